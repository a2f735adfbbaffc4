"""Rules on addresses: page numbers, provenance, identity of a job, links in HTML."""

from __future__ import annotations

import html as entities
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Viewers by the domain that their host contains, in order.
VIEWERS = [("issuu.com", "Issuu"), ("calameo.com", "Calameo"), ("calameo.es", "Calameo"), ("flippingbook.com", "FlippingBook"), ("fliphtml5.com", "FlipHTML5"), ("joomag.com", "Joomag"), ("publuu.com", "Publuu"), ("anyflip.com", "AnyFlip"), ("ourdigitalmag.com", "OurDigitalMag")]
# Names of a page number in an address, and words in addresses of legal texts.
PAGE_KEYS = ["page", "p", "pagina", "slide"]
LEGAL_WORDS = ["politica", "aviso", "privacid", "cookie"]


def safe_source(url: Column) -> Column:
    """Without query and fragment, which may hold access tokens."""
    return F.regexp_replace(url, r"[?#].*$", "")


def url_path(url: Column) -> Column:
    return F.regexp_replace(safe_source(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")


def last_match(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), 1)
    return F.try_element_at(found, F.lit(-1))


def page_number(url: Column) -> Column:
    """From the query (page, p, pagina, slide; first value, digits, above 0), else the last such mark in the path, else the last digits of its last part."""
    query = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"\?(.*)$", 1)
    named = [F.regexp_extract(query, rf"(?:^|&){k}=([^&]+)", 1) for k in PAGE_KEYS]
    from_query = F.coalesce(*[F.when(v.rlike(r"^\d+$"), positive(v)) for v in named])
    path = url_path(url)
    marked = last_match(path, r"(?i)(?:page|pagina|slide|p)[_\-/]*(\d+)")
    return F.coalesce(from_query, marked.try_cast("int"), last_match(F.substring_index(path, "/", -1), r"(\d+)").try_cast("int"))


def positive(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n > 0, n)


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def job_id(url: Column, pdf: Column | None = None) -> Column:
    """The first 24 hex digits of a hash of the source: the bytes of a PDF if there are any, else the address."""
    name = F.concat(F.lit("url:"), normal_url(url))
    if pdf is not None:
        name = F.when(pdf.isNotNull(), F.concat(F.lit("pdf:"), F.sha2(pdf, 256))).otherwise(name)
    return F.left(F.sha2(name.cast("binary"), 256), F.lit(24))


def is_pdf(content: Column, content_type: Column, url: Column) -> Column:
    head = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    return F.coalesce(head, F.lit(False)) | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False)) | F.coalesce(F.lower(url_path(url)).endswith(".pdf"), F.lit(False))


@F.pandas_udf(T.StringType())
def resolved(link: pd.Series, base: pd.Series) -> pd.Series:
    """Links with character references decoded and resolved against their page; no built-in does either."""
    return pd.Series([None if a is None else urljoin(b or "", entities.unescape(a)) for a, b in zip(link, base)])


def declared_total(c: Column) -> Column:
    """The largest page total from 2 to 5000 that a counter text declares."""
    two = [F.regexp_extract_all(c, F.lit(p), 1) for p in (r"(?iU)\b\d{1,4}\s*(?:/|de|of)\s*(\d{1,4})\b", r"(?iU)\b(?:total(?:\s+de)?|pages?|paginas|páginas)\D{0,12}(\d{1,4})\b")]
    whole = F.when(F.trim(c).rlike(r"^\d+$"), F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))
    numbers = F.transform(F.concat(*two, whole), lambda v: v.try_cast("int"))
    return F.array_max(F.filter(numbers, lambda n: (n > 1) & (n <= 5000)))
