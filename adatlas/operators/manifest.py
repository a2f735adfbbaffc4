"""Page manifests: numbering of downloaded images, duplicates, order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from adatlas.functions import rules as RT
from adatlas.functions import urls as U


def image_order(images: DataFrame, url: str = "url") -> DataFrame:
    """Adds image_rank: by page number, images without one last, then by address."""
    n = U.page_number(F.col(url))
    return images.withColumn("image_rank", F.row_number().over(W.partitionBy("issue_id").orderBy(n.isNull(), F.coalesce(n, F.lit(0)), F.lower(url))))


class Claims:
    """The numbers of one issue's images: each new one takes the first free number from the wanted one on.

    next_free leads from a taken number to one that may be free; what is passed on the way is led there directly.
    """

    def __init__(self):
        self.next_free: dict[int, int] = {}
        self.first: dict[str, int] = {}

    def new(self, wanted: int, sha256: str) -> int:
        n, way, next_free = wanted, [], self.next_free
        while n in next_free:
            way.append(n)
            n = next_free[n]
        for k in way:
            next_free[k] = n + 1
        next_free[n] = n + 1
        self.first[sha256] = n
        return n


def claimed(rows: Iterator[dict]) -> Iterator[tuple[dict, int | None, int | None]]:
    """(row, its number, what it repeats) of one issue's rows in order."""
    claims = Claims()
    for row in rows:
        new = row["status"] == "ok"
        yield row, claims.new(row["wanted"], row["sha256"]) if new else row["wanted"], None if new else claims.first.get(row["sha256"])


def numbered(images: DataFrame) -> DataFrame:
    """The manifest of downloaded images: issue_id, idx (from 1), url, sha256 (null where the download failed), bytes.

    Each new image gets the first unused number from its address's number on; a repeated hash is a duplicate of the
    number its first copy got; failed rows claim none. Where numbers come in ascending order, as they do once images
    are sorted by number, windows give the numbers; issues where they don't go through Python, row by row in order of
    idx, with the numbers of one issue at hand. One shuffle, by issue.
    """
    wanted = F.coalesce(F.nullif(U.page_number(F.col("url")), F.lit(0)), F.col("idx").cast("int"))
    own = images.select("issue_id", "idx", wanted.alias("wanted"), U.safe_source(F.col("url")).alias("source_url"), "sha256", "bytes")
    same, order = W.partitionBy("issue_id", "sha256"), W.partitionBy("issue_id").orderBy("idx")
    first = F.row_number().over(same.orderBy("idx"))
    own = own.withColumn("status", F.when(F.col("sha256").isNull(), "failed").when(first > 1, "duplicate").otherwise("ok"))
    ok = F.col("status") == "ok"
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumns({"__rn": F.count_if(ok).over(upto), "__before": F.max(F.when(ok, F.col("wanted"))).over(order.rowsBetween(W.unboundedPreceding, -1))})
    own = own.withColumn("__number", F.col("__rn") + F.max(F.when(ok, F.col("wanted") - F.col("__rn"))).over(upto))
    own = own.withColumn("__falls", F.bool_or(ok & F.coalesce(F.col("wanted") < F.col("__before"), F.lit(False))).over(W.partitionBy("issue_id")))
    columns = ["issue_id", "idx", "page_number", "source_url", "sha256", "bytes", "status", "duplicate_of"]
    number = F.when(ok, F.col("__number")).otherwise(F.col("wanted")).cast("int")
    rising = own.where("not __falls").withColumn("page_number", number)
    of = F.max(F.when(ok, F.col("page_number"))).over(same)
    rising = rising.withColumn("duplicate_of", F.when(F.col("status") == "duplicate", of)).select(*columns)

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, claims = object(), Claims()
        for batch in batches:
            numbers, copies = [], []
            for issue, wanted, sha256, status in zip(*(batch.column(c).to_pylist() for c in ("issue_id", "wanted", "sha256", "status"))):
                if issue != at:
                    at, claims = issue, Claims()
                new = status == "ok"
                numbers.append(claims.new(wanted, sha256) if new else wanted)
                copies.append(None if new else claims.first.get(sha256))
            made = {"page_number": numbers, "duplicate_of": copies}  # other columns go through as they are
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    schema = to_arrow_schema(rising.schema)
    odd = own.where("__falls").select("issue_id", "idx", "wanted", "source_url", "sha256", "bytes", "status").sortWithinPartitions("issue_id", "idx")
    return rising.unionByName(odd.mapInArrow(claim, rising.schema))


def captured(captures: DataFrame) -> DataFrame:
    """Captured resources worth keeping: PDFs by type or suffix, images whose address speaks of pages; each once."""
    path = F.lower(U.url_path(F.col("url")))
    low = F.lower("url")
    pdf = F.lower(F.coalesce("content_type", F.lit(""))).contains("pdf") | path.endswith(".pdf")
    image = F.coalesce("content_type", F.lit("")).startswith("image/") & (low.contains("page") | low.contains("large") | low.contains("slide") | low.contains("/pages/"))
    return captures.withColumn("resource", F.when(pdf, "pdf").when(image, "image")).where("resource is not null").dropDuplicates(["issue_id", "url"])


def pdf_links(html_pages: DataFrame) -> DataFrame:
    """The first quoted address on a page that ends in .pdf and isn't a legal text, resolved. html_pages: id, url, html."""
    quoted = html_pages.select("id", "url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("[\"']([^\"']+)[\"']"), 1)).alias("pos", "link"))
    low = F.lower("link")
    likely = quoted.where(low.contains(".pdf"))  # before Python decodes what is left
    full = likely.withColumn("link", U.resolved("link", "url"))
    bad = F.lit(False)
    for w in U.LEGAL_WORDS:
        bad = bad | low.contains(w)
    return full.where(F.lower(U.url_path(F.col("link"))).endswith(".pdf") & ~bad).groupBy("id").agg(F.min_by("link", "pos").alias("pdf_url"))


#: What marks a page of the viewer 3D FlipBook.
FLIPBOOK = "(?i)_3d-flip-book|fb3d|3dflipbook"


def viewer_rules(spark) -> DataFrame:
    """The known viewers as a rule table: a domain that the host contains, and the viewer's name."""
    return RT.table(spark, U.VIEWERS)


def viewers(html_pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The embedded viewer of a page: 3D FlipBook by its marks, else the first address whose host a rule knows. rules: (priority, pattern, value), by default the known viewers."""
    rules = viewer_rules(html_pages.sparkSession) if rules is None else rules
    own = html_pages.select("id", "url", F.coalesce("html", F.lit("")).alias("html"))
    flip = own.where(F.col("html").rlike(FLIPBOOK)).select("id", F.col("url").alias("viewer_url"), F.lit("3D FlipBook").alias("viewer"))
    links = own.where(~F.col("html").rlike(FLIPBOOK)).select("id", "url", F.posexplode(F.regexp_extract_all("html", F.lit("(?i)(?:src|href)=[\"']([^\"']+)[\"']"), 1)).alias("pos", "link"))
    # an address without a known domain anywhere needs no decoding
    likely = RT.first_rule(links, F.lower("link"), rules, into="__any").where("__any is not null").drop("__any").withColumn("full", U.resolved("link", "url"))
    host = F.lower(F.regexp_extract("full", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    found = RT.first_rule(likely, host, rules).where("rule is not null")
    first = found.groupBy("id").agg(F.min_by(F.struct(F.col("full").alias("viewer_url"), F.col("rule.value").alias("viewer")), "pos").alias("v"))
    return flip.unionByName(first.select("id", "v.viewer_url", "v.viewer"))
