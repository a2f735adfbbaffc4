"""Brands in page text: mentions, the aggregate per issue and brand, and the merging of brands that share a page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.functions import rules as RT
from adatlas.functions import text as X

# The notes of brands found in text.
AD_NOTE, PLAIN_NOTE, MERGED_NOTE = "Pagina con aspecto de anuncio.", "Marca mencionada; revisar si es anuncio.", " (marca consolidada automaticamente)"


def mentions(pages: DataFrame, text: str = "text", blocked: DataFrame | None = None) -> DataFrame:
    """One row for each unblocked web address on a page. pages: issue_id, pos, page_no and the text.

    blocked: a rule table (priority, pattern, value) of domains that an address may not end with, in place of those in code.
    """
    own = pages.select("issue_id", "pos", "page_no", F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = own.withColumn("urls", F.regexp_extract_all("t", F.lit(X.URL_PATTERN), 1))
    # other rules run only on pages with an address. No filter and no plain explode stands here: both would be tested down where the text is, by the same rules again
    any_url = F.size("urls") > 0
    rules = {"ad_like": X.is_ad_like(F.col("t")), "email": X.first_email(F.col("t")), "phone": X.first_phone(F.col("t"))}
    own = own.select("issue_id", "pos", "page_no", *[F.when(any_url, c).alias(name) for name, c in rules.items()], F.transform("urls", X.domain_root).alias("roots"))
    own = own.select("issue_id", "pos", "page_no", *rules, F.posexplode_outer("roots").alias("match_idx", "root")).where("match_idx is not null")
    if blocked is None:
        own = own.where(~X.is_blocked(F.col("root")))
    else:
        own = RT.first_rule(own, F.col("root"), blocked, into="__rule", ends=True).where("__rule is null").drop("__rule")
    return own.withColumn("key", X.brand_key(F.col("root")))


def brands(found: DataFrame) -> DataFrame:
    """Mentions by issue and key. Confidence and notes are those of the last mention; website is the shortest, the first of equals."""
    order = F.struct("pos", "match_idx")
    ordered = F.array_sort(F.collect_set(F.struct("pos", "page_no")))
    # dealt before they are aggregated: a mention is smaller than what a task would make of one, and few meet in a task
    out = found.repartition("issue_id", "key").groupBy("issue_id", "key").agg(
        F.min_by("root", F.struct(F.length("root"), order)).alias("website"),
        F.transform(ordered, lambda p: p.page_no).alias("pages"),
        F.min_by("email", F.when(F.col("email") != "", order)).alias("email"),
        F.min_by("phone", F.when(F.col("phone") != "", order)).alias("phone"),
        F.max_by("ad_like", order).alias("ad_like"),
    )
    return out.select(
        "issue_id", "key", X.title_case(F.col("key")).alias("brand"), F.array_distinct("pages").alias("pages"), "website",
        F.coalesce("email", F.lit("")).alias("email"), F.coalesce("phone", F.lit("")).alias("phone"), F.lit("").alias("sector"), F.lit("").alias("ad_size"),
        F.when(F.col("ad_like"), 0.65).otherwise(0.4).alias("confidence"), F.lit("heuristica").alias("method"), F.when(F.col("ad_like"), AD_NOTE).otherwise(PLAIN_NOTE).alias("notes"),
    )


FILLED = ("website", "email", "phone", "sector", "ad_size")


def absorbed(kept: dict, row: dict) -> None:
    """Merges a brand into one that stays: the shorter name, all pages, what was empty, the higher confidence."""
    if len(row["brand"]) < len(kept["brand"]):
        kept["brand"], kept["website"] = row["brand"], row["website"] or kept["website"]
    kept["pages"] = sorted({*kept["pages"], *row["pages"]})
    kept |= {c: kept[c] or row[c] for c in FILLED}
    kept["confidence"] = max(kept["confidence"], row["confidence"])
    kept["notes"] += MERGED_NOTE


def fold(rows: list[dict]) -> list[dict]:
    """The brands of one root, strongest first: each goes to the first kept one of its pages where one name begins with the other."""
    kept: list[dict] = []
    for row in sorted(rows, key=lambda r: (-r["confidence"], r["brand"])):
        name, on = row["brand"].lower(), set(row["pages"])
        near = (k for k in kept if not on.isdisjoint(k["pages"]) and (name.startswith(k["brand"].lower()) or k["brand"].lower().startswith(name)))
        if into := next(near, None):
            absorbed(into, row)
        else:
            kept.append(row)
    return kept


def with_roots(found: DataFrame) -> DataFrame:
    """Adds low, the brand in lower case, root_no, which counts the roots of an issue, and of_root, the number of brands of one root.

    A root is a brand that begins with no other; all that begin with it stand behind it in order of name, before its
    last possible continuation. Of these continuations the greatest so far belongs to the root that stands last.
    """
    order = W.partitionBy("issue_id").orderBy("low")
    reach = F.max(F.concat("low", F.lit("\U0010ffff"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    own = found.withColumn("low", F.lower("brand")).withColumn("__reach", reach)
    is_root = F.coalesce(F.col("__reach") <= F.col("low"), F.lit(True))
    own = own.withColumn("root_no", F.sum(is_root.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__reach")
    return own.withColumn("of_root", F.count("*").over(W.partitionBy("issue_id", "root_no")))


def consolidated(found: DataFrame) -> DataFrame:
    """Merges brands of an issue that share a page where one name begins with the other.

    Only brands with a common root can, so that a brand alone with its root stays as it is; the others of a root are
    folded in Python, one root at a time being held. One shuffle, by issue.
    """
    columns = found.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                root = row["issue_id"], row.pop("root_no")
                if root != at:
                    done += fold(group)
                    at, group = root, []
                group.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema([batch.schema.field(c) for c in columns]))
        if group:
            yield pa.RecordBatch.from_pylist(fold(group), schema=pa.schema([batch.schema.field(c) for c in columns]))

    own = with_roots(found)
    several = own.where("of_root > 1").select(*columns, "root_no").sortWithinPartitions("issue_id", "root_no")
    return own.where("of_root = 1").select(*columns).unionByName(several.mapInArrow(merge, found.schema))


def detected(pages: DataFrame, text: str = "text", blocked: DataFrame | None = None) -> DataFrame:
    """Free mode from pages to merged brands."""
    return consolidated(brands(mentions(pages, text, blocked)))
