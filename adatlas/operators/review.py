"""Review of advertisers: reasons to look, decisions, queues and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adatlas.functions import text as X
from adatlas.functions.ordered import in_order

FIELDS = ["brand", "sector", "website", "email", "phone", "ad_size"]


def with_variants(ads: DataFrame) -> DataFrame:
    """Adds norm, the form in which brands are compared, and is_variant: whether another brand of the issue is a proper beginning of it, or it of another one.

    With the distinct names of an issue in order, a name begins others if it begins the next one; and it begins with an
    earlier one if it stands before that one's last possible continuation, of which only the greatest so far is kept. An
    empty name begins every other, but makes no variant of it. Names are ordered over parts of bounded size, so that an
    issue may be as large as it likes.
    """
    own = ads.withColumn("norm", X.compare_key(F.col("brand")))
    names = own.select("issue_id", "norm").distinct().withColumn("__ends", F.when(F.col("norm") != "", F.concat("norm", F.lit("\U0010ffff"))))
    names = in_order(names, ["issue_id"], [(F.col("norm"), False)], lead={"__next": "norm"}, most={"__reach": "__ends"})
    begins, begun = F.coalesce(F.startswith("__next", "norm"), F.lit(False)), F.coalesce(F.col("__reach") > F.col("norm"), F.lit(False))
    names = names.select(F.col("issue_id").alias("__issue"), F.col("norm").alias("__norm"), (begins | begun).alias("is_variant"))
    return own.join(names, own["issue_id"].eqNullSafe(names["__issue"]) & (own["norm"] == names["__norm"])).drop("__issue", "__norm")


def flagged(ads: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds review_reasons, in the fixed order low_conf, magazine, short, weird, variant. issues: issue_id and titulo, the publication's name; an issue without one is not compared with it."""
    titles = issues.groupBy("issue_id").agg(X.compare_key(F.min("titulo")).alias("magazine"))
    own = with_variants(ads).join(titles, "issue_id", "left")
    norm, magazine = F.col("norm"), F.coalesce("magazine", F.lit(""))
    reasons = F.array(
        F.when(F.col("confidence") < 0.70, F.lit("low_conf")),
        F.when((magazine != "") & (norm != "") & (F.contains(magazine, norm) | F.contains(norm, magazine)), F.lit("magazine")),
        F.when(F.length(F.regexp_replace(norm, "[^a-z0-9]", "")) < 3, F.lit("short")),
        F.when(F.coalesce(F.col("brand"), F.lit("")).rlike(r"(?U)[^\p{L}\p{N}_\s&'\-.]"), F.lit("weird")),
        F.when(F.col("is_variant"), F.lit("variant")),
    )
    return own.withColumn("review_reasons", F.array_compact(reasons)).drop("norm", "is_variant", "magazine")


def with_partial(ads: DataFrame, coverage: DataFrame) -> DataFrame:
    """Adds partial_analysis once to advertisers on partly analysed pages, or to all of an issue with unanalysed pages or a fallback."""
    c = coverage.select("issue_id", F.col("failed_pages").alias("__failed"), F.col("partial_pages").alias("__partial"), F.col("fallback").alias("__fallback"))
    own = ads.join(c, "issue_id", "left")
    hit = (F.size(F.coalesce("__failed", F.array().cast("array<int>"))) > 0) | F.coalesce("__fallback", F.lit(False)) | F.coalesce(F.arrays_overlap("pages", "__partial"), F.lit(False))
    return own.withColumn("review_reasons", F.when(hit, F.array_union("review_reasons", F.array(F.lit("partial_analysis")))).otherwise(F.col("review_reasons"))).drop("__failed", "__partial", "__fallback")


def confident(ads: DataFrame, least: float = 0.0) -> DataFrame:
    """Advertisers of at least some confidence; by default all."""
    return ads.where(F.coalesce("confidence", F.lit(0.0)) >= least) if least > 0 else ads


def review_items(ads: DataFrame) -> DataFrame:
    """What a reviewer is shown of each advertiser: empty texts for nulls, the reasons and their labels."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    reasons = F.coalesce("review_reasons", F.array().cast("array<string>"))
    return ads.select(
        "issue_id", "adv_idx", *map(blank, FIELDS), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), blank("method"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"),
        F.array_join(reasons, ",").alias("review_flag"), X.review_label(reasons).alias("review_label"),
    )


def first_page(ads: DataFrame, pages: DataFrame) -> DataFrame:
    """Each advertiser with the image of its first page, null where there is none. pages: issue_id, page_no, image_path."""
    own = ads.withColumn("page_no", F.get("pages", F.lit(0)))
    return own.join(pages.select("issue_id", "page_no", F.nullif("image_path", F.lit("")).alias("image_path")), ["issue_id", "page_no"], "left")


def decided(ads: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies decisions by (issue_id, adv_idx): the last given value of each field, any drop; indexes that aren't there vanish."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in FIELDS]
    d = decisions.groupBy("issue_id", "adv_idx").agg(*last, F.bool_or(F.coalesce(F.col("state") == "drop", F.lit(False))).alias("__drop"))
    out = ads.join(d, ["issue_id", "adv_idx"], "left").where("not coalesce(__drop, false)")
    return out.withColumns({c: F.coalesce(X.strip(F.col(f"__{c}")), F.col(c)) for c in FIELDS}).drop(*[f"__{c}" for c in FIELDS], "__drop")


def review_queue(ads: DataFrame, coverage: DataFrame) -> DataFrame:
    """Flagged advertisers, or all of an issue whose analysis is partial."""
    own = ads.join(coverage.select("issue_id", "estado"), "issue_id", "left")
    return own.where((F.size("review_reasons") > 0) | (F.col("estado") == "parcial")).drop("estado")


def export_gate(ads: DataFrame, coverage: DataFrame) -> DataFrame:
    """For each issue: auto (nothing flagged, complete), review, or error (not complete and without advertisers)."""
    n = ads.groupBy("issue_id").agg(F.count("*").alias("total"), F.count_if(F.size("review_reasons") > 0).alias("flagged"))
    own = coverage.select("issue_id", "estado").join(n, "issue_id", "left").fillna(0, ["total", "flagged"])
    gate = F.when((F.col("estado") != "completo") & (F.col("total") == 0), "error").when((F.col("flagged") == 0) & (F.col("estado") == "completo"), "auto").otherwise("review")
    return own.withColumn("gate", gate)


def review_counts(ads: DataFrame, decisions: DataFrame) -> DataFrame:
    """Kept, dropped and pending advertisers of each issue, by the last decision on each."""
    d = decisions.groupBy("issue_id", "adv_idx").agg(F.max_by("state", "seq").alias("state"))
    own = ads.join(d, ["issue_id", "adv_idx"], "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    return own.groupBy("issue_id").agg(F.count_if(F.col("state") == "keep").alias("kept"), F.count_if(F.col("state") == "drop").alias("dropped"), F.count_if(F.col("state") == "pending").alias("pending"))
