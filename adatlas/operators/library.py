"""The library of issues: saving, migrating, comparing, history, share of voice, previous issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.functions import rules as RT
from adatlas.functions import text as X
from adatlas.functions.ordered import Order, in_order


def with_sector_group(ads: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds sector_group: by the rules in code, or by a table (priority, pattern, value) of which the first rule that the sector contains gives the group."""
    if rules is None:
        return ads.withColumn("sector_group", X.sector_group(F.col("sector")))
    own = RT.first_rule(ads, X.sector_text(F.col("sector")), rules, into="__rule")
    blank = X.strip(X.text(F.col("sector"))) == ""
    return own.withColumn("sector_group", F.when(blank, X.NO_SECTOR).otherwise(F.coalesce("__rule.value", F.lit(X.OTHER_SECTOR)))).drop("__rule")


def sector_rules(spark) -> DataFrame:
    """The rules in code as a table."""
    return RT.table(spark, [(word, group) for group, words in X.SECTORS for word in words])


def stored_advertisers(ads: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds canonical and sector_group (see with_sector_group); a null confidence is 0."""
    own = ads.withColumn("canonical", X.canonical_brand(F.col("brand"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return with_sector_group(own, rules)


def stored_issues(meta: DataFrame, ads: DataFrame) -> DataFrame:
    """Issue rows as they are stored: page count only if all digits, no zero cost, a default title, the number of advertisers."""
    pages = F.col("paginas").cast("string")
    counts = ads.groupBy("issue_id").agg(F.count("*").alias("n_anunciantes"))
    out = meta.withColumn("paginas", F.when(pages.rlike(r"^\d+$"), pages.try_cast("int"))).withColumn("coste_usd", F.nullif(F.col("coste_usd").cast("double"), F.lit(0.0))).withColumn("titulo", F.coalesce("titulo", F.lit("Revista")))
    return out.join(counts, "issue_id", "left").withColumn("n_anunciantes", F.coalesce("n_anunciantes", F.lit(0)).cast("int"))


def listed_issues(issues: DataFrame) -> DataFrame:
    """All issues, the last analysed first."""
    return issues.orderBy(F.desc("fecha"), F.desc("issue_id"))


def issue(issues: DataFrame, issue_id) -> DataFrame:
    """The issue of an id: one row or none."""
    return issues.where(F.col("issue_id") == F.lit(issue_id))


def listed_advertisers(ads: DataFrame, issue_id=None) -> DataFrame:
    """Advertisers of an issue, or of every issue, by brand; place counts them from 1. Equal brands stand in no set order."""
    own = ads if issue_id is None else ads.where(F.col("issue_id") == F.lit(issue_id))
    return own.withColumn("place", F.row_number().over(W.partitionBy("issue_id").orderBy("brand")))


def library_view(ads: DataFrame) -> DataFrame:
    """What the library shows of an issue's advertisers."""
    return listed_advertisers(ads).select("issue_id", "place", F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("sector", F.lit("")).alias("sector"))


def migrated(ads: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Fills a missing or empty sector_group from the sector."""
    old = F.col("sector_group") if "sector_group" in ads.columns else F.lit(None).cast("string")
    own = with_sector_group(ads.withColumn("__old", old), rules)
    return own.withColumn("sector_group", F.coalesce(F.nullif("__old", F.lit("")), "sector_group")).drop("__old")


def without_issues(table: DataFrame, issues: DataFrame) -> DataFrame:
    """What stays of a table after deleting issues."""
    return table.join(issues.select("issue_id").distinct(), "issue_id", "left_anti")


def latest(ads: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each issue and canonical brand in the given order; rows without a canonical brand are left out."""
    row = F.struct(*[c for c in ads.columns if c not in ("issue_id", "canonical")])
    return ads.where("canonical <> ''").repartition("issue_id", "canonical").groupBy("issue_id", "canonical").agg(F.max_by(row, F.struct(*order)).alias("r")).select("issue_id", "canonical", "r.*")


def compared(pairs: DataFrame, last: DataFrame) -> DataFrame:
    """For each pair (issue_a, issue_b): every canonical brand with status nuevo, perdido or recurrente; shown as it is in B where it is there."""
    a = pairs.join(last.withColumnRenamed("issue_id", "issue_a"), "issue_a").select("issue_a", "issue_b", "canonical", F.col("brand").alias("brand_a"))
    b = pairs.join(last.withColumnRenamed("issue_id", "issue_b"), "issue_b").select("issue_a", "issue_b", "canonical", F.col("brand").alias("brand_b"))
    status = F.when(F.col("brand_a").isNull(), "nuevo").when(F.col("brand_b").isNull(), "perdido").otherwise("recurrente")
    return a.join(b, ["issue_a", "issue_b", "canonical"], "full").select("issue_a", "issue_b", "canonical", status.alias("status"), F.coalesce("brand_b", "brand_a").alias("brand"))


def fidelity(comparison: DataFrame) -> DataFrame:
    """Counts of a comparison and the part of B's brands that were in A (0 for an empty B)."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = comparison.groupBy("issue_a", "issue_b").agg(count("nuevo").alias("nuevos"), count("perdido").alias("perdidos"), count("recurrente").alias("recurrentes"))
    return out.withColumn("fidelidad", F.coalesce(F.try_divide(F.col("recurrentes"), F.col("recurrentes") + F.col("nuevos")), F.lit(0.0)))


def title() -> Column:
    return F.coalesce(F.nullif("titulo", F.lit("")), F.lit("Revista"))


def by_date() -> list[Order]:
    """Issues of a title by date; of one date the later saved comes first."""
    return [(F.col("fecha"), False), (F.col("issue_id"), True)]


def consecutive(issues: DataFrame) -> DataFrame:
    """Pairs of an issue and the next one of its title, however many issues a title has."""
    own = issues.select("issue_id", "fecha", title().alias("title"))
    return in_order(own, ["title"], by_date(), lag={"issue_a": "issue_id"}).where("issue_a is not null").select("issue_a", F.col("issue_id").alias("issue_b"))


def history(ads: DataFrame, issues: DataFrame, brand: Column | None = None) -> DataFrame:
    """Appearances with their issue's data: of one brand (any spelling), or of all."""
    own = ads if brand is None else ads.where(F.col("canonical") == X.canonical_brand(brand))
    return own.join(issues, "issue_id")


def ordered_history(appearances: DataFrame) -> DataFrame:
    """A history by date, earliest first, of each canonical brand; appearances of one date share a place."""
    return in_order(appearances, ["canonical"], [(F.col("fecha"), False)], rank="place")


def share_of_voice(ads: DataFrame) -> DataFrame:
    """Advertisers of each issue and sector group."""
    group = F.coalesce(F.nullif(F.trim("sector_group"), F.lit("")), F.lit(X.NO_SECTOR))
    return ads.groupBy("issue_id", group.alias("sec")).agg(F.count("*").alias("n"))


def ordered_share(share: DataFrame) -> DataFrame:
    """Sector groups of an issue, the largest first, equal ones by name; place counts them from 1."""
    return share.withColumn("place", F.row_number().over(W.partitionBy("issue_id").orderBy(F.desc("n"), "sec")))


def with_previous(issues: DataFrame) -> DataFrame:
    """Adds the count of the issue before of the same title and the change as shown."""
    own = in_order(issues.withColumn("__title", title()), ["__title"], by_date(), lag={"prev": "n_anunciantes"}).drop("__title")
    step = F.coalesce("n_anunciantes", F.lit(0)) - F.col("prev")
    delta = F.when(F.col("prev").isNull(), "·").when(step > 0, F.concat(F.lit("+"), step.cast("string"))).when(step < 0, step.cast("string")).otherwise("=")
    return own.withColumn("delta", delta)
