"""Coverage of an analysis and checks of a source, for all issues at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adatlas.functions import text as X

NONE = "array<int>"


def numbers(c: str, when: Column) -> Column:
    """The distinct positive page numbers of the rows that meet a condition, in order."""
    return F.array_sort(F.collect_set(F.when(when & X.positive_int(F.col(c)).isNotNull(), X.positive_int(F.col(c)))))


def joined(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), ", ")


def missing(expected: Column, have: Column) -> Column:
    """1 to expected without what there is; empty for no or a non-positive total."""
    return F.when(expected >= 1, F.array_except(F.sequence(F.lit(1), expected), have)).otherwise(F.array().cast(NONE))


def duplicate_numbers(pages: DataFrame) -> DataFrame:
    """Page numbers that an issue has more than once."""
    return pages.where(X.positive_int(F.col("page_no")).isNotNull()).groupBy("issue_id", "page_no").agg(F.count("*").alias("n")).where("n > 1")


def checked_source(sources: DataFrame, pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status, expected and missing pages, and the messages of each issue's source.

    sources: issue_id, kind, viewer, expected_pages, local_pdf; pages: issue_id, page_no and, where images were read,
    unreadable and low_resolution; manifest: issue_id, page_number, status.
    """
    for c in ("unreadable", "low_resolution"):
        pages = pages if c in pages.columns else pages.withColumn(c, F.lit(False))
    yes = F.lit(True)
    p = pages.groupBy("issue_id").agg(F.count("*").cast("int").alias("obtained_pages"), numbers("page_no", yes).alias("have"), numbers("page_no", F.col("unreadable")).alias("unreadable_pages"), numbers("page_no", ~F.col("unreadable") & F.col("low_resolution")).alias("low_resolution_pages"))
    d = duplicate_numbers(pages).groupBy("issue_id").agg(F.array_sort(F.collect_list(F.col("page_no").cast("int"))).alias("duplicate_numbers"))
    m = manifest.groupBy("issue_id").agg(numbers("page_number", F.col("status") == "ok").alias("ok"), numbers("page_number", F.col("status") == "failed").alias("bad"), numbers("page_number", yes).alias("listed"))
    own = sources.join(p, "issue_id", "left").join(d, "issue_id", "left").join(m, "issue_id", "left")
    lists = ["have", "unreadable_pages", "low_resolution_pages", "duplicate_numbers", "ok", "bad", "listed"]
    own = own.withColumns({c: F.coalesce(F.col(c), F.array().cast(NONE)) for c in lists}).withColumn("obtained_pages", F.coalesce("obtained_pages", F.lit(0)))
    declared = X.positive_int(F.col("expected_pages"))
    inferred = F.when(F.get("listed", F.lit(0)) == 1, F.try_element_at("listed", F.lit(-1)))
    own = own.withColumn("completeness_known", (F.col("kind") == "pdf") | declared.isNotNull())
    own = own.withColumn("expected_pages", F.when(F.col("kind") == "pdf", F.col("obtained_pages")).otherwise(F.coalesce(declared, inferred)))
    own = own.withColumn("missing_pages", missing(F.col("expected_pages"), F.col("have"))).withColumn("failed_pages", F.array_except("bad", "ok"))
    # The messages below
    n = lambda c: F.size(c).cast("string")
    some = lambda c: F.size(c) > 0
    blocking = F.array_compact(
        F.array(
            F.when(F.col("obtained_pages") == 0, "No se obtuvo ninguna pagina procesable."),
            F.when(some("missing_pages"), F.concat(F.lit("Faltan "), n("missing_pages"), F.lit(" pagina(s): "), joined(F.slice("missing_pages", 1, 20)), F.when(F.size("missing_pages") > 20, "...").otherwise(""))),
            F.when(some("failed_pages"), F.concat(F.lit("Fallaron "), n("failed_pages"), F.lit(" descarga(s) de pagina."))),
            F.when(some("unreadable_pages"), F.concat(F.lit("Hay "), n("unreadable_pages"), F.lit(" imagen(es) ausentes o danadas."))),
            F.when(some("duplicate_numbers"), F.concat(F.lit("La numeracion contiene paginas duplicadas: "), joined(F.col("duplicate_numbers")))),
        )
    )
    warnings = F.array_compact(F.array(F.when(~F.col("completeness_known"), "El lector no publica el total de paginas; se valida lo obtenido."), F.when(some("low_resolution_pages"), F.concat(n("low_resolution_pages"), F.lit(" pagina(s) tienen baja resolucion.")))))
    kind = F.when(F.col("local_pdf"), "PDF local").when(F.col("kind") == "pdf", "PDF").otherwise("Lector por imagenes")
    own = own.withColumn("blocking_reasons", blocking).withColumn("warnings", warnings).withColumn("source_type", kind).withColumn("viewer", F.coalesce("viewer", F.lit("")))
    return own.withColumn("status", F.when(some("blocking_reasons"), "incompleta").otherwise("lista")).drop("have", "ok", "bad", "listed", "local_pdf")


def ready(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows (pages or spreads) of issues whose source is ready: only these go to a model. Text mode takes the others too."""
    return rows.join(checked.where("status = 'lista'").select("issue_id"), "issue_id", "left_semi")


def reusable(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether a stored source may be used again: PDFs always; images without failures, with enough pages and any path."""
    m = manifest.groupBy("issue_id").agg(F.count_if(F.col("status") == "failed").alias("bad"), F.count_distinct(F.when(F.col("status") == "ok", F.col("page_number").try_cast("int"))).alias("good"))
    own = sources.join(m, "issue_id", "left").fillna(0, ["bad", "good"])
    enough = F.coalesce(F.col("good") >= F.when(F.col("expected_pages") > 0, F.col("expected_pages")), F.lit(True))
    return own.withColumn("reusable", (F.col("kind") == "pdf") | ((F.col("bad") == 0) & enough & (F.col("n_paths") > 0))).drop("bad", "good")


def coverage(issues: DataFrame) -> DataFrame:
    """Status of each issue. issues: issue_id, mode, total_pages, failed_pages, source_failed_pages, partial_pages, invalid_items, fallback."""
    e = lambda c: F.coalesce(F.col(c), F.array().cast(NONE))
    own = issues.withColumn("failed_pages", F.array_sort(F.array_union(e("failed_pages"), e("source_failed_pages")))).withColumn("partial_pages", F.array_sort(F.array_distinct(e("partial_pages"))))
    own = own.withColumn("paginas_analizadas", F.greatest(F.lit(0), F.col("total_pages") - F.size("failed_pages")))
    partial = (F.size("failed_pages") > 0) | (F.size("partial_pages") > 0) | (F.coalesce("invalid_items", F.lit(0)) > 0) | F.coalesce("fallback", F.lit(False))
    state = F.when((F.col("mode") == "ia") & (F.col("total_pages") > 0) & (F.col("paginas_analizadas") == 0), "fallido").when(partial, "parcial").otherwise("completo")
    return own.withColumn("estado", state).withColumn("modo_solicitado", F.when((F.col("mode") == "ia") | F.coalesce("fallback", F.lit(False)), "ia").otherwise("heuristica"))
