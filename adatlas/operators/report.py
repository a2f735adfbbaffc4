"""What reports show: appearances, key figures, sector split, labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.functions import text as X


def indexed(ads: DataFrame, reviewed: bool = False) -> DataFrame:
    """Adds adv_no, from 1, in export order: confidence falling, then brand (after review: lower-cased)."""
    name = F.lower("brand") if reviewed else F.col("brand")
    return ads.withColumn("adv_no", F.row_number().over(W.partitionBy("issue_id").orderBy(F.desc("confidence"), name)))


def appearances(ads: DataFrame, meta: DataFrame) -> DataFrame:
    """One row for each advertiser and page, one too for an advertiser without pages. ads have adv_no; meta: issue_id, job_id, export_id, estado, url, titulo."""
    own = ads.join(meta, "issue_id")
    one = own.withColumn("pages", F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.array(F.lit(None).cast("int"))))
    rows = one.select("*", F.posexplode("pages").alias("at", "page"))
    advertiser = F.concat(X.appearance_prefix(F.col("job_id"), F.col("export_id")), F.lit(":a"), F.format_string("%04d", F.col("adv_no").cast("int")))
    place = F.when(F.col("page").isNotNull(), F.format_string(":p%04d", F.coalesce("page", F.lit(0)))).otherwise(F.format_string(":n%04d", F.col("at") + 1))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        "issue_id", F.concat(advertiser, place).alias("appearance_id"), advertiser.alias("advertiser_id"), blank("brand"), blank("sector"), "page", blank("website"), blank("email"), blank("phone"), blank("ad_size"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), blank("method"), blank("notes"), F.coalesce(F.array_join("review_reasons", ","), F.lit("")).alias("review_flag"),
        F.coalesce(F.nullif("estado", F.lit("")), F.lit("completo")).alias("analysis_status"), F.coalesce("url", F.lit("")).alias("source_url"), F.coalesce("titulo", F.lit("")).alias("source_title"), blank("job_id"), blank("export_id"),
    )


def key_figures(ads: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return ads.groupBy("issue_id").agg(F.count("*").alias("total"), F.count_if(filled("website")).alias("with_web"), F.count_if(filled("email") | filled("phone")).alias("with_contact"))


def coverage_state(state: str = "estado", older: str = "estado_analisis") -> Column:
    return F.coalesce(F.nullif(F.col(state), F.lit("")), F.nullif(F.col(older), F.lit("")), F.lit("completo"))


def coverage_text(missing: str = "paginas_no_analizadas", partial: str = "paginas_parciales") -> Column:
    """Pages that were not, or only partly, analysed, in words."""
    listed = lambda c, words: F.when(F.size(c) > 0, F.concat(F.lit(words), F.array_join(F.col(c).cast("array<string>"), ", ")))
    return F.concat_ws("; ", listed(missing, "no analizadas: "), listed(partial, "respuesta parcial: "))


def spread_list(c: str) -> Column:
    """Spreads as text: pages joined by plus signs, spreads by commas; null for none."""
    return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda s: F.array_join(s.cast("array<string>"), "+")), ", "))


def source_summary() -> Column:
    """One line on a checked source: kind and viewer, pages, status."""
    viewer = F.when(F.coalesce("viewer", F.lit("")) != "", F.concat(F.lit(" ("), "viewer", F.lit(")"))).otherwise("")
    obtained, expected = F.col("obtained_pages").cast("string"), F.col("expected_pages").cast("string")
    pages = F.when(expected.isNull(), F.concat(obtained, F.lit(" paginas; total no publicado"))).otherwise(F.concat(obtained, F.lit("/"), expected, F.lit(" paginas")))
    return F.concat(F.col("source_type"), viewer, F.lit(" · "), pages, F.lit(" · "), F.col("status"))


# The labels of the summary, in order.
SUMMARY = ["Revista", "Fuente", "Modo de deteccion", "Fecha del analisis", "Paginas de la revista", "Estado del analisis", "", "Anunciantes detectados", "Con sitio web", "Con datos de contacto", "Paginas NO analizadas (revisar)", "Paginas con respuesta parcial (revisar)"]


def summary_rows(ads: DataFrame, meta: DataFrame) -> DataFrame:
    """The summary of each issue as rows: place, label, value; the last two labels only where there are such spreads.

    meta: issue_id, titulo, url, modo, fecha, paginas, estado, estado_analisis, pliegos_fallidos, pliegos_parciales.
    """
    own = meta.join(key_figures(ads), "issue_id", "left")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    values = [shown("titulo"), shown("url"), shown("modo"), F.date_format("fecha", "dd/MM/yyyy HH:mm"), shown("paginas"), F.upper(coverage_state()), F.lit(""), count("total"), count("with_web"), count("with_contact"), spread_list("pliegos_fallidos"), spread_list("pliegos_parciales")]
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(label).alias("label"), value.alias("value")) for k, (label, value) in enumerate(zip(SUMMARY, values), 1)])
    return own.select("issue_id", F.inline(rows)).where("value is not null")


def run_metadata(runs: DataFrame) -> DataFrame:
    """What is kept of a run; optional columns are null unless they say something.

    runs: issue_id, modo (ia or heuristica), cost_usd, new_usd, resumed_usd, model, resumed_spreads, failed_spreads,
    partial_spreads, n_invalid, fallback_reason, estado.
    """
    paid = F.col("cost_usd").isNotNull()
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return runs.select(
        "issue_id", F.when(F.col("modo") == "ia", "IA (analisis visual)").otherwise("Heuristica (modo gratis)").alias("modo"),
        F.col("cost_usd").alias("coste_usd"), F.when(paid, F.coalesce("new_usd", "cost_usd")).alias("coste_nuevo_usd"), F.when(paid, F.coalesce("resumed_usd", F.lit(0.0))).alias("coste_reanudado_usd"),
        F.nullif("model", F.lit("")).alias("modelo_ia"), F.nullif("resumed_spreads", F.lit(0)).alias("pliegos_reanudados"), some("failed_spreads").alias("pliegos_fallidos"), some("partial_spreads").alias("pliegos_parciales"),
        F.nullif("n_invalid", F.lit(0)).alias("registros_ia_corregidos"), F.when(F.coalesce("fallback_reason", F.lit("")) != "", True).alias("fallback_heuristica"), F.nullif("fallback_reason", F.lit("")).alias("aviso_fallback"), F.col("estado").alias("estado_analisis"),
    )


def sector_split(ads: DataFrame) -> DataFrame:
    """Sector groups of each issue from the free sectors, with the bar's percent; equal counts in order of first sight (adv_no)."""
    own = ads.groupBy("issue_id", X.sector_group(F.col("sector")).alias("sec")).agg(F.count("*").alias("n"), F.min("adv_no").alias("seen"))
    w = W.partitionBy("issue_id")
    return own.withColumn("pct", 100 * F.col("n") / F.max("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "seen"))).drop("seen")


def issue_labels(issues: DataFrame) -> DataFrame:
    """Labels of the library view: number, title, pages and mode, date to the minute."""
    number = F.trim(F.coalesce(F.col("numero").cast("string"), F.lit("")))
    sub = F.concat_ws(" · ", F.when(F.col("paginas") != 0, F.concat(F.col("paginas").cast("string"), F.lit(" págs"))), F.nullif(F.trim("modo"), F.lit("")))
    return issues.select("issue_id", F.concat(F.lit("#"), F.when(number != "", number).otherwise(F.col("issue_id").cast("string"))).alias("n"), F.coalesce(F.nullif("titulo", F.lit("")), F.lit("Revista")).alias("name"), sub.alias("sub"), F.date_format("fecha_analisis", "yyyy-MM-dd HH:mm").alias("date"))


def searched(labels: DataFrame, query: str) -> DataFrame:
    """Labels that contain the query, without regard to case."""
    return labels.where(F.lower(F.concat("name", "n", "sub")).contains(query.lower()))
