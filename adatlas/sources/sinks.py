"""Writers: CSV and JSON exports, appearances, all-or-nothing publication, idempotent exports, stored work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adatlas.functions import text as X
from adatlas.operators import report as R
from adatlas.operators import review as V
from adatlas.sources.stored_library import Library

# The columns of the CSV export and their headers, in order.
CSV_COLUMNS = {
    "brand": "Marca", "sector": "Sector", "pages": "Paginas", "website": "Web", "email": "Email", "phone": "Telefono", "ad_size": "Tamano anuncio",
    "confidence": "Confianza", "method": "Metodo", "notes": "Notas", "state": "Estado analisis", "coverage": "Cobertura",
}


def csv_rows(ads: DataFrame, meta: DataFrame) -> DataFrame:
    """Advertisers as text columns under the export's headers: pages joined, confidence in percent, the issue's state and coverage.

    meta: issue_id, estado, estado_analisis, paginas_no_analizadas, paginas_parciales.
    """
    of = meta.select("issue_id", R.coverage_state().alias("state"), R.coverage_text().alias("coverage"))
    own = ads.join(of, "issue_id", "left").withColumn("state", F.coalesce("state", F.lit("completo")))
    own = own.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ", ")).withColumn("confidence", X.percent(F.col("confidence")))
    return own.select("issue_id", *[F.coalesce(c, F.lit("")).alias(name) for c, name in CSV_COLUMNS.items()])


def write_csv(ads: DataFrame, meta: DataFrame, path: str) -> None:
    """Semicolons and a header line, a folder for each issue. Spark writes no byte order mark."""
    csv_rows(ads, meta).write.partitionBy("issue_id").option("sep", ";").option("header", True).csv(path)


def json_objects(ads: DataFrame, meta: DataFrame) -> DataFrame:
    """One object for each issue: meta and its advertisers in order of adv_no."""
    row = F.struct("adv_no", *[c for c in ads.columns if c not in ("issue_id", "adv_no")])
    own = ads.groupBy("issue_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("adv_no")).alias("anunciantes"))  # an issue has some hundreds
    return meta.join(own, "issue_id", "left").select("issue_id", F.struct(*[c for c in meta.columns if c != "issue_id"]).alias("meta"), F.coalesce("anunciantes", F.array()).alias("anunciantes"))


def write_json(ads: DataFrame, meta: DataFrame, path: str, compression: str = "none") -> None:
    json_objects(ads, meta).write.option("compression", compression).json(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, export_id: str) -> bool:
    """Writes all tables of an export, or none: into a staging folder, renamed at the end. False if the export is there already."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    final, staging = path(f"{root}/{export_id}"), path(f"{root}/_staging/{export_id}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        return False
    try:
        fs.delete(staging, True)
        for name, table in tables.items():
            table.write.parquet(f"{root}/_staging/{export_id}/{name}")
        return fs.rename(staging, final)
    except Exception:
        fs.delete(staging, True)
        raise


def export_results(ads: DataFrame, meta: DataFrame, root: str, export_id: str, min_confidence: float = 0.0, library: str | None = None) -> bool:
    """All deliverables of reviewed issues, of advertisers of at least some confidence: CSV rows, objects, appearances and summary; then, if a folder is given, the library.

    ads: adv_no and the fields of an advertiser; meta: what the writers ask for, and job_id. The library's save bears the
    export's id, so that a call which broke off is simply repeated: what is there stays, what lacks is done, nothing twice.
    False if all was there already.
    """
    spark, own = ads.sparkSession, V.confident(ads, min_confidence)
    told = meta.select("issue_id", "job_id", F.lit(export_id).alias("export_id"), R.coverage_state().alias("estado"), "url", "titulo")
    tables = {"csv": csv_rows(own, meta), "json": json_objects(own, meta), "appearances": R.appearances(own, told), "summary": R.summary_rows(own, meta)}
    tables["csv"] = tables["csv"].withColumnsRenamed({c: c.replace(" ", "_") for c in CSV_COLUMNS.values()})  # a table's columns have no spaces
    done = publish(spark, tables, root, export_id)
    if library:
        issues = meta.select("issue_id", "titulo", "numero", "url", F.col("fecha").alias("fecha_analisis"), "paginas", "modo", "coste_usd")
        done = Library(spark, library).save(issues, own, save_id=export_id) or done
    return done


def new_exports(exports: DataFrame, done: DataFrame) -> DataFrame:
    """Exports whose id has not been stored yet, each once."""
    return exports.dropDuplicates(["export_id"]).join(done.select("export_id"), "export_id", "left_anti")


def new_work(rows: DataFrame, stored: DataFrame, key: str = "signature") -> DataFrame:
    """Rows to append to stored work: those whose key isn't there."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")
