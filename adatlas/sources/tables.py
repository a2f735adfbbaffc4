"""Readers: pages, stored work, model answers, replayed results, PDF and image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from adatlas.functions import images as I
from adatlas.functions import text as X
from adatlas.functions import urls as U

PAGES = "issue_id STRING, page_no INT, image_path STRING, embedded_text STRING, ocr_text STRING"
RESPONSES = "issue_id STRING, spread_no INT, page_nums ARRAY<INT>, raw STRING, stop_reason STRING, model STRING, input BIGINT, output BIGINT, cache_write BIGINT, cache_read BIGINT"
ADVERTISER = "brand STRING, pages ARRAY<INT>, website STRING, email STRING, phone STRING, sector STRING, ad_size STRING, confidence DOUBLE, method STRING, notes STRING, review_flag STRING"


def pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Pages with pos, from 0, in order of number, and the best text of each."""
    own = spark.read.schema(PAGES).format(kind).load(path)
    pos = F.row_number().over(W.partitionBy("issue_id").orderBy("page_no")) - 1
    return own.withColumn("pos", pos).withColumn("text", X.best_text(F.col("embedded_text"), F.col("ocr_text")))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Model answers; truncated where the model ran out of tokens."""
    return spark.read.schema(RESPONSES).json(path).withColumn("truncated", F.col("stop_reason") == "max_tokens")


def stored(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """Stored work as JSON lines: broken lines and other versions are left out."""
    row = F.from_json("value", f"{schema}, version INT, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    return spark.read.text(path).select(row.alias("r")).select("r.*").where(f"_corrupt_record is null and version = {version}").drop("_corrupt_record")


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Advertisers of saved results, whole files. For results by the hundred thousand a table of them is far quicker; see replayed."""
    return replayed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "file")


def replayed(results: DataFrame, *keys: str) -> DataFrame:
    """Advertisers of saved results: a list, or an object with anunciantes or advertisers. results: keys and value, a result's whole text."""
    body = results.select(*keys, F.try_parse_json("value").alias("v"))
    kind = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in ADVERTISER.split(', '))}>>"
    rows = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.anunciantes", "$.advertisers")])
    items = body.select(*keys, F.posexplode(rows).alias("at", "item"))
    cast = F.from_json(F.to_json("item"), kind[len("array<") : -1])
    return items.select(*keys, "at", cast.alias("a")).select(*keys, "at", "a.*")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that are PDFs, by suffix or first bytes, with size, time and job id."""
    own = spark.read.format("binaryFile").load(path)
    return own.where(U.is_pdf(F.col("content"), F.lit(""), F.col("path"))).select("path", "length", "modificationTime", U.job_id(F.col("path"), F.col("content")).alias("job_id"))


def sized(files: DataFrame) -> DataFrame:
    """path, width and height of image files (path, content), null where they can't be read: from the first bytes, and from the whole file only where its size stands further on."""
    own = files.select("path", "content", I.sizes(*I.ends(F.col("content"))).alias("s"))
    own = own.withColumn("w", I.sizes(F.when(F.col("s.more"), F.col("content")), F.lit(b"")))
    return own.select("path", F.coalesce("s.width", "w.width").alias("width"), F.coalesce("s.height", "w.height").alias("height"))


def checked_images(files: DataFrame, expected: DataFrame, least: int = 800) -> DataFrame:
    """expected (issue_id, page_no, image_path) with width, height, unreadable (absent, empty or damaged) and low_resolution (the longer side below `least`). files: path, content."""
    own = sized(files).select(F.regexp_replace("path", "^file:/*", "/").alias("image_path"), "width", "height")
    out = expected.join(own.groupBy("image_path").agg(F.max("width").alias("width"), F.max("height").alias("height")), "image_path", "left")
    unreadable = F.col("width").isNull()
    return out.withColumn("unreadable", unreadable).withColumn("low_resolution", ~unreadable & (F.greatest("width", "height") < least))


def image_files(spark: SparkSession, path: str, expected: DataFrame, least: int = 800) -> DataFrame:
    """checked_images over the files of a folder."""
    return checked_images(spark.read.format("binaryFile").load(path).select("path", "content"), expected, least)


def unchanged(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files whose size and time equal their stored marker."""
    return files.join(markers, ["path", "length", "modificationTime"], "left_semi")
