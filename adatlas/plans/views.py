"""Issues, pages, answers and manifests derived from the given tables, once as DataFrames and once as DuckDB texts.

The given tables hold few web addresses, so that most operators get their rows from order lines and parts: a supplier's
year is an issue, an order line an advertiser on one of its 48 pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adatlas.functions import text as X

#: The same text serves both engines; names in braces are tables.
APP = """
SELECT l_suppkey * 10000 + year(l_shipdate) AS issue_id, concat('Rev ', CAST(l_suppkey AS STRING)) AS titulo, CAST(year(l_shipdate) AS STRING) AS numero,
  CAST(1 + l_orderkey % 48 AS INT) AS page_no,
  concat(CASE p_size % 4 WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN concat(p_name, ' Electric') ELSE p_name END, CASE l_returnflag WHEN 'A' THEN ', S.A.' WHEN 'R' THEN ' GmbH' ELSE '' END) AS brand,
  round(l_discount * 10, 2) AS confidence, CASE WHEN l_linestatus = 'O' THEN concat(replace(p_name, ' ', '-'), '.com') ELSE '' END AS website,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('info@', split_part(p_name, ' ', 1), '.es') ELSE '' END AS email, CASE WHEN l_linenumber % 4 = 0 THEN concat('9', lpad(CAST(l_partkey AS STRING), 8, '0')) ELSE '' END AS phone,
  CASE p_size % 9 WHEN 0 THEN '' WHEN 1 THEN 'Alimentación / Quesos' WHEN 2 THEN 'Bebidas / distribucion' WHEN 3 THEN 'Sanitarios y griferia' WHEN 4 THEN 'Agencia SEO para hosteleria' WHEN 5 THEN 'Asistente digital' WHEN 6 THEN 'Catering' WHEN 7 THEN 'Algo raro' ELSE 'Cerámica y azulejo' END AS sector,
  CASE WHEN l_tax > 0.04 THEN 'media pagina' ELSE '' END AS ad_size, l_shipdate AS shipped, l_returnflag AS flag, p_size AS size,
  l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_quantity AS o4, l_extendedprice AS o5, l_suppkey AS supplier
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
ORDER = ["page_no", "o1", "o2", "o3", "o4", "o5"]
MENTION = """
SELECT issue_id, page_no, o1, o2, o3, o4, o5, concat(CASE o2 % 3 WHEN 0 THEN 'Publicidad ' WHEN 1 THEN 'www.' ELSE 'Ver ' END, replace(replace(replace(lower(brand), ', s.a.', ''), ' gmbh', ''), ' ', '-'),
  CASE flag WHEN 'A' THEN '.com' WHEN 'R' THEN '.es' ELSE '.net' END, CASE WHEN o2 % 2 = 0 THEN concat(' info@', split_part(lower(brand), ' ', 1), '.org') ELSE '' END, ' 9', lpad(CAST(o3 AS STRING), 8, '0')) AS piece
FROM {app}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table with fewer splits than there are cores, dealt over all of them by keys, so that what is done to each row does not run in one task. A large table is read as it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(APP, lineitem=spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"), part=table(spark, sf_dir, "part"))


APP_SQL = APP.format(lineitem="lineitem", part="part")


def canonical_sql(c: str) -> str:
    forms = "|".join(X.LEGAL_FORMS)
    return f"trim(regexp_replace(trim(regexp_replace(regexp_replace(translate(lower(coalesce({c}, '')), 'áéíóúüñçàè', 'aeiouuncae'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' (?:{forms})$', ''))"


def norm_sql(c: str) -> str:
    return f"translate(regexp_replace(trim(lower({c})), '[\\s\\-_.]+', '', 'g'), 'áéíóúüñ', 'aeiouun')"


def sector_sql(c: str) -> str:
    padded = f"(' ' || trim(translate(lower({c}), 'áéíóúüñ', 'aeiouun')) || ' ')"
    cases = " ".join(f"WHEN {' OR '.join(f'contains({padded}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{group}'" for group, words in X.SECTORS)
    return f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 'Sin sector' {cases} ELSE 'Otros' END"


#: Advertisers as the library stores them.
ADS_SQL = f"SELECT *, {canonical_sql('brand')} AS canonical, {sector_sql('sector')} AS sector_group FROM ({APP_SQL})"
ISSUES_SQL = f"SELECT issue_id, min(titulo) AS titulo, min(numero) AS numero, min(shipped) AS fecha, count(DISTINCT canonical) AS n_anunciantes FROM ({ADS_SQL}) GROUP BY issue_id"
PAGES_SQL = f"SELECT issue_id, page_no, string_agg(piece, ' ' ORDER BY o1, o2, o3, o4, o5) AS text FROM ({MENTION.format(app=f"({APP_SQL})")}) GROUP BY issue_id, page_no"


def issues(ads: DataFrame) -> DataFrame:
    return ads.groupBy("issue_id").agg(F.min("titulo").alias("titulo"), F.min("numero").alias("numero"), F.min("shipped").alias("fecha"), F.count_distinct("canonical").alias("n_anunciantes"))


def ad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each issue and page; pos is the page number."""
    pieces = spark.sql(MENTION, app=app(spark, sf_dir)).repartition("issue_id", "page_no")  # few pieces of a page meet in a task before
    order = F.array_sort(F.collect_list(F.struct("o1", "o2", "o3", "o4", "o5", "piece")))
    return pieces.groupBy("issue_id", "page_no").agg(F.array_join(F.transform(order, lambda p: p.piece), " ").alias("text")).withColumn("pos", F.col("page_no"))


#: One broken-down answer for each order line; every seventh entry breaks a rule.
ANSWER = """
SELECT issue_id, page_no AS spread_no, o1, o2, o3, o4, o5, concat('{{"anuncios":[{{"marca":', CASE WHEN o3 % 11 = 0 THEN '"  "' WHEN o3 % 13 = 0 THEN '7' ELSE concat('"', brand, ' "') END, ',"pagina":', CASE WHEN o3 % 7 = 0 THEN '99' WHEN o3 % 5 = 0 THEN 'null' ELSE CAST(page_no AS STRING) END,
  ',"web":"', website, '","telefono":', CASE WHEN o3 % 3 = 0 THEN '912345678' WHEN o3 % 17 = 0 THEN 'true' ELSE '"912 "' END, ',"confianza":', CASE WHEN o3 % 19 = 0 THEN '"0.5"' WHEN o3 % 23 = 0 THEN '1.5' WHEN o3 % 29 = 0 THEN 'null' ELSE CAST(confidence AS STRING) END, '}}]}}') AS raw, page_no
FROM {app}
"""
