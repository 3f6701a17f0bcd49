"""Domain-shaped tables derived from the supplied ones, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe.functions import scalars as S
from ecoframe.operators.skew import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


# --- orders as recordings -----------------------------------------------------------------------------

def order_file():
    return F.concat(F.lit("C"), F.col("o_custkey"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"),
                    F.lit("_050000.wav"))


def recordings(spark, sf_dir) -> DataFrame:
    folder = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "c0").otherwise(
        F.concat(F.lit("c"), F.col("o_custkey")))
    path = F.concat(F.lit("/audio/"), F.col("o_orderkey"), F.lit("/"), folder, F.lit("/"), order_file())
    base = table(spark, sf_dir, "orders").withColumn("path", path).withColumn("file", S.base_name(F.col("path")))
    # inline() makes the parsed columns a result of their own: filters and groupings on them do not parse again
    return base.select(F.inline(F.array(F.struct(
        "path", "file", S.recording_site(F.col("file")).alias("site"),
        S.folder_site(F.col("path")).alias("source_site"), S.recording_clock(F.col("file")).alias("clock_start"),
        F.when(F.col("o_orderstatus") == "P", 30.0).otherwise(60.0).alias("duration_s"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 44100).otherwise(48000).alias("rate_hz"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), 2).otherwise(1).alias("channels"),
        F.sha2(cents("o_totalprice").cast("string"), 256).alias("sha256"),
        S.join_messages(S.recording_name_error(F.col("file")),
                        F.when(F.col("o_totalprice") < 2000, "unreadable header")).alias("error")))))


RECORDINGS = """
recordings AS (
  SELECT '/audio/' || o_orderkey || '/' || CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'c0'
           ELSE 'c' || o_custkey END || '/C' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') || '_050000.wav' AS path,
         'C' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') || '_050000.wav' AS file,
         'C' || o_custkey AS site,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'C0' ELSE 'C' || o_custkey END AS source_site,
         o_orderdate::DATE + INTERVAL 5 HOUR AS clock_start,
         CASE WHEN o_orderstatus = 'P' THEN 30.0 ELSE 60.0 END::DOUBLE AS duration_s,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 44100 ELSE 48000 END AS rate_hz,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 2 ELSE 1 END AS channels,
         sha256(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)) AS sha256,
         CASE WHEN o_totalprice < 2000 THEN 'unreadable header' END AS error
  FROM orders)"""


# --- line items as annotations --------------------------------------------------------------------------

def detections(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", order_file().alias("_file"))
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.round(F.col("l_tax") * 500)
    return rows.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice")).alias("ordinal"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A") & (F.col("l_quantity") == 50), "C0")
        .otherwise(F.concat(F.lit("C"), F.col("o_custkey"))).alias("site"),
        F.when((F.col("l_tax") > 0.075) & (F.col("l_returnflag") == "R"),
               F.concat(F.lit("X"), F.col("l_suppkey"), F.lit("_20240101_000000.wav")))
        .otherwise(F.col("_file")).alias("file"),
        F.when(F.col("l_discount") > 0, F.concat(F.lit("sp"), F.col("l_quantity").cast("int"))).alias("species"),
        start.alias("start_s"), (start + F.col("l_quantity")).alias("end_s"))


DETECTIONS = """
detections AS (
  SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' ||
           CAST(round(l_extendedprice * 100) AS BIGINT) AS ordinal,
         CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' AND l_quantity = 50 THEN 'C0' ELSE 'C' || o_custkey END AS site,
         CASE WHEN l_tax > 0.075 AND l_returnflag = 'R' THEN 'X' || l_suppkey || '_20240101_000000.wav'
              ELSE 'C' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') || '_050000.wav' END AS file,
         CASE WHEN l_discount > 0 THEN 'sp' || CAST(l_quantity AS INTEGER) END AS species,
         round(l_tax * 500) AS start_s, round(l_tax * 500) + l_quantity AS end_s
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# --- customers as points ----------------------------------------------------------------------------------

def points(spark, sf_dir) -> DataFrame:
    degrees = F.floor(F.col("c_acctbal") / 100).cast("int").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ordinal"),
        F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 0), "C1").otherwise(
            F.concat(F.lit("C"), F.col("c_custkey"))).alias("site"),
        F.when(F.col("c_nationkey") == 3, F.concat(degrees, F.lit(",5"))).otherwise(degrees).alias("latitude"),
        (F.col("c_nationkey") * 16 - 190).cast("string").alias("longitude"),
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", S.rate_in_hz(F.lit("48,0 kHz"))).alias("declared_rate_hz"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "unknown").otherwise("1995 to 1999, 2000").alias("declared_year"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_nationkey")).alias("annotated_minutes"))


POINTS = """
points AS (
  SELECT c_custkey AS ordinal,
         CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 0 THEN 'C1' ELSE 'C' || c_custkey END AS site,
         CAST(CAST(floor(c_acctbal / 100) AS INTEGER) AS VARCHAR) || CASE WHEN c_nationkey = 3 THEN ',5' ELSE '' END AS latitude,
         CAST(c_nationkey * 16 - 190 AS VARCHAR) AS longitude,
         CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN 48000 END AS declared_rate_hz,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' ELSE '1995 to 1999, 2000' END AS declared_year,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_nationkey END AS annotated_minutes
  FROM customer)"""


# --- campaigns of a customer: one per year of orders, each reaching 30 days into the year before ----------

def yearly_campaigns(spark, sf_dir) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("ordinal")).distinct()
    first = F.make_date("ordinal", F.lit(1), F.lit(1))
    return years.select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("site"),
        F.concat(F.lit("C"), F.col("o_custkey"), F.lit("-"), F.col("ordinal")).alias("campaign_id"),
        F.date_sub(first, 30).cast("timestamp_ntz").alias("clock_start"),
        F.add_months(first, 12).cast("timestamp_ntz").alias("clock_end"), "ordinal")


YEARLY_CAMPAIGNS = """
campaigns AS (
  SELECT DISTINCT 'C' || o_custkey AS site, 'C' || o_custkey || '-' || year(o_orderdate) AS campaign_id,
         make_date(year(o_orderdate), 1, 1) - INTERVAL 30 DAY AS clock_start,
         make_date(year(o_orderdate) + 1, 1, 1)::TIMESTAMP AS clock_end, year(o_orderdate) AS ordinal
  FROM orders)"""


# --- suppliers as sites: orders are their minutes, brands their species ---------------------------------------

def supplier_site(column: str = "l_suppkey"):
    return F.concat(F.lit("S"), F.col(column))


def supplier_recordings(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_shipdate").alias("clock_start"))
    file = F.concat(supplier_site(), F.lit("-"), F.col("l_orderkey"))
    return rows.select(file.alias("path"), file.alias("file"), supplier_site().alias("site"), "clock_start",
                       F.lit(60.0).alias("duration_s"), F.lit(None).cast("string").alias("error"))


def supplier_detections(spark, sf_dir) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.concat(supplier_site(), F.lit("-"), F.col("l_orderkey")).alias("file"),
                       F.col("p_brand").alias("species"))


def supplier_context(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(supplier_site("s_suppkey").alias("site"), F.col("n_name").alias("validation_group"),
                       (F.col("s_nationkey") - 12.0).alias("latitude"), (F.col("n_regionkey") * 30.0).alias("longitude"),
                       F.col("s_name").alias("recorder"))


# --- line items as image composites of their supplier -----------------------------------------------------------

def supplier_series(spark, sf_dir) -> DataFrame:
    """Composites inside the year before the eve of each supplier's last shipment."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linenumber")
    campaigns = rows.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("clock_start"), F.count(F.lit(1)).alias("_n"))
    campaigns = campaigns.select("l_suppkey", "_n", S.window_cut(F.col("clock_start")).alias("cut"),
                                 S.window_start(F.col("clock_start")).alias("window_start"))
    placed = attach(rows, campaigns, ["l_suppkey"], "_n").withColumn("composite_start", F.to_date("l_shipdate"))
    inside = S.inside_window(F.col("composite_start"), F.date_add("composite_start", 15), F.col("window_start"), F.col("cut"))
    return placed.where(inside).select(
        supplier_site().alias("site"), S.campaign_id(supplier_site()).alias("campaign_id"), "cut", "composite_start",
        F.when(F.col("l_returnflag") != "R", F.date_add("composite_start", F.col("l_linenumber"))).alias("observation_date"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("window_n_valid"),
        (F.col("l_discount") * 5 + 0.3).alias("window_ndvi_median"), (F.col("l_tax") * 5 - 0.1).alias("window_ndmi_median"))


SUPPLIER_SERIES = """
windows AS (
  SELECT l_suppkey, max(l_shipdate)::DATE - 1 AS cut, max(l_shipdate)::DATE - 366 AS window_start
  FROM lineitem GROUP BY l_suppkey),
series AS (
  SELECT 'S' || l.l_suppkey AS site, 'S' || l.l_suppkey || '-1' AS campaign_id, cut, l_shipdate::DATE AS composite_start,
         CASE WHEN l_returnflag <> 'R' THEN l_shipdate::DATE + l_linenumber END AS observation_date,
         CAST(floor(l_quantity / 5) AS INTEGER) AS window_n_valid,
         l_discount * 5 + 0.3::DOUBLE AS window_ndvi_median, l_tax * 5 - 0.1::DOUBLE AS window_ndmi_median
  FROM lineitem l JOIN windows w ON l.l_suppkey = w.l_suppkey
  WHERE l_shipdate::DATE >= window_start AND l_shipdate::DATE + 15 <= cut),
used AS (
  SELECT *, window_n_valid >= 5 AS is_used,
         least(greatest(floor(((coalesce(observation_date, composite_start + 8)) - (cut - 365)) / 91.25), 0), 3) AS quarter
  FROM series),
stats AS (
  SELECT site, campaign_id, min(cut) AS cut, count(*) AS composites, count(*) FILTER (is_used) AS composites_used,
         count(DISTINCT quarter) FILTER (is_used) AS quarters_covered,
         count(*) FILTER (is_used AND quarter = 3) AS n_last_quarter,
         quantile_cont(window_ndvi_median, 0.5) FILTER (is_used) AS ndvi,
         quantile_cont(window_ndmi_median, 0.5) FILTER (is_used) AS ndmi,
         quantile_cont(window_ndvi_median, 0.9) FILTER (is_used) AS p90,
         quantile_cont(window_ndvi_median, 0.1) FILTER (is_used) AS p10,
         quantile_cont(window_ndmi_median, 0.5) FILTER (is_used AND quarter = 3) AS ndmi_last
  FROM used GROUP BY site, campaign_id),
optical AS (
  SELECT site, campaign_id, cut, composites, composites_used, CAST(quarters_covered AS INTEGER) AS quarters_covered,
         n_last_quarter, composites_used >= 10 AND quarters_covered = 4 AS coverage_ok,
         CASE WHEN composites_used >= 10 AND quarters_covered = 4 THEN round(ndvi, 6) END AS ndvi_median,
         CASE WHEN composites_used >= 10 AND quarters_covered = 4 THEN round(ndmi, 6) END AS ndmi_median,
         CASE WHEN composites_used >= 10 AND quarters_covered = 4 THEN round(p90 - p10, 6) END AS ndvi_amplitude_p90_p10,
         CASE WHEN composites_used >= 10 AND quarters_covered = 4 AND n_last_quarter >= 2
              THEN round(ndmi_last - ndmi, 6) END AS ndmi_recent_change
  FROM stats)"""

SUPPLIER_ACOUSTIC = """
minute AS (SELECT DISTINCT 'S' || l_suppkey AS site, 'S' || l_suppkey || '-' || l_orderkey AS file FROM lineitem),
heard AS (SELECT 'S' || l_suppkey AS site, p_brand AS species, count(DISTINCT l_orderkey) AS minutes
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
total AS (SELECT site, count(*) AS valid_minutes FROM minute GROUP BY site),
effort AS (SELECT min(valid_minutes) AS m FROM total),
acoustic AS (
  SELECT h.site, h.site || '-1' AS campaign_id, t.valid_minutes, count(*) AS species_detected,
         e.m AS standard_effort_min,
         round(sum(1 - list_reduce(list_transform(range(0, least(h.minutes, e.m)),
             lambda j: greatest(t.valid_minutes::DOUBLE - greatest(h.minutes, e.m) - j, 0) / (t.valid_minutes - j)),
             lambda a, b: a * b)), 6) AS rarefied_richness,
         string_agg(h.species, ';' ORDER BY h.species) AS species
  FROM heard h JOIN total t ON h.site = t.site CROSS JOIN effort e
  GROUP BY h.site, t.valid_minutes, e.m)"""
