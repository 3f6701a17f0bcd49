"""Threshold curves, lists at equal effort, robustness to gaps and seasonal anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import shapes as T
from ecoframe.operators import robustness as B
from ecoframe.operators import thresholds as H

EFFORT, REPLICATES = 5, 20
LEVELS = (1.0, 0.8, 0.6, 0.4)


def _u(seed: str, *parts: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"('0x' || substr(md5(concat_ws(':', {text})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def threshold_curve(spark, sf_dir):
    """Line items as checked clips: scores in steps, true if the quantity is large, strata drawn with 1/4, 1/2 or all."""
    p = F.when(F.col("l_linestatus") == "O", 0.25).when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0)
    clips = T.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey") % 7).alias("species"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("stratum"),
        (F.floor(F.col("l_extendedprice") / 500) / 200).alias("score"), (F.col("l_quantity") + F.col("l_discount") * 100 > 28).alias("truth"), p.alias("p"))
    out = H.threshold_curve(clips, ["species"])
    return out.select("species", *[F.round(c, 6).alias(c) for c in ("threshold", "accepted", "precision", "recall", "se_precision", "se_recall")])


THRESHOLD_CURVE = """
WITH clips AS (SELECT 'S' || (l_suppkey % 7) AS species, l_returnflag || l_linestatus || l_linenumber AS stratum, floor(l_extendedprice / 500) / 200::DOUBLE AS score,
    (l_quantity + l_discount * 100 > 28)::INT AS truth, CASE WHEN l_linestatus = 'O' THEN 0.25 WHEN l_returnflag = 'R' THEN 0.5 ELSE 1.0 END::DOUBLE AS p FROM lineitem),
strata AS (SELECT species, stratum, count(*)::DOUBLE AS size, sum(1 / p) AS pop, sum(truth)::DOUBLE AS pos FROM clips GROUP BY ALL),
k AS (SELECT *, CASE WHEN size > 1 THEN pop * greatest(pop - size, 0) / (size * (size - 1)) ELSE 0 END AS k FROM strata),
per AS (SELECT species, stratum, score, count(*) AS n, sum(truth) AS tp, sum(1 / p) AS w, sum(truth / p) AS wtp FROM clips GROUP BY ALL),
marks AS (SELECT DISTINCT species, score AS t FROM clips),
marked AS (SELECT m.species, t, k.stratum, any_value(size) AS size, any_value(pos) AS pos, any_value(k) AS k, coalesce(sum(n), 0)::DOUBLE AS sel, coalesce(sum(tp), 0)::DOUBLE AS tp,
    coalesce(sum(w), 0) AS w, coalesce(sum(wtp), 0) AS wtp FROM marks m JOIN k ON k.species = m.species
    LEFT JOIN per ON per.species = m.species AND per.stratum = k.stratum AND per.score >= t GROUP BY ALL),
ratios AS (SELECT *, sum(wtp) OVER (PARTITION BY species, t) / sum(w) OVER (PARTITION BY species, t) AS p FROM marked),
recalls AS (SELECT ratios.*, sum(wtp) OVER (PARTITION BY species, t) / nullif(allw, 0) AS r, allw FROM ratios
    JOIN (SELECT species, sum(wtp) AS allw FROM per GROUP BY species) USING (species)),
v AS (SELECT species, t, any_value(p) AS p, any_value(r) AS r, any_value(allw) AS allw, sum(w) AS w,
    sum(k * (tp * (1 - p) ** 2 + (sel - tp) * p * p - (tp - p * sel) ** 2 / size)) AS vp,
    sum(k * (tp * (1 - r) ** 2 + (pos - tp) * r * r - (tp - r * pos) ** 2 / size)) AS vr FROM recalls GROUP BY species, t)
SELECT species, round(t, 6) AS threshold, round(w, 6) AS accepted, round(p, 6) AS precision, round(r, 6) AS recall,
    round(sqrt(greatest(vp, 0)) / w, 6) AS se_precision, round(sqrt(greatest(vr, 0)) / nullif(allw, 0), 6) AS se_recall FROM v"""


def jaccard_at_effort(spark, sf_dir):
    """Customers as sites, their orders as minutes, the sizes and brands of ordered parts as species."""
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("minute"))
    lines = T.table(spark, sf_dir, "lineitem").join(T.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    heard = lines.select(F.col("l_orderkey").alias("minute"), F.concat_ws("#", "p_brand", F.col("p_size") % 5).alias("species"))
    reference = T.table(spark, sf_dir, "part").where("p_size % 5 = 1").select(F.concat_ws("#", "p_brand", F.col("p_size") % 5).alias("species"))
    out = B.jaccard_at_effort(orders, orders.join(heard, "minute"), reference, ["site"], EFFORT, REPLICATES, portable=True)
    return out.select("site", "minutes", F.round("distance", 6).alias("distance"), F.round("spread", 6).alias("spread"))


JACCARD_AT_EFFORT = f"""
WITH heard AS (SELECT DISTINCT l_orderkey AS minute, p_brand || '#' || (p_size % 5) AS species FROM lineitem JOIN part ON l_partkey = p_partkey),
ref AS (SELECT DISTINCT p_brand || '#' || (p_size % 5) AS species FROM part WHERE p_size % 5 = 1),
drawn AS (SELECT o_custkey AS site, o_orderkey AS minute, r, row_number() OVER (PARTITION BY o_custkey, r ORDER BY {_u('effort', 'o_custkey', 'r', 'o_orderkey')}, o_orderkey) AS k
    FROM orders, (SELECT range AS r FROM range({REPLICATES})) x),
lists AS (SELECT DISTINCT site, r, species FROM drawn JOIN heard USING (minute) WHERE k <= {EFFORT}),
counts AS (SELECT site, r, count(*) AS own, count(ref.species) AS common FROM lists LEFT JOIN ref USING (species) GROUP BY ALL),
every AS (SELECT site, r, count(*) AS minutes FROM drawn GROUP BY ALL),
d AS (SELECT e.site, minutes, 1 - coalesce(common, 0) / (coalesce(own, 0) + (SELECT count(*) FROM ref) - coalesce(common, 0))::DOUBLE AS distance
    FROM every e LEFT JOIN counts c ON c.site = e.site AND c.r = e.r)
SELECT site, minutes, CASE WHEN minutes >= {EFFORT} THEN round(avg(distance), 6) END AS distance,
    CASE WHEN minutes >= {EFFORT} THEN round(stddev_pop(distance), 6) END AS spread FROM d GROUP BY site, minutes"""


def _series(spark, sf_dir):
    """Shipments of a supplier as an image series."""
    day = F.to_date("l_shipdate")
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.col("l_orderkey").alias("image"),
        F.col("l_linenumber").alias("line"), F.when(F.col("l_discount") > 0.01, F.col("l_extendedprice") / 7919.0).alias("ndvi"))


def gap_levels(spark, sf_dir):
    out = B.gap_levels(_series(spark, sf_dir), ["site", "year"], "ndvi", "quarter", ["image", "line"], LEVELS, portable=True)
    return out.select("site", "year", "mode", "level", "n", F.round("median", 6).alias("median"), F.round("amplitude", 6).alias("amplitude"))


SERIES = """series AS (SELECT l_suppkey AS site, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, l_orderkey AS image, l_linenumber AS line,
    l_extendedprice / 7919.0::DOUBLE AS ndvi FROM lineitem WHERE l_discount > 0.01)"""
GAP_LEVELS = f"""
WITH {SERIES},
draws AS (SELECT *, {_u('gaps', "'random'", 'site', 'year', 'image', 'line')} AS one, {_u('gaps', "'quarter'", 'site', 'year', 'quarter')} AS whole FROM series),
kept AS (SELECT site, year, mode, level, CASE WHEN CASE mode WHEN 'random' THEN one ELSE whole END < level THEN ndvi END AS v
    FROM draws, (SELECT unnest(['random', 'quarter']) AS mode) a, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in LEVELS)}]) AS level) b)
SELECT site, year, mode, level, count(v) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 6) AS amplitude
FROM kept GROUP BY ALL"""


def quarter_anomaly(spark, sf_dir):
    out = B.quarter_anomaly(_series(spark, sf_dir), ["site"], "ndvi", "year", "quarter")
    return out.select("site", "year", "quarter", "n", "earlier_years", *[F.round(c, 6).alias(c) for c in ("median", "anomaly", "anomaly_all_years")])


QUARTER_ANOMALY = f"""
WITH {SERIES},
m AS (SELECT site, year, quarter, count(*) AS n, quantile_cont(ndvi, 0.5) AS median FROM series GROUP BY ALL)
SELECT a.site, a.year, a.quarter, any_value(a.n) AS n, count(b.year) FILTER (b.year < a.year) AS earlier_years, round(any_value(a.median), 6) AS median,
    round(any_value(a.median) - avg(b.median) FILTER (b.year < a.year), 6) AS anomaly, round(any_value(a.median) - avg(b.median), 6) AS anomaly_all_years
FROM m a LEFT JOIN m b ON b.site = a.site AND b.quarter = a.quarter AND b.year <> a.year GROUP BY a.site, a.year, a.quarter"""


QUERIES = {f.__name__: f for f in [threshold_curve, jaccard_at_effort, gap_levels, quarter_anomaly]}
ORACLE = {"threshold_curve": THRESHOLD_CURVE, "jaccard_at_effort": JACCARD_AT_EFFORT, "gap_levels": GAP_LEVELS, "quarter_anomaly": QUARTER_ANOMALY}
