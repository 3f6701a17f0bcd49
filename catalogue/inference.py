"""Species sets, ridge gains, intervals, tests, readings and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import shapes as T
from ecoframe import constants as C
from ecoframe.functions import scalars as S
from ecoframe.functions.random import uniform
from ecoframe.operators import intervals as I
from ecoframe.operators import ridge as G
from ecoframe.operators import sets as J
from ecoframe.plans import sizing

LAMBDA = 1.0


# --- species sets -----------------------------------------------------------------------------------------

def _supplier_species(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("#", "p_brand", "p_size").alias("species"))
    rows = T.table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_suppkey").alias("site"), "species")


def _regions(spark, sf_dir):
    return T.table(spark, sf_dir, "supplier").join(
        T.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("group"), F.col("s_suppkey").alias("site"), "s_acctbal")


def _forests(spark, sf_dir):
    """The three suppliers of each region with the highest balance play its reference forests."""
    ranked = J.first_per_group(_regions(spark, sf_dir), ["region"], [F.col("s_acctbal").desc(), F.col("site")], 3)
    return ranked.select("region", "group", "site", (F.col("rank") - 1).alias("forest"))


FORESTS = """
regions AS (SELECT n_regionkey AS region, n_nationkey AS grp, s_suppkey AS site, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
forests AS (SELECT region, grp, site, row_number() OVER (PARTITION BY region ORDER BY s_acctbal DESC, site) - 1 AS forest FROM regions
            QUALIFY row_number() OVER (PARTITION BY region ORDER BY s_acctbal DESC, site) <= 3),
spec AS (SELECT DISTINCT l_suppkey AS site, p_brand || '#' || p_size AS species FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def jaccard_to_reference(spark, sf_dir):
    """Distance of each supplier's species set to the union of its region's reference forests."""
    species = _supplier_species(spark, sf_dir).distinct()
    sites = _regions(spark, sf_dir).select("region", "site")
    reference = species.join(_forests(spark, sf_dir).select("region", "site"), "site").select("region", "species").distinct()
    out = J.jaccard_to_reference(sites.join(species, "site"), reference, ["region"], ["site"])
    return out.select("region", "site", F.round("distance", 6).alias("distance"))


JACCARD = "WITH" + FORESTS + """,
ref AS (SELECT DISTINCT region, species FROM forests JOIN spec USING (site)),
refn AS (SELECT region, count(*) AS n FROM ref GROUP BY region),
pairs AS (SELECT r.region, r.site, count(*) AS n, count(f.species) AS shared FROM regions r JOIN spec s ON r.site = s.site
          LEFT JOIN ref f ON f.region = r.region AND f.species = s.species GROUP BY ALL)
SELECT p.region, p.site, round(1 - shared / (p.n + refn.n - shared)::DOUBLE, 6) AS distance FROM pairs p JOIN refn USING (region)"""


def reference_b2(spark, sf_dir):
    """The same distance when the forests hosted by each held-out nation leave the reference."""
    regions, forests = _regions(spark, sf_dir), _forests(spark, sf_dir)
    species = _supplier_species(spark, sf_dir).distinct()
    folds = regions.select("region", "group").distinct()
    out = J.jaccard_without_hosted(regions.select("region", "site").join(species, "site"),
                                   forests.join(species, "site").select("region", "forest", "group", "species"),
                                   folds, ["region"], ["site"])
    return out.select("region", "group", "site", F.round("distance", 6).alias("distance"))


REFERENCE_B2 = "WITH" + FORESTS + """,
folds AS (SELECT DISTINCT region, grp FROM regions),
ref AS (SELECT DISTINCT d.region, d.grp, s.species FROM folds d JOIN forests f ON f.region = d.region AND f.grp <> d.grp JOIN spec s ON s.site = f.site),
refn AS (SELECT region, grp, count(*) AS n FROM ref GROUP BY ALL),
pairs AS (SELECT d.region, d.grp, r.site, count(*) AS n, count(f.species) AS shared
          FROM folds d JOIN regions r ON r.region = d.region JOIN spec s ON r.site = s.site
          LEFT JOIN ref f ON f.region = d.region AND f.grp = d.grp AND f.species = s.species GROUP BY ALL)
SELECT p.region, p.grp AS "group", p.site, round(1 - shared / (p.n + coalesce(refn.n, 0) - shared)::DOUBLE, 6) AS distance
FROM pairs p LEFT JOIN refn ON p.region = refn.region AND p.grp = refn.grp"""


def beta_parts(spark, sf_dir):
    """Turnover and nestedness among all suppliers of a region."""
    rows = _regions(spark, sf_dir).select("region", "site").join(_supplier_species(spark, sf_dir), "site")
    out = J.beta_parts(rows, ["region"], "site")
    return out.select("region", "sites", "species", *[F.round(c, 6).alias(c) for c in ("dissimilarity", "turnover", "nestedness")])


BETA_PARTS = "WITH" + FORESTS + """,
own AS (SELECT DISTINCT region, r.site, species FROM regions r JOIN spec s ON r.site = s.site),
rich AS (SELECT region, site, count(*) AS n FROM own GROUP BY ALL),
common AS (SELECT a.region, a.site AS one, b.site AS other, count(*) AS c
           FROM own a JOIN own b ON a.region = b.region AND a.species = b.species AND a.site < b.site GROUP BY ALL),
pairs AS (SELECT a.region, sum(least(a.n, b.n) - coalesce(c, 0)) AS low, sum(greatest(a.n, b.n) - coalesce(c, 0)) AS high
          FROM rich a JOIN rich b ON a.region = b.region AND a.site < b.site
          LEFT JOIN common ON common.region = a.region AND one = a.site AND other = b.site GROUP BY ALL),
every AS (SELECT region, count(DISTINCT site) AS sites, count(DISTINCT species) AS species, count(*) AS records FROM own GROUP BY ALL),
parts AS (SELECT region, sites, species,
            coalesce((low + high) / nullif(2 * (records - species) + low + high, 0)::DOUBLE, 0) AS sor,
            coalesce(low / nullif(records - species + low, 0)::DOUBLE, 0) AS sim
          FROM every LEFT JOIN pairs USING (region))
SELECT region, sites, species, round(sor, 6) AS dissimilarity, round(sim, 6) AS turnover, round(sor - sim, 6) AS nestedness FROM parts"""


# --- ridge problems: suppliers as properties, nations as groups, regions as problems ------------------------------

def _problem(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        (F.avg("l_extendedprice") / 10000).alias("y"), (F.avg("l_discount") * 100).alias("x1"), F.avg("l_quantity").alias("x2"))
    place = _regions(spark, sf_dir).select("region", "group", F.col("site").alias("row_id"))
    rows = place.join(lines, F.col("row_id") == F.col("l_suppkey")).select(
        "region", F.lit(0).cast("bigint").alias("mask"), "group", "row_id", "y", "x1", "x2")
    return G.Problem(rows, ("region",), ("x1",), ("x1", "x2"), LAMBDA)


ROWS = """
agg AS (SELECT l_suppkey, avg(l_extendedprice) / 10000 AS y, avg(l_discount) * 100 AS x1, avg(l_quantity) AS x2 FROM lineitem GROUP BY l_suppkey),
pr AS (SELECT n_regionkey AS region, n_nationkey AS grp, l_suppkey AS row_id, y, x1, x2
       FROM agg JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _fit(train: str, by: str) -> str:
    """Closed-form ridge with one and with two features in two passes over the training rows (y, x1, x2) of each `by`."""
    return f"""SELECT {by}, n, ym - s0 * m1 AS bi, s0 AS b1, ym - s1 * m1 - s2 * m2 AS li, s1 AS l1, s2 AS l2 FROM (
      SELECT *, b1_ / a11 / d1 AS s0, (a22 * b1_ - a12 * b2_) / (a11 * a22 - a12 * a12) / d1 AS s1,
             (a11 * b2_ - a12 * b1_) / (a11 * a22 - a12 * a12) / d2 AS s2
      FROM (SELECT *, n * v1 / (d1 * d1) + {LAMBDA} AS a11, n * v2 / (d2 * d2) + {LAMBDA} AS a22, n * c12 / (d1 * d2) AS a12,
                   n * c1 / d1 AS b1_, n * c2 / d2 AS b2_
            FROM (SELECT {by}, count(y) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS ym, coalesce(nullif(stddev_pop(x1), 0), 1) AS d1,
                         coalesce(nullif(stddev_pop(x2), 0), 1) AS d2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2,
                         var_pop(x1) AS v1, var_pop(x2) AS v2 FROM {train} GROUP BY ALL)))"""


GROUPS = "st AS (SELECT DISTINCT region, grp FROM pr)"
NAN = "'nan'::DOUBLE"
# Textbook statistics of the rows outside each group, in two passes.
LOGO = f"""
{GROUPS},
outside AS (SELECT g.region, g.grp, count(p.y) AS n, coalesce(avg(p.x1), {NAN}) AS m1, coalesce(avg(p.x2), {NAN}) AS m2, coalesce(avg(p.y), {NAN}) AS ym,
            coalesce(nullif(stddev_pop(p.x1), 0), 1) AS d1, coalesce(nullif(stddev_pop(p.x2), 0), 1) AS d2, covar_pop(p.x1, p.x2) AS c12,
            covar_pop(p.x1, p.y) AS c1, covar_pop(p.x2, p.y) AS c2, var_pop(p.x1) AS v1, var_pop(p.x2) AS v2
            FROM st g LEFT JOIN pr p ON p.region = g.region AND p.grp <> g.grp GROUP BY ALL),
scaled AS (SELECT *, n * v1 / (d1 * d1) + {LAMBDA} AS a11, n * v2 / (d2 * d2) + {LAMBDA} AS a22, n * c12 / (d1 * d2) AS a12,
           n * c1 / d1 AS b1_, n * c2 / d2 AS b2_ FROM outside),
slopes AS (SELECT *, coalesce(b1_ / a11 / d1, {NAN}) AS s0, coalesce((a22 * b1_ - a12 * b2_) / (a11 * a22 - a12 * a12) / d1, {NAN}) AS s1,
           coalesce((a11 * b2_ - a12 * b1_) / (a11 * a22 - a12 * a12) / d2, {NAN}) AS s2 FROM scaled),
fit AS (SELECT region, grp, ym - s0 * m1 AS bi, s0 AS b1, ym - s1 * m1 - s2 * m2 AS li, s1 AS l1, s2 AS l2, m1, m2, ym FROM slopes),
err AS (SELECT pr.*, abs(ym - y + b1 * (x1 - m1)) AS e_base, abs(ym - y + l1 * (x1 - m1) + l2 * (x2 - m2)) AS e_larger FROM pr JOIN fit USING (region, grp)),
seen AS (SELECT region, 1 - sum(e_larger) / sum(e_base) AS gain, sum(e_base) AS sb, sum(e_larger) AS sl FROM err GROUP BY region)"""


def ridge_logo_gain(spark, sf_dir):
    out = G.held_out_gain(_problem(spark, sf_dir))
    return out.select("region", "n", *[F.round(c, 6).alias(c) for c in ("mae_base", "mae_larger", "gain")])


RIDGE_LOGO = "WITH" + ROWS + "," + LOGO + """
SELECT region, count(*) AS n, round(avg(e_base), 6) AS mae_base, round(avg(e_larger), 6) AS mae_larger,
       round(1 - sum(e_larger) / sum(e_base), 6) AS gain FROM err GROUP BY region"""


def ridge_line_items(spark, sf_dir):
    """Price of every line item from discount and quantity, one whole supplier held out at a time."""
    rows = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.lit(0).cast("bigint").alias("mask"), F.col("l_suppkey").alias("group"),
        F.lit(0).alias("row_id"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_discount") * 100).alias("x1"),
        F.col("l_quantity").alias("x2"))
    out = G.held_out_gain(G.Problem(rows, ("flag",), ("x1",), ("x1", "x2"), LAMBDA))
    return out.select("flag", "n", *[F.round(c, 6).alias(c) for c in ("mae_base", "mae_larger", "gain")])


RIDGE_LINE_ITEMS = "WITH pr AS (SELECT l_returnflag AS region, l_suppkey AS grp, l_extendedprice / 10000 AS y, l_discount * 100 AS x1, l_quantity AS x2 FROM lineitem)," + LOGO + """
SELECT region AS flag, count(*) AS n, round(avg(e_base), 6) AS mae_base, round(avg(e_larger), 6) AS mae_larger,
       round(1 - sum(e_larger) / sum(e_base), 6) AS gain FROM err GROUP BY region"""


def ridge_large_mean(spark, sf_dir):
    """The same model where quantity is counted from a far origin: only its spread matters."""
    rows = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.lit(0).cast("bigint").alias("mask"), F.col("l_suppkey").alias("group"),
        F.lit(0).alias("row_id"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_discount") * 100).alias("x1"),
        (F.lit(1.7e9) + F.col("l_quantity")).alias("x2"))
    out = G.held_out_gain(G.Problem(rows, ("flag",), ("x1",), ("x1", "x2"), LAMBDA))
    return out.select("flag", "n", *[F.round(c, 6).alias(c) for c in ("mae_base", "mae_larger", "gain")])


def ridge_outlier_group(spark, sf_dir):
    """One supplier of each flag counts its quantities from a far origin: models that leave it out don't notice."""
    rows = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.lit(0).cast("bigint").alias("mask"), F.col("l_suppkey").alias("group"),
        F.lit(0).alias("row_id"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_discount") * 100).alias("x1"),
        (F.when(F.col("l_suppkey") == 3, F.lit(1e9)).otherwise(F.lit(0.0)) + F.col("l_quantity")).alias("x2"))
    errors = G.held_out_errors(G.Problem(rows, ("flag",), ("x1",), ("x1", "x2"), LAMBDA))
    near = errors.groupBy("flag", (F.col("group") == 3).alias("far")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("error_base").alias("base"), F.avg("error_larger").alias("larger"))
    # The error in the far group is as large as its distance: it is given relative to that.
    size = F.when(F.col("far"), F.lit(1e9)).otherwise(F.lit(1.0))
    return near.select("flag", "far", "n", F.round("base", 6).alias("mae_base"), F.round(F.col("larger") / size, 6).alias("mae_larger"))


RIDGE_OUTLIER = "WITH pr AS (SELECT l_returnflag AS region, l_suppkey AS grp, l_extendedprice / 10000 AS y, l_discount * 100 AS x1, CASE WHEN l_suppkey = 3 THEN 1e9::DOUBLE ELSE 0 END + l_quantity AS x2 FROM lineitem)," + LOGO + """
SELECT region AS flag, grp = 3 AS far, count(*) AS n, round(avg(e_base), 6) AS mae_base,
       round(avg(e_larger) / CASE WHEN grp = 3 THEN 1e9::DOUBLE ELSE 1 END, 6) AS mae_larger FROM err GROUP BY region, grp = 3"""

RIDGE_LARGE_MEAN = RIDGE_LINE_ITEMS.replace("l_quantity AS x2", "1.7e9::DOUBLE + l_quantity AS x2", 1)


def _u(seed: str, *parts: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"('0x' || substr(md5(concat_ws(':', {text})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _index(seed: str, source: str, what: str) -> str:
    u = _u(seed, "'index'", "region", what)
    return (f"SELECT *, row_number() OVER (PARTITION BY region ORDER BY {u}, {what}) - 1 AS idx, "
            f"count(*) OVER (PARTITION BY region) AS size FROM {source}")


def fixed_error_interval(spark, sf_dir):
    problem = _problem(spark, sf_dir)
    out = I.fixed_error_interval(G.held_out_errors(problem), problem, 1000, seed="fixed", portable=True)
    return out.select("region", *[F.round(c, 6).alias(c) for c in ("gain", "lower", "upper")])


FIXED_ERROR = "WITH" + ROWS + "," + LOGO + f""",
idx AS ({_index('fixed', 'err', 'row_id')}),
draws AS (SELECT region, b, CAST(floor({_u('fixed', "'draw'", 'region', 'b', 'idx')} * size) AS BIGINT) AS idx FROM idx, (SELECT range AS b FROM range(1000)) r),
boot AS (SELECT region, b, 1 - sum(e_larger) / sum(e_base) AS g FROM draws JOIN idx USING (region, idx) GROUP BY ALL)
SELECT s.region, round(any_value(gain), 6) AS gain, round(quantile_cont(g, 0.05), 6) AS lower, round(quantile_cont(g, 0.95), 6) AS upper
FROM boot b JOIN seen s ON s.region = b.region GROUP BY s.region"""


def bootstrap_interval(spark, sf_dir):
    out = I.refit_bootstrap_interval(_problem(spark, sf_dir), 200, seed="refit", portable=True)
    return out.select("region", *[F.round(c, 5).alias(c) for c in (
        "gain", "percentile_lower", "percentile_upper", "basic_lower", "basic_upper", "replicate_mean")])


BOOTSTRAP = "WITH" + ROWS + "," + LOGO + f""",
idx AS ({_index('refit', 'st', 'grp')}),
draws AS (SELECT region, b, CAST(floor({_u('refit', "'draw'", 'region', 'b', 'idx')} * size) AS BIGINT) AS idx FROM idx, (SELECT range AS b FROM range(200)) r),
cnt AS (SELECT region, b, idx, count(*) AS c FROM draws GROUP BY ALL),
wt AS (SELECT cnt.b, cnt.c, idx.* FROM cnt JOIN idx USING (region, idx)),
btrain AS (SELECT region, b, grp, c, y, x1, x2 FROM (
  SELECT wt.region, wt.b, wt.grp, wt.c, pr.y, pr.x1, pr.x2, unnest(range(o.c)) FROM wt JOIN wt o ON o.region = wt.region AND o.b = wt.b AND o.grp <> wt.grp
  JOIN pr ON pr.region = o.region AND pr.grp = o.grp)),
bfit AS ({_fit('btrain', 'region, b, grp, c')}),
boot AS (SELECT region, b, CASE WHEN isfinite(g) THEN g END AS g FROM (
  SELECT region, b, 1 - sum(c * abs(li + l1 * x1 + l2 * x2 - y)) / sum(c * abs(bi + b1 * x1 - y)) AS g
  FROM bfit JOIN pr USING (region, grp) GROUP BY ALL)),
q AS (SELECT region, quantile_cont(g, 0.05) AS lo, quantile_cont(g, 0.95) AS hi, avg(g) AS m FROM boot GROUP BY region)
SELECT q.region, round(gain, 5) AS gain, round(lo, 5) AS percentile_lower, round(hi, 5) AS percentile_upper,
       round(2 * gain - hi, 5) AS basic_lower, round(2 * gain - lo, 5) AS basic_upper, round(m, 5) AS replicate_mean
FROM q JOIN seen ON seen.region = q.region"""


def corrected_cv(spark, sf_dir):
    problem = _problem(spark, sf_dir)
    groups = problem.rows.select("region", "group").distinct()
    assignment = I.fold_assignment(groups, ["region"], 5, 20, "cv", portable=True)
    out = I.corrected_cv_interval(problem, assignment)
    return out.select("region", *[F.round(c, 5).alias(c) for c in ("gain", "lower", "upper")])


CORRECTED_CV = "WITH" + ROWS + "," + GROUPS + f""",
asg AS (SELECT st.*, r, (row_number() OVER (PARTITION BY region, r ORDER BY {_u('cv', "'fold'", 'region', 'r', 'grp')}, grp) - 1) % 5 AS fold
        FROM st, (SELECT range AS r FROM range(20)) x),
ft AS (SELECT asg.region, r, fold, count(*) AS n_test FROM asg JOIN pr ON pr.region = asg.region AND pr.grp = asg.grp GROUP BY ALL),
ftrain AS (SELECT ft.region, ft.r, ft.fold, n_test, y, x1, x2 FROM ft LEFT JOIN
  (SELECT asg.region, r, fold, y, x1, x2 FROM asg JOIN pr ON pr.region = asg.region AND pr.grp = asg.grp) o
  ON o.region = ft.region AND o.r = ft.r AND o.fold <> ft.fold),
ffit AS (SELECT * REPLACE (coalesce(bi, {NAN}) AS bi, coalesce(b1, {NAN}) AS b1, coalesce(li, {NAN}) AS li, coalesce(l1, {NAN}) AS l1, coalesce(l2, {NAN}) AS l2)
         FROM ({_fit('ftrain', 'region, r, fold, n_test')})),
fold_mae AS (SELECT region, r, fold, avg(abs(bi + b1 * x1 - y)) AS b, avg(abs(bi + b1 * x1 - y) - abs(li + l1 * x1 + l2 * x2 - y)) AS d,
                    any_value(n_test / nullif(n, 0)) AS ratio
             FROM asg JOIN ffit USING (region, r, fold) JOIN pr USING (region, grp) GROUP BY ALL),
g AS (SELECT region, avg(d) / avg(b) AS rr, avg(b) AS bm, 1.0::DOUBLE / count(*) + avg(ratio) AS corr FROM fold_mae GROUP BY region),
se AS (SELECT g.region, any_value(rr) AS rr, sqrt(any_value(corr) * var_samp((d - rr * b) / bm)) AS se FROM fold_mae JOIN g USING (region) GROUP BY g.region)
SELECT region, round(rr, 5) AS gain, round(rr - 1.6448536269514722::DOUBLE * se, 5) AS lower, round(rr + 1.6448536269514722::DOUBLE * se, 5) AS upper
FROM (SELECT region, CASE WHEN isfinite(rr) THEN rr END AS rr, CASE WHEN isfinite(rr) AND isfinite(se) THEN se END AS se FROM se)"""


def permutation_p(spark, sf_dir):
    out = I.permutation_test(_problem(spark, sf_dir), "x2", 199, seed="perm", portable=True)
    return out.select("region", F.round("gain", 6).alias("gain"), F.round("p_value", 6).alias("p_value"))


PERMUTATION = "WITH" + ROWS + "," + LOGO + f""",
pos AS (SELECT *, row_number() OVER (PARTITION BY region, grp ORDER BY {_u('perm', "'row'", 'region', 'row_id')}, row_id) AS p FROM pr),
sz AS (SELECT region, grp, count(*) AS size FROM pr GROUP BY ALL),
place AS (SELECT *, row_number() OVER (PARTITION BY region, size ORDER BY {_u('perm', "'place'", 'region', 'grp')}, grp) AS t FROM sz),
src AS (SELECT region, size, grp AS source, i, row_number() OVER (PARTITION BY region, size, i ORDER BY {_u('perm', "'perm'", 'region', 'i', 'grp')}, grp) AS t
        FROM sz, (SELECT range AS i FROM range(199)) x),
swap AS (SELECT src.region, i, source, place.grp FROM src JOIN place ON src.region = place.region AND src.size = place.size AND src.t = place.t),
pm AS (SELECT d.region, s.i, d.grp, d.y, d.x1, v.x2 FROM swap s JOIN pos d ON d.region = s.region AND d.grp = s.grp
       JOIN pos v ON v.region = s.region AND v.grp = s.source AND v.p = d.p),
ptrain AS (SELECT g.region, i, g.grp, y, x1, x2 FROM st g JOIN pm ON pm.region = g.region AND pm.grp <> g.grp),
pfit AS ({_fit('ptrain', 'region, i, grp')}),
pe AS (SELECT region, i, sum(abs(li + l1 * x1 + l2 * x2 - y)) AS e FROM pm JOIN pfit USING (region, i, grp) GROUP BY ALL)
SELECT pe.region, round(any_value(CASE WHEN isfinite(gain) THEN gain END), 6) AS gain,
       round(CASE WHEN isfinite(any_value(gain)) THEN (1 + count(*) FILTER (e <= sl * (1 + 1e-12))) / (1 + count(*))::DOUBLE END, 6) AS p_value
FROM pe JOIN seen ON seen.region = pe.region GROUP BY pe.region"""


# --- readings and the summary of repetitions -------------------------------------------------------------------------

def _repetitions(spark, sf_dir):
    """Orders as repetitions of the cells (status × priority): gains and bounds drawn from their key."""
    o = T.table(spark, sf_dir, "orders")

    def u(name):
        return uniform("rep", F.lit(name), F.col("o_orderkey"), portable=True)

    base = o.select(
        F.lit("grade").alias("block"), F.col("o_orderstatus").alias("structure"), F.col("o_orderpriority").alias("scenario"),
        F.lit(30).alias("n_properties"), (u("t") * 0.3).alias("true_gain"), (u("m") * 0.3).alias("true_gain_mse"),
        F.when(u("r") < 0.95, u("r") * 0.3).alias("reachable_gain"), (u("g") * 0.5 - 0.1).alias("gain_m3_m2b"),
        (u("c") * 0.5 - 0.1).alias("gain_cv"), (u("a") * 2).alias("mae_M2b"), F.when(u("p") < 0.97, u("p")).alias("p_value"))
    for k, m in enumerate(C.INTERVAL_METHODS):
        base = base.withColumn(f"lower_{m}", F.col("gain_m3_m2b") - 0.05 * (k + 1) * (1 + F.col("mae_M2b"))).withColumn(
            f"upper_{m}", F.col("gain_m3_m2b") + 0.04 * (k + 1) * (1 + F.col("mae_M2b")))
    return sizing.with_readings(base)


REPS = f"""
rep0 AS (SELECT o_orderstatus AS structure, o_orderpriority AS scenario,
  {", ".join(f"{_u('rep', repr(n), 'o_orderkey')} AS u_{n}" for n in "tmrgcap")} FROM orders),
rep1 AS (SELECT *, u_t * 0.3::DOUBLE AS true_gain, u_m * 0.3::DOUBLE AS true_gain_mse, CASE WHEN u_r < 0.95 THEN u_r * 0.3::DOUBLE END AS reachable_gain,
  u_g * 0.5::DOUBLE - 0.1::DOUBLE AS gain, u_a * 2 AS mae, CASE WHEN u_p < 0.97 THEN u_p END AS p_value FROM rep0),
rep AS (SELECT *, {", ".join(f"gain - 0.05::DOUBLE * {k + 1} * (1 + mae) AS lo{k}, gain + 0.04::DOUBLE * {k + 1} * (1 + mae) AS hi{k}" for k in range(4))} FROM rep1),
readings AS (SELECT *, CASE WHEN lo2 >= 0.10 THEN '{C.READING_CONFIRMED}' WHEN lo2 > 0 AND gain >= 0.10 THEN '{C.READING_POSITIVE_ABOVE}'
  WHEN lo2 > 0 AND hi2 < 0.10 THEN '{C.READING_POSITIVE_BELOW}' WHEN hi2 < 0.10 THEN '{C.READING_DISCARDED}' ELSE '{C.READING_INCONCLUSIVE}' END AS reading FROM rep)"""


def simulation_summary(spark, sf_dir):
    out = sizing.summarise_cells(_repetitions(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in (
        (f.name, f.dataType.simpleString()) for f in out.schema) if c not in C.READINGS])


def _method_sql(k: int, m: str) -> str:
    return (f"round(avg((hi{k} + lo{k}) / 2 - reachable_gain), 6) AS centre_bias_{m}, "
            f"round(avg(coalesce(reachable_gain BETWEEN lo{k} AND hi{k}, false)::INTEGER), 6) AS coverage_reachable_{m}, "
            f"round(avg((true_gain BETWEEN lo{k} AND hi{k})::INTEGER), 6) AS coverage_population_{m}, "
            f"round(quantile_cont(hi{k} - lo{k}, 0.5), 6) AS width_median_{m}")


SIMULATION_SUMMARY = "WITH" + REPS + f"""
SELECT 'grade' AS block, structure, scenario, 30 AS n_properties, round(avg(true_gain), 6) AS true_gain_mean,
       round(avg(true_gain_mse), 6) AS true_gain_mse_mean, round(avg(reachable_gain), 6) AS reachable_gain_mean,
       round(avg(gain), 6) AS gain_mean, round(stddev_samp(gain), 6) AS gain_sd, round(quantile_cont(hi2 - lo2, 0.5), 6) AS width_median,
       round(avg((lo2 > 0)::INTEGER), 6) AS lower_above_zero, round(avg(coalesce(p_value <= 0.05, false)::INTEGER), 6) AS permutation_rejection_5pct,
       round(quantile_cont(mae, 0.5), 6) AS mae_m2b_median, {", ".join(_method_sql(k, m) for k, m in enumerate(C.INTERVAL_METHODS))},
       round(sqrt(0.9 * 0.1 / count(*)), 6) AS coverage_se
FROM readings GROUP BY structure, scenario"""


def reading_shares(spark, sf_dir):
    """Share of each reading category per cell, zero where a category never occurs."""
    out = sizing.summarise_cells(_repetitions(spark, sf_dir))
    return out.select("structure", "scenario", *[F.round(f"`{r}`", 6).alias(f"reading_{i}") for i, r in enumerate(C.READINGS)])


READING_SHARES = "WITH" + REPS + f"""
SELECT structure, scenario, {", ".join(f"round(count(*) FILTER (reading = '{r}') / count(*)::DOUBLE, 6) AS reading_{i}" for i, r in enumerate(C.READINGS))}
FROM readings GROUP BY structure, scenario"""


def overall_coverage(spark, sf_dir):
    out = sizing.overall_coverage(_repetitions(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


OVERALL_COVERAGE = "WITH" + REPS + "SELECT " + ", ".join(
    f"round(avg(coalesce(reachable_gain BETWEEN lo{k} AND hi{k}, false)::INTEGER), 6) AS {m}"
    for k, m in enumerate(C.INTERVAL_METHODS)) + " FROM readings"


QUERIES = {f.__name__: f for f in [
    jaccard_to_reference, reference_b2, beta_parts, ridge_logo_gain, ridge_line_items, ridge_large_mean, ridge_outlier_group, fixed_error_interval, bootstrap_interval,
    corrected_cv, permutation_p, simulation_summary, reading_shares, overall_coverage]}
ORACLE = {
    "jaccard_to_reference": JACCARD, "reference_b2": REFERENCE_B2, "beta_parts": BETA_PARTS, "ridge_logo_gain": RIDGE_LOGO,
    "ridge_line_items": RIDGE_LINE_ITEMS, "ridge_large_mean": RIDGE_LARGE_MEAN, "ridge_outlier_group": RIDGE_OUTLIER, "fixed_error_interval": FIXED_ERROR, "bootstrap_interval": BOOTSTRAP,
    "corrected_cv": CORRECTED_CV, "permutation_p": PERMUTATION, "simulation_summary": SIMULATION_SUMMARY,
    "reading_shares": READING_SHARES, "overall_coverage": OVERALL_COVERAGE}
