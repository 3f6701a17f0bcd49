"""Mixing sources to target weights (native SQL functions).

Targets: each source gets weight times one common level, at most `ceiling` times its size; the level spends the whole budget
(what is cut off is shared again by weight until no source is above its ceiling, which is the same fixed point). Sampling:
complete epochs first; the rest of a target goes to the documents with the smallest exponential keys (-ln u / quality,
Efraimidis and Spirakis), as far as their running sum of words comes nearest to it.

The running sum needs no sort of a whole source: keys fall into `buckets` monotone buckets, whose sums locate the bucket in
which the budget ends; only that bucket, 1/buckets of a source, is sorted. A hot source therefore never meets in one task.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; rows that
repeat an id are separate documents with equal keys, ordered by size (equal rows are interchangeable); a source of size 0 has
target 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.llm.common import WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)
BUCKETS = 16384
#: The smallest quality; with it as rate, keys of any quality spread over the buckets.
FLOOR = 0.1


def sizes(docs: DataFrame) -> DataFrame:
    """Size in words and the draw of every document: u in (0, 1) from its id, quality from its share of letters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(text)
    share = F.regexp_count(text, F.lit(r"[A-Za-zÀ-ɏ]")) / F.greatest(chars, F.lit(1))
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.greatest(share, F.lit(FLOOR)).alias("quality"), u.alias("u"))


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Adds each source's target. `totals` has one row a source (source, source_size): it is as long as there are sources."""
    if ceiling <= 0 or budget_share < 0 or not weights or min(weights) <= 0:
        raise ValueError("weights and ceiling must be positive")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    # A source with a smaller ceiling per weight reaches it first: the level follows from sums over that order.
    first = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * ceiling
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (total * budget_share - spent) / left)
    full = F.col("source_size") * ceiling <= F.col("weight") * F.col("level")
    ratio = F.when(~F.col("full"), F.col("source_size") / F.col("weight"))
    rows = rows.withColumn("full", full).withColumn("common", F.min_by("level", ratio).over(every))
    target = F.when(F.col("full"), F.col("source_size") * ceiling).otherwise(F.col("weight") * F.col("common"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _key() -> Column:
    return -F.log("u") / F.col("quality")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.5, ceiling: float = 2.0, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs (complete ones) for every row of `docs`."""
    rows = sizes(docs).withColumn("k", _key())
    rows = cut(rows.withColumn("bucket", F.floor((1 - F.exp(-FLOOR * F.col("k"))) * buckets).cast("int")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_share, ceiling)
    same = totals["source"].eqNullSafe(sums["source"])
    plan = sums.join(totals, same).select(
        sums["source"], "bucket", "words", "source_size", "target", F.coalesce(F.sum("words").over(
            Window.partitionBy(sums["source"]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("cutting", (F.col("below") < F.col("rest")) & (F.col("below") + F.col("words") > F.col("rest")))
    met = rows.join(plan.withColumnsRenamed({"source": "s", "bucket": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = met.filter("cutting").withColumn("upto", F.col("below") + F.sum("size").over(
        Window.partitionBy("s", "b").orderBy("k", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)))
    nearest = F.abs(F.col("upto") - F.col("rest")) <= F.abs(F.col("upto") - F.col("size") - F.col("rest"))
    inside = inside.withColumn("extra", ((F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("size") < F.col("rest")) & nearest)).cast("long"))
    outside = met.filter(~F.col("cutting")).withColumn("extra", (F.col("below") < F.col("rest")).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "epochs", "extra"]
    return inside.select(cols).unionByName(outside.select(cols)).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"),
        (F.col("epochs") + F.col("extra")).alias("copies"))
