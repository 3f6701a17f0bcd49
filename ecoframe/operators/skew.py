"""Joins and ranks that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a repeated key gives out in one piece.
PIECE = 10_000


def whole(df: DataFrame) -> DataFrame:
    """``df`` with its columns as the output of one generator, so that no later filter or pruning reaches below it.

    Uses of it in one plan, each with other columns, then have equal plans below, and Spark runs their exchange once.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def shared(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` behind one exchange by ``keys`` (columns that nearly tell the rows apart), which all uses in one plan read."""
    return whole(df.repartition(*keys))


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], weight: str, how: str = "inner",
           spread: Sequence[str] | None = None) -> DataFrame:
    """Join one row of ``stats`` per key back to ``rows`` without sending a hot key to one task.

    ``weight`` is the column of ``stats`` that says how many rows the key has. A key is hot if it owns over a
    quarter of a shuffle partition's share, so at most 4 × partitions keys are hot: that bounds what is broadcast.
    Its rows are spread over as many salts as it fills quarters, and its stats row is repeated once per salt. All other keys join as usual. ``spread`` names columns that vary within a key
    (default: all columns). NULL keys match NULL keys. The total, the hot keys and the join read one run of ``stats``.
    """
    keys, stats = list(keys), whole(stats)
    total = stats.agg(F.sum(weight)).scalar()
    quarters = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(weight) * F.lit(quarters) > total
    salts = F.ceil(F.col(weight) * F.lit(float(quarters)) / total).cast("bigint")
    hot = stats.where(is_hot).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], salts.alias("_hot"))

    def matches(prefix: str) -> Column:
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        return condition

    salt = F.when(F.col("_hot") > 1, F.pmod(F.xxhash64(*[F.col(c) for c in (spread or rows.columns)]),
                                            F.col("_hot"))).otherwise(F.lit(0).cast("bigint"))
    left = (rows.join(F.broadcast(hot), matches("_hot_"), "left")
            .withColumn("_salt", salt).drop("_hot", *[f"_hot_{k}" for k in keys]))
    copies = F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), salts - 1)).otherwise(
        F.array(F.lit(0).cast("bigint")))
    right = stats.select(*[F.col(k).alias(f"_right_{k}") for k in keys],
                         *[c for c in stats.columns if c not in keys], F.explode(copies).alias("_right_salt"))
    joined = left.join(right, matches("_right_") & (F.col("_salt") == F.col("_right_salt")), how)
    return joined.drop("_salt", "_right_salt", *[f"_right_{k}" for k in keys])


def repeated(rows: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key occurs more than once.

    With ``order`` (columns that name the row order within a key) only the second and later occurrences are
    returned; without it every member of the repeated group. NULLs in the key are equal to each other.
    """
    measures = [F.count(F.lit(1)).alias("_n")]
    if order:
        measures.append(F.min(F.struct(*order)).alias("_first"))
    stats = rows.groupBy(*keys).agg(*measures).where(F.col("_n") > 1)
    joined = attach(rows, stats, keys, "_n")
    if order:
        joined = joined.where(F.struct(*order) > F.col("_first"))
    return joined.drop("_n", "_first")


def later_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key of every second and later row of a key, once for each such row.

    For what is told by the key alone: keys are counted, no row is joined back. A key with very many rows is given out in pieces of
    PIECE rows, which are dealt to many tasks. NULLs in the key are equal to each other.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 2) / PIECE))))
    dealt = pieces.repartition(*keys, "_piece")
    left = F.least(F.lit(PIECE).cast("bigint"), F.col("_n") - 1 - F.col("_piece") * PIECE)
    return dealt.select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), left)).alias("_at")).drop("_at")


def rank_by_uniform(rows: DataFrame, keys: Sequence[str], draw: str, tie: Sequence[str], name: str,
                    buckets: int = 64) -> DataFrame:
    """0-based rank of each row within its key, ordered by a uniform ``draw`` (then ``tie``).

    Equals ``row_number() over (partition by keys order by draw, tie) - 1``, but a key with very many rows is
    ranked in ``buckets`` pieces: the draw itself says which piece, and piece totals give the offsets. These can be as many
    as the rows, so they are never broadcast.
    """
    keys = list(keys)
    if buckets <= 1:
        order = Window.partitionBy(*keys).orderBy(draw, *tie)
        return rows.withColumn(name, F.row_number().over(order).cast("bigint") - 1)
    placed = rows.withColumn("_bucket", F.floor(F.col(draw) * buckets).cast("int"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
               .withColumn("_offset", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).drop("_rows"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(draw, *tie)
    return (placed.withColumn("_position", F.row_number().over(within) - 1)
            .join(offsets.hint("merge"), [*keys, "_bucket"])
            .withColumn(name, (F.col("_offset") + F.col("_position")).cast("bigint"))
            .drop("_bucket", "_offset", "_position"))
