"""Ridge models from mergeable moments, with whole groups held out.

A fit needs the number, means and centred co-moments (n, mean, Σ(v − mean)(v − mean)ᵀ) of its training rows. Those of two
sets merge without loss, so the moments of "all groups but one" are merged from the groups before and the groups behind it;
nothing is ever taken away from a total, and a held-out group may lie as far from the others as it likes. A resample merges
groups with weights, a fold merges the other folds. Rows are read once to build the moments of the groups and once to score the
predictions; merging and the p×p solve run in Arrow batches.

A *problem* is a set of rows that share ``keys``; many problems are fitted side by side. Where the response
depends on what is held out, each row is present once per response variant, named by ``mask``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecoframe.functions.scalars import finite
from ecoframe.operators.skew import attach
from ecoframe.session import durable

# members whose moments are merged in one list; more of them are merged block by block
BLOCK = 256


@dataclass(frozen=True)
class Problem:
    """Rows to model: keys, mask, group, row_id, y and the features. Without a group column every row is its own group.

    ``base`` and ``larger`` are the two models compared; ``features`` is their union in a fixed order.
    ``hosted`` (keys, group, mask) gives the response variant to use when a group is held out; None means that
    all responses are the same (mask 0). ``skewed`` False promises that groups are small, so joins need no salt.
    """
    rows: DataFrame
    keys: tuple[str, ...]
    base: tuple[str, ...]
    larger: tuple[str, ...]
    penalty: float = 1.0
    hosted: DataFrame | None = None
    skewed: bool = True

    def __post_init__(self):
        rows = self.rows if "group" in self.rows.columns else self.rows.withColumn("group", F.col("row_id"))
        object.__setattr__(self, "rows", centred(rows, self.keys, [*self.features, "y"]))

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys([*self.larger, *self.base]))

    @property
    def models(self) -> dict[str, tuple[str, ...]]:
        return {"base": self.base, "larger": self.larger}

    @cached_property
    def most_groups(self) -> int:
        """The largest number of groups in a problem."""
        counts = self.rows.select(*self.keys, "mask", "group").distinct().groupBy(*self.keys, "mask").count()
        return counts.agg(F.max("count")).first()[0] or 1

    def join(self, rows: DataFrame, stats: DataFrame, on: Sequence[str], weight: str = "s_w") -> DataFrame:
        """One stats row per key joined to its rows."""
        if self.skewed:
            return attach(rows, stats, on, weight)
        return rows.join(stats, list(on))

    def group_stats(self) -> DataFrame:
        return self.rows.groupBy(*self.keys, "mask", "group").agg(*moments(self.features))

    def own(self, rows: DataFrame) -> DataFrame:
        """Only the variant that belongs to each row's own held-out group."""
        if self.hosted is None:
            return rows
        hosted = self.hosted if self.skewed else self.hosted.hint("shuffle_hash")
        return rows.join(hosted, [*self.keys, "group", "mask"])


def centred(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every column less its median within the problem, so that sums keep their digits whatever the origin.

    The median is one of the values: a constant column becomes exactly zero. The rows are written once (keys, response
    and features only), because every step of a model reads them again.
    """
    middle = [F.percentile_approx(F.col(c).cast("double"), 0.5, 100).alias(f"_mid_{c}") for c in columns]
    middles = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *middle))
    joined = attach(rows, middles, keys, "_n")
    return durable(joined.withColumns({c: F.col(c) - F.coalesce(f"_mid_{c}", F.lit(0.0)) for c in columns}).select(*rows.columns))


def moment_names(features: Sequence[str]) -> list[str]:
    """Weight, means and co-moments; variable 0 is the response."""
    q = len(features) + 1
    return ["s_w"] + [f"m_{i}" for i in range(q)] + [f"c_{i}_{j}" for i in range(q) for j in range(i, q)]


def moments(features: Sequence[str], weight: Column | None = None, y: str = "y") -> list[Column]:
    """The moments that a ridge fit needs, as aggregate columns. A constant column has exactly its value as mean."""
    v = [F.col(c).cast("double") for c in (y, *features)]
    if weight is None:
        n = F.count(F.lit(1)).cast("double")
        mean = [F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.avg(x)) for x in v]
        co = [F.covar_pop(v[i], v[j]) * n for i in range(len(v)) for j in range(i, len(v))]
    else:
        w = weight.cast("double")
        n = F.sum(w)
        mean = [F.sum(w * x) / n for x in v]
        co = [F.sum(w * v[i] * v[j]) - n * mean[i] * mean[j] for i in range(len(v)) for j in range(i, len(v))]
    return [c.alias(name) for c, name in zip([n, *mean, *co], moment_names(features))]


def _merge(a: np.ndarray, b: np.ndarray, q: int) -> np.ndarray:
    """Moments of two sets together, for many pairs at once; an empty set is all zeros."""
    upper = np.triu_indices(q)
    n = a[..., 0] + b[..., 0]
    share = np.divide(b[..., 0], n, out=np.zeros_like(n), where=n > 0)
    apart = b[..., 1:1 + q] - a[..., 1:1 + q]
    between = apart[..., upper[0]] * apart[..., upper[1]] * (a[..., 0] * share)[..., None]
    mean = np.where((a[..., 0] > 0)[..., None], a[..., 1:1 + q] + apart * share[..., None], b[..., 1:1 + q])
    return np.concatenate((n[..., None], mean, a[..., 1 + q:] + b[..., 1 + q:] + between), axis=-1)


def _lists(stats: DataFrame, by: Sequence[str], member: str, names: Sequence[str], weight: str | None) -> DataFrame:
    own = F.array(*[F.col(n).cast("double") for n in names])
    times = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return stats.groupBy(*by).agg(F.collect_list(F.struct(F.col(member).alias("member"), times.alias("times"), own.alias("own"))).alias("_list"))


def _padded(listed: pd.Series, q: int, width: int) -> np.ndarray:
    """(rows, longest list, moments), weights applied, zeros behind the shorter lists. Lists are ordered by member."""
    out = np.zeros((len(listed), max(map(len, listed), default=0), width))
    for i, members in enumerate(listed):
        out[i, :len(members)] = [m["own"] for m in members]
        times = np.array([m["times"] for m in members])
        out[i, :len(members), 0] *= times
        out[i, :len(members), 1 + q:] *= times[:, None]
    return out


def _in_blocks(stats: DataFrame, member: str, most: int) -> DataFrame:
    return stats.withColumn(f"{member}_block", F.pmod(F.xxhash64(member), F.lit(-(-most // BLOCK))))


def merged(stats: DataFrame, by: Sequence[str], member: str, features: Sequence[str], most: int, weight: str | None = None) -> DataFrame:
    """by and the moments of all members together; at most `most` members share a `by`, `weight` says how often each counts."""
    by, names, q = list(by), moment_names(features), len(features) + 1
    if most > BLOCK:
        block = f"{member}_block"
        stats = merged(_in_blocks(stats, member, most), [*by, block], member, features, BLOCK, weight)
        return merged(stats, by, block, features, -(-most // BLOCK))
    lists = _lists(stats, by, member, names, weight)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            own = _padded(x["_list"].map(lambda m: sorted(m, key=lambda r: r["member"])), q, len(names))
            total = reduce(lambda a, k: _merge(a, own[:, k], q), range(own.shape[1]), np.zeros((len(x), len(names))))
            yield pd.concat([x[by].reset_index(drop=True), pd.DataFrame(total, columns=names)], axis=1)

    shape = T.StructType([*[lists.schema[c] for c in by], *[T.StructField(n, T.DoubleType()) for n in names]])
    return lists.mapInPandas(run, shape)


def without_each(stats: DataFrame, by: Sequence[str], member: str, features: Sequence[str], most: int, weight: str | None = None) -> DataFrame:
    """by, member and, as ``t_<moment>``, the moments of all other members: those before it merged with those behind it.

    Over BLOCK members are dealt to blocks: the others of the own block are merged with the other blocks.
    """
    by, names, q = list(by), moment_names(features), len(features) + 1
    if most > BLOCK:
        block, dealt = f"{member}_block", _in_blocks(stats, member, most)
        near = without_each(dealt, [*by, block], member, features, BLOCK, weight)
        blocks = merged(dealt, [*by, block], member, features, BLOCK, weight)
        far = without_each(blocks, by, block, features, -(-most // BLOCK))
        far = far.select(*by, block, *[F.col(f"t_{n}").alias(f"f_{n}") for n in names])
        met = near.join(far, [*by, block])

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def both(sums: pd.DataFrame) -> pd.Series:
            values = sums.to_numpy(dtype=float)
            return pd.Series(list(_merge(values[:, :len(names)], values[:, len(names):], q)))

        total = both(F.struct(*[F.col(f"{side}_{n}") for side in "tf" for n in names]))
        return met.select(*by, member, total.alias("_t")).select(*by, member, *[F.col("_t")[i].alias(f"t_{n}") for i, n in enumerate(names)])
    lists = _lists(stats, by, member, names, weight)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            members = x["_list"].map(lambda m: sorted(m, key=lambda r: r["member"]))
            own = _padded(members, q, len(names))
            rest = np.zeros_like(own)
            for k in range(1, own.shape[1]):
                rest[:, k] = _merge(rest[:, k - 1], own[:, k - 1], q)
            behind = np.zeros((len(x), len(names)))
            for k in range(own.shape[1] - 1, -1, -1):
                rest[:, k] = _merge(rest[:, k], behind, q)
                behind = _merge(own[:, k], behind, q)
            size = members.map(len).to_numpy()
            inside = np.arange(own.shape[1]) < size[:, None]
            out = x[by].iloc[np.repeat(np.arange(len(x)), size)].reset_index(drop=True)
            out[member] = [r["member"] for m in members for r in m]
            yield pd.concat([out, pd.DataFrame(rest[inside], columns=[f"t_{n}" for n in names])], axis=1)

    shape = T.StructType([*[lists.schema[c] for c in by], T.StructField(member, stats.schema[member].dataType),
                          *[T.StructField(f"t_{n}", T.DoubleType()) for n in names]])
    return lists.mapInPandas(run, shape)


def coefficients(train: Mapping[str, Column], features: Sequence[str], models: Mapping[str, Sequence[str]],
                 penalty: float) -> Column:
    """struct of raw-scale coefficients ``<model>_intercept`` and ``<model>_<feature>`` for each model.

    Features are standardised with the training mean and population deviation (a constant feature keeps
    deviation 1); the intercept is not penalised. Without training rows the coefficients are NaN.
    """
    features = list(features)
    q = len(features) + 1
    names = [f"{m}_{f}" for m, fs in models.items() for f in ["intercept", *fs]]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    places = {m: [features.index(f) for f in fs] for m, fs in models.items()}

    @F.pandas_udf(schema)
    def solve(sums: pd.DataFrame) -> pd.DataFrame:
        s = sums.to_numpy(dtype=float)
        w = np.where(s[:, 0] > 0.5, s[:, 0], np.nan)
        y_mean, mean = np.where(np.isnan(w), np.nan, s[:, 1]), s[:, 2:1 + q]
        square = np.empty((len(s), q, q))
        upper = np.triu_indices(q)
        square[:, upper[0], upper[1]] = square[:, upper[1], upper[0]] = s[:, 1 + q:]
        spread, xy = square[:, 1:, 1:], square[:, 1:, 0]
        diagonal = np.einsum("mii->mi", spread)
        constant = diagonal <= 0
        sd = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, diagonal) / w[:, None]))
        z = np.where(constant[:, :, None] | constant[:, None, :], 0.0, spread) / (sd[:, :, None] * sd[:, None, :])
        b = np.where(constant, 0.0, xy) / sd
        out = {}
        for model, at in places.items():
            a = z[:, at][:, :, at] + penalty * np.eye(len(at))
            usable = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(w)
            slope = np.full((len(s), len(at)), np.nan)
            slope[usable] = np.linalg.solve(a[usable], b[usable][:, at, None])[..., 0]
            slope = slope / sd[:, at]
            out[f"{model}_intercept"] = y_mean - (slope * mean[:, at]).sum(axis=1)
            for k, i in enumerate(at):
                out[f"{model}_{features[i]}"] = slope[:, k]
        return pd.DataFrame(out)[names]

    return solve(F.struct(*[train[n].alias(n) for n in moment_names(features)]))


def predict(fit: Column, model: str, features: Sequence[str]) -> Column:
    value = fit[f"{model}_intercept"]
    for f in features:
        value = value + fit[f"{model}_{f}"] * F.col(f)
    return value


def absolute_errors(fit: Column, models: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    return {m: F.abs(predict(fit, m, fs) - F.col("y")) for m, fs in models.items()}


def held_out_fits(problem: Problem, models: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One fit per held-out group: keys, mask, group, s_w (rows of the group) and ``fit``."""
    keys, features = list(problem.keys), problem.features
    stats = problem.group_stats()
    rest = without_each(stats, [*keys, "mask"], "group", features, problem.most_groups)
    own = problem.own(rest).join(stats.select(*keys, "mask", "group", "s_w"), [*keys, "mask", "group"])
    train = {n: F.col(f"t_{n}") for n in moment_names(features)}
    return own.select(*keys, "mask", "group", "s_w", coefficients(
        train, features, models or problem.models, problem.penalty).alias("fit"))


def held_out_errors(problem: Problem, models: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Each row with ``error_<model>``: its absolute error under the model fitted without its group."""
    models = models or problem.models
    fits = held_out_fits(problem, models)
    joined = problem.join(problem.rows, fits, [*problem.keys, "mask", "group"])
    errors = absolute_errors(F.col("fit"), models)
    return joined.select(*problem.keys, "group", "row_id", *[e.alias(f"error_{m}") for m, e in errors.items()])


def gain(base_error: Column, larger_error: Column) -> Column:
    """1 − error of the larger model / error of the base model; NULL where it is not defined."""
    return finite(1 - F.try_divide(larger_error, base_error))


def held_out_gain(problem: Problem) -> DataFrame:
    """Per problem: MAE of both models and the gain of the larger one."""
    return held_out_errors(problem).groupBy(*problem.keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("error_base").alias("mae_base"), F.avg("error_larger").alias("mae_larger"),
        gain(F.sum("error_base"), F.sum("error_larger")).alias("gain"))
