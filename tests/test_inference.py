import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecoframe.operators import sets
from ecoframe.operators import intervals as I
from ecoframe.operators import ridge as G

X = ["a", "b", "c", "d"]


def ridge_by_descent(xt, yt, xs, penalty=1.0):
    """The minimum of the penalised squares, by conjugate gradients on standardised columns; nothing is inverted."""
    centre, scale = xt.mean(0), np.where(xt.std(0) > 0, xt.std(0), 1.0)
    z, t = (xt - centre) / scale, yt - yt.mean()
    beta = np.zeros(z.shape[1])
    left = z.T @ t
    way = left.copy()
    for _ in range(60):
        if left @ left < 1e-28:
            break
        pull = z.T @ (z @ way) + penalty * way
        step = (left @ left) / (way @ pull)
        beta, after = beta + step * way, left - step * pull
        way, left = after + (after @ after) / (left @ left) * way, after
    return yt.mean() + (xs - centre) / scale @ beta


def data(n, groups=None, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = x @ [0.5, 0.2, 0.4, 0.6] + rng.normal(size=n)
    table = pd.DataFrame(x, columns=X).assign(y=y, group=np.arange(n) if groups is None else groups, row_id=np.arange(n), k=1, mask=0)
    return table


def problem(spark, table, skewed=True, **k):
    return G.Problem(spark.createDataFrame(table), ("k",), ("a", "b", "c"), tuple(X), skewed=skewed, **k)


def held_out(table, columns, y=None):
    x, y, g = table[columns].to_numpy(), table.y.to_numpy() if y is None else y, table.group.to_numpy()
    return np.array([abs(ridge_by_descent(x[g != g[i]], y[g != g[i]], x[i:i + 1])[0] - y[i]) for i in range(len(x))])


@pytest.mark.parametrize("groups", [None, [0, 0, 1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 5, 6]])
@pytest.mark.parametrize("skewed", [True, False])
def test_held_out_errors_equal_ridge_by_descent(spark, groups, skewed):
    table = data(14, groups)
    got = G.held_out_errors(problem(spark, table, skewed)).toPandas().sort_values("row_id")
    assert np.abs(got.error_larger.to_numpy() - held_out(table, X)).max() < 1e-10
    assert np.abs(got.error_base.to_numpy() - held_out(table, X[:3])).max() < 1e-10


def test_without_groups_every_row_is_held_out_alone(spark):
    table = data(9, seed=4)
    got = G.held_out_errors(problem(spark, table.drop(columns="group"))).toPandas().sort_values("row_id")
    assert np.abs(got.error_larger.to_numpy() - held_out(table, X)).max() < 1e-10


def test_weights_equal_repeated_rows(spark):
    table, weights = data(12), [2, 1, 0, 1, 4, 1, 1, 0, 3, 1, 2, 1]
    rows = spark.createDataFrame(table.assign(w=weights))
    sums = rows.agg(*G.moments(X, F.col("w")))
    fit = sums.select(G.coefficients({n: F.col(n) for n in G.moment_names(X)}, X, {"m": X}, 1.0).alias("fit")).first().fit
    again = table.loc[np.repeat(np.arange(12), weights)]
    expected = ridge_by_descent(again[X].to_numpy(), again.y.to_numpy(), table[X].to_numpy())
    got = fit["m_intercept"] + table[X].to_numpy() @ np.array([fit[f"m_{f}"] for f in X])
    assert np.abs(got - expected).max() < 1e-10


def test_constant_feature_has_no_effect(spark):
    table = data(10).assign(d=3.7)
    got = G.held_out_errors(problem(spark, table)).toPandas()
    assert np.abs(got.error_larger - got.error_base).max() < 1e-10


def gain(table, base, larger, weights=None):
    w = np.ones(len(base)) if weights is None else weights
    return 1 - (w * larger).sum() / (w * base).sum()


def test_refit_bootstrap_equals_brute_force(spark):
    table = data(12, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5])
    p = problem(spark, table)
    got = I.refit_bootstrap_interval(p, 30, seed="s").first()
    indexed = I._indexed(p.rows.select("k", "group").distinct(), p, "group", "s", False, 64)
    counts = I._draw_counts(indexed, p, 30, "s", False).join(indexed, ["k", "index"]).select("b", "group", "c").toPandas()
    gains = []
    for _, drawn in counts.groupby("b"):
        assert drawn.c.sum() == 6
        w = table.group.map(drawn.set_index("group").c).fillna(0).astype(int).to_numpy()
        errors = {}
        for name, columns in (("base", X[:3]), ("larger", X)):
            e = np.zeros(12)
            for i in np.flatnonzero(w):
                train = np.repeat(np.arange(12), np.where(table.group == table.group[i], 0, w))
                e[i] = abs(ridge_by_descent(table[columns].to_numpy()[train], table.y.to_numpy()[train], table[columns].to_numpy()[i:i + 1])[0] - table.y[i])
            errors[name] = e
        gains.append(gain(table, errors["base"], errors["larger"], w))
    low, high = np.quantile(gains, [0.05, 0.95])
    observed = gain(table, held_out(table, X[:3]), held_out(table, X))
    assert (got.percentile_lower, got.percentile_upper) == (pytest.approx(low, abs=1e-9), pytest.approx(high, abs=1e-9))
    assert (got.basic_lower, got.basic_upper) == (pytest.approx(2 * observed - high, abs=1e-9), pytest.approx(2 * observed - low, abs=1e-9))
    assert got.replicate_mean == pytest.approx(np.mean(gains), abs=1e-9)


def test_corrected_cv_equals_brute_force(spark):
    table = data(15, [0, 0, 1, 2, 2, 3, 4, 4, 5, 6, 6, 7, 8, 8, 9])
    p = problem(spark, table)
    assignment = I.fold_assignment(p.rows.select("k", "group").distinct(), ["k"], 5, 3, "s")
    got = I.corrected_cv_interval(p, assignment).first()
    d, b, ratio = [], [], []
    for (_, _), members in assignment.toPandas().groupby(["r", "fold"]):
        assert len(members) == 2
        test = table.group.isin(members.group).to_numpy()
        mae = {}
        for name, columns in (("base", X[:3]), ("larger", X)):
            x, y = table[columns].to_numpy(), table.y.to_numpy()
            mae[name] = np.abs(ridge_by_descent(x[~test], y[~test], x[test]) - y[test]).mean()
        d.append(mae["base"] - mae["larger"])
        b.append(mae["base"])
        ratio.append(test.sum() / (~test).sum())
    d, b = np.array(d), np.array(b)
    r = d.mean() / b.mean()
    se = np.sqrt((1 / len(d) + np.mean(ratio)) * np.var((d - r * b) / b.mean(), ddof=1))
    assert len(d) == 15 and got.gain == pytest.approx(r, abs=1e-9)
    assert (got.lower, got.upper) == (pytest.approx(r - 1.6448536269514722 * se, abs=1e-9), pytest.approx(r + 1.6448536269514722 * se, abs=1e-9))


def test_permutation_test_equals_brute_force(spark):
    table = data(9, [0, 0, 1, 1, 2, 2, 3, 4, 5])
    p = problem(spark, table)
    got = I.permutation_test(p, "d", 19, seed="s").first()
    sizes = p.rows.groupBy("k", "group").agg(F.count(F.lit(1)).alias("size"))
    swaps = I.permuted_groups(sizes, p, 19, "s").toPandas()
    size = table.groupby("group").size()
    positions = p.rows.select("k", "group", "row_id").withColumn("_u", I.uniform("s", F.lit("row"), F.col("k"), F.col("row_id")))
    order = positions.toPandas().sort_values(["group", "_u"]).groupby("group").row_id.apply(list)
    base, observed, hits = held_out(table, X[:3]), held_out(table, X), 0
    for _, swap in swaps.groupby("i"):
        assert sorted(swap.group) == sorted(swap.source) and (size[swap.group].to_numpy() == size[swap.source].to_numpy()).all()
        moved = table.d.copy()
        for row in swap.itertuples():
            moved.loc[order[row.group]] = table.d.loc[order[row.source]].to_numpy()
        hits += gain(table, base, held_out(table.assign(d=moved), X)) >= gain(table, base, observed) - 1e-12
    assert got.p_value == pytest.approx((1 + hits) / 20)


def test_singleton_of_its_size_keeps_its_value(spark):
    table = data(5, [0, 0, 1, 1, 2])
    sizes = problem(spark, table).rows.groupBy("k", "group").agg(F.count(F.lit(1)).alias("size"))
    swaps = I.permuted_groups(sizes, problem(spark, table), 25, "s")
    assert swaps.where("group = 2 and source <> 2").isEmpty() and swaps.where("group = 0 and source = 1").count() > 0


def test_fixed_error_interval_agrees_on_both_paths(spark):
    table = data(20)
    wide, narrow = problem(spark, table, skewed=True), problem(spark, table, skewed=False)
    errors = G.held_out_errors(wide)
    a = I.fixed_error_interval(errors, wide, 100).first()
    b = I.fixed_error_interval(errors, narrow, 100).first()
    assert (a.gain, a.lower, a.upper) == (pytest.approx(b.gain), pytest.approx(b.lower), pytest.approx(b.upper))
    assert a.lower < a.gain < a.upper


def test_held_out_errors_with_varying_responses(spark):
    table = data(10)
    other = table.y + np.linspace(-1, 1, 10)
    rows = pd.concat([table, table.assign(mask=1, y=other)])
    hosted = spark.createDataFrame([(1, g, 1 if g < 3 else 0) for g in range(10)], "k long, group long, mask long")
    got = G.held_out_errors(problem(spark, rows, hosted=hosted)).toPandas().sort_values("row_id").error_larger.to_numpy()
    expected = np.where(np.arange(10) < 3, held_out(table, X, other.to_numpy()), held_out(table, X))
    assert len(got) == 10 and np.abs(got - expected).max() < 1e-10


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e8, 1.7e9])
def test_gain_does_not_depend_on_the_origin(spark, shift):
    table = data(40, np.arange(40) // 4)
    plain = G.held_out_gain(problem(spark, table)).first().gain
    moved = G.held_out_gain(problem(spark, table.assign(d=table.d.round(3) + shift))).first().gain
    rounded = G.held_out_gain(problem(spark, table.assign(d=table.d.round(3)))).first().gain
    assert moved == pytest.approx(rounded, abs=1e-6 if shift > 1e7 else 1e-9) and plain == pytest.approx(rounded, abs=1e-2)


@pytest.mark.parametrize("shift", [0.0, 1e3, 1e6, 1e9])
@pytest.mark.parametrize("block", [256, 3])
def test_a_group_far_from_all_others_changes_no_other_digit(spark, shift, block, monkeypatch):
    """Models fitted without the far group must not know how far it is; those with it agree with two passes over the rows."""
    monkeypatch.setattr(G, "BLOCK", block)
    table = data(48, np.arange(48) // 6)
    table.loc[table.group == 3, "d"] += shift
    got = G.held_out_errors(problem(spark, table)).toPandas().sort_values("row_id")
    for name, columns in (("base", X[:3]), ("larger", X)):
        for g in range(8):
            out = (table.group == g).to_numpy()
            x, y = table.loc[~out, columns].to_numpy(), table.y[~out].to_numpy()
            middle, spread = x.mean(axis=0), x.std(axis=0)
            z = (x - middle) / spread
            slope = np.linalg.solve(z.T @ z + np.eye(len(columns)), z.T @ (y - y.mean()))
            fitted = y.mean() + (table.loc[out, columns].to_numpy() - middle) / spread @ slope
            error = np.abs(fitted - table.y[out].to_numpy())
            assert np.allclose(got.loc[out, f"error_{name}"], error, rtol=1e-9, atol=1e-9 if g != 3 else 1e-9 * max(1.0, shift))


def test_moments_merge_in_any_grouping(spark):
    table = data(60, np.arange(60) % 20)
    p = problem(spark, table)
    stats = p.group_stats()
    names = G.moment_names(p.features)
    whole = p.rows.groupBy("k").agg(*G.moments(p.features)).toPandas()[names].to_numpy()
    for block in (256, 4):
        G.BLOCK, kept = block, G.BLOCK
        try:
            total = G.merged(stats, ["k"], "group", p.features, 20).toPandas()[names].to_numpy()
            rest = G.without_each(stats, ["k"], "group", p.features, 20).toPandas().set_index("group")
        finally:
            G.BLOCK = kept
        assert np.allclose(total, whole, rtol=1e-10, atol=1e-10)
        for g in (0, 7, 19):
            others = p.rows.filter(F.col("group") != g).groupBy("k").agg(*G.moments(p.features)).toPandas()[names].to_numpy()[0]
            assert np.allclose(rest.loc[g, [f"t_{n}" for n in names]].astype(float), others, rtol=1e-10, atol=1e-10)


def test_turnover_and_nestedness_equal_the_sums_over_pairs(spark):
    r = np.random.default_rng(8)
    rows = [(k, f"s{s}", f"sp{x}") for k in ("a", None) for s in range(7) for x in range(12) if r.random() < 0.2 + s / 12]
    rows += [("one", "s", "sp1"), ("same", "s", "x"), ("same", "t", "x"), ("same", "t", None), ("same", None, "y")] + rows[:4]
    got = {g.key: g for g in sets.beta_parts(spark.createDataFrame(rows, "key string, site string, species string"), ["key"], "site").collect()}
    assert set(got) == {"a", None, "one", "same"} and [got[k].dissimilarity for k in ("one", "same")] == [0.0, 0.0]
    for key in ("a", None):
        lists = {}
        for k, s, x in rows:
            if k == key:
                lists.setdefault(s, set()).add(x)
        pairs = [(len(p - q), len(q - p)) for p, q in itertools.combinations(lists.values(), 2)]
        low, high = sum(map(min, pairs)), sum(map(max, pairs))
        common = sum(map(len, lists.values())) - len(set().union(*lists.values()))
        sor, sim = (low + high) / (2 * common + low + high), low / (common + low)
        assert (got[key].dissimilarity, got[key].turnover, got[key].nestedness) == pytest.approx((sor, sim, sor - sim))
    assert sets.beta_parts(spark.createDataFrame([], "key string, site string, species string"), ["key"], "site").count() == 0
