"""Threshold curves, lists at equal effort, gaps and anomalies on small tables."""

from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecoframe.operators import robustness, thresholds


@pytest.mark.parametrize("pieces", [64, 3])
def test_threshold_curve_equals_the_sums_of_each_threshold(spark, pieces, monkeypatch):
    monkeypatch.setattr(thresholds, "PIECES", pieces)
    r = np.random.default_rng(3)
    clips = [("a" if k % 3 else "b", f"s{r.integers(4)}", float(r.integers(12)) / 10, bool(r.random() < 0.5), 0.25) for k in range(150)]
    clips += [("a", "alone", 0.35, True, 0.5), ("a", "s1", None, True, 0.5), ("a", "s1", 0.2, None, 0.5), ("a", "s1", 0.2, True, 0.0)]
    got = thresholds.threshold_curve(spark.createDataFrame(clips, "species string, stratum string, score double, truth boolean, p double"), ["species"]).collect()
    used = [c for c in clips if c[2] is not None and c[3] is not None and c[4] > 0]
    assert len(got) == len({(c[0], c[2]) for c in used})
    for g in got:
        mine = [c for c in used if c[0] == g.species]
        w = lambda cs: sum(1 / c[4] for c in cs)
        accepted, positive = [c for c in mine if c[2] >= g.threshold], [c for c in mine if c[3]]
        hits = [c for c in accepted if c[3]]
        p, q = w(hits) / w(accepted), w(hits) / w(positive)
        errors = []
        for value, of, e in ((p, w(accepted), lambda c: (c[2] >= g.threshold) * (c[3] - p)), (q, w(positive), lambda c: c[3] * ((c[2] >= g.threshold) - q))):
            v = 0.0
            for stratum in {c[1] for c in mine}:
                part = [c for c in mine if c[1] == stratum]
                size, population = len(part), w(part)
                if size > 1:
                    v += population ** 2 * (1 - size / population) / size * np.var([e(c) for c in part], ddof=1)
            errors.append(sqrt(v) / of)
        assert (g.precision, g.recall) == (pytest.approx(p), pytest.approx(q))
        assert (g.se_precision, g.se_recall) == (pytest.approx(errors[0], abs=1e-6), pytest.approx(errors[1], abs=1e-6))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "species string, stratum string, score double, truth boolean, p double")
    assert thresholds.threshold_curve(none, ["species"]).count() == 0
    series = spark.createDataFrame([], "site long, year int, quarter int, v double")
    assert robustness.gap_levels(series, ["site"], "v", "quarter", ["year"]).count() == 0
    assert robustness.quarter_anomaly(series, ["site"], "v", "year", "quarter").count() == 0


def test_effort_takes_the_least_draws_of_every_replicate(spark):
    minutes = spark.createDataFrame([(s, k) for s in (1, 2) for k in range(3 if s == 2 else 9)], "site long, minute long")
    heard = [(1, k, f"sp{k % 5}") for k in range(9)] + [(2, 0, "sp0")]
    detections = spark.createDataFrame(heard, "site long, minute long, species string")
    reference = spark.createDataFrame([("sp0",), ("sp1",), ("x",)], "species string")
    got = {g.site: g for g in robustness.jaccard_at_effort(minutes, detections, reference, ["site"], 4, 10).collect()}
    draws = minutes.where("site = 1").crossJoin(spark.range(10)).withColumn(
        "u", robustness.uniform("effort", F.col("site"), F.col("id").cast("int"), F.col("minute"))).toPandas()
    distances = []
    for _, d in draws.groupby("id"):
        own = {f"sp{k % 5}" for k in d.sort_values("u").minute[:4]}
        distances.append(1 - len(own & {"sp0", "sp1", "x"}) / len(own | {"sp0", "sp1", "x"}))
    assert got[1].distance == pytest.approx(np.mean(distances)) and got[2].distance is None and got[2].minutes == 3


def test_gap_levels_are_nested_and_full_at_one(spark):
    rows = [(1, 2000 + k // 20, k % 4, k, float(k * k % 17)) for k in range(60)] + [(1, 2000, 0, 99, None)]
    out = robustness.gap_levels(spark.createDataFrame(rows, "site long, year int, quarter int, k int, v double"), ["site", "year"], "v", "quarter", ["k"])
    by = {(g.year, g.mode, g.level): g for g in out.collect()}
    assert all(by[2000, m, 1.0].n == 20 for m in ("random", "quarter"))
    for mode in ("random", "quarter"):
        counts = [by[2001, mode, level].n for level in robustness.LEVELS]
        assert counts == sorted(counts, reverse=True)
    values = [v for _, y, _, _, v in rows if y == 2002]
    assert by[2002, "random", 1.0].median == pytest.approx(np.median(values))


def test_anomaly_never_sees_its_own_year(spark):
    rows = [(1, y, 2, v) for y, v in ((2000, 1.0), (2001, 3.0), (2003, 100.0))]
    out = robustness.quarter_anomaly(spark.createDataFrame(rows, "site long, year int, quarter int, v double"), ["site"], "v", "year", "quarter")
    got = {g.year: (g.anomaly, g.anomaly_all_years, g.earlier_years) for g in out.collect()}
    assert got == {2000: (None, 1.0 - 51.5, 0), 2001: (2.0, 3.0 - 50.5, 1), 2003: (98.0, 98.0, 2)}
