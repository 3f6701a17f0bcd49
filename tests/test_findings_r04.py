"""What round four found: draws that fill the disk."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ecoframe.operators import robustness

SF = "/root/testdata/sf0.001"


def test_draws_are_neither_sorted_nor_shuffled_where_keys_are_small(spark):
    plan = entry.queries()["jaccard_at_effort"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # Minutes are not multiplied by the replicates.
    assert not [x for x in plan.splitlines() if "Generate explode(" in x and "minute#" in x and "[replicate#" in x] and "md5" in plan


@pytest.mark.parametrize("piece, limited", [(10_000, 1000), (4, 1000), (4, 3)])
def test_nulls_and_repeated_minutes_count_as_they_are(spark, monkeypatch, piece, limited):
    monkeypatch.setattr(robustness, "PIECE", piece, raising=False)
    monkeypatch.setattr(robustness, "MOST_LIMITED", limited)
    listed = [(1, k) for k in range(12)] + [(1, 3), (1, None), (2, 1), (2, 2), (3, 1), (3, 1), (3, 1), (3, 2), (None, 5), (None, 6), (None, 7), (None, 8), (None, 9)]
    heard = [(1, k, s) for k in range(12) for s in ("a", "b", "c", None)[k % 3:k % 3 + 2]] + [(1, 0, "a"), (1, 77, "z"), (1, None, "a"), (3, 1, "b"), (None, 5, "a")]
    minutes = spark.createDataFrame(listed, "site long, minute int")
    detections = spark.createDataFrame(heard, "site int, minute long, species string")
    reference = spark.createDataFrame([("a",), ("b",), ("b",), ("x",), (None,)], "species string")
    m, replicates = 4, 6
    got = {r.site: r for r in robustness.jaccard_at_effort(minutes, detections, reference, ["site"], m, replicates).collect()}
    u = robustness.uniform("effort", F.col("site"), F.col("id").cast("int"), F.col("minute"))
    draws, expected = {}, {}
    for r in minutes.crossJoin(spark.range(replicates)).withColumn("u", u).collect():
        draws.setdefault((r.site, r.id), []).append((r.u, r.minute is not None, r.minute))
    for (site, _), mine in draws.items():
        own = {s for _, _, minute in sorted(mine)[:m] for a, b, s in heard if site is not None and (a, b) == (site, minute) and minute is not None}
        expected.setdefault(site, []).append(1 - len(own & {"a", "b", "x"}) / (len(own) + 4 - len(own & {"a", "b", "x"})))
    assert {s: r.minutes for s, r in got.items()} == {1: 14, 2: 2, 3: 4, None: 5}
    assert got[2].distance is None and got[2].spread is None
    assert {s: r.distance for s, r in got.items() if s != 2} == {s: pytest.approx(sum(d) / len(d)) for s, d in expected.items() if s != 2}
