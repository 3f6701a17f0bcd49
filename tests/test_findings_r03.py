"""What round three found: plans that send expanded rows through the driver, and states that grow with a group."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ecoframe.operators import quality, robustness, skew, zonal

SF = "/root/testdata/sf0.001"


def broadcast_expansions(df):
    """Broadcast subtrees of the plan that multiply rows, which estimates of their size leave out."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.match(r"[\s:+|-]*", line).end() for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out += [x for x in lines[i:end] if "Generate explode" in x]
    return out


@pytest.mark.parametrize("name", ["items_over_areas", "items_over_points"])
def test_expanded_areas_and_footprints_are_not_broadcast(spark, name):
    out = entry.queries()[name](spark, SF)
    assert not broadcast_expansions(out) and "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_draws_of_replicates_are_not_broadcast(spark):
    assert not broadcast_expansions(entry.queries()["jaccard_at_effort"](spark, SF))


@pytest.mark.parametrize("limited", [1000, 3])
def test_both_ranks_of_draws_take_the_same_minutes(spark, monkeypatch, limited):
    monkeypatch.setattr(robustness, "MOST_LIMITED", limited, raising=False)
    minutes = spark.range(40).select((F.col("id") % 3).alias("site"), F.col("id").alias("minute"))
    heard = spark.range(200).select((F.col("id") % 40 % 3).alias("site"), (F.col("id") % 40).alias("minute"),
                                    F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("species"))
    reference = spark.createDataFrame([("s1",), ("s2",)], "species string")
    out = robustness.jaccard_at_effort(minutes, heard, reference, ["site"], 5, 8)
    assert limited == 1000 or not broadcast_expansions(out)
    chosen, distances = {}, {}
    drawn = minutes.crossJoin(spark.range(8)).withColumn("u", robustness.uniform("effort", F.col("site"), F.col("id").cast("int"), F.col("minute")))
    for r in sorted(drawn.collect(), key=lambda r: (r.u, r.minute)):
        chosen.setdefault((r.site, r.id), []).append(r.minute)
    species = {}
    for r in heard.collect():
        species.setdefault(r.minute, set()).add(r.species)
    for (site, _), mine in chosen.items():
        own = set().union(*(species.get(k, set()) for k in mine[:5]))
        distances.setdefault(site, []).append(1 - len(own & {"s1", "s2"}) / len(own | {"s1", "s2"}))
    assert {r.site: r.distance for r in out.collect()} == {s: pytest.approx(sum(d) / len(d)) for s, d in distances.items()}


def test_draws_of_few_rows_are_dealt_to_many_tasks(spark):
    plan = entry.queries()["fixed_error_interval"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not any("b#" in x and "keys=[" in x and "index#" in x.split("functions")[0] for x in plan.splitlines())


@pytest.mark.parametrize("chunk, pixels", [(10_000, 1 << 20), (7, 64)])
def test_discs_of_many_blocks_are_counted_as_one_group(spark, monkeypatch, chunk, pixels):
    monkeypatch.setattr(zonal, "CHUNK", chunk)
    monkeypatch.setattr(zonal, "PIXELS", pixels, raising=False)
    r, kinds, blocks, points, expected = np.random.default_rng(3), [], [], [], []
    for k, (x0, y0, res, h, w, nodata) in enumerate([(0.0, 0.0, 10.0, 9, 6, -1.0), (50.0, 300.0, 7.5, 5, 11, 2.0), (-20.0, 90.0, 3.0, 8, 8, 9.0)]):
        grid = np.full((12, 12), np.nan)
        grid[:h, :w] = r.choice([-1.0, 1.0, 2.0, 3.0], (h, w))
        kinds.append((f"r{k}", x0, y0, res, w, h, nodata))
        blocks += [(f"r{k}", i, j, grid[4 * i:4 * i + 4, 4 * j:4 * j + 4].ravel().tolist()) for i in range(3) for j in range(3)]
        rows, cols = np.mgrid[:12, :12]
        for p in range(8):
            x, y = float(x0 + r.uniform(-20, 100)), float(y0 - r.uniform(-20, 90))
            points.append((f"r{k}", f"p{p}", x, y))
            d2 = (x0 + (cols + 0.5) * res - x) ** 2 + (y0 - (rows + 0.5) * res - y) ** 2
            for radius in (4.0, 33.0):
                valid = (d2 <= radius * radius) & ~np.isnan(grid) & (grid != nodata)
                native = valid & (grid >= 2)
                expected.append((f"r{k}", f"p{p}", radius, int(valid.sum()), int(native.sum()), round(float(np.sqrt(d2[native].min())), 6) if native.any() else None))
    out = zonal.zonal_cover(
        spark.createDataFrame(points, "href string, point string, x double, y double"),
        spark.createDataFrame(kinds, "href string, x0 double, y0 double, res double, width int, height int, nodata double"),
        spark.createDataFrame(blocks, "href string, block_row int, block_col int, values array<double>"), [2, 3], (4.0, 33.0), 4)
    got = [(g.href, g.point, g.radius, g.n, g.native, None if g.nearest is None else round(g.nearest, 6)) for g in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    groups = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "FlatMapCoGroupsInPandas" in x]
    assert groups and all("_group#" in x and "_chunk#" not in x.split("count(")[0] for x in groups)


def test_orphans_come_from_one_grouping_of_names(spark):
    annotated, audio = ["a", "b", "b", None, None], ["b", "c", "c", "d", None]
    out = quality.orphan_files(*(spark.createDataFrame([(f,) for f in names], "file string") for names in (annotated, audio)))
    assert sorted((r.kind, str(r.target)) for r in out.collect()) == sorted(
        [(quality.C.QC_ANNOTATION_WITHOUT_AUDIO, f) for f in ("a", "None")] + [(quality.C.QC_AUDIO_WITHOUT_ANNOTATION, f) for f in ("c", "d", "None")])
    plan = entry.queries()["qc_orphans"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "LeftAnti" not in plan and plan.count("Scan parquet") == 3


@pytest.mark.parametrize("piece", [10_000, 2])
def test_repeated_annotations_are_counted_and_not_joined_back(spark, monkeypatch, piece):
    monkeypatch.setattr(skew, "PIECE", piece, raising=False)
    rows = [("a", "x", 1.0, 2.0, 1)] * 3 + [("a", None, 1.0, None, k) for k in range(6)] + [("a", "x", 1.0, 3.0, 9), (None, None, None, None, 1), (None, None, None, None, 2)]
    out = quality.repeated_annotations(spark.createDataFrame(rows, "file string, species string, start_s double, end_s double, ordinal long"), ["ordinal"])
    got = sorted((str(r.target), r.detail) for r in out.collect())
    # the first three share their ordinal too: two of them are second and later occurrences all the same
    assert got == sorted([("a", "x 1.0–2.0 s")] * 2 + [("a", "NULL 1.0–NULL s")] * 5 + [("None", "NULL NULL–NULL s")])
    plan = entry.queries()["qc_duplicate_annotations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ordinal" not in plan and plan.count("Scan parquet") == 2


def test_report_shuffles_no_ordinals_and_groups_names_once(spark):
    plan = entry.queries()["qc_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ordinal" not in "".join(x for x in plan.splitlines() if "l_orderkey" in x) and "FullOuter" in plan and "LeftAnti" not in plan
    names = lambda side: spark.createDataFrame([(f,) for f in side], "file string")
    annotated = names(["a", "b", "b", None, None]).selectExpr("file", "'S' site", "'x' species", "1D start_s", "2D end_s", "1 ordinal")
    audio = names(["b", "c", "c", "d", None]).selectExpr("file", "'S' site", "'T' source_site", "timestamp_ntz'2024-01-01' clock_start", "60D duration_s",
                                                        "1 rate_hz", "1 channels", "file sha256", "cast(null as string) error", "file path")
    got = {(r.kind, r.target): 0 for r in quality.quality_report(audio, annotated).collect()}
    for r in quality.quality_report(audio, annotated).collect():
        got[r.kind, r.target] += 1
    kinds = (quality.C.QC_ANNOTATION_WITHOUT_AUDIO, quality.C.QC_AUDIO_WITHOUT_ANNOTATION, quality.C.QC_DUPLICATE_ANNOTATION, quality.C.QC_ANNOTATION_OUTSIDE_AUDIO)
    assert {k: n for k, n in got.items() if k[0] in kinds} == {
        (kinds[0], "a"): 1, (kinds[0], None): 1, (kinds[1], "c"): 1, (kinds[1], "d"): 1, (kinds[1], None): 1, (kinds[2], "b"): 1, (kinds[2], None): 1}


def test_acoustic_summary_reads_one_assignment(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()["rarefaction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "l_orderkey" in x]
    assert len(scans) <= 3, scans
