import datetime as dt
import itertools
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions import scalars as S
from ecoframe.functions.random import uniform


def column(spark, values, kind, *expressions):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [tuple(r) for r in rows.select(*expressions).collect()]


def test_recording_names(spark):
    names = ["RBA_20221009_050240.wav", "rba_20221009_050240.WAV", "RBA_2022109_050240.wav", "RBA_20221009.wav",
             "RBA_20221340_050240.wav", "no_pattern.wav"]
    v = F.col("v")
    rows = column(spark, names, "string", S.recording_site(v), S.recording_clock(v), S.recording_name_error(v).isNotNull())
    start = dt.datetime(2022, 10, 9, 5, 2, 40)
    assert rows[0] == ("RBA", start, False) and rows[1] == ("RBA", start, False)
    assert all(r[2] for r in rows[2:]) and all(r[1] is None for r in rows[2:])


def test_source_text(spark):
    v = F.col("v")
    assert column(spark, ["48 kHz", "44.1 kHz", "44,1 KHZ", "unknown", None], "string", S.rate_in_hz(v)) == [
        (48000.0,), (44100.0,), (44100.0,), (None,), (None,)]
    assert column(spark, ["2020 to 2022", "unknown", None], "string", S.years_in_text(v)) == [([2020, 2022],), ([],), ([],)]
    assert column(spark, ["S2A_N0400_x", "S2A_N0500_x", "S2A_N0301_x", "none"], "string", S.reflectance_offset(v)) == [
        (1000.0,), (1000.0,), (0.0,), (0.0,)]
    assert column(spark, ["/a/rgu/x.wav", "x.wav"], "string", S.folder_site(v)) == [("RGU",), (None,)]


def test_coordinates(spark):
    rows = spark.createDataFrame([("-6.2", "-36"), ("-6,2", "-36"), ("90", "180"), ("90.1", "0"), ("0", "-181"), (None, "0")], "a string, b string")
    assert [r[0] for r in rows.select(S.valid_coordinate(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False, False]


def test_windows(spark):
    v = F.col("v")
    assert column(spark, [dt.datetime(2022, 10, 9, 5, 2, 40)], "timestamp_ntz", S.window_cut(v), S.window_start(v)) == [
        (dt.date(2022, 10, 8), dt.date(2021, 10, 8))]
    start = F.to_date(F.lit("2022-12-19"))
    assert column(spark, [360, 3, 353], "int", S.observation_date(start, v)) == [
        (dt.date(2022, 12, 26),), (dt.date(2023, 1, 3),), (dt.date(2022, 12, 19),)]
    cut = F.to_date(F.lit("2022-12-31"))
    days = [dt.date(2021, 12, 1), dt.date(2021, 12, 31), dt.date(2022, 4, 1), dt.date(2022, 4, 2), dt.date(2022, 12, 31)]
    assert [r[0] for r in column(spark, days, "date", S.relative_quarter(v, cut))] == [0, 0, 0, 1, 3]


@pytest.mark.parametrize("total,m,minutes", [(4, 2, [2, 1, 4]), (5, 5, [1, 3, 5]), (7, 3, [1, 2, 6, 7]), (9, 1, [4])])
def test_rarefaction_equals_enumeration(spark, total, m, minutes):
    picks = list(itertools.combinations(range(total), m))
    expected = sum(sum(any(p < n for p in pick) for pick in picks) / len(picks) for n in minutes)
    rows = column(spark, minutes, "bigint", S.rarefaction_term(F.col("v"), F.lit(total), F.lit(m)))
    assert sum(r[0] for r in rows) == pytest.approx(expected, abs=1e-12)


def test_rarefaction_of_any_size_equals_exact_integers(spark):
    cases = [(200, 65, 65), (193, 65, 65), (1000, 100, 70), (5000, 80, 66), (100_000, 3000, 900), (100_000, 99_000, 65), (1_000_000, 40_000, 100)]
    cases += [(10 ** 9, 32_000, 31_000), (10 ** 9, 10 ** 8, 65), (10 ** 9, 10 ** 6, 900), (10 ** 9, 5 * 10 ** 8, 3), (10 ** 9, 999_999_990, 999_999_990), (10 ** 7, 0, 9)]

    def exact(total, n, m):
        short, long_ = sorted((n, m))
        absent = Fraction(1)
        for j in range(short):  # rounded to 200 bits now and then, far below what is compared
            absent *= Fraction(total - long_ - j, total - j)
            if absent.denominator.bit_length() > 4000:
                absent = Fraction((absent.numerator << 400) // absent.denominator, 1 << 400)
            if absent < Fraction(1, 10 ** 30):
                return 1.0
        return float(1 - absent)

    rows = spark.createDataFrame(cases, "total long, n long, m long").select(S.rarefaction_term(F.col("n"), F.col("total"), F.col("m"))).collect()
    for case, row in zip(cases, rows):
        assert abs(row[0] - exact(*case)) < 1e-12, case


def test_rarefaction_refuses_too_much_effort(spark):
    with pytest.raises(Exception, match="rarefaction effort"):
        column(spark, [1], "bigint", S.rarefaction_term(F.col("v"), F.lit(5), F.lit(6)))


def test_three_decimals_match_c_format(spark):
    values = [n * 0.0001 for n in range(100, 20000, 5)] + [0.0625, 0.1875, 0.2505, 9.9995, 15.9999, 16.0, 17.0625, 999.9995, 123456.0005, 2.0 ** 52 + 1, 2.0 ** 60]
    assert [r[0] for r in column(spark, values, "double", S.three_decimals(F.col("v")))] == [f"{v:.3f}" for v in values]


@pytest.mark.parametrize("gain,low,high,expected", [
    (.20, .11, .30, C.READING_CONFIRMED), (.10, .10, .12, C.READING_CONFIRMED), (.15, .02, .30, C.READING_POSITIVE_ABOVE),
    (.05, .01, .08, C.READING_POSITIVE_BELOW), (.02, -.05, .08, C.READING_DISCARDED), (.12, -.03, .25, C.READING_INCONCLUSIVE),
    (.05, .01, .12, C.READING_INCONCLUSIVE)])
def test_interval_readings(spark, gain, low, high, expected):
    assert column(spark, [gain], "double", S.interval_reading(F.col("v"), F.lit(low), F.lit(high))) == [(expected,)]


def test_jaccard(spark):
    rows = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], [])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(S.jaccard_distance(F.col("a"), F.col("b"))).collect()] == pytest.approx([2 / 3, 0.0, 1.0])


def test_missing_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,), (None,)], "v double")
    assert [r[0] for r in rows.select(S.finite(F.col("v"))).collect()] == [None, None, 1.5, None]
    ratio = rows.select(S.normalized_difference(F.lit(0.0), F.lit(0.0))).first()[0]
    assert ratio is None


def test_uniforms_do_not_depend_on_partitioning(spark):
    def draws(df):
        return {r.id: (r.a, r.b) for r in df.select("id", uniform(7, F.col("id")).alias("a"), uniform(7, F.col("id"), portable=True).alias("b")).collect()}
    one, many = draws(spark.range(2000).repartition(1)), draws(spark.range(2000).repartition(7))
    assert one == many
    for k in (0, 1):
        values = [v[k] for v in one.values()]
        assert 0 <= min(values) and max(values) < 1 and abs(sum(values) / 2000 - 0.5) < 0.03


def test_status_labels(spark):
    rows = spark.createDataFrame([(True, 9, None), (False, 9, "x"), (False, 3, "x"), (False, 5, "névoa (B02 0.2 > 0.1)"), (False, 5, "x"), (False, None, None)],
                                 "ok boolean, scl int, reason string")
    got = [r[0] for r in rows.select(S.composite_status(F.col("ok"), F.col("scl"), F.col("reason"))).collect()]
    assert got == [C.STATUS_VALID, C.STATUS_CLOUD, C.STATUS_SHADOW, C.STATUS_HAZE, C.STATUS_OTHER, C.STATUS_OTHER]
