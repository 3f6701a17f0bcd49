import datetime as dt
import hashlib
import json
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe import schemas
from ecoframe.operators.acoustic import campaign_table
from ecoframe.sources import audio, items, projection, provenance, registry, tables
from ecoframe.streaming import recordings as streaming


def wav(path, seconds=1.0, rate=8000, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(struct.pack("<h", sum(path.name.encode()) % 999) * int(seconds * rate) * channels)


def test_scan_of_audio_files(spark, tmp_path):
    wav(tmp_path / "rba" / "RBA_20221009_050240.wav", 60)
    wav(tmp_path / "RBA" / "RBA_20230123_110440.WAV", 60, channels=2)
    (tmp_path / "RBA" / "no_pattern.wav").write_bytes(b"not audio")
    (tmp_path / "RBA" / "notes.txt").write_text("x")
    rows = {r.file: r for r in audio.recording_table(audio.scan_wavs(spark, str(tmp_path))).collect()}
    assert len(rows) == 3
    first = rows["RBA_20221009_050240.wav"]
    assert (first.site, first.source_site, first.duration_s, first.rate_hz, first.channels, first.error) == ("RBA", "RBA", 60.0, 8000, 1, None)
    assert first.sha256 == hashlib.sha256((tmp_path / "rba" / first.file).read_bytes()).hexdigest() and first.time_zone == C.UNKNOWN_ZONE
    bad = rows["no_pattern.wav"]
    assert "name" in bad.error and "header" in bad.error and bad.site is None
    assert rows["RBA_20230123_110440.WAV"].channels == 2
    got = campaign_table(spark.createDataFrame(list(rows.values()), audio.recording_table(audio.scan_wavs(spark, str(tmp_path))).schema)).first()
    assert (got.campaign_id, got.n_recordings, got.effort_min) == ("RBA-1", 2, 2.0)


def test_file_stream_gives_the_batch_rows(spark, tmp_path):
    wav(tmp_path / "in" / "RBA" / "RBA_20221009_050240.wav", 2)
    wav(tmp_path / "in" / "RGU" / "RGU_20221010_050240.wav", 3)
    query = streaming.stream_campaigns(streaming.stream_recordings(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format(
        "memory").queryName("campaigns_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = {r.site: r.effort_min for r in spark.table("campaigns_seen").collect()}
    finally:
        query.stop()
    assert got == {"RBA": pytest.approx(2 / 60), "RGU": pytest.approx(3 / 60)}


def make_zip(path, *members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members:
            z.writestr(name, content)


def test_extraction_keeps_audio_only(spark, tmp_path):
    make_zip(tmp_path / "a.zip", ("x/one.wav", b"1"), ("x/read.txt", b"t"), ("x/._one.wav", b"m"), ("../../out.WAV", b"22"))
    out = tmp_path / "target"
    rows = audio.extract_wavs(spark, str(tmp_path), str(out)).collect()
    assert sorted((r.folder, r.name, r.size) for r in rows) == [("a", "one.wav", 1), ("a", "out.WAV", 2)]
    assert sorted(p.name for p in (out / "a").iterdir()) == ["one.wav", "out.WAV"] and not (tmp_path.parent / "out.WAV").exists()


def test_extraction_keeps_equal_names_of_two_archives(spark, tmp_path):
    make_zip(tmp_path / "in" / "s1" / "a.zip", ("r.wav", b"AAAA"))
    make_zip(tmp_path / "in" / "b.zip", ("r.wav", b"BBBB"))
    out = tmp_path / "target"
    for _ in range(2):  # the second time everything is in place
        rows = audio.extract_wavs(spark, str(tmp_path / "in"), str(out)).collect()
        assert sorted((r.folder, r.name, r.size) for r in rows) == [("b", "r.wav", 4), ("s1/a", "r.wav", 4)]
    assert (out / "s1" / "a" / "r.wav").read_bytes() == b"AAAA" and (out / "b" / "r.wav").read_bytes() == b"BBBB"


def test_extraction_replaces_a_file_of_equal_size_with_other_content(spark, tmp_path):
    make_zip(tmp_path / "a.zip", ("r.wav", b"AAAA"))
    (tmp_path / "t" / "a").mkdir(parents=True)
    (tmp_path / "t" / "a" / "r.wav").write_bytes(b"XXXX")
    audio.extract_wavs(spark, str(tmp_path), str(tmp_path / "t")).collect()
    assert (tmp_path / "t" / "a" / "r.wav").read_bytes() == b"AAAA"


def test_extraction_refuses_repeated_names(spark, tmp_path):
    make_zip(tmp_path / "a.zip", ("x/one.wav", b"1"), ("y/one.wav", b"2"))
    with pytest.raises(Exception, match="repeated in several folders: one.wav"):
        audio.extract_wavs(spark, str(tmp_path), str(tmp_path / "t")).collect()


HEAD = ("Site ID,Study area,Recording location,Biome,Latitude,Longitude,Recorder (+ microphone),Ominidirectional,Sampling rate,"
        "Recording date,Minutes Annotated,Contact,Reference\n")


def test_source_metadata_in_mixed_encoding(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes(HEAD.encode() + b"RBA,Caraj\x98s,Brazil,Forest,-6.1,-36.2,AudioMoth,yes,48 kHz,2022,18,someone@x,ref\n"
                     b"RGU,\xc1rea,Brazil,Forest,-6.3,-36.4,SM4,yes,44.1 kHz,2023,18,someone@x,ref\nOTH,a,b,c,1,2,d,e,f,g,h,i,j\n")
    assert not tables.is_utf8(spark, str(path))
    points = tables.points_from_source(tables.scan_text_csv(spark, str(path)), ["RBA", "RGU"])
    rows = {r.site: r for r in points.collect()}
    assert set(rows) == {"RBA", "RGU"} and rows["RGU"].study_area == "Área"
    assert (rows["RBA"].declared_rate_hz, rows["RGU"].declared_rate_hz, rows["RBA"].annotated_minutes) == (48000.0, 44100.0, 18)
    assert "someone@x" not in str(rows)


def test_utf8_with_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿Site,Recording,Species,Begin_Time_(s),End_Time_(s),Low_Freq_(Hz),High_Freq_(Hz)\nRBA,f.wav,Espécie,1,2.5,100,\nXX,g.wav,y,1,2,3,4\n".encode())
    assert tables.is_utf8(spark, str(path))
    assert tables.header(spark, str(path))[1:3] == ["Recording", "Species"]
    rows = tables.detections_from_source(tables.scan_text_csv(spark, str(path)), ["RBA"]).collect()
    assert [tuple(r) for r in rows] == [("RBA", "f.wav", "Espécie", 1.0, 2.5, 100.0, None, C.ANNOTATION_SOURCE)]


def test_exported_tables_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("A", "A-1", dt.datetime(2022, 10, 9, 5, 2, 40), dt.datetime(2022, 10, 10), 2, 2.5)], schemas.schema("campaigns"))
    tables.write_table(rows, str(tmp_path / "c"), "campaigns", csv=True)
    assert tables.header(spark, str(tmp_path / "c")) == ["sitio", "campanha_id", "inicio_relogio", "fim_relogio", "n_gravacoes", "esforco_min"]
    assert tables.scan_table(spark, str(tmp_path / "c"), "campaigns").collect() == rows.collect()
    series = spark.createDataFrame([("A", "041012", float("nan"), None)], "site string, tile string, B02 double, SCL int")
    tables.write_table(series, str(tmp_path / "s"), "series", csv=True)
    back = tables.scan_table(spark, str(tmp_path / "s"), "series").first()
    assert (back.tile, back.B02, back.SCL) == ("041012", None, None)


RECORD = {"files": [{"key": "a.zip", "size": 5, "checksum": "md5:abc", "links": {"self": "u"}}, {"key": "b", "size": 6, "checksum": "sha256:x", "links": {"self": "v"}}]}


def test_record_files(spark):
    rows = registry.files_of_record(spark.createDataFrame([(json.dumps(RECORD),)], "j string"), "j").collect()
    assert [tuple(r) for r in rows] == [("a.zip", "u", 5, "abc"), ("b", "v", 6, None)]


def test_projection_round_trip(spark):
    """Against the meridian arc, integrated numerically, and the length of the parallel."""
    p = spark.createDataFrame([(500000.0, 8325906.0), (484973.0, 8325906.0)], "x double, y double")
    lon, lat = projection.utm_to_lon_lat(F.col("x"), F.col("y"), 24)
    on, off = p.select(lon.alias("lon"), lat.alias("lat")).collect()
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi = np.linspace(0, np.radians(-on.lat), 20001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert on.lon == pytest.approx(-39.0, abs=1e-12) and arc * 0.9996 == pytest.approx(1e7 - 8325906.0, abs=1e-3)
    radius = a / np.sqrt(1 - e2 * np.sin(np.radians(off.lat)) ** 2) * np.cos(np.radians(off.lat))
    assert np.radians(-39.0 - off.lon) * radius * 0.9996 == pytest.approx(15027.0, abs=0.1)
    same = projection.shift_datum(F.lit(-39.1), F.lit(-15.1), "WGS84", "WGS84", (0.0, 0.0, 0.0))
    moved = projection.shift_datum(F.lit(-39.1), F.lit(-15.1), "GRS67", "WGS84", projection.SAD69_TO_WGS84)
    row = p.select(same[0].alias("a"), same[1].alias("b"), moved[0].alias("c"), moved[1].alias("d")).first()
    assert (row.a, row.b) == (pytest.approx(-39.1, abs=1e-9), pytest.approx(-15.1, abs=1e-9))
    assert 0 < abs(row.c + 39.1) < 1e-3 and 0 < abs(row.d + 15.1) < 1e-3


def test_content_hashes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x")
    row = provenance.content_hashes(spark, str(tmp_path / "in")).first()
    assert (row.sha256, row.md5) == (hashlib.sha256(b"x").hexdigest(), hashlib.md5(b"x").hexdigest())


def test_dictionary():
    text = provenance.data_dictionary({t: schemas.columns(t) for t in schemas.TABLES})
    assert "## `series`" in text and "| `NDMI` |" in text
    assert len(schemas.columns("series")) == 44 and len(schemas.columns("analytical_table")) == 21
    with pytest.raises(ValueError, match="t.new_column"):
        provenance.data_dictionary({"t": ["site", "new_column"]})


def test_catalogue_items(spark):
    feature = {"id": "I", "bbox": [-37, -7, -35, -5], "properties": {"start_datetime": "2022-01-01T00:00:00Z", "end_datetime": "2022-01-16T23:59:59.000Z",
               "bdc:tiles": ["041012", "041013"], "eo:cloud_cover": 12.5}, "assets": {"SCL": {"href": "h", "eo:bands": [{"nodata": 0}]}, "B02": {"href": "b"}}}
    found = items.items_from_json(spark.createDataFrame([(json.dumps(feature),)], "value string"))
    row = found.first()
    assert (row.tile, row.item_cloud_pct, row.west, row.north) == ("041012,041013", 12.5, -37.0, -5.0)
    assert found.select(F.to_date("start"), F.to_date("end")).first()[0:2] == (dt.date(2022, 1, 1), dt.date(2022, 1, 16))
    bands = {r.band: (r.href, r.nodata, r.scale) for r in items.item_bands(found).collect()}
    assert bands == {"SCL": ("h", 0.0, None), "B02": ("b", None, None)}
