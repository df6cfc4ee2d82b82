"""Time arithmetic, coalescing, documents, streams."""

import json

import pytest
from helpers import as_dict, frame
from pyspark.sql import functions as F

from voxlattice.domain import CALENDAR, HOUR, WHOLE, check_span
from voxlattice.errors import IdError, SourceReadError, UnsupportedFormat
from voxlattice.frame import to_blocks
from voxlattice.functions import timeaxis
from voxlattice.operators import coalesce, sets
from voxlattice.operators.policies import MAX, SUM
from voxlattice.sources import jsonio
from voxlattice.streaming import observations


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("i, u, t", [(3600, 7300, 2), (1800, 1457482000, 809712), (1, 1770000000, 1770000000), (86400, 86399, 0)])
def test_buckets(spark, i, u, t):
    assert one(spark, timeaxis.bucket(F.lit(u), i)) == t


@pytest.mark.parametrize("t0, t1, unit", [(1800 * 809712, 1800 * 809713, 1800), (7200, 14400, 7200), (300 * 4858272, 300 * 4858273, 300), (0, WHOLE, WHOLE)])
def test_coarsest_unit(spark, t0, t1, unit):
    assert one(spark, timeaxis.coarsest_unit(F.lit(t0), F.lit(t1))) == unit == timeaxis.gcd_unit(t0, t1)


def test_spans():
    assert timeaxis.span_difference((0, 86400), (3600, 7200)) == [(0, 3600), (7200, 86400)]
    assert timeaxis.span_intersection((0, 10), (10, 20)) is None
    assert check_span(3600, 2) == (7200, 10800)
    for bad in ((0, 1), (3600, -1), (WHOLE, 1)):
        with pytest.raises(IdError):
            check_span(*bad)


def test_segments(spark):
    for lo, hi in ((3600, 7200), (0, WHOLE), (5, 6), (1, 1000), (WHOLE - 3, WHOLE)):
        cover = timeaxis.segments(lo, hi)
        spans = [(i << (35 - z), (i + 1) << (35 - z)) for z, i in cover]
        assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
        assert [tuple(r) for r in one(spark, timeaxis.dyadic_column(F.lit(lo), F.lit(hi), 35))] == cover
    assert timeaxis.dyadic(-4, 3, 4) == [(2, -1), (3, 0), (4, 2)]
    with pytest.raises(IdError):
        timeaxis.segments(5, 5)


def test_whole_hours_of_a_day_in_blocks(spark):
    f = frame(spark, [(0, 5, 5, 86400, 172800, 1)], z=10, timed=True)
    seconds = to_blocks(f).select(F.sum(F.expr("shiftleft(1L, 35 - tz)"))).first()[0]
    assert seconds == 86400


def test_coalesce(spark):
    f = frame(spark, [(0, 3638, 1614, 0, HOUR, 4), (0, 3638, 1614, HOUR, 2 * HOUR, 4), (0, 1, 1, 0, HOUR, 4), (0, 1, 1, HOUR, 2 * HOUR, 5)], z=12, timed=True)
    assert as_dict(coalesce.coalesce_time(f)) == {(0, 3638, 1614, 0, 7200): 4, (0, 1, 1, 0, 3600): 4, (0, 1, 1, 3600, 7200): 5}
    natural = {(r["x"], r["i"], r["lo"], r["hi"]) for r in coalesce.range_ids(f).collect()}
    assert natural == {(3638, 7200, 0, 0), (1, 3600, 0, 0), (1, 3600, 1, 1)}
    calendar = {(r["x"], r["i"], r["lo"], r["hi"]) for r in coalesce.calendar_ids(f).collect()}
    assert calendar == {(3638, 3600, 0, 1), (1, 3600, 0, 0), (1, 3600, 1, 1)}
    assert coalesce.flat_single_ids(f, CALENDAR).count() == 4


def test_calendar_of_a_half_hour(spark):
    f = frame(spark, [(0, 3638, 1614, 1800 * 809712, 1800 * 809713, 4)], z=12, timed=True)
    r = coalesce.calendar_ids(f).first()
    assert (r["i"], r["lo"], r["hi"]) == (60, 24291360, 24291389)
    r = coalesce.range_ids(f).first()
    assert (r["i"], r["lo"], r["hi"]) == (1800, 809712, 809712)
    r = coalesce.range_ids(frame(spark, [(0, 5, 5, 1)], z=10)).first()
    assert (r["i"], r["lo"], r["hi"]) == (WHOLE, 0, 0)


def test_time_is_cut_at_both_sides_boundaries(spark):
    a = frame(spark, [(0, 0, 0, 0, 100, 1)], timed=True)
    b = frame(spark, [(0, 0, 0, 50, 150, 10), (0, 1, 0, 0, 10, 5)], timed=True)
    assert as_dict(sets.merge(a, b, 0, SUM)) == {(0, 0, 0, 0, 50): 1, (0, 0, 0, 50, 100): 11, (0, 0, 0, 100, 150): 10, (0, 1, 0, 0, 10): 5}
    assert as_dict(sets.difference(a, b)) == {(0, 0, 0, 0, 50): 1}
    whole = frame(spark, [(0, 0, 0, 7)])
    assert as_dict(sets.intersection(whole, a)) == {(0, 0, 0, 0, 100): 7}


def test_document(spark, tmp_path):
    f = frame(spark, [(0, 0, 0, 10), (1, 0, 0, 20), (2, 0, 0, 10)])
    doc = jsonio.parse_document(jsonio.document(f, "risk").first()["document"])
    assert doc["data"][0]["value"] == [10, 20] and [i["ref"] for i in doc["data"][0]["ids"]] == [0, 1, 0]
    assert doc["data"][0]["ids"][0] == {"z": 20, "f": [0], "x": [0], "y": [0], "ref": 0} and doc["data"][0]["name"] == "risk"
    path = str(tmp_path / "doc")
    jsonio.write_document(f, path)
    assert as_dict(jsonio.read_frame(spark, path, 20)) == {(k, 0, 0, 0, WHOLE): v for k, v in enumerate((10, 20, 10))}
    assert jsonio.read_frame(spark, path, 20).without_values().df.count() == 3
    assert "ref" not in json.loads(jsonio.document(f.without_values()).first()["document"])["data"][0]["ids"][0]


def _write(path, data, **extra):
    path.write_text(json.dumps({"$schema": "", "meta": {"version": "1", "description": ""}, "option": {}, "data": data, **extra}))
    return str(path)


def test_document_ranges(spark, tmp_path):
    ids = [{"z": 1, "f": [0], "x": [1, 0], "i": 3600, "t": [2, 3], "ref": 1}]
    p = _write(tmp_path / "a.json", [{"name": "n", "value": [5, 6], "ids": ids}])
    assert tuple(jsonio.read_ranges(spark, p).first()) == (1, 0, 0, 1, 0, 0, 1, 7200, 14400, 6)
    assert len(as_dict(jsonio.read_frame(spark, p, 1))) == 4
    with pytest.raises(SourceReadError):
        jsonio.read_frame(spark, p, 0)


@pytest.mark.parametrize("ids", [[{"z": 1, "ref": 2}], [{"z": 1}], [{"z": 1, "ref": 0, "i": 5}], [{"z": 1, "ref": 0, "t": [5]}]])
def test_malformed_ids(spark, tmp_path, ids):
    p = _write(tmp_path / "a.json", [{"name": "n", "value": [5], "ids": ids}])
    with pytest.raises(Exception, match="ref out of range|come together"):
        jsonio.read_ranges(spark, p).collect()


@pytest.mark.parametrize("ids", [[{"z": 31, "ref": 0}], [{"z": 1, "f": [2], "ref": 0}], [{"z": 1, "x": [0, 2], "ref": 0}], [{"z": 1, "y": [-1], "ref": 0}], [{"z": 1, "y": [], "ref": 0}]])
def test_indices_out_of_range(spark, tmp_path, ids):
    p = _write(tmp_path / "a.json", [{"name": "n", "value": [5], "ids": ids}])
    with pytest.raises(Exception, match="out of range"):
        jsonio.read_ranges(spark, p).collect()


def test_blocks_are_written_as_ranges(spark, tmp_path):
    f = frame(spark, [(a, b, c, 5) for a in (0, 1) for b in (2, 3) for c in (6, 7)] + [(0, 4, 6, 5)], z=4)
    doc = jsonio.parse_document(jsonio.document(f).first()["document"])
    assert [(i["z"], i["f"], i["x"], i["y"]) for i in doc["data"][0]["ids"]] == [(3, [0], [1], [3]), (4, [0], [4], [6])]
    jsonio.write_document(f, str(tmp_path / "d"))
    assert {k[:3]: v for k, v in as_dict(jsonio.read_frame(spark, str(tmp_path / "d"), 4)).items()} == as_dict(f)


def test_malformed_documents(spark, tmp_path):
    for data in ([], [{"name": "a", "value": [], "ids": []}] * 2):
        with pytest.raises(UnsupportedFormat):
            jsonio.read_ranges(spark, _write(tmp_path / "a.json", data))
    (tmp_path / "b.json").write_text("{not json")
    with pytest.raises(Exception):  # noqa: B017
        jsonio.read_ranges(spark, str(tmp_path / "b.json")).collect()


def test_stream_of_observations(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 4), (1, "2024-01-01 00:20:00", 9), (1, "2024-01-01 01:20:00", 2), (2, "2024-01-01 00:30:00", 3)]
    df = spark.createDataFrame(rows, "x int, ts string, value long").select(F.lit(0).alias("f"), "x", F.lit(0).alias("y"), F.to_timestamp("ts").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = observations.windowed_cells(stream, HOUR, MAX, "bigint")
    q = out.writeStream.outputMode("update").foreachBatch(observations.upsert_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["x"], r["t0"]): r["value"] for r in observations.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    t = 1704067200
    assert got == {(1, t): 9, (1, t + HOUR): 2, (2, t): 3}
    batch = {(r["x"], r["t0"]): r["value"] for r in observations.windowed_cells(df, HOUR, MAX, "bigint").collect()}
    assert batch == got


def test_events_become_cells(spark):
    df = spark.createDataFrame([(35.681382, 139.766084, 10.0, "2024-01-01 01:30:00")], "lat double, lon double, alt double, ts string")
    r = observations.to_cells(df.withColumn("ts", F.to_timestamp("ts")), 18, HOUR).first()
    assert (r["f"], r["x"], r["y"], r["t"]) == (0, 232846, 103226, 1704072600 // HOUR)


def test_command_line(spark, tmp_path, monkeypatch):
    from voxlattice import __main__ as cli

    ids = [{"z": 25, "f": [0], "x": [7], "y": [9], "ref": 0}]
    p = _write(tmp_path / "in.json", [{"name": "n", "value": [5], "ids": ids}])
    assert cli.main([p, str(tmp_path / "out")]) == 0 and cli.main([]) == 2
    assert as_dict(jsonio.read_frame(spark, str(tmp_path / "out"), 25)) == {(0, 17, 9, 0, WHOLE): 5}
