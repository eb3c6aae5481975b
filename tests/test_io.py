import gzip
import json
import struct

import pytest

from framewright.functions.exif import metadata
from framewright.sources import readers, writers
from framewright.streaming import logs

LOG = "frame_id string, n int"


def jpeg(text=b"2023:09:16 10:00:05\0", orientation=6):
    """A JPEG's head with EXIF tags, and a frame of 4416 x 2488."""
    at = 8 + 2 + 12 * 2 + 4
    exif = struct.pack("<2sHIH", b"II", 42, 8, 2)
    exif += struct.pack("<HHIHH", 274, 3, 1, orientation, 0) + struct.pack("<HHII", 34665, 4, 1, at) + struct.pack("<I", 0)
    exif += struct.pack("<H", 1) + struct.pack("<HHII", 36867, 2, len(text), at + 2 + 12 + 4) + struct.pack("<I", 0) + text
    app = b"Exif\0\0" + exif
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 2488, 4416, 3)


def test_exif():
    assert metadata(jpeg()) == {"width": 4416, "height": 2488, "orientation": 6, "timestamp": "2023:09:16 10:00:05", "metadata_error": None}
    for broken in (b"", b"\xff\xd8", jpeg()[:40], b"II*\0\xff\xff\xff\xff", b"text"):
        got = metadata(broken)
        assert got["metadata_error"] and got["timestamp"] is None


def test_images(spark, tmp_path):
    (tmp_path / "A/deep").mkdir(parents=True)
    (tmp_path / "A/1.JPG").write_bytes(jpeg())
    (tmp_path / "A/deep/2.jpeg").write_bytes(b"broken")
    (tmp_path / "A/._1.JPG").write_bytes(b"side")
    (tmp_path / "A/notes.txt").write_text("x")
    (tmp_path / "A/jpg").write_text("x")
    got = {r.relative_path: r.size_bytes for r in readers.list_images(spark, str(tmp_path)).collect()}
    assert got == {"A/1.JPG": len(jpeg()), "A/deep/2.jpeg": 6}
    rows = {r.path.rsplit("/", 1)[-1]: r for r in readers.image_metadata(spark, str(tmp_path)).collect()}
    assert str(rows["1.JPG"].timestamp) == "2023-09-16 10:00:05" and rows["1.JPG"].width == 4416
    assert rows["2.jpeg"].metadata_error and rows["2.jpeg"].timestamp is None


def test_tables(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿a,b\n1,\n2,x\n", encoding="utf-8")
    with gzip.open(tmp_path / "t.csv.gz", "wt", encoding="utf-8") as f:
        f.write(path.read_text(encoding="utf-8"))
    for p in (path, tmp_path / "t.csv.gz"):
        assert [tuple(r) for r in readers.csv_table(spark, str(p), "a int, b string").collect()] == [(1, None), (2, "x")]
    (tmp_path / "a.json").write_text(json.dumps([{"frame_id": "x", "n": 1}, {"frame_id": "y"}], indent=1))
    assert sorted(readers.json_array(spark, str(tmp_path / "a.json"), LOG).collect()) == [("x", 1), ("y", None)]
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    writers.to_csv(df, str(tmp_path / "out"), gzip=True)
    assert sorted(readers.csv_table(spark, str(tmp_path / "out"), "a int, b string").collect()) == sorted(df.collect())
    writers.to_one_csv(df, str(tmp_path / "r/one.csv"))
    assert (tmp_path / "r/one.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b")
    writers.upsert(spark.createDataFrame([("x", 1, 1), ("y", 1, 1)], "k string, v int, at int"), str(tmp_path / "kv"), "k", "at")
    writers.upsert(spark.createDataFrame([("x", 2, 2)], "k string, v int, at int"), str(tmp_path / "kv"), "k", "at")
    kv = spark.read.parquet(str(tmp_path / "kv"))
    assert {r.k: r.v for r in kv.collect()} == {"x": 2, "y": 1} and readers.lookup(kv, "k", "x").first().v == 2
    got = writers.manifest(spark, str(tmp_path)).collect()
    assert {"t.csv", "a.json", "r/one.csv"} <= {r.path for r in got} and all(len(r.sha256) == 64 for r in got)
    shown = writers.labelled(df, {"a": "number"}, {"b": {"é": "e"}}, ("a",))
    assert shown.columns == ["number", "b"] and sorted(r.number for r in shown.collect()) == ["1", "2"]


def test_record_logs(spark, tmp_path):
    good, torn = '{"frame_id":"a","n":1}\n{"frame_id":"b","n":1}\n{"frame_id":"a","n":2}\n', '{"frame_id":"c","n"'
    (tmp_path / "torn").write_text(good + torn)
    records, tail = readers.record_log(spark, str(tmp_path / "torn"), LOG, "frame_id")
    assert {r.frame_id: r.n for r in records.collect()} == {"a": 2, "b": 1} and [r.value for r in tail.collect()] == [torn]
    (tmp_path / "middle").write_text('{"frame_id":"a","n":1}\n' + torn + "\n" + '{"frame_id":"b","n":1}\n')
    records, tail = readers.record_log(spark, str(tmp_path / "middle"), LOG, "frame_id")
    assert [r.frame_id for r in records.collect()] == ["a"] and tail.count() == 2
    once = '{"frame_id":"a","n":1}\n{"frame_id":"b","n":1}\n'
    (tmp_path / "once").write_text(once + torn)
    known = spark.createDataFrame([("a",), ("b",)], "frame_id string")
    assert readers.strict_log(spark, str(tmp_path / "once"), LOG, "frame_id", known, complete=False).count() == 2
    for name, kwargs in (("once", {}), ("torn", {"complete": False}), ("middle", {"complete": False}), ("once", {"known": known.limit(1), "complete": False})):
        with pytest.raises(ValueError):
            readers.strict_log(spark, str(tmp_path / name), LOG, "frame_id", **kwargs)


def test_stream_resumes_and_errors_count_as_done(spark, tmp_path):
    from pyspark.sql import functions as F

    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", -1)], LOG).write.parquet(str(src))
    work = lambda df: df.select("frame_id", F.when(F.col("n") < 0, "error").otherwise("processed").alias("status"), F.lit(1).alias("seen"))
    first = logs.process_new(spark, str(src), LOG, work, out, f"{out}-c")
    assert sorted((r.frame_id, r.status) for r in first.collect()) == [("a", "processed"), ("b", "error")]
    spark.createDataFrame([("c", 1)], LOG).write.mode("append").parquet(str(src))
    assert sorted(r.frame_id for r in logs.process_new(spark, str(src), LOG, work, out, f"{out}-c").collect()) == ["a", "b", "c"]
    fixed = lambda df: work(df.withColumn("n", F.lit(1)))
    again = logs.process_new(spark, str(src), LOG, fixed, out, f"{out}-c", retry_errors=True)
    assert sorted((r.frame_id, r.status) for r in again.collect()) == [("a", "processed"), ("b", "processed"), ("c", "processed")]


def test_sessions_and_progress(spark, tmp_path):
    from framewright.streaming.progress import Progress

    rows = [("A", f"2024-01-01 00:00:{s:02d}") for s in (0, 5, 14, 40)] + [("B", "2024-01-01 00:00:01"), ("A", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "k string, s string").selectExpr("k", "cast(s as timestamp) ts").write.parquet(str(tmp_path / "in"))
    said = []
    listener = Progress(2, said.append)
    spark.streams.addListener(listener)
    stream = logs.gap_sessions(logs.file_stream(spark, str(tmp_path / "in"), "k string, ts timestamp"), "k", "ts", "15 seconds", "1 minute")
    logs.replay(stream, "append", str(tmp_path / "out"), str(tmp_path / "c"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    got = sorted((r.k, str(r.start)[11:], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("A", "00:00:00", 3), ("A", "00:00:40", 1), ("B", "00:00:01", 1)]
    assert listener.rows == 6


def test_index_replaces_touched_buckets_only(spark, tmp_path):
    import os

    path = str(tmp_path / "kv")
    rows = lambda lo, hi, at: spark.range(lo, hi).selectExpr("concat('k', id) k", f"id * {at} v", f"{at} at")
    writers.upsert(rows(0, 1000, 1), path, "k", "at")
    of = lambda: {f"{d}/{f}" for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}
    first = of()
    writers.upsert(rows(3, 5, 7), path, "k", "at")
    writers.upsert(rows(4, 5, 2), path, "k", "at")  # older than what is there
    kv = {r.k: (r.v, r["at"]) for r in spark.read.parquet(path).collect()}
    assert len(kv) == 1000 and kv["k3"] == (21, 7) and kv["k4"] == (28, 7) and kv["k5"] == (5, 1)
    assert len(first) - 2 <= len(first & of()) < len(first)
    found = readers.index_lookup(spark, path, "k", "k4")
    assert [tuple(r) for r in found.select("k", "v").collect()] == [("k4", 28)]
    assert len(found.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(bucket__" in found._jdf.queryExecution().toString()


def test_torn_logs_are_cut_at_the_first_broken_byte(spark, tmp_path):
    log, schema = tmp_path / "log", "frame_id string, n int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).coalesce(1).write.json(str(log))
    whole = '{"frame_id":"é","n":3}\n\n{"frame_id":"d","n":4}\n'
    (log / "part-torn.json").write_text(whole + '{"frame_id":"e","n', encoding="utf-8")
    (log / "part-middle.json").write_text('{"frame_id":"f","n":6}\nx\n{"frame_id":"g","n":7}\n', encoding="utf-8")
    cuts = readers.recover_log(spark, str(log), schema, str(tmp_path / "aside"))
    assert sorted((r.file.rsplit("/", 1)[1], r.offset, r.bytes) for r in cuts) == [("part-middle.json", 23, 25), ("part-torn.json", len(whole.encode()), 18)]
    assert (log / "part-torn.json").read_text(encoding="utf-8") == whole and (tmp_path / "aside/part-torn.json.tail").read_text() == '{"frame_id":"e","n'
    assert {r.frame_id: r.n for r in readers.strict_log(spark, str(log), schema, "frame_id").collect()} == {"a": 1, "b": 2, "é": 3, "d": 4, "f": 6}
    assert readers.recover_log(spark, str(log), schema, str(tmp_path / "aside")) == []


def test_workbook_of_many_sheets(spark, tmp_path):
    from framewright.sources import workbook

    path = str(tmp_path / "book.xlsx")
    odd = spark.createDataFrame([(1, "a <&> \" ]]>", 1.5, True, 2**60), (2, None, None, None, None), (3, " x\r\ny\x01 ", -1e-9, False, 5), (4, "", float("nan"), True, -1)], "k int, `t x` string, d double, b boolean, l long")
    sheets = {f"sheet {i}": (spark.range(i * 50).selectExpr("id", "cast(id * 0.1 as double) v"), ["id"]) for i in range(19)} | {"odd": (odd, ["k"])}
    workbook.write_workbook(spark, sheets, path)
    assert workbook.sheet_names(path) == list(sheets)
    cells = workbook.read_sheets(spark, path).cache()
    for name in ("sheet 0", "sheet 3", "sheet 18"):
        assert workbook.unequal(cells, name, sheets[name][0]).count() == 0
    back = {r.k: r for r in workbook.sheet_table(cells, "odd", odd).collect()}
    assert [tuple(back[k])[1:] for k in (1, 2)] == [("a <&> \" ]]>", 1.5, True, 2**60), (None, None, None, None)]
    assert (back[3]["t x"], back[3].d, back[4]["t x"]) == (" x\r\ny ", -1e-9, "")
    assert workbook.unequal(cells, "sheet 3", spark.range(150).selectExpr("id", "if(id = 7, null, id * 0.1) v")).count() == 2
    with pytest.raises(ValueError):
        workbook.write_workbook(spark, {"a": sheets["odd"], "A": sheets["odd"]}, path)


def test_figures_hold_what_they_draw(spark, tmp_path):
    from framewright.sources import figures

    rows = [("A & B", 1, i / 1000, (i + 1) / 1000, float(i % 7), float(i == 2500), 0.25, 0.75) for i in range(5000)]
    rows += [("C", 1 + (i >= 3), float(i), i + 1.0, 4.0, None if i == 5 else 1.0, None if i == 4 else 0.4, None if i == 4 else 0.6) for i in range(8)]
    bins = spark.createDataFrame(rows, "grp string, segment long, start_hour double, end_hour double, left_mean double, right_mean double, left_share double, right_share double")
    groups = spark.createDataFrame([("A & B",), ("C",), ("none",)], "grp string")
    labels = spark.createDataFrame([("C", 3.0, True), ("C", 3.0001, False), ("C", 6.0, True)], "grp string, hour double, labelled boolean")
    drawn = figures.curves(bins, groups, "note", "effective", labels).unionByName(figures.curves(bins, groups, "note", "actual")).unionByName(figures.heatmap(bins, groups, "note"))
    figures.write_figures(drawn, str(tmp_path / "figures"))
    assert len(list((tmp_path / "figures").glob("*.svg"))) == 9
    found = figures.read_figures(spark, str(tmp_path / "figures"))
    got = {(r.figure, r.grp): r for r in figures.inspected(found).collect()}
    assert figures.problems(figures.inspected(found)).count() == 0
    dense = got["curve_effective", "A & B"]
    assert dense.left_paths == 1 and 960 < dense.left_points <= 4 * 960 and dense.note == "note"  # of 5000 bins
    c = got["curve_effective", "C"]
    assert (c.left_points, c.right_points, c.ticks, c.words) == (8, 7, 2, 2) and got["curve_actual", "C"].left_paths == 2
    assert got["curve_effective", "none"].empty == 1 and (got["heatmap", "C"].cells, got["heatmap", "C"].shares) == (16, 14)
    d = next(p["_d"] for r in found.where("figure = 'curve_effective' and grp = 'C'").collect() for p in r.path if p["_class"] == "right")
    points = [tuple(map(float, x.split())) for x in d.removeprefix("M ").split(" L ")]
    want = [(60 + (i + 0.5) / 8 * 960, 290 - 1 / 5 * 240) for i in range(8) if i != 5]
    assert all(abs(a - x) < 0.006 and abs(b - y) < 0.006 for (a, b), (x, y) in zip(points, want, strict=True))
    spike = next(p["_d"] for r in found.where("figure = 'curve_effective' and grp = 'A & B'").collect() for p in r.path if p["_class"] == "right")
    assert spike.count(" 255.22") == 1  # one bin of 5000 stands out, and is drawn: the scale ends at 1.15 times 6
