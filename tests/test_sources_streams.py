"""Sources and streams."""

import datetime
import json

from pyspark.sql import functions as F

from quarry.sources import tables
from quarry.streaming import limits


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y"}]))
    (tmp_path / "b.json").write_text(json.dumps({"papers": [{"id": "z", "n": 3}]}))
    assert tables.read_records(spark, str(tmp_path / "a.json"), "id string, n int").count() == 2
    assert tables.read_records(spark, str(tmp_path / "b.json"), "id string, n int", "papers").first().n == 3


def test_keyword_file(spark, tmp_path):
    f = tmp_path / "k.txt"
    f.write_text("* Robotics\nArm\n\n* Computer Vision\nPixel\n* Robotics again\nWheel\n")
    got = sorted(tuple(r) for r in tables.read_keyword_file(spark, str(f)).collect())
    assert got == [("computer_vision", "pixel"), ("robotics", "wheel")]


def test_keyword_store(spark, tmp_path):
    assert tables.read_keyword_store(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"version": "1", "categories": {"a": ["X", "y"]}}))
    store = tables.read_keyword_store(spark, str(tmp_path / "s.json"))
    more, log = tables.add_keywords(store, ["Y", "new", "new "], "b")
    assert sorted(r.keyword for r in more.collect()) == ["new", "x", "y"] and log.count() == 1
    less, gone = tables.remove_keywords(more, ["X"])
    assert less.count() == 2 and gone.count() == 1
    assert {r.category: r["count"] for r in tables.keyword_stats(more).collect()} == {"a": 2, "b": 1}


def test_ids_archives_and_parsed(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b\n# note\n\na\n")
    assert [r.paper_id for r in tables.read_id_file(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["b", "a"]
    d = tmp_path / "src"
    d.mkdir()
    (d / "p1.tex").write_text("\\section{A}")
    (d / "skip.txt").write_text("x")
    assert [r.paper_id for r in tables.read_archives(spark, str(d)).collect()] == ["p1"]
    from quarry.operators import parsing

    parsed = parsing.parse_documents(spark.createDataFrame([("p", "\\title{T}")], "paper_id string, source string"))
    tables.write_parsed(parsed, str(tmp_path / "out"))
    assert tables.read_parsed(spark, str(tmp_path / "out")).first().title == "T"


def test_sliding_log_golden():
    got, log = limits.sliding_log([0, 10, 20, 61, 62, 71], [], 2, 60)
    assert got == [True, True, False, True, False, True]


def test_fixed_window():
    got, _ = limits.fixed_window([0, 1, 2, 60, 61], None, 2, 60)
    assert got == [True, True, False, False, True]


def events(spark):
    t0 = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(ip, t0 + datetime.timedelta(seconds=s)) for ip in ("a", "b") for s in (0, 10, 20, 61, 62, 71)], "ip string, ts timestamp")


def test_rate_limit_batch(spark):
    got = limits.rate_limit_batch(events(spark), 2, 60.0).orderBy("ip", "ts").collect()
    assert [r.accepted for r in got] == [True, True, False, True, False, True] * 2
    assert limits.rate_limit_batch(events(spark).limit(0), 2).count() == 0


def test_rate_limit_stream_agrees(spark, tmp_path):
    e = events(spark).orderBy("ts")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = limits.rate_limit_stream(stream, 2, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("limited").orderBy("ip", "ts").collect()
    assert [r.accepted for r in got] == [True, True, False, True, False, True] * 2


def test_stream_windows_agree_with_batch(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "in"))
    stream = limits.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "30 seconds", late="1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(tuple(r) for r in limits.windowed_counts(e, "30 seconds").collect())
    assert sorted(tuple(r) for r in spark.table("windows").collect()) == want
    assert limits.session_counts(e, "15 seconds", "ip").count() == 4


def test_backfill_resumes(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.range(3).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    for _ in range(2):
        limits.backfill(stream, str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination(60)
    assert sum(seen) == 3
    spark.range(2).write.mode("append").parquet(src)
    limits.backfill(stream, str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination(60)
    assert sum(seen) == 5


def test_bypass(spark):
    t = spark.createDataFrame([("/health",), ("/search",)], "path string")
    assert [r.path for r in limits.limited_paths(t).collect()] == ["/search"]
    assert t.select(F.lit(1)).count() == 2
