"""Files, line protocol, time columns, change streams and alerts."""

import pytest
from pyspark.sql import functions as F

from polymera.session import Engine, Sequences
from polymera.sources import detect, files, lines
from polymera.streaming import alerts, changes, views


@pytest.mark.parametrize("name", ["t.ndjson", "t.csv", "t.parquet"])
def test_copy_round_trip(spark, tmp_path, name):
    df = spark.createDataFrame([(1, "alice", 9.5), (2, "bob, jr", 8.1), (3, None, 7.7)], "id int, name string, score double")
    path = str(tmp_path / name)
    files.copy_to(df, path)
    back = files.copy_from(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_json_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"id": 1},\n {"id": 2}]')
    assert files.copy_from(spark, str(path), "id long").count() == 2
    with pytest.raises(ValueError):
        files.format_of("x.unknown")


def test_line_protocol(spark):
    text = ['cpu,host=a\\ b,dc=x usage=0.5,n=3i,ok=t,s="q \\" z" 1700000000000000000', "# note", "", "bad line"]
    rows = lines.parse_lines(spark.createDataFrame([(t,) for t in text], "value string")).collect()
    assert len(rows) == 2 and rows[1]["bad"] == "bad line"
    assert rows[0]["measurement"] == "cpu" and rows[0]["tags"] == {"host": "a b", "dc": "x"} and rows[0]["ts"] == 1700000000000000000
    parsed = lines.parse_lines(spark.createDataFrame([(text[0],)], "value string"))
    f = F.col("fields")
    got = parsed.select(lines.field_value(f, "usage")["double"], lines.field_value(f, "n")["long"], lines.field_value(f, "ok")["boolean"], lines.field_value(f, "s")["string"]).first()
    assert tuple(got) == (0.5, 3, True, 'q " z')
    assert lines.infer_schema(parsed) == {"usage": "double", "n": "long", "ok": "boolean", "s": "string"}


def test_time_column(spark):
    assert detect.time_column(spark.createDataFrame([(1,)], "a int").withColumn("when_", F.current_timestamp())) == ("when_", "type")
    assert detect.time_column(spark.createDataFrame([(1700000000000, 5.0)], "at long, v double")) == ("at", "ms")
    assert detect.time_column(spark.createDataFrame([("x",)], "a string")) is None


def test_alerts(spark):
    rows = [("g", i, v) for i, v in enumerate([1, 9, 9, 9, 1, 9, 1, 1, 1])]
    w = alerts.breaches(spark.createDataFrame(rows, "k string, bucket int, v int"), "v", ">", 5)
    assert [tuple(r) for r in alerts.alert_events(w, ["k"], "bucket", 2, 2).orderBy("bucket").collect()] == [("g", 2, "fire"), ("g", 7, "recover")]


def test_streamed_view_and_changes(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("o1", "active", 10), ("o2", "active", 20), ("o3", "pending", 5)], "id string, status string, amount int").write.parquet(folder)
    stream = spark.readStream.schema("id string, status string, amount int").parquet(folder)
    view = views.materialized_view(stream, ["status"], {"cnt": ("count", None), "total": ("sum", "amount")})
    q = view.writeStream.outputMode("complete").format("memory").queryName("view_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("view_test").collect())) == [("active", 2, 30.0), ("pending", 1, 5.0)]
    out = str(tmp_path / "table")
    apply = changes.apply_to(out, ["id"], "n")
    apply(spark.createDataFrame([("a", 1, "insert"), ("b", 1, "insert")], "id string, n int, op string"), 0)
    apply(spark.createDataFrame([("a", 2, "update"), ("b", 2, "delete")], "id string, n int, op string"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/1").collect())) == [("a", 2, "update")]
    with pytest.raises(ValueError):
        changes.late_policy(stream, "ts", "maybe")


def test_streamed_alerts(spark, tmp_path):
    folder = str(tmp_path / "w")
    spark.createDataFrame([("g", i, b) for i, b in enumerate([False, True, True, False, False])], "k string, bucket int, breach boolean").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("k string, bucket int, breach boolean").parquet(folder)
    q = alerts.stream_alerts(stream, "k", "bucket", 2, 2).writeStream.outputMode("append").format("memory").queryName("alerts_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("alerts_test").orderBy("bucket").collect()] == [("g", 2, "fire"), ("g", 4, "recover")]


def test_engine(spark):
    engine = Engine(spark)
    engine.register("things", spark.createDataFrame([(1, "é")], "id long, name string"))
    assert tuple(engine.sql("SELECT char_bytes(name), safe_sqrt(-1), bucket_ms(60000, 61000) FROM things WHERE id = :i", i=1).first()) == (2, None, 60000)
    s = Sequences()
    assert list(s.nextval("q", 3)) == [1, 2, 3] and s.currval("q") == 3
    numbered = s.number(spark.range(100).repartition(7), "r")
    assert sorted(r["id"] for r in numbered.select("id").collect()) == list(range(1, 101))
    engine.drop("things")
