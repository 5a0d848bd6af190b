"""Sources, sinks and streams on temporary folders."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from visitlens.sources import schema, stores
from visitlens.streaming import live

T0 = dt.datetime(2024, 5, 1)


def test_conform_and_absent_table(spark, tmp_path):
    assert schema.read_table(spark, str(tmp_path), "visits").count() == 0
    stores.append(spark.createDataFrame([(1, "s", "extra")], "id long, source string, other string"), str(tmp_path), "visits")
    found = schema.read_table(spark, str(tmp_path), "visits")
    assert found.columns == schema.schema("visits").names and found.first().species is None


def test_replace_only_touched_partitions(spark, tmp_path):
    stores.replace_partitions(spark.createDataFrame([(1, 10), (2, 20)], "clip_id long, x long"), str(tmp_path), "t", "clip_id")
    stores.replace_partitions(spark.createDataFrame([(1, 11)], "clip_id long, x long"), str(tmp_path), "t", "clip_id")
    assert sorted((r.clip_id, r.x) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 11), (2, 20)]


def test_exports_hide_secrets(spark, tmp_path):
    cameras = spark.createDataFrame([(1, "s", "hunter2")], "id long, source string, password string")
    stores.export_csv({"cameras": cameras}, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/cameras", header=True).columns == ["id", "source"]
    rows = spark.createDataFrame([(i,) for i in range(60)], "id long")
    assert stores.export_ledger(rows.where("id < 5"), f"{tmp_path}/l", rows) == {"added": 0, "removed": 55, "alarm": 1}
    stores.save_report(rows.limit(1), str(tmp_path), "1")
    stores.save_report(rows.where("id = 7"), str(tmp_path), "2")
    assert stores.latest_report(spark, str(tmp_path)).first().id == 7


def test_media_keys_and_vectors(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.jpg").write_bytes(b"x")
    (tmp_path / "m/b.jpg").write_bytes(b"y")
    media = stores.read_media(spark, str(tmp_path / "m"), "*.jpg")
    done = media.where(F.endswith("path", F.lit("a.jpg")))
    assert [r.path[-5:] for r in stores.unseen(media, done).collect()] == ["b.jpg"]
    span = stores.video_span(media.withColumn("duration_s", F.lit(2.5))).first()
    assert (span.ended_at - span.started_at).total_seconds() == 2.5
    blob = spark.createDataFrame([(np.array([1, 2], "<f4").tobytes(),), (None,)], "embedding binary")
    assert [r.embedding for r in stores.decode_vectors(blob).collect()] == [[1.0, 2.0], None]


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append" if name != "places" else "update").start()
    q.processAllAvailable()
    q.stop()


def test_live_visits_close_with_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(T0 + dt.timedelta(minutes=m), "s", 0.5) for m in (0, 3, 20, 200)]
    ddl = "ts timestamp, source string, confidence double"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(folder)
    run(live.live_visits(live.watch(spark, folder, ddl)), "visits")
    assert sorted(r.n for r in spark.table("visits").collect()) == [1, 2]
    run(live.hourly_census(live.watch(spark, folder, ddl).withColumn("empty", F.lit(True))), "census")
    assert [(r.calls, r.empty) for r in spark.table("census").collect()] == [(3, 3)]


def test_recurrences_and_view_changes(spark, tmp_path):
    box = "source string, epoch long, at_s double, x1 double, y1 double, x2 double, y2 double"
    spark.createDataFrame([("s", 1, t, 0.0, 0.0, 10.0, 10.0) for t in (0.0, 100.0, 1000.0, 90000.0)], box).coalesce(1).write.parquet(str(tmp_path / "b"))
    run(live.recurrences(live.watch(spark, str(tmp_path / "b"), box)), "places")
    assert [(r.events, r.days) for r in spark.table("places").collect()] == [(3, 2)]
    mark = "source string, at_s double, day boolean, corr double"
    spark.createDataFrame([("s", 0.0, True, 0.9), ("s", 10.0, True, 0.1), ("s", 200.0, False, 0.9), ("s", 320.0, True, 0.2)], mark).coalesce(1).write.parquet(str(tmp_path / "v"))
    run(live.view_changes(live.watch(spark, str(tmp_path / "v"), mark)), "views")
    assert [(r.epoch, r.at_s) for r in spark.table("views").collect()] == [(1, 320.0)]
