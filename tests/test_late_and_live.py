"""Rules on ordered streams, late data and versioned tables against plain replays."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest

from visitlens.operators import late, sessions
from visitlens.sources import versions
from visitlens.streaming import inorder

T0 = dt.datetime(2024, 5, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, was)


def stream(spark, folder, rows, schema, parts):
    """``rows`` in as many files, each a batch of its own."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def finish(df, out):
    q = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/rows").collect()


def camera(seed, n):
    draw, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += draw.choice([0.5, 0.5, 1, 1, 2, 7, 30])
        rows.append((seed % 3, i, T0 + dt.timedelta(seconds=at), draw.choice([0, 0, 1, 2]), draw.random()))
    return rows


def replay(rows, ring, post, most, silent, mark):
    """Clips of one camera by a plain walk: frames in order, then the silence at the end."""
    out, held, clip = [], [], None
    rows = sorted((r[2], *r[1:2], *r[3:]) for r in rows)
    rows = [((t - T0).total_seconds(), n, best) for t, _, n, best in rows if (t - T0).total_seconds() < mark]

    def close():
        out.append((clip["start"], clip["opens"], clip["end"], clip["frames"], clip["n"], clip["best"]))

    for t, n, best in rows:
        if clip and t > min(clip["last"] + post, clip["start"] + most) + silent:
            close()
            clip = None
        held = [*held, t][-ring:]
        if clip:
            clip["frames"] += 1
            clip["end"] = t
            if t - clip["last"] > post or t - clip["start"] > most:
                close()
                clip = None
        if n:
            clip = clip or {"start": t, "opens": held[0], "end": t, "frames": len(held), "n": 0, "best": 0.0}
            clip["last"] = t
            clip["n"] += n
            clip["best"] = max(clip["best"], best)
    if clip and min(clip["last"] + post, clip["start"] + most) + silent < mark:
        close()
    return out


def test_clip_sessions(spark, rocks, tmp_path):
    rows = [r for seed in range(3) for r in camera(seed, 120)]
    schema = "source int, id long, ts timestamp, detections int, confidence double"
    given = stream(spark, tmp_path / "in", rows, schema, 1)
    found = finish(inorder.clip_sessions(given, ring=5, post_s=4, most_s=20, silent_s=3, late="5 seconds"), tmp_path / "out")
    mark = max((r[2] - T0).total_seconds() for r in rows) - 5
    epoch = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    got = sorted((r.source, round(r.started_s - epoch, 3), round(r.opens_s - epoch, 3), round(r.ended_s - epoch, 3), r.frames, r.detections, r.max_confidence) for r in found)
    want = sorted((s, *c) for s in range(3) for c in replay([r for r in rows if r[0] == s], 5, 4, 20, 3, mark))
    assert got == want and want
    assert {r.reason for r in found} <= {"idle", "full"}


def test_order_of_batches_does_not_matter(spark, rocks, tmp_path):
    """The same rows in one batch and in several, out of order within the patience."""
    rows = sorted(camera(1, 150), key=lambda r: r[2])
    end = (1, 999, rows[-1][2] + dt.timedelta(hours=3), 0, 0.0)
    schema = "source int, id long, ts timestamp, detections int, confidence double"
    mixed = rows[:]
    random.Random(4).shuffle(mixed)
    found = []
    for k, (order, parts) in enumerate((([*rows, end], 1), ([*mixed, end], 2))):
        given = stream(spark, tmp_path / f"in{k}", order, schema, parts)
        found.append(sorted(tuple(r) for r in finish(inorder.clip_sessions(given, ring=5, post_s=4, most_s=20, silent_s=3, late="2 hours"), tmp_path / f"out{k}")))
    assert found[0] == found[1] and len(found[0]) > 5


def test_who_is_here(spark, rocks, tmp_path):
    draw, rows, at = random.Random(3), [], 0
    for i in range(60):
        at += draw.choice([10, 20, 40, 100, 400])
        rows.append((i % 2, i, T0 + dt.timedelta(seconds=at), draw.choice(["fox", "cat", None]), draw.choice([None, "stan"])))
    rows.append((0, 90, T0 + dt.timedelta(seconds=at + 10_000), "cat", None))
    given = stream(spark, tmp_path / "in", rows, "source int, id long, ts timestamp, species string, individual string", 1)
    told = finish(inorder.who_is_here(given, gap_s=300, late="1 hour"), tmp_path / "out")
    mark = at + 10_000 - 3600
    epoch = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    for source in range(2):
        times = sorted((r[2] - T0).total_seconds() for r in rows if r[0] == source and (r[2] - T0).total_seconds() < mark)
        start = max(k for k in range(len(times)) if k == 0 or times[k] - times[k - 1] >= 300)
        seen = Counter(r[3] for r in rows if r[0] == source and times[start] <= (r[2] - T0).total_seconds() <= times[-1] and r[3])
        last = max((r for r in told if r.source == source), key=lambda r: (r.at_s, r.n, not r.active))
        assert (last.n, round(last.started_s - epoch), round(last.ended_s - epoch)) == (len(times) - start, times[start], times[-1])
        assert last.active == (times[-1] + 300 >= mark)
        assert dict(x.split(":") for x in last.species.split(",")) == {k: str(v) for k, v in seen.items()}


def some_rows(n, seed):
    draw = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=draw.randint(0, 6000)), i % 3, round(draw.random(), 3)) for i in range(n)]


def test_late_rows_in_any_order(spark, tmp_path):
    rows = some_rows(150, 1)
    random.Random(1).shuffle(rows)
    schema = "id long, ts timestamp_ntz, source long, confidence double"
    root = str(tmp_path / "store")
    for k in range(3):
        late.arrive(spark.createDataFrame(rows[k::3] + ([rows[0]] if k == 2 else []), schema), root, 1800)
        seen = [r for j in range(k + 1) for r in rows[j::3]]
        want = sessions.visits(spark.createDataFrame(seen, schema), 1800).collect()
        got = versions.read(spark, f"{root}/visits", late.VISITS).drop("day").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), k
    assert versions.read(spark, f"{root}/rows", late.ROWS).count() == 150
    # A batch that comes again, and one of nothing, change nothing.
    before = versions.read(spark, f"{root}/visits", late.VISITS).collect()
    late.arrive(spark.createDataFrame(rows[0::3], schema), root, 1800)
    late.arrive(spark.createDataFrame([(None, None, None, None)], schema), root, 1800)
    assert sorted(versions.read(spark, f"{root}/visits", late.VISITS).collect()) == sorted(before)


def test_a_late_row_joins_two_visits(spark, tmp_path):
    schema, root = "id long, ts timestamp_ntz, source long, confidence double", str(tmp_path)
    two = [(1, T0 - dt.timedelta(minutes=25), 1, 0.5), (2, T0 + dt.timedelta(minutes=25), 1, 0.7), (3, T0 + dt.timedelta(days=3), 1, 0.1)]
    late.arrive(spark.createDataFrame(two, schema), root, 1800)
    assert versions.read(spark, f"{root}/visits", late.VISITS).count() == 3
    held = versions.folders(spark, f"{root}/visits")
    late.arrive(spark.createDataFrame([(4, T0, 1, 0.2)], schema), root, 1800)
    found = sorted((r.n, r.rep_id) for r in versions.read(spark, f"{root}/visits", late.VISITS).collect())
    assert found == [(1, 3), (3, 2)]
    now = versions.folders(spark, f"{root}/visits")
    assert now["2024-05-04"] == held["2024-05-04"] and now["2024-04-30"] != held["2024-04-30"] and "2024-05-01" not in now


def test_versions(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "day string, x long"
    assert versions.read(spark, root, schema).count() == 0
    first = versions.replace(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], schema), root, "day")
    old = versions.read(spark, root, schema)
    versions.replace(spark.createDataFrame([("b", 5), ("c", 6)], schema), root, "day", gone=["a"])
    now = lambda: sorted((r.day or "", r.x) for r in versions.read(spark, root, schema).collect())
    assert now() == [("", 3), ("b", 5), ("c", 6)]
    assert sorted(r.x for r in old.collect()) == [1, 2, 3]
    # A writer that died before its commit has changed nothing; one that is overtaken raises.
    spark.createDataFrame([("z", 9)], schema).write.parquet(f"{root}/data/dead/__part=z")
    assert now() == [("", 3), ("b", 5), ("c", 6)]
    known = versions.versions
    try:
        versions.versions = lambda *a: [first]
        with pytest.raises(RuntimeError, match="there already"):
            versions.replace(spark.createDataFrame([("q", 1)], schema), root, "day", gone=[])
    finally:
        versions.versions = known
    assert now() == [("", 3), ("b", 5), ("c", 6)]
    versions.replace(spark.createDataFrame([], schema), root, "day")
    assert now() == []
