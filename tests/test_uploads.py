"""Uploads and arrivals as streams."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestar.operators import catalog as K
from lodestar.streaming import arrivals as A
from lodestar.streaming import uploads as U


def send(spark, path, *events):
    rows = [(i, kind, *more, *[None] * (4 - len(more))) for i, kind, *more in events]
    spark.createDataFrame(rows, U.EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_completion_is_told_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    part = lambda i, n, size, tag="t": (i, "part", None, n, size, tag)
    opened = lambda i, size: (i, "open", size)
    send(spark, src, part(1, 3, 5), part(1, 1, 10), opened(1, 25), part(2, 1, 10), opened(2, 20), part(2, 2, 10, " "), opened(3, 10), part(3, 1, 9), opened(4, 10), part(4, 1, 10), part(4, 2, 1), opened(6, 0))
    stream = spark.readStream.schema(U.EVENTS).parquet(src)
    assert [tuple(r) for r in U.run_uploads(stream, 10, out).collect()] == [(6, "complete", 0)]
    send(spark, src, part(1, 2, 10), part(1, 3, 7), part(1, 1, 10), part(2, 2, 10), part(5, 1, 4))
    got = U.run_uploads(stream, 10, out).collect()
    assert sorted(tuple(r) for r in got) == [(1, "complete", 25), (2, "complete", 20), (6, "complete", 0)]
    send(spark, src, part(1, 2, 10), opened(5, 4))
    got = U.run_uploads(stream, 10, out).collect()
    assert sorted(tuple(r) for r in got) == [(1, "complete", 25), (2, "complete", 20), (5, "complete", 4), (6, "complete", 0)]


def test_stale_finalizer_fires_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    send(spark, src, (1, "open", 10), (1, "finalizing"), (2, "open", 10), (2, "finalizing"), (3, "open", 5))
    stream = spark.readStream.schema(U.EVENTS).parquet(src)
    U.run_uploads(stream, 10, out, stale_seconds=1)
    time.sleep(1.5)
    send(spark, src, (2, "completed"), (3, "open", 5))
    first = U.run_uploads(stream, 10, out, stale_seconds=1)
    assert [tuple(r) for r in first.where("upload_id = 1").collect()] == [(1, "stale", 10)]
    send(spark, src, (3, "open", 5))
    assert U.run_uploads(stream, 10, out, stale_seconds=1).where("upload_id = 1").count() == 1


def test_failed_micro_batch_counts_nothing_twice(spark, tmp_path):
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.range(10).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    double = lambda df: df.withColumn("v", F.col("id") * 2)
    A.register_batches(stream, double, "b", out, failed="id % 5 = 0")
    assert tuple(A.batch_progress(spark, out).first()) == ("b", 1, 8, 2, "completed")
    spark.range(10, 16).coalesce(1).write.mode("append").parquet(src)
    broken = lambda df: df.withColumn("v", F.when(F.col("id") == 15, F.raise_error(F.lit("broken"))).otherwise(F.col("id") * 2).cast("long"))
    with pytest.raises(StreamingQueryException):
        A.register_batches(stream, broken, "b", out, failed="id % 5 = 0")
    assert A.batch_progress(spark, out).first()["state"] == "interrupted" and A.registered(spark, out).count() == 10
    A.register_batches(stream, double, "b", out, failed="id % 5 = 0")
    assert tuple(A.batch_progress(spark, out).first()) == ("b", 2, 12, 4, "completed")
    assert sorted(r["id"] for r in A.registered(spark, out).collect()) == list(range(16))


def test_blank_tags_are_not_acknowledged(spark):
    rows = [(1, 20, 1, "e", 10), (1, 20, 2, " ", 10), (2, 20, 1, "e", 10), (2, 20, 2, "", 10), (3, 10, 1, None, 10)]
    parts = spark.createDataFrame(rows, "upload_id long, size long, part long, etag string, bytes long")
    assert {r["upload_id"]: (r["acknowledged"], r["complete"]) for r in K.upload_status(parts, 10).collect()} == {1: (1, False), 2: (1, False), 3: (0, False)}
    sessions = parts.select("upload_id", "size").distinct()
    assert sorted(tuple(r) for r in K.missing_parts(parts, sessions, 10).collect()) == [(1, 2), (2, 2), (3, 1)]
    assert {r["upload_id"]: r["progress"] for r in K.transfer_progress(parts, ["upload_id"], 10).collect()} == {1: 0.5, 2: 0.5, 3: 0.0}


def test_identity_has_name_size_time_and_occurrence(spark):
    import hashlib
    import json

    parts = spark.createDataFrame([(i, n, h) for i in (1, 2, 3, 4) for n, h in ((2, "bb"), (1, "aa"))], "upload_id long, part long, sha256 string")
    files = spark.createDataFrame([(1, "d/a.dat", 9, 5, None, 0), (2, "d/a.dat", 9, 5, None, 1), (3, 'd/"é.dat', 9, 5, "m", 0), (4, "d/a.dat", 9, 6, None, 0), (5, "e", 0, 5, None, 0)], "upload_id long, path string, size long, modified long, mapped_name string, occurrence long")
    got = {r["upload_id"]: r["identity"] for r in K.chunk_identity(parts, files).collect()}
    want = lambda *v: hashlib.sha256(json.dumps(list(v), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert got == {1: want("d/a.dat", 9, 5, None, 0, ["aa", "bb"]), 2: want("d/a.dat", 9, 5, None, 1, ["aa", "bb"]), 3: want('d/"é.dat', 9, 5, "m", 0, ["aa", "bb"]), 4: want("d/a.dat", 9, 6, None, 0, ["aa", "bb"]), 5: want("e", 0, 5, None, 0, [])}


def test_gate_counts_every_other_state(spark):
    items = spark.createDataFrame([(1,)], "file_id long")
    verdicts = lambda *v: spark.createDataFrame([(1, x) for x in v], "file_id long, verdict string")
    jobs = lambda *s: spark.createDataFrame([(x,) for x in s], "state string")
    ok = lambda v, j: K.corpus_gate(items, v, j).first()["ok"]
    assert ok(verdicts("ok"), jobs("done")) and not ok(verdicts("ok", None), jobs("done"))
    assert not any(ok(verdicts("ok"), jobs("done", s)) for s in ("reader_error", "failed", "running", "new", None))


def test_neighbouring_uploads_share_a_state(spark, tmp_path):
    """Three runs over random parts against a loop; state is kept by groups of ids, so it is read and written seldom."""
    import random

    deal, src, out = random.Random(7), str(tmp_path / "in"), f"file://{tmp_path}/out"
    ids = [*range(-20, 180), 10**12, 10**12 + 1]
    size = {i: deal.randrange(0, 41) for i in ids}
    kept, opened, want = {i: {} for i in ids}, set(), []
    for _ in range(3):
        sent, once = [], set()
        for i in deal.sample(ids, 150):
            for part in range(1, -(-size[i] // 10) + 1):
                if deal.random() < 0.8:
                    sent.append((i, "part", None, part, min(10, size[i] - part * 10 + 10) - (deal.random() < 0.05), deal.choice(["t", "u", "v", " ", None])))
            if deal.random() < 0.7:
                sent.append((i, "open", size[i]))
        deal.shuffle(sent)
        sent = [e for e in sent if (e[0], e[1:2], e[3:4]) not in once and not once.add((e[0], e[1:2], e[3:4]))]
        send(spark, src, *sent)
        for i, kind, *more in sent:
            if kind == "open":
                opened.add(i)
            elif not kept[i].get(more[1], (0, False))[1]:
                kept[i][more[1]] = (more[2], bool((more[3] or "").strip()))
        for i in {e[0] for e in sent} & opened - set(want):
            if sorted(kept[i]) == list(range(1, -(-size[i] // 10) + 1)) and all(ok for _, ok in kept[i].values()) and sum(n for n, _ in kept[i].values()) == size[i]:
                want.append(i)
        got = U.run_uploads(spark.readStream.schema(U.EVENTS).parquet(src), 10, out)
        assert sorted(map(tuple, got.collect())) == sorted((i, "complete", size[i]) for i in want)
    assert 50 < len(want) < len(ids)
    states = spark.read.format("statestore").option("stateVarName", "uploads").load(f"{out}/progress")
    assert states.count() == len({i >> U.GROUP_BITS for i in ids}) == 8


def test_timers_of_uploads_in_a_group(spark, tmp_path):
    """One upload is stale, its neighbours are not: one never finalized, one completed, one began later."""
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    run = lambda s: U.run_uploads(spark.readStream.schema(U.EVENTS).parquet(src), 10, out, stale_seconds=s)
    send(spark, src, *[(i, "open", 10) for i in range(4)], (0, "finalizing"), (1, "finalizing"))
    run(1)
    send(spark, src, (1, "completed"))
    time.sleep(1.5)
    send(spark, src, (3, "finalizing"))
    assert [tuple(r) for r in run(600).collect()] == [(0, "stale", 10)]
    send(spark, src, (2, "open", 10))
    assert run(600).count() == 1
