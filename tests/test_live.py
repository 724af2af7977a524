"""Streams with state against the same of a table, with rows shuffled over batches."""

import random
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstone.operators import relational as R
from quillstone.streaming import live as L
from quillstone.streaming.progress import JobProgress


def streamed(spark, tmp_path, batches, schema, apply, name):
    """What a query gives of batches, a file each, in their order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        (file,) = (tmp_path / f"in{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{k:03d}.parquet"
        file.rename(target)
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = apply(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name)


def in_batches(rng, rows, n):
    """Rows shuffled over batches of a few minutes each, so that none is later than the watermark."""
    rows = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 50))
    size = -(-len(rows) // n)
    out = [rows[k : k + size] for k in range(0, len(rows), size)]
    for part in out:
        rng.shuffle(part)
    return out


def test_sessions_expire_and_are_revoked(spark, tmp_path):
    rng = random.Random(1)
    base = 1.7e9
    opened = {k: (base + rng.uniform(0, 1000), k % 7, rng.choice([60.0, 200.0, 900.0])) for k in range(60)}
    revoked = {k: opened[k][0] + rng.uniform(1, 400) for k in range(0, 60, 3)}
    rows = [(at, k, user, "open", at + ttl) for k, (at, user, ttl) in opened.items()] + [(at, k, opened[k][1], "revoke", None) for k, at in revoked.items()]
    rows += [(base + 5000, 999, 1, "open", base + 1e6)]  # moves the watermark past all others
    table = [[(k, u, at, kind, e) for at, k, u, kind, e in part] for part in in_batches(rng, rows, 6)]
    schema = "session_id long, user_id long, at double, kind string, expires double"
    as_events = lambda df: df.select("session_id", "user_id", F.timestamp_seconds("at").alias("ts"), "kind", "expires")
    changes = streamed(spark, tmp_path, table, schema, lambda s: L.session_stream(as_events(s)), "sessions_changed")
    for now in (base + 1, base + 300, base + 700, base + 1200, base + 4000):
        then = [(k, u, at + ttl, int(k in revoked and revoked[k] <= now)) for k, (at, u, ttl) in opened.items() if at <= now]
        want = {r.session_id for r in R.valid_sessions(spark.createDataFrame(then, "session_id long, user_id long, expires_at double, revoked int"), now).collect()}
        assert {r.session_id for r in L.valid_at(changes, now).collect()} == want, now
    ends = {r.session_id: r.state for r in changes.where("state <> 'opened'").collect()}
    assert len(ends) == 60 and {ends[k] for k in revoked if revoked[k] < opened[k][0] + opened[k][2]} == {"revoked"}


def test_pieces_come_in_order(spark, tmp_path):
    rng = random.Random(2)
    base, rows = 1.7e9, []
    for a in range(20):
        n = rng.randint(1, 9)
        begin = base + rng.uniform(0, 300)
        for s in range(n):
            if not (a % 5 == 0 and s == 2):  # a piece is lost
                rows.append((begin + s, a, s, f"{a}:{s} ", s == n - 1))
        if a % 3 == 0:
            rows.append((begin, a, 0, f"{a}:0 ", n == 1))  # delivered twice
    rows.append((base + 9000, 999, 0, "x", False))
    table = [[(a, s, t, last, at) for at, a, s, t, last in part] for part in in_batches(rng, rows, 5)]
    schema = "answer_id long, seq long, text string, last boolean, at double"
    timed = lambda df: df.select("answer_id", "seq", "text", "last", F.timestamp_seconds("at").alias("ts"))
    got = streamed(spark, tmp_path, table, schema, lambda s: L.piece_stream(timed(s)), "pieces_joined")
    want = L.joined_pieces(spark.createDataFrame([r for part in table for r in part], schema)).where("answer_id < 999")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(got.select("answer_id", "n_pieces", "answer", "complete")) == as_set(want)
    assert {r.complete for r in got.collect()} == {True, False}


CHAIN = ("first", "second", "third")


def log(rng, n):
    """Events of a router as they would come: what was asked answers or fails a little later."""
    until, served, turns, events, at = {}, {}, {}, [], 1000.0
    for seq in range(n):
        at += rng.uniform(0.1, 9)
        if turns and rng.random() < 0.7:
            turn = rng.choice(list(turns))
            e = Row(turn_id=turn, seq=seq, at=at, kind=rng.choice(["ok", "ok", "credit", "rate", "error"]), model=turns[turn][1][-1])
        else:
            e = Row(turn_id=seq, seq=seq, at=at, kind="open", model=None)
        events.append(e)
        list(L.fold(CHAIN, [e], until, served, turns))
    return events


def test_failover_by_hand():
    e = lambda at, turn, kind, model=None: Row(turn_id=turn, seq=0, at=at, kind=kind, model=model)
    events = [e(0, 1, "open"), e(1, 1, "rate", "first"), e(2, 2, "open"), e(3, 1, "ok", "second"), e(4, 2, "credit", "second"), e(5, 2, "error", "third"), e(6, 3, "open"), e(47, 4, "open"), e(48, 4, "ok", "third"), e(49, 4, "ok", "first")]
    until, served, turns = {}, {}, {}
    got = list(L.fold(CHAIN, events, until, served, turns))
    assert [d[2:] for d in got] == [
        ("ask", "first", "first"), ("ask", "second", "first, second"), ("ask", "second", "second"), ("done", "second", "first, second"), ("ask", "third", "second, third"),
        ("unavailable", "third", "second, third"), ("unavailable", "third", ""), ("ask", "first", "first"), ("done", "first", "first"),
    ]
    assert served == {"second": 1, "first": 1} and not turns and until == {"first": 46.0, "second": 3604.0, "third": 35.0}


def test_failover_stream_is_the_fold_of_its_log(spark, tmp_path):
    rng = random.Random(3)
    logs = {f"r{k}": log(rng, 120) for k in range(4)}
    want = {(r, *d) for r, events in logs.items() for d in L.fold(CHAIN, events, {}, {}, {})}
    schema = "router string, turn_id long, seq long, at double, kind string, model string"
    rows = sorted(((r, e.turn_id, e.seq, e.at, e.kind, e.model) for r, events in logs.items() for e in events), key=lambda r: r[3])
    parts = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    for p in parts:
        rng.shuffle(p)
    got = streamed(spark, tmp_path, parts, schema, lambda s: L.failover_stream(s, CHAIN), "failed_over")
    as_set = lambda df: {tuple(r) for r in df.select("router", "turn_id", "at", "decision", "model", "tried").collect()}
    assert as_set(got) == want and {d[3] for d in want} == {"ask", "done", "unavailable"}
    assert as_set(L.failover_table(spark.createDataFrame(rows, schema).repartition(3), CHAIN)) == want


def test_progress_of_a_job(spark, tmp_path):
    parts = [[(k, f"t{k}")] * n for k, n in enumerate((3, 1, 4, 2))]
    progress = JobProgress(spark, str(tmp_path / "progress"), {"job_at_work": 10})
    spark.streams.addListener(progress)
    try:
        streamed(spark, tmp_path, parts, "id int, text string", lambda s: s.select("id"), "job_at_work")
        for _ in range(100):
            if (tmp_path / "progress").exists() and progress.table().where("batch_id = -1").count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    found = [r.percent for r in progress.table().orderBy("at").collect()]
    assert found == [30, 40, 80, 100, 100] and {r.name for r in progress.table().collect()} == {"job_at_work"}
