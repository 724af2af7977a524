"""Processors with several state variables and timers: sessions that expire, answers in pieces, models that fail over.

Each is a fold that has a batch counterpart: what the stream has given out up to its watermark equals what the table gives.
State lies in RocksDB, a key's state goes when it is at its end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.streaming.stateful import ASIDE

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(spark: SparkSession) -> None:
    """Several state variables and timers need the RocksDB store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


# --- sessions ----------------------------------------------------------------------------------


class _Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "user_id long, expires double")
        self.revoked = handle.getValueState("revoked", "at double")

    def _row(self, key, user_id: int, at: float, state: str) -> Row:
        return Row(session_id=key[0], user_id=user_id, at=at, state=state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        opened = self.session.get()
        revoked = self.revoked.get()[0] if self.revoked.exists() else None
        end = revoked
        for r in rows:
            if r.kind == "revoke":
                end = r.at if end is None else min(end, r.at)
            elif opened is None:
                opened = (r.user_id, r.expires)
                self.session.update(opened)
                self.handle.registerTimer(int(1000 * r.expires))
                yield self._row(key, r.user_id, r.at, "opened")
        if end is not None and end != revoked:
            self.revoked.update((end,))
        if opened is not None and end is not None and end < opened[1]:
            yield self._row(key, opened[0], end, "revoked")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        opened = self.session.get()
        revoked = self.revoked.get()[0] if self.revoked.exists() else None
        if opened is not None and (revoked is None or revoked >= opened[1]):  # revoked after its end
            yield self._row(key, opened[0], opened[1], "expired")
        self.session.clear()
        self.revoked.clear()

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """session_id, user_id, at, state of a stream of events (session_id long, user_id long, ts timestamp, kind open or revoke, expires double).

    A session that is opened is valid from then on until it is revoked or expired, whichever is first; the events may come in any order
    within the watermark. A timer ends a session when event time has passed its end, and its state goes.
    """
    _stateful(events.sparkSession)
    rows = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return rows.groupBy("session_id").transformWithState(_Sessions(), "session_id long, user_id long, at double, state string", "Append", "EventTime")


def valid_at(changes: DataFrame, now: float) -> DataFrame:
    """session_id, user_id of the sessions that are valid at a time, from what session_stream has given out."""
    ends = F.min(F.when(F.col("state") != "opened", F.col("at")))
    own = changes.groupBy("session_id", "user_id").agg(F.min(F.when(F.col("state") == "opened", F.col("at"))).alias("begins"), ends.alias("ends"))
    return own.where((F.col("begins") <= now) & F.coalesce(F.col("ends") > now, F.lit(True))).select("session_id", "user_id")


# --- answers in pieces -------------------------------------------------------------------------


class _Pieces(StatefulProcessor):
    def __init__(self, patience: float) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "text string")
        self.begun = handle.getValueState("begun", "next long, last long, deadline long, text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        following, last, deadline, text = self.begun.get() or (0, -1, 0, "")
        latest = 0.0
        for r in rows:
            latest = max(latest, r.at)
            if r.last:
                last = r.seq
            if r.seq >= following:
                self.waiting.updateValue((r.seq,), (r.text,))
        parts = [text]
        while self.waiting.containsKey((following,)):
            parts.append(self.waiting.getValue((following,))[0] or "")
            self.waiting.removeKey((following,))
            following += 1
        if deadline:
            self.handle.deleteTimer(deadline)
        if last >= 0 and following > last:
            self._forget()
            yield Row(answer_id=key[0], n_pieces=following, answer="".join(parts), complete=True)
        else:
            deadline = max(deadline, int(1000 * (latest + self.patience)))
            self.begun.update((following, last, deadline, "".join(parts)))
            self.handle.registerTimer(deadline)

    def _forget(self) -> None:
        self.begun.clear()
        self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        begun = self.begun.get()
        if begun is not None:
            yield Row(answer_id=key[0], n_pieces=begun[0], answer=begun[3], complete=False)
        self._forget()

    def close(self) -> None:
        pass


def piece_stream(pieces: DataFrame, patience: float = 60.0, late: str = "1 minute") -> DataFrame:
    """answer_id, n_pieces, answer, complete of a stream of pieces (answer_id long, seq long from 0, text string, last boolean, ts timestamp).

    Pieces wait in the order of their numbers; an answer is given out once all pieces up to its last one are there. One that has had no
    piece for `patience` seconds of event time is given out as far as it is without a gap.
    """
    _stateful(pieces.sparkSession)
    rows = pieces.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return rows.groupBy("answer_id").transformWithState(_Pieces(patience), "answer_id long, n_pieces long, answer string, complete boolean", "Append", "EventTime")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """The same of a table: each answer up to its first gap."""
    own = pieces.groupBy("answer_id").agg(F.array_sort(F.collect_set(F.struct("seq", "text"))).alias("own"), F.max(F.when(F.col("last"), F.col("seq"))).alias("last"))
    whole = F.filter("own", lambda x, i: x["seq"] == i)
    return own.select("answer_id", F.size(whole).cast("long").alias("n_pieces"), F.array_join(F.transform(whole, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("answer"), F.coalesce(F.size(whole) > F.col("last"), F.lit(False)).alias("complete"))


# --- models that fail over ---------------------------------------------------------------------


def available(chain: Sequence[str], until: dict[str, float], at: float) -> list[str]:
    return [m for m in chain if until.get(m, 0.0) <= at]


def fold(chain: Sequence[str], events: Sequence[Row], until: dict[str, float], served: dict[str, int], turns: dict[int, tuple[list[str], list[str]]]) -> Iterator[tuple]:
    """turn_id, at, decision, model, tried of one router's events in order; what it knows is changed on the way.

    A turn that opens gets the models that aren't set aside at that time, in the chain's order. Its model's success ends it; a failure sets the model
    aside and asks the next of its models. A turn without any is told which model is back soonest.
    """

    def ask(turn: int, at: float, left: list[str], tried: list[str]) -> tuple:
        if left:
            turns[turn] = (left[1:], [*tried, left[0]])
            return turn, at, "ask", left[0], ", ".join([*tried, left[0]])
        turns.pop(turn, None)
        aside = [(until[m], k, m) for k, m in enumerate(chain) if until.get(m, 0.0) > at]
        return turn, at, "unavailable", min(aside)[2] if aside else None, ", ".join(tried)

    for e in events:
        if e.kind == "open":
            yield ask(e.turn_id, e.at, available(chain, until, e.at), [])
        elif e.turn_id in turns and turns[e.turn_id][1][-1] == e.model:
            left, tried = turns[e.turn_id]
            if e.kind == "ok":
                served[e.model] = served.get(e.model, 0) + 1
                turns.pop(e.turn_id)
                yield e.turn_id, e.at, "done", e.model, ", ".join(tried)
            else:
                until[e.model] = e.at + ASIDE.get(e.kind, ASIDE["error"])
                yield ask(e.turn_id, e.at, left, tried)


_DECISIONS = "router string, turn_id long, at double, decision string, model string, tried string"


class _Failover(StatefulProcessor):
    def __init__(self, chain: Sequence[str]) -> None:
        self.chain = list(chain)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getMapState("until", "model string", "until double")
        self.served = handle.getMapState("served", "model string", "n long")
        self.turns = handle.getMapState("turns", "turn_id long", "left array<string>, tried array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(rows, key=lambda r: (r.at, r.seq))
        until = {m: self.until.getValue((m,))[0] for m in self.chain if self.until.containsKey((m,))}
        served = {m: self.served.getValue((m,))[0] for m in self.chain if self.served.containsKey((m,))}
        ids = {e.turn_id for e in events}
        before = {t: tuple(map(list, self.turns.getValue((t,)))) for t in ids if self.turns.containsKey((t,))}
        turns = dict(before)
        for decision in fold(self.chain, events, until, served, turns):
            yield Row(router=key[0], **dict(zip(("turn_id", "at", "decision", "model", "tried"), decision, strict=True)))
        for m, at in until.items():
            self.until.updateValue((m,), (at,))
        for m, n in served.items():
            self.served.updateValue((m,), (n,))
        for t in ids:
            if t in turns:
                self.turns.updateValue((t,), tuple(turns[t]))
            elif t in before:
                self.turns.removeKey((t,))

    def close(self) -> None:
        pass


def failover_stream(events: DataFrame, chain: Sequence[str]) -> DataFrame:
    """router, turn_id, at, decision, model, tried of a stream of events (router string, turn_id long, seq long, at double, kind, model).

    kind: open asks for a model; ok, credit, rate and error are what the model that was asked gave. A router keeps its own
    models' cooldowns, what they have served, and its open turns; routers are independent. Events of a batch are taken in order of time.
    """
    _stateful(events.sparkSession)
    return events.groupBy("router").transformWithState(_Failover(chain), _DECISIONS, "Append", "None")


def failover_table(events: DataFrame, chain: Sequence[str]) -> DataFrame:
    """The same of a table: events sorted by router and time within partitions pass by once."""
    names = list(chain)

    def run(batches):
        import itertools

        import pandas as pd

        rows = (r for data in batches for r in data.itertuples(index=False))
        for router, own in itertools.groupby(rows, key=lambda r: r.router):
            found = [(router, *d) for d in fold(names, own, {}, {}, {})]
            yield pd.DataFrame(found, columns=["router", "turn_id", "at", "decision", "model", "tried"])

    ordered = events.select("router", "turn_id", "seq", "at", "kind", "model").repartition("router").sortWithinPartitions("router", "at", "seq")
    return ordered.mapInPandas(run, _DECISIONS)
