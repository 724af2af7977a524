"""Queries that segment documents, place spans on pages, and follow state over events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking as K
from quillstone.operators import intervals as I
from quillstone.plans.chunk_sql import CHUNKS
from quillstone.plans.tables import table
from quillstone.streaming import stateful as S


def _chunks(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("number"), F.col("text").alias("text"))).alias("pages"))
        return K.chunk(docs, strategy, embedder=K.HASHED)

    return run


def letters() -> object:
    """A model that any engine can compute: how often each letter occurs."""
    return lambda texts: np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], np.float64)


def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each sentence of every document is to the next one by a model, and whether a semantic group ends there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit(1).alias("number"), F.col("text").alias("text"))).alias("pages"))
    return K.sentence_likeness(docs, ("letter-counts", letters)).select("doc_id", "at", T.rounded(F.col("likeness"), 6).alias("likeness"), "ends")


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of a conversation as its pages with their offsets, and stretches of 500 characters over them."""
    turns = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    pages = turns.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))).withColumn("stop", F.col("start") + F.length("text")).select("conv_id", "turn", "role", "start", "stop")
    total = pages.groupBy("conv_id").agg(F.max("stop").alias("total"))
    spans = total.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(500).cast("long"))).alias("span"))
    return pages, spans


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last turn that each stretch touches: an interval join within a conversation, without all of its pairs."""
    pages, spans = _places(spark, sf_dir)
    stretches = spans.select("conv_id", "span", F.col("span").alias("start"), (F.col("span") + 500).alias("stop"))
    touching = I.overlap_join(stretches, pages.select("conv_id", "turn", F.col("start").alias("from_"), F.col("stop").alias("to_")), ["conv_id"])
    return touching.groupBy("conv_id", "span").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))


def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest user turn that begins at or before each stretch: an as-of join as a window over both sides."""
    pages, spans = _places(spark, sf_dir)
    both = pages.where("role = 'user'").select("conv_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.col("turn").alias("user_turn")).unionByName(spans.select("conv_id", F.col("span").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("user_turn")))
    w = Window.partitionBy("conv_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("user_turn", F.last("user_turn", ignorenulls=True).over(w)).where("side = 1").select("conv_id", F.col("at").alias("span"), "user_turn")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts to log in, their days pressed into seconds; a purchase is a success."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), (F.col("user_id") % 20).alias("user_id"), at.alias("at"), (F.col("event_type") == "purchase").alias("success"))


def login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.throttle_table(_attempts(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if("allowed").alias("allowed"))


def cooldown_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event type, taken for a model, is ready on 2024-01-20."""
    kind = F.when(F.col("value") > 30, "credit").when(F.col("value") > 10, "rate").otherwise("error")
    errors = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return S.availability(errors, 1705708800.0)


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {
    "chunk_fixed": _chunks("fixed"),
    "chunk_sentence": _chunks("sentence"),
    "chunk_recursive": _chunks("recursive"),
    "chunk_semantic": _chunks("semantic"),
    "semantic_breaks": semantic_breaks,
    "page_range": page_range,
    "heading_asof": heading_asof,
    "login_throttle": login_throttle,
    "cooldown_state": cooldown_state,
    "event_counts": event_counts,
}

_PLACES = """pg AS (SELECT conv_id, turn, role, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(text) AS n FROM conversations),
        sp AS (SELECT conv_id, unnest(range(0, CAST(max(s + n) AS BIGINT), 500)) AS span FROM pg GROUP BY conv_id)"""
# Sentences without a look-behind: what ends one is marked, then cut.
_SENTENCES = r"""list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+([A-Z0-9"(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))"""
ORACLE_SQL = CHUNKS | {
    "semantic_breaks": f"""WITH s AS (SELECT doc_id, unnest(range(len(p))) AS k, unnest(p) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS p FROM documents) WHERE len(p) > 1),
        v AS (SELECT doc_id, k, list_transform(range(26), lambda i: CAST(len(sentence) - len(replace(sentence, chr(CAST(97 + i AS INT)), '')) AS DOUBLE)) AS v FROM s),
        w AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM v),
        c AS (SELECT doc_id, k, coalesce(list_inner_product(v, n) / nullif(sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(n, n)), 0), 0) AS likeness FROM w WHERE n IS NOT NULL)
        SELECT doc_id, CAST(k AS INT) AS at, CAST(round(CAST(likeness AS DECIMAL(20,10)), 6) AS DOUBLE) AS likeness, likeness < quantile_cont(likeness, 0.25) OVER (PARTITION BY doc_id) AS ends FROM c""",
    # One attempt of every user a step: what was let through in the last minute, in the order of time.
    "login_throttle": """WITH RECURSIVE a AS (SELECT event_id, user_id % 20 AS user_id, epoch_us(ts) / 1e6 / 3600 AS secs, event_type = 'purchase' AS success FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY secs, success, event_id) AS k FROM a),
        r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS recent, false AS allowed FROM a
              UNION ALL SELECT user_id, k, CASE WHEN len(kept) >= 8 THEN kept WHEN success THEN CAST([] AS DOUBLE[]) ELSE list_append(kept, secs) END, len(kept) < 8
              FROM (SELECT n.user_id, n.k, n.success, n.secs, list_filter(r.recent, lambda t: n.secs - t < 60) AS kept FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1))
        SELECT user_id, count(*) AS attempts, count(*) FILTER (allowed) AS allowed FROM r WHERE k > 0 GROUP BY user_id""",
    "page_range": f"WITH {_PLACES} SELECT conv_id, span, min(turn) AS first, max(turn) AS last FROM sp JOIN pg USING (conv_id) WHERE s + n > span AND s < span + 500 GROUP BY conv_id, span",
    "heading_asof": f"WITH {_PLACES} SELECT conv_id, span, (SELECT max(turn) FROM pg WHERE pg.conv_id = sp.conv_id AND role = 'user' AND s <= span) AS user_turn FROM sp",
    "cooldown_state": """WITH e AS (SELECT event_type AS model, value, epoch_us(ts) / 1e6 AS secs FROM events WHERE epoch_us(ts) / 1e6 <= 1705708800.0)
        SELECT model, max_by(secs + CASE WHEN value > 30 THEN 3600 WHEN value > 10 THEN 45 ELSE 30 END, secs) <= 1705708800.0 AS ready FROM e GROUP BY model""",
    "event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY day, event_type",
}
