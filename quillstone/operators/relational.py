"""Tenancy, latest states, deletions and conversations as plain relational plans.

Every read of owned rows takes the owner first; a blank owner is an error, and a foreign id gives no rows.
No ids, or an empty list of them, stand for all that one owns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: Turns of history that a prompt takes.
HISTORY = 8


def owned(df: DataFrame, user_id: str, ids: Sequence[object] | DataFrame | None = None, id_column: str = "document_id", owner_column: str = "user_id") -> DataFrame:
    """Rows of the owner, of the ids asked for if there are any; without any, all of them."""
    if not user_id or not str(user_id).strip():
        raise ValueError("an owner is required")
    mine = df.where(F.col(owner_column) == F.lit(user_id))
    if isinstance(ids, DataFrame):
        return mine if ids.isEmpty() else mine.join(ids.select(id_column).distinct(), id_column, "left_semi")
    return mine.where(F.col(id_column).isin(list(ids))) if ids else mine


def orphans(points: DataFrame, registry: DataFrame, id_column: str = "document_id", owner_column: str | None = "user_id") -> DataFrame:
    """Points whose document isn't registered, or that have no owner."""
    lost = points.join(registry.select(id_column).distinct(), id_column, "left_anti")
    if owner_column is None:
        return lost
    return points.where(F.coalesce(F.col(owner_column), F.lit("")) == "").unionByName(lost.where(F.coalesce(F.col(owner_column), F.lit("")) != ""))


def without(df: DataFrame, doomed: Column) -> DataFrame:
    """What a deletion leaves; a predicate that is null keeps the row."""
    return df.where(~F.coalesce(doomed, F.lit(False)))


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last writer's row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def valid_sessions(sessions: DataFrame, now: float) -> DataFrame:
    return sessions.where((F.col("revoked") == 0) & (F.col("expires_at") > F.lit(now)))


def clean_turns(turns: DataFrame) -> DataFrame:
    """Turns of user and assistant that aren't blank, without what users said last: the prompt adds it itself."""
    said = turns.where(F.col("role").isin("user", "assistant") & ~T.is_blank(F.col("text"))).withColumn("text", T.strip(F.col("text")))
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return said.withColumn("_last", last).where("turn <= _last").drop("_last")


def recent(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def chat_list(turns: DataFrame) -> DataFrame:
    """conv_id, title from the first user turn, number of turns, last turn; partial sums before the exchange."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    own = turns.groupBy("conv_id").agg(first.alias("first"), F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"))
    return own.select("conv_id", T.title(F.col("first")).alias("title"), "n_turns", "last_turn")


def scope_json(ids: Column) -> Column:
    """Sorted distinct ids as JSON text; null without any."""
    own = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))
    return F.when(F.size(own) > 0, F.to_json(own))


def scope_from_json(text: Column) -> Column:
    """The ids of such a text: what isn't text in it is dropped; null if it is no list."""
    items = F.from_json(text, "array<variant>")
    return F.when(items.isNotNull(), F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")))


def title_fill(title: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), new)


def model_status(chain: DataFrame, cooldowns: DataFrame, served: DataFrame, now: float) -> DataFrame:
    """model, priority, state, remaining seconds, served, of a small chain of models."""
    waiting = F.coalesce(F.col("until") > F.lit(now), F.lit(False))
    rows = chain.join(cooldowns, "model", "left").join(served, "model", "left")
    return rows.select("model", "priority", F.when(waiting & F.col("credit"), "exhausted").when(waiting, "cooldown").otherwise("ready").alias("state"), F.when(waiting, F.greatest(F.lit(0), F.floor(F.col("until") - F.lit(now)))).otherwise(F.lit(0)).cast("int").alias("remaining"), F.coalesce("served", F.lit(0)).cast("long").alias("served"))


def model_chain(chain: DataFrame, cooldowns: DataFrame, served: DataFrame, now: float) -> DataFrame:
    """model_status with the label, whether a model can be asked, and of one that can't the reason and the whole time of its cooldown.

    chain: model, label, priority; cooldowns: model, until, credit, reason, total.
    """
    rows = model_status(chain.select("model", "priority"), cooldowns, served, now).join(chain.select("model", "label"), "model").join(cooldowns.select("model", "reason", "total"), "model", "left")
    ready = F.col("state") == "ready"
    return rows.select("model", "label", "priority", "state", ready.alias("available"), F.when(ready, "").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"), "remaining", F.when(ready, 0).otherwise(F.col("total")).cast("int").alias("cooldown_total"), "served")


def failover(attempts: DataFrame) -> DataFrame:
    """turn_id, model, tried, error of attempts (turn_id, priority, model, at, status, n_tokens): the first model in the chain that gives anything answers.

    A status other than 200 and an empty stream are failures, after which the next model is tried; what follows a success
    was never asked. A turn without a success has no model and says what was tried. Turns are short arrays.
    """
    good = (F.col("status") == 200) & (F.col("n_tokens") > 0)
    own = attempts.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("priority", "model", good.alias("good")))).alias("own"))
    at = F.array_position(F.transform("own", lambda x: x["good"]), True)
    asked = F.when(at > 0, F.slice("own", F.lit(1), at.cast("int"))).otherwise(F.col("own"))
    tried = F.array_join(F.transform(asked, lambda x: x["model"]), ", ")
    return own.select("turn_id", F.when(at > 0, F.get("own", at.cast("int") - 1)["model"]).alias("model"), tried.alias("tried"), F.when(at == 0, F.concat(F.lit("no model responded; tried: "), tried)).alias("error"))


def ordered(df: DataFrame, *newest: str) -> DataFrame:
    """Lists as they are shown: newest first by each column, nulls last."""
    return df.orderBy(*(F.desc_nulls_last(c) for c in newest))


def transcript(messages: DataFrame) -> DataFrame:
    """Messages of each chat in the order in which they were said, and of arrival where times are equal, with their number from 1."""
    w = Window.partitionBy("chat_id").orderBy("created_at", "seq")
    return messages.withColumn("nth", F.row_number().over(w)).orderBy("chat_id", "nth")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: Column, name: str = "items") -> DataFrame:
    """parents with their children as an ordered array, an empty one where there are none."""
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("_at"), *(F.col(c) for c in children.columns if c != key)))).alias(name))
    rows = F.transform(F.coalesce(name, F.array()), lambda x: F.struct(*(x[c].alias(c) for c in children.columns if c != key)))
    return parents.join(own, key, "left").withColumn(name, F.when(F.col(name).isNull(), F.array()).otherwise(rows))


def cascade(parents: DataFrame, children: DataFrame, key: str, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """What a deletion of parents leaves of them and of their children."""
    gone = parents.where(F.coalesce(doomed, F.lit(False))).select(key).distinct()
    return without(parents, doomed), children.join(gone, key, "left_anti")


def erase_owner(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """What is left of each table when all rows of one owner are erased; rows without an owner stay."""
    if not user_id.strip():
        raise ValueError("an owner is required")
    return {name: without(df, F.col("user_id") == user_id) for name, df in tables.items()}


def latest_state(updates: DataFrame, key: str, at: str = "at") -> DataFrame:
    """A table's present rows from its inserts and updates: of each column the last value that was set, null being no change.

    Revoking a session, renaming a chat, setting its scope, touching it and finishing a run are each an appended row.
    """
    columns = [c for c in updates.columns if c not in (key, at)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns]
    return updates.groupBy(key).agg(*last, F.max(at).alias(at))


def runs_of(runs: DataFrame, user_id: str, sweep_id: str | None = None) -> DataFrame:
    """One's runs, of a sweep if one is named, the newest first."""
    mine = owned(runs, user_id)
    return ordered(mine.where(F.col("sweep_id") == sweep_id) if sweep_id else mine, "created_at")


def public_chat(chats: DataFrame) -> DataFrame:
    return chats.select("chat_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("New chat")).alias("title"), scope_from_json(F.col("scope")).alias("document_ids"), "created_at", "updated_at")


def public_message(messages: DataFrame) -> DataFrame:
    """Messages without their owner; sources, stored as JSON, are an empty list where there are none."""
    return messages.select("message_id", "chat_id", "role", "content", F.coalesce(F.nullif(F.col("sources"), F.lit("")), F.lit("[]")).alias("sources"), "created_at")


def listed_documents(documents: DataFrame) -> DataFrame:
    """Documents with their id by its other name, the latest upload first."""
    return ordered(documents.withColumn("doc_id", F.col("document_id")), "upload_time")


def source_panel(hits: DataFrame) -> DataFrame:
    """What is shown of each hit beside an answer: nine fields, by question and rank."""
    return hits.select("qid", "rank", "filename", "page_start", "page_end", "section", "matched_by", "fused_score", "dense_score", "bm25_score", "text")


#: The longest question.
QUERY_LENGTH = 8000


def query_valid(query: Column, temperature: Column | None = None) -> Column:
    """Whether a question can be asked: not blank, not too long, with a temperature from 0 to 1 if any."""
    ok = ~T.is_blank(query) & (F.length(query) <= QUERY_LENGTH)
    return ok if temperature is None else ok & F.coalesce(temperature.between(0, 1), F.lit(True))


def prompt(passages: DataFrame, template: str) -> DataFrame:
    """qid, context: numbered passages of each question with their place, and in a chat their section, in the order of rank."""
    if template == "chat":
        section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit(" — "), F.col("section"))).otherwise("")
        where = F.concat(T.location(F.col("page_start"), F.col("page_end")), section)
    else:
        where = F.concat(F.lit("p."), F.col("page_start"), F.lit("-"), F.col("page_end"))
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("filename"), F.lit(" "), where, F.lit("\n"), F.col("text"))
    own = passages.select("qid", F.struct("rank", block.alias("block")).alias("b")).groupBy("qid").agg(F.array_sort(F.collect_list("b")).alias("own"))
    return own.select("qid", F.array_join(F.transform("own", lambda x: x["block"]), "\n\n---\n\n").alias("context"))


# Fixed texts: what stands around the passages of a prompt.
NO_PASSAGES = "(no passages retrieved)"
CITE = "Remember to cite sources as [filename p.X]."
EVAL_SYSTEM = "Answer strictly using the SOURCE PASSAGES below. Cite passages as [filename p.X]. If the passages do not contain the answer, say so plainly rather than inventing one."


def eval_messages(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, system, user of every question (qid, question) with its context, empty if it has none."""
    rows = questions.join(contexts, "qid", "left")
    user = F.concat(F.lit("SOURCE PASSAGES:\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\n-----\n\nQUESTION:\n"), "question")
    return rows.select("qid", F.lit(EVAL_SYSTEM).alias("system"), user.alias("user"))


def chat_messages(contexts: DataFrame, questions: DataFrame, history: DataFrame, modes: dict[str, str]) -> DataFrame:
    """qid, messages array<struct<role,content>> of every question (qid, conv_id, mode, question): the mode's text, the history, the request.

    modes: the text of each mode, the first one for unknown modes. history: turns of conversations (conv_id, turn, role, text).
    """
    first, *others = modes.items()
    system = F.lit(first[1])
    for name, said in others:
        system = F.when(F.col("mode") == name, F.lit(said)).otherwise(system)
    said = recent(clean_turns(history)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    rows = questions.join(contexts, "qid", "left").join(said, "conv_id", "left")
    user = F.concat(F.lit("SOURCE PASSAGES:\n\n"), F.coalesce("context", F.lit(NO_PASSAGES)), F.lit("\n\n-----\n\nREQUEST:\n"), "question", F.lit(f"\n\n{CITE}"))
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    turns = F.transform(F.coalesce("turns", F.array()), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    between = F.when(F.col("turns").isNull(), F.array().cast("array<struct<role:string,content:string>>")).otherwise(turns)
    return rows.select("qid", F.concat(one("system", system), between, one("user", user)).alias("messages"))
