"""Queries over documents as a registry, conversations as chats and events as sessions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import experiment as E
from quillstone.operators import relational as R
from quillstone.plans.tables import table
from quillstone.session import shared_dir
from quillstone.sources.chunk_table import ChunkTable
from quillstone.sources.files import acceptable
from quillstone.sources.sinks import export_rows, json_safe

#: 2024-01-20, in seconds: the present of the session queries.
NOW = 1705708800.0
_CHAIN = [("large", 1), ("middle", 2), ("small", 3)]


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), "n_chars")


def owned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return R.owned(_registry(spark, sf_dir), "src3", asked).select("document_id")


def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return R.orphans(_registry(spark, sf_dir), registry).select("document_id", "user_id")


def delete_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by owner after all documents of one are deleted."""
    left = R.without(_registry(spark, sf_dir), F.col("user_id") == "src3")
    return left.groupBy("user_id").agg(F.count("*").alias("documents"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups are sessions of ten days; an error of the user's later on revokes them."""
    events = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    errors = events.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last_error"))
    opened = events.where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), "user_id", "ts", (seconds + 864000).alias("expires_at"))
    return opened.join(errors, "user_id", "left").select("session_id", "user_id", "expires_at", F.coalesce((F.col("last_error") > F.col("ts")).cast("int"), F.lit(0)).alias("revoked"))


def valid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.valid_sessions(_sessions(spark, sf_dir), NOW).select("session_id", "user_id")


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    return found.select("user_id", "event_id", "event_type", "value")


def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chat_list(table(spark, sf_dir, "conversations"))


def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.title(F.col("text")).alias("title"))


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


def sanitized_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clean_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


def scope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each owner's documents as a stored scope."""
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("ids"))
    return own.select("source", R.scope_json(F.col("ids")).alias("scope"))


def title_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", R.title_fill(F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role")), F.col("text")).alias("title"))


def _cooldowns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Errors set a model aside, by their value for a short or a long time; purchases are answers served."""
    chain = spark.createDataFrame(_CHAIN, "model string, priority int")
    names = F.element_at(F.array(*(F.lit(m) for m, _ in _CHAIN)), (F.col("user_id") % 3 + 1).cast("int"))
    events = table(spark, sf_dir, "events").withColumn("model", names).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).where(F.col("at") <= NOW)
    errors = R.latest(events.where("event_type = 'error'"), ["model"], F.desc("at"), F.desc("event_id"))
    cooldowns = errors.select("model", (F.col("at") + F.when(F.col("value") > 20, 3600).otherwise(45)).alias("until"), (F.col("value") > 20).alias("credit"))
    served = events.where("event_type = 'purchase'").groupBy("model").agg(F.count("*").alias("served"))
    return chain, cooldowns, served


def model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.model_status(*_cooldowns(spark, sf_dir), NOW)


def soonest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cooldowns, _ = _cooldowns(spark, sf_dir)
    return cooldowns.agg(F.min_by("model", "until").alias("model"), F.count("*").alias("n"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language, its five longest documents as passages of a prompt."""
    docs = table(spark, sf_dir, "documents")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    top = docs.select("lang", "doc_id", "source", "text", "n_chars", F.row_number().over(w).alias("rank")).where("rank <= 5")
    return top.select(F.col("lang").alias("qid"), "rank", F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")).alias("filename"), (F.col("doc_id") % 4).alias("page_start"), (F.col("doc_id") % 4 + F.col("doc_id") % 2).alias("page_end"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("section"), "text")


def _digest(contexts: DataFrame) -> DataFrame:
    return contexts.select("qid", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages in a prompt's blocks, as a digest."""
    return _digest(R.prompt(_passages(spark, sf_dir), "chat"))


def eval_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the template of evaluations, which doesn't name sections."""
    return _digest(R.prompt(_passages(spark, sf_dir), "eval"))


def email_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written in other ways, as addresses, and how many each key has."""
    names = table(spark, sf_dir, "customer").select(F.explode(F.array(F.concat(F.lit(" "), "c_name"), F.upper("c_name"), F.concat("c_name", F.lit("\t")))).alias("email"))
    return names.groupBy(T.email_key(F.col("email")).alias("email")).agg(F.count("*").alias("n"))


def password_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.password_ok(words).alias("ok"))


def model_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("p_partkey") % 3 == 0, "openrouter:").when(F.col("p_partkey") % 3 == 1, "hf:").otherwise("")
    parts = table(spark, sf_dir, "part").select("p_partkey", T.model_ref(F.concat(prefix, F.col("p_brand"), F.lit(":fast"))).alias("ref"))
    return parts.select("p_partkey", "ref.provider", "ref.model")


def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its apostrophes broken and repaired."""
    broken = F.concat(F.lit("â€œ"), F.col("text"), F.lit("â€\u009d â€“ itâ€™s"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.repair(broken)).alias("repaired"))


def credit_error_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("value") > 30, "Monthly CREDIT spent").when(F.col("value") > 20, "included credits used up").when(F.col("value") > 10, "monthly limit").otherwise("busy")
    status = F.when(F.col("event_id") % 7 == 0, 402).otherwise(429)
    return table(spark, sf_dir, "events").select("event_id", T.is_credit_error(status, said).alias("credit"))


def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.verdict(F.col("text")).alias("verdict"))


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved question sets, a JSON list each, and how many questions they have."""
    sets = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list("role")).alias("questions_json"))
    return sets.select("conv_id", F.json_array_length("questions_json").alias("n_questions"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table of all documents: written twice, a part of it changed, documents of one language unregistered, and what is left.

    Each source is an owner, documents without one belong to nobody, as do those whose id ends in 7.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.lit(0).alias("chunk_index"), F.when(F.col("doc_id") % 10 != 7, F.col("source")).alias("user_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("session_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")
    )
    stored = ChunkTable(spark, f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex[:12]}")
    stored.upsert(docs)
    stored.upsert(docs.where("document_id % 3 = 0"))
    stored.upsert(docs.where("document_id % 5 = 0").withColumn("digest", F.lit("changed")))
    stored.purge_orphans(docs.where("session_id <> 'en'").select("document_id"))
    return stored.whole().select("user_id", "document_id", "session_id", "digest")


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent events of each turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.concat(F.lit("data: "), F.to_json(F.struct(F.col("role").alias("type"), F.col("turn").alias("seq"))), F.lit("\n\n")).alias("frame"))


def stream_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each conversation joined in the order of their number."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("own"))
    return own.select("conv_id", F.md5(F.array_join(F.transform("own", lambda x: x["text"]), "")).alias("answer"))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items of a run, exported: fixed columns in their order, NaN as null, what an export doesn't have left out."""
    lines = table(spark, sf_dir, "lineitem")
    nan = F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(F.lit(float("nan")))
    return export_rows(lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("question"), F.col("l_returnflag").alias("answer"), F.col("l_quantity").alias("recall_at_k"), nan.alias("composite_score"), F.col("l_tax").alias("total_ms"), F.lit("x").alias("model_id")))


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at every depth, with NaN and infinite ones, as JSON."""
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(F.lit(0.5))
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(F.array(value, F.lit(1.5)).alias("a"), F.struct(value.alias("b")).alias("s")).alias("v"))
    return json_safe(rows).select("event_id", F.to_json("v", {"ignoreNullFields": "false"}).alias("json"))


def owned_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty request stands for all that one owns."""
    return R.owned(_registry(spark, sf_dir), "src3", []).select("document_id")


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("upload_time"))
    return R.listed_documents(docs).select("doc_id", "document_id", "upload_time")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as runs with their lines as items."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("user_id"), F.col("o_orderpriority").alias("sweep_id"), F.col("o_orderdate").alias("created_at"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("item"), F.col("l_returnflag").alias("status"))
    return runs, items


def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs_of(_runs(spark, sf_dir)[0], "u7", "1-URGENT").select("run_id", "sweep_id")


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One's runs with their items in order."""
    runs, items = _runs(spark, sf_dir)
    found = R.with_children(R.owned(runs, "u7"), items, "run_id", F.col("item"))
    return found.select("run_id", F.size("items").alias("n_items"), F.array_join(F.transform("items", lambda x: x["status"]), "").alias("statuses"))


def run_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of runs and items, by owner, when one's runs are deleted."""
    runs, items = _runs(spark, sf_dir)
    left, left_items = R.cascade(runs, items, "run_id", F.col("user_id") == "u7")
    per_run = left_items.groupBy("run_id").agg(F.count("*").alias("items"))
    return left.join(per_run, "run_id", "left").groupBy("user_id").agg(F.count("*").alias("runs"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))


def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of users: a purchase sets what was spent, an error the last error; each keeps its last value."""
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("spent"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("error"))
    return R.latest_state(events, "user_id").select("user_id", "spent", "error", F.col("at.event_id").alias("last_event"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in the order of their time, here that of pairs of turns, and of arrival within it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.floor(F.col("turn") / 2).alias("created_at"), (-F.col("turn")).alias("seq"), "role")
    return R.transcript(turns).select("chat_id", "nth", "role")


def public_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats with a title, here a source, and a scope of ids as stored; one in three has none, one in three a broken one."""
    docs = table(spark, sf_dir, "documents")
    scope = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["a'), F.col("doc_id"), F.lit('",7,"b"]'))).when(F.col("doc_id") % 3 == 1, F.lit("{broken"))
    chats = docs.select(F.col("doc_id").alias("chat_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("title"), scope.alias("scope"), F.lit(1).alias("created_at"), F.lit(2).alias("updated_at"))
    return R.public_chat(chats).select("chat_id", "title", F.array_join("document_ids", ",").alias("document_ids"))


def query_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", R.query_valid(F.col("text"), F.col("doc_id") % 7 / 5).alias("ok"))


def failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and an hour as one turn's attempts, the first three of them; errors and small values fail."""
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("day", F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id", "hour").orderBy("event_id")
    tries = events.withColumn("priority", F.row_number().over(w)).where("priority <= 3")
    tries = tries.select(F.struct("user_id", "hour").alias("turn_id"), "priority", F.concat(F.lit("m"), F.col("priority")).alias("model"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), F.floor("value").cast("int").alias("n_tokens"))
    found = R.failover(tries)
    return found.select(F.col("turn_id.user_id").alias("user_id"), F.date_format("turn_id.hour", "yyyy-MM-dd").alias("day"), "model", "tried", F.col("error").isNotNull().alias("failed"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last user turn as a request, with its mode and history; odd ones have found a passage, the others none."""
    turns = table(spark, sf_dir, "conversations")
    asked = R.latest(turns.where("role = 'user'"), ["conv_id"], F.desc("turn")).select(F.col("conv_id").alias("qid"), "conv_id", F.when(F.col("conv_id") % 3 == 0, "sow").otherwise("qa").alias("mode"), F.col("text").alias("question"))
    passages = asked.where("qid % 2 = 1").select("qid", F.lit(1).alias("rank"), F.lit("a.txt").alias("filename"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit("").alias("section"), F.col("question").alias("text"))
    found = R.chat_messages(R.prompt(passages, "chat"), asked, turns, {"qa": "Answer.", "sow": "Draft."})
    return found.select("qid", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")).alias("messages_md5"))


def eval_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    contexts = items.where("qid % 2 = 0").select("qid", F.concat(F.lit("[1] "), "question").alias("context"))
    return R.eval_messages(contexts, items).select("qid", F.md5("user").alias("user_md5"), F.length("system").alias("n_system"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes as uploads: known suffixes in either case, neither empty nor too large."""
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".txt", ".exe", ".md", "text"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    size = F.when(F.col("p_partkey") % 11 == 0, 0).otherwise(F.col("p_size") * 2_000_000)
    return table(spark, sf_dir, "part").select("p_partkey", acceptable(F.concat("p_name", suffix), size).alias("ok"))


def line_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of sections among lines made of each document's source and id."""
    docs = table(spark, sf_dir, "documents")
    lines = F.array(F.concat(F.lit("SECTION "), F.upper("source"), F.lit(" - General")), F.concat(F.lit("3."), F.col("doc_id"), F.lit(" Scope  ")), F.concat(F.lit("3."), F.col("doc_id"), F.lit(" scope")), F.lit("ALL CAPS LINE"), F.lit(""), F.concat("text", F.lit(" ")))
    return docs.select("doc_id", F.posexplode(lines).alias("at", "line")).select("doc_id", "at", T.heading(F.col("line")).alias("heading")).where("heading IS NOT NULL AND at < 5")


def resolved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.when(F.col("p_partkey") % 3 == 0, "auto").otherwise(F.concat(F.lit("m"), F.col("p_partkey") % 4))
    found = T.resolved_model(ref, ("m0", "m1"), {"m0": 900, "m2": 300})
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("r")).select("p_partkey", "r.model", "r.max_tokens")


def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.derived_id("msg_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), T.percent(F.col("turn"), F.max("turn").over(Window.partitionBy("conv_id")), 38, 92).alias("progress"))


def owned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their sum for each customer of a nation, the semi join below the aggregate."""
    own = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    kept = table(spark, sf_dir, "orders").join(own, "o_custkey", "left_semi")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), T.rounded(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).alias("total"))


def model_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain, cooldowns, served = _cooldowns(spark, sf_dir)
    rows = cooldowns.select("*", F.when(F.col("credit"), "allowance spent").otherwise("busy").alias("reason"), F.when(F.col("credit"), 3600.0).otherwise(45.0).alias("total"))
    return R.model_chain(chain.withColumn("label", F.upper("model")), rows, served, NOW)


def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of an upload: the first reads, the last is indexed, what lies between embeds."""
    turns = table(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    stage = F.when(F.col("turn") == 0, "reading").when(F.col("turn") == F.col("last"), "indexed").otherwise("embedding")
    return turns.select("conv_id", "turn", T.upload_percent(stage, F.col("turn"), F.col("last")).alias("percent"))


def erased_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left, by table and owner, when one owner is erased from documents and their chunks, here pages of 1000 characters."""
    docs = _registry(spark, sf_dir)
    chunks = docs.select("document_id", "user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 1000))).alias("chunk"))
    left = R.erase_owner({"documents": docs, "chunks": chunks}, "src3")
    counts = [df.groupBy("user_id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "user_id", "rows") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


def run_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), F.col("n_chars").alias("upload_time"))
    return E.options(docs, "src3").where("kind IN ('document', 'retrieval_mode')")


QUERIES = {f.__name__: f for f in (
    owned_ids, orphan_chunks, delete_survivors, valid_sessions, latest_upsert, chat_list, chat_titles, recent_history, sanitized_history, scope_json, title_fill, model_status, soonest_model, prompt_blocks,
    eval_prompt, email_keys, password_rule, model_refs,
    mojibake_repair, credit_error_flag, judge_verdicts, dataset_counts, stored_chunks, stream_frames, stream_concat, csv_export, owned_totals,
    json_values, owned_all, listed_documents, run_list, run_items, run_cascade, latest_states, transcripts, public_chats, query_validity, failover, chat_messages, eval_messages, uploads, line_headings, resolved_models, derived_ids, model_chain, upload_progress, erased_owner, run_options,
)}

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TITLE = r"""CASE WHEN t = '' THEN 'New chat' WHEN length(t) <= 60 THEN t ELSE CASE WHEN contains(left(t, 60), ' ') THEN CASE WHEN trim(regexp_replace(left(t, 60), ' [^ ]*$', '')) = '' THEN trim(left(t, 60)) ELSE trim(regexp_replace(left(t, 60), ' [^ ]*$', '')) END ELSE trim(left(t, 60)) END || '…' END"""
_FLAT = r"array_to_string(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''), ' ')"
_SESSIONS = """er AS (SELECT user_id, max(ts) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id),
        se AS (SELECT event_id AS session_id, e.user_id, epoch_us(ts) / 1e6 + 864000 AS expires_at, coalesce(last_error > ts, false) AS revoked FROM events e LEFT JOIN er USING (user_id) WHERE event_type = 'signup')"""
_MODELS = f"""ch AS (SELECT * FROM (VALUES ('large', 1), ('middle', 2), ('small', 3)) t(model, priority)),
        ev AS (SELECT *, ['large', 'middle', 'small'][user_id % 3 + 1] AS model, epoch_us(ts) / 1e6 AS secs FROM events WHERE epoch_us(ts) / 1e6 <= {NOW}),
        la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY secs DESC, event_id DESC) AS n FROM ev WHERE event_type = 'error') WHERE n = 1),
        co AS (SELECT model, secs + CASE WHEN value > 20 THEN 3600 ELSE 45 END AS until, value > 20 AS credit FROM la),
        sv AS (SELECT model, count(*) AS served FROM ev WHERE event_type = 'purchase' GROUP BY model)"""

ORACLE_SQL = {
    "owned_ids": "SELECT doc_id AS document_id FROM documents WHERE source = 'src3' AND doc_id IN (SELECT doc_id FROM labels)",
    "orphan_chunks": "SELECT doc_id AS document_id, source AS user_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "delete_survivors": "SELECT source AS user_id, count(*) AS documents FROM documents WHERE source <> 'src3' GROUP BY source",
    "stored_chunks": """SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS document_id, lang AS session_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE md5(coalesce(text, '')) END AS digest
        FROM documents WHERE doc_id % 10 <> 7 AND coalesce(source, '') <> '' AND lang <> 'en'""",
    "valid_sessions": f"WITH {_SESSIONS} SELECT session_id, user_id FROM se WHERE NOT revoked AND expires_at > {NOW}",
    "latest_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "chat_list": f"""WITH c AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS f, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id),
        d AS (SELECT *, {_FLAT.format("coalesce(f, '')")} AS t FROM c) SELECT conv_id, {_TITLE} AS title, n_turns, last_turn FROM d""",
    "chat_titles": f"WITH d AS (SELECT conv_id, turn, {_FLAT.format('text')} AS t FROM conversations) SELECT conv_id, turn, {_TITLE} AS title FROM d",
    "recent_history": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "sanitized_history": f"""WITH s AS (SELECT conv_id, turn, role, trim(text, {_WS}) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, {_WS}) <> ''),
        m AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last_said FROM s) SELECT conv_id, turn, role, text FROM m WHERE turn <= last_said""",
    "scope_json": "SELECT source, CAST(to_json(list_sort(list(DISTINCT lang))) AS VARCHAR) AS scope FROM documents GROUP BY source",
    "title_fill": "SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN '' ELSE role END, ''), text) AS title FROM conversations",
    "model_status": f"""WITH {_MODELS} SELECT model, priority, CASE WHEN coalesce(until > {NOW}, false) THEN CASE WHEN credit THEN 'exhausted' ELSE 'cooldown' END ELSE 'ready' END AS state,
        CAST(CASE WHEN coalesce(until > {NOW}, false) THEN greatest(0, floor(until - {NOW})) ELSE 0 END AS INT) AS remaining, coalesce(served, 0) AS served FROM ch LEFT JOIN co USING (model) LEFT JOIN sv USING (model)""",
    "soonest_model": f"WITH {_MODELS} SELECT min_by(model, until) AS model, count(*) AS n FROM co",
    "prompt_blocks": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5),
        b AS (SELECT lang, rank, '[' || rank || '] doc' || doc_id || '.txt ' || CASE WHEN doc_id % 2 = 0 THEN 'p.' || doc_id % 4 ELSE 'pp.' || doc_id % 4 || '-' || (doc_id % 4 + doc_id % 2) END
              || CASE WHEN doc_id % 3 > 0 THEN ' — ' || source ELSE '' END || chr(10) || text AS block FROM t),
        c AS (SELECT lang AS qid, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY lang)
        SELECT qid, CAST(length(context) AS INT) AS n_chars, md5(context) AS context_md5 FROM c""",
    "eval_prompt": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5),
        b AS (SELECT lang, rank, '[' || rank || '] doc' || doc_id || '.txt p.' || doc_id % 4 || '-' || (doc_id % 4 + doc_id % 2) || chr(10) || text AS block FROM t),
        c AS (SELECT lang AS qid, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY lang)
        SELECT qid, CAST(length(context) AS INT) AS n_chars, md5(context) AS context_md5 FROM c""",
    "email_keys": "SELECT lower(c_name) AS email, 3 * count(*) AS n FROM customer GROUP BY lower(c_name)",
    "password_rule": """WITH w AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS w FROM customer)
        SELECT c_custkey, length(w) >= 10 AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]') AS ok FROM w""",
    "model_refs": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'openrouter' ELSE 'hf' END AS provider, p_brand || ':fast' AS model FROM part",
    "mojibake_repair": "SELECT doc_id, md5('“' || text || '” – it’s') AS repaired FROM documents",
    "credit_error_flag": "SELECT event_id, event_id % 7 = 0 OR value > 20 AS credit FROM events",
    "judge_verdicts": f"SELECT conv_id, turn, CASE upper(left(trim(text, {_WS}), 1)) WHEN 'Y' THEN true WHEN 'N' THEN false END AS verdict FROM conversations",
    "dataset_counts": "SELECT conv_id, CAST(count(*) AS INT) AS n_questions FROM conversations GROUP BY conv_id",
    "stream_frames": "SELECT conv_id, turn, 'data: {\"type\":\"' || role || '\",\"seq\":' || turn || '}' || chr(10) || chr(10) AS frame FROM conversations",
    "stream_concat": "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS answer FROM conversations GROUP BY conv_id",
    "csv_export": """SELECT l_orderkey || '-' || l_linenumber AS question, l_returnflag AS answer, CAST(NULL AS VARCHAR) AS expected_answer, CAST(NULL AS VARCHAR) AS error, l_quantity AS recall_at_k,
        CAST(NULL AS VARCHAR) AS precision_at_k, CAST(NULL AS VARCHAR) AS ndcg_at_k, CAST(NULL AS VARCHAR) AS mrr, CAST(NULL AS VARCHAR) AS context_precision, CAST(NULL AS VARCHAR) AS context_recall, CAST(NULL AS VARCHAR) AS faithfulness,
        CAST(NULL AS VARCHAR) AS answer_relevance, CAST(NULL AS VARCHAR) AS keyword_f1, CASE WHEN l_discount > 0 THEN l_discount END AS composite_score, CAST(NULL AS VARCHAR) AS retrieval_ms, CAST(NULL AS VARCHAR) AS rerank_ms,
        CAST(NULL AS VARCHAR) AS generation_ms, l_tax AS total_ms FROM lineitem""",
    "json_values": """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN '{"a":[null,1.5],"s":{"b":null}}' ELSE '{"a":[0.5,1.5],"s":{"b":0.5}}' END AS json FROM events""",
    "owned_all": "SELECT doc_id AS document_id FROM documents WHERE source = 'src3'",
    "listed_documents": "SELECT doc_id, doc_id AS document_id, n_chars AS upload_time FROM documents",
    "run_list": "SELECT o_orderkey AS run_id, o_orderpriority AS sweep_id FROM orders WHERE o_custkey % 50 = 7 AND o_orderpriority = '1-URGENT'",
    "run_items": """SELECT o_orderkey AS run_id, CAST(count(l_orderkey) AS INT) AS n_items, coalesce(string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag), '') AS statuses
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 7 GROUP BY o_orderkey""",
    "run_cascade": """WITH i AS (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY l_orderkey)
        SELECT 'u' || o_custkey % 50 AS user_id, count(*) AS runs, CAST(coalesce(sum(items), 0) AS BIGINT) AS items FROM orders LEFT JOIN i ON l_orderkey = o_orderkey WHERE o_custkey % 50 <> 7 GROUP BY o_custkey % 50""",
    "latest_states": """SELECT user_id, last(value ORDER BY ts, event_id) FILTER (event_type = 'purchase') AS spent, last(event_id ORDER BY ts, event_id) FILTER (event_type = 'error') AS error,
        last(event_id ORDER BY ts, event_id) AS last_event FROM events GROUP BY user_id""",
    "transcripts": "SELECT conv_id AS chat_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, -turn) AS INT) AS nth, role FROM conversations",
    "public_chats": "SELECT doc_id AS chat_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'New chat' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id || ',b' END AS document_ids FROM documents",
    "query_validity": f"SELECT doc_id, trim(text, {_WS}) <> '' AND length(text) <= 8000 AND doc_id % 7 <= 5 AS ok FROM documents",
    "failover": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS p FROM events QUALIFY p <= 3),
        g AS (SELECT user_id, CAST(ts AS DATE) AS d, min(p) FILTER (event_type <> 'error' AND value >= 1) AS good, max(p) AS n FROM e GROUP BY user_id, CAST(ts AS DATE))
        SELECT user_id, strftime(d, '%Y-%m-%d') AS day, 'm' || good AS model, array_to_string(list_transform(range(1, coalesce(good, n) + 1), lambda x: 'm' || x), ', ') AS tried, good IS NULL AS failed FROM g""",
    "chat_messages": f"""WITH q AS (SELECT conv_id, text, turn FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
        s AS (SELECT conv_id, turn, role, trim(text, {_WS}) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, {_WS}) <> ''),
        k AS (SELECT * FROM s QUALIFY turn <= max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id)),
        h AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8),
        a AS (SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS turns FROM h GROUP BY conv_id)
        SELECT q.conv_id AS qid, CAST(2 + coalesce(n, 0) AS INT) AS n, md5('system: ' || CASE WHEN q.conv_id % 3 = 0 THEN 'Draft.' ELSE 'Answer.' END || chr(10) || coalesce(turns, '') || 'user: SOURCE PASSAGES:' || chr(10) || chr(10)
        || CASE WHEN q.conv_id % 2 = 1 THEN '[1] a.txt pp.1-2' || chr(10) || text ELSE '(no passages retrieved)' END || chr(10) || chr(10) || '-----' || chr(10) || chr(10) || 'REQUEST:' || chr(10) || text || chr(10) || chr(10) || 'Remember to cite sources as [filename p.X].') AS messages_md5
        FROM q LEFT JOIN a ON a.conv_id = q.conv_id""",
    "eval_messages": """SELECT item_id AS qid, md5('SOURCE PASSAGES:' || chr(10) || chr(10) || CASE WHEN item_id % 2 = 0 THEN '[1] ' || text ELSE '' END || chr(10) || chr(10) || '-----' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || text) AS user_md5, CAST(length('Answer strictly using the SOURCE PASSAGES below. Cite passages as [filename p.X]. If the passages do not contain the answer, say so plainly rather than inventing one.') AS INT) AS n_system FROM benchmark""",
    "uploads": """SELECT p_partkey, p_partkey % 6 NOT IN (3, 5) AND p_partkey % 11 <> 0 AND p_size * 2000000 <= 52428800 AS ok FROM part""",
    "line_headings": """SELECT doc_id, 0 AS at, 'SECTION ' || upper(source) || ' - General' AS heading FROM documents UNION ALL SELECT doc_id, 1, '3.' || doc_id || ' Scope' FROM documents UNION ALL SELECT doc_id, 3, 'ALL CAPS LINE' FROM documents""",
    "resolved_models": "WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'm0' ELSE 'm' || p_partkey % 4 END AS model FROM part) SELECT p_partkey, model, CASE model WHEN 'm0' THEN 900 WHEN 'm2' THEN 300 ELSE 700 END AS max_tokens FROM m",
    "derived_ids": "SELECT conv_id, turn, 'msg_' || left(sha1(conv_id || chr(31) || turn), 12) AS id, CASE WHEN max(turn) OVER (PARTITION BY conv_id) = 0 THEN 92 ELSE CAST(floor(38 + 54 * (turn / max(turn) OVER (PARTITION BY conv_id))) AS INT) END AS progress FROM conversations",
    "model_chain": f"""WITH {_MODELS}, j AS (SELECT ch.*, co.credit, co.until, coalesce(until > {NOW}, false) AS waits, coalesce(served, 0) AS served FROM ch LEFT JOIN co USING (model) LEFT JOIN sv USING (model))
        SELECT model, upper(model) AS label, priority, CASE WHEN waits THEN CASE WHEN credit THEN 'exhausted' ELSE 'cooldown' END ELSE 'ready' END AS state, NOT waits AS available, CASE WHEN waits THEN CASE WHEN credit THEN 'allowance spent' ELSE 'busy' END ELSE '' END AS reason,
        CAST(CASE WHEN waits THEN greatest(0, floor(until - {NOW})) ELSE 0 END AS INT) AS remaining, CASE WHEN waits THEN CASE WHEN credit THEN 3600 ELSE 45 END ELSE 0 END AS cooldown_total, served FROM j""",
    "upload_progress": """WITH t AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations)
        SELECT conv_id, turn, CASE WHEN turn = 0 THEN 4 WHEN turn = l THEN 100 ELSE CAST(38 + floor(54 * (turn / l)) AS INT) END AS percent FROM t""",
    "erased_owner": """SELECT 'documents' AS table_name, source AS user_id, count(*) AS rows FROM documents WHERE source <> 'src3' GROUP BY source
        UNION ALL SELECT 'chunks', source, CAST(sum(n_chars // 1000 + 1) AS BIGINT) FROM documents WHERE source <> 'src3' GROUP BY source""",
    "run_options": """SELECT 'retrieval_mode' AS kind, CAST(unnest(range(5)) AS INT) AS at, unnest(['hybrid_rrf', 'hybrid_weighted', 'dense', 'sparse', 'mmr']) AS value
        UNION ALL SELECT 'document', CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS INT), CAST(doc_id AS VARCHAR) FROM documents WHERE source = 'src3'""",
    "owned_totals": "SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY o_custkey",
}
