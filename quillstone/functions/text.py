"""Text functions as columns: repair, words, sentences, headings, titles. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sequences that UTF-8 text read as Windows-1252 shows, and what they stand for.
MOJIBAKE = (
    ("\u00e2\u20ac\u2122", "\u2019"),
    ("\u00e2\u20ac\u0153", "\u201c"),
    ("\u00e2\u20ac\u009d", "\u201d"),
    ("\u00e2\u20ac\u201c", "\u2013"),
    ("\u00e2\u20ac\u201d", "\u2014"),
    ("\u00e2\u20ac\u2039", "\u2018"),
    ("\u00e2\u20ac\u00a6", "\u2026"),
    ("\u00e2\u0080\u0099", "\u2019"),
    ("\u00e2\u0080\u009c", "\u201c"),
    ("\u00e2\u0080\u009d", "\u201d"),
    ("\u00e2\u0080\u0093", "\u2013"),
    ("\u00e2\u0080\u0094", "\u2014"),
)

# Fixed patterns.
TERM = r"[A-Za-z0-9]+(?:[.\-/][A-Za-z0-9]+)*"
ANSWER_TERM = r"[a-z0-9]+"
HEADING = r"^\s*((?:SECTION\s+[A-Z0-9.\-]+(?:\s*[-—]\s*[A-Z][^\n]{0,80})?)|(?:[A-Z]\.\d+(?:\.\d+)*(?:\s+[A-Z][^\n]{0,80})?)|(?:\d+(?:\.\d+){0,3}\s+[A-Z][^\n]{0,80})|(?:[A-Z][A-Z \-/]{4,60}))\s*$"
HEADING_LENGTH = 90
TITLE_LENGTH = 60

# What may open a sentence, by use: ingestion, chunk boundaries, and metrics.
OPENERS = {"ingest": r"A-Z0-9(", "chunk": r"A-Z0-9\"(\[", "metric": r"A-Z0-9(\["}


def strip(text: Column) -> Column:
    """Without white space at either end, non-breaking spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~F.rlike(text, F.lit(r"(?U)\S")), F.lit(True))


def repair(text: Column) -> Column:
    """Mojibake replaced, one sequence after the other."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, text)


def terms(text: Column) -> Column:
    """Search terms: ASCII words that keep their inner dots, dashes and slashes, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)


def answer_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ANSWER_TERM), F.lit(0))


def words(text: Column) -> Column:
    """What lies between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """The usual estimate: three words for four tokens, and one more."""
    return F.floor(F.size(words(text)) / F.lit(0.75)).cast("int") + 1


def sentences(text: Column, use: str = "ingest") -> Column:
    """Sentences end at . ! or ? before white space and something that may open one; blank ones are dropped."""
    text = F.regexp_replace(text, r"[ \t]+", " ") if use == "ingest" else text
    parts = F.split(text, rf"(?<=[.!?])(?U:\s+)(?=[{OPENERS[use]}])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def heading(line: Column) -> Column:
    """The line if it is a heading, else null. Blank lines and lines over 90 characters aren't."""
    bare = F.regexp_replace(line, r"(?U)\s+$", "")
    return F.when((bare != "") & (F.length(bare) <= HEADING_LENGTH) & F.rlike(bare, F.lit(HEADING)), strip(bare))


def title(message: Column) -> Column:
    """A first message on one line, cut at a word within 60 characters."""
    text = F.array_join(words(F.coalesce(message, F.lit(""))), " ")
    head = F.substring(text, 1, TITLE_LENGTH)
    cut = strip(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head))
    return F.when(text == "", "New chat").when(F.length(text) <= TITLE_LENGTH, text).otherwise(F.concat(F.when(cut == "", strip(head)).otherwise(cut), F.lit("…")))


def location(start: Column, end: Column) -> Column:
    """Page or pages as they are cited."""
    return F.when(start == end, F.concat(F.lit("p."), start)).otherwise(F.concat(F.lit("pp."), start, F.lit("-"), end))


def is_credit_error(status: Column, body: Column) -> Column:
    """Whether a provider's answer says that the free allowance is spent."""
    body = F.lower(body)
    return (status == 402) | F.contains(body, F.lit("included credits")) | (F.contains(body, F.lit("monthly")) & F.contains(body, F.lit("credit")))


def verdict(answer: Column) -> Column:
    """True for yes, false for no, null for anything else."""
    head = F.upper(F.substring(strip(answer), 1, 1))
    return F.when(head == "Y", True).when(head == "N", False)


def email_key(email: Column) -> Column:
    """What two addresses must have in common to be one."""
    return F.lower(strip(email))


def password_ok(password: Column) -> Column:
    return (F.length(password) >= 10) & F.rlike(password, F.lit("[A-Za-z]")) & F.rlike(password, F.lit("[0-9]"))


# The providers that a model can name.
PROVIDERS = ("openrouter", "hf")


def model_ref(ref: Column, default: str = "hf") -> Column:
    """provider:model as a struct; a name without a known provider in front has the default one."""
    named = F.rlike(ref, F.lit(f"^({'|'.join(PROVIDERS)}):"))
    return F.struct(F.when(named, F.substring_index(ref, ":", 1)).otherwise(F.lit(default)).alias("provider"), F.when(named, F.regexp_replace(ref, "^[^:]*:", "")).otherwise(ref).alias("model"))


def rounded(x: Column, digits: int) -> Column:
    """Rounding by way of a decimal, so that every engine rounds alike."""
    return F.round(x.cast("decimal(20,10)"), digits).cast("double")


def prefixed_id(prefix: str, length: int = 12) -> Column:
    """A new id: a prefix and so many hexadecimal digits of a random UUID."""
    return F.concat(F.lit(prefix), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(length)))


def derived_id(prefix: str, *of: Column, length: int = 12) -> Column:
    """An id that the same values always give."""
    return F.concat(F.lit(prefix), F.left(F.sha1(F.concat_ws("\x1f", *of)), F.lit(length)))


def truncated(text: Column, length: int) -> Column:
    """At most so many characters, as errors and judged passages are cut."""
    return F.substring(text, 1, length)


def percent(done: Column, total: Column, low: int = 0, high: int = 100) -> Column:
    """Progress from low to high, within both; high where there is nothing to do."""
    share = F.coalesce(F.try_divide(done, total), F.lit(1.0))
    return F.least(F.lit(high), F.greatest(F.lit(low), low + F.floor((high - low) * share))).cast("int")


# How far an upload is when a stage begins; embedding goes on to 92.
UPLOAD_STAGES = {"reading": 4, "extracted": 22, "split": 38, "embedding": 38, "writing": 95, "indexed": 100}


def upload_percent(stage: Column, done: Column, total: Column) -> Column:
    """How far an upload is, in percent; null for an unknown stage."""
    out = F.when(stage == "embedding", percent(done, total, UPLOAD_STAGES["embedding"], 92))
    for name, at in UPLOAD_STAGES.items():
        out = out.when(stage == name, F.lit(at))
    return out


def resolved_model(ref: Column, chain: Sequence[str], most_tokens: dict[str, int], default: int = 700) -> Column:
    """struct(model, max_tokens): "auto" is the first of the chain; a model without a bound of its own has the default one."""
    model = F.when((ref == "auto") | is_blank(ref), F.lit(chain[0])).otherwise(ref)
    bound = F.lit(default)
    for name, n in most_tokens.items():
        bound = F.when(model == name, F.lit(n)).otherwise(bound)
    return F.struct(model.alias("model"), bound.alias("max_tokens"))
