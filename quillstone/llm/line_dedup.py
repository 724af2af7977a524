"""Deduplication of runs of lines by winnowing. DataFrame operations only.

A run is `run` consecutive lines, or one line that is long by itself. Fingerprints are the hashes of the smallest line of each
window of `run` lines (the window minima, fewer than the lines) and those of long lines, so two copies of a run
always share one, at the same place of the run.

 1. Fingerprints with two places or more are found, and the first place of each.
 2. Every later place is joined to the first one of its fingerprint, and the match is extended both ways over the
    lines around both places. Successive places of a longer run continue one another.
 3. Windows around a later place in which the first place has other lines are compared among themselves:
    each window is joined to the first place that has it. So nothing is lost where a line has many surroundings.
 4. The lines of all matches but the first copy are deleted.

Each place is sent once by its fingerprint and no pairs of places are made; what is frequent is summed before it is sent. What
a join meets in one key is split by Spark, as both of its sides are exchanges. Joins are of one kind at every size:
no side is broadcast while it is still small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Lines of the shortest run that is deleted, and characters from which on a line is a run by itself.
RUN, LONG = 3, 150
_BLANK = " \t\r\x0b\f"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _lines(text: Column, long: int) -> Column:
    """Two hashes of each line that isn't blank, and whether it is long."""
    full = F.filter(F.transform(F.split(text, "\n", -1), _trimmed), lambda x: x != "")
    return F.transform(full, lambda x: F.struct(F.xxhash64(F.lit("a"), x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"), (F.length(x) >= long).alias("long")))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the same id and text are one document: they get the same result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _places(docs: DataFrame, run: int, long: int) -> DataFrame:
    """The places of fingerprints: position, the lines before (nearest first) and after, and the windows whose minimum it is.

    The windows with one minimum begin at consecutive lines, from `start` to `end`; a long line has none besides itself.
    """

    def minimum(i: Column) -> Column:
        own = F.slice("h", i, run)["a"]
        return i + F.array_position(own, F.array_min(own)).cast("int") - 1

    def window(i: Column) -> Column:
        at = minimum(i)
        same = [F.when((i + d + run - 1 <= F.size("h")) & (minimum(i + d) == at), 1).otherwise(0) for d in range(1, run)]
        is_first = (i == 1) | (minimum(F.greatest(i - 1, F.lit(1))) != at)
        return F.when(is_first, F.struct(at.alias("at"), F.lit(False).alias("long"), i.alias("start"), sum(same, i).alias("end")))

    starts = F.when(F.size("h") >= run, F.sequence(F.lit(1), F.size("h") - F.lit(run - 1)))
    windows = F.coalesce(F.filter(F.transform(starts, window), lambda x: x.isNotNull()), F.array())
    lone = F.filter(F.transform("h", lambda x, i: F.when(x["long"], F.struct((i + 1).cast("int").alias("at"), F.lit(True).alias("long"), F.lit(1).alias("start"), F.lit(0).alias("end")))), lambda x: x.isNotNull())
    rows = docs.select("doc_id", "text_hash", _lines(F.col("text"), long).alias("h")).select("doc_id", "text_hash", "h", F.explode(F.concat(windows, lone)).alias("p"))
    at = F.col("p.at")
    bare = lambda lines: F.transform(lines, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    before = F.reverse(F.slice("h", F.greatest(at - (run - 1), F.lit(1)), F.least(at - 1, F.lit(run - 1))))
    return rows.select(
        F.get("h", at - 1)["a"].alias("fingerprint"), F.get("h", at - 1)["b"].alias("check"), F.struct("doc_id", "text_hash", at.alias("at")).alias("place"),
        bare(before).alias("before"), bare(F.slice("h", at + 1, run - 1)).alias("after"), F.col("p.long").alias("long"), F.col("p.start").alias("start"), F.col("p.end").alias("end"),
    )


def _common(x: Column, y: Column) -> Column:
    """How many lines both arrays begin with."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    other = F.array_position(same, False).cast("int")
    return F.when(other == 0, F.size(same)).otherwise(other - 1)


def repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG, scratch: C.Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, first and last line (numbered from 1, blank lines aside) of matches with earlier runs; they may overlap."""
    scratch = scratch or C.Scratch(docs.sparkSession)
    docs = _keyed(docs)
    places = _places(docs, run, long)
    key = ["fingerprint", "check"]
    repeated = places.groupBy(*key).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").select(*key, "first")
    repeated = scratch.keep(repeated, "fingerprints")
    near = scratch.keep(places.join(repeated.hint("merge"), key), "places")
    firsts = near.where("place = first").select(*key, F.col("before").alias("first_before"), F.col("after").alias("first_after")).dropDuplicates(key)
    later = near.where("place > first").join(scratch.keep(firsts, "first-places").hint("merge"), key)
    # The match goes from the place so many lines back and so many on.
    at = F.col("place.at")
    later = later.withColumn("low", at - _common(F.col("before"), F.col("first_before"))).withColumn("high", at + _common(F.col("after"), F.col("first_after")))
    later = scratch.keep(later.select(*key, "place", "before", "after", "long", "start", "end", "low", "high"), "extended")
    matched = F.col("high") - F.col("low") + 1 >= run
    document = [F.col("place.doc_id").alias("doc_id"), F.col("place.text_hash").alias("text_hash")]
    alone = later.where("long").select(*document, at.alias("first_line"), at.alias("last_line"))
    runs = later.where(matched).select(*document, F.col("low").alias("first_line"), F.col("high").alias("last_line"))

    # Windows that the match doesn't hold, by their own lines: how far before the place they begin, and all that they hold.
    rest = later.where("start <= end").select(*document, at.alias("at"), *key, "before", "after", "low", "high", F.explode(F.sequence("start", "end")).alias("begin")).where((F.col("begin") < F.col("low")) | (F.col("begin") + run - 1 > F.col("high")))
    back = F.col("at") - F.col("begin")
    window = F.concat(F.slice("before", F.lit(1), back), F.slice("after", F.lit(1), run - 1 - back))
    rest = scratch.keep(rest.select("doc_id", "text_hash", "begin", *key, F.xxhash64(back, window["a"]).alias("w1"), F.xxhash64(back, window["b"]).alias("w2")), "other-windows")
    position = F.struct("doc_id", "text_hash", "begin")
    of = [*key, "w1", "w2"]
    starts = rest.groupBy(*of).agg(F.min(position).alias("first"), F.count("*").alias("n")).where("n > 1").select(*of, "first")
    others = rest.join(scratch.keep(starts, "first-windows").hint("merge"), of).where(position > F.col("first")).select("doc_id", "text_hash", F.col("begin").alias("first_line"), (F.col("begin") + run - 1).alias("last_line"))
    return runs.unionByName(alone).unionByName(others)


def _cleaned(docs: DataFrame, run: int, long: int) -> DataFrame:
    """rest (the row but for its text), lines, n_lines, n_removed and the text that is left, null if it was, of every row.

    Lines are cut before the join and put together after it: above it they are a column that is there, which no
    plan computes again for each of them.
    """
    scratch = C.Scratch(docs.sparkSession)
    gone = repeated_runs(docs, run, long, scratch).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first_line", "last_line")).alias("runs"))
    numbers = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first_line"], r["last_line"]))))
    gone = scratch.keep(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), numbers.alias("removed")), "repeated-lines")
    scratch.drop_but(gone)
    text = F.col("text").cast("string")
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    lines = F.split(text, "\n", -1)
    full = F.filter(F.transform(lines, lambda x, i: F.when(_trimmed(x) != "", i + 1)), lambda i: i.isNotNull())
    rows = docs.select(rest.alias("rest"), lines.alias("lines"), full.alias("full"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own_hash"))
    rows = rows.join(gone.hint("merge"), F.col("rest.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("lines")), F.transform("removed", lambda k: F.get("full", k - 1))), lambda i: F.get("lines", i - 1))
    left = F.array_join(F.when(F.col("removed").isNull(), F.col("lines")).otherwise(kept), "\n")
    return rows.select("rest", F.coalesce(F.size("full"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), left.alias("kept_text"))


def dedup_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """doc_id, n_lines (that aren't blank), n_removed and kept_text of every row.

    Lines end at \\n and are compared without white space at their ends; blank lines are neither counted
    nor deleted, nor do they end a run. A line of `long` characters is a run by itself. Of equal runs the one in the
    smallest doc_id stays, a null id being smaller than all; texts that share an id are ordered by a hash; rows that share id
    and text count as one and all get its result. A null text is empty and has no lines. Texts of any length are
    compared whole. An empty table gives no rows. Columns other than doc_id and text are not read. Lines are taken for
    equal if two 64-bit hashes agree.
    """
    return _cleaned(docs.select("doc_id", "text"), run, long).select(F.col("rest.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.coalesce("kept_text", F.lit("")).alias("kept_text"))


def without_repeated_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """docs with what dedup_lines leaves as text and its length as n_chars; a document that loses all of its lines goes.

    Null and blank texts, and those that lose nothing, stay as they are, in all columns; repeated rows all stay or go
    together. An empty table gives no rows. Columns may have any names.
    """
    rows = _cleaned(docs, run, long).where("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns))
