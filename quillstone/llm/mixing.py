"""Mixing sources to target weights. DataFrame operations only.

Sources in the order of their names weigh 1, 2, 3 and so on in turn, and share all words by weight; no source
gives more than `most` times its words, what it can't give is shared anew among the others. Within a source
each document gets a hash-random key. Key space is cut into equal ranges, as many as the source needs, so ranges of the largest
source are no larger than others. Prefix sums over the ranges' words name the one range in which the budget ends; that
range alone is sorted, and prefix sums within it give the cut: the key up to which documents are taken once more than the
whole epochs that the budget holds. Applying a cut to documents is a join with one row a source; no text moves.

The budget is exact: the document at the cut gives its first words only. Equal keys are told apart by doc_id and size; rows equal in all
three are interchangeable, and are counted, not listed, until the end.

Null and empty texts have size 0 and are never taken. A null source is one source, the last. A null doc_id is hashed as empty text. Repeated
rows are taken like others, each for itself. Very long texts are counted whole. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources, in turn.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its words.
MOST = 3
#: Documents of one range of keys, about.
RANGE_ROWS = 10_000
#: Copies of one row that are made again in one go.
COPIES = 10_000

_WORD = r"[^\x20\x09-\x0D]++"


def key_of(doc_id: Column) -> Column:
    """60 bits of the SHA-256 of the id as text."""
    text = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"), 256)
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key_of(F.col("doc_id")).alias("key"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources (source_size, weight) with the target of each and the words it gives.

    Each round shares what the full sources leave by weight among the others, and ends when none of these is above its
    limit: a source that was full stays so, as shares only grow. Two sums come to the driver a round.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    limit = most * F.col("source_size")
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, weights = (total[0] or 0), (total[1] or 0)
    while True:
        full = wide(limit) * F.lit(weights).cast("decimal(19,0)") < wide(F.col("weight")) * F.lit(rest).cast("decimal(19,0)")
        found = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        now = ((total[0] or 0) - (found[0] or 0), found[1] or 0)
        if now == (rest, weights) or not now[1]:
            break
        rest, weights = now
    share = wide(F.lit(rest)) * wide(F.col("weight"))
    target = F.when(full, limit.cast("double")).otherwise(share.cast("double") / F.lit(max(weights, 1)).cast("double"))
    budget = F.when(full, limit).otherwise(F.floor(share / F.lit(max(weights, 1)).cast("decimal(19,0)")).cast("long"))
    return sources.withColumns({"target": target, "budget": budget})


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int, range_rows: int, scratch: C.Scratch) -> DataFrame:
    """One row a source: its size, target, whole epochs, and the cut (key, doc_id, size), with the words and the copies at the cut."""
    sums = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sums")
    placed = C.numbered(sums, F.col("source").asc_nulls_last(), scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    sources = scratch.keep(placed.withColumns({"weight": weight, "ranges": F.ceil(F.col("n") / range_rows).cast("long")}), "mix-sources")
    full = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    sources = targets(sources, most).withColumn("epochs", full).withColumn("over", F.col("budget") - F.col("epochs") * F.col("source_size"))

    rows = _of_source(sized, sources.filter("over > 0").select("source", "place", "ranges", "over"))
    rows = rows.withColumn("range", F.shiftright(F.shiftright("key", 28) * F.col("ranges"), 32))
    before = lambda by, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = lambda words: (F.col("start") < F.col("over")) & (F.col("over") <= F.col("start") + words)
    ranges = rows.groupBy("place", "range", "over").agg(F.sum("size").alias("words"))
    last = ranges.withColumn("start", before(["place"], ["range"], F.col("words"))).filter(ends(F.col("words"))).select("place", "range", F.col("start").alias("first"))
    inside = rows.join(last, ["place", "range"]).groupBy("place", "over", "first", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    words = F.col("copies") * F.col("size")
    cut = inside.withColumn("start", F.col("first") + before(["place"], ["key", "doc_id", "size"], words)).filter(ends(words))
    cut = cut.select("place", F.struct("key", "doc_id", "size").alias("cut"), (F.col("over") - F.col("start")).alias("left"), "copies")
    out = scratch.keep(sources.join(cut, "place", "left").select("source", "source_size", "weight", "target", "epochs", "cut", F.coalesce("left", F.lit(0)).alias("left"), "copies"), "mix-plan")
    scratch.drop_but(out, sized)
    return out


def _of_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _taken(at_cut: Column) -> Column:
    """Whole epochs, and once more up to the cut."""
    here = F.struct("key", "doc_id", "size")
    return F.col("epochs") * F.col("size") + F.when(F.col("cut").isNull() | (here > F.col("cut")), F.lit(0)).when(here < F.col("cut"), F.col("size")).otherwise(at_cut)


def _share(number: Column) -> Column:
    """What the copy of this number (from 0) of the row at the cut gives."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - number * F.col("size")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: doc_id, source, size, source_size, weight, target (of its source, in words) and taken, the words that the mix takes of it."""
    scratch = C.Scratch(docs.sparkSession)
    sized = scratch.keep(_sized(docs), "mix-sized")
    rows = _of_source(sized, _plan(sized, weights, most, range_rows, scratch))
    at_cut = F.coalesce(F.struct("key", "doc_id", "size") == F.col("cut"), F.lit(False))
    shown = ["doc_id", "source", "size", "source_size", "weight", "target"]
    others = rows.filter(~at_cut).select(*shown, _taken(F.lit(0)).alias("taken"))
    # Copies at the cut are equal: their number makes them again, in pieces that are dealt out.
    pieces = rows.filter(at_cut).groupBy("source").agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "weight", "target", "epochs", "cut", "key", "left", "copies")))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}")))).repartition("source", "piece")
    number = F.explode(F.sequence(F.col("piece") * COPIES, F.least(F.col("copies"), (F.col("piece") + 1) * COPIES) - 1))
    copies = pieces.withColumn("number", number).select(*shown, _taken(_share(F.col("number"))).alias("taken"))
    return others.unionByName(copies)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: documents once an epoch (from 1), the text at the cut ended after its last word that is taken.

    Columns of documents and epoch. A document of which nothing is taken is left out. Rows equal to the one at the cut in id, source
    and size are numbered within their source; no others are moved.
    """
    scratch = C.Scratch(docs.sparkSession)
    sized = scratch.keep(_sized(docs), "mix-sized")
    plan = _plan(sized, weights, most, range_rows, scratch)
    scratch.drop_but(plan)
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    whole = docs.select(F.struct("*").alias("row"))
    size = F.coalesce(F.regexp_count(F.col("row.text"), F.lit(_WORD)), F.lit(0)).cast("long")
    rows = whole.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size.alias("size"), key_of(F.col("row.doc_id")).alias("key"))
    rows = _of_source(rows, plan)
    at_cut = F.coalesce(F.struct("key", "doc_id", "size") == F.col("cut"), F.lit(False))
    number = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("row.text"))) - 1
    rows = rows.filter(~at_cut).withColumn("taken", _taken(F.lit(0))).unionByName(rows.filter(at_cut).withColumn("taken", _taken(_share(number))))
    rows = rows.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    begun = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*+" + _WORD), F.lit(0)), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("size"), begun).otherwise(F.col("row.text"))
    return rows.select(*(text.alias("text") if c == "text" else column.alias(c) for c, column in zip(docs.columns, columns, strict=True)), "epoch")
