"""A Merkle manifest of a dataset: leaves in the order of their ids without sorting them.

A row's leaf is the SHA-256 of its columns. Leaves of a source stand in the order of doc_id. Where each stands comes from an
index of bitmaps by rank: the ids of a source are a bitmap cut into words of 64 bits, of which only those that hold an id are kept. A word
is the OR of its ids, merged from partial words of each task; a directory of popcounts tells how many ids stand before it, in three
levels of at most 65,536 entries under one parent, so that no directory grows with the data. A leaf's place is the directory's entry
and the popcount of the bits below its own.

Places are then keys: the 729 leaves with the same place div 729 meet in one array of slots, six levels of runs of three
are hashed within it, and what is left, one node, is a slot of the next array. The subroots are slots of a last tree, in
the order of the source names. Going down again each array learns what stands beside it above, so that each leaf
gets its proof from its own array and from one row.

Null columns are hashed as `-`. Sources stand in bytewise order, a null one first; ids ascend, null ones first. Rows that share an id stand in the
order of their leaves; rows equal in all hashed columns have equal leaves and stand next to each other. Words with such ids (and null ones) have
more rows than bits; theirs are numbered by pieces of the leaves' hash space. Empty and very long texts are hashed
as they are. An empty table has no root and gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Members of a run.
FAN = 3
#: Levels that one array of slots reduces.
LEVELS = 6
SPAN = FAN**LEVELS

#: What stands for the word of null ids: below that of any id.
_NULL_WORD = -(2**57) - 1


def field(value: Column) -> Column:
    """Bytes in UTF-8, a colon, the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in COLUMNS)).cast("binary"), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- places


def _directory(words: DataFrame) -> DataFrame:
    """words (tree, word, bits, n) with before: the rows of the tree that stand before the word."""

    def counted(level: DataFrame, shift: int, tag: str) -> DataFrame:
        own = Window.partitionBy("tree", f"up{shift}").orderBy(tag)
        return level.withColumn(f"before_{tag}", F.sum("n").over(own) - F.col("n"))

    level = words.withColumn("up16", F.shiftright("word", 16))
    out = counted(level, 16, "word")
    above = level.groupBy("tree", "up16").agg(F.sum("n").alias("n")).withColumn("up32", F.shiftright("up16", 16))
    out = out.join(counted(above, 32, "up16").drop("n"), ["tree", "up16"])
    above = above.groupBy("tree", "up32").agg(F.sum("n").alias("n")).withColumn("up48", F.shiftright("up32", 16))
    out = out.join(counted(above, 48, "up32").drop("n"), ["tree", "up32"])
    above = above.groupBy("tree", "up48").agg(F.sum("n").alias("n"))  # at most 1,025 a tree
    top = above.withColumn("before_up48", F.sum("n").over(Window.partitionBy("tree").orderBy("up48")) - F.col("n")).drop("n")
    out = out.join(top, ["tree", "up48"])
    return out.select("tree", "word", "bits", "n", (F.col("before_word") + F.col("before_up16") + F.col("before_up32") + F.col("before_up48")).alias("before"))


def place_leaves(leaves: DataFrame, scratch: C.Scratch) -> DataFrame:
    """leaves (tree, doc_id, leaf, and what else) with place, from 0 within the tree."""
    word = F.coalesce(F.shiftright("doc_id", 6), F.lit(_NULL_WORD))
    low = F.col("doc_id").bitwiseAND(63).cast("int")
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    words = leaves.groupBy("tree", word.alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    index = scratch.keep(_directory(words), "merkle-index")
    single = F.coalesce(F.bit_count("bits"), F.lit(0)) == F.col("n")
    met = leaves.withColumn("word", word).join(index, ["tree", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, cast(doc_id & 63 as int))")))
    out = leaves.columns
    ones = met.filter(single).select(*out, (F.col("before") + below).alias("place"))
    # Rows that share an id: pieces of 1/4096 of the leaves' hashes, counted, then numbered.
    again = met.filter(~single).withColumns({"low": low, "piece": F.substring("leaf", 1, 3)})
    key = ["tree", "word", "low", "piece"]
    pieces = again.groupBy(*key).agg(F.count("*").alias("rows"))
    pieces = pieces.withColumn("first", F.sum("rows").over(Window.partitionBy("tree", "word").orderBy("low", "piece")) - F.col("rows"))
    shared = again.withColumn("low", F.coalesce("low", F.lit(-1))).join(pieces.withColumn("low", F.coalesce("low", F.lit(-1))).drop("rows"), key)
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("leaf")) - 1
    return ones.unionByName(shared.withColumn("place", F.col("before") + F.col("first") + inside).select(*out, "place"))


# --- trees


def _levels(slots: list[str], n: int) -> list[list[str]]:
    """The nodes of an array, level by level, until one is left of the tree's n nodes or LEVELS are done."""
    out = [slots]
    while n > 1 and len(out) <= LEVELS:
        last = out[-1]
        out.append([_digest("".join(last[k : k + FAN])) for k in range(0, len(last), FAN)])
        n = -(-n // FAN)
    return out


def _beside(levels: list[list[str]], slot: int) -> list[str]:
    """What stands before and after the slot in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % FAN
        out += ["".join(nodes[first:slot]), "".join(nodes[slot + 1 : first + FAN])]
        slot //= FAN
    return out


def _in_order(members: list[dict]) -> list[dict]:
    out: list = [None] * len(members)
    for m in members:
        out[m["slot"]] = m
    return out


_NODES = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])
NODE_SCHEMA = "tree long, place long, digest string, n long"


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each array becomes one node; n is the number of nodes that its tree has then."""
    for data in batches:
        rows = data.to_pylist()
        made = [_levels([m["digest"] for m in _in_order(r["members"])], r["n"])[-1] for r in rows]
        yield C.batch(_NODES, [r["tree"] for r in rows], [r["grp"] for r in rows], [m[0] for m in made], [-(-r["n"] // SPAN) for r in rows])


_BELOW = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("beside", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
BELOW_SCHEMA = "tree long, place long, beside array<string>, subroot string, root string"


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of an array: what stands beside it up to the root. Slots of the lowest arrays of the sources' tree are subroots."""
    for data in batches:
        for r in data.to_pylist():
            slots = [m["digest"] for m in _in_order(r["members"])]
            levels = _levels(slots, r["n"])
            root = r["root"] or levels[-1][0]
            tree, above = r["tree"], r["beside"] or []
            places = [r["grp"] * SPAN + k for k in range(len(slots))]
            subroots = slots if r["lowest"] else [r["subroot"]] * len(slots)
            yield C.batch(_BELOW, [tree] * len(slots), places, [_beside(levels, k) + above for k in range(len(slots))], subroots, [root] * len(slots))


def _arrays(nodes: DataFrame, members: list[Column]) -> DataFrame:
    slot = (F.col("place") % SPAN).cast("int").alias("slot")
    return nodes.groupBy("tree", F.expr(f"place div {SPAN}").alias("grp")).agg(F.first("n").alias("n"), F.collect_list(F.struct(slot, *members)).alias("members"))


def _climb(nodes: DataFrame, most: int, scratch: C.Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The arrays above nodes (tree, place, digest, n), lowest first, and each tree's last node. most: nodes of the largest tree."""
    arrays = []
    while True:
        arrays.append(scratch.keep(_arrays(nodes, [F.col("digest")]), "merkle-arrays"))
        nodes = scratch.keep(arrays[-1].mapInArrow(_up, NODE_SCHEMA), "merkle-nodes")
        most = -(-most // SPAN)
        if most <= 1:
            return arrays, nodes


def _descend(arrays: DataFrame, above: DataFrame | None, lowest: bool) -> DataFrame:
    """arrays with what is above each of them, as (tree, grp, beside, subroot, root)."""
    arrays = arrays.withColumn("lowest", F.lit(lowest))
    if above is None:
        empty = {"beside": F.lit(None).cast("array<string>"), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")}
        return arrays.withColumns(empty)
    return arrays.join(above, ["tree", "grp"])


_PROOF = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("beside", pa.list_(pa.string()))])


def _prove(keep_proofs: bool):
    schema = _PROOF if keep_proofs else pa.schema(list(_PROOF)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            for r in data.to_pylist():
                members = _in_order(r["members"])
                levels = _levels([m["digest"] for m in members], r["n"])
                above, rows = r["beside"], []
                upper = "".join(above)
                for k, m in enumerate(members):
                    own = _beside(levels, k)
                    folded = m["claimed"] or m["digest"]
                    for path in (own, above):
                        for i in range(0, len(path), 2):
                            folded = _digest(path[i] + folded + path[i + 1])
                    rows.append((m["doc_id"], r["source"], m["digest"], r["subroot"], r["root"], _digest("".join(own) + upper), folded, folded == r["root"], own + above))
                yield C.batch(schema, *list(zip(*rows, strict=True))[: len(schema)])

    return run


def manifest(docs: DataFrame, claimed_text: Column | None = None, keep_proofs: bool = True, columns: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot (of its source), root, proof_sha256, folded_root, verified, and beside: what stands before and after it, level by level.

    claimed_text: a text for each row, whose leaf is folded with the proof in place of the row's own; null: the row's own.
    verified: whether folding gives the root. Without keep_proofs only the proofs' digest is returned.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    columns = columns or {c: F.col(c) for c in COLUMNS}
    claimed = F.lit(None).cast("string") if claimed_text is None else F.when(claimed_text.isNotNull() & ~claimed_text.eqNullSafe(columns["text"]), leaf_of(columns | {"text": claimed_text}))
    leaves = scratch.keep(docs.select(columns["doc_id"].cast("long").alias("doc_id"), columns["source"].cast("string").alias("source"), leaf_of(columns).alias("digest"), claimed.alias("claimed")), "merkle-leaves")
    trees = C.numbered(leaves.groupBy("source").agg(F.count("*").alias("n")), F.col("source").asc_nulls_first(), scratch)
    trees = scratch.keep(trees.withColumnRenamed("place", "tree"), "merkle-trees")
    C.bounded_batches(spark)
    of_tree = leaves.join(trees.select(F.col("source").alias("_source"), "tree"), F.col("source").eqNullSafe(F.col("_source"))).select("tree", "doc_id", F.col("digest").alias("leaf"), "claimed")
    placed = place_leaves(of_tree, scratch)
    placed = placed.join(trees.select("tree", "n"), "tree").withColumnRenamed("leaf", "digest")
    lowest = scratch.keep(_arrays(placed, [F.col("digest"), F.col("claimed"), F.col("doc_id")]), "merkle-leaf-arrays")
    scratch.drop(leaves)
    slots = F.transform("members", lambda m: F.struct(m["slot"].alias("slot"), m["digest"].alias("digest")))
    nodes = scratch.keep(lowest.select("tree", "grp", "n", slots.alias("members")).mapInArrow(_up, NODE_SCHEMA), "merkle-nodes")
    n_trees, most = trees.agg(F.count("*"), F.max("n")).first()
    n_trees, most = max(n_trees, 1), most or 1
    arrays, subroots = _climb(nodes, -(-most // SPAN), scratch) if most > SPAN else ([], nodes)
    tops, _ = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(n_trees).cast("long").alias("n")), n_trees, scratch)
    above = None
    for k, level in reversed(list(enumerate(tops))):
        below = scratch.keep(_descend(level, above, k == 0).mapInArrow(_down, BELOW_SCHEMA), "merkle-above")
        above = below.withColumnRenamed("place", "grp")
    # Now a place is a source's tree, whose last array is its first.
    above = above.select(F.col("grp").alias("tree"), F.lit(0).cast("long").alias("grp"), "beside", "subroot", "root")
    for level in reversed(arrays):
        below = scratch.keep(_descend(level, above, False).mapInArrow(_down, BELOW_SCHEMA), "merkle-above")
        above = below.withColumnRenamed("place", "grp")
    scratch.drop_but(lowest, below, trees)
    proved = lowest.join(above, ["tree", "grp"]).join(trees.select("tree", "source"), "tree")
    schema = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proved.mapInArrow(_prove(keep_proofs), schema + ", beside array<string>" * keep_proofs)
