"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges.

Each distinct shingle of a document is hashed once; the high bits of the hash pick one of 128 bins, and
a bin keeps its smallest hash. An empty bin borrows from another one that a hash of its number and of
the attempt picks (optimal densification), so two documents agree in a bin with the probability of
their similarity. Documents with equal sets are one class from here on.

Bands of 4 bins are buckets. In each bucket one class is the centre, and only edges from the centre to
the others become candidates, so a bucket of n classes gives n-1 of them. Candidates that sizes and bins prove not to be
links are dropped; the others are confirmed on the full sets. Buckets that still hold several components get
another centre, small ones all their pairs. In the buckets that are mixed even then all
pairs between components are compared: a bucket is dealt into parts of a bounded size, and each two parts
that hold several components meet in a tile. So every two classes that share a bucket are compared or linked
by others.

Nothing is collected. Rows are numbered once, when they are written; a class is compared by the set of one of its rows,
so copies are never sent. The sets of classes that share a bucket are written once, in one pass over the texts. A centre with many members is confirmed in slices of a bounded number of members and shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
BINS, ROWS = 128, 4
#: Buckets of so many classes get all their pairs in the second round.
SMALL_BUCKET = 8
#: Members, and their shingles, that are confirmed against one copy of a centre, about.
SLICE, SLICE_SHINGLES = 500, 2 << 20
#: Classes, and shingles, in a part of a large mixed bucket, about.
PART, PART_SHINGLES = 2000, 1 << 20

_NAMES = [("n", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("row_hash", pa.int64())]
_FEATURES = pa.schema([*_NAMES, ("n_shingles", pa.int64()), ("class", pa.int64()), ("bands", pa.list_(pa.int64())), ("bins", pa.binary())])
_SKETCH = np.dtype([("bins", "<u2", BINS), ("filled", "u1", BINS // 8)])
_SETS = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SIZED = pa.schema([*_LINKS, ("n", pa.int64())])
_LIKELY = pa.schema([("tile", pa.int64()), ("class", pa.int64()), ("root", pa.int64()), ("part", pa.int64())])


def _borrowed(attempts: int = 64) -> np.ndarray:
    """For each attempt and bin, the bin to borrow from."""
    n = np.arange(attempts * BINS, dtype=np.uint64)
    return (C.scramble(n + np.uint64(0x51ED270B)) % np.uint64(BINS)).astype(np.int64).reshape(attempts, BINS)


_BORROWED = _borrowed()


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    vocabulary = C.Vocabulary()
    ids = [vocabulary.encode(C.words_of(t, lower=True)) for t in texts]
    hashes = vocabulary.hashes()
    out = []
    for own in ids:
        n = min(SHINGLE, len(own))
        out.append(np.unique(C.grams(hashes[own], n)[n - 1 :]) if n else np.zeros(0, np.uint64))
    return out


def bins_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The densified bins of sets that aren't empty, one row each, and which of them the set itself fills."""
    bins = np.full((len(sets), BINS), np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    if sets:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        number = (values >> np.uint64(57)).astype(np.int64)
        place = row * BINS + number
        first = np.flatnonzero(np.diff(place, prepend=-1))  # hashes ascend, so the first of a bin is its smallest
        bins.ravel()[place[first]], filled.ravel()[place[first]] = values[first], True
    own, out = filled.copy(), bins.copy()
    for attempt in range(len(_BORROWED)):
        r, b = np.nonzero(~filled)
        if not len(r):
            return out, own
        source = _BORROWED[attempt][b]
        found = own[r, source]
        out[r[found], b[found]] = bins[r[found], source[found]]
        filled[r[found], b[found]] = True
    for r in np.flatnonzero(~filled.all(axis=1)):  # hardly any bin is left: the next full one to the right
        full = np.flatnonzero(own[r])
        for b in np.flatnonzero(~filled[r]):
            out[r, b] = bins[r, full[np.searchsorted(full, b) % len(full)]]
    return out, own


def _class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.arange(BINS // ROWS, dtype=np.uint64)
    for data in batches:
        sets = shingle_sets(data.column("text").to_pylist())
        full = [k for k, s in enumerate(sets) if len(s)]
        bins, filled = bins_of([sets[k] for k in full])
        bands = np.zeros((len(full), BINS // ROWS), np.uint64) + salt
        for k in range(ROWS):
            bands = C.scramble(bands * np.uint64(0x9E3779B97F4A7C15) + bins[:, k::ROWS])
        sketch = np.zeros(len(full), _SKETCH)
        sketch["bins"], sketch["filled"] = C.scramble(bins) & np.uint64(0xFFFF), np.packbits(filled, axis=1)
        at = {k: i for i, k in enumerate(full)}
        yield C.batch(
            _FEATURES, *(data.column(c) for c, _ in _NAMES), [len(s) for s in sets], [_class(s) if len(s) else None for s in sets],
            [bands[at[k]].view(np.int64) if k in at else None for k in range(len(sets))], [sketch[at[k]].tobytes() if k in at else None for k in range(len(sets))],
        )


def _sketches(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(column.to_pylist()), _SKETCH)
    return rows["bins"], np.unpackbits(rows["filled"], axis=1).astype(bool)


def _may_link(n: np.ndarray, m: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs of sets that can be links, by their sizes and sketches; what is ruled out is none for certain.

    A bin that one set alone fills, or that has other smallest hashes in both, holds a shingle that is in
    one set only; a link has at most (100 - PERCENT) / (100 + PERCENT) times the sum of both sizes of these.
    """
    apart = ((x[1] | y[1]) & ((x[1] != y[1]) | (x[0] != y[0]))).sum(axis=1)
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((100 + PERCENT) * apart <= (100 - PERCENT) * (n + m))


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates that may be links, with the member's size."""
    for data in batches:
        n, m = (np.array(data.column(c), np.int64) for c in ("n_centre", "n_member"))
        if data.num_rows:
            ok = _may_link(n, m, _sketches(data.column("bins_centre")), _sketches(data.column("bins_member")))
            kept = data.filter(pa.array(ok))
            yield C.batch(_SIZED, kept.column("centre"), kept.column("member"), kept.column("n_member"))


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data in batches:
        yield C.batch(_SETS, data.column("class"), [C.pack_sorted(s) for s in shingle_sets(data.column("text").to_pylist())])


def _confirm(group: pa.Table) -> pa.Table:
    rows = list(zip(*(group.column(c).to_pylist() for c in ("class", "is_centre", "shingles")), strict=True))
    centre = next((C.unpack_sorted(s) for _, is_centre, s in rows if is_centre), None)
    links = []
    for own, is_centre, packed in rows:
        if not is_centre and centre is not None:
            s = C.unpack_sorted(packed)
            both = len(np.intersect1d(centre, s, assume_unique=True))
            if 100 * both >= PERCENT * (len(s) + len(centre) - both):
                links.append((group.column("centre")[0].as_py(), own))
    return C.arrow(_LINKS, links)


def _sets(rows: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class, shingles) of all classes that share a bucket with another one, each from one of its rows.

    Both sides of the join are exchanged by row number, at every size alike: a plan that sends the few of a small input to all
    tasks would say nothing of a large one.
    """
    shared = members.select("class").distinct().join(classes.select("class", F.col("least.n").alias("wanted_n")), "class")
    texts = rows.select("n", F.col("row.text").cast("binary").alias("text")).join(shared.hint("merge"), F.col("n") == F.col("wanted_n"))
    return texts.select("class", "text").mapInArrow(_packed_sets, "class long, shingles binary")


def _confirmed(sets: DataFrame, classes: DataFrame, candidates: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The candidates (a: centre, b: member) that are links on their full sets."""
    bins = classes.select("class", "n_shingles", "bins")
    side = lambda name, key: bins.select(F.col("class").alias(key), F.col("n_shingles").alias(f"n_{name}"), F.col("bins").alias(f"bins_{name}"))
    pairs = candidates.select(F.col("a").alias("centre"), F.col("b").alias("member")).join(side("centre", "centre"), "centre").join(side("member", "member"), "member")
    likely = scratch.keep(pairs.mapInArrow(_agree, "a long, b long, n long"), "likely")
    n_slices = F.ceil(F.greatest(F.count("*") / SLICE, F.sum("n") / SLICE_SHINGLES)).cast("long")
    slices = scratch.keep(likely.groupBy("a").agg(n_slices.alias("slices")), "slices")
    sent = likely.join(slices, "a").select(F.col("b").alias("class"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("slices")).alias("slice"), F.lit(False).alias("is_centre"))
    sent = sent.unionByName(slices.select(F.col("a").alias("class"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("is_centre")))
    return sets.join(sent.hint("merge"), "class").groupBy("centre", "slice").applyInArrow(_confirm, "a long, b long")


def _other_centres(mixed: DataFrame, scratch: C.Scratch) -> DataFrame:
    """In each bucket (band, class, root), edges from another centre to the classes of other components."""
    key = F.xxhash64(F.lit("other"), F.col("band"), F.col("class"))
    centre = mixed.groupBy("band").agg(F.min(key).alias("key"))
    centre = mixed.select("band", key.alias("key"), F.col("class").alias("a"), F.col("root").alias("centre_root")).join(centre, ["band", "key"]).drop("key")
    return mixed.join(scratch.keep(centre, "centres"), "band").where("root <> centre_root").select("a", F.col("class").alias("b"))


def _small_pairs(buckets: DataFrame, scratch: C.Scratch) -> DataFrame:
    """All pairs between components within small buckets: no bucket gives more than a fixed number."""
    lists = buckets.groupBy("band").agg(F.count("*").alias("n")).where(f"n BETWEEN 3 AND {SMALL_BUCKET}").select("band")
    own = buckets.join(scratch.keep(lists, "small-buckets"), "band").groupBy("band").agg(F.array_sort(F.collect_list(F.struct("class", "root"))).alias("own"))
    pair = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: (y["class"] > x["class"]) & (y["root"] != x["root"])), lambda y: F.struct(x["class"].alias("a"), y["class"].alias("b")))))
    return own.select(F.explode(pair).alias("p")).select("p.a", "p.b")


def _mixed(members: DataFrame, roots: DataFrame, least: int, scratch: C.Scratch) -> DataFrame:
    """(band, class, root) of the buckets that hold several components and at least so many classes."""
    rooted = members.join(roots, members["class"] == roots["node"], "left").select("band", "class", F.coalesce("root", "class").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where(f"x <> y AND n >= {least}").select("band")
    return scratch.keep(rooted.join(scratch.keep(mixed, "mixed"), "band"), "mixed-buckets")


def _tiles(mixed: DataFrame, classes: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The classes of each two parts that meet. The largest component of a bucket has parts of its own, which don't meet one another."""
    own = scratch.keep(mixed.join(classes.select("class", "n_shingles"), "class"), "mixed-classes")
    sizes = scratch.keep(own.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")), "mixed-components")
    largest = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    sizes = sizes.join(largest, "band").groupBy("band", "largest")
    is_largest = F.col("root") == F.col("largest")
    parts = lambda which: F.ceil(F.greatest(F.sum(F.when(which, F.col("n"))) / PART, F.sum(F.when(which, F.col("shingles"))) / PART_SHINGLES)).cast("long")
    sizes = scratch.keep(sizes.agg(parts(is_largest).alias("own_parts"), parts(~is_largest).alias("parts")), "parts")
    part = F.when(is_largest, F.col("parts") + F.pmod(F.xxhash64("class"), F.col("own_parts"))).otherwise(F.pmod(F.xxhash64("class"), F.col("parts")))
    dealt = own.join(sizes, "band").withColumn("part", part)
    last = F.col("parts") - 1 + F.when(is_largest, F.lit(0)).otherwise(F.col("own_parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    tile = F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other"))
    return dealt.select(tile.alias("tile"), "band", "class", "root", "part", "n_shingles").join(classes.select("class", "bands", "bins"), "class")


def _likely_in_tile(group: pa.Table) -> pa.Table:
    """The classes that may be links with another component's. A pair counts in the first bucket that it shares."""
    band, n, root, part = (np.array(group.column(c), np.int64) for c in ("band", "n_shingles", "root", "part"))
    bands = np.array(group.column("bands").to_pylist(), np.int64)
    bins, filled = _sketches(group.column("bins"))
    two = part.min() < part.max()
    likely = np.zeros(len(n), bool)
    for k in range(len(n) - 1):
        x = slice(k + 1, None)
        ok = (root[x] != root[k]) & (100 * np.minimum(n[x], n[k]) >= PERCENT * np.maximum(n[x], n[k]))
        if two:
            ok &= part[x] != part[k]
        at = k + 1 + np.flatnonzero(ok)
        at = at[bands[k][(bands[at] == bands[k]).argmax(axis=1)] == band[k]]
        at = at[_may_link(n[at], n[k], (bins[at], filled[at]), (bins[k], filled[k]))]
        likely[at] = True
        likely[k] |= len(at) > 0
    return group.select(_LIKELY.names).filter(pa.array(likely))


def _linked_in_tile(group: pa.Table) -> pa.Table:
    """Links on full sets between components; those between classes that others in the tile link are left out."""
    rows = {c: (r, p, C.unpack_sorted(s)) for c, r, p, s in zip(*(group.column(c).to_pylist() for c in ("class", "root", "part", "shingles")), strict=True)}
    names, sets = list(rows), [s for _, _, s in rows.values()]
    root, part = (np.array([r[k] for r in rows.values()], np.int64) for k in (0, 1))
    n = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    two = part.min() < part.max()
    held = np.zeros(len(ids), bool)
    links = []
    for k in range(len(n) - 1):
        ok = (root != root[k]) & (100 * np.minimum(n, n[k]) >= PERCENT * np.maximum(n, n[k])) & (np.arange(len(n)) > k)
        if two:
            ok &= part != part[k]
        if not ok.any():
            continue
        own = ids[starts[k] : starts[k] + n[k]]
        held[own] = True
        rest = slice(starts[k] + n[k], None)
        both = np.bincount(owner[rest][held[ids[rest]]], minlength=len(n))
        held[own] = False
        for j in np.flatnonzero(ok & (100 * both >= PERCENT * (n + n[k] - both))):
            if root[j] != root[k]:
                links.append((names[k], names[j]))
                root[root == root[j]] = root[k]
    return C.arrow(_LINKS, links)


def _links_in_tiles(sets: DataFrame, classes: DataFrame, mixed: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Links between the components of each bucket, as many as tie what belongs together."""
    likely = _tiles(mixed, classes, scratch).groupBy("tile").applyInArrow(_likely_in_tile, "tile long, class long, root long, part long")
    likely = scratch.keep(likely, "likely")
    return sets.join(likely.hint("merge"), "class").groupBy("tile").applyInArrow(_linked_in_tile, "a long, b long").distinct()


def _numbered(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """n, row (all columns of docs) and a hash of the row, written once: from here on the numbers are fixed.

    A hash can't be taken of maps; rows that differ in maps alone are told apart by their number.
    """
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return scratch.keep(docs.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row"), F.xxhash64(*own).alias("row_hash")), "rows")


def _grouped(docs: DataFrame, scratch: C.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbered rows, (n, doc_id, n_shingles, class) of each, and (class, keeper, component_id, n_links) of every class."""
    C.bounded_batches(docs.sparkSession)
    rows = _numbered(docs, scratch)
    texts = rows.select("n", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"), "row_hash", F.col("row.text").cast("binary").alias("text"))
    features = scratch.keep(texts.mapInArrow(_features, "n long, doc_id long, text_hash long, row_hash long, n_shingles long, class long, bands array<long>, bins binary"), "features")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "row_hash", "n")
    least = features.where("class IS NOT NULL").groupBy("class").agg(F.min(name).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bins").alias("bins"))
    classes = scratch.keep(least, "classes")

    buckets = classes.select("class", F.explode("bands").alias("band"))
    centres = scratch.keep(buckets.groupBy("band").agg(F.min("class").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a"), "centres")
    members = scratch.keep(buckets.join(centres, "band"), "members")
    tested = scratch.keep(members.where("class <> a").select("a", F.col("class").alias("b")).distinct(), "candidates")
    sets = scratch.keep(_sets(rows, classes, members), "sets")
    links = scratch.keep(_confirmed(sets, classes, tested, scratch), "links")
    roots = components(links, scratch)
    mixed = _mixed(members, roots, 3, scratch)
    more = _other_centres(mixed, scratch).unionByName(_small_pairs(mixed, scratch))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = scratch.keep(more.join(done, ["a", "b"], "left_anti"), "candidates")
    if not more.isEmpty():
        links = links.unionByName(scratch.keep(_confirmed(sets, classes, more, scratch), "links"))
        roots = components(links, scratch)
    mixed = _mixed(members, roots, SMALL_BUCKET + 1, scratch)  # smaller buckets had all their pairs
    if not mixed.isEmpty():
        links = links.unionByName(scratch.keep(_links_in_tiles(sets, classes, mixed, scratch), "links"))
        roots = components(links, scratch)

    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("links"))
    own = classes.select("class", "least").join(roots, classes["class"] == roots["node"], "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    own = scratch.keep(own, "own-roots")
    smallest = scratch.keep(own.groupBy("root").agg(F.min("least").alias("keeper")), "components")
    grouped = own.join(smallest, "root").join(degree, own["class"] == degree["a"], "left")
    grouped = scratch.keep(grouped.select("class", "keeper", F.col("keeper.doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")), "grouped-classes")
    scratch.drop_but(rows, features, grouped)
    return rows, features.select("n", "doc_id", "n_shingles", "class"), grouped


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_links of every row.

    A-Z in lower case, words without white space, sets of distinct shingles of five words; shorter texts
    are one shingle, and a text without words (null ones too) has none and is linked with nothing.
    component_id is the smallest id reachable over links, kept says whether it is the row's own, and
    n_links counts the confirmed links of the row's class to other classes; pairs that others link aren't all confirmed.

    Rows with a null id take part and may be linked; they are kept only if nothing that they reach has
    an id. Rows that share an id are documents of their own. An empty table gives no rows. Columns
    other than doc_id and text are not read. A class is named by a 64-bit hash of its set.
    """
    scratch = C.Scratch(docs.sparkSession)
    rows, features, classes = _grouped(docs.select("doc_id", "text"), scratch)
    scratch.drop(rows)
    out = features.join(classes, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, as it is in all its columns; rows without words all stay.

    It is the row with the smallest id, a null id being larger than all; of several with that id the one whose text, then
    whose row has the smallest hash, and of equal rows any. An empty table gives no rows. Columns may have any names.
    """
    rows, features, classes = _grouped(docs, C.Scratch(docs.sparkSession))
    kept = classes.select(F.col("keeper.n").alias("kept_n")).distinct().unionByName(features.where("class IS NULL").select(F.col("n").alias("kept_n")))
    return rows.join(kept, F.col("n") == F.col("kept_n"), "left_semi").select("row.*")
