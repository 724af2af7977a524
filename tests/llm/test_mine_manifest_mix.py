"""Hard negatives, the Merkle manifest and the mixing of sources against plain models."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import common as C
from quillstone.llm import hard_negatives, merkle, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- hard negatives


def plain_mine(rows, positives=5, negatives=5):
    """rows: (vec_id, vector, label). Python's integers."""
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda found: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    out = []
    for k, (i, v, lab) in enumerate(good):
        if i is None or i % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other == lab) for n, (j, w, other) in enumerate(good) if n != k]
        for p, j, _ in first(s for s in scores if s[2])[:positives]:
            for rank, (s, n, _) in enumerate(first(x for x in scores if not x[2] and 80 * p <= 100 * x[0] <= 100 * p)[:negatives], 1):
                out.append((i, j, rank, n, p, s))
    return Counter(out)


def mined(spark, rows, **settings):
    table = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, row int, vector string").repartition(3)
    found = hard_negatives.mine(hard_negatives.prepared(table), F.col("vec_id") % 100 == 0, **settings)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def near(rng, centre, noise):
    return [float(np.float32(x + rng.gauss(0, noise))) for x in centre]


def vectors(seed, n=400):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(4)]
    return [(i * 5, near(rng, centres[rng.randrange(4)], 0.1), rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("slice_bytes", "group_bytes"), [(1 << 20, 1 << 20), (300, 2000)])
def test_hard_negatives(spark, slice_bytes, group_bytes):
    rows = vectors(1)
    common = rows[7][1]
    rows += [(10_000 + i, common, i % 2) for i in range(80)]  # one vector, many rows
    rows += [(100, common, 1), (100, common, 1), (100, rows[20][1], 1), (None, common, 1), (None, common, 0), (900, None, 1), (901, common, None), (902, [float("nan"), *common[1:]], 1), (903, [float("inf"), *common[1:]], 0), (904, [None, *common[1:]], 0), (905, common[:5], 0), (906, [], 1), (1000, [], 1), (1100, [1000.0] * 8, 0)]
    got, want = mined(spark, rows, slice_bytes=slice_bytes, group_bytes=group_bytes), plain_mine(rows)
    assert got == want and sum(want.values()) > 200


def test_hard_negatives_of_nothing(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1.0], 0), (2, [1.0], 1)])
    assert not mined(spark, [(100, [1.0], 0), (2, [1.0], 1)])  # no positive
    assert mined(spark, [(100, [1.0], 0), (3, [1.0], 0), (2, [1.0], 1)]) == {(100, 3, 1, 2, 65536, 65536): 1}


@pytest.mark.parametrize(("width", "size"), [(1, 2**30), (64, 300), (1500, 40), (5000, 100_000)])
def test_products_are_exact(width, size):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-size, size, (5, width)), rng.integers(-size, size, (7, width))
    a[0], b[0] = size, -size  # the largest score there is
    left, right = hard_negatives._both(a, b)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert left.scores(right, slice(None)).tolist() == want
    assert len(left.primes) >= (1 if size < 4 else 2)


def test_rows_that_are_too_large_take_no_part(spark):
    rows = [(100, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1e30, 0.0], 0), (3, [1e7, 0.0], 0), (4, [1.0, 1.0], 1)]
    assert mined(spark, rows) == plain_mine([r for r in rows if r[0] not in (2, 3)])


# --- the manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hashed(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def reduced(nodes):
    """All levels of a tree, and for each node of the lowest what stands beside it on its way."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    ways = []
    for k in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            run = k // 3 * 3
            way.append(("".join(level[run:k]), "".join(level[k + 1 : run + 3])))
            k //= 3
        ways.append(way)
    return levels[-1][0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, hashed(r)))
        trees[s] = (own, *reduced([hashed(r) for r in own]))
    root, tops = reduced([trees[s][1] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops, strict=True):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways, strict=True):
            even = zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 2 == 0
            changed = even and r[4] is not None
            folded = hashed((*r[:4], r[4].replace("\n", ""))) if changed else hashed(r)
            for before, after in way + top:
                folded = h(before + folded + after)
            out.append((r[0], hashed(r), subroot, root, h("".join(b + a for b, a in way + top)), folded, folded == root))
    return Counter(out)


def manifested(spark, rows, **settings):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree int, word string, leaf int"
    docs = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], schema).repartition(3)
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return merkle.manifest(docs, F.when(even, F.translate("text", "\n", "")), **settings)


KEYS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_with_awkward_rows(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "a\nb", "日本\n", "x" * 5000 + "\n", "plain"])
    rows = [(rng.choice([-(2**63), -5, 0, 2**62, *range(40, 300)]), rng.choice([None, "", "a", "b", "é", "\U0001f600", "￿"]), rng.choice([None, "en"]), rng.choice([None, 7]), text()) for _ in range(400)]
    rows += rows[:30] + [(None, "a", None, None, text()) for _ in range(9)] + [(None, None, None, None, None)] * 3
    got = manifested(spark, rows).collect()
    assert Counter(tuple(r[k] for k in KEYS) for r in got) == plain_manifest(rows)
    for r in got:  # the siblings that are returned prove the leaf
        at = r.leaf
        for k in range(0, len(r.beside), 2):
            at = h(r.beside[k] + at + r.beside[k + 1])
        assert at == r.root


def test_manifest_of_several_arrays(spark):
    """More leaves than two arrays hold in one source, more sources than one array holds, ids far apart."""
    rng = random.Random(4)
    rows = [(i * 70_000_003 - 10**10, "large", "en", i, f"t{i}\n") for i in range(1500)] + [(i, f"s{rng.randrange(10**6)}", None, 1, "x") for i in range(800)]
    rng.shuffle(rows)
    got = manifested(spark, rows, keep_proofs=False).collect()
    assert Counter(tuple(r[k] for k in KEYS) for r in got) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_manifest_of_few(spark, n):
    rows = [(i, "s", "en", 1, "a\n") for i in range(n)]
    assert Counter(tuple(r[k] for k in KEYS) for r in manifested(spark, rows).collect()) == plain_manifest(rows)


# --- mixing


def plain_targets(sizes, most=3):
    """Shares by weight, the excess over the limit shared anew until none is above. Fractions."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, weights = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        share = {s: Fraction(most * sizes[s]) if s in full else Fraction(rest * weight[s], weights) for s in names}
        above = {s for s in names if share[s] > most * sizes[s]}
        if not above:
            return share
        full |= above


def plain_mix(rows):
    size = [len(WORD.findall(t or "")) for _, _, t in rows]
    sums = Counter()
    for (_, s, _), n in zip(rows, size, strict=True):
        sums[s] += n
    targets = plain_targets(sums)
    out = []
    for s in sums:
        budget, own = math.floor(targets[s]), []
        for (i, source, _), n in zip(rows, size, strict=True):
            if source == s:
                own.append((int(h("" if i is None else str(i))[:15], 16), i is not None, i or 0, n, i))
        epochs, over = divmod(budget, sums[s]) if sums[s] else (0, 0)
        start = 0
        for _, _, _, n, i in sorted(own, key=lambda x: x[:4]):
            out.append((i, s, n, sums[s], round(float(targets[s]), 6), epochs * n + max(0, min(n, over - start))))
            start += n
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "k", 2) for i, s, t in rows], "doc_id long, source string, text string, size int, key string, place int").repartition(3)


def mixed(found):
    return Counter((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found.collect())


def sample(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " \n\t ", " ".join("w" for _ in range(rng.randint(1, 60))), "é\xa0b c\x0bd"])
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", "", None, "￿", "\U0001f600"]), text()) for i in range(600)]
    return rows + [(1, "a", "one two three")] * 40 + rows[:20] + [(None, "b", "x y")] * 3 + [(9, "void", None), (8, "tiny", "word")]


@pytest.mark.parametrize(("seed", "range_rows"), [(1, 50_000), (2, 7), (3, 1)])
def test_mix(spark, seed, range_rows):
    rows = sample(seed)
    got = mixed(mixing.mix_sources(table(spark, rows), range_rows=range_rows))
    assert got == plain_mix(rows)
    assert got == mixed(mixing.mix_sources(table(spark, rows[::-1]), range_rows=range_rows))  # reruns agree


@pytest.mark.parametrize("copies", [1, 7, 1000])
def test_mix_of_equal_rows_at_the_cut(spark, copies, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    rows = [(5, "a", "one two three")] * copies + [(6, "b", "w " * 40), (7, "c", "w " * 3 * copies)]
    assert mixed(mixing.mix_sources(table(spark, rows))) == plain_mix(rows)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(table(spark, [])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix_sources(table(spark, [(1, "a", None), (2, None, "")])).collect()] == [(0.0, 0)] * 2


def test_mixed_documents_have_the_words_that_are_taken(spark):
    rows = sample(5)
    taken = Counter()
    for (i, s, n, _, _, t), times in plain_mix(rows).items():
        taken[i, s, n] += t * times
    found, texts = Counter(), {}
    for i, s, t in rows:
        texts.setdefault((i, s), set()).add(t)
    for r in mixing.mixed_documents(table(spark, rows)).collect():
        whole = next(t for t in texts[r.doc_id, r.source] if t and t.startswith(r.text))
        n = len(WORD.findall(whole))
        found[r.doc_id, r.source, n] += len(WORD.findall(r.text))
        assert 1 <= r.epoch <= 3
    assert {k: n for k, n in taken.items() if n} == found


def test_numbered(spark):
    with_gaps = spark.createDataFrame([(f"k{i * 7 % 1000:04d}",) for i in range(1000)] + [(None,)], "name string")
    scratch = C.Scratch(spark)
    found = C.numbered(with_gaps, F.col("name").asc_nulls_last(), scratch).collect()
    assert sorted((r.place, r.name) for r in found) == [*((i, f"k{i:04d}") for i in range(1000)), (1000, None)]
