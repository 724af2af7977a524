"""Each operator against a plain model on small fixtures with the awkward cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import common as C
from quillstone.llm import decontaminate, fm_index, graph, interpolation, line_dedup, near_dedup, pieces, quality, secrets, substring_dedup, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return words((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, repeated passages and lines; null and empty ones; ties and repeated rows."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mi", "né", "SU", "日", "ta") for b in ("ra", "n", "pel", "x")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, lines = sentence(30), "\n".join(sentence(6) for _ in range(4))
    texts = [sentence(rng.randint(1, 90)) for _ in range(40)]
    texts += [sentence(20) + " " + passage + " " + sentence(9) for _ in range(4)]
    texts += [sentence(5) + "\n" + lines + "\n\n" + sentence(7) for _ in range(4)]
    base = sentence(80).split(" ")
    for k in range(6):
        copy = list(base)
        copy[k * 9] = f"changed{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 3 + ["one two", "one two", "ONE TWO", "", None, " \n\t ", "a b a b a b " * 30, passage + " " + passage, "x" * 3000, " nbsp em " * 9]
    out = list(enumerate(texts))
    out += [(3, texts[3]), (3, texts[3]), (5, "other text of an id that is there"), (None, texts[41]), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """documents with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, row string, class string, block int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", 1) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# --- op1


def brute_base(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1:
            counts.update([*low(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*low(t), "\n"]
        out.append((i, zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    return out


def test_interpolation_base(docs, rows, empty):
    got = interpolation.score_documents(docs, block_bytes=2000, range_entries=100)
    assert sorted(map(repr, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()))) == sorted(map(repr, brute_base(rows)))
    assert interpolation.score_documents(empty).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_scores(docs, rows, order, monkeypatch):
    """The scores are those of a plain model with the weights that were fitted."""
    fitted = []
    fit = interpolation.fit
    monkeypatch.setattr(interpolation, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[0])
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in interpolation.score_documents(docs, order=order, block_bytes=2000, range_entries=100).collect())
    weights = fitted[0]
    assert all(abs(w.sum() - 1) < 1e-9 for w in weights.known.values())
    pad = ["<"] * max(1, order - 1)
    counts = [Counter() for _ in range(order + 1)]
    contexts = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1:
            tokens = pad + low(t) + ["\n"]
            for k in range(len(pad), len(tokens)):
                for n in range(1, order + 1):
                    counts[n][tuple(tokens[k - n + 1 : k + 1])] += 1
                    contexts[n][tuple(tokens[k - n + 1 : k])] += 1
    total, v = sum(counts[1].values()), len(counts[1])
    want = Counter()
    for i, t in rows:
        tokens = pad + low(t) + ["\n"]
        score = 0.0
        for k in range(len(pad), len(tokens)):
            parts, bucket = [1 / (v + 1), counts[1][(tokens[k],)] / total], 1
            for n in range(2, order + 1):
                # a context at the begin of a text stands for the begin alone
                before = contexts[n][tuple(tokens[k - n + 1 : k])] if k > len(pad) else sum(x for c, x in contexts[n].items() if set(c) == {"<"})
                parts.append(counts[n][tuple(tokens[k - n + 1 : k + 1])] / before if before else 0)
                bucket = 64 * (n - 1) + int(math.log2(before)) if before else bucket
            score += math.log10(float(weights.of(bucket) @ np.array(parts)))
        want[i, len(tokens) - len(pad), round(score, 6)] += 1
    assert got == want


def test_interpolation_counts_beyond_32_bits():
    """Two cells whose counts add up to more than 2**32."""
    h = np.array([5, 9], np.uint64)
    cells = [(0, k, interpolation.KEPT, C.pack_sorted(h), C.pack(np.array([3 << 31, 7], np.uint64))) for k in range(2)]
    out = interpolation._count(4)(C.arrow(interpolation._CELLS, cells)).to_pylist()
    assert [C.unpack(r["total"], np.uint64).tolist() for r in out if r["block"] is not None] == [[3 << 32, 14]] * 2
    assert out[-1]["n"] == (3 << 32) + 14 and out[-1]["v"] == 2


def test_interpolation_of_many_equal_rows_and_a_long_text(spark):
    """Rows that are all alike fall into many blocks; a text far beyond a block is scored whole."""
    rows = [(None, None)] * 400 + [(7, "a b a b")] * 300 + [(8, "c d " * 30_000)]
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in interpolation.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=3000, range_entries=100).collect())
    assert got == Counter(brute_base(rows))


def test_interpolation_beats_base_on_held_out(spark):
    rng = random.Random(1)
    chain = {w: [f"w{rng.randrange(40)}" for _ in range(2)] for w in (f"w{k}" for k in range(40))}
    rows = []
    for i in range(200):
        w = f"w{rng.randrange(40)}"
        text = [w]
        for _ in range(60):
            w = rng.choice(chain[w])
            text.append(w)
        rows.append((i, " ".join(text)))
    got = interpolation.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum() + 0.5


# --- op2


def brute_statistics(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = Counter(zip(w, w[1:], w[2:], strict=False))
    in_repeat = [False] * len(w)
    for k in range(len(w) - 2):
        if counts[w[k], w[k + 1], w[k + 2]] > 1:
            in_repeat[k : k + 3] = [True] * 3
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(in_repeat)


def test_quality_statistics(rows):
    texts = [t for _, t in rows] + ["#a $b\n#a $b\n\n#a $b", "x\ny\nx\r\nx"]
    counts, features = quality.statistics([t if t is None else t.encode() for t in texts])
    assert [tuple(int(counts[c][k]) for c in quality.STATISTICS) for k in range(len(texts))] == [brute_statistics(t) for t in texts]
    assert np.isfinite(features).all()


def test_quality_verdicts(spark, docs, empty):
    rng = random.Random(3)
    good = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(120)), 1) for i in range(300)]
    bad = [(i, " ".join(f"w{rng.randrange(500)}$$$" for _ in range(120)), 0) for i in range(300, 360)]
    short = [(i, "too short", 1) for i in range(360, 370)]
    own = spark.createDataFrame([(i, t, 0) for i, t, _ in good + bad + short], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in (good + bad + short)[::2]] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge_documents(own, labels).collect()}
    assert all(got[i].kept for i, *_ in good) and not any(got[i].kept for i, *_ in bad) and all(got[i].base_failed for i, *_ in short)
    assert sorted(r.doc_id for r in quality.keep_good(own, labels).collect()) == sorted(i for i, *_ in good)
    assert quality.keep_good(own, labels).columns == own.columns
    none = labels.limit(0)
    assert all(r.kept == (not r.base_failed) for r in quality.judge_documents(docs, none).collect())
    assert quality.judge_documents(empty, none).collect() == []


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    points = np.concatenate((rng.normal(0, 1, (500, 3)), [[9, 9, 9]]))
    scores = quality.Forest(points[:500], points.min(axis=0), points.max(axis=0)).scores(points)
    assert scores[-1] == scores.max() > 0.6 > np.median(scores)


def brute_score(forest, point):
    """The mean path down all trees, a node at a time."""
    paths = []
    for root in forest.roots:
        at = root
        while forest.feature[at] >= 0:
            at = forest.left[at] if point[forest.feature[at]] <= forest.split[at] else forest.right[at]
        paths.append(forest.path[at])
    return 2.0 ** (-np.mean(paths) / forest.usual)


def brute_threshold(scores, good, share):
    """All thresholds that reject no more than the share of the good; of those that reject most of the bad the highest kind."""
    options = [t for t in [*scores, max(scores)] if sum(s > t for s, g in zip(scores, good, strict=True) if g) <= int(share * sum(good))]
    most = max(sum(s > t for s, g in zip(scores, good, strict=True) if not g) for t in options)
    return most, {k for k, (s, g) in enumerate(zip(scores, good, strict=True)) if not g and s > min(options)}


def test_quality_verdict_is_that_of_plain_trees(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(200)}" + ("$" * rng.randrange(3) if i % 5 == 0 else "") for _ in range(rng.randint(30, 150))) for i in range(400)]
    texts += [None, "", "a b c " * 40, "#" * 4000, ("word " * 60 + "\n") * 3]
    own = spark.createDataFrame([*enumerate(texts), (0, texts[1]), (None, texts[2])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    judge = quality.fit(own, labels, most_good_rejected=0.05)
    assert judge.forest is not None
    got = Counter((r.doc_id, r.base_failed, round(r.anomaly, 9), r.kept) for r in quality.judge_documents(own, labels, most_good_rejected=0.05).collect())
    want = Counter()
    for i, t in [*enumerate(texts), (0, texts[1]), (None, texts[2])]:
        n, _, _, _, repeats = brute_statistics(t)
        failed = n < 50 or 100 * repeats > 50 * n
        score = brute_score(judge.forest, quality.statistics([t and t.encode()])[1][0])
        want[i, failed, round(score, 9), not failed and score <= judge.threshold] += 1
    assert got == want
    assert sum(n for (i, failed, _, kept), n in got.items() if not failed and not kept) > 20


def test_all_labels_are_used(spark):
    """Thresholds and ranks of tables are those of lists, and a label beyond the first 20,000 by hash counts, too."""
    rng = np.random.default_rng(5)
    for k in range(3):
        scores, good = np.round(rng.random(400), 2 + 6 * (k % 2)), rng.random(400) < 0.7
        rows = spark.createDataFrame(list(zip(good.tolist(), scores.tolist(), strict=True)), "good boolean, score double")
        assert quality.threshold_of(rows, 0.1, 8, 5) == quality.threshold(scores, good, 0.1)
        assert [quality.nth_largest(rows, n, 4, 3) for n in (0, 17, 399)] == [np.sort(scores)[::-1][n] for n in (0, 17, 399)]
    n = 24_000
    own = spark.range(n).selectExpr("id AS doc_id", "repeat(concat('word', id % 97, ' '), 1) || array_join(transform(sequence(1, 60), x -> concat('w', (id * x) % 1009)), ' ') AS text")
    first = spark.range(n).selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id").limit(20_000).selectExpr("id AS doc_id", "1 AS first")
    labels = spark.range(n).selectExpr("id AS doc_id").join(first, "doc_id", "left").selectExpr("doc_id", "coalesce(first, 0) AS quality", "0 AS toxic")
    assert quality.fit(own, labels).forest is not None  # all documents labelled bad lie beyond the first 20,000


def test_threshold_is_calibrated():
    rng = np.random.default_rng(4)
    for _ in range(50):
        scores, good = np.round(rng.random(60), 2), rng.random(60) < 0.7
        good[:2] = True, False
        at = quality.threshold(scores, good, 0.1)
        most, _ = brute_threshold(scores, good, 0.1)
        assert (scores[~good] > at).sum() == most and (scores[good] > at).sum() <= int(0.1 * good.sum())


# --- op3


def brute_secrets(text, reach=200):
    """Patterns and rules written anew: base spans, then weak ones that stand alone and have a part beside them."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    names = r"(?:[cC]lient|[aA]ccount|[uU]ser|[lL]ogin|[kK]ey)_?(?:[iI][dD]|[nN]ame)"
    ids = [(m.start(), 3, m.end()) for m in re.finditer(rf"""A(?:SIA|IDA|ROA|GPA|NPA)[A-Z0-9]{{12,}}|{names}["']? *[:=] *["']?[A-Za-z0-9@._-]{{3,}}""", text)]
    keys = [(m.start(), 4, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20 and all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    hosts = [(m.start(), 5, m.end()) for m in re.finditer(r"""(?:https?|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[a-z0-9.-]+\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)""", text)]
    cross = lambda x, ys: any(y[0] < x[2] and x[0] < y[2] for y in ys)
    weak = [x for x in hosts if not cross(x, base)] + [x for x in ids if not cross(x, base + hosts)] + [x for x in keys if not cross(x, base + hosts + ids)]
    parts = {"secret": [x for x in base if x[1] != 1], "identifier": [x for x in base if x[1] == 1 and not cross(x, [y for y in base if y[1] != 1])], "endpoint": []}
    for x in weak:
        parts[{3: "identifier", 4: "secret", 5: "endpoint"}[x[1]]].append(x)
    near = lambda x, c: any(-1 < (x[0] - y[2] if y[2] <= x[0] else y[0] - x[2]) <= reach for y in parts[c] if not cross(x, [y]))
    rule = {3: lambda x: near(x, "secret"), 4: lambda x: near(x, "identifier") or near(x, "endpoint"), 5: lambda x: near(x, "secret") and near(x, "identifier")}
    found = sorted(base + [x for x in weak if rule[x[1]](x)])
    joined = lambda xs: ",".join(f"{('assign', 'access', 'hex', 'id', 'key', 'host')[k]}:{a}:{b}" for a, k, b in xs)
    return *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(joined(sorted(base)).encode()).hexdigest(), joined(found), len(found) - len(base)


def test_secrets(spark, docs, rows, empty):
    key, access = "Zx9" + "aB3dE5gH7jK9mN1pQ3", "AKIA" + "ABCDEFGH12345678"
    texts = [
        f"é日 password = 'abcdefgh1' and {access} then {'0a' * 20}", f"{access} near {key} and https://host.example/x", f"{key} alone", "https://alone.example/x", f"client_id: bob42 {'x ' * 150} {key}",
        f"client_id: bob42 {key} db at s3://bucket/key", "token=secret=short password: token: abcdefghijk", "api-key=abcdefghij apikey:abcdefghij API_KEY = 1234567", f"secret={key}", "AKIA123 AKIAAKIAAKIAAKIA", f"user_name=joe {'ab12' * 10} " * 40, "",
        "user_name=JohnSmith1234567890abcd", f"see https://host.example/{key}/index for more", f"token={access} https://host.example/a", f"https://h.example/?user_id=bob42&x=1 {key} {access}", f"x{key}{key} user_id=ann42", "y" * 30_000 + f" {access} {key} " + "z9Z" * 9000,
    ]
    own = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id long, text string")
    got = Counter(tuple(r) for r in secrets.find_secrets(own).collect())
    assert got == Counter((i, *brute_secrets(t)) for i, t in [*enumerate(texts), (0, texts[0]), (None, texts[1])])
    assert sum(r[-1] for r in got) > 5
    linked = {r[0]: r[-1] for r in got if r[0] is not None}
    assert linked[12] == linked[13] == linked[14] == 0, "what completes a part must not be the part itself"
    assert Counter(tuple(r) for r in secrets.find_secrets(docs).collect()) == Counter((i, *brute_secrets(t)) for i, t in rows)
    assert secrets.find_secrets(empty).collect() == []


# --- op4


def test_token_counts(docs, rows, empty):
    model = token_counts.model_at("piece_bpe_32k.model")
    want = Counter((i, len((t or "").encode()), n := model.count((t or "").encode()), n > 50) for i, t in rows)
    for chunk, over in ((1 << 20, 256), (64, 8), (200, 1)):
        assert Counter(tuple(r) for r in token_counts.count_tokens(docs, limit=50, chunk_bytes=chunk, overlap_bytes=over).collect()) == want
    assert token_counts.count_tokens(empty).collect() == []


def test_token_counts_splice_anywhere():
    model = token_counts.model_at("piece_bpe_32k.model")
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "  ", "the", "\n", "\n\n", "é", "日本", "<s>", "\t", " the quick", "▁", " "]) for _ in range(rng.randint(0, 90))).encode()
        for chunk, over in ((16, 4), (40, 8)):
            assert token_counts.count_in_chunks(model, text, chunk, over) == model.count(text)


def test_token_counts_without_spaces():
    """Line breaks alone are boundaries enough: no more than a few chunks are encoded at once."""
    model = token_counts.model_at("piece_bpe_32k.model")
    text = "\n".join(f"word{k}" for k in range(3000)).encode()
    seen = []
    ends = model.ends
    model.ends = lambda t, a, b: seen.append(b - a) or ends(t, a, b)
    try:
        assert token_counts.count_in_chunks(model, text, 500, 20) == model.count(text)
    finally:
        del model.ends
    assert max(seen) < 1500
    assert token_counts.count_in_chunks(model, b"x" * 9000 + b"\xff", 500, 20) == model.count(b"x" * 9000 + b"\xff")


# --- op5


def brute_scores(items, passage, threshold):
    """BM25 of each item for the distinct words of a passage, as shares of its own."""
    tf = {i: Counter(decontaminate.words_of(t)) for i, t in items}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    out = {}
    for i, c in tf.items():
        n = sum(c.values())
        part = {w: math.log1p((len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * f * (decontaminate.K1 + 1) / (f + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * n / mean)) for w, f in c.items()}
        score = sum(x for w, x in part.items() if w in passage) / sum(part.values())
        if score >= threshold:
            out[i] = score
    return out


def test_wand_finds_all_above_threshold():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    pick = lambda n: " ".join(vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    items = [(i, pick(rng.randint(5, 40))) for i in range(70)]
    for threshold in (0.3, 0.6, 0.9):
        index = decontaminate.Index(items, threshold)
        half = index.passage_words // 2
        texts = [pick(90) + " " + items[k][1] + " " + pick(60) for k in range(40)] + [pick(3), ""]
        for text in texts:
            own = decontaminate.words_of(text)
            ids = np.full((math.ceil(len(own) / half) + 2) * half, -1, np.int64)
            ids[: len(own)] = [index.vocabulary.get(w, -1) for w in own]
            p, i, s = index.retrieve(ids)
            got = {(a, index.items[b]): round(c, 9) for a, b, c in zip(p.tolist(), i.tolist(), s.tolist(), strict=True)}
            want = {(a, b): round(c, 9) for a in range(len(ids) // half) for b, c in brute_scores(items, set(own[a * half : (a + 2) * half]), threshold).items()}
            assert got == want


def test_one_changed_word_in_a_short_answer():
    question = "which of the old harbour towers was rebuilt by the masons after the great winter storm of that year"
    for n in range(5, 9):
        answer = [f"answer{k}" for k in range(n)]
        index = decontaminate.Index([(1, f"{question}? {' '.join(answer)}.")])
        assert len(index.parts[0][1]) == n
        for k in range(n):
            changed = [*answer[:k], "other", *answer[k + 1 :]]
            assert [m.item_id for m in index.search([f"{question}? {' '.join(changed)}."])[0]] == [1], (n, k)
        assert index.search([f"{question}? {' '.join(f'x{k}' for k in range(n))}."]) == [[]]


def test_leaks(spark, docs, empty):
    items = [(1, "What is the largest moon of the planet Saturn and who found it? It is Titan, found by Huygens in 1655."), (2, "Name the author of the tale of the white whale. Herman Melville wrote it in the nineteenth century."), (None, "no id"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = "entirely different words fill this document from here on " * 20
    texts = [filler + items[0][1].upper() + filler, filler, items[1][1], items[0][1].split("?")[0], None, ""]
    own = spark.createDataFrame([(i, t, 7) for i, t in [*enumerate(texts), (0, texts[0]), (None, items[1][1])]], "doc_id long, text string, item_id int")
    for shard_bytes in (1 << 20, 100):
        assert Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(own, bench, shard_bytes=shard_bytes).collect()) == Counter([(0, 1), (0, 1), (2, 2), (None, 2)])
        assert Counter(r.doc_id for r in decontaminate.without_leaks(own, bench, shard_bytes=shard_bytes).collect()) == Counter([1, 3, 4, 5])
    assert decontaminate.find_leaks(empty, bench).collect() == [] and decontaminate.find_leaks(docs, bench.limit(0)).collect() == []


def brute_leaks(items, texts, passage_words=128, threshold=0.6, least=0.5):
    """Every item against every passage, over all items' statistics."""
    items = sorted({(i, t) for i, t in items if i is not None and decontaminate.words_of(t)})
    words = re.compile(r"\w+")
    longest = max(len(words.findall(t)) for _, t in items)
    half = max(passage_words, 2 * longest) // 2
    keys = [f"{i} {t}" for i, t in items]

    def share(part, passage):
        n = 3 if len(part) >= 8 else 2 if len(part) >= 5 else 1
        own = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
        return len([x for x in own if any(tuple(passage[k : k + n]) == x for k in range(len(passage)))]) / len(own)

    out = Counter()
    for d, t in texts:
        w = words.findall((t or "").lower())
        best = {}
        for at in range(0, max(1, len(w)), half):
            passage = w[at : at + 2 * half]
            for key, score in brute_scores(list(zip(keys, [x for _, x in items], strict=True)), set(passage), threshold - 1e-9).items():
                item, text = items[keys.index(key)]
                question, answer = decontaminate.question_and_answer(text)
                if share(question, passage) >= least and share(answer, passage) >= least and round(score, 9) > best.get(key, (0, 0, 0))[0]:
                    best[key] = round(score, 9), item, at
        out.update((d, item, score, at) for score, item, at in best.values())
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1500, 300])
def test_leaks_are_the_same_however_items_are_cut(spark, shard_bytes):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    pick = lambda n: [vocabulary[min(399, int(rng.expovariate(0.01)))] for _ in range(n)]
    items = [(i, " ".join(pick(rng.randint(12, 40)))) for i in range(60)] + [(60, "one two three four five six. seven eight nine ten eleven")]
    texts = []
    for i, t in items:  # copies from whole to half, around the threshold
        w = t.split(" ")
        for share in (1, 0.85, 0.75, 0.65, 0.55):
            gone = set(rng.sample(range(len(w)), int((1 - share) * len(w))))
            texts.append((len(texts), " ".join([*pick(rng.randint(0, 300)), *(f"other{rng.random()}" if k in gone else x for k, x in enumerate(w)), *pick(30)])))
    texts += [(3, texts[3][1]), (None, items[0][1]), (900, None), (901, ""), (902, "long " * 40_000 + items[5][1])]
    own = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, items[0], (None, "no id at all in here"), (70, None), (71, "?!")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, round(r.score, 9), r.first_word) for r in decontaminate.find_leaks(own, bench, shard_bytes=shard_bytes).collect())
    assert got == brute_leaks(items, texts)
    assert 80 < len(got) < 290
    left = Counter((r.doc_id, r.text) for r in decontaminate.without_leaks(own, bench, shard_bytes=shard_bytes).collect())
    leaked = Counter(d for d, *_ in brute_leaks(items, texts))
    assert left == Counter((d, t) for d, t in texts if d not in leaked)


def test_long_items_change_nothing_for_others(spark):
    """A long item has passages of its own length: with or without it the others leak from the same documents, and it is found itself."""
    rng = random.Random(13)
    vocabulary = [f"v{k}" for k in range(5000)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    short, long = pick(40), pick(600)
    parts = [short[k : k + 5] for k in range(0, 40, 5)]
    scattered = [w for part in parts for w in [*part, *(f"x{rng.random()}" for _ in range(38))]]
    texts = [(1, " ".join(scattered)), (2, " ".join([*pick(50), *short, *pick(9)])), (3, " ".join([*pick(700), *long, *pick(2000)])), (4, " ".join(long[:200])), (5, "a"), (6, ""), (7, None), (8, " ".join(pick(30_000) + long))]
    own = spark.createDataFrame(texts, "doc_id long, text string")
    items = [(1, " ".join(short)), (2, " ".join(pick(30)))]
    found = lambda bench, size: {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(own, spark.createDataFrame(bench, "item_id long, text string"), shard_bytes=size).collect()}
    for size in (1 << 22, 300_000):
        assert found(items, size) == {(2, 1)}
        assert found([*items, (3, " ".join(long)), (4, " ".join(pick(100_000)))], size) == {(2, 1), (3, 3), (8, 3)}


# --- op6


def test_viterbi_is_optimal():
    """Against all segmentations; ties go to the longest last piece."""
    scored = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.5, "aba": -3.5, "▁": -1.0, "▁a": -1.8, "bb": -3.0}
    own = pieces.Pieces({p: (k + 300, s) for k, (p, s) in enumerate(scored.items())}, list(range(256)))

    def best(word):
        if not word:
            return 0.0, ()
        options = [(best(word[:-n])[0] + scored[word[-n:].replace(" ", "▁")], best(word[:-n])[1] + (word[-n:],)) for n in range(1, 4) if word[-n:].replace(" ", "▁") in scored and n <= len(word)]
        options.append((best(word[:-1])[0] + own.unknown, best(word[:-1])[1] + (word[-1:],)))
        top = max(s for s, _ in options)
        return next((s, p) for s, p in sorted(options, key=lambda x: -len(x[1][-1])) if s == top)

    for n in range(1, 6):
        some = ["".join(x) for x in itertools.product("ab z", repeat=n)]
        found = own._solve(some)
        for word, ids, same in zip(some, found, own._solve_long(some), strict=True):
            assert ids == same
            want = [own.pieces[p][0] if p in own.pieces else p.encode()[0] for p in best(word)[1]]
            assert ids == want, word


def plain_search(own, word):
    """One word, a character at a time."""
    sums, back, ids = [0], [0], [None]
    for j in range(1, len(word) + 1):
        options = [(sums[i] + own.pieces[word[i:j]][1], -i, own.pieces[word[i:j]][0]) for i in range(max(0, j - own.longest), j) if word[i:j] in own.pieces]
        options.append((sums[-1] + own.unknown, -j, None))
        best = max(options, key=lambda x: x[:2])
        sums.append(best[0])
        back.append(-best[1] if best[2] is not None else j - 1)
        ids.append(best[2])
    out, j = [], len(word)
    while j:
        out = ([ids[j]] if ids[j] is not None else [own.byte_ids[b] for b in word[back[j] : j].encode()]) + out
        j = back[j]
    return out


def test_long_words_by_stretches(monkeypatch):
    """Stretches give what one search from the word's begin gives, whatever they meet."""
    rng = random.Random(6)
    monkeypatch.setattr(pieces, "LONGEST_TOGETHER", 7)
    toy = pieces.Pieces({p: (k + 300, s) for k, (p, s) in enumerate({"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.5, "aba": -3.5, "▁": -1.0, "bb": -3.0, "aaaa": -4.0}.items())}, list(range(256)))
    some = ["".join(rng.choice("ab z") for _ in range(rng.randint(1, 90))) for _ in range(300)] + ["a" * 200, "ab" * 99, "z" * 70]
    assert toy._solve_long(some) == [plain_search(toy, w) for w in some]
    monkeypatch.setattr(pieces, "LONGEST_TOGETHER", 96)
    real = pieces.encoder_at("piece_bpe_32k.model").pieces
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(97, 900))) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdefABCDEF+/=", "the日本é", "-=") for _ in range(5)] + ["-" * 1500, "word" * 300]
    assert real._solve_long(some) == [plain_search(real, w) for w in some]


def test_decode_is_the_inverse(spark, docs, rows):
    encoded = pieces.encode_documents(docs)
    got = Counter((r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect())
    assert got == Counter((i, t or "") for i, t in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (None, [10**6])], "doc_id long, ids array<int>")
    assert Counter((r.doc_id, r.text) for r in pieces.decode_documents(odd).collect()) == Counter([(1, None), (2, ""), (None, "")])


def test_pieces_round_trip(docs, rows, empty):
    got = pieces.encode_documents(docs).collect()
    assert Counter((r.doc_id, r.n_tokens == len(r.ids), r.round_trip) for r in got) == Counter((i, True, True) for i, _ in rows)
    own = pieces.encoder_at("piece_bpe_32k.model").pieces
    library = token_counts.model_at("piece_bpe_32k.model").processor
    texts = {i: t for i, t in rows if i is not None and i > 5}
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
        if r.doc_id in texts:
            assert own.decode(r.ids).decode() == (texts[r.doc_id] or "") == library.decode(r.ids)
    assert pieces.encode_documents(empty).collect() == []


# --- op7


def pages_rows():
    big, small = "é" * 80, "tiny"
    return [(5, "u", big), (2, None, big), (9, "a\r\nb", big), (7, "x", small), (8, "y", small), (1, "z", None), (3, "q", ""), (4, "http://a", "<p>\r\n\r\nWARC/1.1</p>" * 20), (None, "n", big), (2, "again", big), (None, "m", "only nulls " * 20), (None, "m", "only nulls " * 20)]


def brute_pages(rows):
    groups = defaultdict(list)
    payload = lambda h: (h or "").encode()
    for p, _, h in rows:
        groups[payload(h)].append(p)
    out = []
    for p, _, h in rows:
        first = min((x for x in groups[payload(h)] if x is not None), default=None)
        revisit = len(payload(h)) >= 100 and first is not None and p != first
        out.append((p, len(payload(h)), hashlib.sha256(payload(h)).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


def test_warc_pages(spark):
    rows = pages_rows()
    own = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string").repartition(3)
    assert Counter(tuple(r) for r in warc.archive_and_read(own).collect()) == brute_pages(rows)
    assert warc.archive_and_read(own.limit(0)).collect() == []


def test_warc_push_down_and_foreign_files(spark, tmp_path):
    import gzip

    records = [warc.record("response", f"<urn:x:{k}>", f"payload {k}".encode() * 50, "d" * 64, f"http://h{k % 2}/p", "2024-01-01T00:00:00Z", None, 450) for k in range(6)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records[:2]))
    (tmp_path / "usual.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[2:4]))
    (tmp_path / "own.warc.gz").write_bytes(b"".join(warc.member(r) for r in records[4:]))
    (tmp_path / "ignored.txt").write_text("no archive")
    warc.register(spark)
    read = spark.read.format("warc").option("partition_bytes", 1)
    full = {r.record_id: r for r in read.load(str(tmp_path)).collect()}
    assert {k: full[f"<urn:x:{k}>"].payload for k in range(6)} == {k: f"payload {k}".encode() * 50 for k in range(6)}
    assert full["<urn:x:3>"].headers["WARC-Type"] == "response" and full["<urn:x:3>"].payload_digest == "d" * 64
    some = read.schema("record_id string, target_uri string").load(str(tmp_path)).where("target_uri LIKE 'http://h1%'")
    assert sorted(r.record_id for r in some.collect()) == ["<urn:x:1>", "<urn:x:3>", "<urn:x:5>"]
    assert spark.read.format("warc").load(str(tmp_path)).where("record_type = 'revisit'").count() == 0


def test_warc_unwanted_payload_is_not_inflated(tmp_path):
    """A member whose body is broken can be passed over, as its length is known."""
    good, broken = (warc.record("response", f"<urn:x:{k}>", b"p" * 100_000, "d", None, "t", None, 9) for k in range(2))
    member = bytearray(warc.member(broken))
    member[-200:-20] = b"\xff" * 180
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.member(good) + bytes(member) + warc.member(good))
    with path.open("rb") as f:
        assert len(list(warc.rows_of(f, warc._Wanted(["record_id"])))) == 3


# --- op8


def brute_repeats(rows, width):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, __import__("xxhash").xxh3_64_intdigest((r[1] or "").encode())))
    seen, out = set(), {}
    for i, t in order:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen:
                gone[k : k + width] = [True] * width
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out[i, t] = (i, len(w), sum(gone), kept)
    return Counter(out[r] for r in rows)


@pytest.mark.parametrize(("width", "seed", "frequent"), [(20, 8, 10**6), (5, 2, 10**6), (5, 2, 2)])
def test_repeats(docs, rows, empty, width, seed, frequent):
    got = substring_dedup.remove_repeats(docs, width=width, seed=seed, block_bytes=1500, shard_bytes=1500, frequent=frequent).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, width)
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() and sum(x.stop - x.start for x in r.removed) == r.n_removed
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(15):
        text = rng.integers(2, 6, 200)
        text[rng.integers(0, 200, 10)] = fm_index.SEPARATOR
        whole = np.concatenate((text, [fm_index.SEPARATOR, fm_index.END]))
        index = fm_index.FMIndex(whole[:-1], 8)
        order = sorted(range(len(whole)), key=lambda j: (tuple(whole[j : j + 8]), j))
        lengths = rng.integers(1, 30, 12)
        query = rng.integers(2, 8, lengths.sum())
        query[query > 6] = 0
        found, lowest = index.matching_statistics(query, lengths, 7)
        for start, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
            for i in range(n):
                part = query[start + i : start + n]
                best = max((m for m in range(1, min(7, n - i) + 1) if (part[:m] > 1).all() and any((whole[j : j + m] == part[:m]).all() for j in range(len(whole) - m + 1))), default=0)
                assert found[start + i] == best
                if best:
                    at = order[lowest[start + i]]
                    assert (whole[at : at + best] == part[:best]).all()


# --- op9


def brute_near(rows):
    def shingles(t):
        w = low(t)
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    out = []
    for k, (i, _) in enumerate(rows):
        reach = [rows[j][0] for j in range(len(rows)) if find(j) == find(k)] if sets[k] else [i]
        component = min((x for x in reach if x is not None), default=None)
        out.append((i, len(sets[k]), component, i == component))
    return Counter(out)


def test_near_duplicates(docs, rows, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows)
    assert near_dedup.near_duplicates(empty).collect() == []
    left = near_dedup.keep_one_of_each(docs)
    assert left.columns == docs.columns
    kept = Counter(r.doc_id for r in left.collect())
    assert all(n == 1 for i, n in kept.items() if i is not None and i != 5)
    assert {i for i, _, _, k in brute_near(rows) if k} <= set(kept)


def test_kept_rows_stay_as_they_are(spark):
    """Rows without words all stay with their own columns; of equal rows one stays, of rows with one id and text always the same."""
    rows = [(None, "", "en", "s1"), (None, "", "fr", "s2"), (None, None, "de", "s3"), (7, " \n", "en", "s4"), (7, " \n", "en", "s4"), (1, "a b c", "x", "y"), (1, "a b c", "x", "y"), (1, "a b c", "v", "w"), (2, "A B C", "x", "y"), (None, "a B c", "n", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n string, row string")
    seen = set()
    for parts in (1, 3, 4):
        got = Counter(tuple(r) for r in near_dedup.keep_one_of_each(frame.repartition(parts)).collect())
        assert sum(got.values()) == 6 and sum((got & Counter(rows[:5])).values()) == 5
        seen |= set(got - Counter(rows[:5]))
    assert len(seen) == 1 and next(iter(seen))[0] == 1


def test_pairs_within_a_template(spark):
    """Documents of one template in pairs: only the two of a pair are links, though all share their buckets."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = fresh(150), []
    for pair in range(150):
        both = fresh(30)
        for k in range(2):
            rows.append((2 * pair + k, " ".join([*template, *both, *fresh(24)])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows)
    assert sum(r.kept for r in got) == 150


def test_sketches_rule_out_no_link():
    """What sizes and bins rule out is below the similarity."""
    rng = np.random.default_rng(2)
    out = 0
    for _ in range(600):
        pool = np.unique(rng.integers(0, 2**64, int(rng.integers(2, 700)), dtype=np.uint64))
        share = rng.uniform(0.3, 1)
        a, b = (np.sort(pool[rng.random(len(pool)) < s]) for s in (share, rng.uniform(0.3, 1)))
        if not len(a) or not len(b):
            continue
        bins, filled = near_dedup.bins_of([a, b])
        low = C.scramble(bins) & np.uint64(0xFFFF)
        may = near_dedup._may_link(np.array([len(a)]), np.array([len(b)]), (low[:1], filled[:1]), (low[1:], filled[1:]))[0]
        both = len(np.intersect1d(a, b))
        out += not may
        assert may or 100 * both < near_dedup.PERCENT * (len(a) + len(b) - both)
    assert out > 100


def test_many_near_copies(spark):
    """A large group in which many pairs aren't linked by themselves."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for k in rng.sample(range(120), 2):
            copy[k] = f"c{i}x{k}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for i in range(50)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows)


def test_near_copies_linked_by_their_original_alone(spark):
    """Copies are linked with their original, but not with one another, and no smallest hash singles it out."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(304)]
    rows = [(5000, " ".join(base))]
    for i in range(1000):
        copy = list(base)
        for k in range(8):
            copy[k * 37 + rng.randrange(5, 33)] = f"c{i}x{k}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows)
    assert sum(r.kept for r in got) == 1


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (12, 60, 400):
        errors = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            a, b = pool[: int(0.9 * len(pool))], pool[int(0.1 * len(pool)) :]
            bins, _ = near_dedup.bins_of([a, b])
            errors.append((bins[0] == bins[1]).mean() - len(np.intersect1d(a, b)) / len(pool))
        assert abs(np.mean(errors)) < 0.04


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 90), (100, 95), (95, 95), (90, 100)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 95: 90, 100: 90}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- op10


def line_results(rows, run, long=line_dedup.LONG):
    """By id and text: windows of lines, and long lines by themselves, that were there before."""
    blank = " \t\r\x0b\f"
    ranked = sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for i, t in ranked:
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(blank)]
        bare = {k: lines[k].strip(blank) for k in full}
        gone = set()
        for at in range(len(full)):
            for n in {1, run} if len(bare[full[at]]) >= long else {run}:
                own = full[at : at + n]
                if len(own) == n:
                    g = tuple(bare[j] for j in own)
                    if g in seen:
                        gone |= set(own)
                    seen.add(g)
        out[i, t] = (i, len(full), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def brute_lines(rows, run, long=line_dedup.LONG):
    out = line_results(rows, run, long)
    return Counter(out[r] for r in rows)


def test_line_dedup(spark, docs, rows, empty):
    rng = random.Random(9)
    block = "\n".join(f"line {k}" for k in range(5))
    texts = ["\n".join(rng.choice(["a", "b", "c", " a ", "", "\t", "twelve chars", " twelve chars"]) for _ in range(rng.randint(0, 25))) for _ in range(40)] + [block, "x\n" + block + "\ny", block + "\n" + block, None, "", "\n".join(f"{k % 700} of a very long document" for k in range(20_000))]
    own = [*enumerate(texts), (3, texts[3]), (None, block)]
    frame = spark.createDataFrame([(i, t, len(t or ""), "z") for i, t in own], "doc_id long, text string, n_chars long, at string").repartition(3)
    for run, long in ((2, 150), (3, 150), (3, 12), (4, 12), (1, 150)):
        got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(frame, run, long).collect())
        assert got == brute_lines(own, run, long), (run, long)
    left = line_dedup.without_repeated_lines(frame)
    assert left.columns == frame.columns
    want = Counter((i, t) for i, n, gone, t in brute_lines(own, 3).elements() if not gone or gone < n)
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == want
    assert all(r.n_chars == len(r.text or "") for r in left.collect())
    ids_once = [r for r in rows if r[0] != 5]
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(docs.where("doc_id IS NULL OR doc_id <> 5")).collect()) == brute_lines(ids_once, 3)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_a_line_in_many_surroundings(spark):
    """Runs around one frequent line: the first place of the line has other neighbours than most."""
    rng = random.Random(13)
    rows = [(i, "\n".join(x for _ in range(6) for x in (f"n{rng.randrange(6)}", "AAA", f"m{rng.randrange(6)}", f"own {rng.random()}"))) for i in range(80)]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_lines(rows, 3)
    assert sum(r[2] for r in got) > 500


# --- texts beyond a block, a chunk and a batch


def test_very_long_text(spark):
    """One text of more than 4 MiB, another that repeats half of it, with the operators' own settings."""
    long = "\n".join(" ".join(f"w{(k * 7919 + j) % 100_003}x{k}" for j in range(12)) for k in range(36_000))
    rows = [(1, long), (2, "head of its own\n" + long[: len(long) // 2]), (3, "short"), (4, None)]
    assert len(long) > 4 << 20
    own = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in interpolation.score_documents(own).collect()) == Counter((*x[:5], round(x[5], 3)) for x in brute_base(rows))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Counter(tuple(r)[:6] for r in quality.judge_documents(own, labels).collect()) == Counter((i, *brute_statistics(t)) for i, t in rows)
    model = token_counts.model_at("piece_bpe_32k.model")
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(own).collect()) == Counter((i, model.count((t or "").encode())) for i, t in rows)
    assert all(r.round_trip for r in pieces.encode_documents(own, keep_ids=False).collect())
    got = substring_dedup.remove_repeats(own).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, 20)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(own).collect()) == Counter(x[:3] for x in brute_near(rows))
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(own).collect()) == brute_lines(rows, 3)
    assert {r.doc_id: r.spans for r in secrets.find_secrets(own).collect()}[1] == brute_secrets(long)[4]


# --- shared


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (C.unpack_sorted(C.pack_sorted(h)) == h).all()
        assert (C.unpack(C.pack(h), np.uint64) == h).all()
        at = C.cut(h, 7)
        assert at[0] == 0 and at[-1] == n and all((h[at[k] : at[k + 1]] >> np.uint64(32)).astype(float).max(initial=0) <= (k + 1) * 2**32 / 7 for k in range(7))
