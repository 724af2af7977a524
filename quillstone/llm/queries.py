"""The registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontaminate, hard_negatives, interpolation, line_dedup, merkle, mixing, near_dedup, pieces, quality, secrets, substring_dedup, token_counts, warc


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(C.table(spark, sf_dir, "documents"))


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(C.table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(C.table(spark, sf_dir, "documents"))


def op5_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op6_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(C.table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op7_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(C.table(spark, sf_dir, "pages"))


def op8_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(C.table(spark, sf_dir, "documents"), keep_text=False).drop("removed", "kept_text")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(C.table(spark, sf_dir, "documents")).drop("n_links")


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = hard_negatives.prepared(rows.select("vec_id", "embedding", label.alias("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).drop("nth")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", ""))
    return merkle.manifest(C.table(spark, sf_dir, "documents"), tampered, keep_proofs=False).drop("source")


def op13_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(C.table(spark, sf_dir, "documents")).drop("source", "weight")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_quality_forest": op2_quality_forest,
    "op3_secret_links": op3_secret_links,
    "op4_token_counts": op4_token_counts,
    "op5_bm25_decontamination": op5_bm25_decontamination,
    "op6_sentencepiece_viterbi": op6_sentencepiece_viterbi,
    "op7_warc_source": op7_warc_source,
    "op8_fm_index_repeats": op8_fm_index_repeats,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_line_winnowing": op10_line_winnowing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_mix_sources": op13_mix_sources,
}

# Patterns of secrets, and the rule for a match of each: p is the pattern, m the match.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, p, 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", "[0-9a-f]+", "length(m) >= 32"),
    ("id", r"""(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}|(?:[cC]lient|[aA]ccount|[uU]ser|[lL]ogin|[kK]ey)_?(?:[iI][dD]|[nN]ame)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "true"),
    ("key", "[A-Za-z0-9+/_=-]+", "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
    ("host", r"""(?:https?|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[a-z0-9.-]+\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)""", "true"),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql(reach: int = 200) -> str:
    """Spans by the lengths of matches and of what lies between; weak ones by all pairs within a text."""
    parts = " UNION ALL ".join(
        f"""SELECT r, {k} AS kind, i, length(gap) AS gap, length(m) AS n, {rule.replace("p, 2", f"{_quoted(pattern)}, 2")} AS counts FROM (
            SELECT r, unnest(range(len(f))) AS i, unnest(f) AS m, unnest(g[1:len(f)]) AS gap FROM (SELECT r, regexp_extract_all(t, {_quoted(pattern)}) AS f, regexp_split_to_array(t, {_quoted(pattern)}) AS g FROM d))"""
        for k, (_, pattern, rule) in enumerate(_SECRETS)
    )
    overlaps = lambda kinds: f"EXISTS (SELECT 1 FROM s q WHERE q.r = p.r AND q.kind IN ({kinds}) AND q.a < p.b AND p.a < q.b)"
    near = lambda kinds: f"EXISTS (SELECT 1 FROM y q WHERE q.r = p.r AND q.kind IN ({kinds}) AND NOT q.idle AND ((q.b <= p.a AND p.a - q.b <= {reach}) OR (q.a >= p.b AND q.a - p.b <= {reach})))"
    name = f"[{', '.join(_quoted(k) for k, *_ in _SECRETS)}][kind + 1] || ':' || a || ':' || b"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS ({parts}),
        s AS MATERIALIZED (SELECT r, kind, b - n AS a, b FROM (SELECT *, CAST(sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS b FROM w) WHERE counts),
        y AS MATERIALIZED (SELECT r, kind, a, b, kind = 1 AND {overlaps("0, 2")} AS idle FROM s p
              WHERE kind < 3 OR (NOT {overlaps("0, 1, 2")} AND (kind = 5 OR NOT {overlaps("5")}) AND (kind <> 4 OR NOT {overlaps("3")}))),
        z AS (SELECT * FROM y p WHERE kind < 3 OR (kind = 3 AND {near("0, 2, 4")}) OR (kind = 4 AND {near("1, 3, 5")}) OR (kind = 5 AND {near("0, 2, 4")} AND {near("1, 3")}))
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256(coalesce(string_agg({name}, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg({name}, ',' ORDER BY a, kind), '') AS spans, count(*) FILTER (kind > 2) AS n_linked
        FROM d LEFT JOIN z ON z.r = d.r GROUP BY d.r, doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op3_secret_links": _secrets_sql(),
    # A record's type follows from the smallest page of its payload; the digest is of the UTF-8 bytes.
    "op7_warc_source": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
        FROM f""",
    # A window of twenty words that begins earlier too takes its words with it.
    "op8_fm_index_repeats": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM d WHERE len(ws) >= 20),
        r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(ws[k:k + 19], ' ') ORDER BY doc_id, k) > 1 AS again FROM s),
        g AS (SELECT DISTINCT doc_id, k + j AS k FROM r, (SELECT unnest(range(0, 20)) AS j) WHERE again),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
        x AS (SELECT w.doc_id, w.word, w.k, g.k IS NOT NULL AS gone FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.k = w.k)
        SELECT d.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
        FROM d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id""",
    # All links by shared shingles, and what each document reaches.
    "op9_near_duplicates": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY x, y),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    # A window of three lines, or a line of 150 characters, that begins earlier too takes its lines with it.
    "op10_line_winnowing": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
        l AS (SELECT doc_id, unnest(raw) AS line, unnest(range(1, len(raw) + 1)) AS i FROM d),
        f AS (SELECT doc_id, i, line, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM l),
        n AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f WHERE t <> ''),
        w AS (SELECT doc_id, k, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS w FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
        v AS (SELECT doc_id, k, w, 3 AS size FROM w WHERE w IS NOT NULL UNION ALL SELECT doc_id, k, t, 1 FROM n WHERE length(t) >= 150),
        r AS (SELECT doc_id, k, size, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) > 1 AS again FROM v),
        g AS (SELECT DISTINCT doc_id, k + j AS k FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE again AND j < size),
        x AS (SELECT f.doc_id, f.i, f.line, n.k IS NOT NULL AS full_line, g.k IS NOT NULL AS gone
              FROM f LEFT JOIN n ON n.doc_id = f.doc_id AND n.i = f.i LEFT JOIN g ON g.doc_id = n.doc_id AND g.k = n.k)
        SELECT doc_id, CAST(count(*) FILTER (full_line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM x GROUP BY doc_id""",
    # All scores by a join; the first five of each side.
    "op11_hard_negatives": """
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS (SELECT r, unnest(e) AS x, unnest(range(len(e))) AS i FROM v),
        s AS MATERIALIZED (SELECT p.r AS a, q.r AS b, CAST(sum(p.x * q.x) AS BIGINT) AS score FROM c p JOIN v w ON w.r = p.r AND w.vec_id % 100 = 0 JOIN c q ON q.i = p.i GROUP BY p.r, q.r),
        t AS (SELECT s.*, p.vec_id AS anchor_id, q.vec_id, p.label = q.label AS same FROM s JOIN v p ON p.r = a JOIN v q ON q.r = b),
        g AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS nth FROM t WHERE same AND a <> b),
        n AS (SELECT g.anchor_id, g.vec_id AS positive_id, g.score AS positive_score, t.vec_id AS negative_id, t.score AS negative_score,
                     row_number() OVER (PARTITION BY g.a, g.nth ORDER BY t.score DESC, t.vec_id) AS rank
              FROM g JOIN t ON t.a = g.a AND NOT t.same AND 80 * g.score <= 100 * t.score AND t.score <= g.score WHERE g.nth <= 5)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    # Levels from the leaves up, then each leaf's way to the root. crc32 bit by bit.
    "op12_merkle_manifest": """
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, * FROM documents),
        f AS (SELECT r, doc_id, source, text, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                     coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head, replace(text, chr(10), '') AS cut FROM d),
        e AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS other,
                     xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 2 = 0 AS even FROM f),
        o AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM d GROUP BY source)),
        l AS MATERIALIZED (SELECT e.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM e JOIN o ON e.source IS NOT DISTINCT FROM o.source),
        up AS (SELECT tree, 0 AS level, i, leaf AS h, n FROM l UNION ALL
               SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, i // 3, n),
        top AS (SELECT 0 AS level, tree AS i, h, (SELECT count(*) FROM o) AS n FROM up WHERE n = 1 UNION ALL
               SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3, n),
        all_nodes AS MATERIALIZED (SELECT tree, level, i, h, n FROM up UNION ALL SELECT -1, level, i, h, n FROM top),
        root AS (SELECT h FROM top WHERE n = 1),
        way AS (SELECT r, tree, i, tree AS own, 0 AS level, 0 AS step, '' AS before, '' AS after, n FROM l UNION ALL
                SELECT w.r, CASE WHEN w.n = 1 THEN -1 ELSE w.tree END, CASE WHEN w.n = 1 THEN w.own ELSE w.i // 3 END, w.own, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, w.step + (w.n > 1)::INT,
                       CASE WHEN w.n > 1 THEN coalesce((SELECT string_agg(x.h, '' ORDER BY x.i) FROM all_nodes x WHERE x.tree = w.tree AND x.level = w.level AND x.i // 3 = w.i // 3 AND x.i < w.i), '') END,
                       CASE WHEN w.n > 1 THEN coalesce((SELECT string_agg(x.h, '' ORDER BY x.i) FROM all_nodes x WHERE x.tree = w.tree AND x.level = w.level AND x.i // 3 = w.i // 3 AND x.i > w.i), '') END,
                       CASE WHEN w.n = 1 THEN (SELECT count(*) FROM o) ELSE (w.n + 2) // 3 END
                FROM way w WHERE w.n > 1 OR w.tree >= 0),
        beside AS (SELECT r, step, before, after FROM way WHERE step > 0 AND before IS NOT NULL),
        fold AS (SELECT r, 0 AS step, CASE WHEN even AND text IS NOT NULL THEN other ELSE leaf END AS h FROM l JOIN (SELECT r AS q, text FROM d) ON q = r UNION ALL
                 SELECT f.r, f.step + 1, sha256(b.before || f.h || b.after) FROM fold f JOIN beside b ON b.r = f.r AND b.step = f.step + 1),
        done AS (SELECT r, arg_max(h, step) AS h FROM fold GROUP BY r),
        proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS p FROM beside GROUP BY r)
        SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM root) AS root, coalesce(p, sha256('')) AS proof_sha256, done.h AS folded_root, done.h = (SELECT h FROM root) AS verified
        FROM l JOIN up s ON s.tree = l.tree AND s.n = 1 JOIN done ON done.r = l.r LEFT JOIN proof ON proof.r = l.r""",
    # Targets from sums over the sources in the order in which they fill up, taken words from running sums.
    "op13_mix_sources": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                                       CAST('0x' || left(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
        c AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
              FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        u AS (SELECT rest, weights FROM c WHERE 3 * source_size * weights >= weight * rest ORDER BY weights DESC LIMIT 1),
        t AS (SELECT w.*, 3 * source_size * u.weights < weight * u.rest AS full_source, u.rest, u.weights FROM w, u),
        b AS (SELECT *, CASE WHEN full_source THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest * weight AS DOUBLE) / CAST(weights AS DOUBLE) END AS target,
                     CAST(CASE WHEN full_source THEN 3 * source_size ELSE rest * weight // weights END AS BIGINT) AS budget FROM t),
        x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END AS over,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, over - start)) AS BIGINT) AS taken FROM x""",
}
