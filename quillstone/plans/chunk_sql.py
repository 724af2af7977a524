"""The chunkers in SQL: spans by sums over pieces, and cuts by a recursion from chunk to chunk."""

from __future__ import annotations

from quillstone.functions import text as T
from quillstone.operators.chunking import LEAST, OVERLAP, SEPARATORS, TARGET

_HEAD = T.HEADING.replace("'", "''")
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''))"
_IS_HEAD = f"len(rtrim(line, {_BLANKS})) BETWEEN 1 AND {T.HEADING_LENGTH} AND regexp_matches(rtrim(line, {_BLANKS}), '{_HEAD}')"
_TEXTS = r"texts AS MATERIALIZED (SELECT doc_id, text || chr(10) || chr(10) AS t FROM documents WHERE regexp_matches(text, '\S'))"


def _packed() -> str:
    """Chunks of texts (doc_id, t) by spans (doc_id, a, b), where they begin and end, from 0.

    z has a text's spans as lists with running sums of tokens (s) and words (p). A step of rec finds the first span (m) with which the
    target is reached from where the chunk begins: it is cut before that span if there is something before and the target would be passed, else behind it.
    """
    return f"""wz AS (SELECT x.doc_id, a, b, {_WORDS.format("substr(t, a + 1, b - a)")} AS w FROM spans x JOIN texts USING (doc_id)),
        z AS MATERIALIZED (SELECT doc_id, any_value(t) AS t, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS n, list_prepend(0, list(s ORDER BY a)) AS s, list_prepend(0, list(p ORDER BY a)) AS p
            FROM (SELECT doc_id, a, b, CAST(sum(floor(w / 0.75) + 1) OVER o AS BIGINT) AS s, CAST(sum(w) OVER o AS BIGINT) AS p FROM wz WINDOW o AS (PARTITION BY doc_id ORDER BY a)) JOIN texts USING (doc_id) GROUP BY doc_id),
        rec AS (SELECT doc_id, 0 AS step, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS k, false AS counted, CAST(NULL AS BIGINT) AS begins, CAST(NULL AS BIGINT) AS cut FROM z UNION ALL
            SELECT doc_id, step + 1, list_min(list_filter(range(first, cut + 1), lambda j: s[cut + 1] - s[j + 1] <= {OVERLAP})), CASE WHEN m IS NULL THEN n + 1 ELSE cut END, m IS NOT NULL AND early, first, cut
            FROM (SELECT *, CASE WHEN m IS NULL THEN n WHEN early THEN m ELSE m + 1 END AS cut
                  FROM (SELECT *, NOT (counted AND m = k) AND first < m AND s[m + 2] - s[first + 1] > {TARGET} AS early
                        FROM (SELECT r.doc_id, r.step, r.first, r.k, r.counted, z.n, z.s, list_min(list_filter(range(r.k, z.n), lambda x: z.s[x + 2] - z.s[r.first + 1] >= {TARGET})) AS m
                              FROM rec r JOIN z ON z.doc_id = r.doc_id WHERE r.k <= z.n)))
            WHERE first < cut),
        cuts AS (SELECT r.doc_id, r.step, z.a[r.begins + 1] AS a, z.b[r.cut] AS b, CAST(floor((z.p[r.cut + 1] - z.p[r.begins + 1]) / 0.75) AS BIGINT) + 1 AS tokens FROM rec r JOIN z ON z.doc_id = r.doc_id WHERE r.cut IS NOT NULL),
        lines AS (SELECT doc_id, unnest(l) AS line, unnest(list_prepend(0, list_transform(range(1, len(l)), lambda i: list_sum(list_transform(l[1:i], lambda x: len(x) + 1))))) AS pos FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM z)),
        heads AS (SELECT doc_id, pos, trim(line, {_BLANKS}) AS head FROM lines WHERE {_IS_HEAD}),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS k FROM cuts WHERE step = 1 OR tokens >= {LEAST})
        SELECT x.doc_id, CAST(x.k AS INT) AS chunk_index, trim(substr(z.t, x.a + 1, x.b - x.a), {_BLANKS}) AS text, 1 AS page_start, 1 AS page_end,
               coalesce((SELECT arg_max(head, pos) FROM heads h WHERE h.doc_id = x.doc_id AND h.pos <= x.a), '') AS section
        FROM kept x JOIN z ON z.doc_id = x.doc_id"""


#: Sentences: what lies between two is marked on either side, and stays in the sums.
_SENTENCES = r"""pieces AS (SELECT doc_id, unnest(pc) AS piece, unnest(range(len(pc))) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '([.!?])([ \t\n\r\f\x0b]+)([A-Z0-9"(\[])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS pc FROM texts)),
        spans AS MATERIALIZED (SELECT doc_id, CAST(e - len(replace(piece, chr(2), '')) + greatest(strpos(piece, chr(2)) - 1, 0) AS BIGINT) AS a, e AS b
            FROM (SELECT *, CAST(sum(len(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM pieces) WHERE regexp_matches(replace(piece, chr(2), ''), '\S'))"""


def _finer(n: int, separator: str) -> str:
    """Spans of level n: those of the level above, cut at a separator where they are over the target."""
    sep = " || ".join(f"chr({ord(c)})" for c in separator)
    return f"""p{n} AS (SELECT doc_id, a, unnest(string_split(x, {sep})) AS piece, unnest(range(len(string_split(x, {sep})))) AS i FROM (SELECT doc_id, a, substr(t, a + 1, b - a) AS x FROM l{n - 1} JOIN texts USING (doc_id) WHERE big)),
        q{n} AS (SELECT doc_id, e - len(piece) AS a, e AS b FROM (SELECT *, CAST(a + sum(len(piece) + {len(separator)}) OVER (PARTITION BY doc_id, a ORDER BY i) AS BIGINT) - {len(separator)} AS e FROM p{n}) WHERE regexp_matches(piece, '\\S') UNION ALL SELECT doc_id, a, b FROM l{n - 1} WHERE NOT big),
        l{n} AS MATERIALIZED (SELECT doc_id, a, b, floor({_WORDS.format("substr(t, a + 1, b - a)")} / 0.75) + 1 > {TARGET} AS big FROM q{n} JOIN texts USING (doc_id))"""


_WHOLE = f"l0 AS (SELECT doc_id, CAST(0 AS BIGINT) AS a, CAST(len(t) AS BIGINT) AS b, floor({_WORDS.format('t')} / 0.75) + 1 > {TARGET} AS big FROM texts)"
_PARTS = ", ".join([_WHOLE, *(_finer(k, sep) for k, sep in enumerate(SEPARATORS, 1)), f"spans AS (SELECT doc_id, a, b FROM l{len(SEPARATORS)})"])

#: Sentences of lines between two heads are a run, whose chunks are cut for themselves.
_FIXED = rf"""WITH RECURSIVE ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE regexp_matches(text, '\S'))),
        rn AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, {_IS_HEAD} AS head FROM ln)),
        st AS (SELECT doc_id, run, i, unnest(x) AS sentence, unnest(range(len(x))) AS j FROM (SELECT doc_id, run, i,
            list_filter(list_transform(string_split(regexp_replace(regexp_replace(line, '[ \t]+', ' ', 'g'), '([.!?])[ \t\n\r\f\x0b]+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS x FROM rn WHERE NOT head)),
        wz AS (SELECT *, {_WORDS.format("sentence")} AS w FROM st),
        z AS MATERIALIZED (SELECT doc_id, run, list(sentence ORDER BY i, j) AS x, count(*) AS n, list_prepend(0, list(s ORDER BY i, j)) AS s, list_prepend(0, list(p ORDER BY i, j)) AS p
            FROM (SELECT *, CAST(sum(floor(w / 0.75) + 1) OVER o AS BIGINT) AS s, CAST(sum(w) OVER o AS BIGINT) AS p FROM wz WINDOW o AS (PARTITION BY doc_id, run ORDER BY i, j)) GROUP BY doc_id, run),
        rec AS (SELECT doc_id, run, 0 AS step, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS begins, CAST(NULL AS BIGINT) AS cut FROM z UNION ALL
            SELECT doc_id, run, step + 1, list_min(list_filter(range(first, cut + 1), lambda j: s[cut + 1] - s[j + 1] <= {OVERLAP})), CASE WHEN m IS NULL THEN n + 1 ELSE cut END, first, cut
            FROM (SELECT *, coalesce(m + 1, n) AS cut FROM (SELECT r.doc_id, r.run, r.step, r.first, r.k, z.n, z.s, list_min(list_filter(range(r.k, z.n), lambda x: z.s[x + 2] - z.s[r.first + 1] >= {TARGET})) AS m
                  FROM rec r JOIN z ON z.doc_id = r.doc_id AND z.run = r.run WHERE r.k <= z.n)) WHERE first < cut),
        cuts AS (SELECT r.doc_id, r.run, r.step, array_to_string(z.x[r.begins + 1:r.cut], ' ') AS text, CAST(floor((z.p[r.cut + 1] - z.p[r.begins + 1]) / 0.75) AS BIGINT) + 1 AS tokens FROM rec r JOIN z ON z.doc_id = r.doc_id AND z.run = r.run WHERE r.cut IS NOT NULL)
        SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.run, step) - 1 AS INT) AS chunk_index, c.text, 1 AS page_start, 1 AS page_end, coalesce(trim(h.line, {_BLANKS}), '') AS section
        FROM cuts c LEFT JOIN rn h ON h.doc_id = c.doc_id AND h.run = c.run AND h.head WHERE tokens >= {LEAST}"""

CHUNKS = {"chunk_fixed": _FIXED, "chunk_sentence": f"WITH RECURSIVE {_TEXTS}, {_SENTENCES}, {_packed()}", "chunk_recursive": f"WITH RECURSIVE {_TEXTS}, {_PARTS}, {_packed()}"}
