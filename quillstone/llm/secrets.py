"""Secret scans that link the parts of a credential. DataFrame operations only.

Three kinds of spans count by themselves: assignments, access identifiers and long hexadecimal runs. Weak
candidates (endpoints, other identifiers, bare keys of mixed characters) are reported only if a part
that completes them lies in their scope, the characters within `reach` of them. The same characters are one part
only: a weak candidate that overlaps a base span, or a weak one of a kind named before its own, is left to that, and
an access identifier that is itself assigned as a secret completes nothing. So the parts that complete each other are disjoint.

The parts of a text are sorted by position, and what ends last before a part and begins first after it decides
whether one of each class overlaps it or lies in its scope: an interval join without pairs, linear in the parts but for the sort.

Offsets come from the lengths of what lies between matches: `split` and `regexp_extract_all` see the
same matches. Texts aren't moved; one row per document and one per match are, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters between a weak candidate and a part that completes it, at most.
REACH = 200

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KEY = "[A-Za-z0-9+/_=-]"
#: Kind, pattern, and the class of part that it is; in the order in which kinds sort.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("assign", _ASSIGN, "secret"),
    ("access", r"AKIA[A-Z0-9]+", "identifier"),
    ("hex", r"[0-9a-f]{32,}", "secret"),
    ("id", r"""(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}|(?:[cC]lient|[aA]ccount|[uU]ser|[lL]ogin|[kK]ey)_?(?:[iI][dD]|[nN]ame)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "identifier"),
    ("key", rf"{_KEY}{{20,}}", "secret"),
    ("host", r"""(?:https?|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[a-z0-9.-]+\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com)""", "endpoint"),
)
KINDS = tuple(k for k, _, _ in PATTERNS)
#: These count by themselves.
BASE = 3
_CLASS = tuple(c for _, _, c in PATTERNS)


def _matches(text: Column, kind: int) -> Column:
    """Each match: its kind, number, what lies between the one before and it, its length, whether it counts."""
    name, pattern, _ = PATTERNS[kind]
    between = F.split(text, pattern, -1)
    found = F.when(F.size(between) > 1, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def counts(match: Column) -> Column:
        if name == "assign":
            return F.length(F.regexp_extract(match, pattern, 2)) >= 8
        if name == "key":
            return F.rlike(match, F.lit("[0-9]")) & F.rlike(match, F.lit("[A-Z]")) & F.rlike(match, F.lit("[a-z]"))
        return F.length(match) >= 16 if name == "access" else F.lit(True)

    part = lambda m, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(F.get(between, i)).alias("gap"), F.length(m).alias("n"), counts(m).alias("counts"))
    return F.coalesce(F.transform(found, part), F.array())


def _joined(spans: Column) -> Column:
    text = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["stop"])
    return F.array_join(F.transform(spans, text), ",")


def _of_kinds(*kinds: str) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def _extremes(spans: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Of each class, what ends last of the parts sorted before a part, and what begins first of those after it: running extremes in both orders."""
    of = Window.partitionBy("row")
    before = of.orderBy("start", "kind", "stop").rowsBetween(Window.unboundedPreceding, -1)
    after = of.orderBy(F.desc("start"), F.desc("kind"), F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({f"{c}_before": F.max(F.when(is_c, F.col("stop"))).over(before) for c, is_c in classes.items()})
    return spans.withColumns({f"{c}_after": F.min(F.when(is_c, F.col("start"))).over(after) for c, is_c in classes.items()})


def _overlaps(c: str) -> Column:
    return F.coalesce(F.col(f"{c}_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"{c}_after") < F.col("stop"), F.lit(False))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked of every row.

    Spans are kind:start:stop in code points, stop exclusive, in the order of start and kind. An identifier needs a
    secret in its scope, a bare key an identifier or an endpoint, an endpoint both a secret and an identifier.

    A null or empty text has no spans; a null id stays null; equal rows and repeated ids are scanned each
    on their own; texts of any length are scanned whole; an empty table gives no rows. Columns other than doc_id and
    text are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    # The first element stands for the document itself, so that one without matches keeps a row.
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("n"), F.lit(True).alias("counts")))
    parts = rows.select("row", "doc_id", F.explode(F.concat(itself, *(_matches(F.col("text"), k) for k in range(len(PATTERNS))))).alias("p")).select("row", "doc_id", "p.*")
    parts = parts.repartition("row")
    by_kind = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = parts.withColumn("stop", F.sum(F.col("gap") + F.col("n")).over(by_kind)).withColumn("start", F.col("stop") - F.col("n")).where("counts")

    spans = _extremes(spans, {"base": _of_kinds(*KINDS[:BASE]), "assigned": _of_kinds("assign", "hex"), "host": _of_kinds("host"), "id": _of_kinds("id")})
    left_to_others = F.when(_of_kinds("host"), _overlaps("base")).when(_of_kinds("id"), _overlaps("base") | _overlaps("host")).when(_of_kinds("key"), _overlaps("base") | _overlaps("host") | _overlaps("id")).otherwise(False)
    spans = spans.where(~left_to_others).select("row", "doc_id", "kind", "start", "stop", (_of_kinds("access") & _overlaps("assigned")).alias("idle"))

    classes = {c: F.col("kind").isin([k for k in range(len(KINDS)) if _CLASS[k] == c]) & ~F.col("idle") for c in ("secret", "identifier", "endpoint")}
    spans = _extremes(spans, classes)
    near = lambda c: F.coalesce(F.col("start") - F.col(f"{c}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{c}_after") - F.col("stop") <= reach, F.lit(False))
    complete = F.when(_of_kinds("id"), near("secret")).when(_of_kinds("key"), near("identifier") | near("endpoint")).when(_of_kinds("host"), near("secret") & near("identifier")).otherwise(True)
    kept = spans.where(complete)

    is_span = F.col("kind") >= 0
    found = kept.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(is_span, F.struct("start", "kind", "stop")))).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < BASE)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_linked"),
    )
