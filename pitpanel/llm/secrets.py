"""Secrets by a trigram inverted index. DataFrame functions only.

Each rule's regular expression says which trigrams any match must contain, as an OR of ANDs. An index
maps trigrams to bitmaps of rows; AND and OR over its postings name the few rows whose text a rule has
to be run on. A rule without such trigrams (a run of hexadecimal digits) is run on every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_view, materialize


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are leftmost and don't overlap; those whose ``group`` is shorter than ``least`` fall away."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# fixed values: the rules that always hold. A run of digits or capitals that is too short holds no match
# further on either, so its length is part of the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# public formats of keys
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
)
#: rows of candidates up to which their numbers are broadcast to the texts; beyond it both sides are shuffled
MOST_BROADCAST = 1 << 20
_BITS = 32768  # of one of Spark's bitmaps
_MOST = 64  # strings or clauses that an expression is expanded to
_ANY = frozenset([frozenset()])


# ---------------------------------------------------------------- what a match must contain
def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Sets of lower-case trigrams, one of which lies wholly in the lower-cased text of any match.

    An empty set among them means that nothing is mandatory.
    """
    return _sequence(regex.parse(pattern))[1]


def _of(strings: set[str]) -> frozenset:
    clauses = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > _MOST:  # one of the two is still mandatory
        return min(a, b, key=lambda q: (q == _ANY, len(q)))
    every = {x | y for x, y in product(a, b)}
    return frozenset(c for c in every if not any(d < c for d in every))


def _sequence(items) -> tuple[set[str] | None, frozenset]:
    """All strings an expression stands for, if they are few, and its query."""
    query, run, whole = _ANY, {""}, True
    for item in items:
        exact, inner = _item(*item)
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = {a + b for a, b in product(run, exact)}
        else:
            query, whole = _both(_both(query, _of(run)), inner), False
            run = {""} if exact is None else exact
    return (run if whole else None), _both(query, _of(run))


def _item(kind, arg) -> tuple[set[str] | None, frozenset]:
    if kind is op.LITERAL:
        exact = {chr(arg).lower()}
    elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
        exact = {chr(c).lower() for _, c in arg}
    elif kind is op.SUBPATTERN:
        return _sequence(arg[3])
    elif kind is op.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        if any(e is None for e, _ in parts) or sum(len(e) for e, _ in parts) > _MOST:
            every = {c for _, q in parts for c in q}
            return None, frozenset(c for c in every if not any(d < c for d in every))
        exact = set().union(*(e for e, _ in parts))
    elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, inner = _sequence(body)
        if exact is None or high is op.MAXREPEAT or high > 3 or len(exact) ** high > _MOST:
            return None, inner if low else _ANY
        exact = {"".join(p) for n in range(low, high + 1) for p in product(exact, repeat=n)}
    elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        exact = {""}
    else:
        return None, _ANY
    return exact, _of(exact)


# ---------------------------------------------------------------- index
def postings(rows: DataFrame, trigrams: list[str], row_col: str = "_row", text_col: str = "text") -> DataFrame:
    """trigram, bucket, docs: a bitmap of the rows of each bucket of 32,768 row numbers that contain it.

    Holds the trigrams asked for, over lower-cased texts; a scan keeps no list that no rule reads. Row
    numbers must not be negative and should be dense in places, as ``monotonically_increasing_id`` is.
    """
    low = rows.select((F.col(row_col) + 1).alias("at"), F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return (low.select("at", F.explode(held).alias("trigram"))
            .groupBy("trigram", F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("docs")))


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """at, kinds: row number plus one and the rules whose query it meets."""
    wanted = [(k, i, t, len(c)) for k, q in queries.items() for i, c in enumerate(sorted(map(sorted, q))) for t in c]
    named = ("kind", "clause", "trigram", "need")
    each = [F.struct(*[F.lit(v).alias(k) for k, v in zip(named, row)]) for row in wanted]
    # a row per trigram of a rule: its size is fixed by the rules
    clauses = index.sparkSession.range(1).select(F.inline(F.array(*each)))
    met = (index.join(F.broadcast(clauses), "trigram").groupBy("kind", "clause", "need", "bucket")
           .agg(F.bitmap_and_agg("docs").alias("docs"), F.count("*").alias("n")).where("n = need"))
    either = met.groupBy("kind", "bucket").agg(F.bitmap_or_agg("docs").alias("docs"))

    def byte(i):
        return F.substring("docs", i + 1, F.lit(1))

    def bits(i):
        v = F.conv(F.hex(byte(i)), 16, 10).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(v, k) == 1), lambda k: i * 8 + k)
    some = F.filter(F.sequence(F.lit(0), F.lit(_BITS // 8 - 1)), lambda i: byte(i) != F.lit(b"\0"))
    each = either.select("kind", "bucket", F.explode(F.flatten(F.transform(some, bits))).alias("bit"))
    at = each.select("kind", ((F.col("bucket") - 1) * _BITS + F.col("bit") + 1).alias("at"))
    return at.groupBy("at").agg(F.collect_set("kind").alias("kinds"))


# ---------------------------------------------------------------- matches
def _matches(text: Column, rule: Rule) -> Column:
    """Gap before, length and verdict of every match, in order: linear in the text, whatever their number."""
    pattern = F.lit(rule.pattern)
    size = lambda c: F.transform(c, F.length)
    every = F.arrays_zip(size(F.split(text, rule.pattern, -1)).alias("gap"),
                         size(F.regexp_extract_all(text, pattern, F.lit(0))).alias("len"),
                         size(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("inner"))
    # the gap after the last match has none
    return F.transform(F.filter(every, lambda m: m["len"].isNotNull()), lambda m, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["len"].alias("len"),
        (m["inner"] >= rule.least).alias("valid")))


_MATCH = "array<struct<kind:string,i:int,gap:int,len:int,valid:boolean>>"


def find_spans(rows: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, row_col: str = "_row", text_col: str = "text",
               most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """row, kind, start, end of every span, in code points, end exclusive; a row number names one row.

    Null texts have none. ``rows`` is read several times: write it first.
    """
    rows = rows.select(F.col(row_col).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    free = [r for r in rules if frozenset() in queries[r.kind]]
    bound = [r for r in rules if r not in free]
    found = None
    if free:
        every = F.concat(*[F.when(F.col("text").rlike(r.pattern), _matches(F.col("text"), r)).otherwise(F.array().cast(_MATCH)) for r in free])
        found = rows.select("row", F.explode(every).alias("m"))
    if bound:
        asked = sorted({t for r in bound for c in queries[r.kind] for t in c})
        named = candidates(postings(rows, asked, "row"), {r.kind: queries[r.kind] for r in bound})
        named = materialize(named.select((F.col("at") - 1).alias("row"), "kinds"))
        few = named.count() <= most_broadcast
        met = rows.join(F.broadcast(named) if few else named, "row")
        each = F.concat(*[F.when(F.array_contains("kinds", r.kind), _matches(F.col("text"), r)).otherwise(F.array().cast(_MATCH)) for r in bound])
        checked = met.select("row", F.explode(each).alias("m"))
        found = checked if found is None else found.unionByName(checked)
    # matches of one text and rule: a window of at most one text's length
    order = "PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ends = found.select("row", "m.*").withColumn("end", F.expr(f"sum(gap + len) OVER ({order})"))
    return ends.where("valid").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id",
         text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, a count n_kind per base rule, base_sha256, spans; one row per row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start, then in the order of ``rules``.
    Null and empty texts have none; rows that repeat an id or have none are each judged by their own
    text; an empty table gives no row. Columns beyond the two named ones are ignored.
    """
    rows = materialize(column_view(docs, doc_id=id_col, text=text_col).withColumn("_row", F.monotonically_increasing_id()))
    place = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    span = F.struct("start", place.alias("place"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    is_base = F.col("kind").isin([r.kind for r in base])
    per = find_spans(rows, rules, most_broadcast=most_broadcast).groupBy("row").agg(
        *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in base],
        F.sort_array(F.collect_list(F.when(is_base, span))).alias("of_base"), F.sort_array(F.collect_list(span)).alias("of_all"))
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: s["span"]), ","), F.lit(""))
    return rows.select(F.col("_row").alias("row"), "doc_id").join(per, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(joined("of_base"), 256).alias("base_sha256"), joined("of_all").alias("spans"))


# ---------------------------------------------------------------- the same in SQL
def oracle_sql(rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE) -> str:
    """DuckDB text of ``find`` over ``documents``: every rule over every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {quoted(r.kind)} AS kind, {i} AS place, unnest(list_transform(regexp_extract_all(t, {quoted(r.pattern)}), lambda x: length(x))) AS len, "
        f"unnest(list_transform(regexp_extract_all(t, {quoted(r.pattern)}, {r.group}), lambda x: length(x) >= {r.least})) AS valid, "
        f"unnest(list_transform(string_split_regex(t, {quoted(r.pattern)})[:-2], lambda x: length(x))) AS gap, "
        f"unnest(range(len(regexp_extract_all(t, {quoted(r.pattern)})))) AS i FROM d" for i, r in enumerate(rules))
    names = ", ".join(quoted(r.kind) for r in base)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)
    count = ", ".join(f"count(*) FILTER (kind = {quoted(r.kind)}) AS n_{r.kind}" for r in base)
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}), "
            "e AS (SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m), "
            "s AS (SELECT doc_id, kind, place, stop - len AS start, kind || ':' || (stop - len)::BIGINT || ':' || stop::BIGINT AS span FROM e WHERE valid), "
            f"g AS (SELECT doc_id, {count}, string_agg(span, ',' ORDER BY start, place) FILTER (kind IN ({names})) AS b, "
            "string_agg(span, ',' ORDER BY start, place) AS a FROM s GROUP BY doc_id) "
            f"SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (doc_id)")
