"""Personal data by weak supervision. DataFrame functions only.

Four kinds of spans follow fixed rules and always stay. Looser candidates (secrets, dates, numbers of
papers) are voted on by a regular expression, a gazetteer and two context labelers; expectation
maximisation over the counts of vote patterns estimates how far each labeler can be trusted, and a
classifier over the candidates' features, trained on those beliefs, decides.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_view, materialize

# characters one by one: Java looks them up at once, where ranges and \w are tried in turn
_LOCAL = string.ascii_letters + string.digits + r"._%+\-"
_SECRET = string.ascii_letters + string.digits + r"_/+=\-"
# possessive repeats keep long runs off the regex stack
BASE = {
    "email": rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "secret": rf"[{_SECRET}]{{16,}}+",
    "date": r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9./-])",
    "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
PATTERN = BASE | LOOSE
# what lies between matches, run by run: a run of a match's first characters begins one at its head or nowhere
GAP = {k: rf"(?:[^0-9]++|(?!{p})[0-9]++)*+" for k, p in PATTERN.items()} | {
    "email": rf"(?:[^{_LOCAL}]++|(?!{BASE['email']})[{_LOCAL}]++)*+",
    "phone": rf"(?:[^+]++|(?!{BASE['phone']})\+)*+",
    "secret": rf"(?:[{_SECRET}]{{0,15}}+[^{_SECRET}]++)*+",
}
GAZETTEER = r"(?i)(?:token|key|secret|password|passwd|auth|bearer|ssn|social security|born|birth|dob|passport|account)\W*$"
BEFORE = 24
LABELERS = ("v_regex", "v_gazetteer", "v_assigned", "v_varied")


def _matches(text: Column, kind: str, group: int) -> Column:
    """Every match (group 2), or what lies before each (group 1): a text is read once, from the end of the last match."""
    return F.regexp_extract_all(text, F.lit(rf"\G({GAP[kind]})({PATTERN[kind]})"), F.lit(group))


def hits(text: Column, has_digit: Column, kind: str) -> Column:
    """Every match of a kind, looked for only in texts that hold a character it needs."""
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "secret": F.lit(True)}
    return F.when(needs.get(kind, has_digit), _matches(text, kind, 2)).otherwise(F.array().cast("array<string>"))


def _found(text: Column, found: Column, kind: str) -> Column:
    """The matches ``found`` as (start, end, hit, before), in code points; only texts with a match are read again, for the gaps."""
    pairs = F.arrays_zip(_matches(text, kind, 1).alias("gap"), found.alias("hit"))
    span = "array<struct<start:int,end:int,hit:string,before:string>>"
    seed = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(span).alias("spans"))

    def last(*parts):
        return F.substring(F.concat(*parts), -BEFORE, BEFORE)

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        before = last(acc["tail"], p["gap"])
        spans = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"), before.alias("before"))))
        return F.struct(end.alias("at"), last(acc["tail"], p["gap"], p["hit"]).alias("tail"), spans.alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, seed, step)["spans"]).otherwise(F.array().cast(span))


def _luhn(digits: Column) -> Column:
    def value(i):
        v = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        def small(p):
            p = F.regexp_replace(p, "^0+(?=[0-9])", "")
            return F.when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255)
        return F.forall(F.split(hit, r"\."), small)
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, found: Column, kind: str) -> Column:
    """Valid spans of a fixed kind, of its :func:`hits`."""
    valid = F.filter(_found(text, found, kind), lambda s: _valid(kind, s["hit"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def candidates(text: Column, found: Column, kind: str) -> Column:
    """Loose spans, of their :func:`hits`, with votes (1, 0, or -1 for none) and features, but without their text."""
    def describe(s):
        hit, before = s["hit"], s["before"]
        n = F.length(hit)
        digits = n - F.length(F.regexp_replace(hit, "[0-9]", ""))
        letters = n - F.length(F.regexp_replace(hit, "[A-Za-z]", ""))
        varied = F.size(F.array_distinct(F.split(hit, "")))
        mixed = ((digits >= 3) & (letters >= 3)) if kind == "secret" else F.lit(True)
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            mixed.cast("int").alias("v_regex"),
            F.when(before.rlike(GAZETTEER), 1).otherwise(-1).alias("v_gazetteer"),
            F.when(before.rlike("[=:][\\s\"']*$"), 1).when(before.rlike("[A-Za-z]\\s+$"), 0).otherwise(-1).alias("v_assigned"),
            F.when(varied >= 10, 1).when(varied < 6, 0).otherwise(-1).alias("v_varied"),
            F.least(F.floor(n / 8), F.lit(8)).cast("string").alias("f_length"),
            F.floor(4 * digits / n).cast("string").alias("f_digits"), F.floor(4 * letters / n).cast("string").alias("f_letters"),
            F.regexp_extract(before, "(.?)\\s*$", 1).rlike("[A-Za-z0-9]").cast("string").alias("f_after_word"))
    return F.transform(_found(text, found, kind), describe)


def reliabilities(patterns: list[tuple], rounds: int = 100) -> tuple[dict, dict]:
    """Belief per vote pattern (kind, votes..., count), and P(vote | truth) per labeler, by expectation maximisation."""
    kinds = {p[0] for p in patterns}
    prior = dict.fromkeys(kinds, 0.5)
    rate = {j: {y: {v: (0.6 if v == y else 0.2) for v in (1, 0, -1)} for y in (1, 0)} for j in range(len(LABELERS))}
    belief = {}
    for _ in range(rounds):
        mass, votes = defaultdict(float), {(j, y): defaultdict(float) for j in rate for y in (1, 0)}
        for kind, *vs, n in patterns:
            like = {y: (prior[kind] if y else 1 - prior[kind]) * math.prod(rate[j][y][v] for j, v in enumerate(vs)) for y in (1, 0)}
            b = belief[kind, *vs] = like[1] / (like[0] + like[1])
            mass[kind, 1] += b * n
            mass[kind, 0] += (1 - b) * n
            for j, v in enumerate(vs):
                votes[j, 1][v] += b * n
                votes[j, 0][v] += (1 - b) * n
        prior = {k: (mass[k, 1] + 1) / (mass[k, 1] + mass[k, 0] + 2) for k in kinds}
        rate = {j: {y: {v: (votes[j, y][v] + 1) / (sum(votes[j, y].values()) + 3) for v in (1, 0, -1)} for y in (1, 0)} for j in rate}
    return belief, rate


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, in the order of kinds, then start. Null and
    empty texts have none. An empty table, or one without candidates, trains nothing and adds nothing.
    Only counts per vote pattern and per feature value reach the driver: their number is fixed.
    """
    view = column_view(docs, doc_id=id_col, text=text_col)
    # columns of their own, as they are read more than once: most texts hold no digit and few a match
    texts = view.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    matched = texts.select("doc_id", "text", *[hits(F.col("text"), F.col("has_digit"), k).alias(f"{k}_hits") for k in PATTERN])
    of = lambda k: (F.col("text"), F.col(f"{k}_hits"), k)
    found = materialize(matched.select("doc_id", *[base_spans(*of(k)).alias(k) for k in BASE],
                                       F.concat(*[candidates(*of(k)) for k in LOOSE]).alias("loose")))
    each = found.select(F.explode("loose").alias("c")).select("c.*")
    names = [c for c in each.columns if c.startswith(("v_", "f_"))]
    patterns = [tuple(r) for r in each.groupBy("kind", *LABELERS).count().collect()]
    added = F.filter("loose", lambda c: F.lit(False))
    if patterns:
        belief, _ = reliabilities(patterns)
        value = lambda c, name: F.concat(c["kind"], F.lit(f":{name}="), c[name].cast("string"))
        key = lambda c: F.concat_ws(",", c["kind"], *[c[v].cast("string") for v in LABELERS])
        believed = F.create_map(*[F.lit(x) for k, b in belief.items() for x in (",".join(map(str, k)), float(b))])
        row = {c: F.col(c) for c in each.columns}
        soft = each.select("kind", F.explode(F.array(*[value(row, n) for n in names], F.concat("kind", F.lit(":all")))).alias("value"),
                           F.element_at(believed, key(row)).alias("b"))
        # naive Bayes over the features of a candidate, trained on beliefs
        mass = {r["value"]: (r["yes"], r["no"]) for r in soft.groupBy("value").agg(
            F.sum("b").alias("yes"), F.sum(1 - F.col("b")).alias("no")).collect()}
        odds = {}
        for name, (yes, no) in mass.items():
            y, n = mass[name.split(":")[0] + ":all"]
            odds[name] = math.log((yes + 1) / (no + 1)) if name.endswith(":all") else math.log((yes + 1) / (y + 2) * (n + 2) / (no + 1))
        table = F.create_map(*[F.lit(x) for k, v in sorted(odds.items()) for x in (k, float(v))])
        score = lambda c: sum((F.element_at(table, value(c, n)) for n in names), F.element_at(table, F.concat(c["kind"], F.lit(":all"))))
        added = F.filter("loose", lambda c: score(c) > math.log(threshold / (1 - threshold)))

    def written(spans, kind):
        return F.transform(spans, lambda s: F.concat_ws(":", kind if isinstance(kind, Column) else F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*[written(F.col(k), k) for k in BASE])
    more = F.transform(added, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))
