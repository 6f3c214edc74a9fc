"""Base spans against a plain-Python reading of the rules; the whole operator on odd rows."""

import hashlib
import re

from pitpanel.llm import personal

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans(spark):
    texts = [None, "", "x", "a@b.co a@b.com_foo@x.org @x.y a@@b.c .a.@b-.c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.04 99999999999.1.1.1",
             "4417 7442-8035 1547 4929348385146306 1 2 3 4", "\U0001F600 é +1 (017) 555-7713. +12 +1 2 3", "9" * 30_000,
             "1 " * 9_000, "a" * 50_000 + "@b.c", "5 4929348385146306 5", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, email string")
    for row in personal.find(df).collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in RULES.items() for m in re.finditer(p, texts[row.doc_id] or "") if valid(k, m[0])]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (row, spans)
        assert row.spans.split(",")[:len(spans)] == spans or not spans
    assert personal.find(df.limit(0)).collect() == []


LOOSE_RULES = {"secret": r"[A-Za-z0-9_/+=-]{16,}", "date": r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}(?![0-9./-])",
               "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"}


def written(spark, monkeypatch, texts):
    """The table of spans that the operator writes, as it is before it is written."""
    seen = []
    monkeypatch.setattr(personal, "materialize", lambda df: seen.append(df) or df)
    personal.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    return seen[0]


def test_candidates(spark, monkeypatch):
    run = "a1B2c3D4e5F6g7H8"
    texts = [f"key: {run}é{run}x token={run}, {run[:15]} {run}", "é" * 30 + run, f"{run} {run} {run}", f"\U0001F600 password \U0001F600{run}",
             "born 1.2.2020 11.2.2020. 1/2/2020-1 3-4-1999 ssn 123-45-6789 1123-45-6789 123-45-6789-1 12-3-2020,4.5.2021",
             "1.2.20201 123-45-67890 ++1 555 123 4567+1 (555) 123-4567 ++", "a " * 100_000 + run, "1 é" * 100_000 + "1.2.2020", "+ @é" * 50_000]
    for row in written(spark, monkeypatch, texts).collect():
        text = texts[row.doc_id]
        for kind, rule in RULES.items():
            assert [tuple(s) for s in row[kind]] == [m.span() for m in re.finditer(rule, text) if valid(kind, m[0])], (row.doc_id, kind)
        spans = [(k, m) for k, p in LOOSE_RULES.items() for m in re.finditer(p, text)]
        assert [(c.kind, c.start, c.end) for c in row.loose] == [(k, *m.span()) for k, m in spans], row.doc_id
        for c, (_, m) in zip(row.loose, spans):
            before = text[max(m.start() - personal.BEFORE, 0):m.start()]
            assert c.v_gazetteer == (1 if re.search(personal.GAZETTEER, before, re.ASCII) else -1), (row.doc_id, c)
            assert c.v_assigned == (1 if re.search(r"[=:][\s\"']*\Z", before) else 0 if re.search(r"[A-Za-z]\s+\Z", before) else -1), (row.doc_id, c)


def test_each_text_is_read_once_for_matches(spark, monkeypatch):
    """One look for digits, and one reading for the matches of each kind; a second, for the gaps, only where there is one."""
    plan = written(spark, monkeypatch, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(text#\d+, \[0-9\]\)", plan)) == 1, plan
    assert plan.count("regexp_extract_all(") <= 2 * len(personal.PATTERN) and "split(text" not in plan, plan
