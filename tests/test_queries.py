"""Every registered query against its SQL, or, where SQL cannot state it, against what must hold of its rows."""

import collections
import math

import pytest

from papyrine import plans
from papyrine.functions import text as X
from papyrine.session import table
from tests.oracle import check, connect

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, con, name):
    check(spark, con, small, QUERIES[name], SQL[name])


def _docs(spark, small):
    return {r.doc_id: r for r in table(spark, small, "documents").collect()}


def area_summary(spark, small, rows):
    e = table(spark, small, "embeddings").count()
    assert sum(r.n for r in rows) == e and len(rows) == 8
    assert all(0 <= r.x <= 1 and 0 <= r.y <= 1 and 1 <= len(r.areas.split("; ")) <= 3 for r in rows)


def figure_checks(spark, small, rows):
    from papyrine.operators.verification import pool_of

    import json

    import re
    from pyspark.sql import functions as F

    papers = {}
    for r in table(spark, small, "papers").orderBy("ingested_at", F.desc("title")).collect():
        papers[r.event_id] = r.abstract
    facts = {}
    for r in table(spark, small, "facts_abstract").where("ok").select("event_id", "extracted_at", "source", "model", F.to_json("facts").alias("f")).orderBy("extracted_at", F.desc("source"), F.desc("model")).collect():
        facts[r.event_id] = pool_of(json.loads(r.f))
    want = collections.Counter()
    for i, pool in facts.items():
        for raw in re.findall(r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?", (papers.get(i) or "").replace("−", "-")):
            if re.fullmatch(r"(19|20)\d\d", raw):
                continue
            v, dp = float(raw.replace(",", "")), len(raw.partition(".")[2])
            u = sorted(set(pool))[:120]
            two = {c for k, a in enumerate(u) for b in u[k + 1 :] for c in (a - b, b - a, a + b, a / b * 100 if b else -1, b / a * 100 if a else -1, a / b if b else -1, b / a if a else -1) if 0 <= c <= 1e7}
            ok = any(round(x, dp) == round(v, dp) for x in pool)
            want["ok" if ok else "derived" if dp <= 2 and any(round(x, dp) == round(v, dp) for x in two) else "no"] += 1
    assert {r.verdict: r.n for r in rows} == dict(want)


def html_sections(spark, small, rows):
    n = {r.bucket: (r.n, r.pages) for r in rows}
    assert n["abstract"][0] == n["abstract"][1] and "back" not in n and n["abstract"][1] <= len(_docs(spark, small))


def kmeans_regions(spark, small, rows):
    assert len(rows) == table(spark, small, "embeddings").count() == len({r.vec_id for r in rows}) and len({r.region for r in rows}) == 10


def layout(spark, small, rows):
    assert len(rows) == table(spark, small, "embeddings").count()
    for c in ("x", "y"):
        v = [r[c] for r in rows]
        assert min(v) == 0 and max(v) == 1


def method_contexts(spark, small, rows):
    text = collections.defaultdict(set)
    for r in table(spark, small, "papers").collect():
        text[str(r.event_id)].add(" ".join((r.abstract or "").split()))
    seen = collections.Counter((r.cited, r.citer) for r in rows)
    assert rows and max(seen.values()) <= 2 and max(collections.Counter(c for c, _ in seen).values()) <= 12
    for r in rows:
        assert r.cited in r.sentence and len(r.sentence) <= 422


def pca_int8(spark, small, rows):
    assert len(rows) == table(spark, small, "embeddings").count() and len({r.scale for r in rows}) == 1
    for r in rows:
        assert len(r.code) == 16 and max(map(abs, r.code)) <= 127
        assert abs(math.sqrt(sum((c * r.scale / 127) ** 2 for c in r.code)) - 1) < 0.05


def role_ranges(spark, small, rows):
    assert {r.role for r in rows} <= {"method", "task"} and all(0 < r.papers <= r.n for r in rows) and rows


def sentence_split(spark, small, rows):
    import re

    docs = _docs(spark, small)
    for r in rows:
        t = re.sub(r"(?<=[a-z])- (?=[a-z])", "", docs[r.doc_id].text)
        for a in ("et al.", "e.g.", "i.e.", "cf.", "vs.", "resp.", "Fig.", "Eq.", "Sec.", "Tab.", "No.", "pp."):
            t = t.replace(a, a.replace(".", "\x01"))
        s = [x.replace("\x01", ".").strip(" ") for x in re.split("(?<=[.!?])[ \t\n\x0b\x0c\r\xa0]+(?=[A-Z(\u201c\"])", t)]
        s = [x for x in s if len(x) >= 30]
        assert (r.n, r.chars, r.longest) == (len(s), sum(map(len, s)), max(map(len, s)))


def set_groups(spark, small, rows):
    sizes = collections.Counter((r.label, r.group) for r in rows)
    whole = collections.Counter(r.label for r in rows)
    assert len(rows) == table(spark, small, "embeddings").count()
    for label, n in whole.items():
        mine = [c for (x, _), c in sizes.items() if x == label]
        assert len(mine) == 1 or (min(mine) >= 3 and max(mine) <= 0.6 * n and len(mine) <= 6)


def shift_tests(spark, small, rows):
    by = collections.defaultdict(list)
    for r in rows:
        assert abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-9
        by[r.p_type].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: (r.p, r.p_brand))
        low = 1.0
        for i in range(len(rs) - 1, -1, -1):
            low = min(low, rs[i].p * len(rs) / (i + 1))
            assert abs(rs[i].p_adjusted - low) < 1e-9


def stratified_sample(spark, small, rows):
    docs = _docs(spark, small)
    size = collections.Counter(d.lang or "?" for d in docs.values())
    got = collections.Counter(r.lang for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(abs(got[s] - max(1, 0.1 * n)) <= 0.5 + 1e-9 for s, n in size.items())


def text_repairs(spark, small, rows):
    for r in rows:
        assert r.fixed.endswith("conditioning token-level α end") and "\\" not in r.fixed and "[3, 12]" not in r.fixed and "Lee et al." not in r.fixed
        assert not r.fixed.startswith("In this paper, we propose ")


def text_sections(spark, small, rows):
    docs = _docs(spark, small)
    assert sum(r.chars for r in rows) <= sum(len(d.text) for d in docs.values()) and "front" in {r.bucket for r in rows}
    assert sum(r.n for r in rows) >= len(docs) - 1


MUST_HOLD = {f.__name__: f for f in (area_summary, figure_checks, html_sections, kmeans_regions, layout, method_contexts, pca_int8, role_ranges, sentence_split, set_groups, shift_tests, stratified_sample, text_repairs, text_sections)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_what_must_hold(spark, small, name):
    rows = QUERIES[name](spark, small).collect()
    assert rows
    MUST_HOLD[name](spark, small, rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_failure_stop_words():
    assert {"existing", "limited", "challenge", "the", "methods", "solution"} <= set(X.FAILURE_STOP) and not {"paper", "novel", "noise"} & set(X.FAILURE_STOP)
