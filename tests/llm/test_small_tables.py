"""The queries over the smallest tables, against programs that compare everything with everything."""

import collections
import datetime as dt
import itertools
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from papyrine.llm import entity, leaks, queries, residue, survivor
from papyrine.llm.sql import oracle_sql
from papyrine.session import table
from tests.oracle import check, connect


def test_every_query_runs_and_has_its_columns(spark, small):
    columns = {
        "p1_found": ["name_a", "name_b"], "p2_found": ["group_id", "field", "event_id"], "p3_found": ["term", "mark"], "p4_found": ["event_id", "field", "pos", "ref_id"],
        "p5_found": ["event_id", "arxiv_base"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
    }
    found = queries.queries()
    assert set(columns) <= set(found)
    for name, wanted in columns.items():
        df = found[name](spark, small)
        assert df.columns == wanted, name
        rows = df.collect()
        assert rows and len(rows) == len(set(rows)), name


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, small, name):
    assert check(spark, connect(small), small, queries.queries()[name], oracle_sql()[name]) > 0


def test_leaks_against_all_pairs(spark, small):
    """Runs of 16 letters and digits that a text shares with an item, looked for by position in every pair."""
    items = leaks.without_instruction(table(spark, small, "eval_items").select(*[F.col(a).alias(b) for a, b in (("item_id", "item"), ("suite", "suite"), ("text", "text"))])).collect()
    codes = [(r.item, "".join(map(chr, leaks.compact(r.text).astype(int)))) for r in items]
    want = set()
    for r in table(spark, small, "documents").where("text is not null").collect():
        text = "".join(map(chr, leaks.compact(r.text).astype(int)))
        runs = {text[i : i + 16] for i in range(len(text) - 15)}
        for item, c in codes:
            marks = np.zeros(len(c), bool)
            for i in range(len(c) - 15):
                if c[i : i + 16] in runs:
                    marks[i : i + 16] = True
            if len(c) and marks.mean() >= leaks.COVER:
                want.add((r.doc_id, item))
    assert {(r.doc_id, r.item_id) for r in queries.p6_found(spark, small).collect()} == want and want


def test_matches_against_all_pairs(spark, small):
    papers = collections.defaultdict(list)
    for r in table(spark, small, "papers").collect():
        papers[r.event_id].append((entity.words_of(r.title), entity.names_of(r.authors)))
    records = collections.defaultdict(list)
    for r in table(spark, small, "arxiv_index").collect():
        records[r.arxiv_base].append((entity.words_of(r.title), entity.names_of(r.authors)))
    ok = {(e, b) for e, ps in papers.items() for b, rs in records.items() if any(entity.same_authors(n, m) and entity.same_title(w, v) for w, n in ps for v, m in rs)}
    got = {(r.event_id, r.arxiv_base) for r in queries.p5_found(spark, small).collect()}
    assert got <= ok and got
    of = collections.defaultdict(set)
    for e, b in ok:
        of[e].add(b)
    assert {e for e, _ in got} == set(of) and all((e, b) in got for e, bs in of.items() if len(bs) == 1 for b in bs)


def _one_edit(a, b):
    """Whether the strings share one that a dropped character, at most, leaves of each."""
    cut = lambda s: {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}
    return abs(len(a) - len(b)) <= 2 and bool(cut(a) & cut(b))


def test_survivors_against_all_pairs(spark, small):
    """Groups by comparing every two entries of an edition, then the rules of the statement read literally."""
    entries = {r.event_id: r for r in survivor.latest_deliveries(table(spark, small, "papers")).collect()}
    keys = {
        r.event_id: r for r in survivor.latest_deliveries(table(spark, small, "papers")).select(
            "event_id", survivor.plain_key(F.col("title")).alias("title"), survivor.part_marks(F.col("title")).alias("part"), survivor.surnames(F.col("authors")).alias("names"),
            *[survivor.usable(f).alias(f) for f in survivor.FIELDS],
        ).collect()
    }
    root = {i: i for i in entries}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(entries), 2):
        x, y, k, m = entries[a], entries[b], keys[a], keys[b]
        if (x.venue, x.year) != (y.venue, y.year):
            continue
        same = k.openreview_id and m.openreview_id and x.openreview_id == y.openreview_id
        near = k.title and m.title and k.part == m.part and set(k.names or ()) & set(m.names or ()) and _one_edit(k.title, m.title)
        if same or near:
            root[find(b)] = find(a)
    trust = {f: n for n, f in enumerate(survivor.TRUST)}
    groups = collections.defaultdict(list)
    for i in entries:
        groups[find(i)].append(i)
    want = {}
    for ids in groups.values():
        if len(ids) < 2:
            continue
        for f in survivor.FIELDS:
            values = {i: entries[i][f] for i in ids}
            if len(set(values.values())) == 1:
                continue
            if f == "presentation":
                slot = lambda v: next((n for n, w in ((3, "oral"), (2, "spotlight"), (1, "poster")) if v and re.search(w, v, re.I)), 0)
                top = max(slot(v) for v in values.values())
                want[min(ids), f] = min(i for i in ids if slot(values[i]) == top)
            else:
                best = max(ids, key=lambda i: (keys[i][f], entries[i].updated_at or dt.datetime.min, -trust.get(entries[i].feed, 9), -i))
                want[min(ids), f] = min(i for i in ids if values[i] == values[best])
    got = {(r.group_id, r.field): r.event_id for r in queries.p2_found(spark, small).collect()}
    # listed duplicates join some more entries; what the pairs above settle must come out as they say
    assert want and sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)
    listed = {i for i in entries if entries[i].duplicate_event_ids}
    assert all(got.get((g, f)) == v for (g, f), v in want.items() if not listed & {i for i in entries if find(i) == find(g)})


def test_residue_documents_hold_a_detected_or_a_repeated_line(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    flagged = {r.doc_id for r in queries.p8_found(spark, small).collect()}
    lines = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t in texts.items()}
    assert flagged and {i for i, ls in lines.items() if any(residue.placeholder(x) for x in ls)} <= flagged
    assert all(any(residue.is_residue(x) for x in lines[i]) for i in flagged)  # nothing is repeated often enough here to count alone


def test_spellings_and_values_are_complete(spark, small):
    orgs = queries.p1_organisations(spark, small).collect()
    typed = {r.name for r in table(spark, small, "papers").selectExpr("explode(author_institutions.institution) as name").where("name is not null").distinct().collect()}
    assert {r.name for r in orgs} <= typed and len({r.name for r in orgs}) == len(orgs)
    size = collections.Counter(r.organisation for r in orgs)
    assert all(size[r.organisation] == r.n_spellings for r in orgs)
    pairs = {(r.name_a, r.name_b) for r in queries.p1_found(spark, small).collect()}
    by = collections.defaultdict(list)
    for r in orgs:
        by[r.organisation].append(r.name)
    assert pairs == {p for ns in by.values() for p in itertools.combinations(sorted(ns), 2)}
    used = queries.p4_value_map(spark, small).collect()
    assert all(r.n_uses > 0 and (r.ref_id == 0) == (r.how == "none") for r in used) and len({(r.kind, r.name) for r in used}) == len(used)
