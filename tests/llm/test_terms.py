import random
import unicodedata
from collections import Counter, defaultdict

import regex

from papyrine.llm import terms


def brute(rows):
    texts = {(r, t) for r, t in rows if r is not None and t is not None}
    occ, recs = Counter(), defaultdict(set)
    for r, t in texts:
        for w in regex.findall(r"\p{L}+", unicodedata.normalize("NFKC", t).lower()):
            occ[w] += 1
            recs[w].add(r)
    n = len({r for r, _ in texts})
    mark = lambda k: "rare" if k <= 2 else "common" if k > 0.25 * n else "useful"
    return {(w, occ[w], len(recs[w]), mark(len(recs[w]))) for w in occ}


def run(spark, rows, schema="event_id long, abstract string"):
    df = terms.term_frequencies(spark.createDataFrame(rows, schema))
    return {(r.term, r.occurrences, r.records, r.mark) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["graph", "Graph", "traﬁc", "Été", "x2y", "naïve", "日本", "a-b", "ªº", "ﬀ"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(rng.randrange(40), " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for _ in range(200)]
    rows += rows[:30] + [(None, "lost"), (99, None), (98, ""), (97, "   "), (96, "1234 !!")]
    assert run(spark, rows) == brute(rows)


def test_hot_record_and_long_text(spark):
    rows = [(1, "hot term")] * 500 + [(1, f"other{'x' * (i % 3)}") for i in range(50)] + [(2, "hot " * 200_000)]
    assert run(spark, rows) == brute(rows)


def merge(parts):
    """What the aggregates of the operator make of partial counters."""
    text, rec = defaultdict(int), defaultdict(int)
    for part in parts:
        for t, o, r, e, d in part:
            if d is None:
                text[t, e, d] += o
            else:
                text[t, e, d] = max(text[t, e, d], o)
            rec[t, e] = rec[t, e] + r if e is None else 1
    occ, recs = Counter(), Counter()
    for (t, _, _), o in text.items():
        occ[t] += o
    for (t, _), r in rec.items():
        recs[t] += r
    return occ, recs


def partials(rows, cuts):
    import pyarrow as pa

    for part in [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))]:
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part[i : i + 4])], names=["record", "digest", "text"]) for i in range(0, len(part), 4)]
        yield [row for b in terms._counters(iter(batches)) for row in zip(*[c.to_pylist() for c in b.columns])]


def test_flush_and_edges(monkeypatch):
    """Counters that are handed over early, long records, and records and texts cut by partition edges add up."""
    rng = random.Random(4)
    for flush, held in ((3, 1 << 24), (10**6, 60), (3, 1)):
        monkeypatch.setattr(terms, "FLUSH_TERMS", flush)
        monkeypatch.setattr(terms, "HELD_CHARS", held)
        rows = sorted((i // 5, i % 5 // 2, f"t{chr(97 + i // 2 % 7)} shared tail again shared {chr(97 + i // 5)}") for i in range(60))
        rows = [(r, d, next(t for q, e, t in rows if (q, e) == (r, d)) + f" digest{chr(97 + d)}") for r, d, _ in rows]
        want = brute([(r, t) for r, _, t in rows])
        for cuts in ((), (1,), (2, 3, 20), (4, 5, 6, 7, 39), *(sorted(rng.sample(range(1, 60), 6)) for _ in range(40))):
            occ, recs = merge(partials(rows, cuts))
            assert {(t, occ[t], recs[t]) for t in occ} == {w[:3] for w in want}, cuts


def test_last_seen_counters_hold_three_numbers():
    c = terms._Counters()
    for texts in (["a b a", "a c"], ["a a"], ["b"]):
        c.record(texts)
    assert c.seen == {"a": [5, 2, 2], "b": [2, 2, 3], "c": [1, 1, 1]}


def test_one_text_delivered_over_many_partitions(spark):
    rows = [(7, "hot text again again")] * 3000 + [(i, "cold text") for i in range(20, 40)]
    df = spark.createDataFrame(rows, "event_id long, abstract string").repartition(8)
    got = {(r.term, r.occurrences, r.records, r.mark) for r in terms.term_frequencies(df).collect()}
    assert got == brute(rows)


def test_one_record_over_many_partitions(spark):
    rows = [(7, f"hot text number {chr(97 + i % 26)}{chr(97 + i // 26)} again") for i in range(600)] + [(i, "cold text") for i in range(20, 40)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(1, "a b", "t", 3, "x")], "event_id long, abstract string, term string, records long, digest string")
    assert {r.term for r in terms.term_frequencies(df).collect()} == {"a", "b"}


def test_marks_at_the_edges(spark):
    rows = [(i, ("quarter " if i < 10 else "") + ("over " if i < 11 else "") + ("two " if i < 2 else "") + ("three" if i < 3 else "")) for i in range(40)]
    marks = {t: m for t, _, _, m in run(spark, rows)}
    assert marks == {"quarter": "useful", "over": "common", "two": "rare", "three": "useful"}
