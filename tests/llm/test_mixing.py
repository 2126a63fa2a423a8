import random

import pytest

from papyrine.llm import mixing


def rounded(rows, seed, root):
    r = mixing.Rounding(seed)
    for row in rows:
        r.add((row[0],), row[1], row[2])
    left = r.close(root)
    return {x[0]: d for x, d in r.done}, [(x[0], p) for x, p in left]


@pytest.mark.parametrize("partners", [1, 3, 256])
@pytest.mark.parametrize("seed", range(6))
def test_rounding_keeps_tokens_and_bounds(seed, partners, monkeypatch):
    monkeypatch.setattr(mixing, "PARTNERS", partners)
    rng = random.Random(seed)
    rows = sorted(((i, int(rng.lognormvariate(5, 1)) + 1, rng.random()) for i in range(400)), key=lambda r: -r[1]) + [(900, 50, 0.0), (901, 50, 1.0), (902, 0, 0.5)]
    size = {i: t for i, t, _ in rows}
    done, left = rounded(rows, seed, False)
    total = sum(t * q for _, t, q in rows)
    kept = sum(size[i] * d for i, d in done.items()) + sum(size[i] * p for i, p in left)
    assert abs(kept - total) < 1e-4 and set(done.values()) <= {0, 1} and len(done) + len(left) == len(rows) and len(left) <= partners
    done, left = rounded(rows, seed, True)
    assert not left and len(done) == len(rows)
    if partners == 256:  # the last record is a small one
        assert abs(sum(size[i] * d for i, d in done.items()) - total) <= sorted(size.values())[20]


def test_rounding_is_fair():
    """Every record is taken with its own probability."""
    rows = [(0, 90, 0.1), (1, 70, 0.3), (2, 70, 0.5), (3, 10, 0.7), (4, 5, 0.4), (6, 5, 0.5), (7, 4, 0.9), (5, 0, 0.6)]
    hits = dict.fromkeys(range(8), 0)
    for seed in range(6000):
        for i, d in rounded(rows, seed, True)[0].items():
            hits[i] += d
    for i, _, q in rows:
        assert abs(hits[i] / 6000 - q) < 0.03


def mixed(spark, docs, targets, **kw):
    s = spark.createDataFrame(docs, "doc long, source string, tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(s, t, **kw)
    return {r.doc: r.copies for r in copies.collect()}, {r.source: r for r in report.collect()}


def test_shares_caps_and_shortfall(spark):
    rng = random.Random(1)
    docs = [(i, "big", rng.randrange(50, 150)) for i in range(3000)] + [(10_000 + i, "mid", 100) for i in range(300)] + [(20_000 + i, "tiny", 100) for i in range(5)]
    copies, report = mixed(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 4), ("tiny", 0.2, 3), ("none", 0.0, 2)])
    assert len(copies) == len(docs)
    assert all(c <= 1 for d, c in copies.items() if d < 10_000)
    assert all(c == 3 for d, c in copies.items() if d >= 20_000)
    assert report["tiny"].short and not report["big"].short and not report["mid"].short
    budget = sum(t for _, _, t in docs)
    for s, share in (("big", 0.5), ("mid", 0.3)):
        if s == "mid" and report[s].planned_repeats >= 4:
            assert report[s].short
        else:
            assert abs(report[s].selected_tokens - share * budget) <= 100  # one small record
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4


def test_deterministic_and_typed_sources(spark):
    docs = [(i, " Big  Source " if i % 2 else "BIG_SOURCE", 10) for i in range(200)]
    a = mixed(spark, docs, [("big-source", 1.0, 2)], total_tokens=700)
    assert a[0] == mixed(spark, docs, [("big-source", 1.0, 2)], total_tokens=700)[0]
    assert sum(a[0].values()) == 70


def test_nulls_empty_and_repeated(spark):
    copies, report = mixed(spark, [(1, None, 5), (2, "other", 5), (3, "a", 0), (4, "a", 10)], [("a", 1.0, 1), ("a", 1.0, 1), (None, 0.5, 1), ("b", None, None)])
    assert set(copies) == {3, 4} and set(report) == {"a", "b"}
    copies, report = mixed(spark, [], [("a", 1.0, 1)])
    assert copies == {} and report["a"].selected_tokens == 0
    assert mixed(spark, [(1, "a", 1)], []) == ({}, {})


def test_token_counts(spark):
    text = "The quick (brown) fox's 123 naïve\n\n  jumps. " * 40
    whole = mixing.count_tokens(text)
    old = mixing.PIECE
    try:
        mixing.PIECE = 100
        assert mixing.count_tokens(text) == whole
        assert mixing.count_tokens("x" * 1000) == mixing.count_tokens("x" * 1000)
    finally:
        mixing.PIECE = old
    d = spark.createDataFrame([(1, "A b", text, 9), (2, None, None, 9), (3, "c", "", 9)], "doc_id long, source string, text string, tokens long")
    got = {r.doc: (r.source, r.tokens) for r in mixing.token_sizes(d).collect()}
    assert got == {1: ("a-b", whole), 2: (None, 0), 3: ("c", 0)}


def test_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        copies, _ = mixed(spark, [(i, "a", 100) for i in range(1000)], [("a", 1.0, 1)], total_tokens=33_300)
        assert sum(copies.values()) == 333 and len(copies) == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_shares_of_the_test_data(spark, small):
    """Copies lie between floor and ceiling, caps hold, and every source has its tokens up to one record."""
    from papyrine.session import table

    sizes = mixing.token_sizes(table(spark, small, "documents").select("doc_id", "text", "source"))
    copies, report = mixing.mix(sizes, table(spark, small, "mix_targets"))
    targets = {mixing_slug(r.source): r for r in table(spark, small, "mix_targets").collect()}
    plan = {r.source: r for r in report.collect()}
    assert set(plan) == set(targets)
    budget = sum(r.available_tokens for r in plan.values())
    taken, largest = {}, {}
    for r in copies.collect():
        repeats = plan[r.source].planned_repeats
        assert int(repeats + 1e-6) <= r.copies <= -int(-repeats - 1e-6 + 1e-9) + 1 and r.copies <= targets[r.source].max_repeats
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.tokens
        largest[r.source] = max(largest.get(r.source, 0), r.tokens)
    everything = sum(taken.values())
    for s, r in plan.items():
        want = min(targets[s].target_share * budget, targets[s].max_repeats * r.available_tokens)
        assert r.selected_tokens == taken.get(s, 0) and abs(r.selected_tokens - want) <= largest.get(s, 0)
        assert r.short == (targets[s].target_share * budget > targets[s].max_repeats * r.available_tokens)
        assert abs(r.actual_share - taken.get(s, 0) / everything) < 1e-5


def mixing_slug(source):
    import re

    return re.sub(r"[^a-z0-9]+", "-", source.lower()).strip("-")
