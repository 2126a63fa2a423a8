import random

import numpy as np
import pytest

from papyrine.llm import leaks

ITEM = "Which sampler did Kurubolan blame when the sparse margin from Ritrode lost 47 points in climate science although Nifustomi had left the checkpoint stable?"
OTHER = "Which decoder did Vartabrub blame when the latent kernel from Setepika lost 12 points in robotics although Mimonavar had left the gradient causal?"
TASK = "Answer from the paper only: "
FILL = "We study graph matching when the policy is noisy. " * 12


def items(extra=()):
    return [(1, "quiz", TASK + ITEM), (2, "quiz", TASK + OTHER), *extra, *[(100 + i, "quiz", TASK + f"Unrelated question number {i} about topic {chr(97 + i) * 9} and {chr(98 + i) * 7} only") for i in range(6)]]


def found(spark, docs, its=None, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(its if its is not None else items(), "item_id long, suite string, text string")
    return {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i, **kw).collect()}


def test_forms_of_a_leak(spark):
    w = ITEM.split()
    half = " ".join(w[: len(w) * 6 // 10])
    docs = [
        (1, FILL + ITEM + FILL),
        (2, FILL + ITEM.upper().replace(" ", "  \n") + FILL),
        (3, FILL + "<b>" + ITEM.replace(" ", "&nbsp; ") + "</b>" + FILL),
        (4, FILL + ITEM.replace("a", "а").replace("e", "е") + FILL),  # Cyrillic letters
        (5, FILL + half + " ... " + FILL),
        (6, FILL + " ".join(x if i % 9 != 8 else "other" for i, x in enumerate(w)) + FILL),
        (7, FILL + ITEM.replace("checkpoint", "check-\npoint") + FILL),
        (8, FILL + " ".join(w[:13]) + FILL + " ".join(w[11:]) + FILL),
    ]
    assert found(spark, docs) == {(i, 1) for i in range(1, 9)}


def test_what_is_no_leak(spark):
    docs = [
        (1, FILL + TASK + FILL),
        (2, FILL + "Kurubolan and Ritrode met Nifustomi in climate science. " + FILL),
        (3, FILL + "Which encoder did Someone blame when the deep prior from Elsewhere lost 47 points in energy although Nobody had left the index dense?" + FILL),
        (4, ""), (5, None), (None, ITEM),
    ]
    assert found(spark, docs) == set()


def test_copies_long_texts_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 500)
    long = FILL * 400
    assert found(spark, [(1, long + ITEM + long), (2, ITEM), (3, ITEM), (3, ITEM)]) == {(1, 1), (2, 1), (3, 1)}


def test_both_ways_give_the_same(spark):
    """Fingerprints sent to the tasks, or joined: a suite of any size keeps its instruction."""
    w = ITEM.split()
    docs = [(1, FILL + ITEM), (2, OTHER + FILL), (3, FILL), (4, FILL + " ".join(w[:13]) + FILL + " ".join(w[11:])), (5, FILL + TASK + FILL), (5, ITEM), (6, " ".join(w[: len(w) * 6 // 10])), (7, "日本語の短い設問です。"), (8, TASK)]
    its = items([(50, "kurz", "日本語の短い設問"), (51, "kurz", "日本語"), (52, "quiz", TASK + OTHER), (1, "quiz", TASK + ITEM)])
    want = {(1, 1), (2, 2), (2, 52), (4, 1), (5, 1), (6, 1), (7, 50)}
    assert found(spark, docs, its) == want
    for chars in (0, 600):
        assert found(spark, docs, its, broadcast_chars=chars) == want
    assert found(spark, docs, [], broadcast_chars=-1) == set() and found(spark, [], its, broadcast_chars=0) == set()


def test_shares_of_both_ways_are_equal(spark):
    rng = random.Random(8)
    words = [f"{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}{'xyz'[i % 3]}tor" for i in range(300)]
    its = [(i, "s", " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(40)]
    docs = []
    for i in range(60):
        t = rng.choice(its)[2].split()
        a = rng.randrange(len(t))
        docs.append((i, " ".join(rng.choices(words, k=20)) + " " + " ".join(t[a : a + rng.randrange(1, 30)]) + " " + " ".join(rng.choices(words, k=20))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(its, "item_id long, suite string, text string")
    got = [{(r.doc_id, r.item_id, round(r.share, 9)) for r in leaks.leaked_items(d, t, broadcast_chars=n).collect()} for n in (10**9, 0)]
    assert got[0] == got[1] and len(got[0]) > 5


def test_items_that_cannot_be_looked_for_are_listed(spark):
    t = spark.createDataFrame([(1, "s", "日本語"), (2, "s", "日本語の短い設問"), (3, "s", None), (4, "s", ITEM)], "item_id long, suite string, text string")
    assert {(r.item_id, r.letters) for r in leaks.unsearchable(t).collect()} == {(1, 3), (3, 0)}


def test_empty_tables_and_clashes(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, ITEM)], []) == set()
    d = spark.createDataFrame([(1, ITEM, 7, "x")], "doc_id long, text string, item_id long, share string")
    i = spark.createDataFrame([(1, "q", ITEM, 5)], "item_id long, suite string, text string, doc_id long")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()} == {(1, 1)}
    null = spark.createDataFrame([(None, None, None), (2, None, ITEM)], "item_id long, suite string, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, null).collect()} == {(1, 2)}


@pytest.mark.parametrize("seed", range(20))
def test_winnowing_misses_no_long_span(seed):
    """Brute force: every shared run of GRAM + WINDOW - 1 characters shares a kept hash."""
    rng = random.Random(seed)
    letters = "abcdefghij"
    text = lambda n: "".join(rng.choices(letters, k=n))
    span = text(leaks.GRAM + leaks.WINDOW - 1)
    a, b = text(rng.randrange(80)) + span + text(rng.randrange(80)), text(rng.randrange(200)) + span + text(rng.randrange(200))
    kept = [set(leaks.winnow(leaks.gram_hashes(leaks.compact(t), leaks.GRAM)).tolist()) for t in (a, b)]
    assert kept[0] & kept[1]


def test_rolling_hash_equals_equal_runs():
    c = leaks.compact("abcabcabcabcxyzabcabcabc")
    h = leaks.gram_hashes(c, 6)
    runs = [tuple(c[i : i + 6].tolist()) for i in range(len(c) - 5)]
    for i in range(len(runs)):
        for j in range(len(runs)):
            assert (h[i] == h[j]) == (runs[i] == runs[j])


def test_compact():
    assert bytes(leaks.compact("Ä <b>b</b>-c&amp;1 ﬁ").astype(np.uint8)).decode() == "abc1fi"
    assert len(leaks.compact("日本語")) == 3 and len(leaks.compact("")) == 0
