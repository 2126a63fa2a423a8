import pytest
from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import extraction as E
from papyrine.operators import matching as M
from papyrine.operators import verification as V


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"v{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize("name, key", [
    ("GSM8K", "gsm8k"), ("MATH-500", "math500"), ("the LIBERO benchmark", "libero"), ("AIME '24", "aime24"), ("CIFAR 10", "cifar10"), ("HumanEval+", "humaneval+"),
    ("ImageNet 256x256", "imagenet256x256"), ("MS-COCO dataset", "mscoco"), ("AlpacaEval 2.0", "alpacaeval20"), (None, None),
])
def test_dataset_key(spark, name, key):
    assert one(spark, X.dataset_key, name) == key


@pytest.mark.parametrize("name, key, acronym", [
    ("Group Relative Policy Optimization (GRPO)", "group relative policy optimization", "grpo"), ("Bradley-Terry (BT) model", "bradley terry model", "bt"), ("Bradley–Terry model", "bradley terry model", None),
    ("(GRPO)", "grpo", None), ("three datasets", "", None), ("diffusion models", "diffusion model", None),
])
def test_method_key(spark, name, key, acronym):
    assert tuple(one(spark, X.method_key, name)) == (key, acronym)


@pytest.mark.parametrize("name, is_one", [("three datasets", True), ("image datasets", True), ("real-world data", True), ("LoCoMo benchmark", False), ("SCOPE dataset", False)])
def test_placeholder(spark, name, is_one):
    assert one(spark, X.is_placeholder, name) is is_one


def test_small_keys(spark):
    assert tuple(one(spark, X.split_topic, "Deep Learning->Attention Mechanisms")) == ("Deep Learning", "Attention Mechanisms")
    assert tuple(one(spark, X.split_topic, "->")) == (None, None)
    assert one(spark, X.institution, "Tsinghua University, Tsinghua University") == "Tsinghua University"
    assert one(spark, X.institution, " Acme,  Inc. ") == "Acme" and one(spark, X.institution, " , ") is None
    assert one(spark, X.dedupe_key, "Été À-la_x") == "étéàla_x"
    assert one(spark, X.submission_id, "/forum?id=Ab_-9") == "Ab_-9" and one(spark, X.submission_id, "/forum") is None
    assert one(spark, lambda c: X.classify(c, X.TRACK_RULES, "other"), "x/2025/Conference") == "main" and one(spark, lambda c: X.classify(c, X.TRACK_RULES, "other"), None) == "other"
    assert one(spark, X.canon, "Classification Tasks") == "classification" and one(spark, X.canon, "robotics") == "robotics"
    assert one(spark, X.bibtex_escape, "a_b & \\c") == "a\\_b \\& \\textbackslash c"
    assert one(spark, lambda c: X.mark(c, "rate"), "Generate a Rate") == "Gene<i>rate</i> a <i>Rate</i>"
    assert one(spark, X.index_terms, "the graph kernel for graph") == ["graph", "kernel", "graph kernel"]
    assert one(spark, lambda c: X.bigrams(X.words(c)), "one") == []


def test_repairs(spark):
    assert one(spark, E.dehyphen, "condition- ing") == "conditioning" and one(spark, E.dehyphen, "token- level") == "token-level"
    assert one(spark, E.strip_citations, "It works [30, 16] well (Lee et al., 2024).") == "It works well."
    assert one(spark, E.detex, r"$\alpha$ is \textbf{bold} at 5\%") == "α is bold at 5%"
    assert one(spark, E.is_subsequence, "ace", "abcde") and not one(spark, E.is_subsequence, "aec", "abcde")
    assert one(spark, E.elide, "In this paper, we propose a method that is long enough to stay.") == "a method that is long enough to stay."


def test_sentences(spark):
    s = one(spark, M.sentences, "This follows Lee et al. Who did it before in Fig. 3 of it. The sec- ond sentence is long enough too. Short.")
    assert s == ["This follows Lee et al. Who did it before in Fig. 3 of it.", "The second sentence is long enough too."]


def test_contacts(spark):
    got = one(spark, E.contacts, "x Correspondence to: Tae-Hoon Lee <th.lee@kaist.ac.kr>, Min- Soo Kim (ms@x.org), Tae-Hoon Lee <TH.lee@kaist.ac.kr>. Preprint. z@z.org")
    assert [tuple(c) for c in got] == [("Tae-Hoon Lee", "th.lee@kaist.ac.kr"), ("MinSoo Kim", "ms@x.org")]
    assert [tuple(c) for c in one(spark, E.contacts, "Correspondence to: a@x.org, b@x.org, c@x.org")] == [(None, "a@x.org"), (None, "b@x.org")]
    assert one(spark, E.contacts, "no line") == []


def test_figures(spark):
    assert one(spark, V.figures, "z −0.09 in 2024, 3,324 -> 6,592 and 4.4%") == ["-0.09", "3324", "6592", "4.4"]
    assert V.pool_of({"attackers": [11, 12], "named_by": 7}) == [2.0, 7.0]
    assert V.pool_of({"by_year": [3, 4], "gid": 9, "results": {"n": 5}, "rows": [{"id": 12345, "n": 2}], "-2": "x7"}) == [3.0, 4.0, 2.0, -2.0, 7.0]
    assert V.pool_of({"5": True, "a": "1,000 and 3.5", "b": None}) == [5.0, 1000.0, 3.5]
    df = spark.createDataFrame([("4.4 and 31 and 99", [31.0, 705.0])], "t string, pool array<double>")
    assert [r.verdict for r in V.check_figures(df, "t", "pool").orderBy("pos").collect()] == ["derived", "ok", "no"]


def test_derived_figures(spark):
    df = spark.createDataFrame([("2 -1 0.333 33 66 9", [31.0, 33.0, 99.0])], "t string, pool array<double>")
    got = [r.verdict for r in V.check_figures(df, "t", "pool").orderBy("pos").collect()]
    assert got == ["derived", "no", "no", "ok", "derived", "no"]  # no negative value, and no third decimal, is derived


def test_quote_is_bounded_by_words(spark):
    body = "We show that the sparse kernel converges quickly in practice."
    role = lambda q: one(spark, lambda c, b: V.quote_role(c, [("abstract", b)]), q, body)
    assert role("the sparse kernel converges quickly") == "abstract" and role("the sparse kernel converges quick") is None and role("sparse kernel") is None


def test_segments(spark):
    df = spark.createDataFrame([(1, "As ⟦12|own words⟧ shows,\n ⟦field_trend:x|4.4⟧ of"), (2, ""), (3, None), (4, "⟦a|b⟧⟦c|d⟧"), (5, "no anchor ⟦ here")], "k long, t string")
    got = {}
    for r in V.answer_segments(df, "k", "t").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.pos, r.kind, r.ref, r.value))
    assert got == {
        1: [(0, "prose", None, "As "), (1, "quote", "12", "own words"), (2, "prose", None, " shows,\n "), (3, "figure", "field_trend:x", "4.4"), (4, "prose", None, " of")],
        4: [(0, "quote", "a", "b"), (1, "quote", "c", "d")], 5: [(0, "prose", None, "no anchor ⟦ here")],
    }


def test_sections():
    s = E.split_sections("Title line text here\n\n# Introduction\nWe do it.\n\nResults\nIt works.\n")
    assert [(x["heading"], x["text"]) for x in s] == [(None, "Title line text here"), ("Introduction", "We do it."), ("Results", "It works.")]
    page = "<h1>Intro</h1><p>" + "word " * 30 + "<br>more<aside>skip</aside><h2>Tiny</h2>no<section class='x appendix'>" + "late " * 40
    p = E.page_sections(page)
    assert [(x["heading"], x["appendix"]) for x in p] == [("Intro", False), (None, True)] and "skip" not in p[0]["text"]


def test_mask():
    text = "31 name `it`, BERT at 4.4%"
    hidden, held = E.mask(text)
    assert "31" not in hidden and E.unmask(hidden, held) == text
