"""Rows worked out by hand, and brute force, for what SQL only sees on one kind of input."""

import random

import pytest

from papyrine.operators import extraction as E
from papyrine.operators import matching as M
from papyrine.operators import prediction as P
from papyrine.operators import selection as S
from papyrine.operators import views as V
from papyrine.operators import vocabulary as Voc


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    from pyspark.sql import functions as F

    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_gap_scan(spark):
    rows = [
        (1, "Existing methods suffer from label noise in sensors.", "We remove label noise.", 2024), (2, "They are limited by label noise and drift.", "a new loss", 2025),
        (3, "Label noise remains a challenge.", "another loss", 2025), (4, "Sensors drift over time; sensors fail.", "drift is attacked", 2026), (5, "Long sensors drift badly.", None, 2026),
        (6, "Slow drift hurts.", "x", 2026), (7, None, "label noise", 2026), (8, "", "label noise", 2026), (9, "Unrelated matter alone.", "", 2025),
    ]
    df = spark.createDataFrame(rows, "id long, l string, a string, y int")
    got = S.gap_scan(df, "id", "l", "a", "y").orderBy("rank").collect()
    assert [(r.term, r.named, r.attacked, r.motivation, r.years, r.id) for r in got] == [("label noise", 3, 1, 2, "2024:1 2025:2", 3), ("sensors", 3, 0, 3, "2024:1 2026:2", 5)][::-1]
    assert got[0].sentence == "Long sensors drift badly."
    # the topic's own words are no failure
    assert [r.term for r in S.gap_scan(df, "id", "l", "a", "y", "Sensors").collect()] == ["label noise"]
    assert S.gap_scan(df.limit(0), "id", "l", "a", "y").count() == 0


def test_terms_that_are_not_named_verbatim_are_set_aside(spark):
    """Pairs are formed after stop words, so a pair may stand nowhere as it is; the next term takes its place."""
    rows = [(i, "Noise from sensors." if i < 3 else f"Only matter{chr(97 + i)} here.", "", 2024) for i in range(15)]
    df = spark.createDataFrame(rows, "id long, l string, a string, y int")
    assert "noise sensors" in {r.term for r in S.gap_terms(df, "id", "l").collect()}
    assert {r.term for r in S.gap_scan(df, "id", "l", "a", "y").collect()} == set()
    assert {r.term for r in S.gap_scan(df.withColumn("l", df.l.substr(1, 99)).union(spark.createDataFrame([(20 + i, "Noise sensors again.", "", 2024) for i in range(3)], df.schema)), "id", "l", "a", "y").collect()} == {"noise sensors", "sensors again"}


def test_hyphens(spark):
    cases = {"condition- ing": "conditioning", "token- level": "token-level", "condi- tional": "conditional", "func- tions": "functions", "gen- eration": "gen-eration", "mea- sure- ment": "mea-surement", "Multi- Task": "Multi- Task"}
    for a, b in cases.items():
        assert one(spark, E.dehyphen, a) == b, a


def test_links(spark):
    rows = [
        (1, "abstract", "Code: https://github.com/lab/own.git.", ["Own"]), (1, "intro", "We adopt the code from https://github.com/other/base. Our data are at https://zenodo.org/record/1234567.", ["Own"]),
        (1, "references", "https://github.com/never/seen", ["Own"]), (2, None, "We use https://huggingface.co/datasets/a/b for tests.", None),
        (2, None, "All weights will be released at https://hf.co/lab/SuperNet-v2 soon.", ["SuperNet"]), (3, None, None, None), (4, "intro", "See 4https://github.com/topics/x and https://example.org/y.", None),
    ]
    df = spark.createDataFrame(rows, "id long, bucket string, text string, names array<string>")
    got = {(r.id, r.own, r.kind, r.host, r.repo, r.evidence) for r in E.links(df, "id", "text", "bucket", "names").collect()}
    assert got == {(1, True, "code", "gh", "lab/own", "p"), (1, False, "code", "gh", "other/base", ""), (1, True, "data", "zenodo", "1234567", "o"), (2, False, "data", "hfd", "a/b", ""), (2, True, "model", "hfm", "lab/SuperNet-v2", "anl")}
    many = spark.createDataFrame([(1, " ".join(f"Our code is at https://github.com/lab/r{i}. See https://github.com/x/m{i}." for i in range(40)))], "id long, text string")
    kept = E.links(many, "id", "text").groupBy("own").count().collect()
    assert {r.own: r["count"] for r in kept} == {True: 4, False: 25}


def test_evaluate_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 9}", f"t{i:03}", float(rng.randrange(6)), float(rng.random()), rng.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(rows, "field string, technique string, a double, b double, hit boolean").repartition(7)
    got = {r.scorer: r for r in P.evaluate(df, ("a", "b"), "hit", "field", "technique").collect()}
    for name, k in (("a", 2), ("b", 3)):
        order = sorted(rows, key=lambda r: (-r[k], r[0], r[1]))
        hits = [r[4] for r in order]
        n, ap = 0, 0.0
        for i, h in enumerate(hits, 1):
            n += h
            ap += n / i if h else 0
        assert (got[name].candidates, got[name].hits) == (300, n) and abs(got[name].average_precision - ap / n) < 1e-12
        assert all(abs(got[name][f"p_{c}"] - sum(hits[:c]) / c) < 1e-12 for c in (10, 25, 50, 100))


def test_scores(spark):
    df = spark.createDataFrame([("f", "t", 4, 5, 0.0, 0.5, 0, False), ("f", "u", 4, 2, 2.0, 0.1, 3, True), ("g", "t", 1, 5, 1.0, 0.3, 1, False)], "field string, technique string, nf long, nt long, cf double, lim double, n_fields long, hit boolean")
    got = {(r.field, r.technique): r for r in P.scores(df).collect()}
    assert got["f", "t"].pa == 20 and got["f", "t"].lim_cf == 0 and abs(got["g", "t"].lim_cf - 0.25) < 1e-12 and got["f", "u"].lim_cf == 0
    assert abs(got["f", "u"].lim_spec - 0.1 / 1.6094379124341003) < 1e-12


def written(spark) -> int:
    """Bytes that all shuffles so far have written."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_contained_both_ways(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "epsilon", "zeta"]
    needles = [(i, " ".join(rng.choices(words, k=5))) for i in range(40)] + [(40, "of the of the of the of the"), (41, None), (42, "")]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, "xalpha beta"), (82, needles[0][1])]
    n, t = spark.createDataFrame(needles, "n long, needle string"), spark.createDataFrame(texts, "t long, body string")
    want = {(j, i) for i, a in needles for j, b in texts if a and b and len(a) >= 20 and f" {a} " in f" {b} " and any(len(w) >= 4 for w in a.split())}
    for chars in (10**6, 0):
        got = {(r.t, r.n) for r in M.contained_in(n.where("needle not like 'of the of%'"), t, "n", "needle", "t", "body", least=20, most_hits=None, sent_chars=chars).collect()}
        assert got == want, chars
    few = {r.n for r in M.contained_in(n, t, "n", "needle", "t", "body", least=20, most_hits=1).collect()}
    assert few == {i for i in {i for _, i in want} if sum(k == i for _, k in want) == 1}


def test_contained_beyond_the_automaton(spark):
    """Every needle is found, of short words too, in whatever parts they are sent, and the texts do not move."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "of", "the", "a", "zeta", "naïve"]
    needles = [(i, " ".join(rng.choices(words, k=rng.randrange(4, 9)))) for i in range(300)] + [(300, "of the of the of the of the"), (301, "of the of the of the of the")]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 400)))) for i in range(120)] + [(120, needles[300][1]), (121, needles[300][1] + "x"), (122, None), (123, "of the of the"), (124, "of the of the " * 100_000)]
    n, t = spark.createDataFrame(needles, "n long, needle string"), spark.createDataFrame(texts, "t long, body string").coalesce(1)
    want = {(j, i) for i, a in needles for j, b in texts if b and len(a) >= 20 and f" {a} " in f" {b} "}
    assert {i for _, i in want} >= {300, 301}
    for parts in ({}, {"pass_needles": 77}):
        before = written(spark)
        got = M.contained_in(n, t, "n", "needle", "t", "body", least=20, most_hits=None, sent_chars=0, **parts).collect()
        assert len(got) == len(want) and {(r.t, r.n) for r in got} == want, parts
        assert written(spark) - before < 60_000  # the pairs found; the words of the texts took more


def test_first_text_of_equal_quotes(spark):
    """A thousand equal quotes in a thousand texts take a row for each, not one for each pair."""
    quote = "the sparse kernel converges quickly in practice"
    q = spark.createDataFrame([(i, quote) for i in range(1000)] + [(1000, "a quote that stands nowhere at all"), (1001, None)], "quote_id long, quote string")
    t = spark.createDataFrame([(f"d{i:04}", f"{i} {quote} {i}") for i in range(1, 1001)] + [("d0000", quote + "x")], "doc_id string, text string").repartition(3)
    for chars in (10**6, 0):
        before = written(spark)
        got = M.contained_in(q, t, "quote_id", "quote", "doc_id", "text", least=20, most_hits=None, sent_chars=chars, first=True).collect()
        assert sorted((r.quote_id, r.doc_id) for r in got) == [(i, "d0001") for i in range(1000)], chars
        assert written(spark) - before < 300_000  # the pairs took more
    before = written(spark)
    assert sorted((r.quote_id, r.doc_id) for r in V.quoted_anywhere(q, t, "quote", "quote_id", "doc_id", "text").collect()) == [(i, "d0001") for i in range(1000)]
    assert written(spark) - before < 300_000


@pytest.mark.parametrize("name", ["title_mentions", "quotes_anywhere", "citation_degrees", "governing_refs"])
def test_mentions_beyond_the_automaton_as_sql(spark, small, monkeypatch, name):
    """Where needles are too many for the automaton, the query still agrees with its SQL."""
    import functools

    from papyrine import plans
    from tests import oracle

    monkeypatch.setattr(M, "contained_in", functools.partial(M.contained_in, sent_chars=0))
    folder = small.replace("sf0.001", "sf0.01")
    assert oracle.check(spark, oracle.connect(folder), folder, plans.queries()[name], plans.oracle_sql()[name]) > 0


def test_long_vocabulary_labels_fold(spark):
    long = "a b c d e f g h i j k l"
    labels = spark.createDataFrame([(f"x {long} y",), ("x y",), (long,)], "label string")
    vocabulary = spark.createDataFrame([(long,), ("x y z",)], "label string")
    assert [(r.label, r.topic) for r in Voc.fold_labels(labels, vocabulary).collect()] == [(f"x {long} y", long)]


def test_citation_marks(spark):
    import re

    for ref, text, hit in (
        ("Anderson and Rubin (1949b). Title", "as in Anderson  & Rubin (1949b), we", True), ("Anderson and Rubin (1949b). Title", "Anderson and Rubin, 1949b", True), ("Anderson and Rubin (1949b). Title", "Anderson and Rubin (1949)", False),
        ("Lee et al. (2024) X", "(Lee et al., 2024)", True), ("Lee et al. (2024) X", "(Lee et al., 2024a)", False), ("Lee et al. (2024) X", "(Leexet al., 2024)", False), ("no year here", "x", None), ("1 (2024) X", "x", None),
    ):
        m = one(spark, V.citation_marker, ref)
        assert (m is not None and bool(re.search(m, text))) == bool(hit) and (m is None) == (hit is None), (ref, text, m)


def test_governing_reference(spark):
    cites = spark.createDataFrame([(1, "Lee et al. (2024)"), (1, "Nobody (2020)"), (1, "Kim (2023)"), (2, "Lee (2024)")], "doc long, cite string")
    refs = spark.createDataFrame([(1, "Lee and Chan (2024). A very long title of a known work. Venue."), (1, "Kim (2023). Unknown. arXiv:2301.00001"), (3, "Lee (2024). Other")], "doc long, ref string")
    titles = spark.createDataFrame([("p1", "A very long title of a known work"), ("p2", "long title of a known work")], "target string, title string")
    got = {(r.doc, r.cite): r.target for r in V.governing_reference(cites, refs, "doc", "cite", "ref", titles).collect()}
    assert got == {(1, "Lee et al. (2024)"): "p1", (1, "Kim (2023)"): "2301.00001"}


def test_finalize(spark):
    source = "We show that the sparse kernel con- verges quickly, in practice. It remains costly to compute at scale."
    rows = [(source, ["the sparse kernel converges quickly", "the dense kernel converges quickly", "short"], "It remains costly, to compute at scale", "  ", "an invented sentence of some length", "unknown", [("m", "proposed")]), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "src string, novelty_spans array<string>, limitation string, key_change string, result_claim string, contribution_type string, methods array<struct<name: string, role: string>>")
    a, b = V.finalize(df, "src").collect()
    assert (a.kept, a.dropped, a.inconsistent, a.novelty_spans, a.key_change, a.result_claim) == (2, 3, True, ["the sparse kernel converges quickly"], None, None) and a.limitation
    assert (b.kept, b.dropped, b.inconsistent, b.novelty_spans) == (0, 0, False, [])


def test_changed_rows_fold_spellings(spark):
    items = [("V", s, d, "dataset", "cifar10", n) for s, d, n in [(0, 1, "CIFAR-10"), (0, 1, "CIFAR 10"), (0, 2, "CIFAR-10"), (1, 3, "Cifar10")]] + [("V", 1, 3, "task", None, None), ("V", 1, 4, "topic", "x", "x")]
    df = spark.createDataFrame(items, "venue string, side int, doc long, axis string, item string, shown string")
    totals = spark.createDataFrame([("V", 10, 20)], "venue string, t0 long, t1 long")
    got = V.changed_rows(df, totals, {"dataset": 3, "topic": 2, "task": 1}).collect()
    assert [(r.item, r.shown, r.n0, r.n1, r.share0, r.share1) for r in got] == [("cifar10", "CIFAR-10", 2, 1, 200.0, 50.0)]


def test_external_ids_and_fields(spark):
    p = spark.createDataFrame([(1, "2401.1"), (2, "2401.2"), (3, None)], "gid long, arxiv_base string")
    found = spark.createDataFrame([("2401.1", "10.1/x", "s1")], "id string, doi string, s2 string")
    assert {(r.gid, r.doi, r.s2) for r in V.external_ids(p, "arxiv_base", found).collect()} == {(1, "10.1/x", "s1"), (2, "10.48550/arXiv.2401.2", None)}
    m = spark.createDataFrame([("gh", "a/b", 5, False, "d"), ("gh", "a/c", 7, True, "e")], "host string, repo string, stars long, gone boolean, at string")
    assert {(r.repo, r.stars, r.status, r.checked) for r in V.public_fields(m).collect()} == {("a/b", 5, None, "d"), ("a/c", None, "not found", "e")}


def test_semantic_extras_need_three_seeds(spark):
    v = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(8)] + [(20, [-1.0, 0.0])], "doc long, vec array<double>")
    hits = lambda n: spark.createDataFrame([(i, float(9 - i)) for i in range(n)], "doc long, score double")
    assert V.semantic_extras(hits(2), v, "doc", "vec").count() == 0
    assert {r.doc for r in V.semantic_extras(hits(4), v, "doc", "vec").collect()} <= {4, 5, 6, 7}


def test_fetched(spark):
    df = spark.createDataFrame([("a", b"%PDF" + b"x" * 9000), ("a", b"%PDF" + b"x" * 9000), ("b", b"<html>" + b"x" * 9000), ("c", b"%PDF")], "id string, content binary")
    assert [r.id for r in V.fetched(df, "id", "content").collect()] == ["a"]


def test_tex_is_shown_as_signs(spark):
    for a, b in {
        r"ME$^2$ and x_i": "ME² and xᵢ", r"\alpha + \beta_{ij}": "α + βᵢⱼ", r"x^{Q}": "x^(Q)", r"10\% of \$5": "10% of $5", r"see \cite{lee} now": "see now", r"\textbf{\emph{x}} \alphabet": "x",
        "_really_ so": "really so", "ˆV and ``q''": "V̂ and “q”", r"a \leq b": "a ≤ b",
    }.items():
        assert one(spark, E.detex, a) == b, a


def test_elided_openings(spark):
    for a, b in {
        "To address these open issues, we introduce a framework that maps long inputs.": "a framework that maps long inputs.", "We show that it holds.": "We show that it holds.",
        "Moreover, this work studies a very long matter of importance to all.": "a very long matter of importance to all.", "However, nothing is cut.": "nothing is cut.", "The model is large.": "The model is large.",
    }.items():
        assert one(spark, E.elide, a) == b, a


def test_registry_order_and_checks(spark):
    r = spark.createDataFrame([(1, "GSM8K", ["gsm 8k"], "openai/gsm8k", None, "u", True, None), (2, "gsm8k dataset", None, "x/y", None, None, True, None), (3, "MATH", None, "m/m", "g/m", None, False, True), (4, "Other", None, None, None, None, None, None)], "pos long, name string, aliases array<string>, hf string, gh string, url string, hf_ok boolean, gh_ok boolean")
    m = spark.createDataFrame([("GSM-8K",), ("the MATH benchmark",), ("Other",), ("absent",), (None,)], "name string")
    got = {x.name: (x.listed, x.place, x.host) for x in V.benchmark_places(m, r).collect()}
    assert got == {"GSM-8K": ("GSM8K", "https://huggingface.co/datasets/openai/gsm8k", "huggingface"), "the MATH benchmark": ("MATH", "https://github.com/g/m", "github"), "Other": ("Other", None, None), "absent": (None, None, None), None: (None, None, None)}


def test_overlap_both_ways(spark):
    rng = random.Random(9)
    rows = list({(f"f{rng.randrange(12)}", f"t{rng.randrange(30)}") for _ in range(150)})
    df = spark.createDataFrame(rows, "field string, technique string")
    got = [{(r.field, r.technique): r.cf for r in P.overlap_scores(df, "field", "technique", n).collect()} for n in (10**6, 10, 0)]
    assert set(got[0]) == set(got[1]) == set(got[2]) and all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])
    assert P.overlap_scores(df.limit(0), "field", "technique").count() == 0
