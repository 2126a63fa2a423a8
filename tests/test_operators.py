import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.operators import matching, records, selection, trends, vectors, vocabulary
from papyrine.operators.components import components
from papyrine.sources import files
from papyrine.streaming import ingest


@pytest.mark.parametrize("seed", range(4))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(120), rng.randrange(90)) for _ in range(130)] + [(None, 1), (1, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, k in rows:
        if n is not None and k is not None:
            a, b = root(("n", n)), root(("k", k))
            parent[a] = b
    groups = {}
    for n, k in rows:
        if n is not None and k is not None:
            groups.setdefault(root(("n", n)), set()).add(n)
    want = {n: min(g) for g in groups.values() for n in g}
    df = spark.createDataFrame(rows, "node long, key long")
    assert {r.node: r.component for r in components(df).collect()} == want


def test_components_chain_and_hub(spark):
    chain = [(i, i // 2 * 10 + 1) for i in range(40)] + [(i, (i + 1) // 2 * 10 + 2) for i in range(40)]
    hub = [(i, 5) for i in range(1000, 3000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + hub, "node long, key long")).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[i] == 1000 for i in range(1000, 3000))
    assert components(spark.createDataFrame([], "node long, key long")).count() == 0


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {(r.id, r["rank"]): r.neighbour for r in vectors.knn(df, df, "id", "v", 4, block=40).collect()}
    s = v @ v.T
    for i in range(150):
        order = sorted((j for j in range(150) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order


def test_near_pairs_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    s = v @ v.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 3}
    assert {(r.a, r.b) for r in vectors.near_pairs(df, "id", "v", 3.0, block=20).collect()} == want


def test_compact_round_trip(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 12))
    v = rng.normal(size=(60, 3)) @ base
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    codes = vectors.compact_vectors(df, "id", "v", 3)
    back = {r.id: np.array(r.vec) for r in vectors.expand_codes(codes, "id").collect()}
    assert len(back) == 60 and all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in back.values())


def test_groups():
    x = np.vstack([np.tile([1.0, 0, 0], (10, 1)), np.tile([0, 1.0, 0], (10, 1)), np.tile([0, 0, 1.0], (10, 1))])
    assert len(set(vectors.group_selection(x).tolist())) == 3
    assert set(vectors.group_selection(x[:2])) == {0}


@pytest.mark.parametrize("seed", range(3))
def test_containment_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"word{chr(97 + i)}" for i in range(12)] + ["of", "in", "a"]
    texts = [(i, " ".join(rng.choices(words, k=40))) for i in range(40)]
    needles = [(i, " ".join(rng.choices(words, k=3)) if i % 2 else " ".join(texts[i][1].split()[5:9])) for i in range(30)]
    got = {(r.t, r.n) for r in matching.contained_in(spark.createDataFrame(needles, "n long, needle string"), spark.createDataFrame(texts, "t long, body string"), "n", "needle", "t", "body", 10, None).collect()}
    want = {(t, n) for t, b in texts for n, x in needles if len(x) >= 10 and any(len(w) >= 4 for w in x.split()) and f" {x} " in f" {b} "}
    assert got == want


@pytest.mark.parametrize("theta", [0.5, 0.7, 0.85])
def test_fuzzy_titles_against_brute_force(spark, theta):
    rng = random.Random(7)
    words = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(14)]
    left = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 8)))) for i in range(60)] + [(98, ""), (99, None)]
    right = [(1000 + i, " ".join(rng.choices(words, k=rng.randrange(3, 8)))) for i in range(60)]
    m = matching.fuzzy_match(spark.createDataFrame(left, "l long, title string"), spark.createDataFrame(right, "r long, title string"), "l", "r", theta=theta)
    got = {x.l: (x.outcome, x.r, x.score) for x in m.collect()}
    by_text = {}
    for r, t in right:
        by_text.setdefault(t, r)
    for i, t in left:
        tk = set((t or "").split())
        if t and t in by_text:
            assert got[i][:2] == ("exact", by_text[t])
            continue
        if not tk:
            assert got[i][0] == "no-tokens"
            continue
        s = sorted(((len(tk & set(u.split())) / len(tk | set(u.split())), -r) for u, r in by_text.items()), reverse=True)
        s = [x for x in s if x[0] >= theta]
        if not s:
            assert got[i][0] == "none"
        elif len(s) > 1 and s[1][0] >= s[0][0] - 0.05:
            assert got[i][0] == "ambiguous"
        else:
            assert got[i][:2] == ("fuzzy", -s[0][1]) and abs(got[i][2] - s[0][0]) < 1e-9


def test_fuzzy_titles_of_common_words(spark):
    """Titles of a few words in all kinds of orders: what is compared does not grow with the square of the titles."""
    from tests.test_views import written

    rng = random.Random(11)
    words = [f"word{chr(97 + i)}" for i in range(26)]
    long = [rng.sample(words, 20) for _ in range(30)]
    left = [" ".join(rng.sample(words, 8)) for _ in range(4000)] + [" ".join(t) for t in long]
    right = [" ".join(rng.sample(words, 8)) for _ in range(4000)] + [left[i].rsplit(" ", 1)[0] if i % 3 else left[i] for i in range(300)]
    right += [" ".join(rng.sample(t[: 18 + i % 2], 18)) for i, t in enumerate(long)] + [" ".join([*t, "wordxx", "wordyy", "wordzz"][i % 2 :]) for i, t in enumerate(long)]
    l, r = spark.createDataFrame(list(enumerate(left)), "l long, title string"), spark.createDataFrame(list(enumerate(right)), "r long, title string")
    before = written(spark)
    got = {x.l: (x.outcome, x.r) for x in matching.fuzzy_match(l, r, "l", "r").collect()}
    assert (moved := written(spark) - before) < 3_000_000, moved
    texts: dict = {}
    for i, t in enumerate(right):
        texts.setdefault(t, i)
    sets = [(set(t.split()), i) for t, i in texts.items()]
    kinds = set()
    for i, t in [*enumerate(left)][:330] + [*enumerate(left)][4000:]:
        a = set(t.split())
        s = sorted((-len(a & b) / len(a | b), j) for b, j in sets if len(a & b) >= 0.85 * len(a | b))
        want = ("exact", texts[t]) if t in texts else ("none", None) if not s else ("ambiguous", None) if len(s) > 1 and s[1][0] <= s[0][0] + 0.05 else ("fuzzy", s[0][1])
        assert got[i] == want, (t, got[i], want)
        kinds.add(want[0])
    assert kinds == {"exact", "none", "ambiguous", "fuzzy"}


def test_aliases(spark):
    counts = [("reinforcement learning (rl)", 5), ("RL", 3), ("diffusion models", 4), ("diffusion model", 2), ("policies", 1), ("robotics", 2), ("reinforcement learning", 1)]
    got = {r.name: r.canonical for r in vocabulary.learn_aliases(spark.createDataFrame(counts, "name string, n long")).collect()}
    assert got["RL"] == got["reinforcement learning (rl)"] == "reinforcement learning"
    assert got["diffusion models"] == "diffusion model" and got["policies"] == "policies" and got["robotics"] == "robotics"


def test_parents(spark):
    l = spark.createDataFrame([("sparse graph matching", 1), ("graph matching", 5), ("matching", 9), ("mismatching", 1)], "label string, n long")
    got = {r.label: r.parent for r in vocabulary.find_parents(l, l, "n").collect()}
    assert got == {"sparse graph matching": "graph matching", "graph matching": "matching"}


def test_movers(spark):
    df = spark.createDataFrame([("a", 10, 100, 1000, 1000), ("b", 0, 50, 1000, 1000), ("c", 100, 10, 1000, 1000), ("d", 50, 51, 1000, 1000), ("e", 0, 0, 0, 0)], "k string, n0 long, n1 long, t0 long, t1 long")
    assert {r.k: r.direction for r in trends.movers(df).collect()} == {"a": "rising", "b": "new", "c": "falling", "d": "steady", "e": "steady"}


def test_adjusted_p(spark):
    df = spark.createDataFrame([("x", i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5])], "g string, i long, p double")
    got = [r.p_adjusted for r in trends.adjusted_p(df, "p", ["g"], "i").orderBy("i").collect()]
    assert [round(x, 4) for x in got] == [0.04, 0.04, 0.04, 0.5]


def test_global_ids(spark):
    df = spark.createDataFrame([(c, i) for c in "bca" for i in range(30, 0, -1)], "c string, i long")
    got = [(r.c, r.i) for r in records.global_ids(df, "c", "i").orderBy("gid").collect()]
    assert got == sorted(got) and len(got) == 90


@pytest.mark.parametrize("share", [0.001, 0.1, 0.5, 1.0])
def test_sample_is_the_smallest_hashes(spark, share):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else "rare") for i in range(3000)] + [(5000, None)], "i long, s string")
    got = records.stratified_sample(df, "s", "i", share)
    hashed = [tuple(r) for r in df.select("s", "i", F.xxhash64(F.lit(11), "i")).collect()]
    want = set()
    for s in {x[0] for x in hashed}:
        rows = sorted((h, i) for t, i, h in hashed if t == s)
        want |= {i for _, i in rows[: max(1, int(len(rows) * share + 0.5))]}
    assert {r.i for r in got.collect()} == want and got.columns == ["i", "s"]


def test_coverage_gate(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "i long, a string")
    assert records.require_coverage(df, "a", 0.5).count() == 2
    with pytest.raises(ValueError):
        records.require_coverage(df, "a", 0.9)


def test_chips(spark):
    df = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "y", ["b"]), (3, None, None), (4, "x", ["c"])], "d long, k string, m array<string>")
    got = {(r.facet, r.value): r.n for r in selection.chip_counts(df, {"k": ["x"], "m": ["b"]}, "d").collect()}
    assert got == {("k", "x"): 1, ("k", "y"): 1, ("m", "a"): 1, ("m", "b"): 1, ("m", "c"): 1}
    assert {(r.facet, r.value): r.n for r in selection.chip_counts(df, {"k": [], "m": []}, "d").collect()}[("k", "x")] == 2


def test_pick_disjoint():
    assert selection.pick_disjoint(["sample size", "size", "noise", "noise level", "cost"], 3) == ["sample size", "noise", "cost"]


def test_sources(spark, tmp_path):
    empty = files.read_jsonl(spark, str(tmp_path / "none"), "a long, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    files.write_jsonl(spark.createDataFrame([(1, "x"), (2, None)], "a long, b string"), str(tmp_path / "j"))
    assert {tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "j"), "a long, b string").collect()} == {(1, "x"), (2, None)}
    feed = spark.createDataFrame([("one",), ("two",)], "body string")
    root = str(tmp_path / "s")
    assert files.latest_snapshot(spark, root) is None
    assert files.add_snapshot(feed, root, "2026-01-01", "body") and not files.add_snapshot(feed, root, "2026-01-01", "body") and not files.add_snapshot(feed.limit(0), root, "2026-01-02", "body")
    assert files.latest_snapshot(spark, root).count() == 2
    page = spark.createDataFrame([('<div class="paper"><p class="title">A <i>b</i></p><a href="x.html">abs</a><a href="x.pdf">pdf</a></div><div class="paper"><p class="title">C</p></div>',)], "html string")
    assert [tuple(r) for r in files.split_listing(page, "html", []).collect()] == [("A b", "x.pdf", "x.html"), ("C", None, None)]
    xml = spark.createDataFrame([("<record><id>1</id><title>A\n b</title><created>2024-01-02</created></record><record status=\"deleted\"><id>2</id></record>",)], "xml string")
    assert [tuple(r) for r in files.harvest_records(xml, "xml").collect()] == [("1", "A b", "2024-01-02")]


def test_bibtex_keys(spark):
    p = spark.createDataFrame([(1, "V", 2025, "A Study of Graphs", ["Ann Lee"], "u"), (2, "V", 2025, "The Study Again", ["Lee, Bo"], "u"), (3, "V", 2025, "", ["X"], "u")], "event_id long, venue string, year int, title string, authors array<string>, paper_url string")
    got = {r.event_id: r for r in files.bibtex(p).collect()}
    assert {i: r.cite_key for i, r in got.items()} == {1: "lee2025study", 2: "lee2025studya"} and "author = {Ann Lee}" in got[1].entry


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i % 3, i) for i in range(30)], "k long, v long").repartition(3).write.parquet(src)
    s = ingest.file_stream(spark, src, "k long, v long", 1)
    q = ingest.running_counts(s, "k").writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.k: r.n for r in spark.table("running").groupBy("k").agg(F.max("n").alias("n")).collect()}
    assert last == {0: 10, 1: 10, 2: 10}
