from pyspark.sql import functions as F

from papyrine.functions import rules as R
from papyrine.functions import text as X
from papyrine.operators import enrichment as En


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"v{i}") for i in range(len(values))]).alias("r")).first().r


def test_families(spark):
    fam = lambda s, rules: one(spark, lambda c: X.classify(c, rules, "Other"), s)
    assert fam("adversarial robustness", R.TASK_FAMILIES) == "Trust & safety" and fam("graph matching", R.TASK_FAMILIES) == "Data types & structure" and fam("xyz", R.TASK_FAMILIES) == "Other"
    assert fam("Hilbert Space", R.METHOD_FAMILIES) == "Other" and fam("BERT", R.METHOD_FAMILIES) == "Foundation models" and fam(None, R.METHOD_FAMILIES) == "Other"


def test_domains(spark):
    d = lambda s: tuple(one(spark, En.domain_of, s))
    assert d("Meteorology") == ("weather forecasting", "Physical sciences & earth") and d("self-driving") == ("autonomous driving", "Robotics & autonomy")
    assert d("real-world application") == (None, None) and d("null") == (None, None) and d(None) == (None, None)


def test_results(spark):
    df = spark.createDataFrame([(None, None, ["We improve it.", "It improves by 5%."]), ("", "c", ["We improve it."]), ("r", None, None), (None, "c", ["A new view."])], "result string, claim string, spans array<string>")
    got = [r.r for r in df.select(En.result_or_span(F.col("result"), F.col("claim"), F.col("spans")).alias("r")).collect()]
    assert got == ["It improves by 5%.", "We improve it.", "r", None]


def test_names(spark):
    df = spark.createDataFrame([(["a", None, "", "in博弈论", "a", "b"],)], "n array<string>")
    assert df.select(En.clean_names(F.col("n")).alias("n")).first().n == ["a", "b"]


def test_figures_survive(spark):
    ok = lambda a, b: one(spark, En.figures_survive, a, b)
    assert not ok("31 name it, 3 attack it", "31 name it") and ok("4.4 of 3,324", "von 3324 sind 4.4") and ok("3k rows", "3,000 rows")


def test_mapping_and_caches(spark):
    t = spark.createDataFrame([("RL",), ("x",)], "name string")
    m = spark.createDataFrame([("rl", "reinforcement learning"), ("reinforcement learning", "rl methods")], "term string, canonical string")
    o = spark.createDataFrame([("x", "why")], "term string, canonical string")
    assert {r.name: r.canonical for r in En.rename_terms(t, "name", m, o).collect()} == {"RL": "rl methods", "x": "why"}
    c = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, s long, v string")
    assert [r.v for r in En.last_write(c, "k", "s").collect()] == ["new"]
    reg = spark.createDataFrame([("a/b",), ("c/d",), ("e/f",), ("g/h",)], "key string")
    cache = spark.createDataFrame([("a/b", True, False, False, "A/B"), ("c/d", True, False, False, "x/y"), ("e/f", True, True, False, "e/f")], "key string, found boolean, gone boolean, error boolean, name string")
    assert {r.key: r.status for r in En.registry_status(reg, cache, "key").collect()} == {"a/b": "ok", "c/d": "renamed", "e/f": "gone", "g/h": "unknown"}


def test_relations(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "citing long, cited long")
    p = spark.createDataFrame([(1, 2), (1, 3), (3, 1), (2, 3)], "a long, b long")
    assert {(r.a, r.b): r.relation for r in En.relation(p, e, "a", "b").collect()} == {(1, 2): "both", (1, 3): "cites", (3, 1): "cited by", (2, 3): "none"}
    m = spark.createDataFrame([("t", 1, 1), ("t", 1, 2), ("t", 2, 2)], "topic string, doc long, kind int")
    assert {r.doc: r.near for r in En.near_badge(m, "topic", "doc").collect()} == {1: False, 2: True}


def test_metrics(spark):
    f = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "k string, i string")
    t = spark.createDataFrame([("q", "a"), ("s", "y")], "k string, i string")
    got = {r.k: (r.found, r.wanted, r.hit, r.recall, r.precision) for r in En.set_metrics(f, t, "k", "i").collect()}
    assert got == {"q": (2, 1, 1, 1.0, 0.5), "r": (1, 0, 0, None, 0.0), "s": (0, 1, 0, 0.0, None)}


def test_ranges_and_cites(spark):
    assert En.pick_ranges([(0, 5, 1, "a"), (3, 12, 2, "b"), (12, 14, 1, "c"), (4, 4, 0, "d")]) == [(3, 12, "b"), (12, 14, "c")]
    got = one(spark, En.governor_cites, "As Lee et al. (2024) and (Chan and Miller, 2019) say")
    assert [tuple(x) for x in got] == [("Lee", "2024"), ("Chan", "2019")]
    assert one(spark, En.declines, "I cannot find it") and not one(spark, En.declines, "Here it is")
