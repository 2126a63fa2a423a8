import pytest

from papyrine.llm import canon

DATASETS = [(1, "Dihopivi-10", None), (2, "Dihopivi-100", None), (3, "Fenavajor 2023", None), (4, "Fenavajor 2024", None), (5, "Bodrujor-QA", None), (6, "Bodrujor-QA+", None), (7, "VubrieskkBench", None), (8, "Open Badigimi Sign Reading", "OBSR"), (9, "MS-BRUGAR", None)]
METHODS = [(11, "Anchored Policy Rank Pruning", "APRP"), (12, "Anchored Rank Matching", "ARMA"), (13, "Anchored Label Matching", "ALMA"), (14, "Kernel Flow Completion", None)]


@pytest.fixture(scope="module")
def names():
    return canon.Names(DATASETS), canon.Names(METHODS)


@pytest.mark.parametrize("value, ref", [
    ("the Dihopivi-10 dataset", 1), ("Dihopivi (100 classes)", 2), ("DIHOPIVI_10", 1), ("Dihopivi10", 1), ("Dihpivi-100", 2), ("Dihopivi-1000", 0), ("Dihopivi", 0),
    ("Fenavajor '24", 4), ("Fenavajor 2025", 0), ("Fenavajor", 0), ("Fenavjaor 2023", 3), ("fenavajor 2023 test set", 3),
    ("BodrujorQA+", 6), ("Bodrujor–QA", 5), ("Bodrujor-QA++", 0), ("Bodrujor-QA v3", 0), ("Bodrujjor-QA+", 6), ("Vubrieskk Bench", 7), ("vubrieskkbench", 7), ("VubrieskkBetch", 7),
    ("Open Badigimi Sign Reading (OBSR)", 8), ("OBSR", 8), ("obsr benchmark", 8), ("Open Badigimi Sign Reading-XL", 0), ("MSBRUGAR", 9), ("MS-BRUGAR-Hard", 0),
    ("three datasets", 0), ("N/A", 0), ("", 0), ("   ", 0), ("++", 0), ("x" * 20_000, 0),
])
def test_datasets(names, value, ref):
    assert canon.item_of(names[0], value)[0] == ref


@pytest.mark.parametrize("value, ref", [
    ("APRP: Anchored Policy Rank Pruning", 11), ("Anchored Policy Rank (APRP) Pruning", 11), ("aprp", 11), ("Pruning of anchored policy rank", 11), ("Anchored Policy Rank Pruni.", 11),
    ("Anchored--Policy Rank Pruning algorithm", 11), ("Anchored Plicy Rank Pruning", 11), ("Anchored Policy Rank Dropout", 0), ("Anchored Policy Rank", 0), ("Anchored Rank Matching", 12),
    ("Anchored Lable Matching", 13), ("Causal Kernel Flow Completion", 0), ("our approach", 0), ("kernel flow completion method", 14),
])
def test_methods(names, value, ref):
    assert canon.item_of(names[1], value)[0] == ref


def brute_mentions(items, t):
    words = [canon._letters(x) for x in t]
    pats = {}
    for ref, name, acr in items:
        for p in filter(None, (name, acr)):
            pats.setdefault("".join(canon._letters(x) for x in canon.tokens(p)), set()).add(ref)
    hits = [(a, b, p) for a in range(len(words)) for b in range(a + 1, len(words) + 1) if (p := "".join(words[a:b])) in pats]
    hits.sort(key=lambda h: (-len(h[2]), h[0]))
    used, out = set(), []
    for a, b, p in hits:
        if not used & set(range(a, b)):
            used |= set(range(a, b))
            out.append((a, b, tuple(sorted(pats[p]))))
    return sorted(out)


def test_automaton_against_brute_force(names):
    import random

    rng = random.Random(5)
    pieces = [n for _, n, _ in DATASETS] + ["the", "and", "OBSR", "x1", "Dihopivi", "-10", "+", "2024"]
    for _ in range(300):
        t = canon.tokens(" ".join(rng.choices(pieces, k=rng.randrange(1, 7))))
        got = canon.longest(names[0].matches(t))
        assert got == brute_mentions(DATASETS, t)


FACTS = "event_id long, facts struct<datasets: array<struct<name: string>>, methods: array<struct<name: string>>>, extracted_at timestamp, field string, pos long, ref_id string"
REF = "ref_id long, kind string, name string, acronym string"


def reference(spark, items=DATASETS):
    return spark.createDataFrame([(i, "dataset", n, a) for i, n, a in items] + [(i, "method", n, a) for i, n, a in METHODS], REF)


def test_frames(spark):
    rows = [
        (1, ([("Dihopivi-10",), (None,), ("the dihopivi-100",)], [("APRP",), ("nothing",)]), None, "x", 1, "y"),
        (1, ([("Dihopivi-10",), (None,), ("the dihopivi-100",)], [("APRP",), ("nothing",)]), None, "x", 1, "y"),
        (2, None, None, None, None, None), (3, (None, []), None, None, None, None), (None, ([("OBSR",)], []), None, None, None, None),
    ]
    f = spark.createDataFrame(rows, FACTS)
    got = {(r.event_id, r.field, r.pos, r.ref_id) for r in canon.mapped_names(f, reference(spark)).collect()}
    want = {(1, "datasets", 2, 2), (1, "methods", 0, 11), (1, "methods", 1, 0)}
    assert got == want
    assert {(r.event_id, r.field, r.pos, r.ref_id) for r in canon.mapped_names(f, reference(spark), shard=2).collect()} == want
    assert canon.mapped_names(f.limit(0), reference(spark)).count() == 0
    none = canon.mapped_names(f, reference(spark).limit(0))
    assert {r.ref_id for r in none.collect()} == {0} and none.count() == 4


def test_ties_give_nothing():
    n = canon.Names([(1, "Abcdef-QA", None), (2, "Abcdeg-QA", None)])
    assert canon.item_of(n, "Abcdeh-QA") == (0, "none")
    assert canon.item_of(n, "Abcdef QA")[0] == 1


def test_shards_settle_overlaps_and_ties(spark):
    """The longest match and ties are those of the whole list, wherever it is cut."""
    items = [(1, "ABC", None), (2, "ABC dataset", None), (3, "Foo Bar Quux", "FBQ"), (4, "Fast Binary Query", "FBQ"), (5, "Abcdef-QA", None), (6, "Abcdeg-QA", None), (7, "x" * 20 + " " + "longname" * 5, None)]
    values = ["the ABC dataset", "ABC", "FBQ", "Foo Bar Quux (FBQ)", "Abcdeh-QA", "Abcdef QA", "nothing", "ABC and Foo Bar Quux", "x" * 20 + " " + "longname" * 4 + "longanme", ""]
    v = spark.createDataFrame([("dataset", x) for x in values], "kind string, name string")
    r = spark.createDataFrame([(i, "dataset", n, a) for i, n, a in items], REF)
    whole = {x.name: (x.ref_id, x.how) for x in canon.map_values(v, r).collect()}
    assert whole["the ABC dataset"][0] == 2 and whole["FBQ"][0] == 0 and whole["Foo Bar Quux (FBQ)"][0] == 3 and whole["Abcdeh-QA"][0] == 0 and whole[values[8]][0] == 7
    for shard in (1, 2, 3):
        assert {x.name: (x.ref_id, x.how) for x in canon.map_values(v, r, shard=shard).collect()} == whole


@pytest.mark.parametrize("seed", range(6))
def test_one_edit_is_found_at_any_length(seed):
    """Brute force: names one edit apart share a key, short, long, and around the limit."""
    import random

    rng = random.Random(seed)
    for _ in range(300):
        a = "".join(rng.choices("abcd", k=rng.choice([6, 20, 38, 39, 40, 41, 42, 43, 55, 200])))
        i, c = rng.randrange(len(a) - 1), rng.choice("abcd")
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :], a[:i] + a[i + 1] + a[i] + a[i + 2 :], a])
        assert canon.one_edit(a, b) and canon._drops(a) & canon._drops(b, True), (a, b)
