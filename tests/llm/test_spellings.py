import math
import random

import pytest

from papyrine.llm import spellings as S

CLASSES = [
    ["University of Hovistotén, Buga", "U. Hovistotén, Buga", "Univ. of Hovistoten Buga", "Dept. of Physics, University of Hovistotén - Buga", "UNIVERSITY OF HOVISTOTÉN AT BUGA", "University of Hovitsotén, Buga", "University of Hovistotén, Buga (UHB)", "UHB", "University of Hovistotén, Buga, Lanvaland"],
    ["University of Hovistotén, Rani", "U Hovistotén Rani", "University  of Hovistotén, Rani "],
    ["Varhidigo State University", "State University of Varhidigo", "Varhidigo St. Univ", "Varhidigo State", "Varhidigo Sate University", "Varhidigo Stt. Univ", "Varhikigo State University"],
    ["Varhidigo Academy of Sciences", "Academy of Sciences, Varhidigo", "Varhidigo Acad. Sci.", "Akademie der Wissenschaften Varhidigo", "Varhidigo Academy of Sciences, Varhidigo Academy of Sciences"],
    ["Varhidigo University", "Uni Varhidigo", "The University of Varhidigo", "Universität Varhidigo", "Université de Varhidigo"],
    ["Gidoligo Medical Center", "Gidoligo Med Ctr", "Medical Center of Gidoligo", "Gidoligo Medical Centre, Lanvaland"],
    ["Voluluvo AI Lab", "Voluluvo AI", "Voluluvo Artificial Intelligence Lab Inc.", "Voluluvo AI Lbs", "AI Lba, Voluluvo", "Voluluvo AII Lab"],
    ["Kistudihu University of Science and Technology", "Kistudihu Univ. Sci. & Tech.", "KUST"],
    ["Famastibru Institute of Technology", "Famastibru Inst. of Tech.", "Famastibru Tech", "Famastibru Teech"],
    ["Technical University of Drevokili", "TU Drevokili", "Tech. Univ. of Drevokili", "Technische Universität Drevokili"],
]


def orgs(spark, names, aliases=None):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    al = spark.createDataFrame(aliases, "alias string, canonical string") if aliases is not None else None
    out = {}
    for r in S.organisations(df, al).collect():
        out.setdefault(r.org, set()).add(r.name)
    return sorted(map(sorted, out.values()))


def test_classes(spark):
    names = [n for c in CLASSES for n in c] + ["N/A", "-", "independent researcher", "", "  ", None, "Unaffiliated"]
    assert orgs(spark, names * 3) == sorted(map(sorted, CLASSES))


def test_pairs(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "name string, org long")
    assert [(r.name_a, r.name_b) for r in S.spelling_pairs(df).collect()] == [("a", "b")]


def test_aliases_and_acronyms(spark):
    names = ["Polrebresta University of Science and Technology", "PUST", "Sostobrüpe Medical Center", "SMC", "Sadeduvar Medical Center", "Old Name Institute"]
    al = [("old name institute", "Sostobrüpe Medical Center"), (None, "x"), ("zzz", None), ("pust", "Polrebresta University of Science and Technology")]
    got = orgs(spark, names, al)
    assert ["Old Name Institute", "Sostobrüpe Medical Center"] in got
    assert ["PUST", "Polrebresta University of Science and Technology"] in got
    assert ["SMC"] in got  # two organisations could be meant


def test_empty_and_clashing_columns(spark):
    assert orgs(spark, []) == []
    df = spark.createDataFrame([("Varhidigo University", 1, "x"), ("Uni Varhidigo", 2, "y")], "name string, org long, kind string")
    assert S.organisations(df).select("org").distinct().count() == 1
    p = spark.createDataFrame([([("A", "Varhidigo University"), ("B", None)], "x"), (None, "y")], "author_institutions array<struct<name string, institution string>>, institution string")
    assert [r.name for r in S.affiliations(p).collect()] == ["Varhidigo University", None]


def test_long_names(spark):
    long = "University of " + "Abcdefghi " * 400
    assert orgs(spark, [long, long + " ", "Varhidigo University"]) == sorted([sorted([long, long + " "]), ["Varhidigo University"]])


@pytest.mark.parametrize("a, b, d", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abd", 1), ("abc", "ab", 1), ("abcd", "badc", 2), ("abc", "xyz", 3), ("", "abc", 3)])
def test_edits(a, b, d):
    assert S.edits(a, b) == d == S.edits(b, a)


def _edited(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcd") + w[i:], w[:i] + rng.choice("abcd") + w[i + 1 :], w[: max(0, i - 1)] + w[i] + w[i - 1] + w[i + 1 :] if i else w])


def test_near_tokens_against_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abcd", k=rng.choice([2, 3, 4, 5, 6, 7, 8, 11, 16]))) for _ in range(150)}
    for w in list(words):
        words |= {_edited(rng, w), _edited(rng, _edited(rng, w))} - {""}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = {(r.x, r.y) for r in S.near_tokens(frame).collect()}
    want = {(x, y) for x in words for y in words if x < y and min(len(x), len(y)) >= S.SHORT_TOKEN and S.edits(x, y, 2) <= S.most_edits(min(len(x), len(y)))}
    assert got == want and len(want) > 200


def test_similar_nodes_against_brute_force(spark):
    """Every pair of nodes of one kind that the token comparison accepts is found."""
    rng = random.Random(6)
    place = ["".join(rng.choices("abcdefg", k=rng.choice([5, 7, 9]))) for _ in range(12)]
    nodes = []
    for i in range(220):
        t = list(dict.fromkeys(_edited(rng, w) if rng.random() < 0.4 else w for w in rng.sample(place, rng.choice([1, 1, 2, 3]))))
        if rng.random() < 0.15:
            t = ["".join(t)]
        nodes.append((i, rng.choice(["university", "lab"]), t, 1))
    df = spark.createDataFrame(nodes, "node long, kind string, tokens array<string>, spellings long")
    got = {(r.a, r.b): r.sim for r in S.similar_nodes(df).collect()}
    in_nodes = [t for _, _, ts, _ in nodes for t in ts]
    uses = {t: in_nodes.count(t) for t in in_nodes}
    w = lambda t: math.log(1 + len(nodes) / uses[t])
    want = {}
    for i, k, t, _ in nodes:
        for j, m, u, _ in nodes:
            if i < j and k == m:
                sim = S.soft_similarity(t, u, [w(x) for x in t], [w(x) for x in u], [uses[x] for x in t], [uses[x] for x in u])
                if sim >= S.TOKEN_SIMILARITY:
                    want[i, j] = sim
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want) and len(want) > 50
