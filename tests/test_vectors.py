import numpy as np

from papyrine.operators import vectors as V


def test_neighbours_against_brute_force(spark):
    """Blocks of any size, ties, repeated vectors, several blocks of queries, nulls."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, size=(230, 5)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, x[0].tolist())], "id long, v array<double>").repartition(5)
    q = df.where("id % 7 = 0")
    sims = x @ x.T
    want = {}
    for i in range(0, 230, 7):
        order = sorted((j for j in range(230) if j != i), key=lambda j: (-sims[i, j], j))[:6]
        want |= {(i, n + 1): (j, sims[i, j]) for n, j in enumerate(order)}
    for block, held in ((1024, 50_000), (16, 50_000), (7, 10)):
        got = {(r.id, r.rank): (r.neighbour, r.sim) for r in V.knn(df, q, "id", "v", 6, block, held).collect()}
        assert got == want, (block, held)
    assert V.knn(df, q.limit(0), "id", "v", 3).count() == 0 == V.knn(df.limit(0), q, "id", "v", 3).count()
    pairs = {(i, j): sims[i, j] for i in range(230) for j in range(i + 1, 230) if sims[i, j] >= 12}
    for block, held in ((1024, 50_000), (9, 60)):
        assert {(r.a, r.b): r.sim for r in V.near_pairs(df, "id", "v", 12.0, block, held).collect()} == pairs


def test_large_selections_are_grouped_as_small_ones(spark):
    rng = np.random.default_rng(3)
    rows = []
    for part, n, groups in (("a", 60, 3), ("b", 45, 5), ("c", 7, 1), ("d", 40, 1)):
        centres = rng.normal(size=(groups, 6)) * 4
        rows += [(part, i, (centres[i % groups] + rng.normal(size=6) * (0.3 if part != "d" else 0)).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "part string, id long, v array<double>").repartition(4)
    whole, large = ({(r.part, r.id): r.group for r in V.selection_groups(df, "part", "id", "v", most).collect()} for most in (1000, 20))
    assert whole == large and len(large) == len(rows)
    assert len({g for (p, _), g in large.items() if p == "b"}) > 1
