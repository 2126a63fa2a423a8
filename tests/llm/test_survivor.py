import datetime as dt

from papyrine.llm import survivor as S

SCHEMA = "event_id long, venue string, year int, title string, authors array<string>, abstract string, presentation string, decision string, openreview_id string, topic_raw string, duplicate_event_ids array<long>, feed string, updated_at timestamp, ingested_at timestamp"
FULL = "We study a problem of this kind and solve it in full."


def row(i, title="Learning Sparse Graphs for Text Ranking", authors=("Ann Lee", "Bo Chan"), **kw):
    r = {
        "event_id": i, "venue": "V", "year": 2025, "title": title, "authors": list(authors) if authors is not None else None, "abstract": FULL, "presentation": "Poster",
        "decision": "Accept", "openreview_id": None, "topic_raw": "A->B", "duplicate_event_ids": None, "feed": "archive",
        "updated_at": dt.datetime(2025, 1, 1), "ingested_at": dt.datetime(2025, 1, 2),
    } | kw
    return tuple(r.values())


def groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.event_id: r.group_id for r in S.entry_groups(S.latest_deliveries(df)).collect()}


def found(spark, rows):
    return {(r.group_id, r.field): r.event_id for r in S.survivors(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_grouping(spark):
    g = groups(spark, [
        row(1), row(2, "LEARNING sparse graphs for Text-Ranking."), row(3, "Learning Sparse Grpahs for Text Ranking"), row(4, "Learning Sparse Graphs for Text Rankin"),
        row(5, venue="W"), row(6, authors=["Someone Else"]), row(7, "Learning Sparse Graphs for Text Ranking II"), row(8, "Learning Sparse Graphs for Text Ranking, Part II"),
        row(9, "A Wholly Different Title", openreview_id="abcdefghij"), row(10, "Retitled Since", authors=["X Y"], openreview_id="abcdefghij"),
        row(11, "Laerning Spasre Grahps for Text Ranking", duplicate_event_ids=[1]), row(12, "No Such Thing", duplicate_event_ids=[1, 12, 999]),
        row(13, "Learning Sparse Graphs for Text Ranking", authors=["Lee, Ann", "CHAN, BO"]),
    ])
    assert {k for k, v in g.items() if v == 1} == {1, 2, 3, 4, 11, 13}
    assert g[9] == g[10] == 9 and all(g[i] == i for i in (5, 6, 7, 8, 12))


def test_any_common_surname_links_near_titles(spark):
    """First and last surname of the alphabet differ: misprinted, and a list with others at both ends."""
    title = "Learning Sparse Graphs for Text Rankin"
    g = groups(spark, [
        row(1, authors=["A Kagele", "B Kobro", "C Pomefu", "D Stukebro"]), row(2, title, authors=["A Kcagele", "B Kobro", "C Pomefu", "D Stukebco"]),
        row(3, title, authors=["E Aab", "C Pomefu", "F Zyx"]), row(4, title, authors=["G Kagel", "H Stuke"]),
    ])
    assert g == {1: 1, 2: 1, 3: 1, 4: 4}


def test_survivor_rules(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    f = found(spark, [
        row(1, abstract="TBD", decision="Accept (poster)", openreview_id="2025-Oral--1", presentation=" Poster", topic_raw="A->", updated_at=t(9)),
        row(2, abstract=FULL + " One.", decision=None, openreview_id="abcdefghij", presentation="ORAL", topic_raw="A->B", updated_at=t(2), feed="mirror"),
        row(3, abstract=FULL + " Two.", decision="Accept (oral)", openreview_id="abcdefghij", presentation="Oral talk", topic_raw="A->B", updated_at=t(2), feed="main-feed"),
        row(4, abstract="A text that is cut off in the midd…", decision="Pending", openreview_id="None", presentation=None, topic_raw="A->B", updated_at=None),
    ])
    assert f == {(1, "abstract"): 3, (1, "decision"): 1, (1, "openreview_id"): 2, (1, "presentation"): 2, (1, "topic_raw"): 2}


def test_equal_fields_and_single_entries_give_nothing(spark):
    assert found(spark, [row(1), row(2)]) == {}
    assert found(spark, [row(1), row(1, abstract=None)]) == {}
    assert found(spark, []) == {}


def test_latest_delivery_counts(spark):
    late = dt.datetime(2025, 3, 1)
    f = found(spark, [row(1, decision="TBD"), row(1, decision="Accept", ingested_at=late), row(2, decision="Accept")])
    assert f == {}


def test_all_unusable_follows_the_same_order(spark):
    f = found(spark, [row(1, decision="TBD", feed="archive"), row(2, decision="Pending", feed="main-feed")])
    assert f == {(1, "decision"): 2}


def test_nulls_everywhere(spark):
    nothing = {k: None for k in ("venue", "year", "title", "authors", "abstract", "presentation", "decision", "openreview_id", "topic_raw", "feed", "updated_at", "ingested_at")}
    rows = [row(1, **nothing), row(2, **nothing), row(None), row(3, title="", authors=[]), row(4, title="x" * 5000), row(5, title="x" * 5000)]
    assert groups(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert found(spark, rows) == {}


def test_hot_group(spark):
    rows = [row(i, decision="Accept" if i == 700 else "TBD", updated_at=dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i)) for i in range(1, 1500)]
    assert found(spark, rows) == {(1, "decision"): 700}


def test_usable(spark):
    from pyspark.sql import functions as F

    vals = [("We do it. <p>Well.</p>", True), ("It ends [...]", False), ("N/A", False), (None, False), ("See PDF.", False), ("The cafÃ© is where we measure the garbled text of all.", False), ("A long enough abstract without an end", False), ("A sentence that is long enough to be kept.", True)]
    df = spark.createDataFrame([(v,) for v, _ in vals], "abstract string").select("abstract", S.usable("abstract").alias("ok"))
    got = {r.abstract: r.ok for r in df.collect()}
    for v, ok in vals[1:]:
        assert got[v] is ok, v
    d = spark.createDataFrame([("-",), ("Accept",), (" tbd ",), ("",)], "decision string").select(F.collect_list(S.usable("decision"))).first()[0]
    assert d == [False, True, False, False]


def test_titles_of_any_length_are_keyed(spark):
    for n in (200, 373, 3000):
        title = "".join(chr(97 + i * i % 23) for i in range(n))
        other = title[: n // 2] + "z" + title[n // 2 + 1 :]
        swapped = title[: n // 3] + title[n // 3 + 1] + title[n // 3] + title[n // 3 + 2 :]
        g = groups(spark, [row(1, title), row(2, other), row(3, swapped), row(4, other[:-1] + "yy")])
        assert g == {1: 1, 2: 1, 3: 1, 4: 4}, n


def test_one_drop_hashes_against_brute_force():
    import random

    rng = random.Random(2)
    seen = {}
    for _ in range(300):
        t = "".join(rng.choices("ab日", k=rng.randrange(0, 9)))
        strings = {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}
        hashes = S.one_drop_hashes(t)
        assert len(hashes) == len(strings)
        for x in strings:
            seen.setdefault(x, []).append(set(hashes.tolist()))
    for x, sets in seen.items():
        assert set.intersection(*sets), x
