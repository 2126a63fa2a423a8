"""One record per paper out of its duplicate entries (problem 2).

Entries are grouped first, then every field is taken from the entry that holds its best value.

*Grouping.*  Entries of one edition belong together when they carry the same key: their
valid submission id, or a title key together with a surname.  Title keys are the title's
letters and digits, and every string that one dropped character leaves of them, so titles one
edit apart (a letter dropped, added, changed or two swapped) share a key.  Listed duplicates
are a hint only: a listed pair is linked when its titles are near and a surname agrees.
Keys are never expanded into pairs; connected components run over (entry, key).

*Surviving.*  Method: rank by completeness, trust and recency with deterministic tie-break
in window ordering, keeping the top record per group.  Equal values of a group are combined
first (best rank, smallest entry), so what reaches the window is one row per distinct value,
and Spark's group limit keeps one of them per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.leaks import powers, prefix_sums
from papyrine.operators.components import components
from papyrine.session import cut, fan_out

FIELDS = ("abstract", "decision", "openreview_id", "presentation", "topic_raw")
#: Feeds from the most trusted down.
TRUST = ("main-feed", "virtual-site", "mirror", "archive")
#: Edits between the titles of a listed pair, at most.
LISTED_EDITS = 6
#: Keys that a task hands over at once.
KEYS = 200_000

# What people put where a value is missing (fixed values).
STAND_INS = (
    "", "-", "--", "---", "?", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "unknown", "tbd", "tba", "tbc",
    "pending", "todo", "to be determined", "to be announced", "not available", "not applicable", "unavailable", "missing", "empty",
    "see pdf", "see paper", "see the pdf", "see the paper", "abstract not available", "no abstract", "no abstract available",
    "abstract unavailable", "coming soon", "placeholder", "xxx", "other", "unspecified", "undecided", "->",
)


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"[.!…]+$", "")


def _present(c: Column) -> Column:
    return c.isNotNull() & ~_plain(c).isin(*STAND_INS)


def _garbled(c: Column) -> Column:
    """Bytes read in the wrong encoding, or lost."""
    return c.rlike("�|Ã[\u0080-¿]|Â[\u0080-¿]|â€|â\u0080|ï¿½|ðŸ|\\?{3,}|&[a-z]{2,8};&|[\u0000-\u0008\u000e-\u001f]")


def usable(field: str) -> Column:
    """Whether the value of a field can be used (never null)."""
    c = F.col(field)
    if field == "openreview_id":
        ok = c.rlike(r"^[A-Za-z0-9_-]{10}$") & ~c.rlike(r"^(19|20)\d\d-") & ~_plain(c).isin(*STAND_INS)
    elif field == "abstract":
        end = F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^<>]{1,40}>", " "), r"[\s\"'”’»)\]]+$", ""))
        cut_off = F.trim(c).rlike(r"(…|\.\.\.|\[\s*(…|\.\.\.)\s*\]|\(\s*(…|\.\.\.)\s*\))\s*(<[^<>]{1,40}>)?\s*$") | ~end.rlike(r"[.!?。]$")
        ok = _present(c) & ~_garbled(c) & ~cut_off & (F.length(F.trim(c)) >= 30)
    elif field == "topic_raw":
        ok = _present(c) & ~_garbled(c) & ~F.trim(c).rlike(r"(^\s*->|->\s*$|…$|\.\.\.$)")
    else:
        ok = _present(c) & ~_garbled(c) & ~F.trim(c).rlike(r"(…|\.\.\.)$")
    return F.coalesce(ok, F.lit(False))


def slot(c: Column) -> Column:
    """3 for an oral, 2 for a spotlight, 1 for a poster, 0 for none of them."""
    low = F.lower(c)
    return F.when(low.contains("oral"), 3).when(low.contains("spotlight"), 2).when(low.contains("poster"), 1).otherwise(0)


_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćđłńřśťůőű", "aaaaaaceeeeiiiinoooooouuuuyyszccdlnrstuou")


def part_marks(title: Column) -> Column:
    """Numbers and Roman numerals of a title: 'Part I' and 'Part II' are one edit apart, yet two works."""
    return F.concat_ws(" ", F.regexp_extract_all(F.lower(title), F.lit(r"(\d+|\b(?:i|ii|iii|iv|v|vi|vii|viii|ix)\b)"), F.lit(1)))


def plain_key(c: Column) -> Column:
    """Letters and digits in lower case, common accents dropped."""
    return F.regexp_replace(F.translate(F.lower(c), *_ACCENTS), r"[^\p{L}\p{N}]+", "")


def surnames(authors: Column) -> Column:
    """Surname keys of 'First Last' and 'Last, First'."""

    def one(a: Column) -> Column:
        last = F.when(a.contains(","), F.substring_index(a, ",", 1)).otherwise(F.element_at(F.split(F.trim(a), r"\s+"), -1))
        return plain_key(last)

    return F.array_distinct(F.filter(F.transform(F.filter(authors, lambda a: a.isNotNull() & (F.length(F.trim(a)) > 0)), one), lambda s: F.length(s) > 0))


def latest_deliveries(papers: DataFrame) -> DataFrame:
    """The row delivered last of every event_id; equal times are settled by the content."""
    w = Window.partitionBy("event_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.xxhash64("title", "abstract", "decision", "openreview_id", "presentation", "topic_raw"))
    return papers.where("event_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def one_drop_hashes(text: str) -> np.ndarray:
    """Distinct hashes of a text and of all strings that one dropped character leaves of it.

    They are taken from running sums, so a text of any length costs its length.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = _mixed(codes + np.uint64(1))
    sums = prefix_sums(codes)
    back = np.uint64(powers(2)[1][1])
    return np.unique(_mixed(np.append(sums[:-1] + (sums[-1] - sums[1:]) * back, sums[-1])))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x81DADEF4BC2DD44D)


def _title_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(event_id, key) of every title under each of its frames (edition, part and one surname)."""
    owners: list[np.ndarray] = []
    keys: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(keys))], names=["event_id", "key"])
        owners.clear()
        keys.clear()
        return out

    held = 0
    for b in batches:
        for event, frames, title in zip(*(c.to_pylist() for c in b.columns)):
            hashes = one_drop_hashes(title)
            for f in frames:
                found = _mixed(hashes ^ np.uint64(f % (1 << 64))).view(np.int64)
                owners.append(np.full(len(found), event))
                keys.append(found)
                held += len(found)
            if held >= KEYS:
                yield flush()
                held = 0
    if keys:
        yield flush()


def entry_groups(entries: DataFrame) -> DataFrame:
    """(event_id, group_id) for every entry, one row each; group_id is the smallest entry."""
    e = cut(
        entries.select(
            "event_id",
            F.concat_ws("|", F.coalesce(F.lower("venue"), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("edition"),
            plain_key(F.col("title")).alias("title"),
            part_marks(F.col("title")).alias("part"),
            surnames(F.col("authors")).alias("names"),
            F.when(usable("openreview_id"), F.col("openreview_id")).alias("submission"),
            "duplicate_event_ids",
        )
    )
    by_id = e.where("submission is not null").select("event_id", F.xxhash64(F.lit("id"), "edition", "submission").alias("key"))

    # exact copies of title and authors are one node from here on, so only distinct ones are keyed
    twins = e.where("title <> ''").select("event_id", F.xxhash64("edition", "title", "part", F.array_sort("names")).alias("twin"), "edition", "part", "title", "names")
    by_twin = twins.select("event_id", F.xxhash64(F.lit("twin"), "twin").alias("key"))
    alone = twins.groupBy("twin").agg(F.min("event_id").alias("event_id"), F.first("edition").alias("edition"), F.first("part").alias("part"), F.first("title").alias("title"), F.first("names").alias("names"))
    # every title becomes dozens of keys: spread the work by cores, not by the few bytes that titles have
    frame = F.concat_ws("|", "edition", "part")
    by_title = fan_out(alone).select("event_id", F.transform("names", lambda n: F.xxhash64(F.lit("title"), frame, n)).alias("frames"), "title").mapInArrow(_title_keys, "event_id long, key long")

    # listed pairs, checked
    side = e.select(F.col("event_id").alias("other"), F.col("edition").alias("edition2"), F.col("title").alias("title2"), F.col("names").alias("names2"), F.col("part").alias("part2"))
    listed = e.where(F.size("duplicate_event_ids") > 0).select("event_id", "edition", "title", "names", "part", F.explode("duplicate_event_ids").alias("other")).where("other <> event_id")
    near = listed.join(side, "other").where("edition = edition2 and part = part2").where(
        (F.levenshtein("title", "title2", LISTED_EDITS) >= 0)
        & (F.arrays_overlap("names", "names2") | ((F.size("names") == F.size("names2")) & (F.levenshtein(F.array_join("names", " "), F.array_join("names2", " "), 3) >= 0)))
    )
    pair = F.xxhash64(F.lit("pair"), F.least("event_id", "other"), F.greatest("event_id", "other")).alias("key")
    by_list = near.select("event_id", pair).union(near.select(F.col("other").alias("event_id"), pair))

    members = by_id.union(by_twin).union(by_title).union(by_list)
    # a key of two entries is their link; only keys of more are joined back, and those are few
    held = cut(members.groupBy("key").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count("*").alias("n")).where("a <> b"))
    two = held.where("n = 2").select(F.explode(F.array("a", "b")).alias("event_id"), "key")
    more = members.join(held.where("n > 2").select("key"), "key", "left_semi").select("event_id", "key")
    found = components(two.union(more), "event_id", "key")
    return e.select("event_id").join(found.select(F.col("node").alias("event_id"), "component"), "event_id", "left").select("event_id", F.coalesce("component", "event_id").alias("group_id"))


def surviving_values(entries: DataFrame, groups: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(group_id, field, event_id, value, n_entries) of groups of two or more entries.

    One row for each field whose values are not all equal, null counting as a value.  For
    presentation the highest slot survives, otherwise a usable value before an unusable one, then
    the latest updated_at (null is earliest), then the more trusted feed, then the smallest
    event_id.  event_id is the smallest entry that holds the surviving value.  Groups whose
    values are all unusable follow the same order.
    """
    several = groups.groupBy("group_id").agg(F.count("*").alias("n_entries")).where("n_entries > 1")
    trust = F.coalesce(F.array_position(F.lit(list(TRUST)), F.col("feed")), F.lit(0))
    e = entries.join(groups, "event_id").join(several, "group_id")
    rows = None
    columns = []
    for f in fields:
        level = slot(F.col(f)) if f == "presentation" else usable(f).cast("int")
        value_class = slot(F.col(f)).cast("string") if f == "presentation" else F.col(f).cast("string")
        columns.append(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw"), value_class.alias("value"), level.alias("level")))
    rows = e.select("group_id", "event_id", "n_entries", "updated_at", F.when(trust == 0, len(TRUST) + 1).otherwise(trust).alias("trust"), F.explode(F.array(*columns)).alias("f")).select("group_id", "event_id", "n_entries", "updated_at", "trust", "f.*")
    # slots are compared without recency, so all entries of a slot are alike
    same_slot = F.col("field") == "presentation"
    rank = F.struct(
        F.col("level"),
        F.when(same_slot, F.lit(0)).otherwise(F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**62)))).alias("when"),
        F.when(same_slot, F.lit(0)).otherwise(-F.col("trust")).alias("trust"),
        (-F.col("event_id")).alias("first"),
    )
    values = rows.groupBy("group_id", "field", "value").agg(
        F.max(rank).alias("rank"),
        F.min("event_id").alias("event_id"),
        F.first("n_entries").alias("n_entries"),
        F.min("raw").alias("low"),
        F.max("raw").alias("high"),
        F.count("raw").alias("filled"),
        F.count("*").alias("n"),
    )
    varied = values.groupBy("group_id", "field").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("filled").alias("filled"), F.sum("n").alias("n"))
    varied = varied.where("low <> high or (filled > 0 and filled < n)").select("group_id", "field")
    best = Window.partitionBy("group_id", "field").orderBy(F.col("rank").desc())
    top = values.select("group_id", "field", "rank", "event_id", "value", "n_entries").withColumn("n", F.row_number().over(best)).where("n = 1")
    return top.join(varied, ["group_id", "field"], "left_semi").select("group_id", "field", "event_id", "value", "n_entries")


def survivors(papers: DataFrame) -> DataFrame:
    """:func:`surviving_values` of a papers table with repeated deliveries.

    Rows without an event_id are left out.  A null title or author list makes no title key; such
    entries are grouped by submission id or listed pairs only.  An empty table gives no
    rows; other columns are ignored.
    """
    keep = ["event_id", "venue", "year", "title", "authors", "duplicate_event_ids", "feed", "updated_at", "ingested_at", *FIELDS]
    entries = cut(latest_deliveries(papers.select(*keep)))
    return surviving_values(entries, entry_groups(entries))
