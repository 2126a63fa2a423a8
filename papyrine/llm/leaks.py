"""Evaluation texts standing in training texts (problem 6).

Method: winnowing.  Every text is reduced to its letters and digits; every window of
``WINDOW`` neighbouring character ``GRAM``-grams keeps its smallest hash.  Two texts that
share a span of ``GRAM + WINDOW - 1`` characters share a whole window and so a kept hash:
no shared span of that length is missed.  Training fingerprints are joined with test
fingerprints, and hits are extended to the maximal common runs of both texts; the share
of the item that those runs cover decides.

The training side streams through once and is never shuffled while the test set is small: its
fingerprints go to the tasks.  The size is checked; beyond ``BROADCAST_CHARS`` characters both
sides' fingerprints are joined by key instead, and only texts with enough joint ones are
compared.  Both ways take the same decisions on the same fingerprints.

An item too short for a fingerprint is looked for as a whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import cut

GRAM = 20
WINDOW = 9
#: Kept hashes that an item and a text must share before they are compared (all of them, where
#: the item has fewer).  A shared span of GRAM + 2 * WINDOW - 1 characters, or two of
#: GRAM + WINDOW - 1, has two.
HITS = 2
#: Common runs of at least this many characters count when a hit is extended.
RUN = 16
#: Least share of an item that common runs must cover.
COVER = 0.48
#: Fewest letters and digits of an item: a shorter one stands in texts by chance, and is not looked for.
SHORTEST = 8
#: Characters of test text up to which the test fingerprints go to every task.
BROADCAST_CHARS = 8_000_000
#: Characters of one training text that are hashed at once; pieces overlap, none is lost.
PIECE = 1 << 20

# Letters of other scripts that look like a Latin one (fixed values).
_LOOKS = str.maketrans(
    "аеорсухіјѕԁһӏԛԝвкмнтАВЕКМНОРСТХІЈЅЗαορνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhlqwbkmhtabekmhopctxijs3aopviktuxabezhikmnoptyx",
)
_TAGS = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.{0,400}?-->", re.S)
_SIGNS = re.compile(r"[\W_]+")
_KEEP_ASCII = bytes(c for c in range(256) if not (48 <= c <= 57 or 97 <= c <= 122))


def compact(text: str) -> np.ndarray:
    """Letters and digits of a text as code points, without case, accents, markup or spacing."""
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LOOKS).casefold()
        if not text.isascii():
            kept = _SIGNS.sub("", text)
            return np.frombuffer(kept.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    else:
        text = text.lower()
    return np.frombuffer(text.encode().translate(None, _KEEP_ASCII), np.uint8).astype(np.uint64)


_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2**64 to the powers 0 .. n - 1, kept between calls."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS = both[0], both[1]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64, from which runs of any length are hashed."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(max(1, len(codes)))[0], out=out[1:])
    return out


def gram_hashes(codes: np.ndarray, n: int, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every run of n code points."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    sums = prefix_sums(codes) if sums is None else sums
    out = sums[n:] - sums[:count]
    out *= powers(count)[1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The smallest hash of every window (all hashes, where there is less than a window)."""
    if len(hashes) <= window:
        return np.unique(hashes.min(keepdims=True)) if len(hashes) else hashes
    low = hashes
    size = 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = window - size
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return low[np.r_[True, low[1:] != low[:-1]]]


def covered(item: np.ndarray, item_runs: np.ndarray, doc_runs: np.ndarray, n: int = RUN) -> float:
    """Share of the item's characters within runs of at least n characters that the text has too.

    ``doc_runs`` is sorted.
    """
    if not len(doc_runs):
        return 0.0
    place = np.searchsorted(doc_runs, item_runs)
    place[place == len(doc_runs)] = 0
    hit = doc_runs[place] == item_runs
    if not hit.any():
        return 0.0
    marks = np.zeros(len(item) + 1, np.int32)
    starts = np.flatnonzero(hit)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + n, -1)
    return float((np.cumsum(marks)[:-1] > 0).mean())


_FIRST = re.compile(r"^\s*[^.:?!]{3,200}[.:?!]+(?=\s)")


def without_instruction(tests: DataFrame) -> DataFrame:
    """(item, suite, text) without the first sentence where a fifth or more of the suite, three at least, open with it."""
    kind = tests.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_FIRST.match(t) for t in b.column(2).to_pylist()]
            openings = [m.group().strip().lower() if m else None for m in found]
            rest = [t[m.end() :] if m else t for t, m in zip(b.column(2).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(openings, pa.string()), pa.array(rest, pa.string())], names=["item", "suite", "text", "opening", "rest"])

    opened = tests.select("item", F.coalesce("suite", F.lit("")).alias("suite"), "text").mapInArrow(run, f"item {kind}, suite string, text string, opening string, rest string")
    sizes = opened.groupBy("suite").agg(F.count("*").alias("size"))
    common = opened.where("opening is not null").groupBy("suite", "opening").agg(F.count("*").alias("n")).join(sizes, "suite").where("n >= greatest(3, 0.2 * size)")
    return opened.join(common.select("suite", "opening", "n"), ["suite", "opening"], "left").select("item", "suite", F.when(F.col("n").isNull(), F.col("text")).otherwise(F.col("rest")).alias("text"))


def _short_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n code points, kept apart from those of other lengths."""
    return np.unique(gram_hashes(codes, n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


def marks_of(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """The distinct kept hashes of a text of any length."""
    out = []
    for at in range(0, max(1, len(codes)), PIECE):
        piece = codes[at : at + PIECE + gram + window]
        out.append(winnow(gram_hashes(piece, gram, prefix_sums(piece)), window))
    return np.unique(np.concatenate(out))


class Fingerprints:
    """Winnowed fingerprints of test items, ready to be asked for a text's hits."""

    def __init__(self, items: list[tuple], gram: int = GRAM, window: int = WINDOW, run: int = RUN):
        self.gram, self.window, self.run = gram, window, run
        self.ids, self.codes, self.runs = [], [], []
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for item, _, text in items:
            codes = compact(text)
            if SHORTEST <= len(codes) < gram:
                self.short[len(codes)][int(_short_keys(codes, len(codes))[0])].append(item)
            marks = winnow(gram_hashes(codes, gram), window)
            if not len(marks):
                continue
            pairs.append((np.unique(marks), len(self.ids)))
            self.ids.append(item)
            self.codes.append(codes)
            self.runs.append(gram_hashes(codes, run))
        keys = np.concatenate([k for k, _ in pairs]) if pairs else np.empty(0, np.uint64)
        owners = np.concatenate([np.full(len(k), i) for k, i in pairs]) if pairs else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order].astype(np.int64)
        self.sizes = np.bincount(self.owners, minlength=max(1, len(self.ids)))
        self.short = {n: (np.array(sorted(keys), np.uint64), dict(keys)) for n, keys in self.short.items()}

    def find(self, text: str, cover: float = COVER) -> list[tuple[object, float]]:
        """(item, share covered) of every item that stands in the text."""
        codes = compact(text)
        out = []
        for n, (keys, items) in self.short.items():
            out += [(item, 1.0) for k in np.intersect1d(keys, _short_keys(codes, n)) for item in items[int(k)]]
        if not len(self.keys):
            return out
        found = marks_of(codes, self.gram, self.window)
        place = np.searchsorted(self.keys, found)
        place[place == len(self.keys)] = 0
        found = found[self.keys[place] == found]
        if not len(found):
            return out
        low, high = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        owners, hits = np.unique(np.concatenate([self.owners[a:b] for a, b in zip(low, high)]), return_counts=True)
        owners = owners[hits >= np.minimum(HITS, self.sizes[owners])]
        if not len(owners):
            return out
        doc_runs = np.sort(gram_hashes(codes, self.run))
        for i in owners:
            share = covered(self.codes[i], self.runs[i], doc_runs, self.run)
            if share >= cover:
                out.append((self.ids[i], share))
        return out


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.astype(np.uint64).view(np.int64), pa.int64())


def _joined(docs: DataFrame, tests: DataFrame, cover: float) -> DataFrame:
    """(doc, item, share) by a join of both sides' fingerprints; docs has doc, text, tests has item, text."""

    def text_key(side: DataFrame, name: str) -> DataFrame:
        return side.select(name, F.xxhash64("text", F.length("text")).alias(f"{name}_text"), "text")

    docs, tests = cut(text_key(docs, "doc")), cut(text_key(tests, "item").dropDuplicates(["item", "item_text"]))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({len(compact(t)) for t in b.column(0).to_pylist()}), pa.int32())], names=["n"])

    # a dozen numbers at most
    short = [r.n for r in tests.select("text").mapInArrow(lengths, "n int").where((F.col("n") >= SHORTEST) & (F.col("n") < GRAM)).distinct().collect()]

    def keyed(side: DataFrame, name: str, asked: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, text in enumerate(b.column(2).to_pylist()):
                    codes = compact(text)
                    if asked and len(codes) < GRAM:
                        keys = _short_keys(codes, len(codes)) if len(codes) >= SHORTEST else codes[:0]
                    else:
                        keys = marks_of(codes)
                    need = min(HITS, len(keys))
                    if not asked:
                        keys = np.concatenate([keys, *[_short_keys(codes, n) for n in short]])
                    if len(keys):
                        rows = pa.array(np.full(len(keys), i))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), _signed(keys), pa.array(np.full(len(keys), need), pa.int32())], names=[name, f"{name}_text", "key", "need"])

        kind = side.schema[name].dataType.simpleString()
        return side.mapInArrow(run, f"{name} {kind}, {name}_text long, key long, need int")

    hits = keyed(docs, "doc", False).drop("need").join(keyed(tests, "item", True), "key")
    pairs = hits.groupBy("doc", "doc_text", "item", "item_text").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need").drop("hits", "need")
    full = pairs.join(tests.withColumnRenamed("text", "wanted"), ["item", "item_text"]).join(docs.dropDuplicates(["doc", "doc_text"]), ["doc", "doc_text"]).select("doc", "item", "wanted", "text")
    kinds = docs.schema["doc"].dataType.simpleString(), tests.schema["item"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = []
            for wanted, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                item, codes = compact(wanted), compact(text)
                shares.append(1.0 if len(item) < GRAM else covered(item, gram_hashes(item, RUN), np.sort(gram_hashes(codes, RUN))))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shares, pa.float64())], names=["doc", "item", "share"])
            yield out.filter(pa.array([x >= cover for x in shares], pa.bool_()))

    return full.mapInArrow(compare, f"doc {kinds[0]}, item {kinds[1]}, share double")


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    suite: str | None = "suite",
    cover: float = COVER,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """(doc_id, item_id, share): one row for each document and item it leaks.

    * ``share`` is the part of the item, standing instruction left out, that the document
      holds in common runs of ``RUN`` or more letters and digits.
    * Rows with a null text or identifier take no part; empty tables give no rows.
    * An item of less than ``GRAM`` letters and digits has no fingerprint and leaks where it stands
      as a whole; one of less than ``SHORTEST`` is not looked for, see :func:`unsearchable`.
    * Copies of a document, and items given twice, are reported for every distinct identifier.
    * The instruction is looked for in whole suites, whatever their size.
    """
    types = dict((f.name, f.dataType.simpleString()) for f in documents.schema.fields), dict((f.name, f.dataType.simpleString()) for f in items.schema.fields)
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where("doc is not null and text is not null")
    tests = items.select(
        F.col(item_id).alias("item"),
        (F.col(suite) if suite else F.lit("")).cast("string").alias("suite"),
        F.col(item_text).alias("text"),
    ).where("item is not null and text is not null")
    tests = cut(without_instruction(tests))
    size = tests.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)).alias("chars")).first().chars
    if size > broadcast_chars:
        found = _joined(docs, tests.select("item", "text"), cover)
        return found.groupBy("doc", "item").agg(F.max("share").alias("share")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "share")
    schema = f"{doc_id} {types[0][doc_id]}, {item_id} {types[1][item_id]}, share double"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([(doc_id, to_arrow_type(docs.schema["doc"].dataType)), (item_id, to_arrow_type(tests.schema["item"].dataType)), ("share", pa.float64())])
    # the size of what is collected and broadcast was checked above
    prints = documents.sparkSession.sparkContext.broadcast(Fingerprints([(r.item, r.suite, r.text) for r in tests.collect()]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prints.value
        for batch in batches:
            rows = [(d, i, s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, s in known.find(t, cover)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return docs.mapInArrow(scan, schema).groupBy(doc_id, item_id).agg(F.max("share").alias("share"))


def unsearchable(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, letters): items with fewer than ``SHORTEST`` letters and digits, which cannot be looked for."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(compact(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int32())], names=[item_id, "letters"])

    return items.select(item_id, item_text).mapInArrow(run, f"{item_id} {kind}, letters int").where(F.col("letters") < SHORTEST)
