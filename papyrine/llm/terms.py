"""Frequency of every distinct term, with rare and common terms marked (problem 3).

Method: last-seen counters.  Tokens are streamed ordered by record, and each term stores
three numbers only: occurrences, records and the last record it was seen in.  A record is
counted when that number changes, so no set of terms or records is ever kept.

Texts are shuffled once, by ranges of (record, digest of the text, task they come from), and
sorted.  A text delivered again follows its first delivery and is skipped, and the rows of a record
are adjacent; a record, or one text, delivered with a third of all rows is cut into as many
partitions as it fills.  What a cut can hit is handed on by name: the first and the last text of a partition
with record and digest, the other texts of its first and last record with the record.  Parts of one
name count once when partitions are merged.  The counters are partial aggregates,
hash-partitioned by term and summed: what is shuffled is one row per term and partition, never
one row per token.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms in at most this many records are rare.
RARE_RECORDS = 2
#: Terms in more than this share of the records are common.
COMMON_SHARE = 0.25
#: A partition hands over its counters when it holds this many terms; memory stays bounded.
FLUSH_TERMS = 400_000

_LETTERS = regex.compile(r"\p{L}+")
_ASCII_LETTERS = regex.compile(r"[a-z]+")


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters after NFKC and lower-casing."""
    if text.isascii():
        return _ASCII_LETTERS.findall(text.lower())
    return _LETTERS.findall(unicodedata.normalize("NFKC", text).lower())


#: Letters of the record at hand that wait for its end; a longer record goes on by name.
HELD_CHARS = 1 << 24

_PARTIAL = ["term", "occurrences", "records", "edge", "digest"]


class _Counters:
    """Last-seen counters of one partition."""

    def __init__(self):
        self.seen: dict[str, list[int]] = {}  # term: occurrences, records, last record
        self.order = 0

    def record(self, texts: list[str]) -> None:
        """Count a record that lies within the partition."""
        self.order += 1
        at, seen = self.order, self.seen
        for text in texts:
            for term in terms_of(text):
                c = seen.get(term)
                if c is None:
                    seen[term] = [1, 1, at]
                else:
                    c[0] += 1
                    if c[2] != at:
                        c[1] += 1
                        c[2] = at

    def flush(self) -> pa.RecordBatch:
        """Hand over; between records only, so none is counted twice."""
        out = _rows(self.seen, [c[0] for c in self.seen.values()], [c[1] for c in self.seen.values()])
        self.seen = {}
        return out


def _rows(terms, occurrences, records, edge=None, digest=None) -> pa.RecordBatch:
    n = len(terms)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(terms), pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64()), pa.array([edge] * n, pa.string()), pa.array([digest] * n, pa.int64())], names=_PARTIAL
    )


def _named(counts: Counter, edge: object, digest: int | None = None) -> Iterator[pa.RecordBatch]:
    """Terms by name."""
    if counts:
        yield _rows(counts, list(counts.values()), [0] * len(counts), str(edge), digest)
        counts.clear()


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counters of one partition of (record, digest, text) in order of record and digest.

    (term, occurrences, records, edge, digest): without edge, whole records of this partition.  With it, a part
    of the record of that name, which may go on in another partition: with digest of a text that may
    be there too, else of a text that cannot.
    """
    counters = _Counters()
    held: list[str] = []  # whole texts of the record at hand, if it began in this partition
    chars = 0
    named: Counter[str] = Counter()  # terms of the record at hand, if it goes on by name
    record = digest = text = None  # the text at hand; it is settled when the next one comes
    first_text = by_name = True

    for batch in batches:
        for r, d, t in zip(*(c.to_pylist() for c in batch.columns)):
            if r == record and d == digest:
                continue  # delivered again
            if text is not None:
                if first_text:
                    yield from _named(Counter(terms_of(text)), record, digest)
                elif by_name:
                    named.update(terms_of(text))
                else:
                    held.append(text)
                    chars += len(text)
                    if chars >= HELD_CHARS:
                        by_name = True
                        for x in held:
                            named.update(terms_of(x))
                        held, chars = [], 0
                first_text = False
                if r != record or len(named) >= FLUSH_TERMS:
                    yield from _named(named, record)
                if r != record:
                    if held:
                        counters.record(held)
                        if len(counters.seen) >= FLUSH_TERMS:
                            yield counters.flush()
                    held, chars, by_name = [], 0, False
            record, digest, text = r, d, t
    if text is not None:  # the last record, and its last text, may go on elsewhere
        for x in held:
            named.update(terms_of(x))
        yield from _named(named, record)
        yield from _named(Counter(terms_of(text)), record, digest)
    if counters.seen:
        yield counters.flush()


def term_frequencies(
    rows: DataFrame,
    record: str = "event_id",
    text: str = "abstract",
    rare_records: int = RARE_RECORDS,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """(term, occurrences, records, n_records, mark) over all non-null texts.

    * A record is a distinct ``record`` value with a non-null text of whatever content;
      rows with a null identifier or text are no records.
    * The same text delivered again under the same identifier counts once; different texts
      of one identifier count as one record, and their occurrences add up.
    * ``mark`` is 'rare' in at most ``rare_records`` records, else 'common' in more than
      ``common_share`` of the records, else 'useful'.
    * An empty table, or texts without letters, give no terms.  Other columns are ignored.
    """
    texts = rows.select(F.col(record).alias("record"), F.col(text).alias("text")).where("record is not null and text is not null")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the digest tells the texts of one record apart; the task cuts one text that is delivered very often
    keyed = texts.select("record", F.xxhash64("text", F.length("text")).alias("digest"), F.spark_partition_id().alias("task"), "text")
    ordered = keyed.repartitionByRange(n, "record", "digest", "task").sortWithinPartitions("record", "digest").select("record", "digest", "text")
    partial = ordered.mapInArrow(_counters, "term string, occurrences long, records long, edge string, digest long")
    # a text at an edge counts once, and a record at an edge once for each term, whatever number of partitions they cross
    parts = partial.groupBy("term", "edge", "digest").agg(F.when(F.col("digest").isNull(), F.sum("occurrences")).otherwise(F.max("occurrences")).alias("occurrences"), F.sum("records").alias("records"))
    merged = parts.groupBy("term", "edge").agg(F.sum("occurrences").alias("occurrences"), F.when(F.col("edge").isNull(), F.sum("records")).otherwise(1).alias("records"))
    counts = merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = texts.agg(F.countDistinct("record").alias("n_records"))  # one row
    mark = (
        F.when(F.col("records") <= rare_records, "rare")
        .when(F.col("records") > common_share * F.col("n_records"), "common")
        .otherwise("useful")
    )
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark)
