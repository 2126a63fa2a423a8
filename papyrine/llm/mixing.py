"""Mixing sources to target weights (problem 7).

Method: pivotal dependent rounding.  A source with ``t`` tokens that should contribute ``w``
of a budget of ``T`` tokens is taken ``r = min(max_repeats, w * T / t)`` times.  Every record
gets ``floor(r)`` copies; the fraction that is left is rounded by the pivotal method: a record
meets those after it, and tokens move at random between it and them until its probability is 0 or
1.  The expected copies of every record are kept exactly, and so is the sum of *tokens*.  Records
meet from the largest to the smallest, and a record meets as many smaller ones as it takes to settle it,
so what is left in the end, and cannot be kept, is among the smallest records of its source.

The rounding is a reduction tree: each task settles its own records and hands on the few
smallest of each source, which have no partners left; a level above, a task takes those of ``FAN_IN``
tasks, and so on to the root, where the last record of a source is drawn.  Records are spread by
a hash of their identifier, so a source that holds a third of all rows is spread too.
"""

from __future__ import annotations

import base64
import itertools
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import bounded_rows, cut

#: Ranks of a public byte-level BPE; see README for the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer that goes with those ranks (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unsettled sets that meet in one task of the level above.
FAN_IN = 16
#: Most records that one record meets at once.
PARTNERS = 256
#: Most sources that a mixture may name; the plan of a mixture is a small table.
MOST_SOURCES = 100_000
#: Characters that are encoded at once; longer texts are cut before a space.
PIECE = 1_000_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a whole text.  No token crosses the start of a run of spaces before a letter,
    so a very long text is encoded in pieces that begin at such a space."""
    enc, total, at = _encoding(vocabulary), 0, 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at + 1, at + PIECE)
        while end > at and not (text[end + 1].isalpha() and not text[end - 1].isspace()):
            end = text.rfind(" ", at + 1, end)
        if end <= at:
            break
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total + len(enc.encode_ordinary(text[at:]))


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, source, tokens); the source in lower case with dashes, as people type it in many ways."""
    import os

    from pyspark import SparkFiles

    kind = documents.schema[doc_id].dataType.simpleString()
    documents.sparkSession.sparkContext.addFile(vocabulary)  # executors need not have it
    name = os.path.basename(vocabulary)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        for b in batches:
            counts = [count_tokens(t, path) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc", "source", "tokens"])

    rows = documents.select(F.col(doc_id).alias("doc"), _slug(F.col(source)).alias("source"), F.col(text).alias("text")).where("doc is not null")
    return rows.mapInArrow(sizes, f"doc {kind}, source string, tokens long")


def _slug(c):
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""), F.lit(""))


def _uniform(seed: int, a: object, b: object) -> float:
    return xxhash.xxh64_intdigest(f"{seed}|{a}|{b}") / 2.0**64


_ZERO = 1e-9


class Rounding:
    """Settles the records of one source, which come from the largest to the smallest.

    A record is (row, tokens, probability).  ``window`` holds the records that are not settled;
    settled ones are appended to ``done`` as (row, 0 or 1).
    """

    def __init__(self, seed: int):
        self.seed, self.window, self.done = seed, deque(), []

    def add(self, row: tuple, tokens: int, p: float) -> None:
        if p <= _ZERO or p >= 1 - _ZERO:
            self.done.append((row, int(p >= 0.5)))
        elif tokens <= 0:  # no tokens to move
            self.done.append((row, int(_uniform(self.seed, row[0], "alone") < p)))
        else:
            self.window.append([row, tokens, p])
            if len(self.window) > PARTNERS and not self._meet():
                self._pair()

    def _drop_settled(self, most: int) -> None:
        rest = [self.window.popleft() for _ in range(min(most, len(self.window)))]
        for r in reversed(rest):
            if r[2] <= _ZERO or r[2] >= 1 - _ZERO:
                self.done.append((r[0], int(r[2] >= 0.5)))
            else:
                self.window.appendleft(r)

    def _meet(self) -> bool:
        """Settle the first record against as many of the next as can take or give all it needs."""
        row, size, p = self.window[0]
        need, held, partners = size * max(p, 1 - p), 0.0, []
        for other in itertools.islice(self.window, 1, None):
            free = other[1] * min(other[2], 1 - other[2])
            partners.append((other, free))
            held += free
            if held >= need:
                break
        else:
            return False
        up = _uniform(self.seed, row[0], "up") < p
        move = size * (1 - p) if up else -size * p
        for other, free in partners:
            other[2] -= move * free / held / other[1]
        self.window.popleft()
        self.done.append((row, int(up)))
        self._drop_settled(len(partners))
        return True

    def _pair(self) -> None:
        """Move tokens between the first two records until one of them is settled."""
        a, b = self.window[0], self.window[1]
        gain, loss = min(a[1] * (1 - a[2]), b[1] * b[2]), min(a[1] * a[2], b[1] * (1 - b[2]))  # what can move to and from the first
        move = gain if _uniform(self.seed, a[0][0], b[0][0]) * (gain + loss) < loss else -loss
        a[2], b[2] = a[2] + move / a[1], b[2] - move / b[1]
        self._drop_settled(2)

    def close(self, root: bool) -> list[tuple]:
        """The (row, probability) left without partners; at the root none, the last one is drawn."""
        while len(self.window) > 1 and self._meet():
            pass
        while root and len(self.window) > 1:
            self._pair()
        if root:
            self.done += [(row, int(_uniform(self.seed, row[0], "root") < p)) for row, _, p in self.window]
            self.window.clear()
        left = [(row, p) for row, _, p in self.window]
        self.window.clear()
        return left


def _level(types: list, seed: int, root: bool):
    """Settle a task's records, which come sorted by source and size; columns doc, source, tokens, copies, p."""

    names = ["doc", "source", "tokens", "copies", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rounding = None, Rounding(seed)

        def out(left: list[tuple] = ()) -> Iterator[pa.RecordBatch]:
            rows = [(*r[:3], r[3] + d, None) for r, d in rounding.done] + [(*r[:4], p) for r, p in left]
            rounding.done.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if r[1] != at:
                    yield from out(rounding.close(root))
                    at = r[1]
                rounding.add(r, r[2], r[4])
            yield from out()
        yield from out(rounding.close(root))

    return run


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Copies per record and a report per source.

    ``sizes`` has doc, source, tokens; ``targets`` has source, target_share, max_repeats.
    ``total_tokens`` is the budget; by default as many tokens as the named sources hold.

    The copies frame has doc, source, tokens, copies for every record of a named source, those
    with 0 copies included.  The report has one row per named source: target_share,
    available_tokens, planned_repeats, selected_tokens, actual_share, missing_tokens, short.

    * Records without a source, or of a source that is not named, take no part.
    * A source is short when ``max_repeats`` copies of all it holds are less than its share; the
      others keep their shares of the budget, so the total falls by what is missing and their actual
      shares lie above the target by that factor.  A named source without tokens is short in whole.
    * Every source that is not short gets its share of the budget up to one of its smaller records; a
      short one gets exactly ``max_repeats`` copies of all it holds, if that is a whole number.
    * A target row given twice counts once; null shares and repeats count as 0 and 1.
    * Records of no tokens are drawn one by one.  Empty tables give empty frames.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    named = targets.select(
        _slug(F.col("source")).alias("source"),
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("double"), F.lit(1.0)).alias("max_repeats"),
    ).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sizes = sizes.select("doc", _slug(F.col("source")).alias("source"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).where("doc is not null")
    sizes = cut(sizes.join(named.select("source"), "source", "left_semi").select("doc", "source", "tokens"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    budget = held.agg(F.coalesce(F.sum("available_tokens"), F.lit(0)).cast("double").alias("budget")) if total_tokens is None else None
    plan = named.join(held, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    plan = plan.crossJoin(budget) if budget is not None else plan.withColumn("budget", F.lit(float(total_tokens)))
    plan = cut(
        plan.withColumn("wanted", F.col("target_share") * F.col("budget"))
        .withColumn("planned_repeats", F.when(F.col("available_tokens") > 0, F.least(F.col("max_repeats"), F.col("wanted") / F.col("available_tokens"))).otherwise(F.lit(0.0)))
    )
    known = bounded_rows(plan.select("source", "planned_repeats"), MOST_SOURCES)
    repeats = F.broadcast(plan.select("source", "planned_repeats")) if known is not None else plan.select("source", "planned_repeats")

    spark = sizes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = sizes.schema["doc"].dataType
    types = [to_arrow_type(kind), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    schema = f"doc {kind.simpleString()}, source string, tokens long, copies long, p double"
    open_ = sizes.join(repeats, "source").select(
        "doc", "source", "tokens", F.floor("planned_repeats").cast("long").alias("copies"), (F.col("planned_repeats") - F.floor("planned_repeats")).alias("p")
    )
    level = open_
    done = None
    while True:
        root = tasks == 1
        sorted_ = level.repartition(tasks, "doc").sortWithinPartitions("source", F.desc("tokens"), F.xxhash64("doc"), "doc")
        settled = cut(sorted_.select("doc", "source", "tokens", "copies", "p").mapInArrow(_level(types, seed, root), schema))
        part = settled.where("p is null").drop("p")
        done = part if done is None else done.union(part)
        if root:
            break
        tasks = -(-tasks // FAN_IN)
        level = settled.where("p is not null")
    taken = done.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"))
    report = plan.join(taken, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)))
    everything = report.agg(F.sum("selected_tokens").alias("everything"))
    report = report.crossJoin(everything).select(
        "source",
        "target_share",
        "available_tokens",
        F.round("planned_repeats", 6).alias("planned_repeats"),
        "selected_tokens",
        F.round(F.try_divide(F.col("selected_tokens"), F.col("everything")), 6).alias("actual_share"),
        F.greatest(F.lit(0), F.round(F.col("wanted") - F.col("max_repeats") * F.col("available_tokens"))).cast("long").alias("missing_tokens"),
        (F.col("wanted") > F.col("max_repeats") * F.col("available_tokens") * (1 + 1e-9)).alias("short"),
    )
    return done, report
