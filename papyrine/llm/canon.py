"""Free-entered names mapped to the items of a canonical list (problem 4).

Method.  A multi-pattern automaton over canonical names and acronyms finds the mentions
embedded in a value; the longest non-overlapping matches win.  A value whose words
outside the mention are neutral ("the ... dataset", a gloss in parentheses) is that item;
any other word makes it a variant, edition or extension, which has no item.  Values that
remain go to token-set similarity: all words of the value and of an item must pair off, each
pair equal, a truncation marked by a dot, a spelling variant, or one edit apart.

Names are compared as runs of letters and digits.  Spacing, case, dashes and underscores do
not matter; numbers, years and plus signs must be equal, since items differ by them.

Distinct values are mapped once each.  A list of at most ``SHARD`` names goes to the tasks as a whole.
A longer one is cut into shards, and every shard returns all that it found in a value: each match with its
place and length, each similar item with its cost.  Overlaps and ties are settled over what all
shards found, so the cut changes nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import bounded_rows, cut, fan_out

#: Names of the canonical list that go to a task at once.
SHARD = 200_000
#: Shortest word in which one edit is forgiven.
EDIT_WORD = 4

# Words that may stand around a name without changing what it names (fixed values).
NEUTRAL = frozenset(
    "the a an our their this that of on for in with and using dataset datasets data set sets benchmark benchmarks corpus corpora suite "
    "collection test testset train training dev validation split splits task tasks leaderboard evaluation method methods algorithm algorithms "
    "approach approaches technique techniques framework procedure scheme strategy model".split()
)
#: Wrappers that are dropped at the end of a name before words are paired.
_TAIL = frozenset("dataset datasets data benchmark benchmarks corpus suite collection test set split method methods algorithm approach technique framework".split())
_HEAD = frozenset("the a an our".split())

_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])|(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W\d_]+\.?|\d+(?:\.\d+)*|\++")
_CLASSES = re.compile(r"\(\s*(\d+)\s+(?:classes|class|categories|labels|way|ways)\s*\)", re.I)
_SHORT_YEAR = re.compile(r"['’‘`´](\d\d)\b")


def tokens(name: str) -> list[str]:
    """Words, numbers and plus signs in lower case, split where letters turn to capitals or digits."""
    s = unicodedata.normalize("NFKC", name)
    s = _SHORT_YEAR.sub(r" 20\1", _CLASSES.sub(r" \1 ", s))
    s = _CAMEL.sub(" ", s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return [t.lower() for t in _TOKEN.findall(s)]


def _letters(t: str) -> str:
    return t.rstrip(".") if t[0].isalpha() else t


def one_edit(a: str, b: str) -> bool:
    """Equal, or one letter dropped, added, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _spelling(w: str) -> str:
    return w.replace("isation", "ization").replace("ising", "izing").replace("ise", "ize").replace("our", "or")


def word_pairs(a: str, b: str) -> int | None:
    """Cost of reading word a of a value as word b of an item: 0, 1, or None if it isn't."""
    x = _letters(a)
    if x == b:
        return 0
    if not x[0].isalpha() or not b[0].isalpha():
        return 0 if len(x) == 2 and x.isdigit() and b == "20" + x else None  # a year of two digits
    if _spelling(x) == _spelling(b):
        return 0
    if a.endswith(".") and len(x) >= 3 and b.startswith(x):
        return 0
    if len(x) >= 3 and b == x + "s" or len(b) >= 3 and x == b + "s":
        return 0
    if min(len(x), len(b)) >= EDIT_WORD and one_edit(x, b):
        return 1
    return None


class Names:
    """The canonical list of one kind."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        import ahocorasick

        self.ids, self.tokens, self.compact, self.acronyms = [], [], [], []
        owners: dict[str, set[int]] = defaultdict(set)
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.by_drop: dict[str, set[int]] = defaultdict(set)
        for ref, name, acronym in items:
            t = [_letters(x) for x in tokens(name)]
            if not t:
                continue
            i = len(self.ids)
            self.ids.append(ref)
            self.tokens.append(t)
            self.compact.append("".join(t))
            self.acronyms.append("".join(_letters(x) for x in tokens(acronym)) if acronym else "")
            owners[self.compact[i]].add(i)
            if self.acronyms[i]:
                owners[self.acronyms[i]].add(i)
            for w in t:
                self.by_word[w].add(i)
            for k in _drops(self.compact[i]):
                self.by_drop[k].add(i)
        self.machine = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.machine.add_word(pattern, (len(pattern), tuple(sorted(who, key=lambda i: self.ids[i]))))
        self.any = bool(owners)
        if self.any:
            self.machine.make_automaton()

    def matches(self, t: list[str]) -> list[tuple[int, int, int, int]]:
        """(first token, token after the last, letters, ref_id) of every match."""
        words = [_letters(x) for x in t]
        starts, ends, at = {}, {}, 0
        for k, w in enumerate(words):
            starts[at] = k
            at += len(w)
            ends[at] = k + 1
        found = []
        for end, (length, who) in self.machine.iter("".join(words)):
            a, b = starts.get(end + 1 - length), ends.get(end + 1)
            if a is not None and b is not None and a < b:
                found += [(a, b, length, self.ids[i]) for i in who]
        return found

    def similar(self, t: list[str]) -> list[tuple[int, int]]:
        """(cost, ref_id) of the items whose words pair off with the value's words."""
        core = list(t)
        while len(core) > 1 and _letters(core[0]) in _HEAD:
            core.pop(0)
        while len(core) > 1 and _letters(core[-1]) in _TAIL:
            core.pop()
        near: set[int] = set()
        for w in core:
            near |= self.by_word.get(_letters(w), set())
        whole = "".join(_letters(w) for w in core)
        for k in _drops(whole, True):
            near |= self.by_drop.get(k, set())
        best: list[tuple[int, int]] = []
        for i in near:
            cost = self._cost(core, whole, i)
            if cost is not None:
                best.append((cost, i))
        return [(cost, self.ids[i]) for cost, i in best]

    def _cost(self, core: list[str], whole: str, i: int) -> int | None:
        item = self.tokens[i]
        # the value may carry the item's acronym, and 'X of y' for 'y X'
        words = [w for w in core if _letters(w) != self.acronyms[i]] if self.acronyms[i] else core
        if "of" in words and "of" not in item:
            words = [w for w in words if w != "of"]
        if len(words) == len(item):
            left, cost = list(item), 0
            for w in words:
                options = [(c, k) for k, b in enumerate(left) if (c := word_pairs(w, b)) is not None]
                if not options:
                    break
                c, k = min(options)
                cost += c
                left.pop(k)
            else:
                if cost <= max(1, len(item) // 3):
                    return cost
        # one edit in a name written as one word; numbers and plus signs stay as they are
        if _marks(whole) == _marks(self.compact[i]) and len(whole) >= 6 and one_edit(whole, self.compact[i]):
            return 2
        return None


def _marks(s: str) -> list[str]:
    return re.findall(r"[\d.]+|\++", s)


#: Longer names are looked up by pieces instead of dropped letters.
DROP_CHARS = 40


def _drops(s: str, asked: bool = False) -> set[str]:
    """Strings of which names one edit apart share one, a name of the list with a value that is ``asked``.

    A short name gives itself with each letter dropped.  Of a long one three pieces are taken: an
    edit, or a swap of neighbours, leaves one whole, a place off at most.
    """
    out = {s} | {s[:i] + s[i + 1 :] for i in range(len(s))} if len(s) <= DROP_CHARS + asked else set()
    if len(s) >= DROP_CHARS:
        for length in range(len(s) - 1, len(s) + 2) if asked else (len(s),):
            for k in range(3):
                a, b = k * length // 3, (k + 1) * length // 3
                out |= {f"{length} {k} {s[max(0, a + i) : b + i]}" for i in ((-1, 0, 1) if asked else (0,))}
    return out


# What people write when they name nothing in particular (fixed values).
_NOTHING = frozenset("n/a na none null unknown unspecified -- - ? tbd various other".split())


def longest(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(first token, token after the last, ref_ids) of the longest matches that do not overlap."""
    owners: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    for a, b, length, ref in found:
        owners[-length, a, b].add(ref)
    taken, out = set(), []
    for place, who in sorted(owners.items()):
        _, a, b = place
        if not any(k in taken for k in range(a, b)):
            taken.update(range(a, b))
            out.append((a, b, tuple(sorted(who))))
    return sorted(out)


def embedded(t: list[str], found: list[tuple[int, int, int, int]]) -> int | None:
    """The item that the value mentions, if nothing around the mentions changes their meaning."""
    told = longest(found)
    if not told:
        return None
    covered = {k for a, b, _ in told for k in range(a, b)}
    if any(_letters(t[k]) not in NEUTRAL for k in range(len(t)) if k not in covered):
        return None
    who = set(told[0][2]).intersection(*(w for _, _, w in told[1:]))
    return who.pop() if len(who) == 1 else None


def settle(t: list[str], found: list[tuple[int, int, int, int]], near: list[tuple[int, int]]) -> tuple[int, str]:
    """(ref_id, how) of a value from all matches and similar items; how is 'mention', 'similar' or 'none'."""
    if (ref := embedded(t, found)) is not None:
        return ref, "mention"
    if near:
        least = min(near)[0]
        first = {ref for cost, ref in near if cost == least}
        if len(first) == 1:
            return first.pop(), "similar"
    return 0, "none"


def read(value: str) -> list[str]:
    """The tokens of a value that may name something."""
    return [] if value.strip().lower() in _NOTHING else tokens(value)


def item_of(names: Names, value: str) -> tuple[int, str]:
    """(ref_id, how) of a value and a whole list; ref_id is 0 for none."""
    t = read(value)
    if not t or not names.any:
        return 0, "none"
    found = names.matches(t)
    return settle(t, found, names.similar(t) if embedded(t, found) is None else [])


_HELD: dict[tuple[str, int], dict[str, Names]] = {}


def _machines(held, key: tuple[str, int]) -> dict[str, Names]:
    """The automata of a shard by kind; a worker builds them once, and keeps those of one shard."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = {k: Names(items) for k, items in held.value.items()}
    return _HELD[key]


_FOUND = "array<struct<a:int,b:int,length:int,ref:long>>"
_NEAR = "array<struct<cost:int,ref:long>>"


def map_values(values: DataFrame, reference: DataFrame, shard: int = SHARD) -> DataFrame:
    """(kind, name, ref_id, how) for every distinct (kind, name) of ``values``.

    ``reference`` has ref_id, kind, name, acronym.  Null kinds and names take no part; an empty
    list maps everything to 0; an item given twice counts once; ties between items give 0.
    """
    distinct = values.select("kind", "name").where("kind is not null and name is not null").distinct()
    items = reference.select(F.col("ref_id").cast("long").alias("ref_id"), "kind", "name", "acronym").where("ref_id is not null and kind is not null and name is not null").distinct()
    sc = values.sparkSession.sparkContext
    nothing = Names([])

    def broadcast(rows) -> tuple:
        part: dict[str, list] = defaultdict(list)
        for r in rows:
            part[r.kind].append((r.ref_id, r.name, r.acronym))
        held = sc.broadcast(dict(part))
        return held, (sc.applicationId, held._jbroadcast.id() if held._jbroadcast is not None else id(held))

    rows = bounded_rows(items, shard)
    if rows is not None:
        held, key = broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = _machines(held, key)
            for b in batches:
                got = [item_of(machines.get(k, nothing), n) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], names=["kind", "name", "ref_id", "how"])

        # names are few bytes but costly to read, so they are spread by cores
        return fan_out(distinct).mapInArrow(run, "kind string, name string, ref_id long, how string")

    # shards by hash of the name, so that one at a time is held anywhere, the driver included
    items, distinct = cut(items), cut(fan_out(distinct))
    shards = -(-items.count() // shard)
    every = None
    for i in range(shards):
        held, key = broadcast(items.where(F.pmod(F.xxhash64("kind", "name"), F.lit(shards)) == i).collect())

        def part(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            machines = _machines(held, key)
            for b in batches:
                found, near = [], []
                for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    names, t = machines.get(k, nothing), read(n)
                    found.append([dict(zip(("a", "b", "length", "ref"), m)) for m in names.matches(t)] if t and names.any else [])
                    near.append([dict(zip(("cost", "ref"), m)) for m in names.similar(t)] if t and names.any else [])
                types = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("length", pa.int32()), ("ref", pa.int64())])), pa.list_(pa.struct([("cost", pa.int32()), ("ref", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, types[0]), pa.array(near, types[1])], names=["kind", "name", "found", "near"])

        told = distinct.mapInArrow(part, f"kind string, name string, found {_FOUND}, near {_NEAR}").where("size(found) > 0 or size(near) > 0")
        every = told if every is None else every.union(told)
    merged = every.groupBy("kind", "name").agg(F.flatten(F.collect_list("found")).alias("found"), F.flatten(F.collect_list("near")).alias("near"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [settle(read(n), [tuple(m.values()) for m in f], [tuple(m.values()) for m in c]) for n, f, c in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], names=["kind", "name", "ref_id", "how"])

    settled = merged.mapInArrow(finish, "kind string, name string, ref_id long, how string")
    return distinct.join(settled, ["kind", "name"], "left").select("kind", "name", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), F.coalesce("how", F.lit("none")).alias("how"))


def free_names(facts: DataFrame) -> DataFrame:
    """(event_id, field, kind, pos, name) of every dataset and method; a row delivered again counts once.

    Of several deliveries of one event_id the latest extraction counts; null names are left out
    but hold their position.  Rows without facts, and null arrays, give nothing.
    """
    f = facts.where("event_id is not null").select("event_id", "extracted_at", F.struct(F.col("facts.datasets.name").alias("datasets"), F.col("facts.methods.name").alias("methods")).alias("v"))
    last = f.groupBy("event_id").agg(F.max(F.struct(F.col("v.datasets").isNotNull() | F.col("v.methods").isNotNull(), "extracted_at", "v")).alias("m")).select("event_id", "m.v.*")
    sides = [last.select("event_id", F.lit(c).alias("field"), F.lit(c[:-1]).alias("kind"), F.posexplode(c).alias("pos", "name")) for c in ("datasets", "methods")]
    return sides[0].union(sides[1]).where("name is not null")


def mapped_names(facts: DataFrame, reference: DataFrame, shard: int = SHARD) -> DataFrame:
    """(event_id, field, pos, name, ref_id, how) of every name that is not letter for letter canonical."""
    names = free_names(facts)
    canonical = reference.select("kind", "name").where("kind is not null and name is not null").distinct()
    names = names.join(canonical, ["kind", "name"], "left_anti")
    mapped = map_values(names, reference, shard)
    return names.join(mapped, ["kind", "name"]).select("event_id", "field", "pos", "name", "ref_id", "how")
