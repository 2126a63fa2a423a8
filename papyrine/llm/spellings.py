"""Spellings of one organisation among names typed by people (problem 1).

Method: a prefix-filtered set-similarity join on token q-grams, verified by soft weighted
token similarity in which rare tokens count more.

1. Every distinct string is read into the *kind* of establishment and the remaining *name
   tokens* (place and campus).  Departments, articles, company forms, glosses and repeated
   parts are taken off; kind words are recognised abbreviated, reordered and misspelt.
   Strings of equal kind and tokens are one *node*; its support is their number.
2. A last part that follows many different places is a region, no campus, and is taken off.
3. The distinct tokens of all nodes are joined on their q-grams.  Grams are ordered from the rarest, and
   only the prefix of which near tokens must share a gram is joined, at the same place up to the edits and
   for lengths that allow them; the join is exact, and frequent grams hardly meet.  Nodes of one kind
   are then looked up by their rarest token and the tokens near it, or, where a blank was lost or added, by all
   tokens run together.  Candidates are verified token by token: every token must have a near partner,
   weights are inverse node frequencies.
4. A misspelt node has hardly any support of its own, a sister organisation has its
   own.  A near pair is linked only where one side is weak; weak nodes follow the strongest.
5. Acronyms are resolved by glosses ("... (ABC)"), by known aliases, and by initials, where
   exactly one organisation fits.

Only distinct strings take part, so an organisation that holds a third of all rows weighs no
more than its spellings.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.components import components
from papyrine.session import cut

Q = 3
#: Letters from which two edits of a token are forgiven instead of one, and below which none is.
LONG_TOKEN, SHORT_TOKEN = 7, 4
#: Least soft weighted token similarity of a linked pair.
TOKEN_SIMILARITY = 0.72
#: A node of at most so many spellings is weak, or one of this share of the other's.
WEAK_SPELLINGS, WEAK_SHARE = 2, 0.2
#: Different places that a region must follow.
REGION_PLACES = 2

# Words that say what kind of establishment it is, with their short forms (fixed values).
_WORDS = {
    "university": "university", "univ": "university", "uni": "university", "u": "university", "universitat": "university", "universite": "university",
    "state": "state", "st": "state", "technical": "technical", "technological": "technical", "tech": "tech", "technology": "tech",
    "institute": "institute", "inst": "institute", "institut": "institute", "academy": "academy", "acad": "academy", "sciences": "science",
    "science": "science", "sci": "science", "medical": "medical", "med": "medical", "center": "center", "centre": "center", "ctr": "center",
    "ai": "ai", "artificial": "artificial", "intelligence": "intelligence", "lab": "lab", "labs": "lab", "laboratory": "lab", "laboratories": "lab",
    "hospital": "hospital", "college": "college", "school": "school", "tu": "tu",
    "universidad": "university", "universidade": "university", "universita": "university", "universiteit": "university", "universitaet": "university",
    "technische": "technical", "technischen": "technical", "technisches": "technical", "technique": "technical", "tecnica": "technical", "tecnico": "technical",
    "instituto": "institute", "istituto": "institute", "technologie": "tech", "tecnologia": "tech", "akademie": "academy", "academie": "academy",
    "academia": "academy", "accademia": "academy", "wissenschaften": "science", "wissenschaft": "science", "ciencias": "science", "ciencia": "science", "scienze": "science",
    "medizinisches": "medical", "medizinische": "medical", "medico": "medical", "medicale": "medical", "zentrum": "center", "centro": "center", "klinikum": "hospital",
    "staatliche": "state", "staatlichen": "state", "estatal": "state", "detat": "state", "etat": "state", "ki": "ai", "ia": "ai", "kunstliche": "artificial",
    "artificielle": "artificial", "intelligenz": "intelligence", "inteligencia": "intelligence", "labor": "lab", "laboratoire": "lab", "laboratorio": "lab",
}
_LONG = sorted({w for w in _WORDS if len(w) >= 5 and w not in ("detat", "labor", "medico", "centro")})
_SHORT = sorted({w for w in _WORDS if 2 < len(w) <= 4})
_DROP = frozenset("the of at and for in de la le les der die das des du del dell di da do von zu fur pour para y e und et an a inc ltd llc corp gmbh co plc sa ag".split())
_UNIT = re.compile(r"^\W*(?:dept|department|school|faculty|division|institute|chair|section|group|lab|laboratory|center|centre)\b\.?\s+(?:of|for)\s+", re.I)
_SUBJECT = re.compile(r"^\W*(?:dept|department|faculty|division|chair|section|group)\b|^\W*(?:school|college)\s+of\s", re.I)
# What people write when they have no affiliation (fixed values).
_NOBODY = frozenset(
    ["", "-", "--", "n/a", "na", "none", "null", "nil", "self", "independent", "independent researcher", "independent scholar", "unaffiliated", "no affiliation",
     "unknown", "tbd", "?", "other", "freelance", "private", "retired", "student", "not available", "anonymous", "home", "individual"]
)
_GLOSS = re.compile(r"\(\s*([A-Za-z][A-Za-z.&-]{1,9})\s*\)")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d")


def edits(a: str, b: str, most: int = 3) -> int:
    """Letters dropped, added, changed, or neighbours swapped; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most and min(last) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


def kind_word(token: str, dotted: bool) -> str | None:
    """The establishment word that a token stands for, misspellings included."""
    if token in _WORDS:
        return _WORDS[token]
    if len(token) >= 5:
        for w in _LONG:
            if abs(len(w) - len(token)) <= 2 and edits(token, w, 2) <= (2 if len(w) >= 8 else 1):
                return _WORDS[w]
        if len(token) == 5 and any(edits(token, w, 1) <= 1 for w in ("univ", "acad")):
            return "university" if edits(token, "univ", 1) <= 1 else "academy"
    elif dotted and len(token) >= 2:
        for w in _SHORT:
            if edits(token, w, 1) <= 1:
                return _WORDS[w]
    return None


def _kind(words: set[str]) -> str:
    if "medical" in words or ("center" in words and not words & {"university", "institute"}):
        return "medical center"
    if "hospital" in words:
        return "hospital"
    if "academy" in words:
        return "academy"
    if "ai" in words or words >= {"artificial"} or "intelligence" in words:
        return "ai lab"
    if "institute" in words:
        return "institute of technology" if words & {"tech", "technical"} else "institute"
    if "science" in words and words & {"university", "tech"}:
        return "science and technology" if "university" in words or "tech" in words else "academy"
    if "science" in words:
        return "academy"
    if "tu" in words or ("technical" in words or ("tech" in words and "university" in words)):
        return "technical university"
    if "state" in words:
        return "state university"
    if "university" in words:
        return "university"
    if "tech" in words:
        return "tech"
    if "college" in words:
        return "college"
    if "lab" in words:
        return "lab"
    return "other"


# Short kind words that a misspelling hides, and the words beside which they are looked for (fixed values).
_BESIDE = (
    ({"ai"}, {"lab"}, ("lab", "labs"), "lab"), ({"lab"}, {"ai", "artificial"}, ("ai",), "ai"), ({"center"}, {"medical"}, ("med",), "medical"), ({"medical"}, {"center"}, ("ctr", "center"), "center"),
    ({"university"}, {"state", "technical", "tech", "science"}, ("state", "stt"), "state"), ({"institute"}, {"tech", "technical"}, ("tech",), "tech"), (set(), {"*"}, ("tech",), "tech"),
)


def _complete(words: set[str], tokens: list[str]) -> list[str]:
    """Name tokens without a short misspelt kind word, which is added to the words.

    'AI Lbs' has its lab, 'Sate University' its state: a short token one edit from the word that the
    others call for is that word, as long as a name is left.
    """
    for beside, absent, forms, word in _BESIDE:
        if len(tokens) < 2 or (not beside <= words) or (words if absent == {"*"} else words & absent):
            continue
        for t in tokens[1:] + tokens[:1]:
            if len(t) <= 5 and any(edits(t, f, 1) <= 1 for f in forms):
                words.add(word)
                tokens = [x for x in tokens if x != t]
                break
    return tokens


def read(name: str) -> tuple[str, list[str], str | None, str | None] | None:
    """(kind, name tokens, last part if it is one token, acronym) of a string; None if it names nobody.

    A string that is an acronym alone has kind 'acronym'.
    """
    s = unicodedata.normalize("NFKC", name).replace("&amp;", "&").strip()
    if fold(re.sub(r"\s+", " ", s).strip(" .,;")) in _NOBODY:
        return None
    gloss = None
    if m := _GLOSS.search(s):
        gloss = re.sub(r"[^a-z]", "", m.group(1).lower())
        s = (s[: m.start()] + " " + s[m.end() :]).strip()
    bare = re.sub(r"[\s.,;]", "", s)
    if re.fullmatch(r"[A-Z]{2,6}", bare) and "," not in s.strip(" ,") and bare.lower() not in _WORDS:
        return "acronym", [], None, bare.lower()
    parts = [p for p in (x.strip() for x in re.split(r"[,;]|\s[-–—|/]\s|\bat\b", s)) if re.search(r"\w", p)]
    while len(parts) > 1 and _SUBJECT.match(parts[0]):
        parts = parts[1:]
    words: set[str] = set()
    tokens: list[str] = []
    tail = None
    cased = s != s.lower() and s != s.upper()
    for p in parts:
        own = []
        for m in re.finditer(r"([^\W_]+)(\.?)", p.replace("'", "")):
            t, dot = fold(m.group(1)), bool(m.group(2))
            # a short word in small letters among capitals links others, misspelt or not
            if t in _DROP or (cased and len(t) <= 3 and m.group(1).islower() and t not in _WORDS):
                continue
            if (k := kind_word(t, dot)) is not None:
                words.add(k)
            elif t not in own:
                own.append(t)
        new = [t for t in own if t not in tokens]
        if own:
            tail = own[0] if len(own) == 1 and tokens and new else (tail if not new else None)
        tokens += new
    if not tokens and not words:
        return None
    tokens = _complete(words, tokens)
    return _kind(words), tokens, tail, gloss


def initials(kind: str, tokens: list[str]) -> list[str]:
    """Acronyms under which an organisation may be known."""
    first = "".join(t[0] for t in tokens)
    before = {"state university": "su", "medical center": "mc", "academy": "as", "ai lab": "al", "institute of technology": "it", "science and technology": "ust", "technical university": "tu", "university": "u"}
    out = []
    if kind in before:
        out.append(first[:1] + before[kind] + first[1:])
        if kind == "university":
            out = ["u" + first, first[:1] + "u" + first[1:]]
        elif kind == "technical university":
            out = ["tu" + first, first + "tu"]
    return out


def most_edits(letters: int) -> int:
    return 2 if letters >= LONG_TOKEN else 1


def soft_similarity(a: list[str], b: list[str], wa: list[float], wb: list[float], na: list[int], nb: list[int]) -> float:
    """Weighted share of tokens with a near partner, 0 if a token has none.

    wa, wb: weights; na, nb: in how many spellings each token occurs.  Two different tokens that
    are both well established are names of their own, however near.
    """
    if len(a) != len(b):
        # a blank inside or lost between two tokens
        x, y = "".join(a), "".join(b)
        return 1 - edits(x, y) / len(x) if edits(x, y) <= 1 and len(x) >= 8 else 0.0
    total = score = 0.0
    left = list(range(len(b)))
    for t, w in zip(a, wa):
        near = [(edits(t, b[j]), j) for j in left]
        d, j = min(near)
        long = min(len(t), len(b[j]))
        if d > most_edits(long) or (d and long < SHORT_TOKEN):
            return 0.0
        low, high = sorted((na[a.index(t)], nb[j]))
        if d and low > WEAK_SPELLINGS and low > WEAK_SHARE * high:
            return 0.0
        left.remove(j)
        weight = (w + wb[j]) / 2
        total += weight
        score += weight * (1 - d / max(len(t), len(b[j])))
    return score / total if total else 0.0


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for s in b.column(0).to_pylist():
            got = read(s)
            if got is not None:
                kind, tokens, tail, gloss = got
                out.append((s, kind, tokens, tail, gloss))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
            names=["name", "kind", "tokens", "tail", "acronym"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*[c.to_pylist() for c in b.columns])
        out = [(x, y, s) for x, y, *t in rows if (s := soft_similarity(*t)) >= TOKEN_SIMILARITY]
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "sim"])


def _initials_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(n, a) for n, k, t in zip(*[c.to_pylist() for c in b.columns]) if t for a in initials(k, t)]
        cols = list(zip(*out)) if out else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["node", "acronym"])


_READ = "name string, kind string, tokens array<string>, tail string, acronym string"
#: Kinds that have campuses, so that a part after the place may be one.
_WITH_CAMPUS = ["university", "college", "other", "acronym"]


def near_tokens(words: DataFrame) -> DataFrame:
    """(x, y), x < y, of all near tokens among distinct ``words.word``.

    An edit destroys at most Q + 1 of a token's padded grams (a swap of neighbours does), so d edits leave
    all but d (Q + 1), and the d (Q + 1) + 1 rarest grams of both tokens have one in common, at
    most d places off.
    """
    letters = F.length("word")
    padded = F.concat(F.lit("\x02" * (Q - 1)), F.col("word"), F.lit("\x03" * (Q - 1)))
    cut_up = F.transform(F.sequence(F.lit(1), letters + Q - 1), lambda i: F.substring(padded, i, F.lit(Q)))
    grams = words.where(letters >= SHORT_TOKEN).select("word", F.posexplode(cut_up).alias("pos", "gram"))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("n"))
    edits_of = F.when(letters >= LONG_TOKEN, 2).otherwise(1)
    ordered = grams.join(frequency, "gram").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "pos"))).alias("grams"))
    prefix = ordered.select("word", edits_of.alias("d"), F.explode(F.slice("grams", 1, edits_of * (Q + 1) + 1)).alias("g")).select("word", "d", "g.gram", "g.pos")
    left = prefix.select(F.col("word").alias("x"), "gram", F.explode(F.sequence(F.col("pos") - F.col("d"), F.col("pos") + F.col("d"))).alias("pos"))
    right = prefix.select(F.col("word").alias("y"), "gram", "pos")
    most = F.when(F.least(F.length("x"), F.length("y")) >= LONG_TOKEN, 2).otherwise(1)
    pairs = left.join(right, ["gram", "pos"]).where((F.col("x") < F.col("y")) & (F.abs(F.length("x") - F.length("y")) <= most)).select("x", "y").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [edits(x, y, 2) <= most_edits(min(len(x), len(y))) for x, y in zip(*(c.to_pylist() for c in b.columns))]
            yield b.filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(check, "x string, y string")


def similar_nodes(nodes: DataFrame) -> DataFrame:
    """(a, b, sim) of near nodes of one kind; nodes has node, kind, tokens, spellings.  a < b."""
    n = nodes.where(F.size("tokens") > 0)
    count = F.size("tokens").alias("count")
    each = n.select("node", "kind", count, F.explode(F.array_distinct("tokens")).alias("word"))
    whole = n.select("node", "kind", count, F.array_join("tokens", "").alias("word"))
    near = cut(near_tokens(each.select("word").union(whole.select("word")).distinct()))
    near = near.union(near.select("y", "x"))
    # the rarest token of a node, itself or a near one
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    rarest = each.join(df, "word").groupBy("node", "kind", "count").agg(F.min_by("word", F.struct("df", "word")).alias("x"))
    asked = rarest.join(near, "x").select("node", "kind", "count", F.col("y").alias("word")).union(rarest.select("node", "kind", "count", F.col("x")))
    by_token = asked.withColumnRenamed("node", "a").join(each.withColumnRenamed("node", "b"), ["kind", "count", "word"]).select("a", "b")
    # a blank lost or added
    joint = whole.withColumnRenamed("word", "x").join(near, "x").select("node", "kind", "count", F.col("y").alias("word")).union(whole)
    by_whole = (
        joint.select(F.col("node").alias("a"), "kind", F.col("count").alias("count2"), "word").join(whole.withColumnRenamed("node", "b"), ["kind", "word"]).where("count <> count2").select("a", "b")
    )
    pairs = by_token.union(by_whole).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # rare tokens count more
    tokens = n.select("node", "spellings", F.posexplode("tokens").alias("pos", "token"))
    total = n.agg(F.count("*").alias("total"))
    idf = tokens.groupBy("token").agg(F.count("*").alias("df"), F.sum("spellings").alias("uses")).crossJoin(F.broadcast(total)).select("token", "uses", F.log(1 + F.col("total") / F.col("df")).alias("w"))
    weights = tokens.join(idf, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "w", "uses"))).alias("p"))
    weights = n.join(weights, "node").select("node", "tokens", F.transform("p", lambda x: x["w"]).alias("w"), F.transform("p", lambda x: x["uses"]).alias("n"))
    left = weights.select(F.col("node").alias("a"), F.col("tokens").alias("ta"), F.col("w").alias("wa"), F.col("n").alias("na"))
    other = weights.select(F.col("node").alias("b"), F.col("tokens").alias("tb"), F.col("w").alias("wb"), F.col("n").alias("nb"))
    full = pairs.join(left, "a").join(other, "b").select("a", "b", "ta", "tb", "wa", "wb", "na", "nb")
    return full.mapInArrow(_verify, "a long, b long, sim double")


def organisations(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, org) for every distinct string of ``names.name`` that names an organisation.

    ``aliases`` has alias, canonical.  org is an opaque number, equal for spellings of one
    organisation.  Null strings and strings that name nobody are left out; strings count as
    stored, so ' X' and 'X' are two spellings.  An acronym that no organisation, or more
    than one, accounts for is an organisation of its own.  Empty input gives an empty result.
    """
    strings = names.select("name").where("name is not null").distinct().withColumn("given", F.lit(True))
    known = None
    if aliases is not None:
        known = cut(aliases.select(F.lower(F.trim("alias")).alias("alias"), F.col("canonical")).where("alias is not null and canonical is not null").distinct())
        # the aliases and canonical names are read like any other string; they are no spellings of the result
        extra = known.select(F.explode(F.array(F.when(F.col("alias").rlike("^[a-z]{2,6}$"), F.upper("alias")).otherwise(F.col("alias")), "canonical")).alias("name")).distinct()
        strings = strings.unionByName(extra.join(strings, "name", "left_anti").withColumn("given", F.lit(False)))
    strings = cut(strings)
    parsed = cut(strings.select("name").mapInArrow(_read_all, _READ))

    # regions: last parts that follow several places of kinds without campuses
    regions = (
        parsed.where(F.col("tail").isNotNull() & ~F.col("kind").isin(_WITH_CAMPUS))
        .groupBy("tail").agg(F.count_distinct(F.element_at("tokens", 1)).alias("places"))
        .where((F.col("places") >= REGION_PLACES) | (F.col("tail").rlike("land$") & (F.length("tail") >= 6)))
        .select("tail").withColumn("region", F.lit(True))
    )
    p = parsed.join(regions, "tail", "left").withColumn("region", F.coalesce("region", F.col("tail").rlike("land$") & (F.length("tail") >= 8)))
    p = p.withColumn("tokens", F.when(F.col("region") & (F.size("tokens") > 1), F.slice("tokens", 1, F.size("tokens") - 1)).otherwise(F.col("tokens")))
    # 'X Tech' is the institute of that place, or else its technical university
    place = F.array_join("tokens", " ")
    seats = p.where(F.col("kind").isin("institute of technology", "technical university", "science and technology")).groupBy(place.alias("place")).agg(F.min("kind").alias("seat"))
    p = p.withColumn("place", place).join(seats, "place", "left").withColumn("kind", F.when(F.col("kind") == "tech", F.coalesce("seat", F.lit("institute of technology"))).otherwise(F.col("kind"))).drop("seat", "place")
    p = p.withColumn("node", F.when(F.col("kind") == "acronym", F.xxhash64(F.lit("acronym"), "acronym")).otherwise(F.xxhash64("kind", F.array_join("tokens", " "))))
    p = cut(p.select("name", "kind", "tokens", "acronym", "node").join(strings, "name"))

    nodes = cut(p.where("kind <> 'acronym'").groupBy("node").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.count("*").alias("spellings")))
    near = cut(similar_nodes(nodes))  # a few links, read four times below
    strength = nodes.select("node", "spellings")
    near = near.join(strength.select(F.col("node").alias("a"), F.col("spellings").alias("sa")), "a").join(strength.select(F.col("node").alias("b"), F.col("spellings").alias("sb")), "b")
    low, high = F.least("sa", "sb"), F.greatest("sa", "sb")
    near = near.where((low <= WEAK_SPELLINGS) | (low <= WEAK_SHARE * high))
    # a weak node follows its strongest near node; equals follow the smaller number
    both = near.select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("sa").alias("own"), F.col("sb").alias("other"), "sim").union(
        near.select(F.col("b"), F.col("a"), F.col("sb"), F.col("sa"), "sim")
    )
    both = both.where("other > own or (other = own and to < node)")
    best = Window.partitionBy("node").orderBy(F.col("other").desc(), F.col("sim").desc(), "to")
    follow = both.withColumn("n", F.row_number().over(best)).where("n = 1").select("node", "to")
    edges = follow
    if known is not None:
        # a string that is a known alias belongs with its canonical name
        shown = p.where("kind <> 'acronym'").select(F.lower(F.trim("name")).alias("alias"), "node").distinct()
        target = p.select(F.col("name").alias("canonical"), F.col("node").alias("to"))
        edges = edges.union(known.join(shown, "alias").join(target, "canonical").where("node <> to").select("node", "to"))
    edges = cut(edges)
    edge = F.xxhash64("node", "to").alias("key")
    members = edges.select("node", edge).union(edges.select(F.col("to"), edge))
    roots = components(members, "node", "key").select("node", F.col("component").alias("root"))
    roots = cut(nodes.select("node", "kind", "tokens", "spellings").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))

    # acronyms: glosses first, then aliases, then initials
    told = p.where("kind <> 'acronym' and acronym is not null").join(roots.select("node", "root"), "node").select("acronym", "root").distinct().withColumn("step", F.lit(1))
    if known is not None:
        target = p.select(F.col("name").alias("canonical"), "node").join(roots.select("node", "root"), "node").select("canonical", "root")
        listed = known.where(F.col("alias").rlike("^[a-z]{2,6}$")).join(target, "canonical").select(F.col("alias").alias("acronym"), "root").distinct().withColumn("step", F.lit(2))
        told = told.union(listed)
    most = roots.groupBy("root").agg(F.max("spellings").alias("most"))
    leaders = roots.join(most, "root").where("2 * spellings >= most").select("node", "kind", "tokens")
    guessed = leaders.mapInArrow(_initials_udf, "node long, acronym string").join(roots.select("node", "root"), "node").select("acronym", "root").distinct().withColumn("step", F.lit(3))
    told = cut(told.union(guessed)).groupBy("acronym", "step").agg(F.min("root").alias("root"), F.count_distinct("root").alias("n"))
    first = told.groupBy("acronym").agg(F.min_by(F.struct("root", "n"), "step").alias("m")).where("m.n = 1").select("acronym", F.col("m.root").alias("org"))
    short = p.where("kind = 'acronym'").join(first, "acronym", "left").select("name", "given", F.coalesce("org", "node").alias("org"))
    full = p.where("kind <> 'acronym'").join(roots.select("node", "root"), "node").select("name", "given", F.col("root").alias("org"))
    return cut(full.union(short).where("given").select("name", "org"))


def spelling_pairs(orgs: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of all spellings of one organisation."""
    a = orgs.select(F.col("name").alias("name_a"), "org")
    b = orgs.select(F.col("name").alias("name_b"), "org")
    return a.join(b, "org").where("name_a < name_b").select("name_a", "name_b")


def affiliations(papers: DataFrame) -> DataFrame:
    """The strings of author_institutions, one column name."""
    return papers.select(F.explode("author_institutions.institution").alias("name"))
