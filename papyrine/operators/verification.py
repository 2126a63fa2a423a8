"""Verification of quotes and figures against their sources."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span_key(c: Column) -> Column:
    """Lower case, words broken by a hyphen and a blank joined, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "([a-z0-9])- +([a-z0-9])", "$1$2"), r"\s+", " "))


def without_signs(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def verify_spans(rows: DataFrame, span: str, source: str, least: int = 25) -> DataFrame:
    """Adds verdict: 'kept' if the span is a substring of the source, 'kept-loose' without signs, else 'dropped'.

    Always a substring, never a subsequence; shorter spans prove nothing and are dropped.
    """
    a, b = span_key(F.col(span)), span_key(F.col(source))
    verdict = F.when(F.length(a) < least, "dropped").when(F.coalesce(F.contains(b, a), F.lit(False)), "kept")
    verdict = verdict.when(F.coalesce(F.contains(without_signs(b), without_signs(a)), F.lit(False)), "kept-loose").otherwise("dropped")
    return rows.withColumn("verdict", verdict)


def quote_role(quote: Column, sources: list[tuple[str, Column]], least: int = 20) -> Column:
    """The first role whose text holds the quote as whole words; null if none, or the quote is too short."""
    from papyrine.functions.text import norm

    q = norm(quote)
    out = F.when(F.length(q) < least, F.lit(None).cast("string"))
    for role, text in sources:
        out = out.when(F.contains(F.concat(F.lit(" "), norm(text), F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" "))), role)
    return out


def mutation_rates(rows: DataFrame, own: str, other: str) -> DataFrame:
    """(edit, n, accepted): how often a whole-word check accepts the text itself and three edits of it.

    'swap' exchanges words three and four, 'drop' leaves them out, 'splice' goes on with another text.
    """
    w, x = F.split(own, " "), F.split(other, " ")
    n = F.size(w)
    tail = F.slice(w, F.lit(5), F.greatest(n - 4, F.lit(0)))
    edits = F.array(
        F.struct(F.lit("own").alias("edit"), F.col(own).alias("quote")),
        F.struct(F.lit("swap").alias("edit"), F.array_join(F.concat(F.slice(w, 1, 2), F.array(F.element_at(w, 4), F.element_at(w, 3)), tail), " ").alias("quote")),
        F.struct(F.lit("drop").alias("edit"), F.array_join(F.concat(F.slice(w, 1, 2), tail), " ").alias("quote")),
        F.struct(F.lit("splice").alias("edit"), F.array_join(F.concat(F.slice(w, 1, 3), F.slice(x, F.lit(4), F.greatest(F.size(x) - 3, F.lit(0)))), " ").alias("quote")),
    )
    m = rows.select(F.col(own).alias("own"), F.explode(edits).alias("e")).select("own", "e.edit", "e.quote").where("quote is not null")
    hit = F.contains(F.concat(F.lit(" "), "own", F.lit(" ")), F.concat(F.lit(" "), "quote", F.lit(" ")))
    return m.groupBy("edit").agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("accepted"))


# --- figures -------------------------------------------------------------------------------

# Thousands in groups first, then plain numbers (fixed value).
_FIGURE = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"


def figures(text: Column) -> Column:
    """Numbers of a text in order, thousands commas taken out, typographic minus read; years are left out."""
    raw = F.regexp_extract_all(F.translate(text, "−", "-"), F.lit("(" + _FIGURE + ")"), F.lit(1))
    return F.transform(F.filter(raw, lambda s: ~s.rlike(r"^(19|20)\d\d$")), lambda s: F.regexp_replace(s, ",", ""))


def decimals(figure: Column) -> Column:
    return F.length(F.regexp_extract(figure, r"\.(\d+)$", 1))


def rounds_to(claim: Column, values: Column) -> Column:
    """Whether some value rounds to the claim at the claim's own precision (half to even)."""
    c, dp = claim.cast("double"), decimals(claim)
    scale = F.pow(F.lit(10.0), dp)
    return F.exists(values, lambda v: F.abs(F.rint(v * scale) / scale - c) < F.lit(0.5) / scale * 1e-6)


def derived(values: Column, most: int = 120) -> Column:
    """Sums, differences, ratios and percentages of any two of the ``most`` smallest distinct values, from 0 to ten million."""
    v = F.slice(F.array_sort(F.array_distinct(values)), 1, most)

    def pair(a: Column, b: Column) -> Column:
        return F.array(a - b, b - a, a + b, F.try_divide(a, b) * 100, F.try_divide(b, a) * 100, F.try_divide(a, b), F.try_divide(b, a))

    every = F.flatten(F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 2, F.lit(most)), lambda b: pair(a, b)))))
    return F.filter(every, lambda c: (c >= 0) & (c <= 1e7))


# Keys under which ids stand: a list of them counts by its length, nothing else below them counts (fixed values).
ID_KEYS = frozenset("gid gids attackers namers results cards citing cited_by cites neighbors id".split())


def pool_of(value) -> list[float]:
    """All figures of a JSON tree: numbers, numbers in strings and numeric keys; ids are no figures."""
    out: list[float] = []

    def walk(x) -> None:
        if isinstance(x, bool) or x is None:
            return
        if isinstance(x, (int, float)):
            out.append(float(x))
        elif isinstance(x, str):
            out.extend(float(n.replace(",", "")) for n in re.findall(_FIGURE, x))
        elif isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            for k, y in x.items():
                if re.fullmatch(_FIGURE, k):
                    out.append(float(k.replace(",", "")))
                if k not in ID_KEYS:
                    walk(y)
                elif isinstance(y, list):
                    out.append(float(len(y)))

    walk(value)
    return out


def _pool(tree: str | None) -> list[float]:
    try:
        return pool_of(json.loads(tree)) if tree else []
    except ValueError:
        return []


def figure_pool(trees: Column | str) -> Column:
    """:func:`pool_of` of JSON strings; what is no JSON has no figures."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_pool)

    return run(trees)


def check_figures(rows: DataFrame, text: str, pool: str) -> DataFrame:
    """Per figure of a text: 'ok' if the pool has it, 'derived' from two pool values, else 'no'."""
    f = rows.select("*", F.posexplode(figures(F.col(text))).alias("pos", "figure"))
    verdict = F.when(rounds_to(F.col("figure"), F.col(pool)), "ok").when((decimals(F.col("figure")) <= 2) & rounds_to(F.col("figure"), derived(F.col(pool))), "derived").otherwise("no")
    return f.withColumn("verdict", verdict)


# --- anchored answers ----------------------------------------------------------------------

_ANCHOR = r"⟦([^|⟧]*)\|([^⟧]*)⟧"


def answer_segments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, ref, value): one row per segment of an answer.

    Prose, quote anchors ⟦id|quote⟧ and figure anchors ⟦tool:argument|claim⟧ in order; blank prose is left out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    ref = F.regexp_extract_all(t, F.lit(_ANCHOR), F.lit(1))
    value = F.regexp_extract_all(t, F.lit(_ANCHOR), F.lit(2))
    prose = F.split(t, _ANCHOR, -1)
    s = F.zip_with(prose, F.zip_with(ref, value, lambda r, v: F.struct(F.trim(r).alias("ref"), v.alias("value"))), lambda p, a: F.array(
        F.struct(F.lit("prose").alias("kind"), F.lit(None).cast("string").alias("ref"), p.alias("value")),
        F.struct(F.when(F.contains(a["ref"], F.lit(":")), "figure").otherwise("quote").alias("kind"), a["ref"].alias("ref"), a["value"].alias("value")),
    ))
    kept = F.filter(F.flatten(s), lambda x: F.when(x["kind"] == "prose", ~x["value"].rlike(r"^\s*$")).otherwise(x["value"].isNotNull()) & x["value"].isNotNull())
    return rows.select(key, F.posexplode(kept).alias("pos", "s")).select(key, "pos", "s.kind", "s.ref", "s.value")
