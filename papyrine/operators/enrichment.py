"""Extraction results made ready for use, answers graded, cards compared."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import rules as R
from papyrine.functions import text as X


def clean_names(names: Column) -> Column:
    """Names in order, nulls and names in foreign letters left out, each once."""
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "") & ~n.rlike(R.CJK)))


def result_or_span(result: Column, claim: Column, spans: Column) -> Column:
    """The stated result, or else the first novelty span that reads like one.

    The first span is spared where there is no claim, since it stands in for it.
    """
    rest = F.when(claim.isNull(), F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0)))).otherwise(spans)
    return F.coalesce(F.nullif(result, F.lit("")), F.try_element_at(F.filter(rest, lambda s: s.rlike(R.RESULT)), F.lit(1)))


def domain_of(raw: Column) -> Column:
    """struct(domain, family): the canonical area of application; null for what is none."""
    c = X.canon(raw)
    alias = F.create_map(*[F.lit(x) for kv in R.DOMAIN_ALIASES for x in kv])
    family = F.create_map(*[F.lit(x) for name, labels in R.DOMAIN_FAMILIES for label in labels for x in (label, name)])
    d = F.coalesce(F.try_element_at(alias, c), c)
    d = F.when(d.isin(*R.NOT_A_DOMAIN) | d.isin(*R.JUNK_LABELS) | ~X.is_label(d), F.lit(None).cast("string")).otherwise(d)
    return F.struct(d.alias("domain"), F.try_element_at(family, d).alias("family"))


def cards(facts: DataFrame, key: str) -> DataFrame:
    """(key, methods, tasks, datasets, domain, family, claim, result, limitation): one card per record, lists capped."""
    f = F.col("facts")
    d = domain_of(f["domain"])
    claim = F.coalesce(F.nullif(f["key_change"], F.lit("")), F.try_element_at(f["novelty_spans"], F.lit(1)))
    return facts.select(
        key,
        F.slice(clean_names(f["methods"]["name"]), 1, 6).alias("methods"), F.slice(clean_names(f["tasks"]["name"]), 1, 4).alias("tasks"), F.slice(clean_names(f["datasets"]["name"]), 1, 4).alias("datasets"),
        d["domain"].alias("domain"), d["family"].alias("family"), claim.alias("claim"), result_or_span(f["result_claim"], f["key_change"], f["novelty_spans"]).alias("result"), f["limitation"].alias("limitation"),
    )


def rename_terms(terms: DataFrame, term: str, mapping: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Terms through the learned mapping, twice at most, and then through the manual one, which wins."""
    m = mapping.select(F.col("term").alias("_t"), F.col("canonical").alias("_c"))
    out = terms.withColumn("_t", X.basic(F.col(term)))
    for _ in range(2):
        out = out.join(m, "_t", "left").withColumn("_t", F.coalesce("_c", "_t")).drop("_c")
    if overrides is not None:
        out = out.join(overrides.select(F.col("term").alias("_t"), F.col("canonical").alias("_c")), "_t", "left").withColumn("_t", F.coalesce("_c", "_t")).drop("_c")
    return out.withColumnRenamed("_t", "canonical")


def last_write(cache: DataFrame, key: str, sequence: str) -> DataFrame:
    """Of an append-only cache the row written last per key."""
    w = Window.partitionBy(key).orderBy(F.col(sequence).desc())
    return cache.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def registry_status(registry: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, status): 'ok', 'renamed', 'gone', 'error' or 'unknown' of each registered resource."""
    c = cache.select(key, "found", "gone", "error", F.col("name").alias("_name"))
    status = F.when(F.col("found").isNull(), "unknown").when(F.col("error"), "error").when(F.col("gone") | ~F.col("found"), "gone").when(F.lower("_name") != F.lower(key), "renamed").otherwise("ok")
    return registry.join(c, key, "left").select(key, status.alias("status"))


def relation(pairs: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, relation): 'both', 'cites', 'cited by' or 'none' of each pair."""
    e = edges.select("citing", "cited").distinct()
    out = pairs.join(e.select(F.col("citing").alias(a), F.col("cited").alias(b), F.lit(True).alias("_x")), [a, b], "left")
    out = out.join(e.select(F.col("cited").alias(a), F.col("citing").alias(b), F.lit(True).alias("_y")), [a, b], "left")
    r = F.when(F.col("_x") & F.col("_y"), "both").when(F.col("_x"), "cites").when(F.col("_y"), "cited by").otherwise("none")
    return out.select(a, b, r.alias("relation"))


def near_badge(membership: DataFrame, topic: str, doc: str) -> DataFrame:
    """(doc, near): whether a topic reaches a document through narrower labels only."""
    g = membership.groupBy(topic, doc).agg(F.min("kind").alias("k"))
    return g.select(topic, doc, (F.col("k") == 2).alias("near"))


def external_cites(texts: DataFrame, doc: str, text: str, known: DataFrame, ident: str, least: int = 2) -> DataFrame:
    """(ident, n): identifiers of preprints that several texts cite and that are known by title."""
    ids = texts.select(doc, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)arxiv[:. ]*(\d{4}\.\d{4,7})"), F.lit(1)))).alias(ident))
    return ids.groupBy(ident).agg(F.count_distinct(doc).alias("n")).where(F.col("n") >= least).join(known.select(ident).distinct(), ident, "left_semi")


def governor_cites(text: Column) -> Column:
    """array<struct(name, year)> of 'Name et al. (2024)' and '(Name, 2024)'."""
    p = r"([A-Z][\p{L}'\-]+)(?: et al\.?| and [A-Z][\p{L}'\-]+)?,? \(?((?:19|20)\d\d)[a-z]?\)?"
    return F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda n, y: F.struct(n.alias("name"), y.alias("year")))


def declines(text: Column) -> Column:
    """Whether the opening of an answer declines."""
    return F.substring(text, 1, 700).rlike(R.DECLINE)


def figures_survive(source: Column, out: Column) -> Column:
    """Whether every figure of a text comes back in its rendering, by value; '3k' may come back as 3,000."""
    from papyrine.operators.verification import figures

    a = F.transform(figures(source), lambda s: s.cast("double"))
    thousand = F.transform(F.regexp_extract_all(source, F.lit(r"(\d+(?:\.\d+)?)\s*[kK]\b"), F.lit(1)), lambda s: s.cast("double"))
    b = F.transform(figures(out), lambda s: s.cast("double"))
    return F.forall(a, lambda v: F.array_contains(b, v) | (F.array_contains(thousand, v) & F.array_contains(b, v * 1000)))


def rendering_score(source: Column, out: Column) -> Column:
    """struct(numbers_kept, length_ratio, sentence_ratio, echo) of a rendering beside its source."""
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"([.!?。]+)(?:\s|$)"), F.lit(1)))
    return F.struct(
        figures_survive(source, out).alias("numbers_kept"), F.try_divide(F.length(out), F.length(source)).alias("length_ratio"),
        F.try_divide(count(out), count(source)).alias("sentence_ratio"), (X.norm(source) == X.norm(out)).alias("echo"),
    )


def rendering_details(source: Column, out: Column, script: str = "[가-힣]") -> Column:
    """struct(numbers, kept, lost, script_share, echo_chars): figures that come back, letters of the wanted script, source repeated.

    kept and lost are distinct figures as written; echo_chars is the longest run of 40 Latin letters or more that begins as a
    part of the source does.
    """
    from papyrine.operators.verification import figures

    a, b = figures(source), figures(out)
    wanted = F.array_distinct(a)
    letters = lambda p: F.length(out) - F.length(F.regexp_replace(out, p, ""))
    runs = F.filter(F.regexp_extract_all(out, F.lit(r"([A-Za-z][A-Za-z ,.:%()\-]{39,})"), F.lit(1)), lambda r: F.contains(source, F.substring(F.trim(r), 1, 40)))
    return F.struct(
        F.size(a).alias("numbers"), F.size(F.array_intersect(wanted, b)).alias("kept"), F.array_join(F.array_sort(F.array_except(wanted, b)), " ").alias("lost"),
        F.round(letters(script) / F.greatest(letters(script) + letters("[A-Za-z]"), F.lit(1)), 2).alias("script_share"), F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).alias("echo_chars"),
    )


def set_metrics(found: DataFrame, truth: DataFrame, key: str, item: str) -> DataFrame:
    """(key, found, wanted, hit, recall, precision) of sets of items; a side without items has a null rate."""
    f, t = found.select(key, item).distinct().withColumn("_f", F.lit(1)), truth.select(key, item).distinct().withColumn("_t", F.lit(1))
    g = f.join(t, [key, item], "full").groupBy(key).agg(F.count("_f").alias("found"), F.count("_t").alias("wanted"), F.count(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1)).alias("hit"))
    return g.withColumn("recall", F.try_divide(F.col("hit"), F.col("wanted"))).withColumn("precision", F.try_divide(F.col("hit"), F.col("found")))


def pick_ranges(ranges: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of (start, end, priority, role) the longest first, then by priority and place, without overlap, in order."""
    taken: list[tuple[int, int, str]] = []
    for a, b, _, role in sorted(ranges, key=lambda r: (r[0] - r[1], r[2], r[0])):
        if a < b and all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, role))
    return sorted(taken)


def annotate(rows: DataFrame, key: str, text: str, phrases: str) -> DataFrame:
    """(key, start, end, role): places of the phrases (array<struct(role, phrase, priority)>) in a text, none overlapping."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for k, t, ps in zip(b[key], b[text], b[phrases]):
                found = [(m.start(), m.end(), p["priority"], p["role"]) for p in (ps if ps is not None else []) if t and p["phrase"] for m in re.finditer(re.escape(p["phrase"]), t)]
                out += [(k, a, e, r) for a, e, r in pick_ranges(found)]
            yield pd.DataFrame(out, columns=[key, "start", "end", "role"])

    return rows.select(key, text, phrases).mapInPandas(run, f"{key} {kind}, start int, end int, role string")


def group_summary(rows: DataFrame, group: str, coordinates: list[str], area: str, top: int = 3) -> DataFrame:
    """(group, n, mean coordinates, leading areas)."""
    base = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in coordinates])
    c = rows.where(F.col(area).isNotNull()).groupBy(group, area).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(F.col("c").desc(), area)
    lead = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", area))), lambda x: x[area]), "; ").alias("areas"))
    return base.join(lead, group, "left")


def rising_terms(pairs: DataFrame, term: str, least: int = 12, most_share: float = 0.05, bar: float = 2.576) -> DataFrame:
    """Terms that rise from one side to the other and are too rare on both to be common words."""
    from papyrine.functions.stats import two_proportion_z

    n0, n1, t0, t1 = (F.col(c) for c in ("n0", "n1", "t0", "t1"))
    out = pairs.where((n0 + n1 >= least) & (n0 <= most_share * t0) & (n1 <= most_share * t1)).withColumn("z", two_proportion_z(n0, t0, n1, t1))
    return out.where(F.col("z") >= bar)
