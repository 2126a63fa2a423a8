"""Queries of the operators in this subpackage, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import canon, entity, leaks, mixing, residue, spellings, survivor, terms
from papyrine.session import fan_out, table


def _organisations(spark: SparkSession, d: str) -> DataFrame:
    names = spellings.affiliations(table(spark, d, "papers").select("author_institutions"))
    return spellings.organisations(names, table(spark, d, "institution_aliases"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.spelling_pairs(_organisations(spark, d))


def p1_organisations(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the smallest spelling of its organisation and their number."""
    orgs = _organisations(spark, d)
    size = orgs.groupBy("org").agg(F.min("name").alias("organisation"), F.count("*").alias("n_spellings"))
    return orgs.join(size, "org").select("name", "organisation", "n_spellings")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "papers")).select("group_id", "field", "event_id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with its group and the size of the group."""
    keep = ["event_id", "venue", "year", "title", "authors", "duplicate_event_ids", "ingested_at", "abstract", "decision", "openreview_id", "presentation", "topic_raw"]
    groups = survivor.entry_groups(survivor.latest_deliveries(table(spark, d, "papers").select(*keep)))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n_entries"))
    return groups.join(sizes, "group_id").select("event_id", "group_id", "n_entries")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "papers")).where("mark <> 'useful'").select("term", "mark")


def p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "papers")).select("term", "occurrences", "records", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "facts_abstract").select("event_id", "facts", "extracted_at")
    return canon.mapped_names(facts, table(spark, d, "term_reference")).select("event_id", "field", "pos", "ref_id")


def p4_value_map(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct free name with its item, how it was found, and how often it is used."""
    names = canon.free_names(table(spark, d, "facts_abstract").select("event_id", "facts", "extracted_at"))
    used = names.groupBy("kind", "name").agg(F.count("*").alias("n_uses"))
    return canon.map_values(names, table(spark, d, "term_reference")).join(used, ["kind", "name"])


def _preprints(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").select("event_id", "title", "authors", "year")
    return entity.preprints(papers, table(spark, d, "arxiv_index"), table(spark, d, "resolved"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _preprints(spark, d).select("event_id", "arxiv_base")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its confidence, beside what an earlier run had resolved."""
    earlier = table(spark, d, "resolved").where("arxiv_base is not null").groupBy("event_id").agg(F.min("arxiv_base").alias("earlier"))
    found = _preprints(spark, d).join(earlier, "event_id", "left")
    return found.select("event_id", "arxiv_base", "confidence", F.when(F.col("earlier").isNull(), "new").when(F.col("earlier") == F.col("arxiv_base"), "same").otherwise("other").alias("beside_earlier"))


def p5_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Per tenth of confidence, the pairs that an earlier run knows and the share on which both agree.

    The earlier run's other half fitted the confidence; this half is held out.
    """
    known = entity.trusted_half(table(spark, d, "resolved"), held_out=True).withColumnRenamed("arxiv_base", "known")
    tenth = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")
    rows = _preprints(spark, d).join(known, "event_id").select(tenth.alias("tenth"), "confidence", (F.col("arxiv_base") == F.col("known")).cast("double").alias("agrees"))
    return rows.groupBy("tenth").agg(F.count("*").alias("n_pairs"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg("agrees"), 4).alias("agreed"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return leaks.leaked_items(docs, table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_item_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Per test item, in how many documents it leaked; items that did not leak have 0."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items")
    found = leaks.leaked_items(docs, items).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.max("share"), 6).alias("most"))
    return items.select("item_id", "suite").join(found, "item_id", "left").fillna({"n_docs": 0, "most": 0.0})


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often every document of a named source is taken."""
    sizes = mixing.token_sizes(table(spark, d, "documents").select("doc_id", "text", "source"))
    return mixing.mix(sizes, table(spark, d, "mix_targets"))[0].withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source, and the sources that fall short."""
    sizes = mixing.token_sizes(table(spark, d, "documents").select("doc_id", "text", "source"))
    return mixing.mix(sizes, table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "event_id")
    return residue.residue_documents(docs, table(spark, d, "papers")).select("doc_id")


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Per source as typed, how many documents hold residue."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "event_id")
    found = residue.residue_documents(docs, table(spark, d, "papers"))
    joined = docs.select("doc_id", "source").distinct().join(found, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("evidence").alias("n_residue"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
