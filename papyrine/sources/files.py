"""Readers and writers: JSON lines, snapshots, CSV and BibTeX exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyrine.functions import text as X


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON lines file or folder; a missing one is an empty frame of the schema, blank lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; the folder appears only when the job has committed."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.option("multiLine", True).json(path)


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest ``snapshot=<date>`` partition under a folder, None where there is none."""
    if not _exists(spark, root):
        return None
    df = spark.read.parquet(root)
    newest = df.agg(F.max("snapshot")).first()[0]
    return None if newest is None else df.where(F.col("snapshot") == F.lit(newest))


def add_snapshot(df: DataFrame, root: str, date: str, body: str) -> bool:
    """Append today's feed under its date with a digest of each body; an empty feed, or a date that is there, changes nothing."""
    spark = df.sparkSession
    if _exists(spark, f"{root}/snapshot={date}") or df.limit(1).count() == 0:
        return False
    df.withColumn("digest", F.substring(F.sha2(body, 256), 1, 16)).write.mode("overwrite").parquet(f"{root}/snapshot={date}")
    return True


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of ``work`` that are not done yet."""
    return work.join(done.select(key), key, "left_anti")


def split_listing(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """(keep.., title, pdf, url): the entries of an HTML proceedings listing."""
    parts = F.split(html, '<div class="paper">')
    part = F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("part")
    e = pages.select(*keep, part)
    title = X.squeeze(F.regexp_replace(F.regexp_extract("part", r'(?s)class="title">(.*?)</', 1), "<[^>]*>", ""))
    return e.select(*keep, title.alias("title"), F.nullif(F.regexp_extract("part", r'href="([^"]+\.pdf)"', 1), F.lit("")).alias("pdf"), F.nullif(F.regexp_extract("part", r'href="([^"]+\.html)"', 1), F.lit("")).alias("url"))


def harvest_records(pages: DataFrame, xml: str) -> DataFrame:
    """(arxiv_base, title, date): live records of harvested XML pages, white space collapsed."""
    r = pages.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)(<record>.*?</record>)"), F.lit(1))).alias("r")).where(~F.col("r").rlike('status="deleted"'))

    def tag(t: str) -> Column:
        return X.squeeze(F.regexp_extract("r", rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1))

    return r.select(tag("id").alias("arxiv_base"), tag("title").alias("title"), F.nullif(tag("created"), F.lit("")).alias("date"))


def citation_key(authors: Column, year: Column, title: Column) -> Column:
    """Last name, year and the first title word of more than three letters."""
    first = F.try_element_at(authors, F.lit(1))
    last = F.when(F.contains(first, F.lit(",")), F.substring_index(first, ",", 1)).otherwise(F.element_at(F.split(F.trim(first), r"\s+"), -1))
    word = F.try_element_at(F.filter(F.split(X.norm(title), " "), lambda w: F.length(w) > 3), F.lit(1))
    return F.concat(F.coalesce(X.plain(last), F.lit("anon")), year.cast("string"), F.coalesce(word, F.lit("")))


def bibtex(papers: DataFrame, key: str = "event_id") -> DataFrame:
    """(event_id, cite_key, entry): one entry per paper; equal keys get a, aa, ... in order of the id."""
    from pyspark.sql import Window

    p = papers.where(F.length("title") > 0).withColumn("natural", citation_key(F.col("authors"), F.col("year"), F.col("title")))
    w = Window.partitionBy("natural").orderBy(key)
    p = p.withColumn("cite_key", F.concat("natural", F.repeat(F.lit("a"), F.row_number().over(w) - 1)))
    lines = [
        F.concat(F.lit("  title = {"), X.bibtex_escape(X.squeeze(F.col("title"))), F.lit("}")),
        F.concat(F.lit("  author = {"), F.array_join(F.transform("authors", X.bibtex_escape), " and "), F.lit("}")),
        F.concat(F.lit("  booktitle = {"), F.col("venue"), F.lit("}")),
        F.concat(F.lit("  year = {"), F.col("year").cast("string"), F.lit("}")),
        F.concat(F.lit("  url = {"), F.col("paper_url"), F.lit("}")),
    ]
    entry = F.concat(F.lit("@inproceedings{"), "cite_key", F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    return p.select(key, "cite_key", entry.alias("entry"))


def flat_rows(papers: DataFrame) -> DataFrame:
    """The columns of a CSV export, lists joined by '; '."""
    lists = [c for c, t in papers.dtypes if t == "array<string>"]
    simple = [c for c, t in papers.dtypes if not t.startswith(("array", "struct", "map"))]
    return papers.select(*simple, *[F.array_join(c, "; ").alias(c) for c in lists])


def write_csv(papers: DataFrame, path: str) -> None:
    flat_rows(papers).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def term_tables(postings: DataFrame, vectors: DataFrame, root: str) -> None:
    """The tables a search service reads: postings sorted by term, vectors rounded to four digits."""
    postings.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{root}/postings")
    vectors.select("key", F.transform("vec", lambda x: F.round(x, 4)).alias("vec")).write.mode("overwrite").parquet(f"{root}/vectors")
