"""A corpus pipeline of the operators in chronovox.llm: each stage reads what its predecessor kept.

All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovox.llm import jaccard, mixing, quality, sentencepieces, surrogates
from chronovox.llm.common import documents, labels, words
from chronovox.llm.queries import surrogate_key, tokenizer
from chronovox.operators.checkpoints import new_folder, removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that is never null and tells rows apart unless they are equal: the id and a hash of all columns.
    Decisions come back to the rows by it, so that null and repeated ids do no harm."""
    seen = F.xxhash64(*[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())])
    return docs.select(*COLUMNS, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(seen)).alias("__key"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go. Rows carry their columns past the statistics,
    so nothing is shuffled."""
    rules = quality.fit(docs, labels(spark, sf_dir))
    carried = {c: f"__own_{c}" for c in COLUMNS}
    return quality.statistics(docs, carried=carried).where(quality.verdict(rules)).select(*[F.col(n).alias(c) for c, n in carried.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of least key; of equal rows, one. Near-duplicates share
    0.8 or more of their 5-word shingles (Jaccard): SimHash, in wider codes than those of op9's contract, finds them, and
    whole sets decide."""
    docs = keyed(docs)
    least = jaccard.near_copies(docs, "__key").where("doc_id = component_id").select(F.col("doc_id").alias("__key")).distinct()
    return docs.join(least, "__key", "left_semi").dropDuplicates(["__key"]).select(*COLUMNS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; n_chars follows the text."""
    return surrogates.distinct(docs, surrogate_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it: not at all, once, or twice. Equal rows share what they get."""
    docs = keyed(docs)
    rows = docs.select(F.col("__key").alias("doc_id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    taken = mixing.mixed(rows, [5, 2, 1], share=1.5, most=2).groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").alias("__all"))
    copies = F.explode(F.sequence(F.lit(1), F.col("__all")))
    return docs.join(taken.where("__all > 0"), "__key").dropDuplicates(["__key"]).withColumn("__copy", copies).select(*COLUMNS)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and the hash of what they decode to."""
    found = sentencepieces.coded(docs, sentencepieces.Vocabulary.load(tokenizer(spark)))
    return found.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", pii_surrogates),
    ("source mix", source_mix),
    ("tokens", sentencepiece_ids),
]

#: SQL can't express the learned rules, the fingerprints, or the tokens; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written below spark.checkpoint.dir and read again, and goes once
    the next stage has been written. The last stage's rows go when the session ends."""
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        at = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        docs = spark.read.parquet(at)
        if before:
            removed(spark, before)
        before = at
    return docs
