"""The registered queries opN_ of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovox.llm import langid, lzphrases, mixing, packing, quality, runs, sentencepieces, sharding, simhash, substrings, surrogates, toxicity, whitening
from chronovox.llm.common import documents, labels, remainder, words


def op1_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of all documents and of their edited texts."""
    return lzphrases.half_edited(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the machine learns from the rows that aren't held out."""
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id")) == 2
    machine = toxicity.train(docs, labels(spark, sf_dir).where(~held_out))
    return toxicity.scored(docs, machine).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


#: Where the settings of a session don't name others: the key serves tests and demonstrations only, as whoever reads this
#: can undo its surrogates. A deployment sets spark.chronovox.key (and calls surrogates.replaced with its own).
KEY = b"a key that only serves these queries"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def surrogate_key(spark: SparkSession) -> bytes:
    return spark.conf.get("spark.chronovox.key", KEY.decode()).encode()


def tokenizer(spark: SparkSession) -> str:
    """The path of a sentencepiece model, on the driver."""
    return spark.conf.get("spark.chronovox.tokenizer", TOKENIZER)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates, and where these stand for what kind of entity; no two entities of the table share one."""
    found = surrogates.distinct(documents(spark, sf_dir).select("doc_id", "text"), surrogate_key(spark))
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the words of 50-word windows that start in a document of smaller id."""
    return substrings.repeats_removed(documents(spark, sf_dir), window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the hash of what they decode to."""
    found = sentencepieces.coded(documents(spark, sf_dir), sentencepieces.Vocabulary.load(tokenizer(spark)))
    return found.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 24 shards by the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffled_shards(rows, 24, ["doc_id", "text_crc32", "size"], seed=6).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of all documents, the base rules, and the learned list's verdict."""
    docs = documents(spark, sf_dir)
    rules = quality.fit(docs, labels(spark, sf_dir))
    return quality.statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.base_failed().alias("base_failed"), quality.verdict(rules).alias("kept"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents; the model learns from those that aren't held out."""
    docs = documents(spark, sf_dir)
    model = langid.train(langid.training_rows(docs))
    return langid.identify(docs, model).select(
        "doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    rows = documents(spark, sf_dir).select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mixing.mixed(rows, [5, 2, 1], share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; where 10 divides the crc32 of the id (a null one counts as empty), the words from one
    on repeat from there to the end with a period: all three follow from the id and the number of words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.expr("__h div 10")
    n = F.size("__w")
    rows = docs.select("doc_id", "text", h.alias("__h")).withColumn("__w", F.when(F.col("__h") % 10 == 0, words(F.col("text"))))
    rows = rows.withColumn("__a", F.when(n > 0, (g % n).cast("int"))).withColumn("__p", (1 + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int"))
    a, p = F.col("__a"), F.col("__p")
    tail = F.flatten(F.array_repeat(F.slice("__w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    edited = F.array_join(F.slice(F.concat(F.slice("__w", F.lit(1), a), tail), F.lit(1), n), " ")
    return rows.select("doc_id", F.when(a.isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, some of which get periodic ends first, and the hash of their words without the repeats."""
    found = runs.periodic_runs(planted_runs(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct((r.length / r.period).alias("e"), (-r.start).alias("s"), (-r.period).alias("p"), r.length.alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("1000 * b.length div -b.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, in 64ths, whitened, and how far their covariance is from the identity."""
    rows = whitening.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 64).cast("long") + 1000000).alias("embedding"))
    w = whitening.fit(rows)
    return whitening.whitened(rows, w).withColumn("identity_error", F.lit(whitening.identity_error(rows, w)))


def tokenizer_file(spark: SparkSession) -> str:
    """The content of a tokenizers file, read on the driver."""
    if not (at := spark.conf.get("spark.chronovox.tokenizer.file", None)):
        import public_tokenizers

        at = public_tokenizers.path("byte_bpe_50k.json")
    with open(at, encoding="utf-8") as f:
        return f.read()


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of up to 2048 ids."""
    return packing.packed(documents(spark, sf_dir), tokenizer_file(spark), end=1, capacity=2048).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_lz_fingerprints, op2_toxicity, op3_pii_surrogates, op4_substring_dedup, op5_sentencepiece, op6_sharding, op7_quality_rules, op8_language_id, op9_simhash, op10_mixing, op11_periodic_runs, op12_whitening, op13_packing)}

#: Windows as texts, the least doc_id of each, and the words they cover.
_OP4 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
    SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS t
    FROM d, unnest(range(1, len(w) - 48)) AS u(p) WHERE len(w) >= 50
), low AS (
    SELECT t, min(doc_id) AS m FROM win GROUP BY t
), gone AS (
    SELECT DISTINCT win.doc_id, p + k AS q FROM win JOIN low USING (t), unnest(range(0, 50)) AS u(k) WHERE m < win.doc_id
), g AS (
    SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(qs, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op4_substring_dedup": _OP4}
