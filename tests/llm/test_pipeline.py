import collections

from conftest import ROWS, SCHEMA, text
from test_operators import brute_fingerprint, split

import corpus_pipeline as pipeline
from chronovox.llm import sentencepieces, surrogates
from chronovox.llm.queries import KEY, TOKENIZER


def test_stages_against_brute_force(spark, tmp_path):
    # Six plain documents of other words than the fixture's: the rules' learner has two labels to go by.
    more = [(100 + k, text(50 + k, 90) + f" mail{k}@x.example.com", "en", "abc"[k % 3], 0) for k in range(12)]
    junk = [(200 + k, " ".join(w + "###" for w in text(80 + k, 90).split()), "en", "a", 0) for k in range(12)]
    docs = spark.createDataFrame([*ROWS, *more, *junk], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in more] + [(r[0], 0, 0) for r in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one = pipeline.quality_rules(spark, docs, str(tmp_path)).collect()
    want = [r for r in [*ROWS, *more] if len(split(r[1])) >= 50 and r[0] not in (8, 9, 11)]
    got = sorted((r["doc_id"] for r in one if r["doc_id"] not in (8, 9, 11)), key=str)
    assert got == sorted((r[0] for r in want), key=str)
    two = pipeline.near_duplicates(spark, spark.createDataFrame(one, SCHEMA), str(tmp_path)).collect()
    prints = [brute_fingerprint(r["text"]) for r in two]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])
    assert all(min((brute_fingerprint(r["text"]) ^ p).bit_count() for p in prints) <= 3 for r in one)
    three = pipeline.pii_surrogates(spark, spark.createDataFrame(two, SCHEMA), str(tmp_path)).collect()
    maker = surrogates.Surrogates(KEY)
    assert {r["doc_id"]: r["text"] for r in three} == {r["doc_id"]: maker.replace(r["text"])[0] for r in two}
    assert all(r["n_chars"] == len(r["text"]) for r in three)
    four = pipeline.source_mix(spark, spark.createDataFrame(three, SCHEMA), str(tmp_path)).collect()
    copies = collections.Counter(r["doc_id"] for r in four)
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in three}
    five = pipeline.sentencepiece_ids(spark, spark.createDataFrame(four, SCHEMA), str(tmp_path)).collect()
    d = sentencepieces.Decoder(sentencepieces.Vocabulary.load(TOKENIZER))
    assert collections.Counter(d.decode(r["ids"]) for r in five) == collections.Counter(r["text"] for r in four)
    assert pipeline.run(spark, str(tmp_path)).count() == len(five)


def test_stages_with_nulls_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(None, None, None, None, None)] * 2 + [(1, None, None, None, None)], ROWS):
        for _, stage in pipeline.STAGES:
            stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).count()
