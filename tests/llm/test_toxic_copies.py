"""Labelled rows that share their three least terms only are no copies."""

from chronovox.llm import toxicity


def test_rows_of_common_least_terms_all_count(spark):
    bucket = lambda w: next(iter(toxicity.terms(w)))
    least = " ".join(sorted((f"w{k}" for k in range(2000)), key=bucket)[:3])
    rows = [(k, f"{least} {'marker' if k % 2 else 'plain'} own{k}", k % 2) for k in range(200)]
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {bucket("marker"), bucket("plain")} <= set(machine.buckets.tolist())
    bad, good = machine.score([toxicity.terms(f"{least} {w} other") for w in ("marker", "plain")])
    assert bad > 0.5 > good
