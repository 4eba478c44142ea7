"""op1 learns from every labelled document, however many."""

import random

from hirelake.llm import quality


def test_no_label_is_left_out(spark):
    labels = spark.range(60_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    told = labels.where("crc32(cast(doc_id as string)) % 5 = 1")
    assert told.count() > 10_000 and quality.tuning_rows(labels).count() == told.count()
    good = labels.where("quality = 1 and crc32(cast(doc_id as string)) % 5 <> 1")
    assert good.count() > 10_000 and quality.trusted_ids(labels).count() == good.count()


def test_cut_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(round(rng.gauss(0.3 * good, 0.3), 2), bool(good)) for good in (rng.random() < 0.6 for _ in range(3000))]
    scores = sorted({s for s, _ in rows})
    n = {k: sum(g is k for _, g in rows) for k in (True, False)}
    cost = lambda s: sum(g for x, g in rows if x < s) / n[True] + 1 - sum(not g for x, g in rows if x < s) / n[False]
    best = min(range(len(scores)), key=lambda i: (round(cost(scores[i]), 12), i))
    want = (scores[best - 1] + scores[best]) / 2 if best else scores[0]
    assert abs(quality.best_cut(spark.createDataFrame(rows, "score double, good boolean").repartition(7)) - want) < 1e-12


def test_trusted_ids_meet_texts_by_one_plan_at_any_size(spark):
    """Few ids take the same shuffle as many, so that disk grows as the input."""
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(50)], "doc_id long, text string")
    ratios = quality.log_ratios(docs, spark.range(3).withColumnRenamed("id", "doc_id"))
    assert len(ratios.first()["weights"]) == quality.BUCKETS
    plan = ratios._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id" in plan
