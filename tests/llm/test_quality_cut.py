"""The fitted threshold against every cut tried in turn."""

import random

from hirelake.llm import quality


def tried(rows):
    good, bad = [s for s, g in rows if g], [s for s, g in rows if not g]
    if not good or not bad:
        return None
    at = sorted({s for s, _ in rows})
    cuts = [(sum(s < c for s in good) / len(good) + sum(s >= c for s in bad) / len(bad), c, (at[max(i - 1, 0)] + c) / 2) for i, c in enumerate(at)]
    return min(cuts)[2]


def test_best_cut_equals_trying_all(spark):
    r = random.Random(3)
    cases = [[], [(0.5, True)], [(0.5, False)], [(0.5, True), (0.5, False)], [(0.25, False), (0.75, True)], [(0.25, True), (0.75, False)]]
    cases += [[(r.randrange(8) / 8 + 0.25 * g, g) for g in (r.random() < 0.6 for _ in range(40))] for _ in range(4)]
    for rows in cases:
        got = quality.best_cut(spark.createDataFrame(rows, "score double, good boolean"))
        assert got == tried(rows), rows


def test_tuning_fits_the_threshold_and_a_conflicting_label_counts_as_bad(spark):
    text = lambda word, n: " ".join(f"{word}{(i * 7 + n) % 90}" for i in range(60))
    docs = spark.createDataFrame([(i, text("fine", i)) for i in range(20)] + [(100 + i, text("junk", i)) for i in range(20)] + [(200, None), (201, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)] + [(None, 1), (3, None), (0, 0), (200, 0)], "doc_id long, quality int")
    told = {r["doc_id"]: r["good"] for r in quality.tuning_rows(labels).collect()}
    good = {r["doc_id"] for r in quality.trusted_ids(labels).collect()}
    assert told and good and not good & set(told) and all(told[i] == (0 < i < 20) for i in told)
    got = {r["doc_id"]: r for r in quality.quality(docs, quality.trusted_ids(labels), tuning=quality.tuning_rows(labels)).collect()}
    assert {i for i in got if got[i]["kept"]} == set(range(20)) and len(got) == 42
    assert quality.quality(docs.limit(0), quality.trusted_ids(labels), tuning=quality.tuning_rows(labels)).count() == 0
