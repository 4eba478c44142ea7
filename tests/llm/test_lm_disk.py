"""What op5 leaves on disk."""

import time

from hirelake.llm import lm_scoring


def test_shuffles_go_when_scores_are_stored(spark):
    """Passes over texts and pairs leave no shuffle files behind, so that disk holds one pass at a time."""
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more") for i in range(40)], "doc_id long, text string")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: blocks.getAllFiles().mkString("\n").count("/shuffle_")
    before = held()
    assert lm_scoring.score(docs, docs).count() == 40
    for _ in range(20):
        if held() <= before + 4:
            break
        time.sleep(0.5)
    assert held() <= before + 4  # those of the count above
