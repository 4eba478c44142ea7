"""Shapes of plans that keep the work in proportion to the input."""

import pytest

from hirelake.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["filter_country", "pre_filter", "pre_filter_verdicts"])
def test_pairs_stay_where_they_are_made(spark, name):
    """Places are read once for each posting; no pair is shuffled to be judged."""
    text = plan(catalog.QUERIES[name](spark, SMALL))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


@pytest.mark.parametrize(("name", "unions"), [("validate_descriptions", 0), ("record_missing_info", 1)])
def test_descriptions_are_read_in_one_place(spark, name, unions):
    """Postings are not read once for each outcome; the union left is that of old and new verdicts."""
    text = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Union " in line for line in text.splitlines()) == unions


def test_no_side_of_many_profiles_is_broadcast_by_its_files(spark):
    """Small files may hold many rows: profiles and postings meet by merge joins, profiles at their titles before pairs."""
    text = catalog.QUERIES["pre_filter_many"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in text.splitlines() if "Join Inner" in line]
    assert joined and sum("strategy=merge" in line for line in joined) >= 4


def test_words_of_titles_are_read_before_pairs(spark):
    """Words of titles and zones of pay are read once for a posting or a profile, so above the pairing nothing is split."""
    for name in ("pre_filter", "pre_filter_verdicts"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        above, _, below = plan.partition("Join ")
        assert below and "split(" not in above and "bay area" not in above
