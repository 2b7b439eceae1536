"""How often the plans of costly queries read the signals: one read of the view is a scan of each of its three tables."""

import re

import pytest

from signalweave.plans import registry


@pytest.mark.parametrize(("name", "reads"), [("k1_country_heat", 1), ("k6_theme_flows", 2), ("k6_flows_in_focus", 2), ("k11_narratives", 2), ("k11_narratives_zipped", 2)])
def test_reads_of_the_signals(spark, small, name, reads):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x and "user_id" in x]
    assert len(scans) == reads, plan


def plan_of(spark, df):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_labels_are_made_once_a_theme(spark, small):
    plan = plan_of(spark, registry.queries()["k38_fuzzy_dictionary"](spark, small))
    made = [x for x in plan if "USPEC_POLICY_ECONOMIC" in x]  # by the result of an aggregate over the themes alone, not by what it reads
    assert made and all(re.search(r"Aggregate \[entry#\d+\], ", x) for x in made)


def test_texts_are_not_searched_once_a_signal(spark, small):
    plan = plan_of(spark, registry.queries()["k37_fuzzy_suggest"](spark, small))
    assert any("[^a-z0-9]+" in x for x in plan)
    assert not [x for x in plan if "Filter " in x and "[^a-z0-9]+" in x]  # such a filter goes down to the rows of the signals


def test_topics_meet_words_without_shuffling_them(spark, small):
    plan = plan_of(spark, registry.queries()["l7_seed_topics"](spark, small))
    assert sum("user_id" in x and "Relation" in x for x in plan) == 1
    assert any("strategy=broadcast" in x for x in plan)
