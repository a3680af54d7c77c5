"""The plans that matter are the ones meant."""

from conftest import DATA

from turnstone.plans.queries import QUERIES


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_search_is_a_top_k(spark):
    text = plan(QUERIES["search_topk"](spark, DATA))
    assert text.count("TakeOrderedAndProject") == 2 and "CartesianProduct" not in text and "Python" not in text


def test_caps_limit_windows(spark):
    assert "WindowGroupLimit" in plan(QUERIES["catalog_capped"](spark, DATA))


def test_scans_are_pruned(spark):
    text = plan(QUERIES["eval_resume_antijoin"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "text" not in text.split("ReadSchema", 1)[1].split("\n", 1)[0]


def test_recall_reads_stored_tables(spark):
    for name in ("wall_budget", "stitch_blocks", "hit_fusion", "index_hash"):
        QUERIES[name](spark, DATA)  # writes the tables, if no query has
        assert plan(QUERIES[name](spark, DATA)).count("conversations.parquet") == 0


def test_no_nested_loops(spark):
    for name in ("keyword_canonicalize", "recall_at_k", "stitch_blocks"):
        text = plan(QUERIES[name](spark, DATA))
        assert "NestedLoop" not in text and "CartesianProduct" not in text
