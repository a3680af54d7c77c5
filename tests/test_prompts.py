from hashlib import md5

from turnstone.operators import prompts as M
from turnstone.plans.queries import QUERIES


def test_label_digests(spark):
    """Those of the whole prompts: many trajectories a project, a project without keywords, one that is null."""
    facts = [(f"t{i}", p, k, "config", f"fact {i} é\n{k}") for i, p in enumerate(["p", "q", "bare", None] * 60) for k in range(i % 3 + 1)]
    edus = spark.createDataFrame(facts, "trajectory_id string, project string, trajectory_index long, tag string, text string")
    cloud = spark.createDataFrame([(p, f"word{i}") for p in "pq" for i in range(500)] + [("unused", "x"), (None, "y")], "project string, keyword string")
    whole = {r["trajectory_id"]: r["prompt"] and md5(r["prompt"].encode()).hexdigest() for r in M.label_prompt(edus, cloud).collect()}
    assert len(whole) == 240 and sum(x is None for x in whole.values()) == 60
    for pieces in (1, 3, 24):
        rows = M.label_digest(edus, cloud, pieces).collect()
        assert len(rows) == 240 and {r["trajectory_id"]: r["prompt_md5"] for r in rows} == whole


def test_label_query_joins_no_keywords_to_trajectories(spark, tmp_path):
    """A project's keywords must not be carried by each of its trajectories: what the query shuffles and hashes would grow with the square of the input."""
    n = 300
    talks = [(5 * i, 0, "user", f"{''.join(chr(97 + (i * 7 + j * j) % 26) for j in range(12))} {i}") for i in range(n)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["label_prompt"](spark, str(tmp_path))
    assert len({r["prompt_md5"] for r in found.collect()}) == n
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and "md5(" not in found._jdf.queryExecution().optimizedPlan().toString()
