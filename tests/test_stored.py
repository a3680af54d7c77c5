"""What the queries that read stored tables write and shuffle."""

import pytest

from turnstone.functions import text as T
from turnstone.operators import edus as E
from turnstone.plans import fixtures as X
from turnstone.plans.queries import QUERIES
from turnstone.sources import scratch


@pytest.fixture
def talks(spark, tmp_path):
    rows = [(i, k, "user", f"  about number{chr(97 + i)} and other matters\nline {k} of it\x85") for i in range(6) for k in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_keyword_search_writes_what_it_reads(spark, talks):
    before = len(scratch.HELD)
    assert QUERIES["keyword_search_global"](spark, talks).count() > 0
    assert len(scratch.HELD) == before + 3  # facts, trajectories, keywords; no frequencies


def test_words_are_not_shuffled(spark, talks):
    found = E.trajectory_keywords(X.stored(spark, talks).edus)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum(" Exchange " in line for line in plan) == 1
    assert "Exchange" in next(line for line in reversed(plan) if "Exchange" in line or "Generate" in line)  # below the words, towards the scan


def test_strip_searches_whole_texts_only_where_an_end_is_blank(spark):
    texts = ["", " ", "a", " a", "a ", "　a b ", "a\n", "a \r\n", "\x1ca\x85", "a b", "😀 😀", " 😀", "x\ny", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    got = rows.select("t", T.strip(rows.t).alias("s")).collect()
    blank = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    assert len(got) == len(texts) and all(r["s"] == (None if r["t"] is None else r["t"].strip(blank)) for r in got)
