from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnstone.functions import scoring as S
from turnstone.functions import text as T
from turnstone.functions.embedding import by_model, hashed
from turnstone.operators.reports import humanized, padded, status_text
from turnstone.sources.questions import moment


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, clean", [("  a\n", "a"), ("　b\xa0", "b"), ("\x1cc\x0b", "c"), ("", ""), (None, None)])
def test_strip(spark, raw, clean):
    assert one(spark, T.strip(F.lit(raw))) == clean


def test_keywords(spark):
    assert one(spark, T.normalize_keyword(F.lit("  Build\tFrom  Source "))) == "build-from-source"
    assert one(spark, T.clean_keywords(F.array(*map(F.lit, ["B b", "a", "b  B", " "])))) == ["b-b", "a"]
    assert one(spark, T.clean_terms(F.array(*map(F.lit, ["Build from source", "", " X "])))) == ["build from source", "x"]


@pytest.mark.parametrize("raw, tag", [(" Decision", "decision"), ("nope", "project"), ("", "project"), (None, "project"), ("CONFIG\n", "config")])
def test_tags(spark, raw, tag):
    assert one(spark, T.coerce_tag(F.lit(raw).cast("string"))) == tag


@pytest.mark.parametrize("raw, clean", [("-home-ann-some-thing", "some-thing"), ("-home-ann", "home"), ("-home-", "-home-"), ("-srv-x", "-srv-x"), ("home", "home")])
def test_projects(spark, raw, clean):
    assert one(spark, T.clean_project(F.lit(raw))) == clean


def test_project_of_path(spark):
    assert one(spark, T.project_of_path(F.lit("/home/ann/work/x"))) == "work-x"


@pytest.mark.parametrize("seconds, text", [(0, "1 second ago"), (59, "59 seconds ago"), (60, "1 minute ago"), (7200, "2 hours ago"), (86400 * 3 + 5, "3 days ago")])
def test_age(spark, seconds, text):
    assert one(spark, T.age(F.lit(float(seconds)))) == text == humanized(seconds)


def test_cut_at_word(spark):
    assert one(spark, T.cut_at_word(F.lit("aaa bbb ccc"), 6)) == "aaa…"
    assert one(spark, T.cut_at_word(F.lit("aaaaaaaaa"), 6)) == "aaaaaa…"
    assert one(spark, T.cut_at_word(F.lit("short"), 6)) == "short"


def test_cosine_of_zero(spark):
    zero, x = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, S.cosine(zero, x)) == 0 and one(spark, S.similarity(x, x)) == pytest.approx(1)


def test_future_recency(spark):
    future = F.lit(datetime(2025, 1, 11)).cast("timestamp")
    assert one(spark, S.recency("2025-01-01", future, clamp=False)) > 1
    assert one(spark, S.recency("2025-01-01", future, clamp=True)) == 1


def test_status():
    text = status_text(7, 2, None, 1, 0, 2)
    assert "stored: 7" in text and "never" in text and "3 sessions (new 1, ingesting 2)" in text
    assert "Waiting: none" in status_text(0, 0, 5, 0, 0, 0)


def test_whole_numbers(spark):
    assert one(spark, T.whole_numbers(F.array(*map(F.lit, ["1", "2.9", "x", "", "-3"])))) == [1, 2, -3]
    assert one(spark, T.thousands(F.lit(1234567))) == "1,234,567"


def test_embedding(spark):
    import math

    v = one(spark, hashed(F.lit("Wort wort anders")))
    assert len(v) == 64 and math.isclose(sum(x * x for x in v), 1) and sorted(v)[-1] == pytest.approx(2 / math.sqrt(5))
    assert one(spark, hashed(F.lit(None).cast("string"))) == [0.0] * 64
    model = by_model(lambda: lambda texts: [[float(len(t))] for t in texts])
    assert one(spark, model(F.lit("abc"))) == [3.0]


def test_moments(spark):
    assert one(spark, moment(F.lit("2023/05/20 (Sat) 02:21"))) == datetime(2023, 5, 20, 2, 21)
    assert one(spark, moment(F.lit("2023-05-20"))) is None


def test_padding_never_cuts(spark):
    assert one(spark, padded(F.lit("abcdef"), 4)) == "abcdef" and one(spark, padded(F.lit("a"), 3, True)) == "  a"
