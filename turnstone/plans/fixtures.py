"""The store's tables derived from the driver's, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import edus as E
from turnstone.operators import keywords as K
from turnstone.operators import turns as N
from turnstone.sources.scratch import fresh, written
from turnstone.sources.store import Store

AS_OF = "2025-01-01 00:00:00"
BLANK = T.BLANK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"), F.col("role").alias("speaker"), "turn", "text",
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(conv_id as int), cast(turn as int), 0)").alias("ts"),
    )
    return N.number_turns(raw, "turn").drop("turn")


def tagged(edus: DataFrame) -> DataFrame:
    """A stand-in tag by the text's length."""
    return edus.withColumn("tag", F.get(F.array(*map(F.lit, T.TAGS)), (F.length("text") % 6).cast("int")))


def edus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in their trajectories, computed from conversations."""
    facts = tagged(E.dedup_facts(E.line_facts(turns(spark, sf_dir))))
    return E.segment(E.boundaries(facts)).select("session_id", "project", "ts", "turn_id", "pos", "text", "source_turn_ids", "speakers", "edu_seq", "edu_id", "tag", "grp", "trajectory_id", "trajectory_index")


class Tables:
    """What an ingest leaves in the store, for the queries that read it; each table is written when one first does."""

    def __init__(self, facts: DataFrame):
        self.edus = written(facts)

    @cached_property
    def trajectories(self) -> DataFrame:
        return written(E.trajectories(self.edus))

    @cached_property
    def keywords(self) -> DataFrame:
        return written(E.trajectory_keywords(self.edus))

    @cached_property
    def frequency(self) -> DataFrame:
        return written(K.frequencies(self.keywords, self.trajectories))


HELD: dict[tuple[str, str], Tables] = {}


def stored(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables, written once a session and data folder: recall and catalogs read what ingestion wrote."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in HELD:
        HELD[key] = Tables(edus(spark, sf_dir))
    return HELD[key]


def a_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store of its own with these tables."""
    held, store = stored(spark, sf_dir), Store(spark, fresh(spark))
    with store.commit() as change:
        change.append("edus", held.edus)
        change.append("trajectories", held.trajectories)
        change.append("trajectory_keywords", K.of_projects(held.keywords, held.trajectories))
    return store


def terms(keywords: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent keywords, as search terms."""
    return keywords.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(most).select(F.col("keyword").alias("term"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as facts with vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("edu_id"), (F.col("vec_id") % 50).alias("session_id"), F.concat(F.lit("p"), (F.col("label") % 5).cast("string")).alias("project"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(vec_id % 300 as int), 0, 0, 0)").alias("ts"), "embedding",
    )


def edu_vectors(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    """Each fact with one of the vectors, by a hash of its id."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = F.lit(given.count())
    place = F.pmod(F.conv(F.substring(F.md5("edu_id"), 1, 8), 16, 10).cast("long"), n)
    return facts.select("edu_id", "trajectory_id", "project", place.alias("vec_id")).join(given, "vec_id").drop("vec_id")


def state(spark: SparkSession, sf_dir: str, spoken: DataFrame) -> DataFrame:
    """An ingestion state: two thirds of the sessions, some with an older hash."""
    now = signatures(spoken)
    known = now.where("session_id % 3 <> 0")
    return known.select("session_id", "project", F.when(F.col("session_id") % 7 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"), F.greatest(F.col("n") - 2, F.lit(1)).cast("long").alias("turn_count"))


def signatures(spoken: DataFrame) -> DataFrame:
    """A hash of each session's texts in place of its file's."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "text"))), lambda x: x["text"]), "\n")
    return spoken.groupBy("session_id", "project").agg(F.md5(joined).alias("hash"), F.count("*").alias("n"))


TURNS = rf"""turns AS (
  SELECT conv_id AS session_id, 'p' || (conv_id % 5) AS project, role AS speaker, regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') AS text,
    TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_id
  FROM conversations WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') <> '')"""
EDUS = rf"""{TURNS}, lines AS (
  SELECT session_id, project, ts, turn_id, speaker, generate_subscripts(ls, 1) - 1 AS pos, regexp_replace(unnest(ls), '^{BLANK}+|{BLANK}+$', '', 'g') AS text
  FROM (SELECT *, string_split_regex(text, '\r\n|\r|\n') AS ls FROM turns)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, lower(text) ORDER BY turn_id, pos) AS rn FROM lines WHERE text <> '') WHERE rn = 1),
facts AS (
  SELECT session_id, project, ts, turn_id, pos, text, row_number() OVER (PARTITION BY session_id ORDER BY turn_id, pos) - 1 AS edu_seq, sha256(concat_ws(chr(31), session_id, turn_id, text)) AS edu_id, speaker,
    (['decision', 'preference', 'gotcha', 'config', 'architecture', 'project'])[length(text) % 6 + 1] AS tag, regexp_extract_all(lower(text), '\p{{L}}+') AS toks FROM firsts),
judged AS (
  SELECT *, turn_id - prev_turn AS gap, CASE WHEN len(list_distinct(list_concat(prev_toks, toks))) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(prev_toks), list_distinct(toks)))::DOUBLE / len(list_distinct(list_concat(prev_toks, toks))) END AS similarity
  FROM (SELECT *, lag(turn_id) OVER o AS prev_turn, lag(toks) OVER o AS prev_toks, count(*) OVER (PARTITION BY session_id) AS n FROM facts WINDOW o AS (PARTITION BY session_id ORDER BY edu_seq))),
grouped AS (SELECT *, (sum(CASE WHEN prev_turn IS NULL OR (gap <= 1 AND similarity >= 0.05) THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY edu_seq))::BIGINT AS grp FROM judged),
edus AS (
  SELECT session_id, project, ts, turn_id, pos, text, edu_seq, edu_id, tag, grp, toks, sha256(concat_ws(chr(31), 'trajectory', session_id, first_value(edu_id) OVER (PARTITION BY session_id, grp ORDER BY edu_seq))) AS trajectory_id, row_number() OVER (PARTITION BY session_id, grp ORDER BY edu_seq) - 1 AS trajectory_index FROM grouped),
traj AS (
  SELECT trajectory_id, session_id, project, min(turn_id) AS start_turn, max(turn_id) AS end_turn, min(ts) AS created_at, left(arg_min(text, edu_seq), 120) AS summary, count(*) AS edu_count
  FROM edus GROUP BY trajectory_id, session_id, project),
kw1 AS (SELECT trajectory_id, keyword FROM (
  SELECT trajectory_id, keyword, row_number() OVER (PARTITION BY trajectory_id ORDER BY count(*) DESC, keyword) AS rn
  FROM (SELECT trajectory_id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) AS keyword FROM edus) GROUP BY trajectory_id, keyword) WHERE rn <= 3),
kw AS (SELECT * FROM kw1 UNION ALL SELECT DISTINCT trajectory_id, 'uncategorized' FROM edus WHERE trajectory_id NOT IN (SELECT trajectory_id FROM kw1)),
pk AS (SELECT project, trajectory_id, keyword FROM kw JOIN traj USING (trajectory_id)),
freq AS (SELECT project, keyword, count(DISTINCT trajectory_id) AS freq FROM pk GROUP BY project, keyword),
terms AS (SELECT keyword AS term FROM kw GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 3)"""
VECTORS = """vecs AS (SELECT vec_id AS edu_id, vec_id % 50 AS session_id, 'p' || (label % 5) AS project, TIMESTAMP '2024-01-01' + to_days((vec_id % 300)::INTEGER) AS ts, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings ORDER BY vec_id LIMIT 1)"""
HITS = EDUS + """, hit AS (SELECT DISTINCT trajectory_id FROM kw WHERE keyword IN (SELECT term FROM terms)),
around AS (SELECT t.*, h.trajectory_id IS NOT NULL AS hit, coalesce(lead(h.trajectory_id IS NOT NULL) OVER o, false) AS before, coalesce(lag(h.trajectory_id IS NOT NULL) OVER o, false) AS after
  FROM traj t LEFT JOIN hit h USING (trajectory_id) WINDOW o AS (PARTITION BY t.session_id ORDER BY t.start_turn, t.trajectory_id)),
expanded AS (SELECT trajectory_id, session_id, project, start_turn, end_turn, created_at, summary, CASE WHEN hit THEN 'hit' WHEN before THEN 'prev' ELSE 'next' END AS side FROM around WHERE hit OR before OR after),
trimmed AS (SELECT * FROM (
  SELECT e.*, x.start_turn, x.side, row_number() OVER (PARTITION BY e.trajectory_id ORDER BY trajectory_index) AS f, row_number() OVER (PARTITION BY e.trajectory_id ORDER BY trajectory_index DESC) AS l FROM edus e JOIN expanded x USING (trajectory_id))
  WHERE side = 'hit' OR (side = 'prev' AND l <= 2) OR (side = 'next' AND f <= 2)),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_turn, trajectory_id, trajectory_index) AS position FROM trimmed),
block_order AS (SELECT session_id, max(created_at) AS newest, row_number() OVER (ORDER BY max(created_at) DESC, session_id) AS block_no FROM (SELECT DISTINCT p.session_id, t.created_at FROM placed p JOIN traj t USING (trajectory_id)) GROUP BY session_id),
stitched AS (SELECT p.*, newest, block_no FROM placed p JOIN block_order USING (session_id))"""
STATE = TURNS + """, sig AS (SELECT session_id, project, md5(string_agg(text, chr(10) ORDER BY turn_id)) AS hash, count(*) AS n FROM turns GROUP BY session_id, project),
state AS (SELECT session_id, project, CASE WHEN session_id % 7 = 0 THEN 'old' ELSE hash END AS hash, greatest(n - 2, 1) AS turn_count FROM sig WHERE session_id % 3 <> 0)"""
