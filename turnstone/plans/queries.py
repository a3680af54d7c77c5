"""The registry: each query as Spark runs it and, where SQL can say it, as the oracle does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import scoring as S
from turnstone.functions import text as T
from turnstone.functions.embedding import hashed
from turnstone.operators import catalog as C
from turnstone.operators import edus as E
from turnstone.operators import evaluate as V
from turnstone.operators import ingest as I
from turnstone.operators import keywords as K
from turnstone.operators import recall as R
from turnstone.operators import reports as P
from turnstone.operators import lookups as L
from turnstone.operators import prompts as M
from turnstone.operators import search as Q
from turnstone.operators import turns as N
from turnstone.plans import fixtures as X
from turnstone.sources import questions as B

AS_OF = X.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def at(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def question(spark: SparkSession, sf_dir: str):
    """The first vector, as the question's embedding."""
    return Q.vector(X.table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()["embedding"])


def found(rows: DataFrame) -> DataFrame:
    return rows.select("edu_id", "session_id", "project", at("ts"), *(F.round(c, 6).alias(c) for c in ("similarity", "recency_weight", "project_boost", "score")))


def search_sql(where: str, days: str, boost: str, as_of: str) -> str:
    return f"""WITH {X.VECTORS}, near AS (SELECT *, (1 + list_cosine_similarity(e, qe)) / 2 AS s FROM vecs, q WHERE {where} ORDER BY s DESC, edu_id LIMIT 30),
w AS (SELECT *, exp(-0.007 * {days.format(d=f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us(ts)) / 86400000000.0)")}) AS r, ({boost})::DOUBLE AS b FROM near)
SELECT edu_id, session_id, project, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(s, 6) AS similarity, round(r, 6) AS recency_weight, round(b, 6) AS project_boost, round(s * r * b, 6) AS score FROM w ORDER BY s * r * b DESC, edu_id LIMIT 10"""


BOOSTED = "CASE WHEN project = 'p3' THEN 1.5 ELSE 1.0 END"


@query("search_topk", search_sql("true", "{d}", BOOSTED, AS_OF))
def _(spark, d):
    return found(Q.search(X.vectors(spark, d), question(spark, d), AS_OF, current_project="p3"))


@query("search_strict_project", search_sql("project = 'p3'", "{d}", BOOSTED, AS_OF))
def _(spark, d):
    return found(Q.search(X.vectors(spark, d), question(spark, d), AS_OF, current_project="p3", strict_project="p3"))


@query("search_at_date", search_sql("true", "greatest({d}, 0)", "1.0", "2024-06-01 00:00:00"))
def _(spark, d):
    return found(Q.search(X.vectors(spark, d), question(spark, d), "2024-06-01 00:00:00", clamp=True))


@query("search_time_range", search_sql("ts >= TIMESTAMP '2024-03-01' AND ts < TIMESTAMP '2024-05-01'", "{d}", "1.0", AS_OF))
def _(spark, d):
    return found(Q.search(X.vectors(spark, d), question(spark, d), AS_OF, since="2024-03-01", until="2024-05-01"))


@query("turns_clean", f"WITH {X.TURNS} SELECT session_id, project, turn_id, speaker, text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM turns")
def _(spark, d):
    return X.turns(spark, d).select("session_id", "project", "turn_id", "speaker", "text", at("ts"))


@query("session_stats", f"""WITH {X.EDUS}, w AS (SELECT session_id, count(*) AS turns, sum(len(list_filter(string_split_regex(text, '{X.BLANK}+'), lambda x: x <> '')))::BIGINT AS words FROM turns GROUP BY session_id),
j AS (SELECT w.*, coalesce(n, 0) AS edus FROM w LEFT JOIN (SELECT session_id, count(*) AS n FROM edus GROUP BY session_id) USING (session_id))
SELECT session_id, sum(turns)::BIGINT AS turns, sum(words)::BIGINT AS words, sum(edus)::BIGINT AS edus FROM j GROUP BY GROUPING SETS ((session_id), ())""")
def _(spark, d):
    return N.session_stats(X.turns(spark, d), X.edus(spark, d))


@query("chunks_core_context", f"""WITH {X.TURNS}, s AS (SELECT session_id, turn_id, count(*) OVER (PARTITION BY session_id) AS n FROM turns),
c AS (SELECT *, unnest(range((n + 2) // 3)) AS chunk FROM s) SELECT session_id, chunk, turn_id, turn_id >= 3 * chunk AND turn_id < 3 * chunk + 3 AS is_core FROM c WHERE turn_id >= 3 * chunk - 1 AND turn_id < 3 * chunk + 4""")
def _(spark, d):
    return N.chunks(X.turns(spark, d), core=3, margin=1)


@query("chunk_counts", f"WITH {X.TURNS} SELECT session_id, count(*) AS turns, ((count(*) + 2) // 3)::BIGINT AS chunks FROM turns GROUP BY session_id")
def _(spark, d):
    return N.chunk_counts(X.turns(spark, d), core=3)


@query("chunks_legacy_overlap", f"""WITH {X.TURNS}, s AS (SELECT session_id, turn_id, count(*) OVER (PARTITION BY session_id) AS n FROM turns),
c AS (SELECT *, unnest(range(n)) AS chunk FROM s) SELECT session_id, chunk, turn_id FROM c WHERE turn_id >= 2 * chunk AND turn_id < 2 * chunk + 3 AND (chunk = 0 OR 2 * chunk + 1 < n)""")
def _(spark, d):
    return N.overlap_chunks(X.turns(spark, d), size=3, overlap=1)


@query("incremental_turns", f"WITH {X.STATE} SELECT t.session_id, t.turn_id, md5(t.text) AS text_md5 FROM turns t LEFT JOIN state s USING (session_id) WHERE t.turn_id >= coalesce(s.turn_count, 0)")
def _(spark, d):
    spoken = X.turns(spark, d)
    return N.new_turns(spoken, X.state(spark, d, spoken)).select("session_id", "turn_id", F.md5("text").alias("text_md5"))


@query("edu_extract_dedup", f"WITH {X.EDUS} SELECT session_id, edu_id, edu_seq, turn_id, tag, text FROM edus")
def _(spark, d):
    return X.edus(spark, d).select("session_id", "edu_id", "edu_seq", "turn_id", "tag", "text")


@query("edu_citation_clip", f"WITH {X.EDUS}, c AS (SELECT edu_id, turn_id // 3 AS chunk, list_filter([turn_id - 1, turn_id, turn_id + 1, 99], lambda i: i >= turn_id // 3 * 3 AND i < turn_id // 3 * 3 + 3) AS ids FROM edus) SELECT edu_id, chunk::BIGINT AS chunk, array_to_string(ids, ',') AS ids FROM c WHERE len(ids) > 0")
def _(spark, d):
    cited = X.edus(spark, d).withColumns({"chunk": F.floor(F.col("turn_id") / 3), "source_turn_ids": F.array(F.col("turn_id") - 1, F.col("turn_id"), F.col("turn_id") + 1, F.lit(99).cast("long"))})
    return E.clip_to_core(cited, 3).select("edu_id", "chunk", F.array_join(F.col("source_turn_ids").cast("array<string>"), ",").alias("ids"))


@query("edu_citation_join", f"""WITH {X.EDUS}, c AS (SELECT session_id, turn_id // 3 AS chunk, turn_id * 100 + pos AS pos, text, unnest([turn_id + 1, turn_id, turn_id - 1, 99]) AS cited, unnest([0, 1, 2, 3]) AS nth FROM lines WHERE text <> ''),
j AS (SELECT c.*, t.ts, t.speaker FROM c JOIN turns t ON t.session_id = c.session_id AND t.turn_id = c.cited WHERE cited // 3 = chunk)
SELECT session_id, chunk::BIGINT AS chunk, pos::BIGINT AS pos, min(cited) AS turn_id, string_agg(cited::VARCHAR, ',' ORDER BY nth) AS ids, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers, strftime(arg_min(ts, nth), '%Y-%m-%d %H:%M:%S') AS ts FROM j GROUP BY ALL""")
def _(spark, d):
    spoken = X.turns(spark, d)
    cites = [F.concat((F.col("turn_id") + 1).cast("string"), F.lit(".7")), F.col("turn_id").cast("string"), (F.col("turn_id") - 1).cast("string"), F.lit("none"), F.lit("99")]
    raw = E.line_facts(spoken).select("session_id", F.floor(F.col("turn_id") / 3).alias("chunk"), (F.col("turn_id") * 100 + F.col("pos")).alias("pos"), "text", F.array(*cites).alias("source_turn_ids"), F.lit("project").alias("tag"), F.lit(False).alias("failed"))
    facts = E.cited(raw, spoken, core=3)
    return facts.select("session_id", "chunk", "pos", "turn_id", F.array_join(F.col("source_turn_ids").cast("array<string>"), ",").alias("ids"), F.array_join("speakers", ",").alias("speakers"), at("ts"))


@query("ingest_two_passes", f"""WITH {X.EDUS}, l AS (SELECT *, turn_id >= 2 AS pass, row_number() OVER (PARTITION BY session_id, turn_id >= 2, lower(text) ORDER BY turn_id, pos) AS rn FROM lines WHERE text <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id, pos) - 1 AS edu_seq, sha256(concat_ws(chr(31), session_id, turn_id, text)) AS edu_id, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')) AS toks FROM l WHERE rn = 1),
b AS (SELECT *, lag(turn_id) OVER w AS pt, lag(toks) OVER w AS ptoks FROM f WINDOW w AS (PARTITION BY session_id, pass ORDER BY edu_seq)),
g AS (SELECT *, sum(CASE WHEN pt IS NULL OR (turn_id - pt <= 1 AND len(list_distinct(list_concat(ptoks, toks))) > 0 AND len(list_intersect(ptoks, toks))::DOUBLE / len(list_distinct(list_concat(ptoks, toks))) >= 0.05) THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, pass ORDER BY edu_seq) AS grp FROM b)
SELECT session_id, edu_seq, edu_id, sha256(concat_ws(chr(31), 'trajectory', session_id, first_value(edu_id) OVER (PARTITION BY session_id, pass, grp ORDER BY edu_seq))) AS trajectory_id, row_number() OVER (PARTITION BY session_id, pass, grp ORDER BY edu_seq) - 1 AS trajectory_index FROM g""")
def _(spark, d):
    spoken = X.turns(spark, d)
    first = I.process(spoken.where("turn_id < 2"), None).facts
    state = first.groupBy("session_id").agg(F.lit(2).cast("long").alias("turn_count"), F.count("*").alias("edu_count"))
    second = I.process(spoken, state).facts
    return first.unionByName(second).select("session_id", "edu_seq", "edu_id", "trajectory_id", "trajectory_index")


RAW_TAG = "CASE doc_id % 7 WHEN 0 THEN ' Decision ' WHEN 1 THEN 'GOTCHA' WHEN 2 THEN 'bogus' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'architecture' ELSE 'Config' || chr(9) END"


@query("edu_tag_coerce", f"""WITH r AS (SELECT doc_id, lower(regexp_replace({RAW_TAG}, '^{X.BLANK}+|{X.BLANK}+$', '', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN t IN ('decision', 'preference', 'gotcha', 'config', 'architecture', 'project') THEN t ELSE 'project' END AS tag FROM r""")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.coerce_tag(F.expr(RAW_TAG)).alias("tag"))


@query("boundary_pairs", f"""WITH {X.EDUS} SELECT session_id, edu_seq, prev_turn, gap, round(similarity, 6) AS similarity, CASE WHEN gap = 0 THEN 'shared' WHEN gap <= 1 THEN 'adjacent' ELSE gap || ' apart' END AS hint,
gap <= 1 AND similarity >= 0.05 AS same, greatest(0, edu_seq - 2) AS window_start, least(n, edu_seq + 3) AS window_end, edu_seq - 1 - greatest(0, edu_seq - 2) AS prev_rel FROM judged WHERE prev_turn IS NOT NULL""")
def _(spark, d):
    facts = E.boundaries(X.edus(spark, d)).where("prev_turn IS NOT NULL")
    return facts.select("session_id", "edu_seq", "prev_turn", "gap", F.round("similarity", 6).alias("similarity"), "hint", "same", "window_start", "window_end", "prev_rel")


@query("segments", f"WITH {X.EDUS} SELECT session_id, edu_seq, grp, trajectory_id, trajectory_index FROM edus")
def _(spark, d):
    return X.edus(spark, d).select("session_id", "edu_seq", "grp", "trajectory_id", "trajectory_index")


@query("trajectory_rollup", f"WITH {X.EDUS} SELECT trajectory_id, session_id, project, start_turn, end_turn, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, summary, edu_count FROM traj")
def _(spark, d):
    return E.trajectories(X.edus(spark, d)).select("trajectory_id", "session_id", "project", "start_turn", "end_turn", at("created_at"), "summary", "edu_count")


@query("keyword_normalize", f"SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^{X.BLANK}+|{X.BLANK}+$', '', 'g')), '{X.BLANK}+', '-', 'g') AS keyword FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.normalize_keyword(F.col("text")).alias("keyword"))


@query("project_names", """WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '-home-ann-' || source WHEN 1 THEN '-home-ann' WHEN 2 THEN '-srv-' || source WHEN 3 THEN 'home' ELSE '-home-ann-a-b-' || lang END AS raw FROM documents),
s AS (SELECT *, string_split(regexp_replace(raw, '^-+|-+$', '', 'g'), '-') AS p FROM r)
SELECT doc_id, CASE WHEN len(p) >= 2 AND p[1] = 'home' THEN CASE WHEN len(p) > 2 THEN array_to_string(p[3:], '-') ELSE 'home' END ELSE raw END AS project FROM s""")
def _(spark, d):
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('-home-ann-', source) WHEN 1 THEN '-home-ann' WHEN 2 THEN concat('-srv-', source) WHEN 3 THEN 'home' ELSE concat('-home-ann-a-b-', lang) END")
    return X.table(spark, d, "documents").select("doc_id", T.clean_project(raw).alias("project"))


@query("keyword_cloud", f"WITH {X.EDUS} SELECT DISTINCT project, keyword FROM pk")
def _(spark, d):
    held = X.stored(spark, d)
    return K.cloud(held.keywords, held.trajectories)


@query("keyword_frequency", f"WITH {X.EDUS} SELECT project, keyword, freq FROM freq")
def _(spark, d):
    held = X.stored(spark, d)
    return K.frequencies(held.keywords, held.trajectories)


@query("keyword_search_project", f"WITH {X.EDUS} SELECT DISTINCT trajectory_id, project FROM pk WHERE keyword IN (SELECT term FROM terms) AND project = 'p1'")
def _(spark, d):
    held = X.stored(spark, d)
    return K.find(held.keywords, held.trajectories, X.terms(held.keywords), "p1")


@query("keyword_search_global", f"WITH {X.EDUS} SELECT DISTINCT trajectory_id, project FROM pk WHERE keyword IN (SELECT term FROM terms)")
def _(spark, d):
    held = X.stored(spark, d)
    return K.find(held.keywords, held.trajectories, X.terms(held.keywords))


def two_clouds(spark, d):
    """The keywords of all other projects, and the existing ones of p0."""
    words = X.stored(spark, d).frequency
    return words.where("project <> 'p0'"), words.where("project = 'p0'")


@query("keyword_canonicalize")
def _(spark, d):
    return K.canonicalize(*two_clouds(spark, d))


LETTERS = "[" + ", ".join(f"length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz") + "]::DOUBLE[]"


@query("keyword_canonicalize_cosine", f"""WITH {X.EDUS}, raw AS (SELECT DISTINCT keyword AS raw, {LETTERS.format("keyword")} AS v FROM freq WHERE project <> 'p0'), old AS (SELECT keyword AS nearest, {LETTERS.format("keyword")} AS w FROM freq WHERE project = 'p0'),
s AS (SELECT raw, nearest, round(CASE WHEN list_sum(v) = 0 OR list_sum(w) = 0 THEN 0 ELSE list_cosine_similarity(v, w) END, 9) AS c FROM raw, old WHERE raw NOT IN (SELECT nearest FROM old)),
b AS (SELECT raw, nearest, c FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY c DESC, nearest) AS rn FROM s WHERE c >= 0.75) WHERE rn = 1)
SELECT r.raw, CASE WHEN c >= 0.9 THEN nearest ELSE r.raw END AS canonical, nearest, round(c, 6) AS similarity, CASE WHEN r.raw IN (SELECT nearest FROM old) THEN 'existing' WHEN c >= 0.9 THEN 'merged' WHEN c >= 0.75 THEN 'flagged' ELSE 'accepted' END AS status FROM raw r LEFT JOIN b USING (raw)""")
def _(spark, d):
    return K.canonicalize(*two_clouds(spark, d), edits=False).select("raw", "canonical", "nearest", F.round("similarity", 6).alias("similarity"), "status")


@query("hit_fusion", f"""WITH {X.EDUS}, qv AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings ORDER BY vec_id LIMIT 1),
num AS (SELECT edu_id, trajectory_id, project, ('0x' || substr(md5(edu_id), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS n FROM edus),
near AS (SELECT trajectory_id, project, (1 + list_cosine_similarity(embedding::DOUBLE[], qe)) / 2 AS s FROM embeddings JOIN num ON vec_id = n, qv ORDER BY s DESC, edu_id LIMIT 30),
u AS (SELECT DISTINCT trajectory_id, CASE WHEN project = 'p1' THEN 1.5 ELSE 1.0 END::DOUBLE AS score FROM pk WHERE keyword IN (SELECT term FROM terms) UNION ALL SELECT trajectory_id, s * CASE WHEN project = 'p1' THEN 1.5 ELSE 1.0 END FROM near)
SELECT trajectory_id, round(max(score), 6) AS score FROM u GROUP BY trajectory_id""")
def _(spark, d):
    return fused(spark, d).select("trajectory_id", F.round("score", 6).alias("score"))


def fused(spark, d):
    held = X.stored(spark, d)
    return R.hits(held.keywords, held.trajectories, X.terms(held.keywords), X.edu_vectors(spark, d, held.edus), question(spark, d), current_project="p1")


@query("hits_ranked", SQL["hit_fusion"].replace("SELECT trajectory_id, round(max(score), 6) AS score FROM u GROUP BY trajectory_id", ", f AS (SELECT trajectory_id, max(score) AS score FROM u GROUP BY trajectory_id) SELECT row_number() OVER (ORDER BY score DESC, trajectory_id) AS rank, trajectory_id, round(score, 6) AS score FROM f ORDER BY rank LIMIT 50"))
def _(spark, d):
    best = R.ranked(fused(spark, d)).limit(50)  # a wall takes far fewer
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "trajectory_id")).cast("long").alias("rank"), "trajectory_id", F.round("score", 6).alias("score"))


def recalled(spark, d):
    """Facts, trajectories, keywords and the neighbourhood of keyword hits."""
    held = X.stored(spark, d)
    near = R.expand(held.trajectories, K.find(held.keywords, held.trajectories, X.terms(held.keywords)))
    return held.edus, held.trajectories, held.keywords, near


@query("neighbor_expand", f"WITH {X.HITS} SELECT trajectory_id, session_id, side FROM expanded")
def _(spark, d):
    return recalled(spark, d)[3].select("trajectory_id", "session_id", "side")


@query("window_trim", f"WITH {X.HITS} SELECT edu_id, trajectory_id, side FROM trimmed")
def _(spark, d):
    facts, _, _, near = recalled(spark, d)
    return R.trim(facts, near, pad=2).select("edu_id", "trajectory_id", "side")


@query("stitch_blocks", f"WITH {X.HITS} SELECT session_id, block_no, position, edu_id, strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest FROM stitched")
def _(spark, d):
    facts, paths, _, near = recalled(spark, d)
    return R.stitch(R.trim(facts, near, pad=2), paths).select("session_id", "block_no", "position", "edu_id", at("newest"))


@query("wall_budget", f"""WITH {X.HITS}, kws AS (SELECT trajectory_id, string_agg(keyword, ', ' ORDER BY keyword) AS k FROM (SELECT DISTINCT trajectory_id, keyword FROM kw) GROUP BY trajectory_id),
shown AS (SELECT s.session_id, s.block_no, s.trajectory_id, min(position) AS position FROM stitched s GROUP BY ALL),
heads AS (SELECT h.session_id, h.block_no, strftime(min(created_at), '%Y-%m-%d') AS d0, strftime(max(created_at), '%Y-%m-%d') AS d1, string_agg('- [trajectory] ' || summary || '  (keywords: ' || coalesce(k, '') || ')', chr(10) ORDER BY position) AS ls
  FROM shown h JOIN traj t USING (trajectory_id) LEFT JOIN kws USING (trajectory_id) GROUP BY ALL),
texts AS (SELECT h.session_id, h.block_no, '### Block ' || h.block_no || ' — ' || CASE WHEN d0 = d1 THEN d0 ELSE d0 || '—' || d1 END || ' (session ' || left(h.session_id::VARCHAR, 8) || ')' || chr(10) || any_value(ls) || chr(10) || chr(10) || string_agg('- [' || tag || '] ' || text, chr(10) ORDER BY position) || chr(10) AS t
  FROM heads h JOIN stitched s ON s.session_id = h.session_id GROUP BY h.session_id, h.block_no, d0, d1),
run AS (SELECT *, sum(length(t)) OVER (ORDER BY block_no) AS running FROM texts)
SELECT session_id, block_no, md5(t) AS text_md5, length(t)::BIGINT AS chars, running::BIGINT AS running, min(CASE WHEN running <= 3500 OR block_no = 1 THEN 1 ELSE 0 END) OVER (ORDER BY block_no) = 1 AS included FROM run""")
def _(spark, d):
    facts, paths, words, near = recalled(spark, d)
    return R.wall(facts, paths, words, near, pad=2, budget_tokens=1000).select("session_id", "block_no", F.md5("text").alias("text_md5"), "chars", "running", "included")


def first_sql(where: str, order: str, extra: str = "") -> str:
    return f"""k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, lower(text) ORDER BY {order}) AS rn FROM {where}) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {order}) AS rank FROM k) SELECT project, rank, edu_id, tag{extra} FROM r WHERE rank <= 8"""


@query("project_preferences", f"WITH {X.EDUS}, p AS (SELECT * FROM edus WHERE tag = 'preference'), " + first_sql("p", "ts DESC, edu_id"))
def _(spark, d):
    return C.preferences(X.stored(spark, d).edus).select("project", "rank", "edu_id", "tag")


@query("key_decisions", f"""WITH {X.EDUS}, b AS (SELECT trajectory_id, max(coalesce(freq, 1)) AS f FROM pk LEFT JOIN freq USING (project, keyword) GROUP BY trajectory_id),
p AS (SELECT e.*, round(coalesce(f, 1) * exp(-0.007 * greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0, 0)), 9) AS score FROM edus e LEFT JOIN b USING (trajectory_id) WHERE tag IN ('decision', 'gotcha')), """ + first_sql("p", "score DESC, edu_id", ", round(score, 6) AS score"))
def _(spark, d):
    held = X.stored(spark, d)
    return C.key_decisions(held.edus, held.keywords, held.frequency, AS_OF).select("project", "rank", "edu_id", "tag", F.round("score", 6).alias("score"))


@query("recent_activity", f"WITH {X.EDUS} SELECT project, rank, trajectory_id, strftime(created_at, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, trajectory_id) AS rank FROM traj) WHERE rank <= 8")
def _(spark, d):
    return C.recent(X.stored(spark, d).trajectories).select("project", "rank", "trajectory_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("keyword_cloud_top40", f"WITH {X.EDUS} SELECT project, keyword, freq FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY freq DESC, keyword) AS rn FROM freq) WHERE rn <= 40")
def _(spark, d):
    return K.top_cloud(X.stored(spark, d).frequency)


COUNTS = """cnt AS (SELECT t.project, tags.tag, coalesce(n, 0) AS n, trajectories, t.edus, first_day, last_day FROM (
  SELECT project, count(*) AS trajectories, sum(edu_count)::BIGINT AS edus, strftime(min(created_at), '%Y-%m-%d') AS first_day, strftime(max(created_at), '%Y-%m-%d') AS last_day FROM traj GROUP BY project) t
  CROSS JOIN (VALUES ('decision'), ('gotcha'), ('architecture')) tags(tag) LEFT JOIN (SELECT project, tag, count(*) AS n FROM edus GROUP BY project, tag) c ON c.project = t.project AND c.tag = tags.tag)"""


@query("catalog_counts", f"WITH {X.EDUS}, {COUNTS} SELECT * FROM cnt")
def _(spark, d):
    held = X.stored(spark, d)
    return C.counts(held.edus, held.trajectories)


CAPPED = "cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, tag ORDER BY ts DESC, edu_id) AS rank FROM edus WHERE tag IN ('decision', 'gotcha', 'architecture', 'preference')) WHERE rank <= CASE tag WHEN 'preference' THEN 30 ELSE 80 END)"


@query("catalog_capped", f"WITH {X.EDUS}, {CAPPED} SELECT project, tag, rank, edu_id FROM cap")
def _(spark, d):
    return C.capped(X.stored(spark, d).edus).select("project", "tag", "rank", "edu_id")


def part(name: str, where: str) -> str:
    return f"{name} AS (SELECT project, string_agg(edu_id || chr(31) || text || chr(30), '' ORDER BY edu_id) AS {name} FROM cap WHERE tag = '{where}' GROUP BY project)"


@query("index_hash", f"""WITH {X.EDUS}, {CAPPED}, {COUNTS}, kws AS (SELECT trajectory_id, string_agg(keyword, ',' ORDER BY keyword) AS k FROM (SELECT DISTINCT trajectory_id, keyword FROM kw) GROUP BY trajectory_id),
ts AS (SELECT project, string_agg(trajectory_id || chr(31) || summary || chr(31) || coalesce(k, '') || chr(30), '' ORDER BY trajectory_id) AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, trajectory_id) AS rank FROM traj) LEFT JOIN kws USING (trajectory_id) WHERE rank <= 80 GROUP BY project),
{part("pp", "preference")}, {part("cd", "decision")}, {part("cg", "gotcha")}, {part("ca", "architecture")},
nn AS (SELECT project, max(n) FILTER (tag = 'decision') AS nd, max(n) FILTER (tag = 'gotcha') AS ng, max(n) FILTER (tag = 'architecture') AS na FROM cnt GROUP BY project),
ff AS (SELECT project, sha256(string_agg(slot || h, '' ORDER BY slot)) AS ff FROM (SELECT project, substr(md5(keyword), 1, 3) AS slot, sha256(string_agg(keyword || ':' || freq || chr(30), '' ORDER BY keyword)) AS h FROM freq GROUP BY ALL) GROUP BY project)
SELECT project, sha256(project || '|trajs|' || ts || '|prefs|' || coalesce(pp, '') || '|catalog|' || 'decision:' || nd || ':' || coalesce(cd, '') || 'gotcha:' || ng || ':' || coalesce(cg, '') || 'architecture:' || na || ':' || coalesce(ca, '') || '|kw|' || coalesce(ff, '')) AS input_hash
FROM ts JOIN nn USING (project) LEFT JOIN pp USING (project) LEFT JOIN cd USING (project) LEFT JOIN cg USING (project) LEFT JOIN ca USING (project) LEFT JOIN ff USING (project)""")
def _(spark, d):
    held = X.stored(spark, d)
    return C.content_hash(held.edus, held.trajectories, held.keywords, held.frequency)


PENDING = "pend AS (SELECT g.session_id, g.project, coalesce(s.turn_count, 0) AS old_turn_count, CASE WHEN g.session_id % 10 = 3 THEN 'ingesting' WHEN s.session_id IS NULL THEN 'new' ELSE 'updated' END AS status, g.n FROM sig g LEFT JOIN state s USING (session_id) WHERE s.hash IS DISTINCT FROM g.hash AND g.session_id <> 6)"


def pending(spark, d):
    spoken = X.turns(spark, d)
    sig = X.signatures(spoken)
    running = sig.where("session_id % 10 = 3").select("session_id")
    return spoken, I.pending(sig.drop("n"), X.state(spark, d, spoken), exclude=sig.where("session_id = 6").select("session_id"), in_progress=running)


@query("pending_sessions", f"WITH {X.STATE}, {PENDING} SELECT session_id, project, old_turn_count, status FROM pend")
def _(spark, d):
    return pending(spark, d)[1].select("session_id", "project", "old_turn_count", "status")


@query("pending_breakdown", f"WITH {X.STATE}, {PENDING} SELECT count(*) AS pending, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'ingesting') AS ingesting FROM pend")
def _(spark, d):
    return I.breakdown(pending(spark, d)[1])


@query("pending_table", f"WITH {X.STATE}, {PENDING} SELECT session_id, status, (n - old_turn_count)::VARCHAR AS new_turns, rpad(left(session_id::VARCHAR, 8), 10, ' ') || ' ' || rpad(left(project, 32), 34, ' ') || ' ' || lpad((n - old_turn_count)::VARCHAR, 10, ' ') || ' ' || rpad(status, 10, ' ') AS line FROM pend")
def _(spark, d):
    spoken, rows = pending(spark, d)
    return P.pending_table(rows, spoken)


@query("sessions_per_project", f"WITH {X.STATE} SELECT project, count(*) AS sessions FROM state GROUP BY project")
def _(spark, d):
    return P.per_project(X.state(spark, d, X.turns(spark, d)))


@query("delete_session", f"WITH {X.EDUS} SELECT trajectory_id, keyword FROM kw WHERE trajectory_id NOT IN (SELECT trajectory_id FROM traj WHERE session_id % 4 = 0)")
def _(spark, d):
    store = X.a_store(spark, d)
    store.delete_sessions(X.stored(spark, d).trajectories.where("session_id % 4 = 0").select("session_id").distinct())
    return store.table("trajectory_keywords").select("trajectory_id", "keyword")


@query("dedup_latest_upsert", f"WITH {X.EDUS}, new AS (SELECT trajectory_id, 'new: ' || summary AS summary, edu_count + 1 AS edu_count FROM traj WHERE session_id % 3 = 0) SELECT * FROM new UNION ALL SELECT trajectory_id, summary, edu_count FROM traj WHERE trajectory_id NOT IN (SELECT trajectory_id FROM new)")
def _(spark, d):
    store = X.a_store(spark, d)
    changed = X.stored(spark, d).trajectories.where("session_id % 3 = 0").withColumns({"summary": F.concat(F.lit("new: "), "summary"), "edu_count": F.col("edu_count") + 1})
    store.upsert("trajectories", changed, "trajectory_id")
    return store.table("trajectories").select("trajectory_id", "summary", "edu_count")


@query("turn_prompt", f"WITH {X.TURNS} SELECT session_id, md5(string_agg('[Turn ' || turn_id || '] ' || upper(speaker) || ': ' || text, chr(10) ORDER BY turn_id)) AS prompt_md5 FROM turns GROUP BY session_id")
def _(spark, d):
    return M.turn_prompt(X.turns(spark, d)).select("session_id", F.md5("prompt").alias("prompt_md5"))


@query("eval_accuracy", "SELECT lang, sum(quality)::BIGINT AS correct, count(*) AS questions, round(avg(quality), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def _(spark, d):
    joined = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return V.accuracy(joined, "lang", "quality")


@query("eval_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def _(spark, d):
    return V.stratified(X.table(spark, d, "documents"), "lang", "doc_id").select("lang", "doc_id")


@query("eval_resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return V.remaining(X.table(spark, d, "documents").select("doc_id"), X.table(spark, d, "labels").select("doc_id"), "doc_id")


@query("recall_at_k", """WITH p AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id AS id, v.label, round((1 + list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 9) AS s FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p)
SELECT query_id, max(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit, round(sum(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END)::DOUBLE / 10, 6) AS precision,
round(sum(CASE WHEN label = ql THEN 1.0::DOUBLE ELSE 0.0 END / log2(rank + 1)) / (SELECT sum(1 / log2(i + 2)) FROM range(10) t(i)), 6) AS ndcg FROM r WHERE rank <= 10 GROUP BY query_id""")
def _(spark, d):
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return V.at_k(V.neighbours(rows, rows.where("id % 20 = 0"), 10), 10)


@query("token_estimate", "SELECT doc_id, round(length(text) / 3.5, 6) AS tokens FROM documents")
def _(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.round(S.estimated_tokens(F.col("text")), 6).alias("tokens"))


# reads of stored tables


@query("edus_of_session", f"WITH {X.EDUS} SELECT session_id, edu_seq, edu_id, text FROM edus WHERE session_id = 7")
def _(spark, d):
    return L.of_session(X.stored(spark, d).edus, 7).select("session_id", "edu_seq", "edu_id", "text")


def some_paths(spark, d):
    held = X.stored(spark, d)
    return held, K.find(held.keywords, held.trajectories, X.terms(held.keywords, 1)).select("trajectory_id")


SOME = "chosen AS (SELECT DISTINCT trajectory_id FROM kw WHERE keyword = (SELECT keyword FROM kw GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 1))"


@query("edus_of_trajectories", f"WITH {X.EDUS}, {SOME} SELECT trajectory_id, trajectory_index, edu_id FROM edus WHERE trajectory_id IN (SELECT trajectory_id FROM chosen)")
def _(spark, d):
    held, ids = some_paths(spark, d)
    return L.of_trajectories(held.edus, ids).select("trajectory_id", "trajectory_index", "edu_id")


@query("trajectory_lookup", f"WITH {X.EDUS}, {SOME} SELECT t.trajectory_id, t.summary, string_agg(DISTINCT k.keyword, ',' ORDER BY k.keyword) AS keywords FROM traj t JOIN kw k USING (trajectory_id) WHERE t.trajectory_id IN (SELECT trajectory_id FROM chosen) GROUP BY ALL")
def _(spark, d):
    held, ids = some_paths(spark, d)
    return L.by_ids(held.trajectories, held.keywords, ids.unionByName(ids)).select("trajectory_id", "summary", F.array_join("keywords", ",").alias("keywords"))


@query("trajectories_of_session", f"WITH {X.EDUS} SELECT trajectory_id, start_turn, end_turn FROM traj WHERE session_id = 7")
def _(spark, d):
    return L.in_session(X.stored(spark, d).trajectories, 7).select("trajectory_id", "start_turn", "end_turn")


@query("trajectories_of_project", f"WITH {X.EDUS} SELECT trajectory_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM traj WHERE project = 'p2'")
def _(spark, d):
    return L.of_project(X.stored(spark, d).trajectories, "p2").select("trajectory_id", at("created_at"))


@query("list_projects", f"WITH {X.TURNS} SELECT DISTINCT project FROM turns")
def _(spark, d):
    return L.projects(X.stored(spark, d).trajectories)


@query("store_sizes", f"WITH {X.EDUS} SELECT (SELECT count(*) FROM edus) AS edus, (SELECT count(*) FROM traj) AS trajectories")
def _(spark, d):
    return L.sizes(X.stored(spark, d).edus, X.stored(spark, d).trajectories)


@query("dump_lines", f"WITH {X.EDUS} SELECT edu_id, '[' || project || ', ' || strftime(ts, '%Y-%m-%d') || '] ' || text AS line FROM edus")
def _(spark, d):
    return L.dump(X.stored(spark, d).edus).select("edu_id", "line")


# embedding


SLOTS = r"""toks AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS slot FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS t FROM {table})),
slots AS (SELECT {key}, slot, count(*)::DOUBLE AS n FROM toks GROUP BY ALL), norms AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM slots GROUP BY ALL)"""


@query("embed_hashed", f"WITH {X.TURNS}, {SLOTS.format(key='session_id, turn_id', table='turns')} SELECT session_id, turn_id, slot, round(n / norm, 6) AS value FROM slots JOIN norms USING (session_id, turn_id)")
def _(spark, d):
    vectors = X.turns(spark, d).select("session_id", "turn_id", F.posexplode(hashed(F.col("text"))).alias("slot", "value"))
    return vectors.where("value <> 0").select("session_id", "turn_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


QUESTION = "how do the people of this town remember the old river and its bridges"


@query("search_question", f"""WITH {X.EDUS}, {SLOTS.format(key='edu_id', table='edus')}, qt AS (SELECT ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS n FROM (SELECT unnest(string_split('{QUESTION}', ' ')) AS t) GROUP BY 1),
dots AS (SELECT edu_id, sum(slots.n * qt.n) AS dot FROM slots JOIN qt USING (slot) GROUP BY edu_id),
sims AS (SELECT e.edu_id, e.ts, (1 + coalesce(dot / (norm * (SELECT sqrt(sum(n * n)) FROM qt)), 0)) / 2 AS s FROM edus e LEFT JOIN dots USING (edu_id) LEFT JOIN norms USING (edu_id) WHERE e.project = 'p2'),
near AS (SELECT * FROM sims ORDER BY round(s, 9) DESC, edu_id LIMIT 30)
SELECT edu_id, round(s, 6) AS similarity, round(s * exp(-0.007 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0), 6) AS score FROM near ORDER BY round(s * exp(-0.007 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0), 9) DESC, edu_id LIMIT 10""")
def _(spark, d):
    asked = Q.vector(spark.range(1).select(hashed(F.lit(QUESTION)).alias("v")).first()["v"])
    facts = X.stored(spark, d).edus.withColumn("embedding", hashed(F.col("text")))
    return Q.search(facts, asked, AS_OF, strict_project="p2").select("edu_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


# prompts


@query("chunk_prompt", f"""WITH {X.TURNS}, s AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM turns), c AS (SELECT *, unnest(range((n + 2) // 3)) AS chunk FROM s),
k AS (SELECT *, turn_id >= 3 * chunk AND turn_id < 3 * chunk + 3 AS core FROM c WHERE turn_id >= 3 * chunk - 1 AND turn_id < 3 * chunk + 4),
l AS (SELECT *, lag(core) OVER (PARTITION BY session_id, chunk ORDER BY turn_id) AS was, min(core::INT) OVER (PARTITION BY session_id, chunk) <> 1 AS mixed FROM k),
b AS (SELECT session_id, chunk, project, min(turn_id) AS a, max(turn_id) AS z, count(*) AS n, min(turn_id) FILTER (core) AS ca, max(turn_id) FILTER (core) AS cz, count(*) FILTER (core) AS cn, strftime(min(ts), '%Y-%m-%d') AS day,
  string_agg(CASE WHEN mixed AND core IS DISTINCT FROM was THEN CASE WHEN core THEN '--- core: facts come from these turns only ---' ELSE '--- context: read, but take no facts from it ---' END || chr(10) ELSE '' END || '#' || turn_id || ' <' || speaker || '> ' || text, chr(10) ORDER BY turn_id) AS body FROM l GROUP BY session_id, chunk, project),
f AS (SELECT *, left(sha256(concat_ws(chr(31), session_id, chunk, body)), 8) AS fence FROM b)
SELECT session_id, chunk, md5('<<< input ' || fence || chr(10) || 'Project: ' || project || chr(10) || 'Date: ' || day || chr(10) || 'Turns ' || a || ' to ' || z || ' (' || n || '); cite no other.' || chr(10) || 'Core turns ' || ca || ' to ' || cz || ' (' || cn || ').' || chr(10) || body || chr(10) || '>>> end of input ' || fence || ' after turn ' || z) AS prompt_md5 FROM f""")
def _(spark, d):
    spoken = X.turns(spark, d)
    return M.chunk_prompt(N.chunks(spoken, core=3, margin=1), spoken).select("session_id", "chunk", F.md5("prompt").alias("prompt_md5"))


@query("incremental_prompt", f"""WITH {X.EDUS}, k AS (SELECT session_id, string_agg('- [' || tag || '] ' || text, chr(10) ORDER BY edu_seq) AS held FROM edus WHERE turn_id < 2 GROUP BY session_id),
n AS (SELECT session_id, project, string_agg('#' || turn_id || ' <' || speaker || '> ' || text, chr(10) ORDER BY turn_id) AS fresh FROM turns WHERE turn_id >= 2 GROUP BY ALL)
SELECT session_id, md5('Project: ' || project || chr(10) || 'Known facts:' || chr(10) || coalesce(held, '(none)') || chr(10) || 'New turns:' || chr(10) || fresh) AS prompt_md5 FROM n LEFT JOIN k USING (session_id)""")
def _(spark, d):
    return M.incremental_prompt(X.stored(spark, d).edus.where("turn_id < 2"), X.turns(spark, d).where("turn_id >= 2")).select("session_id", F.md5("prompt").alias("prompt_md5"))


@query("boundary_prompt", f"""WITH {X.EDUS}, w AS (SELECT e.session_id, e.edu_seq, e.turn_id, string_agg((f.edu_seq - greatest(0, e.edu_seq - 2)) || CASE f.edu_seq WHEN e.edu_seq - 1 THEN ' previous' WHEN e.edu_seq THEN ' candidate' ELSE ' context' END || ' (turns ' || f.turn_id || ') [' || f.tag || '] ' || f.text, chr(10) ORDER BY f.edu_seq) AS ls,
  max(f.turn_id) FILTER (f.edu_seq = e.edu_seq - 1) AS before FROM edus e JOIN edus f ON e.session_id = f.session_id AND f.edu_seq BETWEEN e.edu_seq - 2 AND e.edu_seq + 2 WHERE e.edu_seq > 0 GROUP BY ALL)
SELECT session_id, edu_seq, md5('Facts, oldest first:' || chr(10) || ls || chr(10) || 'Hint: ' || CASE WHEN before = turn_id THEN 'both cite turn ' || turn_id WHEN turn_id - before <= 1 THEN 'their turns are adjacent' ELSE (turn_id - before) || ' turns lie between their ends' END || chr(10) || 'Is the candidate about the same topic as the previous one?') AS prompt_md5 FROM w""")
def _(spark, d):
    return M.boundary_prompt(X.stored(spark, d).edus).select("session_id", "edu_seq", F.md5("prompt").alias("prompt_md5"))


@query("label_prompt", f"""WITH {X.EDUS}, c AS (SELECT project, string_agg(DISTINCT keyword, ', ' ORDER BY keyword) AS cloud FROM pk GROUP BY project)
SELECT trajectory_id, md5('Project: ' || project || chr(10) || 'Keywords in use: ' || cloud || chr(10) || 'Facts:' || chr(10) || string_agg((trajectory_index + 1) || '. [' || tag || '] ' || text, chr(10) ORDER BY trajectory_index)) AS prompt_md5 FROM edus JOIN c USING (project) GROUP BY trajectory_id, project, cloud""")
def _(spark, d):
    held = X.stored(spark, d)
    return M.label_digest(held.edus, K.cloud(held.keywords, held.trajectories))


# catalog as a whole


@query("index_sections", f"""WITH {X.EDUS}, b AS (SELECT trajectory_id, max(coalesce(freq, 1)) AS f FROM pk LEFT JOIN freq USING (project, keyword) GROUP BY trajectory_id),
s AS (SELECT e.*, round(coalesce(f, 1) * exp(-0.007 * greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0, 0)), 9) AS score FROM edus e LEFT JOIN b USING (trajectory_id)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, lower(text) ORDER BY ts DESC, edu_id) AS rn FROM edus WHERE tag = 'preference') WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, lower(text) ORDER BY score DESC, edu_id) AS rn FROM s WHERE tag IN ('decision', 'gotcha')) WHERE rn = 1),
w AS (SELECT project, keyword FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY freq DESC, keyword) AS rn FROM freq) WHERE rn <= 40),
u AS (SELECT project, 'preferences' AS section, row_number() OVER (PARTITION BY project ORDER BY ts DESC, edu_id) AS rank, '' AS label, text FROM p
UNION ALL SELECT project, 'recent_activity', row_number() OVER (PARTITION BY project ORDER BY created_at DESC, trajectory_id), strftime(created_at, '%Y-%m-%d'), summary FROM traj
UNION ALL SELECT project, 'key_decisions', row_number() OVER (PARTITION BY project ORDER BY score DESC, edu_id), tag, text FROM k
UNION ALL SELECT project, 'keyword_cloud', row_number() OVER (PARTITION BY project ORDER BY keyword), '', keyword FROM w)
SELECT * FROM u WHERE section = 'keyword_cloud' OR rank <= 8""")
def _(spark, d):
    held = X.stored(spark, d)
    return C.sections(held.edus, held.trajectories, held.keywords, held.frequency, AS_OF)


@query("index_markdown")
def _(spark, d):
    held = X.stored(spark, d)
    return C.fitted(C.sections(held.edus, held.trajectories, held.keywords, held.frequency, AS_OF))


def facts_part(tag: str) -> str:
    n = "" if tag == "preference" else f" || ' (' || coalesce((SELECT n FROM cnt WHERE cnt.project = g.project AND tag = '{tag}'), 0) || ' in all)'"
    return f"""'Facts tagged {tag}'{n} || ':' || chr(10) || coalesce((SELECT string_agg('- ' || strftime(ts, '%Y-%m-%d') || ' ' || text || ' {{' || coalesce(k, '') || '}} id ' || edu_id, chr(10) ORDER BY rank) FROM cap LEFT JOIN kws USING (trajectory_id) WHERE cap.project = g.project AND tag = '{tag}'), '(none)')"""


@query("curator_prompt", f"""WITH {X.EDUS}, {CAPPED}, {COUNTS}, kws AS (SELECT trajectory_id, string_agg(keyword, ', ' ORDER BY keyword) AS k FROM (SELECT DISTINCT trajectory_id, keyword FROM kw) GROUP BY trajectory_id),
g AS (SELECT DISTINCT project, trajectories, edus, first_day, last_day FROM cnt),
ws AS (SELECT project, string_agg(keyword || ' (' || freq || ')', ', ' ORDER BY freq DESC, keyword) AS w FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY freq DESC, keyword) AS rn FROM freq) WHERE rn <= 500 GROUP BY project),
ts AS (SELECT project, string_agg(rank || '. ' || strftime(created_at, '%Y-%m-%d') || ' ' || summary || ' {{' || coalesce(k, '') || '}} ' || edu_count || ' facts, id ' || trajectory_id, chr(10) ORDER BY rank) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, trajectory_id) AS rank FROM traj) LEFT JOIN kws USING (trajectory_id) WHERE rank <= 80 GROUP BY project)
SELECT g.project, md5('Project ' || g.project || ': ' || trajectories || ' trajectories, ' || edus || ' facts, ' || first_day || ' to ' || last_day || chr(10) || chr(10) || 'Keywords: ' || w || chr(10) || chr(10) || 'Trajectories:' || chr(10) || t || chr(10) || chr(10) || {" || chr(10) || chr(10) || ".join(facts_part(t) for t in ["preference", *C.TAGS])}) AS prompt_md5
FROM g JOIN ws USING (project) JOIN ts USING (project)""")
def _(spark, d):
    held = X.stored(spark, d)
    return C.curator_prompt(C.gathered(held.edus, held.trajectories, held.keywords, held.frequency)).select("project", F.md5("prompt").alias("prompt_md5"))


# reports


@query("session_report", f"""WITH {X.EDUS}, w AS (SELECT session_id, project, min(ts) AS first, count(*) AS turns, sum(len(list_filter(string_split_regex(text, '{X.BLANK}+'), lambda x: x <> '')))::BIGINT AS words FROM turns WHERE project = 'p3' GROUP BY ALL),
j AS (SELECT w.*, coalesce(n, 0) AS edus, CASE WHEN session_id % 4 = 3 THEN 'yes' ELSE '' END AS partial FROM w LEFT JOIN (SELECT session_id, count(*) AS n FROM edus GROUP BY session_id) USING (session_id)),
a AS (SELECT session_id, project, strftime(first, '%Y-%m-%d') AS day, turns, words, edus, partial FROM j UNION ALL SELECT NULL, NULL, NULL, sum(turns)::BIGINT, sum(words)::BIGINT, sum(edus)::BIGINT, NULL FROM j)
SELECT *, rtrim(rpad(coalesce(day, 'total'), 10, ' ') || ' ' || rpad(coalesce(project, ''), 24, ' ') || ' ' || rpad(left(coalesce(session_id::VARCHAR, ''), 8), 8, ' ') || ' ' || lpad(turns::VARCHAR, 6, ' ') || ' ' || lpad(format('{{:,}}', words), 10, ' ') || ' ' || lpad(edus::VARCHAR, 6, ' ') || ' ' || coalesce(partial, '')) AS line FROM a""")
def _(spark, d):
    spoken = X.turns(spark, d)
    state = spoken.select("session_id").distinct().withColumn("partial", F.col("session_id") % 4 == 3)
    return P.session_rows(spoken, X.stored(spark, d).edus, state, "p3", "words")


@query("reset_targets", f"WITH {X.STATE} SELECT session_id FROM state WHERE starts_with(session_id::VARCHAR, '1') UNION SELECT session_id FROM state WHERE project = 'p2' UNION SELECT session_id FROM state WHERE session_id % 11 = 0")
def _(spark, d):
    state = X.state(spark, d, X.turns(spark, d)).withColumn("partial", F.col("session_id") % 11 == 0)
    chosen = I.reset_targets(state, prefix="1").unionByName(I.reset_targets(state, project="p2")).unionByName(I.reset_targets(state, partial=True))
    return chosen.distinct()


@query("pending_workload", f"""WITH {X.STATE}, {PENDING}, c AS (SELECT (count(*) + 2) // 3 AS c FROM turns t JOIN pend p USING (session_id) WHERE t.turn_id >= p.old_turn_count GROUP BY session_id)
SELECT count(*) AS sessions, coalesce(sum(c), 0)::BIGINT AS chunks, greatest(1, coalesce(sum(c), 0) * 30 // 60)::BIGINT AS minutes FROM c""")
def _(spark, d):
    spoken, rows = pending(spark, d)
    return P.workload(rows, spoken, core=3)


# evaluation source


def asked(spark, d):
    """Questions from the benchmark's items, each with the conversations of its number modulo 10 in its haystack."""
    message = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    talks = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    stacks = talks.groupBy((F.col("conv_id") % 10).alias("n")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "messages"))).alias("s"))
    items = X.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), (F.col("item_id") % 10).alias("n"))
    dates = F.transform("s", lambda x: F.when(x["conv_id"] % 3 == 0, F.lit("soon")).otherwise(F.concat(F.lit("2024/01/"), F.lpad((x["conv_id"] % 28 + 1).cast("string"), 2, "0"), F.lit(" (Mon) 10:05"))))
    return items.join(stacks, "n").select("question_id", F.transform("s", lambda x: x["messages"]).alias("haystack_sessions"), dates.alias("haystack_dates"))


HAYSTACK = """talks AS (SELECT conv_id, count(*) AS turns, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id),
h AS (SELECT item_id::VARCHAR AS question_id, conv_id, turns, messages, row_number() OVER (PARTITION BY item_id ORDER BY conv_id) - 1 AS position FROM benchmark JOIN talks ON item_id % 10 = conv_id % 10)"""


@query("eval_haystack", f"WITH {HAYSTACK} SELECT question_id, position, left(sha256(to_json(messages)::VARCHAR), 16) AS session_key, CASE WHEN conv_id % 3 <> 0 THEN '2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:05:00' END AS started FROM h")
def _(spark, d):
    return B.sessions_of(asked(spark, d)).select("question_id", "position", "session_key", at("started"))


@query("eval_sizes", f"WITH {HAYSTACK}, o AS (SELECT max(turns) AS t FROM h GROUP BY sha256(to_json(messages)::VARCHAR)) SELECT count(DISTINCT question_id) AS questions, count(*) AS sessions, (SELECT count(*) FROM o) AS distinct_sessions, (SELECT sum(t)::BIGINT FROM o) AS turns FROM h")
def _(spark, d):
    return B.sizes(B.sessions_of(asked(spark, d)))


@query("eval_cache_join", f"WITH {HAYSTACK} SELECT question_id, position, conv_id || ': ' || turns AS text FROM h WHERE conv_id % 2 = 0 UNION ALL SELECT question_id, position, 'to do' FROM h WHERE conv_id % 2 = 1")
def _(spark, d):
    sessions = B.sessions_of(asked(spark, d))
    talks = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    keyed = talks.select("conv_id", B.content_key(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("session_key"), F.size("m").alias("n"))
    cache = keyed.where("conv_id % 2 = 0").select("session_key", F.concat_ws(": ", "conv_id", "n").alias("text"))
    return B.facts_of(sessions, cache).select("question_id", "position", "text").unionByName(B.uncached(sessions, cache).select("question_id", "position", F.lit("to do").alias("text")))
