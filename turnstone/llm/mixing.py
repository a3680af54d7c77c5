"""Mixing sources to target weights by hierarchical budgeting (operator 4).

Rows form a tree of domains, languages and sources.  A token budget runs down
the tree in proportion to the siblings' weights.  No node gets more than its
rows can fill in MAX_EPOCHS passes; what it can't take goes to its siblings in
proportion to their weights, and only what no sibling can take is left to the
level above, which shares it out in the same way.  Capacities are summed up the
tree first, so both happen in one pass down: each level solves
sum(min(capacity, level * weight)) = budget for the level, in closed form.

A leaf's budget is spent in epochs: whole passes first, then a prefix of a
seeded order of its rows, of another seed for each epoch.  The prefix holds the
rows whose running token count stays within the budget.  The order is cut into
4096 slices by the hash: sums of the slices tell in which one the budget ends, and
only that slice's rows are put in order, so a source with a third of all rows is
never in one task, and texts are not shuffled: the plan, a row for each leaf, is
written and joined with the rows where they are.

All of it is DataFrame operations; nothing comes to the driver.

Results on odd input: null text counts as empty (0 tokens; such rows come with
any prefix that reaches them); null language, source or domain is a branch
`(none)`; rows that repeat a doc_id are counted and chosen one by one; an empty
table gives an empty result; weights must be positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_bytes, written

LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
SHARE = 0.6
MAX_EPOCHS = 2
SEED = 42
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Four stand-in domains, fixed by the source's name, for tables that have no domain."""
    return F.concat(F.lit("domain"), F.pmod(F.ascii(F.substring(F.md5(source), 1, 1)), F.lit(4)).cast("string"))


def weight(column: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in sorted(weights.items()):
        if not w > 0:
            raise ValueError(f"weight of {name} must be positive")
        out = F.when(column == name, F.lit(float(w))).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """nodes (with cap, weight and budget, the parent's) with given, each node's part of the budget."""
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), child)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = nodes.withColumn("level", (F.col("budget") - before) / rest)
    level = F.max("level").over(Window.partitionBy(*parents))
    return levels.withColumn("given", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("level")


def budgets(leaves: DataFrame, share: float, max_epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """leaves (domain, lang, source, tokens) with tokens and budget, longs."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0))
    total = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("caps")).select(F.lit(0).alias("root"), F.least(F.floor(F.col("tokens") * share).cast("double"), F.col("caps").cast("double")).alias("budget"))
    top = fill(domains.withColumn("weight", weight(F.col("domain"), domain_weights)).join(total, "root"), ["root"], "domain").select("domain", F.col("given").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight(F.col("lang"), lang_weights))
    mid = fill(langs.join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    low = fill(leaves.withColumn("weight", weight(F.col("source"), source_weights)).join(mid, ["domain", "lang"]), ["domain", "lang"], "source")
    return low.select(*LEAF, "tokens", F.floor(F.round("given", 3)).cast("long").alias("budget"))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain_weights: dict | None = None, lang_weights: dict | None = None, source_weights: dict | None = None, domain: Column | None = None, tokens: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of docs: doc_id, domain, lang, source, n_tokens, leaf_budget and n_copies, how often the mix holds it; with keep, these columns of docs as well (under clashing names, the document's own).

    share: the budget as a share of all tokens.  tokens: each row's count; else a quarter of its bytes, rounded up."""
    none = F.lit("(none)")
    n = F.floor((text_bytes() + 3) / 4).cast("long") if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    rows = docs.select(
        F.col("doc_id"), F.coalesce(domain_of(F.col("source")) if domain is None else domain, none).alias("domain"), F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), n.alias("n_tokens"),
        *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)),
    )
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    spent = budgets(leaves, share, max_epochs, domain_weights or {}, LANG_WEIGHTS if lang_weights is None else lang_weights, source_weights or {})
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    spent = written(spent.withColumn("epochs", epochs).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("tokens"))

    def ordered(plan: DataFrame) -> DataFrame:
        return rows.join(plan, LEAF).withColumn("u", F.md5(F.concat_ws(":", F.lit(seed), "epochs", F.col("doc_id").cast("string")))).withColumn("slice", F.substring("u", 1, 3))

    sums = ordered(spent).groupBy(*LEAF, "left", "slice").agg(F.sum("n_tokens").alias("here"))
    sums = sums.withColumn("upto", F.sum("here").over(Window.partitionBy(*LEAF).orderBy("slice")))
    cuts = sums.where("upto > left").groupBy(*LEAF).agg(F.min(F.struct("slice", (F.col("upto") - F.col("here")).alias("before"))).alias("cut"))
    placed = ordered(written(spent.join(cuts, LEAF, "left").select(*LEAF, "budget", "epochs", "left", F.col("cut.slice").alias("cut"), "cut.before")))
    whole = placed.where("cut IS NULL OR slice <> cut").withColumn("more", F.coalesce(F.col("slice") < F.col("cut"), F.lit(True)))
    run = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("u", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    split = placed.where("slice = cut").withColumn("more", F.col("before") + run <= F.col("left"))
    return whole.unionByName(split).select(
        "doc_id", *LEAF, "n_tokens", F.col("budget").alias("leaf_budget"), (F.col("epochs") + F.col("more").cast("long")).cast("long").alias("n_copies"),
        *(f"kept_{i}" for i in range(len(keep))),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, each row as often as it is chosen."""
    columns = tuple(docs.columns)
    found = mix(docs, keep=columns, **options).where("n_copies > 0")
    kept = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)]
    return found.select(F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"), "*").select(*kept)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = """
WITH r AS (SELECT doc_id, coalesce('domain' || (ascii(substr(md5(source), 1, 1)) % 4), '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, ((strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 2 AS cap FROM r GROUP BY ALL),
d AS (SELECT domain, sum(cap) AS cap, 1.0::DOUBLE AS w FROM l GROUP BY domain),
d1 AS (SELECT *, ((SELECT least(floor(sum(tokens)::DOUBLE * 0.6::DOUBLE), sum(cap)) FROM l) - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM d),
d2 AS (SELECT domain, least(cap, max(lv) OVER () * w) AS b FROM d1),
g AS (SELECT domain, lang, sum(cap) AS cap, (CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM l GROUP BY domain, lang),
g1 AS (SELECT g.*, (b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM g JOIN d2 USING (domain)),
g2 AS (SELECT domain, lang, least(cap, max(lv) OVER (PARTITION BY domain) * w) AS b FROM g1),
s1 AS (SELECT l.*, (b - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / count(*) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM l JOIN g2 USING (domain, lang)),
s2 AS (SELECT domain, lang, source, tokens, floor(round(least(cap, max(lv) OVER (PARTITION BY domain, lang)), 3))::BIGINT AS budget FROM s1),
s3 AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM s2),
o AS (SELECT *, budget - epochs * tokens AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || epochs || coalesce(':' || doc_id, '')), n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM r JOIN s3 USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM o
"""
