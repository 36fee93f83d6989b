"""Operator 9: mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

A token budget is propagated down a tree of domains, languages and sources. The children of a node share its budget by their
weights; none gets more than its supply, which is its tokens times `max_epochs`. What a child cannot take goes to its
siblings by their weights, and only what a whole subtree cannot take reaches the siblings of its ancestors (a node's
cap is the sum of its leaves' supplies, 0 where a weight on the way is 0, so its parent never gives it more). Each leaf then reads its documents in
seeded epochs: allotment div supply whole ones, and of the next the longest prefix that fits into the
rest, in the order of md5(seed:epoch:doc_id), then doc_id, then length.

Prefix sums are two-level: tokens are summed by leaf and leading hash digits first, so a source with a third of
all rows is never ordered in one task. Shares are integers, rounded down.

Defined results: null domains, languages and sources are leaves of their own; null and empty texts have no tokens and
come along where the prefix passes them; rows with null doc_ids share one place in the order; repeated rows count as often as
they stand; an empty table gives an empty result; weights not named are 1, and a weight of 0 leaves a node out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import stored

LEVELS = ("domain", "lang", "source")
SHARE, MAX_EPOCHS, SEED = 0.5, 3, "mix-1"
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {}}
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: str = "source") -> Column:
    """Default domains: the number that ends a source's name, modulo 4."""
    return F.concat(F.lit("domain"), F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) AS bigint)") % 4, F.lit(0)).cast("string"))


def _weight(level: str, weights: dict) -> Column:
    column = F.lit(1)
    for value, w in sorted(weights.get(level, {}).items()):
        if w < 0 or w != int(w):
            raise ValueError(f"weights are whole numbers from 0: {level} {value} {w}")
        column = F.when(F.col(level) == value, F.lit(int(w))).otherwise(column)
    return column.cast("long")


def _share_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes have parent columns, level, supply, cap (of it, what weights let the leaves take), w and the parent's `budget`; adds `alloc`."""
    nodes = nodes.withColumn("w", F.greatest(F.col("w"), F.lit(1).cast("long")))
    every = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("cap") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    nodes = (
        nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), zero))
        .withColumn("w_all", F.sum("w").over(every))
        .withColumn("full", F.col("cap") * (F.col("w_all") - F.col("w_before")) <= F.col("w") * (F.col("budget") - F.col("cap_before")))
    )
    nodes = nodes.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(every)).withColumn("w_full", F.sum(F.when(F.col("full"), F.col("w")).otherwise(zero)).over(every))
    part = F.expr("(w * (budget - cap_full)) div nullif(w_all - w_full, 0)")
    return nodes.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part)).select(*parent, level, "supply", "alloc")


def allotments(tokens: DataFrame, weights: dict, share: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, alloc of each leaf, for rows (domain, lang, source, n_tokens)."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("supply", F.col("tokens") * max_epochs)
    open_ = F.lit(True)
    for level in LEVELS:
        open_ = open_ & (_weight(level, weights) > 0)
    leaves = leaves.withColumn("cap", F.when(open_, F.col("supply")).otherwise(0))
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long").alias("budget"))
    up, known = [], total
    for depth, level in enumerate(LEVELS):
        parent, keys = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        if depth:
            above = known.select(*(F.col(k).alias(f"up_{k}") for k in parent), F.col("alloc").alias("budget"))
            cond = F.lit(True)
            for k in parent:
                cond = cond & F.col(k).eqNullSafe(F.col(f"up_{k}"))
            nodes = nodes.join(above, cond).drop(*(f"up_{k}" for k in parent))
        else:
            nodes = nodes.join(F.broadcast(total))  # one row
        known = _share_out(nodes, parent, level)
    return known.withColumn("tokens", F.expr(f"supply div {int(max_epochs)}")).select(*LEVELS, "tokens", "alloc")


def last_places(chosen: DataFrame) -> DataFrame:
    """For rows of `mix` with their place: each leaf's whole epochs and where its prefix ends (null: nowhere)."""
    inside = F.when(F.col("n_epochs") > F.col("whole"), F.col("place"))
    return chosen.groupBy(*LEVELS).agg(F.max("whole").alias("whole"), F.max(inside).alias("last"))


def place_of(whole: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), whole.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def chosen_rows(docs: DataFrame, weights: dict | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, domain: Column | None = None) -> DataFrame:
    """The rows of docs that `mix` reads at least once, rows of one doc_id together.

    The choice is a condition on a row's place and its leaf's last one, so texts are filtered where they lie
    against a table of a row a leaf, which Spark broadcasts if its measured size allows.
    """
    domain = domain_of() if domain is None else domain
    ends = stored(last_places(mix(docs, weights, share, max_epochs, seed, domain, places=True)), "mix-last")
    ends = ends.select(*(F.col(k).alias(f"__leaf_{k}") for k in LEVELS), F.col("whole").alias("__whole"), F.col("last").alias("__last"))
    here = domain.eqNullSafe(F.col("__leaf_domain")) & F.col("lang").eqNullSafe(F.col("__leaf_lang")) & F.col("source").eqNullSafe(F.col("__leaf_source"))
    met = docs.join(ends, here)
    return met.where((F.col("__whole") > 0) | (place_of(F.col("__whole"), seed) <= F.col("__last"))).select(*docs.columns)


def mix(docs: DataFrame, weights: dict | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, domain: Column | None = None, places: bool = False) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and n_epochs (times it is read, 1 or more) of the documents chosen."""
    weights = WEIGHTS if weights is None else weights
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tokens = stored(docs.select("doc_id", (domain_of() if domain is None else domain).alias("domain"), F.col("lang"), F.col("source"), n_tokens.alias("n_tokens")), "mix-tokens")
    leaves = stored(allotments(tokens, weights, share, max_epochs), "mix-leaves")
    plan = leaves.where("tokens > 0 AND alloc > 0").selectExpr(*(f"{k} AS leaf_{k}" for k in LEVELS), "alloc div tokens AS whole", "alloc % tokens AS rest")
    cond = F.lit(True)
    for k in LEVELS:
        cond = cond & F.col(k).eqNullSafe(F.col(f"leaf_{k}"))
    placed = tokens.join(plan, cond).drop(*(f"leaf_{k}" for k in LEVELS)).withColumn("place", place_of(F.col("whole"), seed)).withColumn("digits", F.substring("place", 1, DIGITS))
    group = [*LEVELS, "digits"]
    sums = placed.groupBy(*group).agg(F.sum("n_tokens").alias("in_group"))
    ahead = Window.partitionBy(*LEVELS).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_group").over(ahead), F.lit(0).cast("long"))).select(*(F.col(k).alias(f"at_{k}") for k in group), "ahead")
    cond = F.lit(True)
    for k in group:
        cond = cond & F.col(k).eqNullSafe(F.col(f"at_{k}"))
    inside = Window.partitionBy(*group).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.join(sums, cond).withColumn("end", F.col("ahead") + F.sum("n_tokens").over(inside))
    n_epochs = F.col("whole") + F.when((F.col("end") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    return ends.withColumn("n_epochs", n_epochs.cast("long")).where("n_epochs > 0").select("doc_id", *LEVELS, "n_tokens", "n_epochs", *(["whole", "place"] * places))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(level: str) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"


def _level_sql(depth: int) -> str:
    keys, parent, level = ", ".join(LEVELS[: depth + 1]), ", ".join(f"n.{k}" for k in LEVELS[:depth]), LEVELS[depth]
    over = f"PARTITION BY {parent}" if depth else ""
    on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM u.{k}" for k in LEVELS[:depth]) or "true"
    up = f"a{depth - 1} u" if depth else "(SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) alloc FROM leaves) u"
    return f"""n{depth} AS (SELECT {keys}, CAST(sum(supply) AS BIGINT) supply, CAST({_case(level)} AS BIGINT) w FROM leaves GROUP BY {keys}),
b{depth} AS (SELECT n.*, u.alloc budget,
    coalesce(CAST(sum(n.supply) OVER ({over} ORDER BY n.supply / n.w, n.{level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) cap_before,
    coalesce(CAST(sum(n.w) OVER ({over} ORDER BY n.supply / n.w, n.{level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) w_before,
    CAST(sum(n.w) OVER ({over}) AS BIGINT) w_all
  FROM n{depth} n JOIN {up} ON {on}),
c{depth} AS (SELECT *, supply * (w_all - w_before) <= w * (budget - cap_before) AS filled FROM b{depth} n),
a{depth} AS (SELECT {keys}, supply, CASE WHEN filled THEN supply ELSE (w * (budget - CAST(sum(CASE WHEN filled THEN supply ELSE 0 END) OVER ({over}) AS BIGINT)))
    // nullif(w_all - CAST(sum(CASE WHEN filled THEN w ELSE 0 END) OVER ({over}) AS BIGINT), 0) END alloc FROM c{depth} n)"""


ORACLE_SQL = f"""
WITH tokens AS (SELECT doc_id, 'domain' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4, 0) AS domain, lang, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) supply FROM tokens GROUP BY ALL),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
plan AS (SELECT domain, lang, source, alloc // (supply // {MAX_EPOCHS}) whole, alloc % (supply // {MAX_EPOCHS}) rest FROM a2 WHERE supply > 0 AND alloc > 0),
placed AS (SELECT t.*, p.whole, p.rest, md5('{SEED}:' || p.whole || ':' || coalesce(CAST(t.doc_id AS VARCHAR), '')) place FROM tokens t JOIN plan p
    ON t.domain IS NOT DISTINCT FROM p.domain AND t.lang IS NOT DISTINCT FROM p.lang AND t.source IS NOT DISTINCT FROM p.source),
ends AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) fin FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN fin <= rest AND rest > 0 THEN 1 ELSE 0 END AS BIGINT) n_epochs
FROM ends WHERE whole + CASE WHEN fin <= rest AND rest > 0 THEN 1 ELSE 0 END > 0
"""
