"""Operator 2: line dedup by winnowing over line hashes. DataFrame functions only.

Lines are trimmed; blank ones take no part. A gram is the shortest run of whole lines from a line on that has at least
GRAM words (its hash covers the lines in order, so equal grams are equal runs). Among the grams that start within
MIN_WORDS - GRAM words after a line the smallest hash is selected, the later of equals, so any run of lines that
repeats with MIN_WORDS words or more has a gram selected in both places, and nothing shorter than GRAM words ever matches.

Documents that share a selected gram are candidates; no other can hold a repeat. In these every shortest run of whole lines
of MIN_WORDS words or more, from a line on and up to a line, is hashed, and runs are joined by hash with their first place
(smallest doc_id, then line): a run in very many documents costs a row a place, never pairs. A run that is not the
first is deleted. Any longer repeat is the union of such runs, so exactly the lines in a run of MIN_WORDS words or more that
also stands at some earlier place go, whichever documents hold its parts first. The first place always stays.

Defined results: null and empty texts have no lines and stay as they are; rows with a null doc_id take no part and stay
as they are; rows of one doc_id and different texts are documents of their own, equal rows are one and are all cleaned alike; an
empty table gives an empty result; other columns play no part; a document may repeat itself, and its later run goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import stored

MIN_WORDS, GRAM = 50, 25
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\x0b\x0c\r"
DOC = ["doc_id", "tx"]


def _h(column: Column) -> Column:
    """60 bits of the MD5."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, 15), 16, 10).cast("long")


def _row_keys(docs: DataFrame) -> list[Column]:
    """A document is its doc_id and the hash of its text, so other texts under one id stay apart."""
    return [F.col("doc_id").cast("long").alias("doc_id"), _h(F.col("text")).alias("tx")]


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tx, line, n, at, nth, h): number of the line, its words, words before it, its place among the lines, its hash."""
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(*_row_keys(docs), "text")
    each = whole.select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("line", "body")).withColumn("body", F.btrim("body", F.lit(SPACE)))
    each = each.select(*DOC, "line", F.regexp_count("body", F.lit(WORD)).cast("long").alias("n"), _h(F.col("body")).alias("h")).where("n > 0")
    upto = Window.partitionBy(*DOC).orderBy("line")
    once = each.withColumn("last", F.lag("line").over(upto)).where("last IS NULL OR last <> line").drop("last")  # repeated rows
    return once.withColumn("at", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("nth", F.row_number().over(upto))


def fingerprints(rows: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, tx, nth, g): the selected grams."""
    by_words = Window.partitionBy(*DOC).orderBy("at")
    within = by_words.rangeBetween(0, gram - 1)
    grams = (
        rows.withColumn("run", F.collect_list("h").over(within))
        .withColumn("words", F.sum("n").over(within))
        .where(F.col("words") >= gram)
        .select(*DOC, "nth", "at", _h(F.array_join(F.transform("run", lambda x: x.cast("string")), ",")).alias("g"))
    )
    least = F.min(F.struct("g", (-F.col("nth")).alias("later"))).over(by_words.rangeBetween(0, max(0, min_words - gram)))
    return grams.select(*DOC, least.alias("m")).select(*DOC, (-F.col("m.later")).alias("nth"), F.col("m.g").alias("g")).distinct()


def shortest_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tx, nth, size, g): place, number of lines and hash of each shortest run with min_words, from a line on and up to a line."""
    by = Window.partitionBy(*DOC)
    onward = by.orderBy("at").rangeBetween(0, min_words - 1)
    back = by.orderBy("end").rangeBetween(1 - min_words, 0)
    each = rows.withColumn("end", F.col("at") + F.col("n"))
    for side, within in (("onward", onward), ("back", back)):
        each = each.withColumn(side, F.collect_list("h").over(within)).withColumn(f"{side}_words", F.sum("n").over(within))
    run = lambda side, nth: F.when(F.col(f"{side}_words") >= min_words, F.struct(nth.alias("nth"), F.size(side).alias("size"), F.col(side).alias("run")))
    both = F.array(run("onward", F.col("nth")), run("back", F.col("nth") - F.size("back") + 1))
    runs = each.select(*DOC, F.explode(both).alias("r")).where("r IS NOT NULL")
    return runs.select(*DOC, "r.nth", "r.size", _h(F.array_join(F.transform("r.run", lambda x: x.cast("string")), ",")).alias("g")).distinct()


def every_repeat(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, tx, line, n) of every line to delete."""
    if not 1 <= gram <= min_words:
        raise ValueError("1 <= gram <= min_words")
    rows = stored(lines(docs), "line-hashes")
    chosen = stored(fingerprints(rows, min_words, gram), "line-prints")
    shared = chosen.groupBy("g").agg(F.count("*").alias("places")).where("places > 1").select("g")
    candidates = chosen.join(shared, "g", "left_semi").select(*DOC).distinct()
    runs = stored(shortest_runs(rows.join(candidates, DOC, "left_semi"), min_words), "line-runs")
    first = runs.groupBy("g").agg(F.min(F.struct(*DOC, "nth")).alias("first"), F.count("*").alias("places")).where("places > 1")
    later = runs.join(first, "g").where(F.struct(*DOC, "nth") != F.col("first"))
    gone = later.select(*DOC, F.explode(F.sequence("nth", F.col("nth") + F.col("size") - 1)).alias("nth")).distinct()
    return rows.join(gone, [*DOC, "nth"]).select(*DOC, "line", "n")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, text, clean_text, n_lines, n_removed and n_removed_words of every row."""
    gone = every_repeat(docs, min_words, gram).groupBy(*DOC).agg(F.collect_list("line").alias("gone"), F.sum("n").alias("gone_words"))
    joined = docs.select(*_row_keys(docs), "text").join(gone, DOC, "left")
    # array_except hashes, so the cost is linear in lines however many go.
    joined = joined.withColumn("lines", F.split("text", "\n", -1))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    return joined.select(
        "doc_id",
        "text",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("clean_text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("gone_words", F.lit(0)).cast("long").alias("n_removed_words"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", "n_removed_words", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def _h_sql(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


ORACLE_SQL = f"""
WITH whole AS (SELECT doc_id, text, {_h_sql('text')} tx FROM documents),
split_up AS (SELECT doc_id, tx, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) body
    FROM (SELECT DISTINCT doc_id, tx, text FROM whole WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
counted AS (SELECT doc_id, tx, line, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) n, {_h_sql('body')} h FROM split_up),
rows_ AS (SELECT *, CAST(sum(n) OVER w - n AS BIGINT) ahead, row_number() OVER w nth FROM counted WHERE n > 0 WINDOW w AS (PARTITION BY doc_id, tx ORDER BY line)),
grams AS (SELECT doc_id, tx, nth, ahead, {_h_sql("array_to_string(run, ',')")} g FROM
    (SELECT *, list(h) OVER w run, sum(n) OVER w words FROM rows_ WINDOW w AS (PARTITION BY doc_id, tx ORDER BY ahead RANGE BETWEEN CURRENT ROW AND {GRAM - 1} FOLLOWING)) WHERE words >= {GRAM}),
chosen AS (SELECT DISTINCT doc_id, tx, -(m.later) AS nth, m.g g FROM
    (SELECT doc_id, tx, min({{'g': g, 'later': -nth}}) OVER (PARTITION BY doc_id, tx ORDER BY ahead RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - GRAM} FOLLOWING) m FROM grams)),
shared AS (SELECT DISTINCT doc_id, tx FROM chosen WHERE g IN (SELECT g FROM chosen GROUP BY g HAVING count(*) > 1)),
both_ways AS (SELECT *, list(h) OVER onward run_on, sum(n) OVER onward words_on, list(h) OVER back run_back, sum(n) OVER back words_back FROM rows_ SEMI JOIN shared USING (doc_id, tx)
    WINDOW onward AS (PARTITION BY doc_id, tx ORDER BY ahead RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING), back AS (PARTITION BY doc_id, tx ORDER BY ahead + n RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
runs AS (SELECT doc_id, tx, nth, len(run_on) size, {_h_sql("array_to_string(run_on, ',')")} g FROM both_ways WHERE words_on >= {MIN_WORDS}
    UNION SELECT doc_id, tx, nth - len(run_back) + 1, len(run_back), {_h_sql("array_to_string(run_back, ',')")} FROM both_ways WHERE words_back >= {MIN_WORDS}),
firsts AS (SELECT g, min({{'doc_id': doc_id, 'tx': tx, 'nth': nth}}) f FROM runs GROUP BY g HAVING count(*) > 1),
places AS (SELECT DISTINCT doc_id, tx, unnest(generate_series(nth, nth + size - 1)) nth FROM runs JOIN firsts USING (g) WHERE (doc_id, tx, nth) <> (f.doc_id, f.tx, f.nth)),
gone AS (SELECT doc_id, tx, line, n FROM rows_ JOIN places USING (doc_id, tx, nth)),
per_doc AS (SELECT doc_id, tx, list(line) lines, count(*) n_removed, sum(n) words FROM gone GROUP BY ALL)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) n_lines, coalesce(n_removed, 0) n_removed, CAST(coalesce(words, 0) AS BIGINT) n_removed_words,
    md5(CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda z: NOT list_contains(lines, z[2])), lambda z: z[1]), chr(10)) END) clean_md5
FROM whole LEFT JOIN per_doc USING (doc_id, tx)
"""
