"""Quality rules: per-document rules, then verdicts on whole hosts.

Only built-in functions: no Python runs on the executors. Rule failures are
summed by host (partial aggregates, so a host with a third of all rows costs one
row per task), failure rates are shrunk towards a beta prior whose parameters
come from all hosts by the method of moments, and the host verdicts are joined
back to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.frames import written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
STRONGEST_PRIOR = 1e6  # pseudo-documents, where hosts do not differ


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts that the rules read, one row per document: ``__id, __host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    A repeated word lies in a five-word window that the text holds twice or more. Windows are
    compared by 64-bit hashes, within one text only. Null texts count as empty.
    """
    at = lambda array, k: F.get(array, k)
    text = F.col("__text")
    out = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = out.select("*", F.array_remove(F.split(text, SPACE), "").alias("__words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("__lines"))
    words = F.col("__words")
    out = out.select(
        "__id", "__host",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[at(words, i + k) for k in range(5)]))).alias("__grams"),
    )
    grams = F.col("__grams")
    out = out.withColumn("__sorted", F.when(F.size(grams) > F.size(F.array_distinct(grams)), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    pairs = F.col("__sorted")
    twice = F.filter(F.transform(pairs, lambda x, k: F.when((x["g"] == at(pairs, k - 1)["g"]) | (x["g"] == at(pairs, k + 1)["g"]), x["i"])), lambda i: i.isNotNull())
    out = out.withColumn("__twice", F.sort_array(twice)).drop("__sorted", "__grams")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate("__twice", zero, lambda s, i: F.struct((i + 5).alias("end"), (s["total"] + i + 5 - F.greatest(s["end"], i)).alias("total")), lambda s: s["total"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__twice")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``host_rate`` and ``kept``.

    A document fails with fewer than ``min_words`` words or more than ``max_repeat_percent`` per cent
    repeated words. ``host_rate`` is its host's failure rate, shrunk by the beta prior; ``kept`` is false
    if the document failed or its host's rate is over ``max_host_rate``. Rows without a host get no host
    verdict. Null texts have no words and fail; null, tied and repeated ids give a row each; an empty table
    gives an empty result; other columns are ignored.
    """
    counts = rule_counts(docs, id_col, text_col, host_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = written(counts.withColumn("base_failed", failed), "rule-counts")
    hosts = counts.where(F.col("__host").isNotNull()).groupBy("__host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("f"))
    prior = hosts.agg(F.avg(F.col("f") / F.col("n")).alias("mean"), F.var_samp(F.col("f") / F.col("n")).alias("var")).first()
    mean, var = prior["mean"] or 0.0, prior["var"] or 0.0
    strength = STRONGEST_PRIOR if var <= 0 else min(STRONGEST_PRIOR, max(1.0, mean * (1 - mean) / var - 1))
    rates = hosts.select("__host", ((F.col("f") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))).alias("host_rate"))
    out = counts.join(rates, "__host", "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_host_rate)
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``documents``."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rate")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM j WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(f / n) AS mean, coalesce(var_samp(f / n), 0) AS var FROM h),
p AS (SELECT mean, CASE WHEN var <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, mean * (1 - mean) / var - 1)) END AS s FROM m),
r AS (SELECT source, (f + (SELECT mean * s FROM p)) / (n + (SELECT s FROM p)) AS rate FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM j LEFT JOIN r USING (source)
"""
