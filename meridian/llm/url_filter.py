"""URL filters: listed rules first, then host word segmentation and naive Bayes.

Host labels are split into words by a unigram Viterbi search. Its word counts come from the visible texts of
all pages (without the names of a page's own host, or every run-together name would be a word), from the pieces of hyphenated host labels and from the topic terms.
A multinomial naive Bayes model over the segmented host words and the path tokens then judges each url. Its classes come from page
content, not from urls: a page whose visible text mentions a topic to block is an example of ``block``, any other of ``allow``.
So a host is blocked if words of its name and paths go along with such pages, whether or not they are topic terms, and a listed term in a name
does not block a host whose pages are clean. ``held_out_report`` tells what the model does for hosts that it has not learned from.

Words are counted in Spark and joined with the substrings of the distinct labels, so the search gets
only the counts it can use, and no vocabulary is sent around.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.frames import joined_by_few, written

# Rules of the contract, and the topics to block.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
TOPICS = ("ads", "adult", "bet", "bets", "casino", "escort", "gambling", "jackpot", "malware", "nude", "phishing", "pills", "poker", "porn", "sex", "spam", "torrent", "viagra", "warez", "xxx")
TOPIC_COUNT = 50  # what a topic term adds to its word count, so that the search knows it
LONGEST = 20
FOLDS = 5
SMOOTHING = 0.1  # pseudo-occurrences of a term in each class, where a host counts one
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (of equals the one with the longer host) that fits, as a struct of ``rule`` and ``verdict``, or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]))):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def visible_words(html: Column) -> Column:
    """The words (runs of a-z, lower-cased) of a page without scripts, styles, comments and tags."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")), "[^a-z]+"), lambda w: w != "")


def host_pieces(host: Column) -> Column:
    """Runs of a-z in a host: what dots, hyphens and digits cut."""
    return F.regexp_extract_all(host, F.lit("[a-z]+"), F.lit(0))


def word_counts(pages: DataFrame, hosts: DataFrame, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """``word`` (a-z, up to LONGEST letters) and ``n``: over all pages (``host``, ``html``), pieces of hyphenated labels of distinct ``hosts``, and topics."""
    own = F.filter(visible_words(F.col("html")), lambda w: (F.length(w) <= LONGEST) & ~F.array_contains(host_pieces(F.col("host")), w))
    found = pages.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    hyphened = F.filter(F.split("host", r"\."), lambda x: x.rlike("[a-z]-[a-z]"))
    named = hosts.select(F.explode(hyphened).alias("label")).select(F.explode(host_pieces(F.col("label"))).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    known = pages.sparkSession.createDataFrame([(w, TOPIC_COUNT) for w in sorted(set(topics))], "word string, n long")
    return found.unionByName(named).unionByName(known).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(text: str, counts: dict[str, int], total: float) -> list[str]:
    """The most likely split under unigram counts; an unknown word costs more with every letter."""
    best, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(text[start:end])
            p = best[start] + (math.log(n / total) if n else math.log(10 / total) - math.log(10) * (end - start))
            if p > best[end]:
                best[end], back[end] = p, start
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct ``label`` strings (a-z) with their ``words``. A label brings its substrings of up to LONGEST letters, no more."""
    total = float(counts.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()["n"])
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - i + 1)), lambda n: F.substring("label", i, n))))
    known = labels.select("label", F.explode(F.array_distinct(pieces)).alias("word")).join(counts, "word")
    known = known.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [viterbi(label, {k["word"]: k["n"] for k in known or []}, total) for label, known in zip(batch.column("label").to_pylist(), batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(known, "label", "left").mapInArrow(run, "label string, words array<string>")


def _described(pages: DataFrame, id_col: str, url_col: str, html_col: str, topics: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Urls (``__id, host, path, tokens``), and their kinds (``host, tokens, n, b, pages, host_words, terms``): ``n`` urls of the host's ``pages``, ``b`` of them with a page of block."""
    urls = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    host, path = parts(F.col("__url"))
    tokens = F.filter(F.split(F.lower("path"), "[^a-z0-9]+"), lambda t: t != "")
    tokens = F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), "#").otherwise(t))
    urls = urls.select("__id", host.alias("host"), path.alias("path"), "__html").withColumn("tokens", F.array_join(tokens, " "))
    block = F.arrays_overlap(visible_words(F.col("__html")), F.array(*[F.lit(t) for t in topics]))
    kinds = written(urls.select("host", "tokens", block.alias("block")).groupBy("host", "tokens").agg(F.count("*").alias("n"), F.count_if("block").alias("b")), "url-kinds")
    hosts = written(kinds.groupBy("host").agg(F.count("*").alias("m"), F.sum("n").alias("pages")), "hosts")
    counts = written(word_counts(urls.select("host", F.col("__html").alias("html")), hosts, topics), "word-counts")
    labels = hosts.select("host", F.posexplode(host_pieces(F.col("host"))).alias("at", "label"))
    split = labels.join(segment(labels.select("label").distinct(), counts), "label")
    split = split.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("host_words"))
    named = hosts.join(split, "host", "left").select("host", "m", "pages", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"))
    named = written(named, "host-words")
    kinds = joined_by_few(kinds, named, ["host"], "m", kinds.count())
    terms = F.concat("host_words", F.filter(F.split("tokens", " "), lambda t: t != ""))
    return urls.drop("__html"), written(kinds.withColumn("terms", terms), "url-terms")


def log_ratio(a: Column | int, b: Column | int, all_a: float, all_b: float, kinds: int) -> Column:
    """A term's smoothed weight towards block: ``a`` and ``b`` of the classes' ``all_a`` and ``all_b`` occurrences, over ``kinds`` terms."""
    return F.log((b + F.lit(SMOOTHING)) / F.lit(all_b + SMOOTHING * (kinds + 1))) - F.log((a + F.lit(SMOOTHING)) / F.lit(all_a + SMOOTHING * (kinds + 1)))


def _scored(kinds: DataFrame, folds: int = 1) -> DataFrame:
    """``kinds`` with ``log_odds`` of block, learned from all of them, or for the hosts of each of several folds from the hosts of all others.

    Every host weighs one, dealt among its pages, so that a large host doesn't speak for its top-level domain.
    """
    bad, good = F.col("b") / F.col("pages"), (F.col("n") - F.col("b")) / F.col("pages")
    kinds = kinds.withColumns({"good": good, "bad": bad}).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)) if folds > 1 else F.lit(-1).cast("long"))
    each = kinds.select("good", "bad", "fold", F.explode("terms").alias("term"))
    counts = each.groupBy("term", "fold").agg(F.sum("good").alias("a"), F.sum("bad").alias("b"), F.count("*").alias("rows"))
    counts = written(counts, "term-counts")
    sizes = counts.groupBy("fold").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("rows").alias("rows")).collect()  # a row per fold
    hosts = {r["fold"]: (r["a"], r["b"]) for r in kinds.groupBy("fold").agg(F.sum("good").alias("a"), F.sum("bad").alias("b")).collect()}
    n_terms = counts.select("term").distinct().count()
    if folds > 1:
        whole = counts.groupBy("term").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
        counts = counts.join(whole, "term").select("term", "fold", (F.col("ta") - F.col("a")).alias("a"), (F.col("tb") - F.col("b")).alias("b"), "rows")
    of = lambda values, fold: tuple(sum(v[i] for f, v in values.items() if folds == 1 or f != fold) for i in (0, 1))
    terms, weight, start = {r["fold"]: (r["a"], r["b"]) for r in sizes}, F.lit(None).cast("double"), F.lit(0.0)
    for fold in hosts:
        mine, (n_good, n_bad) = F.col("fold") == fold, of(hosts, fold)
        weight = F.when(mine, log_ratio(F.col("a"), F.col("b"), *of(terms, fold), n_terms)).otherwise(weight)
        start = F.when(mine, math.log((n_bad + 1) / (n_good + 1))).otherwise(start)
    learned = written(counts.select("term", "fold", "rows", weight.alias("w")), "term-weights")
    total = sum(r["rows"] for r in sizes) or 1
    sums = joined_by_few(kinds.select("host", "tokens", "fold", F.explode("terms").alias("term")), learned, ["term", "fold"], "rows", total)
    sums = sums.groupBy("host", "tokens").agg(F.sum("w").alias("w"))
    return kinds.join(sums, ["host", "tokens"], "left").withColumn("log_odds", F.coalesce("w", F.lit(0.0)) + start).drop("w", "fold", "good", "bad")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``host_words`` and ``log_odds`` of block.

    A rule ``site/path`` fits its site and all subdomains where the path begins alike; the longest wins, and its verdict stands. Other urls
    are blocked if the model finds block likelier. Null urls and urls without ``://`` have an empty host and path, hold no tokens and get
    the classes' prior; a null page mentions nothing; null, tied and repeated ids give a row each; an empty table gives an empty result; other columns are ignored.
    """
    urls, kinds = _described(pages, id_col, url_col, html_col, topics)
    kinds = written(_scored(kinds).select("host", "tokens", "n", "host_words", "log_odds"), "url-odds")
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first()["n"]
    out = joined_by_few(urls, kinds, ["host", "tokens"], "n", total).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "host_words", "log_odds")


def held_out_report(pages: DataFrame, url_col: str = "url", html_col: str = "html", topics: tuple[str, ...] = TOPICS, folds: int = FOLDS) -> DataFrame:
    """One row: ``pages``; ``mentions`` (pages that mention a topic) and how many of them, and of the others, the model blocks for hosts that it
    has not learned from (``caught``, ``wrong``); ``listed`` (pages whose host words hold a topic term) and ``differ`` (where that and the verdict disagree)."""
    _, kinds = _described(pages.withColumn("__page", F.lit(0)), "__page", url_col, html_col, topics)
    scored = _scored(kinds, folds)
    blocked, listed = F.col("log_odds") > 0, F.arrays_overlap("host_words", F.array(*[F.lit(t) for t in topics]))
    count = lambda on, x: F.coalesce(F.sum(F.when(on, F.col(x))), F.lit(0))
    scored = scored.withColumn("a", F.col("n") - F.col("b"))
    return scored.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.coalesce(F.sum("b"), F.lit(0)).alias("mentions"), count(blocked, "b").alias("caught"),
        count(blocked, "a").alias("wrong"), count(listed, "n").alias("listed"), count(listed != blocked, "n").alias("differ"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "host_words", "log_odds")
