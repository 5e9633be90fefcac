"""Benchmark decontamination by a distributed positional inverted index.

Documents are packed into shards of bounded size. Each shard stores, for every
term of its texts, the sorted positions at which it occurs (the postings) as one table
row; shards never need each other, so building and searching shuffle nothing.
Texts of a shard are laid out with a gap, so that no match spans two of them.

A phrase is searched from its rarest term in the shard: those postings, adjusted
by the term's offset, are intersected with the adjusted postings of the next
rarest term, and so on until none is left or all terms agree. A proximity match starts from the rarest term too: the next rarest
must occur close by, and so on, before spans are tried. All queries that have terms left go through each step together, as arrays; a query whose rarest term (by
the queries' own counts) is absent from a shard costs one look-up there.

Queries are broadcast in blocks of at most ``BLOCK_BYTES`` of text, one block at a time; more queries mean more passes over the index.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.frames import scratch, without, written
from meridian.llm.words import ALNUM, LOWER, by_size, give_back, scan, text_buffer

SHARD_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20
GAP = 64
STEP = 1 << 16  # candidates that are tried together
INDEX = "shard string, ids {ids}, text_hashes binary, n_words binary, firsts binary, terms binary, counts binary, steps binary"
SPAN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<string>, null_item boolean, near array<string>, near_null boolean"


def _delta(sorted_values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions as differences within each term's postings."""
    steps = np.diff(sorted_values, prepend=np.int32(0))
    heads = np.cumsum(counts) - counts
    steps[heads] = sorted_values[heads]
    return steps.astype(np.int32)


def _undelta(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.int64)
    heads = np.cumsum(counts) - counts
    return total - np.repeat(total[heads] - steps[heads], counts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``docs``, one row per shard, with postings of every term.

    Words are runs of ASCII letters and digits and of all characters outside ASCII, with A-Z lower-cased. Null and
    empty texts have no words; null, tied and repeated ids are kept as they are; an empty table has no shards. Other columns are ignored.
    Shards are named by task and place, so the index has to be written before it is searched more than once.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for at, batch in enumerate(by_size(batches, "text", SHARD_BYTES)):
            data, offsets = text_buffer(batch.column("text"))
            words = scan(data, offsets, ALNUM, LOWER)
            n_words = np.diff(words.first)
            firsts = words.first[:-1] + GAP * np.arange(len(n_words))
            place = np.arange(len(words.hashes)) + np.repeat(GAP * np.arange(len(n_words)), n_words)
            order = np.argsort(words.hashes, kind="stable")
            hashes, place = words.hashes[order], place[order]
            heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(hashes))).astype(np.int32)
            steps = _delta(place.astype(np.int32), counts) if len(hashes) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([f"{task}-{at}"]), "ids": pa.array([batch.column("id").to_pylist()], pa.list_(batch.schema.field("id").type)),
                "text_hashes": pa.array([batch.column("text_hash").to_numpy().tobytes()], pa.binary()),
                "n_words": pa.array([n_words.astype(np.int32).tobytes()], pa.binary()), "firsts": pa.array([firsts.astype(np.int32).tobytes()], pa.binary()),
                "terms": pa.array([hashes[heads].tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "steps": pa.array([steps.tobytes()], pa.binary()),
            })

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(shards, INDEX.format(ids=f"array<{id_type}>"))


class Phrases(NamedTuple):
    """A block of distinct phrases: term numbers by offset (-1 past the end), the terms, and for each phrase the queries that hold it."""

    numbers: np.ndarray
    rare: np.ndarray  # the number of each phrase's rarest term
    terms: np.ndarray
    query: np.ndarray  # queries, phrase by phrase
    ends: np.ndarray  # where each phrase's queries end
    names: list


class Shard:
    """The postings of one index row; one sorted array of (term, place) answers what occurs where."""

    def __init__(self, row: dict) -> None:
        self.ids = row["ids"]
        self.text_hashes = np.frombuffer(row["text_hashes"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int32).astype(np.int64)
        self.firsts = np.frombuffer(row["firsts"], np.int32).astype(np.int64)
        self.terms, self.counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.places = _undelta(np.frombuffer(row["steps"], np.int32), self.counts) if len(self.terms) else np.zeros(0, np.int64)
        self.heads = np.cumsum(self.counts) - self.counts
        self.wide = int(self.places.max()) + 4 * GAP if len(self.places) else 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.wide + self.places

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Where the index has each term; -1 if it has not."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def next_place(self, rank: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place of each term at ``least`` or later; past all places if there is none."""
        wanted = rank * self.wide + np.maximum(least, 0)
        at = np.searchsorted(self.keys, wanted)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key // self.wide == rank), key - rank * self.wide, self.wide)

    def _by_rarity(self, phrases: Phrases, distinct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases whose terms all occur here; their ranks and offsets, rarest first (rank -1 past the end or, with ``distinct``, where a term repeats)."""
        rank = np.append(self.ranks(phrases.terms), -1)  # number -1 is no term
        alive = np.flatnonzero(rank[phrases.rare] >= 0)
        for k in range(phrases.numbers.shape[1]):
            number = phrases.numbers[alive, k]
            alive = alive[(number < 0) | (rank[number] >= 0)]
        ranks = rank[phrases.numbers[alive]]
        if distinct:
            ranks = -np.sort(-ranks, axis=1)
            ranks[:, 1:][ranks[:, 1:] == ranks[:, :-1]] = -1
        size = np.where(ranks < 0, np.iinfo(np.int64).max, self.counts[ranks]) if len(self.counts) else ranks
        order = np.argsort(size, axis=1, kind="stable")
        return alive, np.take_along_axis(ranks, order, 1), order

    def _starts(self, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and places of the postings of each row's term, some at a time."""
        total = np.concatenate([[0], np.cumsum(self.counts[rank])])
        a = 0
        while a < len(rank):
            b = max(a + 1, int(np.searchsorted(total, total[a] + STEP, "right")) - 1)
            n = self.counts[rank[a:b]]
            row = np.repeat(np.arange(a, b), n)
            yield row, self.places[np.repeat(self.heads[rank[a:b]] - (total[a:b] - total[a]), n) + np.arange(len(row))]
            a = b

    def phrases(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and the places where their terms follow each other."""
        alive, ranks, order = self._by_rarity(phrases, False)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for row, place in self._starts(ranks[:, 0]):
            start = place - order[row, 0]
            for k in range(1, ranks.shape[1]):
                rank = ranks[row, k]
                at = start + order[row, k]
                on = rank < 0
                on[~on] = self.next_place(rank[~on], at[~on]) == at[~on]
                row, start = row[on], start[on]
                if not len(row):
                    break
            out.append((alive[row], start))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def near(self, phrases: Phrases, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and starts of spans of ``within`` words that hold all their terms, in any order; a start for each place of the rarest term that has one."""
        alive, ranks, _ = self._by_rarity(phrases, True)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for row, place in self._starts(ranks[:, 0]):
            for k in range(1, ranks.shape[1]):  # each term must stand close by
                rank = ranks[row, k]
                on = rank < 0
                on[~on] = self.next_place(rank[~on], place[~on] - within + 1) < place[~on] + within
                row, place = row[on], place[on]
                if not len(row):
                    break
            for back in range(within - 1, -1, -1):  # then one span must hold them all
                if not len(row):
                    break
                start, ok = place - back, place - back >= 0
                for k in range(1, ranks.shape[1]):
                    rank = ranks[row, k]
                    test = ok & (rank >= 0)
                    ok[test] = self.next_place(rank[test], start[test]) < start[test] + within
                out.append((alive[row[ok]], start[ok]))
                row, place = row[~ok], place[~ok]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def document(self, places: np.ndarray) -> np.ndarray:
        """The row that each place lies in; the gap after a text belongs to it."""
        return np.searchsorted(self.firsts, places, "right") - 1


def phrase_block(names: list, texts: pa.Array, window: int) -> Phrases:
    """The distinct windows of the texts, and which texts hold each."""
    data, offsets = text_buffer(texts)
    words = scan(data, offsets, ALNUM, LOWER)
    terms, number, seen = np.unique(words.hashes, return_inverse=True, return_counts=True)
    size = np.diff(words.first)
    n_windows = np.where(size > 0, np.maximum(1, size - window + 1), 0)
    query = np.repeat(np.arange(len(size)), n_windows)
    begin = np.repeat(words.first[:-1] - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(len(query))
    at = begin[:, None] + np.arange(window)
    numbers = np.where(at < words.first[1:][query][:, None], number[np.minimum(at, max(0, len(number) - 1))] if len(number) else -1, -1)
    if not len(query):
        return Phrases(np.zeros((0, window), np.int32), query, terms, query, query, names)
    rows = np.column_stack([numbers, query])
    rows = rows[np.lexsort(rows.T[::-1])]  # phrase by phrase, then by query
    rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]
    last = np.concatenate([(rows[1:, :-1] != rows[:-1, :-1]).any(1), [True]])
    numbers = rows[last, :-1].astype(np.int32)
    rare = np.where(numbers < 0, np.iinfo(np.int64).max, seen[numbers]).argmin(1)
    return Phrases(numbers, numbers[np.arange(len(numbers)), rare], terms, rows[:, -1], np.flatnonzero(last) + 1, names)


def _blocks(queries: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """The phrases of the queries, in blocks of about BLOCK_BYTES of text; one block at a time is gathered."""
    rows = queries.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(size) // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for k in range(n):
        block = rows.where(F.col("block") == k).select("id", "text").distinct().toArrow()
        yield phrase_block(block.column("id").to_pylist(), block.column("text"), window)


def _runs(shard: Shard, starts: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """Maximal runs of hit words of each document."""
    spans: list[list[dict]] = [[] for _ in range(len(shard.n_words))]
    if len(starts):
        order = np.argsort(starts, kind="stable")
        starts, reach = starts[order], np.maximum.accumulate(ends[order])
        new = np.concatenate([[True], starts[1:] > reach[:-1]])
        firsts, lasts = starts[new], np.append(reach[:-1][new[1:]], reach[-1])
        for a, b, d in zip(firsts, lasts, shard.document(firsts)):
            spans[d].append({"first": int(a - shard.firsts[d]), "end": int(b - shard.firsts[d])})
    return spans


def _holders(phrases: Phrases, found: np.ndarray, document: np.ndarray, n: int) -> tuple[list[list[str]], list[bool]]:
    """The queries, by document, of phrases found in documents: sorted names, and whether one has none."""
    both = np.unique(document * len(phrases.numbers) + found) if len(found) else found
    names: list[set] = [set() for _ in range(n)]
    for d, f in zip((both // max(1, len(phrases.numbers))).tolist(), (both % max(1, len(phrases.numbers))).tolist()):
        names[d].update(phrases.names[q] for q in phrases.query[phrases.ends[f - 1] if f else 0 : phrases.ends[f]])
    return [sorted(x for x in s if x is not None) for s in names], [None in s for s in names]


def _matches(index: DataFrame, block: Phrases, within: int, hits_only: bool) -> DataFrame:
    """``shard, row, id, text_hash`` and FOUND of one block of phrases, for all documents or only those with a match."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    batch_type = to_arrow_type(index.schema["ids"].dataType.elementType)
    sent = index.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        length = (phrases.numbers >= 0).sum(1)
        for row in (row for batch in batches for row in batch.to_pylist()):
            shard = Shard(row)
            n = len(shard.n_words)
            found, start = shard.phrases(phrases) if len(shard.terms) and len(length) else (np.zeros(0, np.int64),) * 2
            items, nulls = _holders(phrases, found, shard.document(start), n)
            spans = _runs(shard, start, start + length[found])
            close, place = shard.near(phrases, within) if within and len(shard.terms) and len(length) else (np.zeros(0, np.int64),) * 2
            near, near_null = _holders(phrases, close, shard.document(place + within - 1), n)
            keep = [k for k in range(n) if not hits_only or items[k] or nulls[k] or near[k] or near_null[k]]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([row["shard"]] * len(keep), pa.string()), "row": pa.array(keep, pa.int32()), "id": pa.array([shard.ids[k] for k in keep], batch_type),
                "text_hash": pa.array(shard.text_hashes[keep]), "n_words": pa.array(shard.n_words[keep], pa.int64()), "spans": pa.array([spans[k] for k in keep], SPAN),
                "items": pa.array([items[k] for k in keep], pa.list_(pa.string())), "null_item": pa.array([nulls[k] for k in keep], pa.bool_()),
                "near": pa.array([near[k] for k in keep], pa.list_(pa.string())), "near_null": pa.array([near_null[k] for k in keep], pa.bool_()),
            })
        give_back()

    return index.mapInArrow(match, f"shard string, row int, id {id_type}, text_hash long, {FOUND}")


def _joined_runs(runs):
    """Sorted spans of several blocks as maximal runs."""
    return F.aggregate(
        F.array_sort(runs), F.array().cast("array<struct<first:int,end:int>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["first"]),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(x))),
    )


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, within: int = 0) -> DataFrame:
    """Exact phrase matches, and with ``within`` proximity matches, of every window of the queries in a written index.

    A window is ``window`` consecutive words of a query, or all words of a shorter one. Returns one row per document:
    ``id``, ``text_hash`` (xxhash64 of the text), ``n_words``, ``spans`` (maximal runs of hit words, as [first, end) pairs), ``items`` (ids, as sorted
    strings, of the queries with a window in the document), ``null_item`` (whether a query without an id has one), and ``near`` and ``near_null``: likewise the
    queries of which all different words of a window stand among ``within`` consecutive words, in any order (none without ``within``).
    Queries without words or text match nothing; of queries that agree in id and text one counts.
    """
    if max(window, within) > GAP:
        raise ValueError(f"matches of over {GAP} words could span two texts of a shard")
    earlier, last = [], None
    for block in _blocks(queries, id_col, text_col, window):
        if last is not None:
            earlier.append(written(_matches(index, last, within, True), "matches"))
        last = block
    out = _matches(index, last, within, False)
    names = [x.strip().split(" ")[0] for x in FOUND.replace("first:int,end:int", "").split(",")]
    if earlier:
        more = reduce(DataFrame.unionByName, earlier).groupBy("shard", "row").agg(
            F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"), F.max("null_item").alias("in"), F.flatten(F.collect_list("near")).alias("n"), F.max("near_null").alias("nn")
        )
        out = out.join(more, ["shard", "row"], "left")
        both = lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<string>")))
        out = out.withColumns({
            "spans": F.when(F.col("s").isNull(), F.col("spans")).otherwise(_joined_runs(F.concat("spans", F.col("s")))), "items": F.array_sort(F.array_distinct(both(F.col("items"), F.col("i")))),
            "near": F.array_sort(F.array_distinct(both(F.col("near"), F.col("n")))), "null_item": F.col("null_item") | F.coalesce("in", F.lit(False)), "near_null": F.col("near_null") | F.coalesce("nn", F.lit(False)),
        })
    return out.select("id", "text_hash", *names)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, within: int = 20) -> DataFrame:
    """Index ``docs``, search the benchmark's windows, and return one row per document as ``search`` does."""
    index = written(build_index(docs, id_col, text_col), "postings")
    return search(index, benchmark, item_col, item_text, window, within)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item; all columns are kept.

    Null and empty texts stay; rows that agree in id and text share their fate; a benchmark without words drops nothing.
    """
    with scratch(docs.sparkSession, keep="gone"):
        found = contamination(docs, benchmark, id_col, text_col, within=0).where(F.size("spans") > 0)
        return without(docs, found, id_col, text_col)


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``documents`` and ``benchmark``, and ``n_near``: items with a proximity match within 20 words."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["first"]))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), (F.size("items") + F.col("null_item").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), (F.size("near") + F.col("near_null").cast("int")).cast("long").alias("n_near"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS g, least(10, len(ws)) AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
m AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw USING (g, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id),
nb AS (SELECT DISTINCT item_id, list_sort(list_distinct(ws[i:i + 9])) AS t FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
ts AS (SELECT row_number() OVER () AS w, t FROM (SELECT DISTINCT t FROM nb)),
occ AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d),
often AS (SELECT x, count(*) AS n FROM occ GROUP BY x),
rare AS (SELECT w, arg_min(x, n) AS x FROM (SELECT w, x, n FROM (SELECT w, unnest(t) AS x FROM ts) LEFT JOIN often USING (x)) GROUP BY w HAVING count(*) = count(n)),
beside AS (SELECT w, t, p, ws[greatest(1, p - 19):p + 19] AS ws, least(p, 20) AS back, doc_id FROM rare JOIN occ USING (x) JOIN ts USING (w) JOIN d USING (doc_id) WHERE list_has_all(ws[greatest(1, p - 19):p + 19], t)),
close AS (SELECT DISTINCT doc_id, t FROM beside WHERE len(list_filter(range(1, back + 1), lambda s: list_has_all(ws[s:s + 19], t))) > 0),
nn AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, item_id FROM close JOIN nb USING (t)) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(nn.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
