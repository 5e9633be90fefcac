"""Substring dedup: fixed-length word windows that occur more than once are cut out.

Rows are packed where they are into batches of bounded size, written as a table with compressed texts. Each batch hashes
all its word windows (Rabin-Karp, 96 bits from two independent bases), folds equal ones and sends the sorted
hashes, as blocks of bytes, to buckets that split the hash range evenly. A bucket
counts its hashes and answers each block with one bit per hash. Batches turn the
bits into removal intervals. A window, copied document, repeated row or passage that fills
a third of the corpus thus costs each bucket one entry per batch, not one per
occurrence; rows are dealt by place, not by content, and no pairs are formed.

There is a block for each batch and bucket that share a hash, so there are never more blocks than distinct windows of batches: their number
grows with batches times buckets until a block holds one hash (about 400,000 batches, some 1.6 TB), and in proportion to the input from there on.

Two different windows share a 96-bit hash with a chance of about n*n / 2**97 over n windows: 2e-10 for the 5e9 of 30 GB, 0.003 for
the 2e13 of 100 TB. Words are compared through the same pair of bases, as 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.frames import small_batches, text_bytes, written
from meridian.llm.words import by_size, give_back, rolling, scan, text_buffer, whole_runs

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
LEVEL = 9  # of the texts' compression: they are written once and shuffled once


class Windows:
    """Each text's first word in a batch, the words at which its windows start, its distinct windows in order of their hash pairs, and which of them each window is."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, n_buckets: int) -> None:
        words = scan(data, offsets, both=True)
        self.first, n = words.first, len(words.hashes)
        self.at = np.flatnonzero(whole_runs(self.first, window, n))
        high = rolling(np.ascontiguousarray(words.hashes[:, 0]), window, 0)[self.at]
        low = (rolling(np.ascontiguousarray(words.hashes[:, 1]), window, 1) >> np.uint64(32)).astype(np.uint32)[self.at]
        del words
        order = ordered(high, low)
        high, low = high[order], low[order]
        new = differ(high, low)
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.high, self.low = high[heads], low[heads]
        self.twice = np.diff(np.append(heads, len(order))) > 1
        bucket = bucket_of(self.high, n_buckets)
        self.full, first = np.unique(bucket, return_index=True)
        self.cuts = np.append(first, len(bucket))


def ordered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """An order of hash pairs in which equal ones stand together."""
    order = np.argsort(high, kind="stable")
    h, l = high[order], low[order]  # noqa: E741
    return np.lexsort((low, high)) if ((h[1:] == h[:-1]) & (l[1:] != l[:-1])).any() else order


def differ(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """True where a pair is not that before it."""
    return np.concatenate([np.ones(min(1, len(high)), bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1])])


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Even ranges of the hashes' upper 32 bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of six bytes each where they fit, else of eight; the first byte tells."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    head, tail = steps[:1], steps[1:]
    if len(tail) and int(tail.max()) >> 48:
        return b"\x08" + steps.tobytes()
    return b"\x06" + head.tobytes() + tail.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(block: bytes) -> np.ndarray:
    if block[:1] == b"\x08":
        return np.cumsum(np.frombuffer(block, np.uint64, offset=1))
    tail = np.frombuffer(block, np.uint8, offset=9).reshape(-1, 6)
    steps = np.zeros((len(tail) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(block, np.uint8, 8, offset=1)
    steps[1:, :6] = tail
    return np.cumsum(steps.view(np.uint64).ravel())


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as a written table of batches: ``batch`` (task and place), ``ids``, ``sizes`` (bytes of each text) and ``texts`` (compressed together, ``n`` bytes)."""
    kind = docs.schema[id_col].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, codec = TaskContext.get().partitionId(), pa.Codec("zstd", compression_level=LEVEL)
        for place, batch in enumerate(gathered(batches)):
            data, offsets = text_buffer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                pa.array([(task << 32) + place], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(to_arrow_type(kind))), pa.array([np.diff(offsets).astype(np.int64).tobytes()], pa.binary()),
                pa.array([len(data)], pa.int64()), pa.array([codec.compress(data.tobytes(), asbytes=True)], pa.binary()),
            ], ["batch", "ids", "sizes", "n", "texts"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(pack, f"batch long, ids array<{kind.simpleString()}>, sizes binary, n long, texts binary"), "batches")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in tables of about BATCH_BYTES of text; a longer text comes alone or ends its table."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in by_size(batches, "text", BATCH_BYTES // 4):
        held.append(batch)
        size += int(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _texts(batch: pa.Table | pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a batch's texts."""
    raw = pa.decompress(batch.column("texts")[row].as_buffer(), batch.column("n")[row].as_py(), "zstd") if batch.column("n")[row].as_py() else b""
    sizes = np.frombuffer(batch.column("sizes")[row].as_buffer(), np.int64)
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Cut every word that lies in a window of ``window`` words whose word sequence also starts elsewhere.

    Words are runs of anything but ASCII white space. Returns one row per input row: ``id_col``,
    ``n_words``, ``n_removed``, ``removed`` (maximal removal intervals, as [first word, end word) pairs)
    and ``kept_text`` (the kept words, joined by one space). Windows are judged on the input. Null and
    empty texts have no words and stay empty; null, tied and repeated ids are allowed, and a repeated
    row counts as a second copy; an empty table gives an empty result; other columns are ignored.
    """
    n_buckets = max(1, -(-text_bytes(docs, text_col) // BUCKET_BYTES))
    id_type = docs.schema[id_col].dataType
    batches = packed(docs, id_col, text_col)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in range(batch.num_rows):
                found = Windows(*_texts(batch, row), window, n_buckets)
                parts = [slice(a, b) for a, b in zip(found.cuts[:-1], found.cuts[1:])]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(found.full, pa.int32()), "batch": pa.array([batch.column("batch")[row].as_py()] * len(parts), pa.int64()), "high": pa.array([_pack(found.high[x]) for x in parts], pa.binary()),
                    "low": pa.array([found.low[x].tobytes() for x in parts], pa.binary()), "twice": pa.array([np.packbits(found.twice[x]).tobytes() for x in parts], pa.binary()),
                })

    def count(bucket: pa.Table) -> pa.Table:
        blocks = [_unpack(x) for x in bucket.column("high").to_pylist()]
        sizes = [len(x) for x in blocks]
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in bucket.column("low")])
        local = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(bucket.column("twice").to_pylist(), sizes)]
        high, found = np.concatenate(blocks), np.concatenate(local)
        order = ordered(high, low)
        same = ~differ(high[order], low[order])[1:]
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        parts = np.split(found, np.cumsum(sizes)[:-1])
        keep = [i for i, x in enumerate(parts) if x.any()]
        return pa.table({"batch": bucket.column("batch").take(pa.array(keep, pa.int64())), "bucket": bucket.column("bucket").take(pa.array(keep, pa.int64())), "bits": pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary())})

    def cut(batch: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = _texts(batch, 0)
        found = Windows(data, offsets, window, n_buckets)
        first, repeated = found.first, np.zeros(len(found.high), bool)
        place = {int(b): k for k, b in enumerate(found.full)}
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            a, b = found.cuts[place[bucket]], found.cuts[place[bucket] + 1]
            repeated[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        starts = found.at[repeated[found.inverse]]
        depth = np.zeros(int(first[-1]) + 1, np.int32)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        n_words, n_removed = np.diff(first), before[first[1:]] - before[first[:-1]]
        del found, starts, depth, repeated
        raw, kept, spans = data.tobytes(), [], []
        for d in range(len(n_words)):
            parts = raw[offsets[d] : offsets[d + 1]].split()
            if n_removed[d]:
                mask = gone[first[d] : first[d + 1]].astype(np.int8)
                turns = np.flatnonzero(np.diff(mask, prepend=0, append=0))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])])
                parts = [x for x, m in zip(parts, mask) if not m]
            else:
                spans.append([])
            kept.append(b" ".join(parts))
        give_back()
        return pa.table({
            id_col: pa.array(batch.column("ids")[0].as_py(), to_arrow_type(id_type)), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    blocks = batches.mapInArrow(send, "bucket int, batch long, high binary, low binary, twice binary")
    with small_batches(docs.sparkSession):
        answers = written(blocks.groupBy("bucket").applyInArrow(count, "batch long, bucket int, bits binary"), "repeated")
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, f"`{id_col}` {id_type.simpleString()}, n_words long, n_removed long, removed array<struct<first:int,end:int>>, kept_text string")


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = remove_repeats(docs, window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
