"""Token-id files: a static range asymmetric numeral system over interleaved lanes.

A file holds consecutive documents. One frequency table, counted over all of the
file's ids, is shared by its blocks. A block holds up to ``LANES * STEPS`` ids dealt
over ``LANES`` coder states whose words are interleaved in decoding order; its entry
in the block index (the checkpoint) gives its first id, its byte range and a CRC-32
of its bytes, so that any block decodes and is verified alone, in parallel.

Layout, all integers little-endian:

    4 bytes   magic "MTS1"
    u32 x 5   documents, blocks, symbols, scale bits, length of the id column
    u64       ids in the file
    u32[]     ids of each document
    u32[]     symbols, ascending          u32[]  their frequencies (sum 2**scale bits)
    u64[]     blocks: offset in the body  u32[]  CRC-32 of each block
    bytes     id column (Arrow IPC)       u32    CRC-32 of all of the above
    bytes     body: per block u64[LANES] final states, then u32[] words
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.bpe import byte_alphabet
from meridian.llm.frames import text_bytes, written
from meridian.llm.words import by_size, byte_table, scan, text_buffer

LANES, STEPS, SCALE = 2048, 256, 20
LOW = np.uint64(1 << 31)
MAGIC = b"MTS1"
FILE_BYTES = 4 << 20
RANGE_BYTES = 24 << 20
CACHE_PARTS = 1_500_000
BATCH_PARTS = 4096
BREAK = "\v"  # between parts that are cut together


class FileError(ValueError):
    """A token file is damaged."""


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols in use and frequencies of at least one that sum to 2**SCALE."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError("too many symbols for the frequency table")
    scaled = np.maximum(1, counts * (1 << SCALE) // counts.sum())
    excess = int(scaled.sum()) - (1 << SCALE)
    if excess < 0:
        scaled[np.argmax(scaled)] -= excess
    for k in np.argsort(-scaled, kind="stable") if excess > 0 else ():
        cut = min(excess, int(scaled[k]) // 2)
        scaled[k] -= cut
        excess -= cut
        if not excess:
            break
    return symbols.astype(np.uint32), scaled.astype(np.uint32)


def _encode_blocks(rank: np.ndarray, frequency: np.ndarray) -> list[bytes]:
    """All blocks of a file, side by side. Lane l of a block holds its ids l, l + LANES, ..."""
    per = LANES * STEPS
    n_blocks = -(-len(rank) // per)
    padded = np.full(n_blocks * per, -1, np.int64)
    padded[: len(rank)] = rank
    grid = padded.reshape(n_blocks, STEPS, LANES)
    f, c = frequency.astype(np.uint64), (np.cumsum(frequency) - frequency).astype(np.uint64)
    state, words, owners = np.full((n_blocks, LANES), LOW), [], []
    for step in range(STEPS - 1, -1, -1):
        symbol = grid[:, step]
        b, lane = np.nonzero(symbol >= 0)
        if not len(b):
            continue
        s = symbol[b, lane]
        x, fs = state[b, lane], f[s]
        over = x >= fs << np.uint64(63 - SCALE)
        words.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        owners.append(b[over])
        x[over] >>= np.uint64(32)
        q = x // fs
        state[b, lane] = (q << np.uint64(SCALE)) + (x - q * fs) + c[s]
    word, owner = (np.concatenate([np.zeros(0, t), *reversed(p)]) for p, t in ((words, "<u4"), (owners, np.int64)))
    word = word[np.argsort(owner, kind="stable")].astype("<u4")
    ends = np.cumsum(np.bincount(owner, minlength=n_blocks)) if n_blocks else np.zeros(0, np.int64)
    return [state[k].astype("<u8").tobytes() + word[a:b].tobytes() for k, (a, b) in enumerate(zip(np.concatenate([[0], ends]), ends))]


def _decode_blocks(blocks: list[bytes], sizes: list[int], symbols: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    if not blocks:
        return np.zeros(0, np.uint32)
    rank_of = np.repeat(np.arange(len(symbols), dtype=np.uint32), frequency)
    f, c = frequency.astype(np.uint64), (np.cumsum(frequency) - frequency).astype(np.uint64)
    head = 8 * LANES
    state = np.stack([np.frombuffer(x, "<u8", LANES) for x in blocks]).astype(np.uint64)
    stream = [np.frombuffer(x, "<u4", offset=head) for x in blocks]
    base = np.cumsum([0, *map(len, stream)])[:-1].astype(np.int64)
    words, at = np.append(np.concatenate(stream), np.uint32(0)).astype(np.uint64), base.copy()
    n, out = np.array(sizes, np.int64), np.zeros((len(blocks), STEPS, LANES), np.uint32)
    mask, lanes = np.uint64((1 << SCALE) - 1), np.arange(LANES)
    for step in range(STEPS):
        live = step * LANES + lanes < n[:, None]
        if not live.any():
            break
        slot = state & mask
        rank = rank_of[slot]
        out[:, step] = rank
        x = f[rank] * (state >> np.uint64(SCALE)) + slot - c[rank]
        need = live & (x < LOW)
        order = at[:, None] + np.cumsum(need, axis=1) - 1
        x = np.where(need, (x << np.uint64(32)) | words[np.where(need, order, 0)], x)
        at += need.sum(1)
        state = np.where(live, x, state)
    if (state != LOW).any() or (at - base != [len(x) for x in stream]).any():
        raise FileError("a block does not decode to its start state")
    return symbols[np.concatenate([out[k].reshape(-1)[:m] for k, m in enumerate(sizes)])]


def pack(documents: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One file: ``ids`` (unsigned 32 bits) of consecutive documents with these lengths."""
    symbols, frequency = _frequencies(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    rank = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, np.int64)
    rank[symbols] = np.arange(len(symbols))
    blocks = _encode_blocks(rank[ids], frequency)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", documents.type)])) as out:
        out.write_batch(pa.record_batch([documents], ["id"]))
    names = sink.getvalue().to_pybytes()
    offsets = np.cumsum([0, *map(len, blocks)])
    head = MAGIC + struct.pack("<5IQ", len(lengths), len(blocks), len(symbols), SCALE, len(names), len(ids))
    head += lengths.astype("<u4").tobytes() + symbols.astype("<u4").tobytes() + frequency.astype("<u4").tobytes()
    head += offsets.astype("<u8").tobytes() + np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes() + names
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


class TokenFile:
    """A parsed file: its documents, their lengths, and its blocks, decoded on demand."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise FileError("not a token file")
        n_docs, n_blocks, n_symbols, scale, n_names, self.n_ids = struct.unpack_from("<5IQ", raw, 4)
        at = 4 + struct.calcsize("<5IQ")

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            at += n * int(kind[2])
            return np.frombuffer(raw, kind, n, at - n * int(kind[2]))

        if scale != SCALE:
            raise FileError("unknown scale")
        self.lengths, self.symbols, self.frequency = take(n_docs, "<u4").astype(np.int64), take(n_symbols, "<u4"), take(n_symbols, "<u4")
        self.offsets, self.checks = take(n_blocks + 1, "<u8").astype(np.int64), take(n_blocks, "<u4")
        names = raw[at : at + n_names]
        at += n_names
        if zlib.crc32(raw[:at]) != struct.unpack_from("<I", raw, at)[0]:
            raise FileError("the header's checksum differs")
        self.documents = pa.ipc.open_stream(names).read_all().column("id").combine_chunks()
        self.raw, self.body = raw, at + 4

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of blocks ``first`` to ``end``, verified."""
        chosen = range(first, len(self.checks) if end is None else end)
        blocks = [self.raw[self.body + self.offsets[k] : self.body + self.offsets[k + 1]] for k in chosen]
        for k, block in zip(chosen, blocks):
            if zlib.crc32(block) != self.checks[k]:
                raise FileError(f"the checksum of block {k} differs")
        sizes = [min(LANES * STEPS, self.n_ids - k * LANES * STEPS) for k in chosen]
        return _decode_blocks(blocks, sizes, self.symbols, self.frequency)


class PartEncoder:
    """The tokenizers library's ids of whole texts; parts between single spaces are encoded once and kept.

    A byte-level piece takes one space before it and never runs over a later one, so a text without
    neighbouring white space may be cut before each space. Other texts go to the library whole.
    Parts are known by 64-bit hashes; they are forgotten when there are CACHE_PARTS of them.
    """

    #: Runs of anything but a space.
    PART = byte_table(b" ")
    #: The byte-level pieces of texts below U+0250; the second for ASCII.
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
    HEAD = np.uint64(0xA0761D6478BD642F)  # marks a text's first part, which no space precedes

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.beside = re.compile(r" (?:\s|$)|\s ")
        self.ascii_space, self.lead = np.zeros(256, bool), np.zeros(256, bool)
        self.ascii_space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        self.lead[[0xE1, 0xE2, 0xE3]] = True  # of the three-byte characters that include white space
        self.merger = Tokenizer(self.library.model)  # the same merges, on pieces that are cut already
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.sizes = np.zeros(max(self.library.get_vocab().values()) + 1, np.int64)
        for token, k in self.library.get_vocab().items():
            self.sizes[k] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for a in range(0, len(texts), 1024) for e in self.library.encode_batch_fast(texts[a : a + 1024], add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        """Whether the patterns cut a part, or several with BREAK around each, as the library does, and no special token is in it."""
        return text.replace(BREAK, "").replace("\n", "").isprintable() and "<" not in text and "\n" + BREAK not in text and BREAK + "\n" not in text and max(text) < "\u0250"

    def _cut(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain parts: cut into pieces by the file's pattern here; the library merges the distinct pieces."""
        text = " " + (BREAK + " ").join(parts)
        pieces = (self.ASCII if text.isascii() else self.PIECE).findall(text)
        number: dict[str, int] = {}
        order = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        line = order == number.get(BREAK, -1)
        words = "\0".join(number).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
        ids = np.array(self.merger.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        # a piece's ids end where their letters fill it
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(list(map(len, words)))) + 1
        first = np.concatenate([[0], ends[:-1]])
        lengths = np.where(line, 0, (ends - first)[order])
        total = np.concatenate([[0], np.cumsum(lengths)])
        flat = ids[np.arange(total[-1]) - np.repeat(total[:-1] - first[order], lengths)]
        return flat, np.diff(np.concatenate([[0], total[np.flatnonzero(line)], [total[-1]]]))

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that follow a space, and how many each has."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(parts), BATCH_PARTS):
            some = parts[a : a + BATCH_PARTS]
            joined = BREAK.join(["", *some, ""])
            plain = [True] * len(some) if self._plain(joined) and joined.count(BREAK) == len(some) + 1 else [self._plain(BREAK + p + BREAK) and BREAK not in p for p in some]
            if all(plain):
                ids, sizes = self._cut(some)
            else:
                ids, sizes = self._cut([p for p, ok in zip(some, plain) if ok]) if any(plain) else (flat[0], lengths[0])
                cut, whole = iter(np.split(ids, np.cumsum(sizes)[:-1])), iter(self._whole([" " + p for p, ok in zip(some, plain) if not ok]))
                each = [next(cut) if ok else next(whole) for ok in plain]
                ids, sizes = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            flat.append(ids)
            lengths.append(sizes)
        return np.concatenate(flat), np.concatenate(lengths)

    def _uncut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts with a space beside white space or at the end, and perhaps a few others."""
        near = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
        at = np.flatnonzero(data == 32)
        after, before = near[at + 4], near[at + 2]
        odd = self.ascii_space[after] | self.lead[after] | (after == 0xC2) | self.ascii_space[before] | (near[at + 1] == 0xC2) | self.lead[near[at]]
        end = np.zeros(len(data) + 1, bool)
        end[offsets[1:]] = True
        return np.unique(np.searchsorted(offsets, at[odd | end[at + 1]], "right") - 1)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and how many each text has."""
        if len(self.known) > CACHE_PARTS:
            self.forget()
        data, offsets = text_buffer(texts)
        whole = [int(d) for d in self._uncut(data, offsets) if self.beside.search(texts[int(d)].as_py())]
        if whole:  # their parts are not asked for
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            data, offsets = text_buffer(pc.if_else(pa.array(mask), "", texts))
        words = scan(data, offsets, self.PART)
        head = np.zeros(len(data) + 1, bool)
        head[offsets[:-1]] = True
        key = np.where(head[words.starts], words.hashes ^ self.HEAD, words.hashes)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.append(self.known, np.uint64(0))[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        new |= at == len(self.known)
        if new.any():
            raw, begin, stop = data.tobytes(), words.starts[first[new]], words.ends[first[new]]
            first_part = head[begin]
            whole_heads = self._whole([raw[a:b].decode() for a, b in zip(begin[first_part].tolist(), stop[first_part].tolist())])
            flat, sizes = self._parts([raw[a:b].decode() for a, b in zip(begin[~first_part].tolist(), stop[~first_part].tolist())])
            sizes = np.concatenate([sizes, np.array([len(x) for x in whole_heads], np.int64)])
            place = np.empty(len(begin), np.int64)  # parts after a space come first
            place[~first_part], place[first_part] = np.split(np.arange(len(begin)), [len(begin) - len(whole_heads)])
            self.known, self.slot = np.insert(self.known, at[new], distinct[new]), np.insert(self.slot, at[new], len(self.ends) - 1 + place)
            self.flat = np.concatenate([self.flat, flat, *whole_heads])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        order = self.slot[np.searchsorted(self.known, distinct)][back]
        lengths = self.ends[order + 1] - self.ends[order]
        starts = np.cumsum(lengths) - lengths
        ids = self.flat[np.arange(int(lengths.sum())) - np.repeat(starts - self.ends[order], lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths)])[words.first]
        parts = {d: x for d, x in zip(whole, self._whole([texts[d].as_py() for d in whole]))}
        stop = np.array([end], np.uint32)
        out = [x for d, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) for x in (parts[d] if d in parts else ids[a:b], stop)]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array([len(x) + 1 for x in out[::2]], np.int64)


_ENCODERS: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """The encoder of a tokenizer file, built once per process. (Tasks reach it by this function's name: a global that
    a nested function uses itself would be copied anew for every task.)"""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def write_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token files of ``docs`` in ascending ``id_col`` order (any type that can be ordered; nulls first, ties by a hash of the text): a written table of
    ``range`` and ``part`` (the files' order), ``n_docs``, ``n_ids`` and ``file`` (bytes).

    Documents are dealt into ranges of id, hash and input partition, and sorted there, so that one id or one repeated row can span several ranges; files are
    cut by text size, so memory is bounded. Null and empty texts have the end id only. An empty table gives no files; other columns are ignored.
    """
    n = max(1, -(-text_bytes(docs, text_col) // RANGE_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("input"))
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc(), F.col("input").asc()]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("range"), "id", "text")
    kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held, size, now, part = encoder(tokenizer), [], 0, None, 0

        def close() -> pa.RecordBatch:
            lengths = np.concatenate([x[2] for x in held])
            ids = np.concatenate([x[1] for x in held])
            file = pack(pa.concat_arrays([x[0] for x in held]), ids, lengths)
            return pa.RecordBatch.from_pydict({"range": pa.array([now], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "file": pa.array([file], pa.binary())})

        for batch in by_size(batches, "text", FILE_BYTES // 2):
            ranges = batch.column("range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                some = batch.slice(a, b - a)
                if held and (int(ranges[a]) != now or size >= FILE_BYTES):
                    yield close()
                    held, size, part = [], 0, part + 1
                if int(ranges[a]) != now:
                    now, part = int(ranges[a]), 0
                ids, lengths = tool.encode(some.column("text"), end_id)
                held.append((some.column("id").cast(kind), ids, lengths))
                size += some.column("text").nbytes
        if held:
            yield close()

    return written(rows.mapInArrow(run, "range int, part int, n_docs long, n_ids long, file binary"), "token-files")


def read_files(files: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """Documents of token files: ``id_col``, ``start`` (ids before it in all files), ``n_tokens``, ``ids_crc32``.

    Every block is verified; a damaged file raises ``FileError``. Starts come from sums in three levels (files of a
    range, ranges of a block of 1024, blocks), so no task sees more than a few thousand rows. No files give no rows; ids come back as ``id_type``.
    """
    arrow = to_arrow_type(files.sparkSession.createDataFrame([], f"x {id_type}").schema["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = TokenFile(batch.column("file")[k].as_py())
                ids = file.ids().astype("<u4").tobytes()
                ends = np.cumsum(file.lengths)
                checks = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - file.lengths).tolist(), ends.tolist())]
                n = len(checks)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("range")[k].as_py()] * n, pa.int32()), pa.array([batch.column("part")[k].as_py()] * n, pa.int32()), file.documents.cast(arrow), pa.array(ends - file.lengths), pa.array(file.lengths), pa.array(checks, pa.int64())], ["range", "part", id_col, "within", "n_tokens", "ids_crc32"])

    sizes = files.select("range", "part", "n_ids", F.floor(F.col("range") / 1024).alias("block"))
    ranges = sizes.groupBy("block", "range").agg(F.sum("n_ids").alias("n"))
    blocks = ranges.groupBy("block").agg(F.sum("n").alias("n"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per 1024 ranges, each of RANGE_BYTES of text
    blocks = blocks.select("block", before(Window.orderBy("block"), "n").alias("a"))
    ranges = ranges.select("block", "range", before(Window.partitionBy("block").orderBy("range"), "n").alias("b"))
    parts = sizes.select("block", "range", "part", before(Window.partitionBy("range").orderBy("part"), "n_ids").alias("c"))
    starts = parts.join(ranges, ["block", "range"]).join(blocks, "block").select("range", "part", (F.col("a") + F.col("b") + F.col("c")).alias("base"))
    rows = files.select("range", "part", "file").mapInArrow(run, f"range int, part int, `{id_col}` {id_type}, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["range", "part"]).select(id_col, (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_files(files, "doc_id", docs.schema["doc_id"].dataType.simpleString())
