"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols; leaf i of its tree holds the merge rank of the pair that
starts at symbol i, together with i. The root is therefore the leftmost pair of the
lowest rank; merging it changes two pairs and removes one, each by a point update in
logarithmic time, until the root holds no rank. Words of similar length go through
their trees side by side, one merge of each at a time.

Normalising and cutting into words follow the tokenizer file: by a pattern for texts
below U+0250, by the library's own normaliser and pre-tokenizer for others. A word is
merged once per worker and kept in a cache of bounded size. Texts are decoded from their ids alone.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.frames import carried
from meridian.llm.words import by_size

SCAN_BYTES = 1 << 20
CACHE_WORDS = 120_000
NONE = np.iinfo(np.int64).max


class SegmentTreeBPE:
    """The merge step of a BPE vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        key = (left << 32) | right
        rank = np.arange(len(pairs))
        order = np.lexsort((-rank, key))  # of a pair listed twice the later rank counts
        key, rank = key[order], rank[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        self.keys, self.ranks = np.append(key[new], NONE), np.append(rank[new], -1)
        self.merged = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank and position of the pairs, as one ordered number; NONE where they don't merge."""
        key = (left << 32) | right
        k = np.searchsorted(self.keys, key)
        return np.where((self.keys[k] == key) & (right >= 0), (self.ranks[k] << 32) | at, NONE)

    def encode(self, words: list[list[int]]) -> list[list[int]]:
        """The symbols of each word after all merges."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        width = 2
        while len(words) and width < 2 * max(2, int(lengths.max())):
            held = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            step = max(1, (1 << 20) // width)
            for a in range(0, len(held), step):
                some = held[a : a + step]
                for k, ids in zip(some, self._merge([words[i] for i in some], lengths[some], width)):
                    out[k] = ids
            width *= 2
        return out

    def _merge(self, words: list[list[int]], lengths: np.ndarray, width: int) -> Iterator[list[int]]:
        n = len(words)
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[:, :width][np.arange(width) < lengths[:, None]] = np.concatenate([np.array(w, np.int64) for w in words])
        place = np.arange(width)
        after = np.tile(np.minimum(place + 1, width), (n, 1))  # `width` stands for the end
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = self._leaf(np.maximum(symbol[:, :width], 0), np.where(symbol[:, :width] >= 0, symbol[:, 1:], -1), place)
        size = width // 2
        while size:
            tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])
            size //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = value
            while node[0] > 1:  # all leaves are equally deep
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & 0xFFFFFFFF
            gone = after[rows, at]
            symbol[rows, at] = self.merged[root >> 32]
            follow = after[rows, gone]
            after[rows, at] = follow
            symbol[rows, gone] = -1
            inner = follow < width
            before[rows[inner], follow[inner]] = at[inner]
            put(rows, gone, np.full(len(rows), NONE))
            right = symbol[rows, follow]
            put(rows, at, self._leaf(symbol[rows, at], right, at))
            front = before[rows, at]
            on = front >= 0
            if on.any():
                put(rows[on], front[on], self._leaf(symbol[rows[on], front[on]], symbol[rows[on], at[on]], front[on]))
            rows = rows[tree[rows, 1] != NONE]
        for row in symbol:
            yield row[row >= 0].tolist()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Cache(dict):
    """A dict that forgets what two fills of ``room`` entries have not asked for."""

    def __init__(self, room: int) -> None:
        super().__init__()
        self.room, self.old = room, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def lacks(self, key) -> bool:
        """Whether the key is unknown; a known one is kept over the next turn."""
        if key not in self and key in self.old:
            self[key] = self.old[key]
        return key not in self

    def turn(self) -> None:
        if len(self) > self.room:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encoding and decoding of whole texts as a ``tokenizers`` BPE file with word ends and no decoder defines them."""

    #: The file's pieces, for lower-cased texts below U+0250, where white space is as listed.
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x20\x09-\x0D\x85\xA0\p{L}\p{N}]+")
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.bpe = SegmentTreeBPE(self.vocab, model["merges"])
        self.library = Tokenizer.from_file(path)
        names = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [names.get(i) for i in range(max(names, default=-1) + 1)]
        self.whole = None not in self.names
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = tuple({s[0] for s in self.special if s})  # a text without any of these holds no special token
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.inner, self.last = [self.vocab[c] for c in self.alphabet], [self.vocab[c + self.suffix] for c in self.alphabet]
        self.byte = {c: b for b, c in enumerate(self.alphabet)}
        self.words = Cache(CACHE_WORDS)  # by the word's bytes or, where a text has them, its characters

    def _pieces(self, text: str) -> list:
        """The words of a text without special tokens; bytes where the library has mapped them."""
        if text.isascii():
            return self.ASCII.findall(text.lower())
        if max(text) < "\u0250":
            return self.PIECE.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if w]

    def pieces(self, text: str) -> list:
        """All words of a text; special tokens as their ids."""
        if not any(m in text for m in self.marks):
            return self._pieces(text)
        out: list = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self._pieces(part))
        return out

    def _learn(self, words: list) -> None:
        self.words.turn()
        inner, last, rows = self.inner, self.last, []
        for word in words:
            if isinstance(word, int):
                rows.append([word])
                continue
            raw = word if isinstance(word, bytes) else word.encode()
            row = [inner[b] for b in raw]
            row[-1] = last[raw[-1]]
            rows.append(row)
        for word, ids in zip(words, self.bpe.encode(rows)):
            self.words[word] = array("I", ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Each text's ids, as little-endian 32-bit integers, and its decoding."""
        cut = [self.pieces(t) for t in texts]
        new = [w for w in {w for words in cut for w in words} if self.words.lacks(w)]
        if new:
            self._learn(new)
        words, out = self.words, []
        for text in cut:
            ids = b"".join([words[w] for w in text])
            out.append((ids, self.decode(ids)))
        return out

    def decode(self, raw: bytes) -> str:
        """Token strings of little-endian 32-bit ids joined by spaces, special tokens included; unknown ids are left out."""
        names, ids = self.names, array("I", raw)
        if self.whole and (not ids or max(ids) < len(names)):
            return " ".join([names[i] for i in ids])
        return " ".join([names[i] for i in ids if i < len(names) and names[i] is not None])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a tokenizer file, built once per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id_col``, the columns of ``keep``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    ``tokenizer`` is the path of the tokenizer file on every executor. Null and empty texts have no ids and decode to
    the empty string; null, tied and repeated ids give a row each; an empty table gives an empty result; other columns are ignored.
    """
    names = [id_col, *keep]
    rows, text = carried(docs, text_col, tuple(names))
    types = [to_arrow_type(rows.schema[c].dataType) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(tokenizer)
        for batch in by_size(batches, text, SCAN_BYTES):
            found = tool.encode_all([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(t) for c, t in zip(names, types)), pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.string())], [*names, "ids", "decoded"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, ids binary, decoded string")


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Token counts and digests of what ``encode_decode`` returns."""
    return encoded.select(*keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id")
