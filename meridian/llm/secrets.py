"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary covers words and common fragments, so random strings take
many tokens for their length. A candidate (a run of key characters with letters and
digits) whose characters per token fall below a limit is reported, unless it is a
digest of a known length, a UUID, a plain number or a lower-case identifier, or lies in a pattern's span. Of a candidate
that patterns' spans cover in part, each uncovered piece is tested; a word that a span cuts and that has no such piece is tested whole.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.frames import carried
from meridian.llm.words import by_size

SCAN_BYTES = 4 << 20
KINDS = ("assign", "access", "hex", "random")

# The patterns of known secrets.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORD = re.compile(r"[A-Za-z0-9]+")
IDENTIFIER = re.compile(r"[a-z0-9]+([-_/][a-z0-9]+)*/?|[A-Z0-9]+(_[A-Z0-9]+)+|[0-9+/=_-]+|(.)\2*")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out.extend((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        out.extend((m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20)
    out.extend((m.start(), 2, m.end()) for m in HEX.finditer(text))
    return sorted(out)


class RandomStrings:
    """The token-efficiency test under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str, limit: float) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit

    def random(self, string: str) -> bool:
        plain = string.strip("-_=/+")
        if len(plain) < 20 or not re.search("[0-9]", plain) or not re.search("[A-Za-z]", plain):
            return False
        if re.fullmatch("[0-9a-fA-F]+", plain) and len(plain) in DIGEST_LENGTHS or UUID.fullmatch(plain):
            return False
        if IDENTIFIER.fullmatch(plain) and max(map(len, re.split("[-_/]", plain))) < 16:
            return False
        return len(plain) / len(self.encoding.encode_ordinary(plain)) < self.limit

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found, starts = [], [a for a, _, _ in known]
        reach = list(accumulate((b for _, _, b in known), max))  # the furthest end of the spans so far
        for m in CANDIDATE.finditer(text):
            near = known[bisect_right(reach, m.start()) : bisect_left(starts, m.end())]
            inside = [(a, b) for a, _, b in near if m.start() < b]
            if not inside:
                if self.random(m[0]):
                    found.append((m.start(), 3, m.end()))
                continue
            pieces, at = [], m.start()
            for a, b in [*inside, (m.end(), m.end())]:
                if at < a:
                    pieces.append((at, a))
                at = max(at, b)
            parts = [(a, 3, b) for a, b in pieces if self.random(text[a:b])]
            if pieces:
                cut = [w.span() for w in WORD.finditer(text, m.start(), m.end())]
                cut = [(c, d) for c, d in cut if any(a < d and c < b and (c < a or b < d) for a, b in pieces) and not any(a < d and c < b for a, _, b in parts)]
                parts.extend((c, 3, d) for c, d in cut if self.random(text[c:d]))
            found.extend(parts)
        return found


_TESTS: dict[tuple, RandomStrings] = {}


def random_strings(vocabulary: str, pattern: str, limit: float) -> RandomStrings:
    """The test for a vocabulary, built once per process."""
    key = (vocabulary, pattern, limit)
    if key not in _TESTS:
        _TESTS[key] = RandomStrings(*key)
    return _TESTS[key]


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), limit: float = 2.0, redact: str | None = None) -> DataFrame:
    """One row per document: ``id_col``, the columns of ``keep`` and ``spans`` (kind, start, end in code points; by start, then kind).

    ``vocabulary`` is the path of a tiktoken file on every executor, ``pattern`` its splitting pattern. With ``redact``, a column
    ``redacted`` holds the text with every maximal span replaced by that string. Null texts count as empty
    (their redaction is null); null, tied and repeated ids give a row each; an empty table gives an empty result; other columns are ignored.
    """
    names = [id_col, *keep]
    rows, text = carried(docs, text_col, tuple(names))
    types = [to_arrow_type(rows.schema[c].dataType) for c in names]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = random_strings(vocabulary, pattern, limit)
        for batch in by_size(batches, text, SCAN_BYTES):
            texts = batch.column(text).to_pylist()
            found = []
            for whole in texts:
                known = base_spans(whole or "")
                found.append(sorted(known + test.spans(whole or "", known)))
            columns = [*(batch.column(c).cast(t) for c, t in zip(names, types)), pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found], span)]
            if redact is not None:
                columns.append(pa.array([t if not spans else cover(t, spans, redact) for t, spans in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "spans", *["redacted"] * (redact is not None)])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, spans array<struct<kind:string,start:int,end:int>>" + (", redacted string" if redact is not None else ""))


def cover(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    """The text with overlapping spans merged and replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out.extend((text[at:a], by))
        at = max(at, b)
    return "".join(out) + text[at:]


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``documents``."""
    import public_tokenizers

    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
