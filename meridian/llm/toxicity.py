"""Toxicity: a factorization machine over hashed terms.

A text's features are its distinct words and word beginnings, hashed into ``SLOTS``
slots. A slot's value is its class log ratio in the training rows (zero where unseen),
and a text's values are scaled to length one. The machine adds to the linear weights an inner
product of learned vectors for every pair of terms, so that terms that are harmless
alone (an insult, the mention of a group) can count together.

Training takes one text of each of at most ``MAX_TRAINING`` labelled ids, those with the smallest hash, on the driver; only
hashed features come there, at most ``MAX_FEATURES`` of a text (those with the smallest slots). Scoring reads every
whole text, and the model it broadcasts has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meridian.llm.frames import carried, settle_driver, small_batches
from meridian.llm.words import ALNUM, LOWER, by_size, give_back, mix, scan, text_buffer

BITS = 18
SLOTS = 1 << BITS
FACTORS = 4
MAX_TRAINING = 12_000
MAX_FEATURES = 8192  # of a training text; slots are hashes, so the smallest are as good as any
PRIOR = 100.0  # pseudo-rows of a slot's class ratio, so that rare terms count little
SCAN_BYTES = 1 << 20


class Model(NamedTuple):
    """Bias, slot values, linear weights and pair vectors."""

    bias: float
    value: np.ndarray
    weight: np.ndarray
    pair: np.ndarray


def features(texts: pa.Array, beginnings: tuple[int, ...] = (4, 6)) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, one after the other, and how many each text has."""
    data, offsets = text_buffer(texts)
    words = scan(data, offsets, ALNUM, LOWER)
    folded = np.concatenate([LOWER[data], np.zeros(max(beginnings), np.uint8)]).astype(np.uint64)
    length, terms = words.ends - words.starts, [words.hashes]
    for n in beginnings:
        start = np.zeros(len(length), np.uint64)
        for k in range(n):
            start |= np.where(k < length, folded[words.starts + k], np.uint64(0)) << np.uint64(8 * k)
        terms.append(mix(start + np.uint64(n << 56)))
    slots = (np.stack(terms, 1) >> np.uint64(64 - BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    both = np.unique((owner[:, None] << BITS) | slots)
    return (both & (SLOTS - 1)).astype(np.int32), np.bincount(both >> BITS, minlength=len(offsets) - 1)


def _scaled(value: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature values of length one per text, and each feature's text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    x = value[slots]
    norm = np.sqrt(np.bincount(owner, x * x, len(counts)))
    return x / np.maximum(norm, 1e-9)[owner], owner


def margins(model: Model, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of label 1."""
    x, owner = _scaled(model.value, slots, counts)
    n = len(counts)
    z = model.bias + np.bincount(owner, model.weight[slots] * x, n)
    for f in range(model.pair.shape[1]):
        vx = model.pair[slots, f] * x
        z += 0.5 * (np.bincount(owner, vx, n) ** 2 - np.bincount(owner, vx * vx, n))
    return z


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 4, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 0) -> Model:
    """Adaptive-gradient logistic loss over the rows' slots. Without both labels the model is a constant."""
    ones, zeros = int(labels.sum()), int(len(labels) - labels.sum())
    weight, rng = np.zeros(SLOTS), np.random.default_rng(seed)
    pair = rng.normal(0, 0.01, (SLOTS, FACTORS))
    if not ones or not zeros:
        return Model(float(np.log((ones + 0.5) / (zeros + 0.5))), weight, weight, np.zeros((SLOTS, FACTORS)))
    seen = [np.zeros(SLOTS), np.zeros(SLOTS)]
    for slots, label in zip(rows, labels):
        seen[int(label)][slots] += 1
    share = ones / len(labels)
    value = np.log((seen[1] + PRIOR * share) / (seen[0] + PRIOR * (1 - share))) - np.log(ones / zeros)
    bias, sw, sp, sb = 0.0, np.full(SLOTS, 1e-6), np.full((SLOTS, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            counts = np.array([len(rows[i]) for i in some])
            slots = np.concatenate([rows[i] for i in some])
            x, owner = _scaled(value, slots, counts)
            vx = pair[slots] * x[:, None]
            sums = np.stack([np.bincount(owner, vx[:, f], len(some)) for f in range(FACTORS)], 1)
            squares = np.bincount(owner, (vx * vx).sum(1), len(some))
            z = bias + np.bincount(owner, weight[slots] * x, len(some)) + 0.5 * ((sums**2).sum(1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]
            at, back = np.unique(slots, return_inverse=True)
            gx = slope[owner] * x
            dw = np.bincount(back, gx, len(at)) + decay * weight[at]
            dp = np.stack([np.bincount(back, gx * (sums[owner, f] - vx[:, f]), len(at)) for f in range(FACTORS)], 1) + decay * pair[at]
            sw[at] += dw**2
            sp[at] += dp**2
            sb += slope.sum() ** 2
            weight[at] -= rate * dw / np.sqrt(sw[at])
            pair[at] -= rate * dp / np.sqrt(sp[at])
            bias -= rate * slope.sum() / np.sqrt(sb)
    return Model(float(bias), value.astype(np.float32), weight.astype(np.float32), pair.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING) -> Model:
    """A model of ``label_col`` (0 or 1) from one text of each of at most ``max_rows`` ids of ``labels``; ids without a row in ``docs`` are left out.

    Null labels and ids are ignored; of an id labelled twice the larger label counts, and of several texts of an id the one with the smallest hash.
    No usable rows give a constant model.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", SCAN_BYTES):
            slots, counts = features(batch.column("text"))
            parts = np.split(slots, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), batch.column("text_hash"), pa.array([p[:MAX_FEATURES].tobytes() for p in parts], pa.binary())], ["id", "label", "text_hash", "slots"])

    # at most max_rows pairs of an id and a label
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).join(F.broadcast(chosen), "id")
    rows = rows.select("id", "text", "label", "text_hash").mapInArrow(run, "id string, label int, text_hash long, slots binary")
    rows = rows.groupBy("id").agg(F.first("label").alias("label"), F.min_by("slots", F.struct("text_hash", "slots")).alias("slots"))
    with small_batches(docs.sparkSession):
        found = rows.toArrow().sort_by("id")  # one row per chosen id; as Arrow they are never rows of the driver's heap
    model = fit([np.frombuffer(x.as_buffer(), np.int32) for x in found.column("slots")], found.column("label").to_numpy().astype(np.float64))
    del found
    give_back()
    settle_driver(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``id_col``, the columns of ``keep``, ``score`` and ``predicted``.

    Null and empty texts get the score of no features; null, tied and repeated ids give a row each; an empty table
    gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]
    rows, text = carried(docs, text_col, tuple(names))
    types = [to_arrow_type(rows.schema[c].dataType) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, text, SCAN_BYTES):
            p = 1 / (1 + np.exp(-np.clip(margins(sent.value, *features(batch.column(text))), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(t) for c, t in zip(names, types)), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def trained(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the ``labels`` table, without its held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.where(~held_out()))


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, trained(spark, docs, sf_dir)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
