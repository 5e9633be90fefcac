"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

1. toxicity: the factorization machine's rejects go;
2. near duplicates: one document of each group of similar word-shingle sets stays;
3. decontamination: documents that hold a benchmark passage go;
4. secrets: secret spans are replaced in the text;
5. BPE: the remaining texts are encoded.

Each stage is written as Parquet in the shared folder and read again, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from meridian.llm.frames import BATCH_BYTES, small_batches, written

SECRET = "[SECRET]"
ARROW_BYTES = 4 << 20


def _bounded(spark: SparkSession) -> None:
    """Arrow batches of whole rows are bounded by bytes. A stage is computed after it returns, so the setting stays in the caller's session; ``run`` puts back what was there."""
    spark.conf.set(BATCH_BYTES, str(ARROW_BYTES))


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but id and text under names that no operator uses, and the names they had."""
    names = {f"__c{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed({old: new for new, old in names.items()}), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (trained on ``labels``, without its held-out fold) does not reject; all columns are kept.

    Null and empty texts have no features: they get the model's bias and stay unless label 1 is the commoner one. Null, tied and repeated ids
    are rows of their own; a very long text is scored whole; an empty table stays empty; without usable labels nothing is rejected
    unless the labels seen are mostly 1.
    """
    _bounded(spark)
    plain, names = _plain(docs)
    with small_batches(spark, ARROW_BYTES):
        model = toxicity.trained(spark, docs, sf_dir)
    kept = toxicity.score(plain, model, keep=("text", *names)).where("predicted = 0")
    return kept.drop("score", "predicted").withColumnsRenamed(names).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 80 per cent of five-word shingles connect: the smallest id (nulls last), then the smallest text hash.

    Null, empty and blank texts link with nothing and all stay; a text of fewer than five words is one shingle; of rows that agree in id and text one
    stays; an empty table stays empty; all columns are kept, whatever their names.
    """
    _bounded(spark)
    plain, names = _plain(docs)
    return ngram_join.keep_one(plain, n=5, percent=80).withColumnsRenamed(names).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of ``benchmark`` (all words of a shorter item); all columns are kept.

    Null and empty texts hold nothing and stay; null, tied and repeated ids are rows of their own (rows that agree in id and text share their fate);
    items without text match nothing; an empty table, of documents or benchmark, drops nothing.
    """
    _bounded(spark)
    plain, names = _plain(docs)
    with small_batches(spark, ARROW_BYTES):
        kept = decontaminate.drop_contaminated(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return kept.withColumnsRenamed(names).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and, if there is a column ``n_chars``, characters counted anew where the text changed.

    Null and empty texts stay as they are; null, tied and repeated ids are rows of their own; a very long text is searched whole; an empty table stays empty; other
    columns are kept, whatever their names.
    """
    _bounded(spark)
    plain, names = _plain(docs)
    found = secrets.find_secrets(plain, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("text", *names), redact=SECRET)
    for new, old in names.items():
        if old == "n_chars":
            counted = F.char_length("redacted").cast(docs.schema["n_chars"].dataType)
            found = found.withColumn(new, F.when(F.size("spans") > 0, counted).otherwise(F.col(new)))
    found = found.withColumn("text", F.col("redacted")).drop("spans", "redacted")
    return found.withColumnsRenamed(names).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, every other column but the text, and of every whole text the token ids (little-endian unsigned 32-bit integers), their number, and a digest of the decoding.

    Null and empty texts have no ids; null, tied and repeated ids are rows of their own; an empty table gives an empty result. A column that is
    called like one of the results (``n_tokens``, ``ids``, ``decoded_sha256``) gives way to it.
    """
    _bounded(spark)
    made = ("n_tokens", "ids", "decoded_sha256")
    plain, names = _plain(docs)
    names = {new: old for new, old in names.items() if old not in made}
    out = bpe.encode_decode(plain, public_tokenizers.path("word_bpe_49k.json"), keep=tuple(names))
    out = out.select("doc_id", *names, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return out.withColumnsRenamed(names)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. Arrow batches of whole rows are bounded by bytes meanwhile; the session's setting is as before afterwards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with small_batches(spark, ARROW_BYTES):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
