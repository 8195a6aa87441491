"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Stages read their input more than once, so ``run`` writes it in between.

All stages take nulls in any column, empty and very long texts, and repeated rows, each as said there; an empty table
gives an empty table; columns besides those of documents pass unchanged, whatever their names (the last stage has none).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.llm import bpe, jaccard, langid, mixing, substring
from courtlens.llm.common import checkpoint, column

#: Least share of a document's letters that its main language must have.
MAIN_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those of which no language has MAIN_SHARE; all stay if no language is known.

    Null and empty texts have no letters; a null language teaches nothing; repeated rows stay or go together.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs
    names = {c: f"_d{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select(*(column(c).alias(n) for c, n in names.items()), F.col("text").alias("_whole"))
    kept = langid.predict(inner, model, text="_whole").where((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_SHARE))
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id (a null id only if all are null).

    Of rows with equal id and text one stays. Texts without words are no copies of each other.
    """
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that also stand elsewhere are cut out; other documents stay as they are.

    n_chars follows the text where that was cut. A null text stays null; repeated rows lose what they share.
    """
    names = {c: f"_d{k}" for k, c in enumerate(docs.columns) if c != "text"}
    cut = substring.remove_repeats(docs.select(*(column(c).alias(n) for c, n in names.items()), "text"), key=names["doc_id"])
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(names["n_chars"]))
    return cut.select(*((F.col("text") if c == "text" else length if c == "n_chars" else F.col(names[c])).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 3 times.

    A null source is a source; null and empty texts have no words, so they only come along in whole copies; rows with
    equal id and text are taken equally often.
    """
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256): ids as little-endian 32-bit numbers, decoded again.

    Null texts are empty and have no ids; each row, repeated or with a null id, has its own result.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "text"), path, pattern)
    read = bpe.digests(encoded, path, pattern, keep_ids=True)
    return read.select(F.col("doc_key").alias("doc_id"), "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring deduplication", repeated_passages),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokens),
]
#: SQL can't express the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = checkpoint(docs) if k + 1 < len(STAGES) else docs
    return docs


QUERIES = {"pipeline": run}
ORACLE_SQLS = {"pipeline": ORACLE_SQL}
