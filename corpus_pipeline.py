"""Corpus pipeline: the stages, in order, applied to ``documents``.

Every stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept and returns the columns of ``documents``; the last returns
the packed pieces. Stages expect a written table, whose scan gives the same
rows each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigflow.llm import langid
from sigflow.llm.common import materialise
from sigflow.llm.exact_dedup import distinct_documents
from sigflow.llm.packing import pack_documents
from sigflow.llm.queries import tokenizer_file
from sigflow.llm.simhash import distinct_near
from sigflow.llm.suffix_dedup import cut_repeats
from sigflow.session import ship_package
from sigflow.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that can have a language; those that are NULL or without any
    letter go. Where no document has a label nothing is learned, and documents
    with letters stay."""
    ship_package(spark)
    langs, prototypes = langid.train(docs)
    # own names, so that no column of the documents clashes with a result
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    found = langid.predict(docs, langs, prototypes, {n: F.col(c) for n, c in names.items()}, letters="letters")
    return found.where("letters").select(*[F.col(n).alias(c) for n, c in names.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    return distinct_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    ship_package(spark)
    return distinct_near(docs, 4, 4)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that repeat. A character that
    lost some of its bytes goes as a whole; a NULL text stays NULL."""
    ship_package(spark)
    others = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    rows = docs.select("doc_id", "text", F.col("text").isNull().alias("none"), *[F.col(c).alias(n) for n, c in others.items()])
    cut = cut_repeats(rows, 200, keep=["none", *others])
    made = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("none"), F.col("kept_text")),
            "n_chars": F.char_length("kept_text").cast("long")} | {c: F.col(n) for n, c in others.items()}
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    ship_package(spark)
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 1024)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

# neither a learned model nor components have a plain SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
