"""From raw documents to token ids: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import bpe_trie, line_dedup, mixing, ngram_join, toxicity
from larkspan.llm.common import documents, dropped, fresh, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold. The model is learned from the labels of sf_dir.

    Null and empty texts score by the constant term and stay unless nearly all labelled texts are toxic. Without labels
    of both classes all texts score alike. Repeated rows go or stay together, an empty table gives none, and columns may
    have any names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh("score", docs.columns)
    return toxicity.score(docs, model, tuple(docs.columns), name).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line. One that loses every line stays with an empty text."""
    kept = line_dedup.dedup_lines(docs, names=("text", None, None)).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates.

    Documents without words, and null ids, are in no group and stay. Rows with one id count as one document. An empty
    table gives none, and columns may have any names.
    """
    groups = ngram_join.near_duplicate_groups(docs)
    copies = stored(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("copy")).distinct(), "near-copies")
    return docs.join(copies, docs["doc_id"] == copies["copy"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, a row for each time that it takes one.

    A document that is taken in part, one in a source at most, keeps its first words, joined by one space. Documents
    without words are taken 0 words and go. Null ids mix as one document each, by their text. Rows that are equal in id,
    source and text share what the mix takes of them. An empty table gives none, and columns may have any names.
    """
    return mixing.mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, ids, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe_trie.encoded(docs, bpe_trie.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("bpe encoding and decoding", encode),
]

#: No SQL: a trained classifier decides which documents go in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written and read again."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
