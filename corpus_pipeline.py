"""From raw documents to token ids: the stages of a training corpus, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm import jaccard_join, mixture, sentencepiece_scan, suffix_dedup, toxicity
from ripplemark.llm.common import materialize, read_table
from ripplemark.llm.queries import TOKENIZERS, remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5; its words are learned as in op4."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 5) == 0)
    return toxicity.without_toxic(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, up to twice."""
    return mixture.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chunks, n_tokens and ids (i32, little-endian, packed in binary)."""
    out = sentencepiece_scan.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.select("doc_id", "n_chunks", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", keep_one_of_each_group), ("suffix-array dedup", cut_repeats), ("mixing sources to target weights", mix_sources), ("SentencePiece encoding", encode)]

#: SQL can express neither a trained grammar nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
