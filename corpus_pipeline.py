"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns their tokens. Stages are applied one after the other, each to
what the one before it wrote.

All stages hold with nulls in any column, empty and very long texts, repeated rows, empty tables
and further columns, also such that are named as an operator names its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontam, near_dedup, quality
from tidelog.llm.components import components
from tidelog.llm.kit import cut, free_name, named, small, table
from tidelog.llm.line_dedup import line_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def own_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` among those of ``rows``, which begins with them."""
    return rows.select(*map(named, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and hold enough content lines; null and empty texts go, repeated rows are judged alike."""
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return own_columns(judged.where(named(judged.columns[-1])), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without windows of three lines seen before; those of which no word is left go.

    Null texts, and texts that lose nothing, stay as they are. n_chars is that of the text left.
    """
    left = line_dedup(docs)
    removed, text = named(left.columns[-1]), F.col("text")
    left = left.where((removed == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(removed > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return own_columns(left.withColumn("n_chars", n_chars), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, and of those with one id that with the smallest hash.

    A document here is an id, null or not, with a text: rows equal in both are one, and another
    text under the same id stands for itself. Texts without words are in no group.
    """
    node = F.xxhash64("doc_id", "text")
    classes = cut(components(near_dedup.near_links(docs.select(node.alias("node"), "text"), "node", "text")), "classes")
    members = docs.select(node.alias("id"), "doc_id").join(small(classes), "id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    best = cut(members.groupBy("comp").agg(F.min(order)["id"].alias("best")), "best")
    losers = cut(members.join(small(best), "comp").where("id <> best").select("id").distinct(), "losers")
    lost = free_name(docs, "lost_node")
    kept = docs.join(small(losers).withColumnRenamed("id", lost), node == F.col(lost), "left_anti")
    repeated = cut(docs.groupBy(node.alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if not repeated.limit(1).count():
        return kept
    # Only rows that stand there more than once are shuffled, one of each from every task.
    again = small(repeated).withColumnRenamed("id", lost)
    once = kept.join(again, node == F.col(lost), "left_anti")
    return once.unionByName(kept.join(again, node == F.col(lost), "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by benchmark items; null and empty texts aren't."""
    found = decontam.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return own_columns(found.where(~named(found.columns[-1])), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and digests of the ids and of what they decode to; a null text has no ids."""
    encoded = bpe.encode(docs.select("doc_id", "text"), TOKENIZER, keep=["doc_id"])
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256")
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), ids, F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k + 1}")
    return docs


# Neither the line labelling nor the hashing of stages 1 and 3 can be told in SQL.
ORACLE_SQL = None
