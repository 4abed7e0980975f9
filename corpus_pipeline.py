"""From raw documents to training documents: each stage works on what the one before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. Each result is written as Parquet and read
again for the next stage, in the shared folder of spark.checkpoint.dir; what a stage has read goes once its result is written.

Defined results, for every stage: a null text is an empty one (the first stage rejects it); rows with a null id are documents of their own texts; rows that repeat
id and text are one document and share its fate, but for the second stage, where one of them stays; of equal texts that with the least id stays; an empty
table gives no rows; other columns of the input come out as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import bpe, decontam, jaccard, quality, substring
from stratum.llm.common import Scratch
from stratum.llm.queries import table, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's bounds let pass."""
    # The verdicts are written without the documents, whose copy would stay beside all the later stages. A hash passes over nulls, so it gets their places too.
    rests = ["text", "lang", "source"]
    key = F.xxhash64(*rests, *[F.col(c).isNull() for c in rests])
    found = quality.judge(docs.select("doc_id", key.alias("key"), *rests), ["doc_id", "key"]).where("not q_kept")
    found = Scratch(spark, "rejected").save(found.select(F.col("doc_id").alias("gone"), F.col("key").alias("hit")).distinct(), "rejected")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return rows.join(found, (rows["key"] == found["hit"]) & rows["row.doc_id"].eqNullSafe(found["gone"]), "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard.first_of_groups(docs, size=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus; documents of which nothing is left go."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("row"), "doc_id", "text")
    out = substring.dedup(rows, ["row"]).where("s_removed = 0 or s_removed < s_words")
    n_chars = F.when(F.col("s_removed") > 0, F.length("s_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    made = {"text": F.col("s_text"), "n_chars": n_chars}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage: one window of an item is enough for a document to go."""
    key = F.xxhash64("doc_id", "text")
    found = decontam.contamination(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), doc_id="key").where(F.size("starts") > 0)
    # As a table, so that Spark knows its size: the documents are shuffled only if the hits are too many to be broadcast.
    found = Scratch(spark, "hits").save(found.select(F.col("doc_id").alias("hit")).distinct(), "hits")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return rows.join(found, rows["key"] == found["hit"], "left_anti").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and the digests by which their decoding can be checked."""
    out = bpe.round_trip(docs, tokenizer("word_bpe_49k.json"), ["doc_id", "lang", "source"], with_ids=True)
    return out.select("doc_id", "lang", "source", F.col("b_n").alias("n_tokens"), F.col("b_ids").alias("ids"), F.col("b_ids_sha256").alias("ids_sha256"), F.col("b_decoded_sha256").alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", token_ids),
]

#: SQL has no byte-pair encoding; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
