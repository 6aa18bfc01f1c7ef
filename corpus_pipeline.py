"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, tokens.

Each stage takes the documents its predecessor has kept, and all but the last return the columns of ``documents``. Rows
that share one doc_id and text are one document to the second stage and stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.bpe import decode_ids, encode_texts
from codelode.llm.common import materialize, small_batches, table
from codelode.llm.minhash import MAX_BROADCAST_IDS, near_duplicates
from codelode.llm.mixing import mix_sources
from codelode.llm.queries import held_out, tokenizer_path
from codelode.llm.repeats import remove_repeats
from codelode.llm.toxicity import learn_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model predicts to be toxic."""
    small_batches(spark)
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score_toxicity(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (five words, similarity 0.8)."""
    small_batches(spark)
    found = near_duplicates(docs, width=5, percent=80)
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier in the corpus; characters split by a cut go."""
    left = remove_repeats(docs.select(*COLUMNS), as_text=True).withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their sources' rates (row counts to the power 0.7), shuffled globally."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, little-endian unsigned 32-bit, and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    path = tokenizer_path()
    encoded = encode_texts(docs.select("doc_id", "source", "text"), path).select("doc_id", "source", "ids")
    return encoded.select(
        "doc_id", "source", "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decode_ids(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL expresses neither the models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; each stage's is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
