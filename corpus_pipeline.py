"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.
Null and empty texts pass every stage; rows with a null doc_id are kept and packed, and
have no part in what orders documents. Rows of a repeated doc_id are rows of their own,
in the order of a hash of their texts. Columns that documents have beside doc_id and text
are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, secrets, simhash, substring, toxicity
from tessera.llm.common import few, forget, keyed, materialize

#: Columns that stages add for themselves; no table is expected to have them.
KEY, OTHER, TEXT = "_tessera_row", "_tessera_other", "_tessera_text"


def _named(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs with their columns in the given order."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def _replace(docs: DataFrame, changed: DataFrame, columns: list[str]) -> DataFrame:
    """docs (keyed) with the texts of changed (KEY, TEXT); only those rows move. n_chars, if there is one, follows the text."""
    changed = materialize(changed.select(F.col(KEY).alias(OTHER), TEXT), "changed")
    ids = few(changed.select(OTHER))
    same = docs.join(ids, F.col(KEY) == F.col(OTHER), "left_anti")
    rest = docs.join(ids, F.col(KEY) == F.col(OTHER), "left_semi").join(changed, F.col(KEY) == F.col(OTHER))
    rest = rest.withColumn("text", F.col(TEXT))
    if "n_chars" in columns:
        rest = rest.withColumn("n_chars", F.length(TEXT).cast(docs.schema["n_chars"].dataType))
    return _named(same, columns).unionByName(_named(rest, columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay, each of repeated rows by itself. Learns from the labelled rows outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.below(docs, toxicity.train(docs, labels), 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Of repeated rows the first stays, like of any copies; null and empty texts are copies
    of one another, and of rows without an id one stays if no row with an id is alike.
    """
    own = keyed(docs, KEY)
    classes = simhash.near_copies(own, shingle=5, similarity=0.8, id_col=KEY)
    gone = materialize(classes.where(f"{KEY} <> component_id").select(F.col(KEY).alias(OTHER)), "gone")
    return _named(own.join(few(gone), F.col(KEY) == F.col(OTHER), "left_anti"), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 20 words or more that stand earlier are removed; the document stays. Rows without an id keep their texts."""
    own = keyed(docs, KEY)
    named = own.where("doc_id is not null")
    changed = substring.remove_repeats(named, 20, KEY).where("n_removed > 0").select(KEY, F.col("kept").alias(TEXT))
    return _replace(own, changed, docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that few owners and repositories hold are masked; the document stays."""
    own = keyed(docs, KEY)
    return _replace(own, secrets.masked(own, id_col=KEY).withColumnRenamed("new_text", TEXT), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in sequences of 2048 tokens for every piece of every row."""
    return packing.pack(docs, packing.default_tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained scores, fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. A stage's rows are deleted when the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            if before is not None:
                forget(before)
            before = docs
    return docs
