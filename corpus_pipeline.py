"""From raw documents to clean, decoded training text: five stages, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept. Stages 1 to 4 return the columns of documents; the last
adds token ids (token_ids, n_tokens) and what they decode to (decoded), in place of columns of those names.

Defined cases. Null and empty texts, and texts without a letter, are rejected by the first stage; a stage of its own
takes them too: null and empty texts are near duplicates of one another, stay as they are in suffix-array dedup (an
empty one goes there), hold no benchmark passage, and have no tokens. Rows without an id are never near duplicates and
never contaminated; rows that repeat an id are one document in near-duplicate removal and decontamination, which keep
or drop them together. Ties: of a group of near duplicates the smallest id stays; of equal passages, that of the
smaller id. An empty table gives an empty table. Other columns, whatever their names, pass through. Texts of any length
are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, decontaminate, langid, suffixdedup, verified
from factweave.llm.common import crc_mod, read_table, shared_dir
from factweave.llm.registry import tokenizer_path

#: Words of a shingle in the near-duplicate stage, bits that SimHash candidates may differ in, and the least Jaccard
#: similarity of near duplicates.
SHINGLE, RADIUS, LEAST = 5, 4, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects."""
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    prefix = "_" * (1 + max(map(len, docs.columns)))  # no column begins like this
    found = langid.identify(docs, model, prefix=prefix)
    return found.where(~F.col(f"{prefix}rejected")).select(*[found[f"`{c}`"] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, whose links are verified on their shingle sets: that with
    the smallest id. Rows of one id are one document; rows without an id stay."""
    groups = verified.near_duplicates(docs, LEAST, RADIUS, SHINGLE).select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__c"))
    gone = groups.where("__id <> __c").select("__id")
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; a document of which nothing is left goes."""
    cut = suffixdedup.deduplicate(docs)
    cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
    return cut.where("text is null or trim(text) <> ''")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold passages of the benchmark."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts, and decode the ids again."""
    return bpe.transcode(docs, tokenizer_path()).withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", exact_repeats),
    ("benchmark_decontamination", benchmark),
    ("bpe", encode),
]

#: Language scores and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each is written to the shared folder and read again, and goes when the next is
    there (the last when the session ends)."""
    docs = read_table(spark, sf_dir, "documents")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = jvm.org.apache.hadoop.fs.Path(at, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before is not None:
            files.delete(before, True)
        before = path
    return docs
