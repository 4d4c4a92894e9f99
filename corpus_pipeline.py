"""From documents to packed training sequences: five stages, each on all that its predecessor kept.

Every stage but the last returns the columns of documents, whatever else they hold. A null, empty or letterless text has no
language and goes in the first stage; the later stages, on their own, keep it. Where a column n_chars exists it follows the
text. A null id is as good as any other. Repeated rows: lines and benchmark_leaks treat rows equal in id and text as one
document, near_copies keeps one of them. Very long texts are taken whole, and an empty table gives an empty result in every
stage. Names that begin with two underscores are ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import common, decontam, langid, line_dedup, packing, shingle_dedup

#: Near copies: Jaccard similarity of the sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; it learns from all that have a language."""
    names = [f"__{k}" for k in range(len(docs.columns))]  # the texts cross to Python once, and no column can clash
    lang, text = (names[docs.columns.index(c)] for c in ("lang", "text"))
    found = langid.identify(docs.toDF(*names), F.col(lang).isNotNull(), keep=names, lang_col=lang, text_col=text)
    return found.filter(~F.col("rejected")).select(*names).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines of 60 characters or more go, and documents of which no line stays."""
    found = line_dedup.dedup(docs).filter((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        found = found.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id; of rows equal in id and text one. Null ids stay."""
    found = shingle_dedup.groups(docs, shingle=SHINGLE, threshold=SIMILARITY)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    return kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, edited or not, go; all stay where the benchmark is empty."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. Repeated rows are packed each; a document without tokens is its end mark alone."""
    return packing.pack(docs, size=4096, with_ids=False)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("pack", pack)]

#: SQL has neither the models nor the tokenizer; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
