"""From raw documents to packed training sequences, in five stages.

Each stage gets all that its predecessor kept. All but the last return the columns of ``documents``; stages that
rewrite texts keep ``n_chars`` in step. Near duplicates are judged on five-word shingles at a similarity of 0.8.

Contract: a null or empty text is not toxic, is one empty line, links with nothing, is clean, and is packed as the end
id alone. Rows of one id are judged each by its own text, but lines and near duplicates keep the smallest id: rows that
repeat an id and a text are one document and stay or go together. Rows without an id stay where the smallest id
decides. Texts of any length are worked on whole; an empty table gives an empty result; extra columns are carried along
up to the last stage, which returns packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm._spark import checkpoint_dir, columns, materialize, row_key, small_side, table, unused
from kinweave.llm.decontaminate import contamination
from kinweave.llm.line_dedup import dedup_lines
from kinweave.llm.ngram_join import similar_components
from kinweave.llm.pattern_packing import pack
from kinweave.llm.queries import vocabulary
from kinweave.llm.toxicity import scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return scores(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").transform(columns, *docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return columns(out, *docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = similar_components(docs, k=5, percent=80, narrow=True, keyed=True)
    names = [unused(docs, n) for n in ("_k1", "_k2")]
    gone = materialize(groups.filter("doc_id <> component_id").select("_k1", "_k2").distinct().toDF(*names))
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_key(docs), names, strict=True)])
    return columns(keyed.join(small_side(gone), names, "left_anti"), *docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination(docs, table(spark, sf_dir, "benchmark"), with_text=True).filter("NOT contaminated").transform(columns, *docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary(), length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pattern_packing", pack_sequences),
]

#: The learned toxicity model and the tokenizer cannot be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that stay; every stage is written as Parquet to the shared folder and reread.

    A stage's files go as soon as the next stage has been written.
    """
    docs = table(spark, sf_dir, "documents")
    home = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/{before}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
