"""A corpus pipeline of five stages, each one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
``documents``; other columns are not read. Null and empty texts pass through as
they are (their score is the classifier's, they have no copies and no passages),
rows without doc_id stay and are no copies of others, an id with several texts is
judged text by text, of rows that repeat both id and text one stays, and empty
tables give empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.llm.bpe import tokenize
from strandbook.llm.common import shared_folder, table
from strandbook.llm.jaccard_join import without_copies
from strandbook.llm.mixing import mix
from strandbook.llm.passages import without_repeats
from strandbook.llm.quality import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier doesn't reject, by the operator's own threshold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return classify(docs.select(*COLUMNS), labels, threshold=0.7).filter("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies."""
    return without_copies(docs.select(*COLUMNS), percent=75)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves each repeated passage of 50 words or more in the earliest document that has it."""
    return without_repeats(docs.select(*COLUMNS), least_words=50, similarity=0.75)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; of the one at a source's edge, a half or more counts as whole."""
    mixed = mix(docs.select(*COLUMNS), share=1.5, epochs=2.0, weights=(3, 1, 2))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    return mixed.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; the decoding gives the text back."""
    ids = tokenize(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("mixing", mixture), ("tokens", tokens)]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
