"""The corpus pipeline: language, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  Every stage
but the last returns the columns of its input, none of them changed, whatever their names.  ``run``
writes each stage's rows as Parquet in the shared checkpoint folder and reads them again, so a lost
executor costs one stage's tasks; a stage's folder is deleted when the next one is written, and the
last one, which the result reads, is the caller's.

Defined results, by stage.  Null text: language ID drops it (no letter); where a stage is called by
itself, quality scores it as an empty text, near-dedup keeps it (no link), mixing copies it, packing
gives its end id.  Empty texts likewise.  Very long texts are read whole.  Rows with a null or
repeated doc_id are documents of their own, but of rows equal in doc_id and text near-dedup keeps
one.  Ties: the smallest doc_id of a class stays.  An empty table gives an empty result with the
same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import langid, mixing, neardup, packing, quality
from quarrylens.llm.common import fold, shared_folder, table

#: The quality stage drops documents that score below this; between it and the classifier's own
#: threshold (0.7) lie doubtful ones, mostly of a few words, which stay.
DROP_BELOW = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; what the nearest centroid rejects goes."""
    model = langid.fit_on(docs.filter(~fold("doc_id", 3, 1)))
    return langid.in_known_languages(docs, model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranked quality score doesn't reject."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit_on(docs.filter(~fold("doc_id", 4, 2)), labels.filter(~fold("doc_id", 4, 2)))
    return quality.at_least(docs, model, DROP_BELOW)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.one_of_each_class(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of each document by its source's target rate, in a global random order."""
    return mixing.poisson_mix(docs, marks=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mix),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained stages, the signatures or the tokenizer.
ORACLE_SQL: str | None = None


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
