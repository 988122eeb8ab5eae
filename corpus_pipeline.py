"""The corpus pipeline: language, quality, near duplicates, packing. Every stage works on all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents, in their order, with any others that docs has.

Defined results, of every stage: an empty table gives an empty one; rows are judged one by one, so repeated rows and repeated
ids fare alike in the first two stages; texts may be of any length; columns that a stage does not use are kept as they
are, nulls too. What a stage does with null texts, null ids and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.llm import language_id, ngram_jaccard_join, quality_classifier, queries
from siftwell.llm.common import map_batches, materialise, table


def _kept(docs: DataFrame, decide, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, for whose texts decide(list of texts) is true. No join, no shuffle."""
    schema: StructType = docs.schema

    def run(batches):
        for b in batches:
            keep = decide(b[text_col])
            yield {name: [v for v, k in zip(values, keep) if k] for name, values in b.items()}

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told (null or empty texts, those without a letter) or is ambiguous: the two best
    languages tie or nearly do. Rows with a null id are judged, but not learned from. Where no row has a language, none is kept."""
    model = spark.sparkContext.broadcast(queries.language_model(docs))

    def decide(texts: list) -> list[bool]:
        return [not language_id.decode(model.value, t, 0.02)[2] for t in texts]

    return _kept(docs, decide)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the bound; one that scores exactly as much stays. A null text scores as an empty one.
    Rows with a null id are judged, but not learned from. Without labels of both kinds nothing can be told and all rows stay."""
    model = queries.quality_model(spark, sf_dir, docs)
    shared, least = spark.sparkContext.broadcast(model), queries.GOOD

    def decide(texts: list) -> list[bool]:
        return [s >= least for s in quality_classifier.scores(shared.value, texts)]

    return docs if model is None else _kept(docs, decide)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id; of rows with that id the one whose text has the smallest
    digest. Rows with one id and unlike texts are documents of their own; rows whose text is null or has no word are
    nobody's copies, but of equal ones with one id one stays; rows with a null id stay."""
    return ngram_jaccard_join.without_duplicates(docs, id_col="doc_id", text_col="text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences. A null text is an empty one; a null id stays null; every row is packed,
    repeated ones too. Returns the columns of the packing operator in place of those of documents."""
    return queries.pack(docs)


STAGES = [("language id", language), ("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("best-fit packing", packing)]

#: Trained models and randomised joins have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
