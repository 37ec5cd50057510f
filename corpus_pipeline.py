"""The corpus pipeline: four filters and a packer over the documents table, one after the other.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that calls one of the
operators in textloom.llm on all that the stage before it kept. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, packing, simhash, toxicity
from textloom.llm.common import materialize, named, read_table, unused

#: Words in a shingle and the least Jaccard similarity of near copies, as a fraction.
SHINGLE, SHARE = 5, (4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labelled ones among docs, scores under one half.

    A null or empty text has the score of an empty window, with the usual mix of labels
    under one half; where no label can be learned from, all stay. Repeated rows get equal
    scores; a score of exactly one half goes.
    """
    model = toxicity.model_for(docs, read_table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "tox_score")
    return toxicity.score_documents(docs, model, score).filter(F.col(score) < 0.5).select(*named(docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten rows or more share; n_chars follows the text.

    No row goes: a null or empty text is an empty text after this stage, and so is one that
    loses all its lines. Repeated rows count apart and lose the same lines.
    """
    names = docs.columns
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*named(names))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Null, empty and wordless texts are one group; a null doc_id stands for a group only if
    all its rows have none; repeated rows are copies, of which the first by text and by a
    hash of all columns stays.
    """
    return simhash.drop_near_copies(docs, shingle=SHINGLE, share=SHARE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs with at most 8 edits in 100 characters.

    Null and empty texts hold no item and stay; items without words are left out; repeated
    rows stay or go together.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed apart; columns other
    than doc_id and text are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: The network's scores and the near copies cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
