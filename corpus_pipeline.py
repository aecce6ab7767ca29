"""From raw documents to a training mix, in five stages.

Each stage is written as Parquet to the shared folder and read again as the next
one's input, so that a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm import decontam, jaccard, lines, mixing, toxicity
from itemloom.session import materialize, quoted, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal toxicity model doesn't reject.

    All columns and repeated rows stay as they are. Null and wordless texts, and all texts where
    no label or no evidence is there, are kept. A probability of just the limit rejects.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates, but for their first document's.

    No document goes; a text all of whose lines go is empty, a null one stays null. n_chars,
    where it is there, is that of the text as it is now. Rows that share a doc_id lose the
    same places; rows without one lose none.
    """
    out = lines.dedup_lines(docs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return out.select(*(length.get(name, c) for name, c in zip(docs.columns, quoted(docs), strict=True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links: that of the least doc_id.

    Wordless texts and rows without a doc_id stay; equal rows of one doc_id become one.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null texts stay, and all documents where the benchmark is empty. Rows that share a doc_id go together.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, with how often.

    All columns stay, four are added. Documents without words go; a null source is one of its own.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mix", mix_sources),
]

#: The first stage's model is fitted, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
