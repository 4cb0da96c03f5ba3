"""A training corpus from raw documents, in five stages.

Each stage takes the documents its predecessor kept, with all their columns, from a table, and
leaves its own as a table; a lost executor costs no more than the stage at work. The table of a
stage is deleted once the next stage's is written.

Defined results for odd input: texts that are null, or without a letter, are in no language and
go in the first stage, so later ones get none from it; given some themselves, ``exact`` counts
null as empty and keeps one such row, ``near`` keeps all of them, ``secrets`` leaves them alone,
and ``packing`` gives each its end id. Null ids stay as they are and never name a group of
others; rows that repeat are one text; very long texts are read whole in each stage. Columns
beyond id and text may be missing or have any names; ``n_chars``, if there, is counted anew
where a secret was replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import fingerprints, langid, neardup, packing, secrets
from weirflow.llm.staging import discard, stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the labelled ones are in go, as do those without a letter."""
    return langid.accepted(docs, langid.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return fingerprints.distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.one_of_each(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    clean = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: a row for each piece of a document, with its ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secret), ("packing", pack)]
#: SQL can express neither the tokenizer nor the language models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        last, docs = docs, stage(step(spark, docs, sf_dir), name)
        discard(last)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
