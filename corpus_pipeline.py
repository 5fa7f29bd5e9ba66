"""A document pipeline of five stages, each one operator of ``notelake.llm``.

Every stage gets the table that the stage before it wrote, and its decisions take effect: language
ID drops texts of no determinable language, both dedup stages leave one document of each group,
the secret scan replaces what it finds, and packing gives the token sequences. All stages but the
last return the columns of ``documents``, whatever other columns the table has: temporary columns are
named ``__nl_*``. An empty table passes every stage and gives no rows. Whole texts are read, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import exact_dedup, language, near_dedup, packing, secrets
from notelake.llm.store import materialize

#: Least probability of the predicted language; clean documents of a few words reach it.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null or empty text, no letter, or a score under the limit.

    Null and repeated ids and null languages are no reason to drop a row. If no row has a language to
    learn from, none can be told and all rows go.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.train(language.training_sample(docs, ~held_out))
    named = language.identify_rows(docs, model, "text", "__nl_lang", "__nl_score")
    sure = (F.col("__nl_lang") != language.UNDETERMINED) & (F.col("__nl_score") >= LEAST_LANGUAGE_SCORE)
    return named.filter(sure).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id stays.

    Null texts equal empty ones; a null id loses against any other; of rows that repeat id and text one stays.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows with a null id or a text without words stay. Rows that repeat an id are one document: all stay or all go.
    """
    groups = near_dedup.near_duplicates(docs)
    gone = materialize(groups.filter("not kept").select("doc_id").distinct(), "gone")
    # merged, not broadcast, at every size: the table of lost ids grows with the input
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found; documents stay, with n_chars counted anew where they changed.

    Null texts stay null. Null and repeated ids are treated like any other.
    """
    found = secrets.find_secrets(docs, secrets.default_model(docs), out="__nl_secrets")
    changed = F.size("__nl_secrets") > 0
    found = found.withColumn("text", F.when(changed, secrets.redact(F.coalesce("text", F.lit("")), F.col("__nl_secrets"))).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of 4096-token sequences.

    Null texts count as empty; every row is packed on its own, also where ids are null or repeat.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The learned stages can't be told in SQL; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result but the last is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
