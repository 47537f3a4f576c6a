"""The stages of the corpus pipeline: language identification, line dedup, near dedup, substring dedup, packing.

Each takes (spark, docs, sf_dir). All but the last return the columns of ``documents``, with the values that came in; only
``text`` changes where something is cut out of it, and ``n_chars`` with it.

Cases: other columns come through whatever their names; rows that repeat an identifier are handled each by its text; rows
without identifier stay rows of their own; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre.llm import language_crf
from gyre.llm.line_dedup import line_dedup
from gyre.llm.near_dedup import near_duplicates
from gyre.llm.packing import pack
from gyre.llm.substring_dedup import substring_dedup

#: A document is rejected if its language is undecided, or its score is below this many times that of a guess
#: among the learned languages. Text that switches between languages stays.
OVER_CHANCE = 1.2
#: Names of the prediction's columns, which the documents' own must not have.
NAMES = ("__gyre_lang", "__gyre_score", "__gyre_spans")
#: Words of a passage from which its repeats are cut out.
PASSAGE = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is decided. Texts that are null or without letters go."""
    field = language_crf.learn(docs)
    lang, score = (F.col(c) for c in NAMES[:2])
    found = language_crf.identify(docs, field, names=NAMES)
    decided = (lang != language_crf.UNDECIDED) & (score * max(len(field.labels), 1) >= OVER_CHANCE)
    return found.where(decided | (F.lit(len(field.labels) == 1) & (score > 0))).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut boilerplate lines out of the texts. Null texts stay null, and a text may become empty."""
    return _counted(line_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Of a group that of the least identifier stays, one without identifier only where none has one. Rows are told apart
    by identifier and text together, and of rows that are equal in both, one stays. Documents without words are no
    duplicates of each other and stay.
    """
    keys = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")]
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), keys[0].alias("a"), keys[1].alias("b"))
    found = near_duplicates(docs.select(name.alias("name"), "text"), id_col="name", words=5, percent=80)
    kept = found.where("kept").groupBy(F.col("name.a").alias("__gyre_a"), F.col("name.b").alias("__gyre_b")).agg(F.max("n_shingles").alias("__gyre_n"))
    same = Window.partitionBy("__gyre_a", "__gyre_b").orderBy("__gyre_n")
    rows = docs.withColumns({"__gyre_a": keys[0], "__gyre_b": keys[1]}).join(kept, ["__gyre_a", "__gyre_b"])
    rows = rows.withColumn("__gyre_i", F.row_number().over(same))
    return rows.where("__gyre_i = 1 OR __gyre_n = 0").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages out that start earlier in the corpus; documents of which nothing is left go.

    Documents that came without words stay.
    """
    found = substring_dedup(docs, window=PASSAGE, texts=True).where("n_removed > 0")
    found = found.select(
        F.col("doc_id").alias("__gyre_id"),
        F.col("_h").alias("__gyre_h"),
        F.col("kept_text").alias("__gyre_kept"),
        (F.col("n_removed") < F.col("n_words")).alias("__gyre_left"),
    ).distinct()
    keyed = docs.withColumn("__gyre_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__gyre_id"]) & (keyed["__gyre_key"] == found["__gyre_h"]), "left")
    cut = joined.where(F.coalesce("__gyre_left", F.lit(True))).withColumn("text", F.coalesce("__gyre_kept", "text"))
    return _counted(cut.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences; the pieces with their token identifiers. A null text has its end mark alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where it is there and the text is not null, as the text has it now."""
    if "n_chars" not in docs.columns:
        return docs
    now = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return docs.withColumn("n_chars", now.cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("language id", language),
    ("line dedup", lines),
    ("near dedup", near),
    ("substring dedup", passages),
    ("packing", packing),
]
