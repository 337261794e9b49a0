"""The corpus pipeline: language ID, near-dedup, repeat removal, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir). All but the last
return the columns of ``documents``, and no others, whatever ``docs`` has besides; every stage's rows
are written as Parquet in the shared folder and read again as the next one's documents. An empty
table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmine.llm import decontam, langid, minhash, packing, suffix_dedup
from specmine.llm.common import crc_mod, materialize
from specmine.llm.queries import read, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null text and text without a letter goes. Repeated rows
    are judged each; rows with a null id are judged like others."""
    sample = langid.sample_by_language(docs, learn=crc_mod(F.col("doc_id"), 3) != 1)
    known = langid.identify(docs.select(*COLUMNS), sample, out_cols=("_lang", "_score"))
    return known.where(F.col("_lang") != langid.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: of repeated rows one, and
    one with a null id only where a group has no other. Texts without words stay, each."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur in a document of smaller id; a document of which
    nothing is left goes. Characters that a passage's edge cuts go with it. Rows of one id keep what they
    share with each other; a null id stands behind all others. Null texts stay null."""
    left = suffix_dedup.remove_repeats(docs, keep=["lang", "source", "n_chars"])
    changed = F.size("spans") > 0
    plain = F.col("kept").cast("string")

    @F.pandas_udf("string")
    def whole_characters(kept):
        return kept.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    text = F.when(F.col("row._null_text"), F.lit(None).cast("string")).when(F.is_valid_utf8(plain), plain).otherwise(whole_characters(F.when(~F.is_valid_utf8(plain), F.col("kept"))))
    out = left.where(~changed | (F.length("kept") > 0)).select("doc_id", text.alias("text"), "row.lang", "row.source", changed.alias("_changed"), F.col("row.n_chars").alias("n_chars"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("_changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item; repeated rows and null ids are judged
    like others, null and empty texts stay."""
    return decontam.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: where it stands in which sequence, and its tokens' checksum. Repeated rows
    are packed each, a null id like any other; a null or empty text is its end token."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path(), with_ids=False), packing.most_pieces(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None  # language ID, the tokenizer and packing have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
