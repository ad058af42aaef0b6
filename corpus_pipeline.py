"""Five stages from raw documents to token ids: language, near-duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`. Rows with repeated or null ids, null texts and
empty tables pass through every stage as the operators' own notes say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_encode
from tidemark.llm.common import cut, fresh_folder, release, table, with_and_without
from tidemark.llm.graph import salted_join
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.langid import fit_languages, held_out_part, identify_languages
from tidemark.llm.mixing import mix_documents, mixed_copies
from tidemark.llm.pii import disclosing_spans, sanitised

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has less than this share of the posterior is rejected.
LEAST_SCORE = 0.5
#: So is one whose letters are less likely than this on average in its best language (natural logarithm): about half of them
#: then belong to no piece that the language was seen with. Texts in a learned language stand between -2 and -4.
LEAST_PER_LETTER = -9.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; the language column becomes the recognised one."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    langs, probs = fit_languages(docs.filter(~held_out_part(F.col("doc_id"))).select("doc_id", "text", "lang"), path)
    seen = identify_languages(docs, langs, probs, path, keep=("doc_id", "text", "source", "n_chars"))
    return seen.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("per_letter") >= LEAST_PER_LETTER)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def with_row_key(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with a number of their own, `_row`: written once, so that it stays the same however often it is read."""
    folder = fresh_folder(spark, "pipeline-rows")
    docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")).write.parquet(folder)
    return spark.read.parquet(folder)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id, null last. Texts are linked, whatever their ids."""
    release(spark)
    rows = with_row_key(spark, docs)
    groups = jaccard_components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    groups = cut(groups.join(rows.select("_row", "doc_id"), "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("_row")))
    stays = groups.groupBy("component_id").agg(first.alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("component_id", F.col("first._row").alias("_stays"))
    gone = cut(salted_join(groups, stays, ["component_id"], ["_row"]).filter("_row <> _stays").select("_row"))
    maybe, stay = with_and_without(rows, "_row", gone)
    return maybe.join(gone, "_row", "left_anti").unionByName(stay).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that give it away, by placeholders."""
    release(spark)
    clean = sanitised(docs.select(*COLUMNS), disclosing_spans(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them several times, until the sources stand in their target proportions."""
    release(spark)
    rows = with_row_key(spark, docs)
    return mixed_copies(rows, mix_documents(rows, key="_row"), key="_row").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and a digest of the text they decode to."""
    release(spark)
    out = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixture),
    ("bpe_encoding", encoded),
]

#: SQL cannot express the trained and iterative stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = fresh_folder(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
