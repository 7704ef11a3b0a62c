"""A corpus pipeline over documents: each stage is one operator, and works on what the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of documents. run() writes each result as Parquet into the shared folder and
reads it again, so that a lost executor costs one stage at most.

What holds in all stages: texts are read whole, however long; an empty table gives an
empty one; columns other than doc_id, text and lang are carried along, whatever their
names; a row without an id is decided like any other. What a stage does with nulls,
empty texts, ties and repeated rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm._store import col, discard, release, stored
from docsieve.llm.bpe import bpe_round_trip
from docsieve.llm.decontamination import contamination
from docsieve.llm.language_id import fit_languages, held_in, identify
from docsieve.llm.line_dedup import BLANK, dedup_lines
from docsieve.llm.ngram_join import ngram_components
from docsieve.llm.queries import tokenizer_file

#: No SQL: language identification and BPE cannot be put in SQL.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected.

    These are texts that are null, empty or without a letter, and ties between languages.
    Repeated rows are decided alike. Without a learned language every text is rejected.
    """
    learned = fit_languages(docs.where(held_in("doc_id")))
    return identify(docs, learned).where("not rejected").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of all texts but the one of the smallest id that holds them.

    What is left blank goes, and so do later exact copies, with short lines too. A text
    that loses no line stays as it is, a null or an empty one included. Rows that share
    an id are one document and lose no lines to each other. Rows without an id are kept.
    """
    out = dedup_lines(docs, copies=True).where((F.col("n_dropped") == 0) | (~F.col("copy") & (F.btrim("kept", F.lit(BLANK)) != "")))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group linked by 0.8 of five-word shingles, and one row of each id.

    Of rows that share an id, the one whose content has the smallest hash stays. A row
    without an id is a document of its own, and comes after those that have one. Null,
    empty and wordless texts link with nothing and stay.
    """
    columns = [col(c) for c in docs.columns]
    nameless = docs.where("doc_id is null")
    if nameless.limit(1).count():
        last = docs.agg(F.max("doc_id")).first()[0] or 0
        numbered = stored(nameless.withColumn("doc_id", F.lit(last + 1).cast("long") + F.monotonically_increasing_id()))
        kept = near_duplicate_stage(spark, docs.where("doc_id is not null").unionAll(numbered.select(*columns)), sf_dir)
        return kept.withColumn("doc_id", F.when(F.col("doc_id") <= last, F.col("doc_id")))
    groups = ngram_components(docs, k=5, num=80, den=100)
    kept = docs.join(groups.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*columns)
    twice = stored(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if not twice.limit(1).count():
        return kept
    row = F.struct(*columns)
    one = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("one"))
    return kept.join(twice, "doc_id", "left_anti").select(*columns).unionAll(one.select("one.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of ten words of the benchmark, or a whole item of fewer.

    Null and empty texts hold none and stay. Of rows that share an id, all go if one holds
    a passage; a row without an id goes by its text. Items that are null hold nothing.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)))
    found = contamination(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    found = found.select(F.col("id").alias("found")).distinct()
    return docs.join(found, key == found["found"], "left_anti").select(*[col(c) for c in docs.columns])


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document as packed unsigned 32-bit integers, with the digest of the decoded text.

    A null or empty text has no ids. Repeated rows are encoded alike, each on its own.
    """
    out = bpe_round_trip(docs, tokenizer_file())
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
        release(spark)
    return docs
