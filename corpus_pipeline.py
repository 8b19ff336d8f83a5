"""A corpus pipeline over `documents`: language, near duplicates, benchmark contamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Repeated rows, null columns, empty tables and extra columns are allowed; each function says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveflow.llm import bpe, decontaminate, jaccard, language, personal
from groveflow.llm.components import components
from groveflow.llm.registry import ready, table
from groveflow.session import materialise


def _unpacked(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    return rows.select(*(changed.get(c, F.col("kept")[c]).alias(c) for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (null texts, texts without letters, texts far from every centroid); a
    missing language is filled in."""
    found = language.predict(docs, language.fit(docs), docs.columns, nested=True).where(~F.col("rejected"))
    return _unpacked(found, docs.columns, lang=F.coalesce(F.col("kept")["lang"], "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the smallest doc_id (nulls last), then the smallest text hash.

    Documents without words are similar to nothing and stay; of equal rows one stays.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("kept"),
        "text",
        F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.md5("text").alias("digest"), F.xxhash64(*docs.columns).alias("rest")).alias("key"),
        F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)).alias("wordless"),
    )
    documents, links = jaccard.links(rows.select(F.col("key").alias("doc_id"), "text"))
    named = documents.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = named.join(components(links), F.col("c") == F.col("node"), "left").groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("least").alias("key"))
    keepers = materialise(named.select("key"), "keepers")
    single = rows.where("not wordless").select("kept", "key").join(keepers, "key", "left_semi").dropDuplicates(["key"])
    return _unpacked(single.select("kept").unionByName(rows.where("wordless").select("kept")), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage in at least one of twenty words go. Null texts stay."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    texts = docs.select(digest.alias("digest"), "text")
    found = decontaminate.decontaminate(texts, table(spark, sf_dir, "benchmark"), keep=["digest"])
    bad = materialise(found.where(decontaminate.contaminated()).select("digest").distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("kept"), digest.alias("digest"))
    return _unpacked(rows.join(bad, "digest", "left_anti"), docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become <email>, <ip>, <card>, <phone>; n_chars follows. Other texts, null ones too, are as they were."""
    found = personal.find(docs, personal.fit(docs), docs.columns, nested=True)
    changed = {"text": F.coalesce("redacted", F.col("kept")["text"])}
    if "n_chars" in docs.columns:
        size = F.char_length("redacted").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(size, F.col("kept")["n_chars"])
    return _unpacked(found, docs.columns, **changed)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the SHA-256 of the decoded text."""
    rows = bpe.encode(docs)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal),
    ("tokens", encode_tokens),
]

#: Similarity joins, a fitted classifier and message passing have no SQL form; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder before the next."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
