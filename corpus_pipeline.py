"""A training corpus from documents: language ID, near-duplicates, benchmark decontamination, PII, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and all but the last return the
columns of docs, which may be more than those of documents and may have any names; doc_id, text and lang are read. In
all stages repeated rows are rows of their own, texts of any length are read whole, and no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, neardup, pii, sentencepiece
from lodestone.llm.common import materialise
from lodestone.llm.queries import TOKENIZER
from lodestone.session import ship

#: Cosines of unrelated vectors scatter about zero by 1 / sqrt(dimensions): three times that is no language's. A text
#: of fewer letters tells too little to be rejected by it.
LEAST_COSINE = 3 / langid.DIMENSIONS**0.5
LEAST_LETTERS = 60


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them), and those of LEAST_LETTERS letters and more
    whose cosine with every learned language is below LEAST_COSINE. Learns from the rows with text and lang that may
    teach; of equal cosines the language that sorts first counts, and with nothing learned nothing is kept."""
    ship(spark)
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(docs.columns)], "text")
    labelled = langid.predict(own, langid.learn(langid.teaching(docs)))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & ((F.col("score") >= LEAST_COSINE) | (letters < LEAST_LETTERS))
    return labelled.where(kept).select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: that of the least doc_id (null first), then the first in the
    table. Documents without words (null, empty, blank) are classes of their own and stay."""
    ship(spark)
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts hold none and stay. An empty
    benchmark drops nothing."""
    ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in text; n_chars follows, if there is one. Null and empty texts stay as they are, and of
    overlapping spans the first names the mask."""
    ship(spark)
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, lossless of every document left. A null text has null ids and no tokens, the
    empty text no ids; of equal segmentations that with the longest last pieces is taken."""
    ship(spark)
    return sentencepiece.round_trip(docs, sentencepiece.read_model(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", tokens),
]

#: Language profiles, signatures and BPE have no SQL: tests/llm/test_pipeline.py compares the stages with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
