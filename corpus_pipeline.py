"""A corpus-cleaning pipeline of five stages over the table of documents.

Each stage takes what its predecessor kept. The first four return the columns of the table of
documents; the last returns the kept documents with their token ids. Stages that run Python lower the
session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` to 2,000, and it stays so: what they return is computed later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm import toxicity
from siftline.llm.common import fresh_name, importable, set_aside, small_batches, stored, table, tokenizer_path
from siftline.llm.line_dedup import dedup_lines
from siftline.llm.lsa_decontam import drop_contaminated
from siftline.llm.sentencepiece_bpe import encode
from siftline.llm.simhash_index import drop_linked

MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from the labelled ones outside the held-out fold.

    A null or empty text is scored like any other, repeated rows alike; an empty table stays empty.
    """
    importable(spark)
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = fresh_name(docs, "_toxicity")
    return toxicity.score(docs, model, out=out).filter(F.col(out) < 0.5).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share (but for the largest id).

    A null text becomes an empty one; further columns come back unchanged, whatever their names.
    """
    free, now = set_aside(docs, "n_lines", "n_dropped", "kept_text")
    kept = dedup_lines(free, min_chars=20, min_docs=3)
    kept = kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*[F.col(now[c]).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Groups are those of the SimHash operator: fingerprints of three-word shingles that differ in three bits or fewer.
    """
    importable(spark)
    small_batches(spark)
    return drop_linked(docs, width=3, seed=42)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts hold none."""
    importable(spark)
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's columns, its token ids, their number and the text decoded from them."""
    importable(spark)
    small_batches(spark)
    return encode(docs, tokenizer_path(MODEL), decoded="decoded").withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the classifier nor the retrieval; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
