"""SQL views over the input tables, in text both Spark and an ANSI engine can run.

The tables hold no invisible characters, look-alike letters, one-time codes, registry
numbers, shorteners or garbled mail, so ``messages`` adds one such signal to each whole
document, by turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


MESSAGES = """
SELECT doc_id AS message_id,
       CASE CAST(doc_id % 12 AS INT)
         WHEN 0 THEN concat(text, ' verification code ', CAST(100000 + doc_id AS STRING))
         WHEN 1 THEN concat(text, ' verification code')
         WHEN 2 THEN concat(text, ' Mersis No: ', lpad(CAST(doc_id AS STRING), 16, '0'))
         WHEN 3 THEN concat(text, ' https://bit.ly/x', CAST(doc_id AS STRING), '.')
         WHEN 4 THEN concat(text, ' bit.ly/x', CAST(doc_id AS STRING), ' bit.ly/x', CAST(doc_id AS STRING))
         WHEN 5 THEN concat(text, ' https://shop.example.com/a https://shop.example.com/a')
         WHEN 6 THEN translate(text, 'aeo', 'аео')
         WHEN 7 THEN replace(text, 'e', 'e\u200b')
         WHEN 8 THEN concat(text, ' casino')
         WHEN 9 THEN concat(text, ' =3C=2F')
         WHEN 10 THEN concat(text, ' Mersis:0123456789 bit.ly/z')
         ELSE text
       END AS text,
       lang, source, doc_id * 7 AS seconds
FROM {documents}
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, text, lang, source, ts. ``ts`` counts seven seconds per document."""
    from pyspark.sql import functions as F

    view = spark.sql(MESSAGES, documents=documents(spark, sf_dir))
    start = 1704067200  # 2024-01-01
    return view.withColumn("ts", F.timestamp_seconds(F.lit(start) + F.col("seconds"))).drop("seconds")
