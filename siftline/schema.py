"""Record schema, label and language sets, validation and label indexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

OTP = "otp"
REKLAM = "reklam"
SPAM = "spam"
BILGILENDIRME = "bilgilendirme"

# The closed label set, the language set, and the class order.
LABELS = (OTP, REKLAM, SPAM, BILGILENDIRME)
LANGS = ("tr", "en")
MODEL_LABELS = (BILGILENDIRME, REKLAM, SPAM)

RECORD_COLUMNS = ("text", "label", "source", "lang", "extra")
EXTRA_TYPE = T.MapType(T.StringType(), T.StringType())
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("extra", EXTRA_TYPE),
    ]
)
DECISION_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("original_label", T.StringType()),
        T.StructField("original_source", T.StringType()),
        T.StructField("method", T.StringType()),
    ]
)

# The characters treated as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column | str) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITESPACE))


def empty_extra() -> Column:
    return F.create_map().cast(EXTRA_TYPE)


def record_columns(text, label, source, lang, extra: Column | None = None) -> list[Column]:
    """Projection of arbitrary columns into the record shape."""
    return [
        text.alias("text"),
        label.alias("label"),
        source.alias("source"),
        lang.alias("lang"),
        (extra if extra is not None else empty_extra()).alias("extra"),
    ]


def rejection_reason(
    *, labels: Sequence[str] = LABELS, langs: Sequence[str] = LANGS
) -> Column:
    """Why a record is invalid, or null. Reads columns text, label, lang."""
    return (
        F.when(F.coalesce(strip("text"), F.lit("")) == "", "blank text")
        .when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "unknown label")
        .when(~F.coalesce(F.col("lang").isin(*langs), F.lit(False)), "unknown lang")
    )


def validate(
    df: DataFrame, *, labels: Sequence[str] = LABELS, langs: Sequence[str] = LANGS
) -> DataFrame:
    """Strict validation: text is stripped and an invalid record fails the job."""
    reason = rejection_reason(labels=labels, langs=langs)
    checked = F.when(
        reason.isNotNull(), F.raise_error(F.concat(F.lit("invalid record: "), reason))
    ).otherwise(strip("text"))
    return df.withColumn("text", checked)


def validate_split(
    df: DataFrame, *, labels: Sequence[str] = LABELS, langs: Sequence[str] = LANGS
) -> tuple[DataFrame, DataFrame]:
    """Lenient validation: (valid rows with stripped text, rejected rows with a reason)."""
    tagged = df.withColumn("reason", rejection_reason(labels=labels, langs=langs))
    valid = tagged.filter(F.col("reason").isNull()).drop("reason").withColumn("text", strip("text"))
    return valid, tagged.filter(F.col("reason").isNotNull())


def label_index(label: Column | str, labels: Sequence[str] = MODEL_LABELS) -> Column:
    """Stable integer id of a label by position; null for labels outside the set."""
    column = F.col(label) if isinstance(label, str) else label
    result = F.when(column == labels[0], 0)
    for i, name in enumerate(labels[1:], start=1):
        result = result.when(column == name, i)
    return result


def label_of(index: Column | str, labels: Sequence[str] = MODEL_LABELS) -> Column:
    """Inverse of :func:`label_index`."""
    column = F.col(index) if isinstance(index, str) else index
    return F.get(F.array(*[F.lit(x) for x in labels]), column.cast("int"))


def with_message_id(df: DataFrame, *, id_col: str = "message_id", text_col: str = "text", content_hash: bool = False) -> DataFrame:
    """Fill missing ids: a random uuid, or a content hash for replayable jobs."""
    fresh = F.sha2(F.col(text_col), 256) if content_hash else F.expr("uuid()")
    given = F.col(id_col) if id_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(id_col, F.coalesce(given.cast("string"), fresh))
