"""The labelled corpora: how each is found, read and mapped to records."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.operators.dedup import SEQ, file_path, file_position
from siftline.schema import BILGILENDIRME, SPAM, record_columns, strip
from siftline.sources.files import first_file, list_files, positional, read_labelled_csv

# Raw label spellings. Everything that is not spam counts as information.
SPAM_HAM = {
    "spam": SPAM,
    "1": SPAM,
    "ham": BILGILENDIRME,
    "normal": BILGILENDIRME,
    "legitimate": BILGILENDIRME,
    "0": BILGILENDIRME,
}


def labels_named(*names: str) -> dict[str, str]:
    return {n: SPAM_HAM[n] for n in names}


@dataclass(frozen=True)
class SourceSpec:
    """A corpus: folder name, preferred file types, column candidates, label map, language."""

    name: str
    lang: str
    label_map: Mapping[str, str]
    text_columns: Sequence[str] = ()
    label_columns: Sequence[str] = ()
    extensions: Sequence[str] = ("csv",)
    separators: Sequence[str] = (",",)
    headerless_tsv: bool = False
    label_folders: Mapping[str, str] = field(default_factory=dict)
    split_files: bool = False
    drop_null_labels: bool = False
    drop_nan_text: bool = True
    positional_extensions: Sequence[str] = ()


# The known corpora, their columns and labels, in merge order.
SOURCES = (
    SourceSpec(
        name="turkish_sms_collection",
        lang="tr",
        label_map=labels_named("spam", "normal", "legitimate", "ham"),
        text_columns=("message", "text", "sms", "mesaj", "icerik", "İçerik"),
        label_columns=("grouptext", "group", "label", "grup", "class", "etiket", "durum"),
        separators=(",", ";"),
    ),
    SourceSpec(
        name="turkish_spam_dataset",
        lang="tr",
        label_map=labels_named("spam", "ham", "normal", "legitimate", "1", "0"),
        text_columns=("text", "email", "message", "icerik", "İçerik", "mesaj"),
        label_columns=("label", "category", "class", "etiket", "spam"),
        extensions=("parquet", "csv"),
        positional_extensions=("parquet",),
        drop_null_labels=True,
    ),
    SourceSpec(
        name="sms_spam_collection",
        lang="en",
        label_map=labels_named("spam", "ham", "legitimate"),
        text_columns=("v2", "text", "message", "sms"),
        label_columns=("v1", "label", "class", "category"),
        headerless_tsv=True,
    ),
    SourceSpec(
        name="enron_spam",
        lang="en",
        label_map=labels_named("spam", "ham", "legitimate"),
        text_columns=("text", "message", "body", "email"),
        label_columns=("label", "class", "category"),
        label_folders=labels_named("spam", "ham"),
    ),
    SourceSpec(
        name="turkishsms_ds",
        lang="tr",
        label_map=labels_named("legitimate", "spam"),
        split_files=True,
        drop_nan_text=False,
    ),
)


def map_label(raw: Column, label_map: Mapping[str, str]) -> Column:
    """Label of a raw spelling, ignoring case and surrounding space; null when unknown."""
    lookup = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair])
    return F.try_element_at(lookup, F.lower(strip(raw)))


class NoLabelFolders(ValueError):
    """A folder has no text files below folders named after labels."""


def unmapped_labels(df: DataFrame, label_map: Mapping[str, str]) -> DataFrame:
    """Every label without a mapping: label (lower case, trimmed, null as ``nan``) and its records."""
    raw = F.lower(strip(F.coalesce(F.col("label"), F.lit("nan"))))
    unknown = df.filter(map_label(raw, label_map).isNull())
    return unknown.groupBy(raw.alias("label")).agg(F.count(F.lit(1)).alias("records"))


def check_labels(df: DataFrame, label_map: Mapping[str, str], *, dataset_name: str) -> None:
    """Fail when a label has no mapping, naming all such labels."""
    values = unmapped_labels(df, label_map).agg(F.array_join(F.array_sort(F.collect_list("label")), ", ")).first()[0]
    if values:
        raise ValueError(f"{dataset_name}: labels without a mapping: {values}")


def to_records(
    df: DataFrame,
    *,
    name: str,
    lang: str,
    label_map: Mapping[str, str],
    drop_null_labels: bool = False,
    drop_nan_text: bool = True,
    check: bool = True,
) -> DataFrame:
    """Raw (text, label) rows as records with stripped text; blank and null text is dropped.

    Labels are checked first, over all rows, in one narrow pass that reads only the label.
    With ``check=False`` an unknown label fails the job when its row is reached instead.
    """
    if drop_null_labels:
        df = df.na.drop(subset=["label"])
    mapped = map_label(F.coalesce(F.col("label"), F.lit("nan")), label_map)
    if check:
        check_labels(df, label_map, dataset_name=name)
    else:
        mapped = F.coalesce(mapped, F.raise_error(F.concat(F.lit(f"{name}: label without a mapping: "), F.coalesce(F.col("label"), F.lit("null")))))
    text = strip("text")
    keep = text.isNotNull() & (text != "")
    if drop_nan_text:
        keep = keep & (F.lower(text) != "nan")
    seq = [SEQ] if SEQ in df.columns else []
    return df.withColumn("label", mapped).filter(keep).select(*record_columns(text, F.col("label"), F.lit(name), F.lit(lang)), *seq)


def read_label_folders(spark: SparkSession, root: str, folders: Mapping[str, str], *, name: str, lang: str) -> DataFrame:
    """Text files directly inside folders named after a label, at any depth; one file is one row.

    Undecodable bytes become replacement characters. Files elsewhere are ignored.
    """
    files = (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt").load(root)
        .select("value", file_path().alias("path"), file_position().alias(SEQ))
    )
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    tagged = files.select(
        strip(F.make_valid_utf8("value")).alias("text"), map_label(parent, folders).alias("label"), SEQ,
    ).filter(F.col("label").isNotNull())
    if tagged.isEmpty():
        raise NoLabelFolders(f"{name}: {root} has no text files below {sorted(folders)}")
    return tagged.filter(F.col("text") != "").select(
        *record_columns(F.col("text"), F.col("label"), F.lit(name), F.lit(lang)), SEQ
    )


def read_split_files(spark: SparkSession, folder: str, columns: Sequence[str] = ("text", "label")) -> DataFrame:
    """Union of all split files of a dataset, further columns ignored."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.parquet(folder).select(*columns, file_position().alias(SEQ))


def load_source(spark: SparkSession, spec: SourceSpec, path: str) -> DataFrame:
    """Records of one corpus from a file or folder."""
    mapping = {
        "name": spec.name, "lang": spec.lang, "label_map": spec.label_map,
        "drop_null_labels": spec.drop_null_labels, "drop_nan_text": spec.drop_nan_text,
    }
    extension = path.rsplit(".", 1)[-1].lower()
    if spec.split_files:
        return to_records(read_split_files(spark, path), **mapping)
    if spec.label_folders and extension != "csv":
        try:
            return read_label_folders(spark, path, spec.label_folders, name=spec.name, lang=spec.lang)
        except NoLabelFolders:
            csv = first_file(spark, path, ("csv",))
            if csv is None:
                raise
            path = csv
    if extension in spec.positional_extensions:
        raw = positional(spark.read.parquet(path).select("*", file_position().alias(SEQ)))
    else:
        raw = read_labelled_csv(
            spark, path, text_columns=spec.text_columns, label_columns=spec.label_columns,
            dataset_name=spec.name, separators=spec.separators, headerless_tsv=spec.headerless_tsv,
        )
    return to_records(raw, **mapping)


def available_sources(
    spark: SparkSession,
    raw_dir: str,
    *,
    specs: Sequence[SourceSpec] = SOURCES,
    skip: Sequence[str] = (),
) -> dict[str, Callable[[], DataFrame]]:
    """Loader per corpus present under ``raw_dir/<name>``; absent ones are skipped with a notice."""
    found: dict[str, Callable[[], DataFrame]] = {}
    for spec in specs:
        folder = f"{raw_dir.rstrip('/')}/{spec.name}"
        if spec.name in skip:
            path = None
        elif spec.split_files:
            path = folder if not list_files(spark, folder, "*.parquet", recursive=True).isEmpty() else None
        elif spec.label_folders:
            path = folder if not list_files(spark, folder, recursive=True).isEmpty() else None
        else:
            path = first_file(spark, folder, spec.extensions)
        if path is None:
            warnings.warn(f"[skip] {spec.name}: nothing to read under {folder}")
            continue
        found[spec.name] = lambda s=spec, p=path: load_source(spark, s, p)
    return found
