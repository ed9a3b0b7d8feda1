"""Mixed-script detection and replacement of look-alike letters."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Look-alike letters of other scripts and the Latin letter they imitate, after the public
# Unicode confusables data. Digits and punctuation are left out on purpose: replacing
# them damages codes and amounts.
CYRILLIC = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V",
    "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "l",
    "а": "a", "Ь": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j",
    "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "ѵ": "v", "ԝ": "w",
    "х": "x", "у": "y", "ү": "y",
    "в": "ʙ", "и": "ᴎ", "к": "ĸ", "м": "ᴍ", "н": "ʜ", "т": "ᴛ", "я": "ᴙ",
}
GREEK = {
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "ο": "o", "σ": "o", "ρ": "p", "υ": "u",
    "ν": "v", "γ": "y", "κ": "ĸ", "τ": "ᴛ",
}
ARMENIAN = {
    "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U",
    "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u",
}
SCRIPTS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN}
LOOK_ALIKE = {**CYRILLIC, **GREEK, **ARMENIAN}

# Accented letters of those scripts count through their base letter.
_BLOCKS = (range(0x0370, 0x0590), range(0x1F00, 0x2000))
ACCENTED = {
    chr(cp): base
    for block in _BLOCKS
    for cp in block
    if len(form := unicodedata.normalize("NFKD", chr(cp))) > 1 and (base := form[0]) in LOOK_ALIKE
}


def _letters(script: str) -> str:
    plain = SCRIPTS[script]
    return "".join(plain) + "".join(c for c, base in ACCENTED.items() if base in plain)


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def is_homoglyph_attack(text: Column | str) -> Column:
    """A look-alike letter of another script next to a letter of a second script.

    Text in one script only is never flagged, whatever the script.
    """
    column = _col(text)
    # A plain range test settles nearly every text before the letter lists are tried.
    suspect = column.rlike(r"[\u0370-\u058f\u1f00-\u1fff]")
    mixed = F.lit(False)
    for script in SCRIPTS:
        other = rf"[^\p{{Is{script}}}\p{{IsCommon}}\p{{IsInherited}}]"
        mixed = mixed | (column.rlike(f"[{_letters(script)}]") & column.rlike(other))
    return suspect & mixed


def mixed_script_report(text: Column | str) -> Column:
    """STRUCT<text, is_mixed_script, flagged_chars>, flagged characters in order of occurrence."""
    column = _col(text)
    mixed = is_homoglyph_attack(column)
    # The letters of a text that is not mixed are not listed, so it is not searched for them either.
    searched = F.when(mixed, column).otherwise(F.when(column.isNotNull(), ""))
    folded = F.translate(searched, "".join(ACCENTED), "".join(ACCENTED.values()))
    found = F.array_distinct(
        F.regexp_extract_all(folded, F.lit("[" + "".join(LOOK_ALIKE) + "]"), F.lit(0))
    )

    def describe(char: Column) -> Column:
        script = F.lit(None).cast("string")
        for name, letters in SCRIPTS.items():
            script = F.when(F.lit("".join(letters)).contains(char), name.upper()).otherwise(script)
        return F.struct(
            char.alias("character"),
            script.alias("script"),
            F.translate(char, "".join(LOOK_ALIKE), "".join(LOOK_ALIKE.values())).alias("look_alike"),
        )

    flagged = F.transform(found, describe)
    return F.struct(
        column.alias("text"),
        mixed.alias("is_mixed_script"),
        F.when(mixed, flagged).otherwise(F.slice(flagged, 1, 0)).alias("flagged_chars"),
    )


@F.arrow_udf(T.StringType())
def _decomposed(text: pa.Array) -> pa.Array:
    # A few texts at a time: beside the batch only what comes of it is held whole.
    done = [pa.array([], pa.string())]
    for start in range(0, len(text), 64):
        done.append(pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in text.slice(start, 64).to_pylist()], pa.string()))
    return pa.concat_arrays(done)


def normalize_nfkd(text: Column | str) -> Column:
    """Compatibility decomposition; marks and case are kept. ASCII texts, which it leaves alone, reach Python as nulls only."""
    column = _col(text)
    return F.coalesce(_decomposed(F.when(F.octet_length(column) != F.char_length(column), column)), column)


@F.pandas_udf(T.StringType())
def _replace_normalized(text: pd.Series) -> pd.Series:
    table = str.maketrans(LOOK_ALIKE)

    def fix(t):
        if t is None:
            return None
        return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", t).translate(table))

    return text.map(fix)


def strip_confusables(text: Column | str, *, normalize: str = "full") -> Column:
    """Replace look-alike letters in mixed-script text; other text is returned unchanged.

    ``full`` also decomposes and recomposes the mixed texts, in Arrow batches; the texts
    that are not mixed reach Python only as nulls. ``letters`` stays inside the JVM and
    leaves compatibility characters as they are.
    """
    column = _col(text)
    mixed = is_homoglyph_attack(column)
    if normalize == "full":
        return F.coalesce(_replace_normalized(F.when(mixed, column)), column)
    if normalize != "letters":
        raise ValueError("normalize must be 'full' or 'letters'")
    source = "".join(LOOK_ALIKE)
    return F.when(mixed, F.translate(column, source, "".join(LOOK_ALIKE.values()))).otherwise(column)
