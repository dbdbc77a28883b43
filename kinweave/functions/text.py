"""Normalization of address text as Spark columns.

ASCII values stay on the JVM. Values with other characters need compatibility folding and full case folding, which
Spark lacks; they, and only they, are passed to one Arrow UDF (every other row sends a null through it).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the address contract: letters written alike, digits, abbreviations, and the words before a number.
LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "ۀ": "ه", "ؤ": "و", "إ": "ا", "أ": "ا", "ٱ": "ا"}
DROPPED = "ـ"
BLANKS = "‌‍﻿"
DIGITS = {"۰۱۲۳۴۵۶۷۸۹"[i]: str(i) for i in range(10)} | {"٠١٢٣٤٥٦٧٨٩"[i]: str(i) for i in range(10)}
ABBREVIATIONS = {"st": "street", "bldg": "building", "apt": "unit"}
NUMBER_WORDS = {"building": ("building", "bldg", "ساختمان", "پلاک"), "unit": ("unit", "apt", "واحد")}

_FOLDS = str.maketrans(LETTERS | DIGITS | {DROPPED: ""} | dict.fromkeys(BLANKS, " "))


def fold(value: str | None) -> str | None:
    """Folded letters and numbers of any script, with blanks for everything else; marks vanish."""
    if value is None:
        return None
    kept = []
    for c in unicodedata.normalize("NFKC", value).translate(_FOLDS).casefold():
        kind = unicodedata.category(c)[0]
        if kind != "M":
            kept.append(c if kind in "LN" else " ")
    return "".join(kept)


@F.pandas_udf(T.StringType())
def _fold_all(values: pd.Series) -> pd.Series:
    return values.map(fold, na_action="ignore")


def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit beyond ASCII, and its value, by the Unicode database."""
    digits = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.digit(c)) for c in digits)


def normalize_text(column: str) -> Column:
    """Lower-case words of letters and numbers with abbreviations written out; null gives ''."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    wide = value.rlike(r"[^\x00-\x7F]")
    plain = F.regexp_replace(F.lower(value), "[^a-z0-9]+", " ")
    folded = F.coalesce(_fold_all(F.when(wide, value)), plain)
    words = F.filter(F.split(folded, " +"), lambda w: w != "")
    written = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(written[w], w)), " ")


def number_field(normalized: Column, field: str | None = None) -> Column:
    """The number after one of the field's words, else the only number, else ''; without leading zeros."""
    digits, values = _decimal_digits()
    only = F.regexp_extract_all(normalized, F.lit(r"(\p{Nd}+)"), F.lit(1))
    found = F.when(F.size(only) == 1, only[0]).otherwise(F.lit(""))
    if field is not None:
        if field not in NUMBER_WORDS:
            raise ValueError(f"Unsupported number field: {field}")
        named = F.regexp_extract(normalized, rf"(?:^| )(?:{'|'.join(NUMBER_WORDS[field])}) (\p{{Nd}}+)(?= |$)", 1)
        found = F.when(named != "", named).otherwise(found)
    return F.regexp_replace(F.translate(found, digits, values), "^0+(?=.)", "")


def postcode(normalized: Column) -> Column:
    return F.replace(normalized, F.lit(" "), F.lit(""))


def blank(column: str) -> Column:
    """Null, empty, or nothing but white space of any script."""
    return F.col(column).isNull() | F.col(column).cast("string").rlike(r"^(?U)\s*$")
