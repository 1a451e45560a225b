"""Text analysis: lower case, letters only, stop words, stems.

Everything but stemming is a Column expression. Stems are taken of distinct words, in vectorised
batches, and joined back, so the Python part sees each word once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stemmers import STEMMERS

#: Letters that a language keeps; others keep every letter.
LETTERS = {"spanish": "a-záéíóúüñ", "english": "a-z"}


@lru_cache(8)
def stop_words(language: str) -> tuple[str, ...]:
    """Spark's own list for the language; none for "simple" and languages without one."""
    from pyspark.ml.feature import StopWordsRemover

    known = ("danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish")
    return tuple(sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(language)})) if language in known else ()


def letters_only(text: Column, language: str) -> Column:
    kept = LETTERS.get(language, "\\p{L}")
    return F.regexp_replace(F.lower(text), f"[^{kept}\\s]", " ")


def plain_tokens(text: Column, language: str) -> Column:
    """Words of two letters or more that are no stop words, repeats kept."""
    words = F.split(F.trim(letters_only(F.coalesce(text, F.lit("")), language)), "\\s+")
    stops = stop_words(language)
    long_enough = F.filter(words, lambda w: F.length(w) > 1)
    return F.filter(long_enough, lambda w: ~w.isin(*stops)) if stops else long_enough


@F.pandas_udf(StringType())
def _stem(words: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([STEMMERS[lang](w) for w, lang in zip(words, language, strict=True)])


def stemmed(words: DataFrame, column: str, language: str) -> DataFrame:
    """The rows with each word replaced by its stem; the stemmer runs once per distinct word."""
    if language not in STEMMERS:
        return words
    stems = words.select(column).distinct().withColumn("_stem", _stem(column, F.lit(language)))
    return words.join(stems, column).withColumn(column, F.col("_stem")).drop("_stem")


def query_tokens(text: str, language: str) -> list[str]:
    """The same analysis of a query, on the driver."""
    kept = LETTERS.get(language)
    low = text.lower()
    low = re.sub(f"[^{kept}\\s]", " ", low) if kept else "".join(ch if ch.isalpha() or ch.isspace() else " " for ch in low)
    stops, stem = set(stop_words(language)), STEMMERS.get(language, lambda w: w)
    return [stem(w) for w in low.split() if len(w) > 1 and w not in stops]
