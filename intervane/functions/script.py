"""Script shares of a text and the language they suggest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kana; Han with extension A; thresholds.
KANA = r"[\x{3040}-\x{30FF}]"
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
MIN_LETTERS, MIN_KANA, BILINGUAL_KANA, BILINGUAL_HAN = 200, 0.10, 0.55, 0.30


def counts(text: Column) -> Column:
    """struct<kana, han, other long>: letters by script; marks, signs and spaces do not count, nor letters beyond the basic plane."""
    plain = F.regexp_replace(text, r"[\p{P}\p{S}\p{Z}\p{C}]", "")
    n = lambda p: F.coalesce(F.regexp_count(plain, F.lit(p)), F.lit(0)).cast("long")
    return F.struct(n(KANA).alias("kana"), n(HAN).alias("han"), n(r"[\p{L}&&[^\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{10000}-\x{10FFFF}]]").alias("other"))


def classify(kana: Column, han: Column, letters: Column) -> Column:
    """kana, han: shares; letters: their total."""
    return F.when(letters < MIN_LETTERS, "Unknown").when(kana < MIN_KANA, "NoJapanese").when((kana < BILINGUAL_KANA) & (han > BILINGUAL_HAN), "Multilingual").otherwise("JapaneseOnly")
