"""Text functions: built-in expressions, and one vectorised UDF for what has none (casefold and NFKD)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_TERMS = 24
#: Texts that a task holds folded at once.
AT_ONCE = 256
#: How sentences are told apart.
GREETING = (
    "hallo|hi|hey|guten\\s+(?:morgen|tag|abend)|moin|servus|danke|dankeschön|ok(?:ay)?|alles\\s+klar|bis\\s+später|tschüss|ciao|hello|thanks|thank\\s+you|bye"
)
HEDGE = "vielleicht|eventuell|ich\\s+glaube|ich\\s+denke|womöglich|maybe|i\\s+think|probably"


def fold(text: str) -> str:
    """Casefolded, decomposed, without combining marks, stripped."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).strip()


@F.pandas_udf(StringType())
def normalise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:  # folded texts leave in small pieces, whatever the size of a batch
        for at in range(0, len(texts), AT_ONCE):
            yield texts.iloc[at : at + AT_ONCE].map(fold, na_action="ignore")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Cut after ``.!?`` and white space or at line feeds; trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\w{2,})"), F.lit(1))


def terms(text: Column, most: int = MAX_TERMS) -> Column:
    """Distinct lower-cased tokens in order, at most ``most`` (the feature's limit)."""
    return F.slice(F.array_distinct(F.transform(tokens(text), F.lower)), 1, most)


def or_query(text: Column) -> Column:
    return F.array_join(terms(text), " or ")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[\s.,;:!?]+$", "")


def token_estimate(text: Column) -> Column:
    """Rounded-up quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def like_any(text: Column, needles: list[str]) -> Column:
    """Whether any of the literal needles occurs, whatever the case; wildcards in a needle stand for themselves."""
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(F.lower(text), F.lower(F.lit(needle)))
    return found


def matches(needle: Column, text: Column) -> Column:
    """``re:`` needles are patterns (any case, per line), others substrings in any case."""
    pattern = F.concat(F.lit("(?imu)"), F.substring(needle, F.lit(4), F.length(needle)))
    return F.when(F.startswith(needle, F.lit("re:")), F.regexp_like(text, pattern)).otherwise(F.contains(F.lower(text), F.lower(needle)))


def sentence_kind(sentence: Column) -> Column:
    return (
        F.when(F.endswith(sentence, F.lit("?")), "question")
        .when(F.regexp_like(sentence, F.lit(rf"(?iuU)^(?:{GREETING})\b")), "greeting")
        .when(F.regexp_like(sentence, F.lit(rf"(?iuU)\b(?:{HEDGE})\b")), "hedged")
        .otherwise("plain")
    )


def content_ref(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, digits)
