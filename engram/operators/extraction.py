"""Stage 1: sentences to candidate facts by an ordered table of patterns, as column expressions.

The first pattern that matches a sentence (and whose object is usable) wins, one fact per sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import HEDGE, normalise, sentence_kind, sentences, strip_punctuation

#: Fixed values: (pattern, predicate, kind of the object, confidence), in order of precedence.
PATTERNS: tuple[tuple[str, str, str | None, float], ...] = (
    (r"\bich\s+(?:bin|war)\s+(?:gerade\s+)?nach\s+(.+?)\s+(?:um)?gezogen\b", "wohnt_in", "ort", 0.85),
    (r"\bich\s+ziehe\s+nach\s+(.+?)(?:\s+um)?$", "wohnt_in", "ort", 0.85),
    (r"\bich\s+wohne\s+(?:jetzt\s+|inzwischen\s+|mittlerweile\s+)?in\s+(.+)$", "wohnt_in", "ort", 0.85),
    (r"\bich\s+lebe\s+(?:jetzt\s+|inzwischen\s+)?in\s+(.+)$", "wohnt_in", "ort", 0.85),
    (r"\bi\s+(?:have\s+)?moved\s+to\s+(.+)$", "wohnt_in", "ort", 0.85),
    (r"\bi\s+live\s+in\s+(.+)$", "wohnt_in", "ort", 0.85),
    (r"\bich\s+arbeite\s+(?:jetzt\s+|inzwischen\s+)?(?:bei|für)\s+(.+)$", "arbeitet_bei", "organisation", 0.85),
    (r"\bmein\s+arbeitgeber\s+ist\s+(.+)$", "arbeitet_bei", "organisation", 0.85),
    (r"\bich\s+habe\s+(?:bei|zu)\s+(.+?)\s+angefangen\b", "arbeitet_bei", "organisation", 0.85),
    (r"\bi\s+work\s+(?:at|for)\s+(.+)$", "arbeitet_bei", "organisation", 0.85),
    (r"\bich\s+hei(?:ß|ss)e\s+(.+)$", "heisst", "person", 0.85),
    (r"\bmy\s+name\s+is\s+(.+)$", "heisst", "person", 0.85),
    (r"\bich\s+bin\s+(?:gerade|zurzeit|zur\s+zeit|momentan|aktuell)\s+(?:in\s+)?(.+)$", "status", None, 0.85),
    (r"\bi\s+am\s+(?:currently|right\s+now)\s+(?:on\s+|in\s+)?(.+)$", "status", None, 0.85),
    (r"\bich\s+mag\s+kein(?:e|en|em)?\s+(.+)$", "mag_nicht", None, 0.85),
    (r"\bich\s+(?:trinke|esse)\s+kein(?:e|en|em)?\s+(.+)$", "mag_nicht", None, 0.85),
    (r"\bich\s+(?:trinke|esse)\s+(?:aber\s+)?kein(?:e|en|em)?\s+(.+)$", "mag_nicht", None, 0.85),
    (r"\bkein(?:e|en)?\s+(.+?)\s+(?:mehr\s+)?für\s+mich\b", "mag_nicht", None, 0.85),
    (r"\bi\s+(?:do\s+not|don't|dont)\s+(?:like|drink|eat)\s+(.+)$", "mag_nicht", None, 0.85),
    (r"\bich\s+mag\s+(?:am\s+liebsten\s+|vor\s+allem\s+|nur\s+)?(.+)$", "mag", None, 0.85),
    (r"\bich\s+(?:trinke|esse)\s+(?:am\s+liebsten|gerne?|nur)\s+(.+)$", "mag", None, 0.85),
    (r"\bich\s+liebe\s+(.+)$", "mag", None, 0.85),
    (r"\bi\s+(?:like|love|prefer)\s+(.+)$", "mag", None, 0.85),
    (r"\bich\s+habe\s+(?:einen|eine|ein)\s+(.+)$", "hat", None, 0.85),
    (r"\bi\s+have\s+(?:a|an)\s+(.+)$", "hat", None, 0.85),
    (r"\bich\s+bin\s+(?:seit\s+\S+\s+)?(.+)$", "ist", None, 0.8),
    (r"\bi\s+(?:am|'m)\s+(.+)$", "ist", None, 0.8),
)
#: What asks to forget, by precedence.
REVOCATIONS: tuple[str, ...] = (
    r"\bvergiss(?:\s+bitte)?,?\s+was\s+ich\s+(?:dir\s+)?(?:über|zu)\s+(.+?)\s+(?:gesagt|erzählt)",
    r"\b(?:vergiss|streich|lösch(?:e)?)\s+(?:bitte\s+)?(?:alles\s+(?:über|zu)\s+)?(?:meine[nrs]?\s+|die\s+|das\s+|den\s+)?(.+?)\s*$",
    r"\bforget\s+(?:what\s+i\s+(?:said|told\s+you)\s+about\s+)?(?:my\s+)?(.+?)\s*$",
)
#: Topic words (folded) and the predicates that they stand for.
TOPICS: dict[str, tuple[str, ...]] = {
    "arbeitgeber": ("arbeitet_bei",), "arbeit": ("arbeitet_bei",), "job": ("arbeitet_bei",), "firma": ("arbeitet_bei",), "employer": ("arbeitet_bei",),
    "work": ("arbeitet_bei",), "wohnort": ("wohnt_in",), "adresse": ("wohnt_in",), "address": ("wohnt_in",), "zuhause": ("wohnt_in",), "name": ("heisst",),
    "essen": ("mag", "mag_nicht", "ist"), "ernahrung": ("mag", "mag_nicht", "ist"), "diet": ("mag", "mag_nicht", "ist"), "food": ("mag", "mag_nicht", "ist"),
    "getranke": ("mag", "mag_nicht"), "kaffee": ("mag", "mag_nicht"),
}
#: How a fact is worded, and objects that say nothing.
WORDING = {"wohnt_in": "Wohnt in %s.", "arbeitet_bei": "Arbeitet bei %s.", "heisst": "Heißt %s.", "mag": "Mag %s.", "mag_nicht": "Mag kein %s.", "hat": "Hat %s.", "ist": "Ist %s.", "status": "Ist zurzeit %s."}
EMPTY_OBJECTS = ("das", "es", "dies", "hier", "da", "so", "it", "that", "this")
#: Predicates of passing states.
TEMPORARY = ("status",)
MAX_OBJECT, MAX_CONTENT, REVOKED, HEDGED = 120, 500, 0.9, 0.25
#: Month names (folded).
MONTHS = {
    "januar": 1, "january": 1, "februar": 2, "february": 2, "marz": 3, "maerz": 3, "march": 3, "april": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "juli": 7, "july": 7,
    "august": 8, "september": 9, "oktober": 10, "october": 10, "november": 11, "dezember": 12, "december": 12,
}
#: Texts of stored decisions.
REVOCATION_TEXT = "Widerruf: Angaben zu „%s“ sollen vergessen werden."


def _flagged(pattern: str) -> str:
    return f"(?iuU){pattern}"


def _usable(found: Column) -> Column:
    return (found != "") & ~F.lower(found).isin(*EMPTY_OBJECTS) & (F.length(found) <= MAX_OBJECT)


def objects(sentence: Column) -> Column:
    """What each pattern finds, in their order; empty where it doesn't match."""
    return F.transform(F.array(*[F.regexp_extract(sentence, _flagged(p), 1) for p, *_ in PATTERNS]), strip_punctuation)


def assertion(sentence: Column, found: Column) -> Column:
    """Struct (predicate, object, object_kind, content, confidence) of the first pattern with a usable object, or null."""
    at = F.array_position(F.transform(found, _usable), True).cast("int")
    column = lambda k: F.element_at(F.array(*[F.lit(p[k]).cast("double" if k == 3 else "string") for p in PATTERNS]), at)
    hedged = F.regexp_like(sentence, F.lit(_flagged(rf"\b(?:{HEDGE})\b")))
    wording = F.create_map(*[F.lit(x) for pair in WORDING.items() for x in pair])
    content = F.replace(F.try_element_at(wording, column(1)), F.lit("%s"), F.element_at(found, at))
    confidence = F.when(hedged, F.round(F.greatest(F.lit(0.1), column(3) - HEDGED), 2)).otherwise(column(3))
    return F.when(at > 0, F.struct(column(1).alias("predicate"), F.element_at(found, at).alias("object"), column(2).alias("object_kind"), content.alias("content"), confidence.alias("confidence")))


def revocation(sentence: Column) -> Column:
    """Topic that the sentence asks to forget, or null."""
    tried = []
    for pattern in REVOCATIONS:
        topic = strip_punctuation(F.regexp_extract(sentence, _flagged(pattern), 1))
        tried.append(F.when((topic != "") & ~F.lower(topic).isin(*EMPTY_OBJECTS), topic))
    return F.coalesce(*tried)


def revoked_predicates(topic_folded: Column) -> Column:
    words = F.regexp_extract_all(topic_folded, F.lit(r"(?U)(\w+)"), F.lit(1))
    table = F.create_map(*[x for word, predicates in TOPICS.items() for x in (F.lit(word), F.array(*map(F.lit, predicates)))])
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), none)))))


def since(sentence: Column, folded: Column, reference: Column) -> Column:
    """Start of validity from "seit März", "since May 2021", "seit 2019": date, or null. Without a year the last such month."""
    month_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    tried = []
    for pattern in (r"\bseit\s+(?:dem\s+)?(\w+)(?:\s+(\d{4}))?", r"\bsince\s+(\w+)(?:\s+(\d{4}))?"):
        token, year = F.regexp_extract(folded, _flagged(pattern), 1), F.regexp_extract(folded, _flagged(pattern), 2)
        month = F.try_element_at(month_of, token)
        this = F.make_date(F.year(reference), month, F.lit(1))
        no_year = F.when(this > reference, F.make_date(F.year(reference) - 1, month, F.lit(1))).otherwise(this)
        dated = F.when(year != "", F.make_date(year.try_cast("int"), month, F.lit(1))).otherwise(no_year)
        tried.append(F.when(F.regexp_like(token, F.lit(r"^\d{4}$")), F.make_date(token.try_cast("int"), F.lit(1), F.lit(1))).when(month.isNotNull(), dated))
    return F.coalesce(*tried)


def extract(turns: DataFrame) -> DataFrame:
    """``turn_id, place, sentence, kind, reason`` and the candidate's columns, one row per sentence of every turn.

    ``turns``: turn_id, role, content, occurred_at. ``reason`` is null for candidates, else why the sentence isn't one.
    """
    rows = turns.select("turn_id", "role", "occurred_at", F.posexplode(sentences(F.col("content"))).alias("place", "sentence"))
    rows = rows.withColumns({"kind": sentence_kind(F.col("sentence")), "topic": revocation(F.col("sentence")), "objects": objects(F.col("sentence")), "folded": normalise("sentence")})
    rows = rows.withColumn("found", assertion(F.col("sentence"), F.col("objects")))
    refused = F.when(F.col("role") != "user", "nicht selbst gesagt").when(F.col("kind") == "question", "ist eine Frage").when(F.col("kind") == "greeting", "nur ein Gruß oder Dank")
    content = F.when(F.col("topic").isNotNull(), F.format_string(REVOCATION_TEXT, "topic")).otherwise(F.col("found.content"))
    rows = rows.withColumn("content", F.when(refused.isNull(), content)).withColumn("refused", refused)
    nth = F.row_number().over(Window.partitionBy("turn_id", F.lower("content")).orderBy("place"))
    reason = F.coalesce("refused", F.when(F.col("content").isNull(), "kein Muster passt").when((F.col("nth") > 1) & F.col("topic").isNull(), "im selben Turn schon gesagt"))
    revoked = F.col("topic").isNotNull()
    return rows.withColumn("nth", nth).withColumn("reason", reason).select(
        "turn_id", "place", "sentence", "kind", "reason", F.when(F.col("reason").isNull(), F.col("content")).alias("content"), F.when(revoked, "retract").otherwise("assert").alias("op_hint"),
        F.when(~revoked, F.col("found.predicate")).alias("predicate"), F.coalesce(~revoked & F.col("found.predicate").isin(*TEMPORARY), F.lit(False)).alias("temporary"), F.when(~revoked, F.col("found.object")).alias("object"), F.when(~revoked, F.col("found.object_kind")).alias("object_kind"),
        F.when(revoked, F.lit(REVOKED)).otherwise(F.col("found.confidence")).alias("confidence"), since(F.col("sentence"), F.col("folded"), F.col("occurred_at").cast("date")).alias("valid_from"), "topic",
    )
