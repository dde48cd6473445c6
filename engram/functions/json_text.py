"""JSON texts: redaction that keeps the shape, objects in model answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that a redacted text keeps, and levels that are searched for ids.
MAX_DEPTH, LEVELS = 32, 4


_KEY, _TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:', r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf"({_KEY}|{_TEXT}|[{{}}\[\],]|[^\s{{}}\[\],\":]+)"


def redact(text: Column | str) -> Column:
    """JSON text with all leaves null; keys (in their order) and lengths stay. Values below MAX_DEPTH levels are null.

    Null, what isn't JSON and an object that repeats a key become null, so nothing is left of what can't be read.
    """
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.regexp_extract_all(text, F.lit(f"(?s){_TOKEN}"), F.lit(1))
    is_key = lambda t: F.startswith(t, F.lit('"')) & F.endswith(t, F.lit(":"))
    kept = lambda t: F.when(t == ",", ", ").when(is_key(t), F.concat(F.regexp_replace(t, r"\s*:$", ""), F.lit(": "))).when(t.isin("{", "}", "[", "]"), t).otherwise("null")

    def step(acc: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        inside = acc["depth"] + opens.cast("int")
        told = F.when(inside <= MAX_DEPTH, kept(t)).when(opens & (inside == MAX_DEPTH + 1), "null").otherwise("")
        return F.struct((inside - closes.cast("int")).alias("depth"), F.concat(acc["told"], told).alias("told"), F.greatest(acc["most"], inside).alias("most"))

    shallow = F.array_join(F.transform(tokens, kept), "")
    opened = F.size(F.filter(tokens, lambda t: t.isin("{", "[")))
    deep = F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.lit("").alias("told"), F.lit(0).alias("most")), step, lambda acc: acc["told"])
    # the parser stops after a first value; only one value fits both into a list and into an object
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.when(one & (F.size(tokens) > 0), F.when(opened <= MAX_DEPTH, shallow).otherwise(deep))


def named_ids(steps: DataFrame, json: str, names: tuple[str, ...], key: str = "step_id", levels: int = LEVELS) -> DataFrame:
    """``<key>, id``: whole numbers anywhere in a JSON column under one of the ``names`` (or in a list under it), each once.

    Level by level through the VARIANT's members, without Python and without a schema; a member of a list goes by the
    list's name. Members below ``levels`` aren't read. What isn't JSON, or repeats a key, names nothing.
    """
    return each_named_id(steps, json, names, key, levels).distinct()


def each_named_id(steps: DataFrame, json: str, names: tuple[str, ...], key: str = "step_id", levels: int = LEVELS) -> DataFrame:
    """The same as often as it is named, so without a shuffle. A text is read once; what is found goes along to the last level."""
    spark = steps.sparkSession
    level = steps.select(F.col(key).alias("_key"), F.lit(None).cast("string").alias("_name"), F.try_parse_json(F.col(json)).alias("_value"), F.lit(None).cast("long").alias("_id")).filter("_value IS NOT NULL")
    for _ in range(levels):
        members = spark.sql("SELECT _key, coalesce(m.key, _name) AS _name, m.value AS _value, _id FROM {level}, LATERAL variant_explode_outer(_value) AS m", level=level)
        kind = F.schema_of_variant("_value")
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        found = F.when(F.col("_name").isin(*names) & (kind == "BIGINT"), F.variant_get("_value", "$", "bigint"))
        level = members.select("_key", "_name", F.when(nested, F.col("_value")).alias("_value"), F.coalesce("_id", found).alias("_id")).filter("_id IS NOT NULL OR _value IS NOT NULL")
    return level.filter("_id IS NOT NULL").select(F.col("_key").alias(key), F.col("_id").alias("id"))


def model_object(text: Column) -> Column:
    """The JSON object in a model's answer: fenced, or between the outermost braces; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(outer)
    return F.when((found != "") & F.get_json_object(found, "$").isNotNull(), found)
