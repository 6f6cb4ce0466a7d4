"""TXT — cleaning model output as one projection over a replies table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def clean_replies(df: DataFrame, col: str = "reply") -> DataFrame:
    """Every cleaning column in one projection (stays inside whole-stage codegen)."""
    c = F.col(col)
    parsed = X.json_loose(c)
    return df.select(
        "*",
        X.strip_fences(c).alias("no_fences"),
        X.strip_sql(c).alias("sql"),
        X.one_line(c).alias("one_line"),
        F.try_variant_get(parsed, "$.score", "string").alias("json_score"),
        X.first_line(c, F.lit("EmptyReply")).alias("first_line"))


def tool_calls(df: DataFrame, col: str = "reply") -> DataFrame:
    """Tool calls written as text: unwrap ``<tool_call>`` tags or code fences (one that
    is never closed reaches to the end), accept one object or an array, flat
    (``name``/``arguments``) or nested (``function.name``/``function.arguments``), with
    ``parameters`` as another name of the arguments, which are an object or JSON text of
    one; anything else, or nothing, is ``{}``. Calls without a name are dropped; prose
    yields no call."""
    text = X.strip(F.col(col))

    def inside(opening: str, closing: str):
        return F.substring_index(F.substr(text, F.instr(text, opening) + F.lit(len(opening))), closing, 1)

    body = X.strip(F.when(text.contains("<tool_call>"), inside("<tool_call>", "</tool_call>"))
                   .when(text.contains("```json"), inside("```json", "```")).when(text.contains("```"), inside("```", "```")).otherwise(text))
    v = F.try_parse_json(F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).when(body.startswith("["), body))
    items = df.select("*", F.posexplode_outer(F.try_variant_get(v, "$", "array<variant>")).alias("call_no", "item"))
    nested = F.schema_of_variant(F.try_variant_get("item", "$.function", "variant")).startswith("OBJECT")
    fn = F.when(nested, F.try_variant_get("item", "$.function", "variant")).otherwise(F.col("item"))
    items = items.withColumn("_fn", fn)
    name = F.try_variant_get("_fn", "$.name", "string")
    given = F.coalesce(F.try_variant_get("_fn", "$.arguments", "variant"), F.try_variant_get("_fn", "$.parameters", "variant"))
    as_text = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get(given, "$", "string"))).otherwise(given)
    args = F.when(F.schema_of_variant(as_text).startswith("OBJECT"), F.to_json(as_text)).otherwise(F.lit("{}"))
    return items.where(name.isNotNull() & (name != "")).select(*df.columns, "call_no", name.alias("tool"), args.alias("arguments"))
