"""Answers of language models: cleaning, validation and rows, with JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S

from .aggregate import LLM_CATEGORIES, LLM_SEVERITIES, _map

DETECT = "entities array<struct<text:string,entity_type:string,reason:string>>"
REPLACE = "rewritten_text string, replacements array<struct<original:string,replacement:string,entity_type:string>>"


def clean_llm_json(answer: Column) -> Column:
    """The JSON object in an answer, without reasoning blocks, fences and prose; null if there is none."""
    text = answer
    for pattern in (r"(?is)<think>.*?</think>", r"(?is)<think>.*$", r"(?i)^```(?:json)?\s*", r"(?i)\s*```$", r"(?U)^\s+|\s+$"):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""), r"(?U)^\s+|\s+$", "")

    def sliced(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((first > 1) & (last > first) & F.contains(t, F.lit("}")), F.substr(t, first, last - first + 1)).otherwise(t)

    return S.let(S.let(text, sliced), lambda t: F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t))


def parse_llm_detect(answer: Column) -> Column:
    """array<struct<text,entity_type,reason>> of usable entities; null if the answer has no entities array."""
    typed = lambda e: e["text"].rlike(r"\S") & (F.length(e["text"]) < 500) & e["entity_type"].isNotNull()

    def usable(clean: Column) -> Column:
        entities = F.from_json(clean, DETECT)["entities"]
        given = F.schema_of_variant(F.try_variant_get(F.try_parse_json(clean), "$.entities", "variant")).startswith("ARRAY")
        return F.when(given, F.filter(F.coalesce(entities, F.from_json(F.lit('{"entities":[]}'), DETECT)["entities"]), lambda e: F.coalesce(typed(e), F.lit(False))))

    return S.let(clean_llm_json(answer), usable)


def parse_llm_replace(answer: Column) -> Column:
    """struct<rewritten_text, replacements>; null without a rewritten text."""
    return S.let(F.from_json(clean_llm_json(answer), REPLACE), lambda parsed: F.when(F.length(parsed["rewritten_text"]) > 0, parsed))


def llm_status(entities: Column) -> Column:
    return S.let(entities, lambda e: F.when(e.isNull(), "failed").when(F.size(e) == 0, "ok_empty").otherwise("ok_entities"))


def rows_from_replacements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", replacements_col: str = "replacements") -> DataFrame:
    """A row for each replacement that occurs: its first place only, count 1."""
    # the outer generator: before an inner one Spark would put a filter on the array's size, and so read each answer again
    r = df.select(id_col, F.col(text_col).alias("__text"), F.posexplode_outer(replacements_col).alias("ord", "r")).where(F.col("r").isNotNull())
    at = F.call_function("instr", F.col("__text"), F.col("r.original"))
    label = F.upper(F.coalesce("r.entity_type", F.lit("SENSITIVE_FACT")))
    found = r.where(F.length("r.original") > 0).withColumn("at", at - 1).where("at >= 0").withColumn("label", label)
    return found.select(
        id_col, "ord", F.col("r.original").alias("value"), "label", _map(LLM_CATEGORIES | {"EMAIL_ADDRESS": "CONTACT", "PHONE_NUMBER": "CONTACT"}, F.col("label"), "OTHER").alias("category"), F.lit(1).alias("count"),
        F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.length("r.original")).alias("end"))).alias("positions"), F.lit(True).alias("masked"),
        F.coalesce("r.replacement", F.concat(F.lit("<"), "label", F.lit(">"))).alias("placeholder"), F.lit("contextual").alias("classification"), _map(LLM_SEVERITIES | {"EMAIL_ADDRESS": "critical", "PHONE_NUMBER": "high"}, F.col("label"), "medium").alias("severity"),
    )
