"""Keywords in a text that force categories to be masked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.joins import grown


def _ascii(keywords: list[str]) -> tuple[list[str], list[str]]:
    return [k for k in keywords if k.isascii()], [k for k in keywords if not k.isascii()]


def fired(text: Column, keywords: list[str]) -> Column:
    """array<string>: ASCII keywords found in any letter case, then the others found as they are (substring mode)."""
    latin, other = _ascii(keywords)
    hits = [F.when(F.contains(F.lower(text), F.lit(k.lower())), F.lit(k)) for k in latin] + [F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in other]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def fired_by_tokens(docs: DataFrame, tokens: DataFrame, keywords: list[str], id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``fired``: ASCII keywords by substring, the others only within tokens that are nouns."""
    latin, other = _ascii(keywords)
    out = docs.withColumn("__latin", fired(F.col("text"), latin))
    if not other:
        return out.withColumnRenamed("__latin", "fired")
    holds = [F.contains(F.col("surface"), F.lit(k)) for k in other]
    hits = tokens.where(F.col("pos")[0] == "名詞").select(id_col, "surface").where(reduce(lambda a, b: a | b, holds))
    per = hits.groupBy(id_col).agg(*[F.bool_or(h).alias(f"__{n}") for n, h in enumerate(holds)])
    per = per.select(id_col, F.array_compact(F.array(*[F.when(F.col(f"__{n}"), F.lit(k)) for n, k in enumerate(other)])).alias("__other"))
    return out.join(grown(per), id_col, "left").withColumn("fired", F.concat("__latin", F.coalesce("__other", F.array().cast("array<string>")))).drop("__latin", "__other")


def forced_categories(hits: Column, categories: list[str]) -> Column:
    """All configured categories, each once and in order, if a keyword fired."""
    return F.when(F.size(hits) > 0, F.array_distinct(F.array(*map(F.lit, categories)))).otherwise(F.array().cast("array<string>"))
