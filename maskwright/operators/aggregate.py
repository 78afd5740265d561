"""Per-surface summaries of detection tables, roll-ups, and joins with forced categories, lists and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import labels
from maskwright.functions import spans as S
from maskwright.functions.joins import grown

from .detect import occurrences

# Categories and severities of a language model's entity types.
LLM_CATEGORIES = {"PERSON": "PERSON", "COMPANY": "ORGANIZATION", "LOCATION": "LOCATION", "CREDENTIAL": "CREDENTIAL"}
LLM_SEVERITIES = {"PERSON": "critical", "COMPANY": "critical", "LOCATION": "high", "DEPARTMENT": "medium", "PROJECT_CODE": "medium", "CREDENTIAL": "critical", "SENSITIVE_FACT": "high"}
ROW = ["value", "label", "category", "count", "positions", "masked", "placeholder", "classification", "severity"]


def aggregate_entities(detections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each (document, surface), ``ord`` giving the order of first arrival.

    The label is that of the lowest start (then one with a category, then first arrival); equal spans count once;
    numbers run over all detections of a label, so rows dropped as phrases leave gaps. One shuffle, by document.
    """
    whose = Window.partitionBy(id_col, "entity_type", "text")
    rows = detections.repartition(id_col).withColumn("__first", F.min(F.struct("start", "end")).over(whose))
    rows = rows.withColumn("__n", F.dense_rank().over(Window.partitionBy(id_col, "entity_type").orderBy("__first")))
    known = F.when(labels.category_for(F.col("entity_type")) == "OTHER", 1).otherwise(0)
    best = F.min_by(F.struct("entity_type", "__n"), F.struct("start", known, "seq"))
    grouped = rows.groupBy(id_col, F.col("text").alias("value")).agg(
        best.alias("b"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("positions"), F.bool_or(F.col("action") == "masked").alias("masked"), F.min("seq").alias("ord")
    )
    label, value = F.col("b.entity_type"), F.col("value")
    out = grouped.select(
        id_col, "ord", "value", label.alias("label"), labels.category_for(label).alias("category"), F.size("positions").alias("count"), "positions", "masked",
        F.concat(F.lit("<"), label, F.lit("_"), F.col("b.__n").cast("string"), F.lit(">")).alias("placeholder"), labels.classification_for(label).alias("classification"), labels.severity_for_surface(label, value).alias("severity"),
    )
    return out.where(~(F.col("label").isin("PERSON", "PROPER_NOUN_PERSON") & labels.is_false_positive_person(F.col("value"))))


def entity_summary(spans: Column) -> Column:
    """map<type, count> of a span array."""
    counted = lambda types: F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(t.alias("key"), F.size(F.filter(types, lambda u: u == t)).alias("value"))))
    return S.let(F.transform(spans, lambda s: s["entity_type"]), counted)


def category_rollup(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, category, rows, occurrences, severity, ord): categories in order of their first row."""
    return rows.groupBy(id_col, "category").agg(F.count("*").alias("rows"), F.sum("count").alias("occurrences"), labels.max_severity(F.col("severity")).alias("severity"), F.min("ord").alias("ord"))


def detection_count(docs: DataFrame, spans_col: str = "spans") -> DataFrame:
    return docs.agg(F.coalesce(F.sum(F.size(spans_col)), F.lit(0)).cast("long").alias("detections"))


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("rows"))


def apply_force_mask(rows: DataFrame, forced: Column) -> DataFrame:
    """Rows whose category is in the array ``forced`` become masked."""
    return rows.withColumn("masked", F.col("masked") | F.coalesce(F.array_contains(forced, F.col("category")), F.lit(False)))


def _map(values: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(other))


def llm_rows(answers: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of a model's entities (doc_id, idx, text, entity_type): distinct trimmed values that occur, with all places."""
    value = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    first = answers.withColumn("value", value).where(F.col("value") != "").groupBy(id_col, "value").agg(F.min_by("entity_type", "idx").alias("entity_type"), F.min("idx").alias("idx"))
    label = F.upper(F.coalesce("entity_type", F.lit("SENSITIVE_FACT")))
    found = first.join(grown(docs.select(id_col, F.col("text").alias("__text"))), id_col).withColumn("label", label)
    found = found.withColumn("spans", S.literal_spans(S.safe(F.col("__text")), F.col("value"), F.col("label"))).where(F.size("spans") > 0)
    n = F.row_number().over(Window.partitionBy(id_col, "label").orderBy("idx"))
    return found.select(
        id_col, F.col("idx").alias("ord"), "value", "label", _map(LLM_CATEGORIES, F.col("label"), "OTHER").alias("category"), F.size("spans").alias("count"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("positions"), F.lit(True).alias("masked"),
        F.concat(F.lit("<"), "label", F.lit("_"), n.cast("string"), F.lit(">")).alias("placeholder"), F.lit("contextual").alias("classification"), _map(LLM_SEVERITIES, F.col("label"), "medium").alias("severity"),
    )


def merge_llm(rows: DataFrame, answers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The model's rows first, then those of ``rows`` whose surface it did not name; ``source`` tells them apart."""
    rest = rows.join(grown(answers.select(id_col, "value")), [id_col, "value"], "left_anti")
    cols = [id_col, "ord", *ROW]
    return answers.select(*cols, F.lit(0).alias("source")).unionByName(rest.select(*cols, F.lit(1).alias("source")))


def recompute(rows: DataFrame, docs: DataFrame, entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows taken apart into spans, without those of earlier force lists, joined with the list's spans and summed up again."""
    kept = rows.where(~F.col("label").startswith("USER_DEFINED_")).select(id_col, F.col("ord").cast("long").alias("k"), F.posexplode("positions").alias("j", "p"), "label", "value", "masked")
    base = kept.select(
        id_col, "k", "j", F.col("label").alias("entity_type"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("value").alias("text"), F.when(F.col("masked"), "masked").otherwise("allowed").alias("action")
    )
    hits = occurrences(docs, entries, id_col).select(id_col, F.posexplode("found").alias("j", "x"))
    more = hits.select(id_col, (F.col("x.k") + (1 << 40)).alias("k"), "j", F.col("x.label").alias("entity_type"), "x.start", "x.end", "x.text", F.lit("masked").alias("action"))
    item = F.struct("k", "j", S.span(F.col("entity_type"), F.col("start"), F.col("end"), F.lit(1.0), F.col("text")).alias("s"), "action")
    every = base.unionByName(more).groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("x"))
    spans = every.select(id_col, "x", F.posexplode_outer(S.resolve_overlaps(S.numbered(F.transform("x", lambda x: x["s"])))).alias("seq", "s")).where(F.col("s").isNotNull())
    detections = spans.select(id_col, "seq", "s.entity_type", "s.start", "s.end", "s.text", F.element_at("x", F.col("s.seq") + 1)["action"].alias("action"))
    return aggregate_entities(detections, id_col)


def new_entries(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Entries (value, category) that were not there before."""
    named = lambda df: df.select("value", F.coalesce("category", F.lit("OTHER")).alias("category"))
    return named(current).join(named(previous), ["value", "category"], "left_anti")
