"""Detector plug-ins, registered SQL functions and a table function."""

from __future__ import annotations

import re
from itertools import chain
from typing import Protocol

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import labels


class Detector(Protocol):
    """Anything that gives the spans of a text Column; models wrap a pandas UDF that returns array<struct>.

    ``mask.sanitize`` takes any number of them as ``detectors`` and calls them by name in the chains of the settings.
    """

    name: str

    def spans(self, text: Column) -> Column: ...


_QUOTED = re.compile(r"('(?:[^'\\\\]|\\\\.|'')*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(and|or|not|[-+*/%<>=!&|^]+)\(")

_DOUBLE = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def as_sql(column: Column) -> str:
    """The SQL text of a Column: operators, which a Column shows in front of their arguments, become function names."""
    shown = repr(column).removeprefix("Column<'").removesuffix("'>")
    return "".join(part if k % 2 else _DOUBLE.sub(r"\1D", _OPERATOR.sub(r"`\1`(", part)) for k, part in enumerate(_QUOTED.split(shown)))


class Detect:
    """The table function: a row for each span of the default chain, given out text by text. As a query of its own, Spark would join
    its rows back by whole texts, and send all of them to every executor."""

    def __init__(self):
        from maskwright.plans.config import MaskConfig

        from . import presets

        self.cfg = cfg = MaskConfig()
        self.find = presets.rows_of(cfg.dialect)
        self.severities, classes = labels.flat(labels.SEVERITIES), labels.flat(labels.CLASSES)
        self.enabled = lambda label: classes.get(label, "other") in cfg.classes

    def eval(self, t: str):
        for label, start, end, text in self.find(t):
            if text not in self.cfg.blocklist and self.enabled(label):
                yield label, start, end, text, self.severities.get(label, "low")


def register(spark: SparkSession) -> None:
    """SQL functions detect_language(text), severity_for(label), category_for(label), classification_for(label),
    sanitize_text(text, strategy) with the strategies tag, partial, hash and surrogate (any other counts as tag, as in
    the original tool), and the table
    function detect(text): entity_type, start, end, text, severity of the default chain's spans."""
    from maskwright.operators import detect, mask
    from maskwright.plans.config import MaskConfig

    cfg, t = MaskConfig(), F.col("t")
    define = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    define("detect_language(t STRING) RETURNS STRING", as_sql(detect.detect_language(t)))
    for name, groups, other in (("severity_for", labels.SEVERITIES, "low"), ("category_for", labels.CATEGORIES, "OTHER"), ("classification_for", labels.CLASSES, "other")):
        pairs = ", ".join(f"'{x}'" for x in chain(*labels.flat(groups).items()))
        define(f"{name}(label STRING) RETURNS STRING", f"coalesce(try_element_at(map({pairs}), label), '{other}')")
    spark.udf.register("masked_text", mask.masker_of_texts(cfg, "tag"))
    spark.udtf.register("detect", F.udtf(Detect, returnType="entity_type string, start int, end int, text string, severity string", useArrow=False))
    define("sanitize_text(t STRING, strategy STRING DEFAULT 'tag') RETURNS STRING", "masked_text(t, strategy)")
