"""Filters on span arrays, aggregated rows and detector answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import labels
from maskwright.functions import spans as S
from maskwright.functions.joins import grown
from maskwright.plans.config import MaskConfig

# Surfaces and patterns that a language model's answer must not bring in.
DENIED = (
    "エンジニア|インフラエンジニア|プログラマー|デザイナー|マネージャー|リーダー|部長|課長|社長|CTO|CEO|PM|PL|アルバイト|正社員|フリーランス|コンサルタント|"
    "パスワード|アクセスキー|APIキー|API キー|トークン|認証情報|秘密鍵|公開鍵|ハッシュ|セッション|Cookie|JWT|OAuth|SSH|SSL|HTTPS|HTTP|JSON|YAML|CSS|SQL|Database|API|REST|GraphQL|"
    "プロジェクト|会議|ミーティング|タスク|チケット|レポート|ドキュメント|データ|システム|サーバー|クライアント|ユーザー|メンバー|チーム|部署|組織|営業|経理|開発|人事|総務|"
    "政府|省庁|警察|国税庁|GitHub|Docker|Kubernetes|AWS|GCP|Azure"
).split("|")
DENIED_PATTERNS = ["エンジニア$", "^(?:パス|アクセス)(?:ワード|キー)$", "^.+(?:部長|課長|係長|主任|取締役|社長)$"]


def drop_blocklisted(spans: Column, words: list[str]) -> Column:
    return F.filter(spans, lambda s: ~s["text"].isin(words)) if words else spans


def min_score(spans: Column, least: float) -> Column:
    return F.filter(spans, lambda s: s["score"] >= least) if least > 0 else spans


def enabled_classes(spans: Column, classes: list[str], demoted: Column | None = None) -> Column:
    """Spans whose class is enabled; ``demoted``: surfaces whose proper nouns count as other."""

    def cls(s: Column) -> Column:
        own = labels.classification_for(s["entity_type"])
        return own if demoted is None else F.when((own == "proper_noun") & F.array_contains(demoted, s["text"]), "other").otherwise(own)

    if set(classes) >= {*labels.CLASSES, "other"}:
        return spans
    return F.filter(spans, lambda s: cls(s).isin(classes))


def demoted_surfaces(spans: DataFrame, surface_tokens: DataFrame, pos_patterns: list[list[str]] | None = None) -> DataFrame:
    """(doc_id, demoted): surfaces of proper-noun spans none of whose tokens is a proper noun.

    ``spans``: doc_id, entity_type, text; ``surface_tokens``: surface, pos. Surfaces without tokens are let be.
    """
    match = reduce(lambda a, b: a | b, [F.slice("pos", 1, len(p)) == F.array(*map(F.lit, p)) for p in pos_patterns or [["名詞", "固有名詞"]]])
    judged = surface_tokens.groupBy("surface").agg(F.bool_or(match).alias("proper"))
    own = spans.where(labels.classification_for(F.col("entity_type")) == "proper_noun")
    return own.join(grown(judged.where(~F.col("proper"))), own["text"] == judged["surface"]).groupBy("doc_id").agg(F.collect_set("text").alias("demoted"))


def maskable(spans: Column, allow_types: list[str]) -> Column:
    return F.filter(spans, lambda s: ~s["entity_type"].isin(allow_types)) if allow_types else spans


def action(entity_type: Column, allow_types: list[str]) -> Column:
    return F.when(entity_type.isin(allow_types), "allowed").otherwise("masked") if allow_types else F.lit("masked")


def filtered(spans: Column, cfg: MaskConfig, demoted: Column | None = None) -> Column:
    """Blocklist, score and class filters; the standalone dialect resolves overlaps behind them."""
    out = enabled_classes(min_score(drop_blocklisted(spans, cfg.blocklist), cfg.min_score), cfg.classes, demoted)
    return S.resolve_overlaps(out) if cfg.dialect == "standalone" else out


def action_of(text: Column, masked: Column, enabled: Column) -> Column:
    """masked if the text changed, else no_change."""
    return F.when(enabled & ~text.eqNullSafe(masked), "masked").otherwise("no_change")


def apply_decisions(spans: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Only the spans or rows that a reviewer kept."""
    return spans.join(grown(decisions.select(*keys).distinct()), keys, "left_semi")


def resolve_row_state(rows: DataFrame, forced: DataFrame, allowed: DataFrame, previous: DataFrame, order_col: str = "ord") -> DataFrame:
    """``rows`` (value, category, masked) with masked and locked set.

    Forced categories lock; the allow list unlocks and unmasks; an earlier choice for the value holds unless locked: of
    several the last by ``order_col`` (a column of ``previous``; without it, or in a tie, masked wins).
    """
    f = forced.select("category").distinct().withColumn("__forced", F.lit(True))
    a = allowed.select("value").distinct().withColumn("__allowed", F.lit(True))
    order = F.struct(*([order_col] if order_col in previous.columns else []), "masked")
    p = previous.groupBy("value").agg(F.max_by("masked", order).alias("__before"))
    j = rows.join(f, "category", "left").join(a, "value", "left").join(p, "value", "left")
    locked = F.coalesce("__forced", F.lit(False)) & ~F.coalesce("__allowed", F.lit(False))
    fresh = F.when(F.col("__allowed"), False).when(F.col("__forced"), True).otherwise(F.coalesce("masked", F.lit(True)))
    return j.withColumn("locked", locked).withColumn("masked", F.when(~F.col("locked") & F.col("__before").isNotNull(), F.col("__before")).otherwise(fresh)).drop("__forced", "__allowed", "__before")


def default_uncheck(rows: DataFrame, tier: str) -> DataFrame:
    """Rows below a severity tier start unmasked."""
    below = labels.severity_rank(F.col("severity")) > labels.ORDER.index(tier)
    return rows.withColumn("masked", F.col("masked") & ~below)


def bulk_unmask(rows: DataFrame, category: str | None = None) -> DataFrame:
    """Unmasks a category or all; locked rows don't change and critical ones stay as they are."""
    scope = F.lit(True) if category is None else F.col("category") == category
    return rows.withColumn("masked", F.when(~scope | F.col("locked") | (F.col("severity") == "critical"), F.col("masked")).otherwise(F.lit(False)))


def llm_allowed(text: Column) -> Column:
    """Whether an answer's surface passes the denylist."""
    bad = text.isin(DENIED) | text.rlike("|".join(DENIED_PATTERNS)) | ((F.length(text) <= 3) & text.rlike("^[ぁ-ん]+$")) | ~text.rlike(r"\S")
    return F.coalesce(~bad, F.lit(False))


def llm_denylist(entities: DataFrame, text_col: str = "text") -> DataFrame:
    return entities.where(llm_allowed(F.col(text_col)))
