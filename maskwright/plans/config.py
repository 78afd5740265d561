"""Settings of a masking run; lists become literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults.
BLOCKLIST = (
    "プロジェクト メンバー チーム マネージャー リーダー ユーザー クライアント サーバー システム データ ファイル フォルダ フォルダー レポート ミーティング タスク チケット "
    "スケジュール ドキュメント アカウント パスワード メッセージ スタッフ カスタマー オフィス ミーティングルーム"
).split()
CLASSES = ["proper_noun", "contact", "identifier", "credential", "attribute", "other"]
FORCE_CATEGORIES = ["PERSON", "ORGANIZATION", "FINANCIAL"]


@dataclass(frozen=True)
class MaskConfig:
    """``dialect`` gateway: resolve overlaps, then filter; standalone: filter, then resolve, with ASCII word borders.

    ``overlap`` reference leaves partial overlaps to the tag mask (fragments of placeholders may show);
    disjoint masks only the longest-first disjoint spans.
    """

    filter_enabled: bool = True
    strategy: str = "tag"
    dialect: str = "gateway"
    overlap: str = "reference"
    allow_types: list[str] = field(default_factory=list)
    presets: bool = True
    disabled: list[str] = field(default_factory=list)
    regex_patterns: list[list[str]] = field(default_factory=list)
    blocklist: list[str] = field(default_factory=lambda: list(BLOCKLIST))
    min_score: float = 0.0
    classes: list[str] = field(default_factory=lambda: list(CLASSES))
    chains: dict[str, list[str]] | None = None
    ja_threshold: float = 0.2
    prefer_surname: bool = False
    pos_patterns: list[list[str]] = field(default_factory=lambda: [["名詞", "固有名詞"]])
    force_keywords: list[str] = field(default_factory=list)
    force_categories: list[str] = field(default_factory=lambda: list(FORCE_CATEGORIES))
