"""Business memos made from orders: sentences with the values that the presets look for, at any scale.

The same templates render to a Spark Column and to SQL, so that oracles see the same texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    "k": (lambda: F.col("o_orderkey").cast("string"), "CAST(o_orderkey AS VARCHAR)"),
    "k7": (lambda: F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), "lpad(CAST(o_orderkey AS VARCHAR), 7, '0')"),
    "k4": (lambda: F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), "lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')"),
    "k8": (lambda: F.lpad(F.col("o_orderkey").cast("string"), 8, "1"), "lpad(CAST(o_orderkey AS VARCHAR), 8, '1')"),
    "c": (lambda: F.col("o_custkey").cast("string"), "CAST(o_custkey AS VARCHAR)"),
    "c4": (lambda: F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), "lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')"),
    "p": (lambda: F.floor("o_totalprice").cast("string"), "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"),
    "d": (lambda: F.date_format("o_orderdate", "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
    "h": (lambda: F.md5(F.col("o_orderkey").cast("string")), "md5(CAST(o_orderkey AS VARCHAR))"),
    "h2": (lambda: F.sha2(F.col("o_orderkey").cast("string"), 256), "sha256(CAST(o_orderkey AS VARCHAR))"),
    "a": (lambda: (F.col("o_custkey") % 90 + 10).cast("string"), "CAST(o_custkey % 90 + 10 AS VARCHAR)"),
}
LINES = [
    "住所は 兵庫県明石市大久保町{a} です。 年齢 {a} 歳 、 性別は 女性 で、 血液型は AB型 。",
    "東京都渋谷区 に転居、 {a}才 の 男性 、 担当は ヤマダハナコ さん。",
    "合計 ¥{p} と {p} 円 と $ {p}.50 の 請求書番号: {k}-001 です。",
    "契約日 {d} 、 令和 5 年 4 月 1 日 に 株式会社アクメ{a} の田中部長から。",
    "Sold by Acme{a} Inc. from 10.0.{a}.{a} via https://shop.example.com/o/{k}?token=x{k7} today.",
    "番号 1234 5678 {k4} と 口座 普通口座番号:{k7} です。",
    "免許証 12-34-5678{a}-12 旅券 AB{k7} の確認。",
    "conn postgresql://user:pw@db.example.com/{k} and DB_NAME=orders_{k} here",
    "key: sk-{h} and api_key-{h} and sk_live_{h} set",
    "password = pw{h} and token: {h2}",
    "ghp_{h}abcd and xoxb-{h} and AKIA{k8}ABCDEFGH end",
    "key-{h} AC{h} SK{h} hf_{h}ab npm_{h}abcd fw_{h} end",
    "eyJ{h}.eyJ{h}.{h} Bearer {h} next",
    "Authorization: Basic{h} x-api-key: {h2}",
    "-----BEGIN RSA PRIVATE KEY-----\n{h}\n{h2}\n-----END RSA PRIVATE KEY----- done",
    "glpat-{h} ntn_{h}abcdefgh gsk_{h}abcdefgh r8_{h}abcde whsec_{h} pplx-{h} tvly-{h}",
    "lin_api_{h} figd_{h}abcdefgh cf-{h}abcdefgh sk-or-v1-{h}abcdefgh sk-proj-{h} ya29.{h}abcdefgh AIza{h}abc",
    "PRJ-{k4}x and EMP-{k4} and TICKET-{k4} and STAFF-{k4}",
    "call 03-{c4}-{k4} or 090{k8} or 0120({a}){k4}",
    "mail user{c}@example.com and sales.{c}@mail.example.co.jp now",
    "郵便 〒651-{k4} と 100-{k4} まで",
    "DEPT-{a} DIVISION_{k4} 部署コード: A{k4} 部門コード={c}",
    "CONTRACT-{k7} AGR_{k4} 契約番号: K{k} 契約No.: {k}",
    "ORDER-{k7} PO_{k7} P.O.-{k4} 発注番号:{k}",
    "CUST-{c4} CLT_{c4} 顧客コード: {c}",
    "INV-{k7} INVOICE_{k4} 請求No: {k}",
    "社員番号: {c} 従業員ID={c4} WORKER-{k4}",
    "会員番号: {c} MEMBER-{c4} 患者番号: {c} MRN-{c4} PATIENT_{k4}",
    "SKU-{k7} 製品コード: P{k} 商品番号={k}",
    "希望年収{a}00万円 と 月収 {a} 万円 です",
    "特許 2020-{k7} US {k7} JP{k8} の件",
    "ASSET-{k4} FA_{k4} 資産番号: {k} LIC-{k7} LICENSE_{k4}",
    "佐藤 と 鈴木 が 神奈川県 の 横浜市 へ、 千葉県 の 千葉市 から",
    "アメリカ と 日本 と インドネシア の 市場  Japan  and  New Zealand  or  Japanese  goods",
    "Mr  John  wrote to  Mary  about  Thomas  and  Johnson  in  Germany",
    "CONFIDENTIAL: leak of the offer {k} for user{c}@example.com",
    "このプロジェクトは進行中 、 メンバー は プロジェクト と スケジュール を確認",
    "機密 の資料 {k} を 長谷川 に送付、 エンジニアリング 部門",
    "nothing to see in order number {k} of customer {c}",
    "取引先 アクメ{a}株式会社 と Beta{a}LLC と Gamma{a}Ltd. の件",
    "sk-ant-api03-{h}{h}{h} and secret_{h}abcdefghijk and github_pat_{h}{h}{h} set",
    "SG.abcdefghijklmno{k7}.{h}abcdefghijk and patabcdefg{k7}.{h2} and Mabcdefghijklmnop{k7}.abcdef.{h} end",
    "two mails user{c}@example.com user{c}@example.com and user{a}@example.com",
]
STEPS = (0, 7, 13, 22)


def _pieces(line: str) -> list[str]:
    return re.split(r"\{(\w+)\}", line)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(line: str) -> str:
    return " || ".join(FIELDS[p][1] if k % 2 else quoted(p) for k, p in enumerate(_pieces(line)) if p)


def text_column() -> Column:
    """Four lines of each order: the templates are picked first, then filled with the fields, each worked out once."""
    templates = F.array(*map(F.lit, LINES))
    picked = F.concat_ws("\n", *[F.element_at(templates, ((F.col("o_orderkey") + s) % len(LINES) + 1).cast("int")) for s in STEPS])
    return reduce(lambda text, name: F.replace(text, F.lit(f"{{{name}}}"), FIELDS[name][0]()), FIELDS, picked)


#: How many times larger memos are than the rows that they are made from, about.
LARGER = 16


def spread(df: DataFrame, larger: int = 1) -> DataFrame:
    """An input dealt out before its rows are made ``larger``: to all cores at least, and so that no task gets more than a split of a file would hold."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, splits * larger)) if splits < cores or larger > 1 else df


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): four lines for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return spread(orders, LARGER).select(F.col("o_orderkey").alias("doc_id"), text_column().alias("text"))


_PICK = " || chr(10) || ".join(f"l[CAST((o_orderkey + {s}) % {len(LINES)} + 1 AS INTEGER)]" for s in STEPS)
SQL = f"SELECT o_orderkey AS doc_id, {_PICK} AS text FROM (SELECT o_orderkey, [{', '.join(map(_sql, LINES))}] AS l FROM orders)"
