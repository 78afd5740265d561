"""Deterministic fake values of the same type: integer arithmetic on a 32-bit hash of label and surface, as a Column and for a single value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, firms and places to pick from, and number ranges of each type.
PERSONS = ["佐藤健太", "鈴木美咲", "高橋翔", "田村彩香", "伊藤雄介", "渡辺結衣", "山本大輝", "中村楓", "小林拓海", "加藤さくら", "John Doe", "Jane Smith", "Alex Kim", "Maria Garcia"]
FIRMS = ["株式会社サンプル商事", "合同会社テスト技研", "株式会社架空ホールディングス", "有限会社ダミー産業", "株式会社仮名コンサルティング"]
PLACES = ["東京都千代田区丸の内1-1-1", "大阪府大阪市北区梅田2-2-2", "神奈川県横浜市西区みなとみらい3-3-3"]
NETWORKS = ["192.0.2", "198.51.100", "203.0.113"]
NUMBERED = {
    "EMPLOYEE_ID": ("EMP-", 90000, 10000), "MEMBER_ID": ("MEM-", 900000, 100000), "CUSTOMER_ID": ("CUST-", 90000, 10000), "CONTRACT_NUMBER": ("CT-", 900000, 100000),
    "PURCHASE_ORDER": ("PO-", 9000000, 1000000), "INVOICE_NUMBER": ("INV-", 900000, 100000), "PATIENT_ID": ("PAT-", 90000, 10000),
}
MASK = 0xFFFFFFFF


def hash32(text: Column) -> Column:
    """Multiply-by-33-and-xor over UTF-16 units, as an unsigned number."""
    units = F.filter(F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G.{4})"), lambda u: u != "")
    return F.aggregate(units, F.lit(5381).cast("long"), lambda h, u: (h * 33).bitwiseAND(F.lit(MASK)).bitwiseXOR(F.conv(u, 16, 10).cast("long")))


def _shift(seed: Column, n: int) -> Column:
    return F.shiftrightunsigned(seed, n)


def _between(seed: Column, n: int, size: int, low: int) -> Column:
    return (_shift(seed, n) % size + low).cast("string")


def _pick(values: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (seed % len(values) + 1).cast("int"))


def fake_hex(seed: Column, length: int) -> Column:
    """Digits of a 32-bit xorshift."""

    def step(acc: Column, _: Column) -> Column:
        a = acc["s"].bitwiseXOR(F.shiftleft(acc["s"], 13)).bitwiseAND(F.lit(MASK))
        b = a.bitwiseXOR(_shift(a, 17))
        c = b.bitwiseXOR(F.shiftleft(b, 5)).bitwiseAND(F.lit(MASK))
        return F.struct(c.alias("s"), F.concat(acc["out"], F.substr(F.lit("0123456789abcdef"), (c % 16 + 1).cast("int"), F.lit(1))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.struct(seed.alias("s"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _email(seed: Column, surface: Column) -> Column:
    at = F.instr(surface, "@") - 1
    n = F.greatest(F.lit(3), F.least(F.when(at > 0, at).otherwise(6), F.lit(10)))

    def step(acc: Column, _: Column) -> Column:
        return F.struct((F.floor(acc["s"] / 26) + 7).cast("long").alias("s"), F.concat(acc["out"], F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (acc["s"] % 26 + 1).cast("int"), F.lit(1))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), n), F.struct(seed.alias("s"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.lit("@example.com")))


def surrogate(label: Column, surface: Column) -> Column:
    """The fake value of (label, surface); [LABEL_HEX4] for unknown labels, null for blank label or surface."""
    seed = hash32(F.concat(label, F.lit("\0"), surface))
    letter = lambda n: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_shift(seed, n) % 26 + 1).cast("int"), F.lit(1))
    lit = F.lit
    options: list[tuple[list[str], Column]] = [
        (["PERSON", "PROPER_NOUN_PERSON"], _pick(PERSONS, seed)),
        (["COMPANY", "ORGANIZATION", "PROPER_NOUN_ORG"], _pick(FIRMS, seed)),
        (["LOCATION", "ADDRESS", "PROPER_NOUN_LOCATION"], _pick(PLACES, seed)),
        (["EMAIL_ADDRESS"], _email(seed, surface)),
        (["PHONE_NUMBER", "PHONE_NUMBER_JP"], F.concat_ws("-", _pick(["070", "080", "090"], seed), _between(seed, 3, 9000, 1000), _between(seed, 12, 9000, 1000))),
        (["POSTAL_CODE"], F.concat_ws("-", _between(seed, 0, 900, 100), _between(seed, 10, 9000, 1000))),
        (["IP_ADDRESS"], F.concat_ws(".", _pick(NETWORKS, seed), _between(seed, 8, 254, 1))),
        (["MY_NUMBER"], F.concat_ws(" ", *[_between(seed, 4 * k, 9000, 1000) for k in range(3)])),
        (["CREDIT_CARD"], lit("4111-1111-1111-1111")),
        (["BANK_ACCOUNT"], F.concat_ws(" ", _pick(["普通", "当座"], seed), _between(seed, 3, 9000000, 1000000))),
        (["DRIVERS_LICENSE"], F.concat_ws("-", _between(seed, 0, 90, 10), _between(seed, 6, 90, 10), _between(seed, 12, 900000, 100000), _between(seed, 24, 90, 10))),
        (["PASSPORT"], F.concat(letter(0), letter(5), _between(seed, 10, 9000000, 1000000))),
        (["API_KEY"], F.concat(lit("sk-"), fake_hex(seed, 32))),
        (["SECRET"], fake_hex(seed, 40)),
        (["DB_CONNECTION"], F.concat(lit("postgresql://user_"), fake_hex(seed, 4), lit(":***@db.example.com:5432/app"))),
        (["URL"], F.concat(lit("https://example.com/path/"), fake_hex(seed, 6))),
        (["SKU"], F.concat(lit("SKU-"), F.upper(fake_hex(seed, 6)))),
        (["MONETARY_AMOUNT"], F.concat(lit("¥"), F.format_number(seed % 999000 + 1000, 0))),
        (["ANNUAL_INCOME"], F.concat(lit("年収"), _between(seed, 0, 1500, 300), lit("万円"))),
        (["AGE"], F.concat(_between(seed, 0, 60, 20), lit("歳"))),
        (["DATE"], F.concat_ws("/", _between(seed, 0, 6, 2020), _between(seed, 6, 12, 1), _between(seed, 10, 28, 1))),
        *[([k], F.concat(lit(head), _between(seed, 0, size, low))) for k, (head, size, low) in NUMBERED.items()],
    ]
    out = F.when((F.coalesce(label, lit("")) == "") | (F.coalesce(surface, lit("")) == ""), lit(None).cast("string"))
    for names, value in options:
        out = out.when(label.isin(names), value)
    return out.otherwise(F.concat(lit("["), label, lit("_"), F.upper(fake_hex(seed, 4)), lit("]")))


def _hex_of(seed: int, length: int) -> str:
    out = ""
    for _ in range(length):
        seed = (seed ^ (seed << 13)) & MASK
        seed ^= seed >> 17
        seed = (seed ^ (seed << 5)) & MASK
        out += "0123456789abcdef"[seed % 16]
    return out


def _mail_of(seed: int, surface: str) -> str:
    at, out = surface.find("@"), ""
    for _ in range(max(3, min(at if at > 0 else 6, 10))):
        out += "abcdefghijklmnopqrstuvwxyz"[seed % 26]
        seed = seed // 26 + 7
    return f"{out}@example.com"


def _n(seed: int, n: int, size: int, low: int) -> int:
    return (seed >> n) % size + low


def _letter(seed: int, n: int) -> str:
    return chr(65 + (seed >> n) % 26)


_FAKES = {
    **dict.fromkeys(["PERSON", "PROPER_NOUN_PERSON"], lambda h, s: PERSONS[h % len(PERSONS)]),
    **dict.fromkeys(["COMPANY", "ORGANIZATION", "PROPER_NOUN_ORG"], lambda h, s: FIRMS[h % len(FIRMS)]),
    **dict.fromkeys(["LOCATION", "ADDRESS", "PROPER_NOUN_LOCATION"], lambda h, s: PLACES[h % len(PLACES)]),
    "EMAIL_ADDRESS": _mail_of,
    **dict.fromkeys(["PHONE_NUMBER", "PHONE_NUMBER_JP"], lambda h, s: f"{('070', '080', '090')[h % 3]}-{_n(h, 3, 9000, 1000)}-{_n(h, 12, 9000, 1000)}"),
    "POSTAL_CODE": lambda h, s: f"{_n(h, 0, 900, 100)}-{_n(h, 10, 9000, 1000)}",
    "IP_ADDRESS": lambda h, s: f"{NETWORKS[h % len(NETWORKS)]}.{_n(h, 8, 254, 1)}",
    "MY_NUMBER": lambda h, s: " ".join(str(_n(h, 4 * k, 9000, 1000)) for k in range(3)),
    "CREDIT_CARD": lambda h, s: "4111-1111-1111-1111",
    "BANK_ACCOUNT": lambda h, s: f"{('普通', '当座')[h % 2]} {_n(h, 3, 9000000, 1000000)}",
    "DRIVERS_LICENSE": lambda h, s: f"{_n(h, 0, 90, 10)}-{_n(h, 6, 90, 10)}-{_n(h, 12, 900000, 100000)}-{_n(h, 24, 90, 10)}",
    "PASSPORT": lambda h, s: f"{_letter(h, 0)}{_letter(h, 5)}{_n(h, 10, 9000000, 1000000)}",
    "API_KEY": lambda h, s: f"sk-{_hex_of(h, 32)}",
    "SECRET": lambda h, s: _hex_of(h, 40),
    "DB_CONNECTION": lambda h, s: f"postgresql://user_{_hex_of(h, 4)}:***@db.example.com:5432/app",
    "URL": lambda h, s: f"https://example.com/path/{_hex_of(h, 6)}",
    "SKU": lambda h, s: f"SKU-{_hex_of(h, 6).upper()}",
    "MONETARY_AMOUNT": lambda h, s: f"¥{h % 999000 + 1000:,}",
    "ANNUAL_INCOME": lambda h, s: f"年収{_n(h, 0, 1500, 300)}万円",
    "AGE": lambda h, s: f"{_n(h, 0, 60, 20)}歳",
    "DATE": lambda h, s: f"{_n(h, 0, 6, 2020)}/{_n(h, 6, 12, 1)}/{_n(h, 10, 28, 1)}",
    **{k: lambda h, s, head=head, size=size, low=low: f"{head}{_n(h, 0, size, low)}" for k, (head, size, low) in NUMBERED.items()},
}


def fake(label: str | None, surface: str | None) -> str | None:
    """``surrogate`` of one label and surface."""
    if not label or not surface:
        return None
    seed, whole = 5381, f"{label}\0{surface}"
    for unit in memoryview(whole.encode("utf-16-le", "surrogatepass")).cast("H"):
        seed = (seed * 33 & MASK) ^ unit
    return _FAKES[label](seed, surface) if label in _FAKES else f"[{label}_{_hex_of(seed, 4).upper()}]"
