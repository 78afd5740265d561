"""DuckDB SQL that says the same as the operators, built from the same patterns and tables."""

from __future__ import annotations

from maskwright.functions import labels
from maskwright.functions.patterns import PRESETS

from .memos import quoted

M = "chr(64976)"


def re2(pattern: str) -> tuple[str, str]:
    """(pattern, replacement) that marks matches; look-arounds become consumed groups."""
    head, tail = "(?<![A-Za-z])", "(?![A-Za-z])"
    if pattern.startswith(head):
        return "(^|[^A-Za-z])(" + pattern[len(head) : -len(tail)] + ")($|[^A-Za-z])", f"'\\1' || {M} || '\\2' || {M} || '\\3'"
    return "(" + pattern + ")", f"{M} || '\\1' || {M}"


def parts(text: str, pattern: str) -> str:
    p, r = re2(pattern)
    return f"string_split(regexp_replace({text}, {quoted(p)}, {r}, 'g'), {M})"


def matches(source: str, patterns: list[tuple[str, str]], id_col: str = "doc_id", text: str = "text") -> str:
    """SELECT of (doc_id, seq, entity_type, start, end, text) for all patterns; seq orders by pattern and place."""
    each = []
    for n, (label, pattern) in enumerate(patterns):
        each.append(
            f"SELECT doc_id, {n} * 1000000 + i AS seq, {quoted(label)} AS entity_type, p, i FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT doc_id, {parts('text', pattern)} AS p FROM src))"
        )
    every = " UNION ALL ".join(each)
    begin = "CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) AS INTEGER)"
    once = f"WITH src AS MATERIALIZED (SELECT {id_col} AS doc_id, {text} AS text FROM {source})"
    return f'{once} SELECT doc_id, seq, entity_type, {begin} AS start, {begin} + CAST(length(p[i]) AS INTEGER) AS "end", p[i] AS text FROM ({every}) WHERE length(p[i]) > 0'


def presets(only: list[str] | None = None, disabled: list[str] | None = None) -> list[tuple[str, str]]:
    return [(label, p) for c, label, p, _ in PRESETS if (only is None or c in only) and c not in (disabled or ())]


def resolved(spans: str) -> str:
    """Overlaps resolved, for spans of one score: nothing within the envelope of what came before, unless equal."""
    env = 'max({\'e\': "end", \'r\': -rn, \'s\': start}) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'
    ranked = f'SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, seq) AS rn FROM ({spans})'
    return f'SELECT doc_id, rn AS seq, entity_type, start, "end", text FROM (SELECT *, {env} AS env FROM ({ranked})) WHERE env IS NULL OR NOT (env.e >= "end" AND (env.s < start OR env.e > "end"))'


def resolved_scored(spans: str) -> str:
    """The same for spans with scores: the envelope is what reaches furthest, of these the best score, of these the first."""
    env = 'max({\'e\': "end", \'c\': score, \'r\': -rn, \'s\': start}) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'
    ranked = f'SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, seq) AS rn FROM ({spans})'
    return f'SELECT doc_id, rn AS seq, entity_type, start, "end", text, score FROM (SELECT *, {env} AS env FROM ({ranked})) WHERE env IS NULL OR NOT (env.e >= "end" AND env.c >= score AND (env.s < start OR env.e > "end"))'


def greedy(spans: str) -> str:
    """Longest-first disjoint spans."""
    cols = 'doc_id, rn, entity_type, start, "end", text'
    return f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, seq) AS rn FROM ({spans})),
r AS (SELECT {cols}, "end" AS last, true AS kept FROM s WHERE rn = 1
UNION ALL SELECT s.doc_id, s.rn, s.entity_type, s.start, s."end", s.text, CASE WHEN s.start >= r.last THEN s."end" ELSE r.last END, s.start >= r.last FROM r JOIN s ON s.doc_id = r.doc_id AND s.rn = r.rn + 1)
SELECT doc_id, rn AS seq, entity_type, start, "end", text FROM r WHERE kept"""


_WORD = 4294967295
_STATE = "CAST(split_part(acc, ':', 1) AS BIGINT)"
_A = f"(xor({_STATE}, {_STATE} << 13) & {_WORD})"
_B = f"xor({_A}, {_A} >> 17)"
_C = f"(xor({_B}, {_B} << 5) & {_WORD})"


def _steps(seed: str, n: str, step: str) -> str:
    """The letters that ``n`` steps append to a state kept as text."""
    return f"split_part(list_reduce(list_prepend(CAST({seed} AS VARCHAR) || ':', list_transform(range({n}), lambda x: '')), lambda acc, x: {step}), ':', 2)"


def fake_hex(seed: str, n: int) -> str:
    return _steps(seed, str(n), f"CAST({_C} AS VARCHAR) || ':' || split_part(acc, ':', 2) || substr('0123456789abcdef', CAST({_C} % 16 + 1 AS INTEGER), 1)")


def surrogate(label: str, surface: str, seed: str) -> str:
    """The fake value of every label, by the arithmetic on its seed."""
    from maskwright.operators import surrogate as S

    pick = lambda values: f"[{', '.join(map(quoted, values))}][CAST({seed} % {len(values)} + 1 AS INTEGER)]"
    num = lambda n, size, low: f"CAST(({seed} >> {n}) % {size} + {low} AS VARCHAR)"
    letter = lambda n: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({seed} >> {n}) % 26 + 1 AS INTEGER), 1)"
    join = lambda sep, *parts: f" || '{sep}' || ".join(parts)
    at = f"instr({surface}, '@') - 1"
    mail = _steps(seed, f"greatest(3, least(CASE WHEN {at} > 0 THEN {at} ELSE 6 END, 10))", f"CAST({_STATE} // 26 + 7 AS VARCHAR) || ':' || split_part(acc, ':', 2) || substr('abcdefghijklmnopqrstuvwxyz', CAST({_STATE} % 26 + 1 AS INTEGER), 1)")
    values = {
        "PERSON PROPER_NOUN_PERSON": pick(S.PERSONS), "COMPANY ORGANIZATION PROPER_NOUN_ORG": pick(S.FIRMS), "LOCATION ADDRESS PROPER_NOUN_LOCATION": pick(S.PLACES), "EMAIL_ADDRESS": f"{mail} || '@example.com'",
        "PHONE_NUMBER PHONE_NUMBER_JP": join("-", pick(["070", "080", "090"]), num(3, 9000, 1000), num(12, 9000, 1000)), "POSTAL_CODE": join("-", num(0, 900, 100), num(10, 9000, 1000)),
        "IP_ADDRESS": join(".", pick(S.NETWORKS), num(8, 254, 1)), "MY_NUMBER": join(" ", *[num(4 * k, 9000, 1000) for k in range(3)]), "CREDIT_CARD": "'4111-1111-1111-1111'",
        "BANK_ACCOUNT": join(" ", pick(["普通", "当座"]), num(3, 9000000, 1000000)), "DRIVERS_LICENSE": join("-", num(0, 90, 10), num(6, 90, 10), num(12, 900000, 100000), num(24, 90, 10)),
        "PASSPORT": join("", letter(0), letter(5), num(10, 9000000, 1000000)), "API_KEY": f"'sk-' || {fake_hex(seed, 32)}", "SECRET": fake_hex(seed, 40),
        "DB_CONNECTION": f"'postgresql://user_' || {fake_hex(seed, 4)} || ':***@db.example.com:5432/app'", "URL": f"'https://example.com/path/' || {fake_hex(seed, 6)}", "SKU": f"'SKU-' || upper({fake_hex(seed, 6)})",
        "MONETARY_AMOUNT": f"'¥' || format('{{:,}}', {seed} % 999000 + 1000)", "ANNUAL_INCOME": f"'年収' || {num(0, 1500, 300)} || '万円'", "AGE": f"{num(0, 60, 20)} || '歳'",
        "DATE": join("/", num(0, 6, 2020), num(6, 12, 1), num(10, 28, 1)), **{k: f"{quoted(head)} || {num(0, size, low)}" for k, (head, size, low) in S.NUMBERED.items()},
    }
    whens = " ".join(f"WHEN {label} IN ({', '.join(map(quoted, names.split()))}) THEN {value}" for names, value in values.items())
    return f"CASE {whens} ELSE '[' || {label} || '_' || upper({fake_hex(seed, 4)}) || ']' END"


def numbered(spans: str) -> str:
    """Adds n, the number of the surface within its label."""
    first = f'SELECT *, min({{\'s\': start, \'e\': "end"}}) OVER (PARTITION BY doc_id, entity_type, text) AS first FROM ({spans})'
    return f"SELECT *, dense_rank() OVER (PARTITION BY doc_id, entity_type ORDER BY first) AS n FROM ({first})"


def last_of_equal(spans: str) -> str:
    return f'SELECT * FROM ({spans}) QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY seq DESC) = 1'


def spliced(source: str, spans: str, put: str, order: str = "start DESC, seq") -> str:
    """(doc_id, masked): the texts with ``put`` in place of each span, from right to left."""
    item = f"CAST(start AS VARCHAR) || chr(1) || CAST(\"end\" AS VARCHAR) || chr(1) || {put}"
    step = "acc[1:CAST(split_part(x, chr(1), 1) AS INTEGER)] || split_part(x, chr(1), 3) || acc[CAST(split_part(x, chr(1), 2) AS INTEGER) + 1:]"
    lists = f"SELECT doc_id, list({item} ORDER BY {order}) AS l FROM ({spans}) GROUP BY doc_id"
    return f"SELECT d.doc_id, CASE WHEN l IS NULL THEN d.text ELSE list_reduce(list_prepend(d.text, l), lambda acc, x: {step}) END AS masked FROM ({source}) d LEFT JOIN ({lists}) s ON d.doc_id = s.doc_id"


TAG = "'<' || entity_type || '_' || CAST(n AS VARCHAR) || '>'"
HASH = "'<' || entity_type || ':' || substr(sha256(text), 1, 10) || '>'"
PARTIAL = "CASE WHEN length(text) <= 2 THEN repeat('*', length(text)) ELSE text[1:1] || repeat('*', length(text) - 2) || text[-1:] END"


def case(column: str, groups: dict[str, str], other: str) -> str:
    whens = " ".join(f"WHEN {column} IN ({', '.join(map(quoted, names.split()))}) THEN {quoted(group)}" for group, names in groups.items())
    return f"CASE {whens} ELSE {quoted(other)} END"


def category(column: str) -> str:
    return f"CASE WHEN {column} LIKE 'USER_DEFINED_%' THEN substr({column}, 14) ELSE {case(column, labels.CATEGORIES, 'OTHER')} END"


def classification(column: str) -> str:
    return case(column, labels.CLASSES, "other")


def severity(column: str) -> str:
    return case(column, labels.SEVERITIES, "low")


def surface_severity(label: str, surface: str) -> str:
    return (
        f"CASE WHEN {label} IN ('PERSON', 'PROPER_NOUN_PERSON') OR ({label} IN ('ORGANIZATION', 'COMPANY', 'PROPER_NOUN_ORG') AND regexp_matches({surface}, {quoted(labels.FORMAL_COMPANY)})) "
        f"OR ({label} = 'EMAIL_ADDRESS' AND regexp_matches({surface}, {quoted(labels.FULL_EMAIL)})) THEN 'critical' ELSE {severity(label)} END"
    )


def rank(column: str) -> str:
    return f"CASE {column} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def literals(source: str, entries: list[tuple[str, str]]) -> str:
    """Spans of literal values, each search going on behind the last match."""
    each = []
    for n, (value, label) in enumerate(entries):
        v = quoted(value)
        each.append(f"SELECT doc_id, {n} * 1000000 + i AS seq, {quoted(label)} AS entity_type, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length({v}) AS INTEGER) AS start, {v} AS text FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(text, {v}) AS p FROM {source}))")
    return f'SELECT doc_id, seq, entity_type, start, start + CAST(length(text) AS INTEGER) AS "end", text FROM ({" UNION ALL ".join(each)})'
