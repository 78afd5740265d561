"""Personal data and secrets replaced by surrogates, with DataFrame functions only.

Every entity gets a keyed replacement of its own type, script, gender and format: digits by a keyed permutation
(Feistel rounds) of the digit strings of that length, with card check digits kept right; addresses, keys and
secrets character class by character class; names by given names of the same gender and script and by built
surnames; IBANs keep check digits that are right. The replacement depends on the key and on the entity alone, so all
mentions in all documents agree.
Distinct entities are then checked over the whole table: where two share a replacement, or one equals an entity
that occurs, all but one are drawn again, until none is left; every further draw is longer, so a free one exists however
many entities there are. This needs the entities only, not the texts.

A name begins with titles (``Herrn Dr.``) or listed given names and goes on with given names, initials, particles and
surnames; every word is an entity of its own, so ``Smith-Jones`` and ``García López`` keep their form and agree with
``Smith`` or ``López`` elsewhere. Up to three words follow a title, two a Spanish given name, else one; titles in
capitals take names in capitals. A name is carried through its document: where one of its surnames or given names
stands alone there, in either letter case or with a final s, it is replaced alike, but not right before another
capitalised word that is no name there (``White House``). Words in ``STOP`` are never names.

Defined results: a null text stays null with no entities; the two noncharacters used as marks become U+FFFD if a
text holds them; equal entities in different letter case (addresses) count as one; rows that repeat an id, and rows
without one, are each replaced on their own; other columns pass through, but one named ``n_entities`` gives way to ours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Peter Hans Karl Jürgen Stefan Pierre Jacques Antoine Carlos Javier Miguel Pedro".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Emma Anna Laura Julia Petra Monika Sabine Claire Sophie Camille Carmen Lucía Isabel Marta Elena".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Иван Николай Михаил Владимир Павел".split(),
    ("cyrillic", "f"): "Анна Елена Ольга Наталья Татьяна Ирина Мария Светлана Екатерина Юлия".split(),
}
#: Forms of address, of which the first line is in use in capitals too.
TITLES = (
    "Mr Mrs Miss Herr Herrn Frau Monsieur Madame Señor Señora Dr Prof "
    "Mister Ms Mx Fräulein Mademoiselle Mme Sr Sra Señorita Doktor Professor Professora Господин Госпожа Κύριος Κύριε Κυρία"
).split()
CAPITAL_TITLES = [t.upper() for t in TITLES[:12]]
#: Words between the parts of a name, and words that are none.
PARTICLES = "van von der den de del della di da dos du la le el zu zum zur ter ten bin y e Van Von De Du La Le El Di Da Al".split()
STOP = (
    "The And But For She You They We He It In On At An As To Of Or So If Is Up Us My No By Do Am Be Go Me Not Was Has Had Will Who "
    "Der Die Das Den Dem Und Er Es Sie Ich Wir Im Am Zu Hat Ist War Los Las Les Un Una Une Et Il Elle Je En Que Qui"
).split()
#: Given names that two surnames may follow.
SPANISH = "Carlos Javier Miguel Pedro Carmen Lucía Isabel Marta Elena".split()
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ra re sa se ta to".split(),
    "cyrillic": "ба бе ва ве га го да де за зи ка ко ла ле ли ло ма ми мо на не но ра ре ро са се со та те ти то".split(),
    "greek": "βα βε γα γο δα δε δι δο ζα ζε κα κε κι κο λα λε λι λο μα με μι μο να νε ρα ρε σα σε τα τε τι το".split(),
    "armenian": "բա բե գա գո դա դե դի դո զա զե կա կե կի կո լա լե լի լո մա մե մի մո նա նե րա րե սա սե տա տե տի տո".split(),
}
OPEN, CLOSE = "﷐", "﷑"

_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_TITLES = "|".join(TITLES)
_LINKS = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_INITIALS = r"(?:\p{Lu}\. ?){0,3}"
_WORD = rf"(?:[\p{{Lu}}dl]['’])?(?!(?:{'|'.join(STOP)})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+(?:\p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})"
_SURNAME = rf"{_LINKS}{_WORD}(?:-{_WORD})*"
_CAPITALS = r"(?:\p{Lu}['’])?\p{Lu}{2,}(?:-\p{Lu}{2,})*(?!\p{L})"
_NAMES = (
    rf"(?:(?:{_TITLES})\.? ){{1,3}}(?:(?:{_GIVEN})[ -]){{0,3}}{_INITIALS}{_SURNAME}(?: {_SURNAME}){{0,2}}",
    rf"(?:(?:{'|'.join(CAPITAL_TITLES)})\.? ){{1,3}}(?:(?:{_GIVEN.upper()})[ -]){{0,3}}{_INITIALS}{_CAPITALS}",
    rf"(?:(?:{'|'.join(SPANISH)})[ -]){{1,3}}{_INITIALS}{_SURNAME}(?: {_SURNAME})?",
    rf"(?:(?:{_GIVEN})[ -]){{1,3}}{_INITIALS}{_SURNAME}(?: y {_WORD})?",
)
KINDS = {
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "secret": r"(?=[PpSsTtAa])(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?[^\s\"'<>]{6,}",
    "key": r"(?=[Aagsxe])(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])",
    "email": r"(?=[A-Za-z0-9])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,63}",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)",
    "card": r"(?=\d)(?<![\w.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\w)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?=[+(\d])(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{4}(?!\w)",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{'|'.join(_NAMES)})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Kinds whose format leaves no room, and the draws after which they get a further group of digits.
NUMBERS, WIDE = ("phone", "card", "ssn", "ip", "iban"), 8
#: Kinds that draw no surrogate of their own: words of closed lists, single letters, and what stays.
CLOSED = ("given", "initial", "kept")


def _number(*parts: Column | str) -> Column:
    """A non-negative number of 60 bits from a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\u0001", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _shaped(value: Column, seed: Column) -> Column:
    """Each letter and digit replaced within its class (hexadecimal strings stay hexadecimal); the rest stays."""
    hexadecimal = value.rlike(r"^(?=[^0-9]*[0-9])(?=[^a-f]*[a-f])[0-9a-f]{8,}$")

    def one(c: Column, i: Column) -> Column:
        block = F.sha2(F.concat_ws("\u0001", seed, (i / 64).cast("int").cast("string")), 512)
        v = F.conv(F.substr(block, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        pick = lambda letters: F.substr(F.lit(letters), v % len(letters) + 1, F.lit(1))
        return (
            F.when(hexadecimal, pick("0123456789abcdef")).when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _permuted(digits: Column, seed: Column) -> Column:
    """A keyed permutation of the digit strings of each length: alternating additive Feistel rounds."""
    n = F.length(digits)
    left = (n / 2).cast("int")
    ml, mr = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), n - left).cast("long")
    start = F.struct(F.coalesce(F.substr(digits, F.lit(1), left).try_cast("long"), F.lit(0)).alias("l"), F.substr(digits, left + 1, n).cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        half = F.pmod(acc["l"] + _number(seed, n, i, F.lit("l"), acc["r"]) % ml, ml)
        return F.struct(half.alias("l"), F.pmod(acc["r"] + _number(seed, n, i, F.lit("r"), half) % mr, mr).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, lambda acc: F.concat(F.when(left > 0, F.lpad(acc["l"].cast("string"), left, "0")).otherwise(""), F.lpad(acc["r"].cast("string"), n - left, "0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in turn."""
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """Sum by the card rule of digits that are followed by one check digit."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(value: Column, seed: Column) -> Column:
    """All but the check digit permuted; the check digit moves along, so right cards stay right and wrong ones wrong."""
    d = _digits(value)
    body, check = F.substr(d, F.lit(1), F.length(d) - 1), F.right(d, F.lit(1)).cast("int")
    new = _permuted(body, seed)
    return _refilled(value, F.concat(new, F.pmod(check + _luhn(body) - _luhn(new), F.lit(10)).cast("string")))


def _ip(value: Column, seed: Column) -> Column:
    """A keyed permutation of all addresses, by halves of 16 bits."""
    part = F.split(value, r"\.")
    start = F.struct((part[0].cast("int") * 256 + part[1].cast("int")).cast("long").alias("l"), (part[2].cast("int") * 256 + part[3].cast("int")).cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        half = acc["l"].bitwiseXOR(_number(seed, i, F.lit("l"), acc["r"]) % 65536)
        return F.struct(half.alias("l"), acc["r"].bitwiseXOR(_number(seed, i, F.lit("r"), half) % 65536).alias("r"))

    out = lambda a: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.shiftright(a[h], 8), a[h] % 256)])
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, out)


def _iban(value: Column, entity: Column, seed: Column) -> Column:
    """Letters and digits after the country redrawn; the check digits move along, so right numbers stay right."""
    country, body = F.substr(entity, F.lit(1), F.lit(2)), F.substr(entity, F.lit(5), F.length(entity))
    new = _shaped(body, seed)
    worth = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + worth(c)) % 97
    right = lambda b: 98 - F.aggregate(F.split(F.concat(b, country, F.lit("00")), ""), F.lit(0), rest)
    check = F.pmod(right(new) - 2 + F.substr(entity, F.lit(3), F.lit(2)).cast("int") - right(body), F.lit(97)) + 2
    made = F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)
    placed = lambda c, i: F.when(c == " ", c).otherwise(F.substr(made, F.length(F.replace(F.substr(value, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))
    return F.array_join(F.transform(F.split(value, ""), placed), "")


def _like(new: Column, value: Column) -> Column:
    """``new`` in capitals where ``value`` is."""
    return F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(new)).otherwise(new)


def _surname(value: Column, seed: Column, attempt: Column) -> Column:
    """Four syllables in the script of the name, and one more with each further draw."""
    out = F.lit("")
    for script, syllables in SYLLABLES.items():
        names = F.array(*map(F.lit, syllables))
        built = F.aggregate(F.sequence(F.lit(1), attempt + 4), F.lit(""), lambda a, i: F.concat(a, F.element_at(names, (_number(seed, i) % len(syllables) + 1).cast("int"))))
        out = F.when(value.rlike(r"\p{Is%s}" % script.title()) if script != "latin" else F.lit(True), F.initcap(built)).otherwise(out)
    return _like(out, value)


def _given(value: Column, key: str) -> Column:
    """Each list of given names is rotated by a keyed step: distinct names stay distinct, none stays itself."""
    word = F.initcap(F.lower(value))
    out = word
    for (script, gender), names in GIVEN.items():
        listed = F.array(*map(F.lit, names))
        step = _number(key, "given", script, gender) % (len(names) - 1) + 1
        at = F.array_position(listed, word)
        out = F.when(at > 0, F.element_at(listed, ((at - 1 + step) % len(names) + 1).cast("int"))).otherwise(out)
    return _like(out, value)


def _initial(value: Column, key: str) -> Column:
    """Letters of each alphabet rotated by a keyed step; others stay."""
    out = value
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"):
        at = F.instr(F.lit(letters), value)
        step = _number(key, "initial", letters[0]) % (len(letters) - 1) + 1
        out = F.when(at > 0, F.substr(F.lit(letters), (at - 1 + step) % len(letters) + 1, F.lit(1))).otherwise(out)
    return out


def _is(kind: str, value: Column) -> Column:
    return value.rlike(rf"^(?:{KINDS[kind]})$")


def _words(name: Column) -> Column:
    """array<struct<kind, entity, before, value>>: the words of a match of ``name``, each with what stands before it."""
    cuts = F.regexp_extract_all(name, F.lit(r"[^\p{L}]*\p{L}+"), F.lit(0))

    def one(x: Column, i: Column) -> Column:
        word, last, after = F.regexp_extract(x, r"(\p{L}+)$", 1), i + 1 == F.size(cuts), F.try_element_at(cuts, i + 2)
        listed = lambda words: word.isin(*words) & ~last
        kind = (
            F.when(listed([*TITLES, *CAPITAL_TITLES, *PARTICLES]) | word.rlike(r"^\p{Ll}"), "kept").when(F.length(word) == 1, F.when(after.startswith("."), "initial").otherwise("kept"))
            .when(F.initcap(F.lower(word)).isin(*_GIVEN.split("|")) & ~last, "given").otherwise("name")
        )
        return F.struct(kind.alias("kind"), F.when(kind == "name", F.lower(word)).otherwise(word).alias("entity"), F.regexp_extract(x, r"^([^\p{L}]*)", 1).alias("before"), word.alias("value"))

    return F.transform(cuts, one)


def _entity(value: Column, surnames: Column) -> Column:
    """array<struct<kind, entity, before, value>>: what is replaced in a match and by what identity, word by word in
    names. A word that stands alone is one of the ``surnames`` of its document, or else a given name."""
    given = F.initcap(F.lower(value)).isin(*_GIVEN.split("|")) & ~F.array_contains(surnames, F.lower(value))
    kind = reduce(lambda c, k: F.when(_is(k, value), k).otherwise(c), [k for k in reversed(KINDS) if k != "name"], F.when(given, "given").otherwise("name"))
    before = F.when(_is("secret", value), F.regexp_extract(value, r"^(.*?[=:]\s*[\"']?)", 1)).otherwise("")
    rest = F.substr(value, F.length(before) + 1, F.length(value))
    entity = F.when(kind.isin("email", "name"), F.lower(rest)).when(kind == "iban", F.replace(rest, F.lit(" "), F.lit(""))).otherwise(rest)
    return F.when(_is("name", value), _words(value)).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("entity"), before.alias("before"), rest.alias("value"))))


def surrogate(kind: Column, value: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The replacement of one entity, in the letter case of ``value``."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, entity, attempt.cast("string")), 256)
    cipher = F.concat_ws("\u0001", F.lit(key), kind, attempt.cast("string"))
    local, domain = F.regexp_extract(value, "^([^@]*)@", 1), F.regexp_extract(value, "@(.*)$", 1)
    reserved = F.regexp_extract(F.lower(domain), r"(\.example\.(?:com|net|org))$", 1)
    core = F.when(reserved != "", F.substr(domain, F.lit(1), F.length(domain) - F.length(reserved))).otherwise(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1))
    email = F.concat(_shaped(local, seed), F.lit("@"), _shaped(core, F.concat(seed, F.lit("d"))), F.when(reserved != "", reserved).otherwise(".example"))
    phone_code = F.regexp_extract(value, r"^(\+\d{1,3}[ .-]?)", 1)
    phone_rest = F.substr(value, F.length(phone_code) + 1, F.length(value))
    pem = F.regexp_extract(value, r"^(-----[^\n-]*-----)", 1), F.regexp_extract(value, r"(-----END[^\n-]*-----)$", 1)
    inner = F.substr(value, F.length(pem[0]) + 1, F.length(value) - F.length(pem[0]) - F.length(pem[1]))
    key_head = F.regexp_extract(value, r"^(AKIA|ASIA|gh[pousr]_|sk-|xox[baprs]-|eyJ)", 1)
    fixed = (
        F.when(kind == "email", email)
        .when(kind == "phone", F.concat(phone_code, _refilled(phone_rest, _permuted(_digits(phone_rest), cipher))))
        .when(kind == "card", _card(value, cipher))
        .when(kind == "ssn", _refilled(value, _permuted(_digits(value), cipher)))
        .when(kind == "ip", _ip(value, cipher))
        .when(kind == "iban", _iban(value, entity, seed))
        .when(kind == "private_key", F.concat(pem[0], _shaped(inner, seed), pem[1]))
        .when(kind == "key", F.concat(key_head, _shaped(F.substr(value, F.length(key_head) + 1, F.length(value)), seed)))
        .when(kind == "name", _surname(value, seed, attempt))
        .when(kind == "given", _given(value, key))
        .when(kind == "initial", _initial(value, key))
        .when(kind == "kept", value)
        .otherwise(_shaped(value, seed))
    )
    # a further draw is longer, where the format allows it at once, else after WIDE draws in the same format
    extra = F.when(kind.isin("name", *CLOSED), 0).when(kind.isin(*NUMBERS), F.greatest(F.lit(0), attempt - WIDE)).otherwise(attempt)
    more = F.when(kind == "email", F.lit("a")).when(kind.isin(*NUMBERS), F.lit("0")).otherwise(F.lit("x"))
    drawn = _shaped(F.repeat(more, extra.cast("int")), F.concat(seed, F.lit("more")))
    tail = F.when(kind.isin(*NUMBERS), F.concat(F.lit("-"), drawn)).otherwise(drawn)
    return F.when(extra <= 0, fixed).when(kind == "email", F.concat(drawn, fixed)).when(kind == "private_key", F.concat(pem[0], _shaped(inner, seed), drawn, pem[1])).otherwise(F.concat(fixed, tail))


def _parts(text: Column) -> Column:
    """struct<parts, surnames>: the text cut at its entities, every second part being one, and the surnames that occur."""
    plain = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(text)
    cut_at = lambda t, pattern: F.split(F.regexp_replace(t, pattern, F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    named = lambda parts: F.filter(parts, lambda p, i: (i % 2 == 1) & _is("name", p))

    def carried(parts: Column, names: Column) -> Column:
        """Mentions of the names' words by themselves, in what lies between the entities."""
        words = F.filter(F.flatten(F.transform(names, _words)), lambda w: w["kind"].isin("name", "given") & (F.length(w["value"]) > 1))
        return _bound(words, lambda w: alone(parts, F.array_distinct(F.transform(w, lambda x: x["value"])), F.array_distinct(F.transform(F.filter(w, lambda x: x["kind"] == "name"), lambda x: x["entity"]))))

    def alone(parts: Column, words: Column, surnames: Column) -> Column:
        forms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.initcap(F.lower(w)), F.upper(w)))))
        any_of = F.concat(F.lit("(?:"), F.array_join(forms, "|"), F.lit(")"))
        pattern = F.concat(F.lit(r"(?<!\p{L})"), any_of, F.lit(r"(?=s?(?!\p{L}))(?! (?!"), any_of, F.lit(r"s?(?!\p{L}))\p{Lu}\p{Ll})"))
        return F.struct(F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(cut_at(p, pattern)))).alias("parts"), surnames.alias("surnames"))

    def of(parts: Column) -> Column:
        none = F.struct(parts.alias("parts"), F.array().cast("array<string>").alias("surnames"))
        return F.when(F.size(parts) < 2, none).otherwise(_bound(named(parts), lambda n: F.when(F.size(n) == 0, none).otherwise(carried(parts, n))))

    return _bound(cut_at(plain, F.lit(PATTERN)), of)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def entities(df: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """(keep..., kind, entity, before, value) for each mention."""
    found = _bound(_parts(F.col(text_col)), lambda x: F.transform(F.filter(x["parts"], lambda p, i: i % 2 == 1), lambda p: _entity(p, x["surnames"])))
    found = F.filter(F.flatten(found), lambda e: ~e["kind"].isin("initial", "kept"))
    rows = df.select(*keep, F.explode_outer(found).alias("__match")).where(F.col("__match").isNotNull())
    return rows.select(*keep, "__match.*")


def draws(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, entity, attempt > 0): the entities whose first surrogate was taken, with the draw that is free."""
    spread = partitions(mentions.sparkSession)
    same = lambda c: F.lower(c) if isinstance(c, Column) else F.lower(F.col(c))
    rows = cut(mentions.where(~F.col("kind").isin(*CLOSED)).select("kind", "entity").distinct().repartition(spread))
    state = rows.withColumn("attempt", F.lit(0)).withColumn("new", surrogate(F.col("kind"), F.col("entity"), F.col("entity"), key, F.col("attempt")))
    taken = rows.select("kind", same("entity").alias("other")).distinct()
    while True:
        state = cut(state)
        rank = F.row_number().over(Window.partitionBy("kind", same("new")).orderBy("attempt", "entity"))
        bad = cut(
            state.withColumn("rank", rank).join(taken.withColumn("real", F.lit(True)), (state["kind"] == taken["kind"]) & (same("new") == F.col("other")), "left")
            .where((F.col("rank") > 1) | F.col("real")).select(state["kind"], "entity", F.lit(True).alias("again"))
        )
        if bad.isEmpty():
            return cut(state.where(F.col("attempt") > 0).select("kind", "entity", "attempt"))
        state = state.join(bad, ["kind", "entity"], "left").repartition(spread)
        state = state.withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0))
        # a projection of its own: within one, a lambda would read the new attempt as a lateral alias
        fresh = surrogate(F.col("kind"), F.col("entity"), F.col("entity"), key, F.col("attempt"))
        state = state.select("kind", "entity", "attempt", F.when(F.col("again"), fresh).otherwise(F.col("new")).alias("new"))


def replace(df: DataFrame, key: str = "demonstration-key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text column replaced, and ``n_entities``."""
    df = df.drop("n_entities")
    again = draws(entities(df, text_col), key)
    if again.isEmpty():
        rows, attempt_of = df, lambda e: F.lit(0)
    else:
        # rows without an id count by their text, so none of them share a map
        keyed = df.withColumn("__id", F.coalesce(F.col(id_col).cast("string"), F.sha2(text_col, 256)))
        hits = entities(keyed, text_col, "__id").join(again, ["kind", "entity"])
        maps = hits.groupBy("__id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "entity"), "attempt"))).alias("__again"))
        rows = keyed.join(maps, "__id", "left").drop("__id")
        attempt_of = lambda e: F.coalesce(F.try_element_at(F.col("__again"), F.concat_ws("|", e["kind"], e["entity"])), F.lit(0))

    put = lambda e: F.concat(e["before"], surrogate(e["kind"], e["value"], e["entity"], key, attempt_of(e)))
    parts, surnames = F.col("__parts.parts"), F.col("__parts.surnames")
    new = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array_join(F.transform(_entity(p, surnames), put), "")).otherwise(p))
    out = rows.withColumn("__parts", _parts(F.col(text_col)))
    columns = [F.when(F.size(parts) == 1, parts[0]).otherwise(F.array_join(new, "")).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return out.select(*columns, F.coalesce(((F.size(parts) - 1) / 2).cast("int"), F.lit(0)).alias("n_entities"))
