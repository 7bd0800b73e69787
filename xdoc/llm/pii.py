"""Surrogates for personal data, in DataFrame expressions only.

One pattern finds all kinds of entities. Each distinct entity gets a keyed
surrogate of its kind that has its shape: letters become letters of the same
script and case, digits digits, separators stay (what has nothing but separators,
like a line to fill in, is no secret or address); names keep their title's
gender; card numbers keep the Luhn property. Surrogates are checked against each
other and against all originals, and whichever collide are drawn again, longer
where their kind or shape is full, so distinct entities stay distinct and equal
ones equal across the whole table, however many there are.
Texts without an entity pass through unread by any shuffle.

Defined results: a null text stays null, an empty one empty; equal entities get
equal surrogates wherever they stand, also in repeated rows; ties between
colliding entities go to the smaller one; an empty table gives an empty table;
extra columns, whatever their names, are kept.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Draws that keep the length of a value; later ones are longer by a symbol more each.
PLAIN = 4
#: So many entities of a kind at most are drawn again without making names longer.
ROOM = {"given": 8, "family": 8192}

# Titles, by gender, and letters of scripts.
MALE = "Mr|Herr|Monsieur|Señor|Don|Sir|господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora|Doña|Lady|госпожа|г-жа"
NEUTRAL = "Dr|Prof|Mx"
GIVEN = {
    "m": "Adam Bruno Carl David Emil Felix Georg Henri Ivan Jonas Karim Louis Martin Nils Oscar Pablo".split(),
    "f": "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nadia Olga Paula".split(),
    "x": "Alex Blair Casey Dana Eden Finley Gray Harper Indigo Jules Kim Lee Morgan Noel Quinn Robin".split(),
    "cm": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Фёдор".split(),
    "cf": "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина София".split(),
}
SURNAME = {"l": "al ber cor den er fal gar hol is jor kel lan mor nev or pel".split(), "c": "ал бер вор гар дем ел зор ив кор лан мер нов ор пар рам сол".split()}
LETTERS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя",
    "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω",
    "[Α-ΩΆ-Ώ]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHan}": "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗",
    r"[\p{IsLatin}&&\p{Ll}]": "àáâäçèéêëìíîïñòóôöùúûü",
    r"[\p{IsLatin}&&\p{Lu}]": "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET = r"""(?i:token|secret|api[_-]?key|passw(?:or)?d)\s{0,3}[=:]\s{0,3}["']?"""
_PATTERNS = {
    "secret": _SECRET + r"(?=[+/_\-]*+[A-Za-z0-9])[A-Za-z0-9+/_\-]{8,}",
    "email": r"(?<![\p{L}\p{N}._%+\-])(?:[._%+\-]*+[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@|[._%+\-]++@(?=[.\-]*+[\p{L}\p{N}][\p{L}\p{N}.\-]*\.\p{L}{2}))[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?:(?:(?<!\d)\+?\d{1,3}[ \-.]?)?\(\d{2,4}\)[ \-.]?\d{3,4}[ \-.]\d{3,4}|\+\d{1,3}(?:[ \-.]?\d{2,4}){2,5}|(?<!\d)\d{3}[\-.]\d{3}[\-.]\d{4})(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "hex": r"\b(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
    "name": rf"\b(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: What any match has: texts without it aren't searched further.
_HINT = rf"[0-9@]|[a-f]{{32}}|[A-F]{{32}}|(?i:token|secret|key|passw)|\b(?:{MALE}|{FEMALE}|{NEUTRAL})\b"


def matches(text: Column) -> Column:
    """All entities of a text in order; empty where there are none or the text is null."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def kind(match: Column) -> Column:
    whole = lambda name: match.rlike(rf"^(?:{_PATTERNS[name]})$")
    first, *rest = (n for n in _PATTERNS)
    found = F.when(whole(first), first)
    for name in rest:
        found = found.when(whole(name), name)
    return found.otherwise("phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _title(m: Column) -> Column:
    return F.regexp_extract(m, r"^(\S+) ", 1)


def _gender(m: Column) -> Column:
    gender = F.when(m.rlike(rf"^(?:{MALE})\b"), "m").when(m.rlike(rf"^(?:{FEMALE})\b"), "f").otherwise("x")
    return F.when(m.rlike(r"\p{IsCyrillic}"), F.concat(F.lit("c"), F.when(gender == "x", "m").otherwise(gender))).otherwise(gender)


def _secret_value(m: Column) -> Column:
    return F.regexp_replace(m, "^" + _SECRET, "")


def entities(match: Column) -> Column:
    """Keys of what a match names, as kind:value: a name has its given name and surname, all others themselves."""
    k = kind(match)
    rest = F.regexp_replace(match, r"^\S+ ", "")
    family = F.regexp_extract(rest, r"(\S+)$", 1)
    names = F.when(rest.contains(" "), F.array(F.concat(F.lit("given_"), _gender(match), F.lit(":"), F.regexp_extract(rest, r"^(\S+)", 1)), F.concat(F.lit("family:"), family))).otherwise(F.array(F.concat(F.lit("family:"), family)))
    value = F.when(k == "email", F.lower(match)).when(k.isin("card", "phone", "ssn"), _digits(match)).when(k == "secret", _secret_value(match)).when(k == "iban", F.regexp_replace(match, " ", "")).otherwise(match)
    return F.when(k == "name", names).otherwise(F.array(F.concat_ws(":", F.when(k == "hex", "secret").otherwise(k), value)))


# ---------------------------------------------------------------- surrogates

def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 in hexadecimal digits."""
    block = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    pad = lambda byte: F.lit(bytes(b ^ byte for b in block.ljust(128, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 512))), 512)


def _draw(at: Column, below: int | Column) -> Column:
    """A keyed number for position ``at`` of the entity in column __digest."""
    place = (at % 128) * 2 + 1
    return F.conv(F.substring("__digest", place, F.lit(2)), 16, 10).cast("int") % below


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), _draw(at, len(letters)) + 1, F.lit(1))


@functools.cache
def _scripts() -> str:
    """Runs of code points beyond ASCII of one script and case (of digits, one set), with letters to draw from, by pages of 256, as JSON."""
    pages, members = [[] for _ in range(0x324)], {}
    for at in range(0x80, 0x32400):
        c = chr(at)
        case = unicodedata.category(c)
        if case[0] not in "LN":
            continue
        script = unicodedata.name(c, "?").split()[0].split("-")[0]
        group = (at - unicodedata.decimal(c), "Nd") if case == "Nd" else (script, case if case in ("Lu", "Ll") else case[0])
        members.setdefault(group, []).append(c)
        runs = pages[at >> 8]
        if runs and runs[-1][2] == group:
            runs[-1][1] = at
        else:
            runs.append([at, at, group])
    other = {"Lu": LETTERS[r"[\p{IsLatin}&&\p{Lu}]"], "Ll": LETTERS[r"[\p{IsLatin}&&\p{Ll}]"], "L": LETTERS[r"[\p{IsLatin}&&\p{Ll}]"], "N": "0123456789"}
    drawn = {g: "".join(m[:24]) if len(m) > 3 else other[g[1]] for g, m in members.items()}
    return json.dumps([[{"a": a, "b": b, "s": drawn[g]} for a, b, g in runs] for runs in pages], ensure_ascii=False)


def _of_script(c: Column, at: Column) -> Column:
    """A letter or number for one of any other script; all else stays."""
    point = F.ascii(c)
    pages = F.from_json(F.lit(_scripts()), "array<array<struct<a: int, b: int, s: string>>>")  # folded into a constant
    own = F.get(F.filter(F.get(pages, F.shiftright(point, 8)), lambda r: (r["a"] <= point) & (point <= r["b"])), F.lit(0))["s"]
    return F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.coalesce(F.substring(own, _draw(at, F.length(own)) + 1, F.lit(1)), c)).otherwise(c)


def _shaped(value: Column, keep: Column) -> Column:
    """Letters for letters of their script and case, digits for digits; the first ``keep`` characters stay."""
    def one(c: Column, k: Column) -> Column:
        found = F.when(k < keep, c).when(c.rlike("^[0-9]$"), _draw(k, 10).cast("string"))
        for letters, by in LETTERS.items():
            found = found.when(c.rlike(f"^{letters}$"), _pick(by, k))
        return found.otherwise(_of_script(c, k))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    def add(total: Column, c: Column, k: Column) -> Column:
        d = c.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.struct(c.alias("c"), k.alias("k")))
    return F.aggregate(numbered, F.lit(0), lambda total, x: add(total, x["c"], x["k"])) % 10


def _named(words: list[str], at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), _draw(F.lit(at), len(words)) + 1)


def _more(kind: str, draw: int, count: int) -> int:
    """Symbols (syllables of names, else digits) that a draw of ``count`` entities adds: their space is far larger than they are many."""
    first = kind.split("_")[0]
    if draw == 0 or (draw < PLAIN and count <= ROOM.get(first, count)):
        return 0
    have = {"given": 16, "family": 16**4}.get(first, 1)
    return max(1, math.ceil(math.log(64 * count / have, 16 if have > 1 else 10))) + max(0, draw - PLAIN)


def _with_surrogates(drawn: DataFrame, more: dict[str, int]) -> DataFrame:
    """``drawn`` with __surrogate, from columns __kind, __value and __digest; ``more`` tells by how many symbols a kind's values are longer.

    What keeps a value's shape is drawn in one column for all kinds: the table of scripts stands once in the plan.
    """
    k, value, shaped = F.col("__kind"), F.col("__value"), F.col("__shaped")

    def by_kind(one):  # an expression of the number of added symbols
        found = one(0)
        for name, n in more.items():
            found = F.when(k == name, one(n)).otherwise(found) if n else found
        return found

    zeros = by_kind(lambda n: F.lit("0" * n))  # shaped as digits of the value
    letters = by_kind(lambda n: F.repeat(F.regexp_extract(value, r"(\p{L})[^\p{L}]*$", 1), n))
    shape = F.concat(F.when(k == "email", F.regexp_extract(value, r"^(.*)\.", 1)).otherwise(value), F.when(k == "family", letters).otherwise(zeros))
    drawn = drawn.withColumn("__shaped", _shaped(shape, F.when(k.isin("card", "phone"), 1).when(k == "iban", 2).otherwise(0)))
    hexed = F.substring("__digest", F.lit(1), F.length(value) + F.length(zeros))
    fixed = F.concat(F.expr("substring(__shaped, 1, length(__shaped) - 1)"), ((F.substring(shaped, -1, 1).cast("int") + 10 - _luhn(shaped)) % 10).cast("string"))
    syllables = lambda s, start, n: [_named(SURNAME[s], start + i) for i in range(n)]
    surname = lambda s: by_kind(lambda n: F.initcap(F.concat(*syllables(s, 1, 4 + n))))
    found = F.when((k == "card") & (_luhn(value) == 0), fixed)
    found = found.when(k == "ip", F.concat(F.concat_ws(".", *((_draw(F.lit(i), 254) + 1).cast("string") for i in range(4))), by_kind(lambda n: F.concat(F.lit(""), *(_draw(F.lit(4 + i), 10).cast("string") for i in range(n))))))
    found = found.when((k == "secret") & value.rlike("^[0-9a-f]{1,256}$"), hexed).when((k == "secret") & value.rlike("^[0-9A-F]{1,256}$"), F.upper(hexed))
    found = found.when(k == "email", F.concat(shaped, F.regexp_extract(value, r"(\.[^.]*)$", 1)))
    for gender, names in GIVEN.items():
        own, s = f"given_{gender}", "c" if gender[0] == "c" else "l"
        found = found.when(k == own, F.concat(_named(names, 0), *syllables(s, 1, more.get(own, 0))))
    found = found.when((k == "family") & value.rlike(r"\p{IsCyrillic}"), surname("c")).when((k == "family") & value.rlike(r"^[\p{IsLatin}'’\-]+$"), surname("l"))
    return drawn.withColumn("__surrogate", found.otherwise(shaped))


def surrogates(keys: DataFrame, key: str, draws: int | None = None) -> DataFrame:
    """Distinct entity keys (column __entity) in; __entity and its __surrogate out, distinct within a kind and from all originals.

    Draws go on until none is left: each that follows the first ones adds symbols, so no kind or shape stays
    full. ``draws`` is for callers who want an error after so many.
    """
    every = materialize(keys.select("__entity").distinct().select("__entity", F.regexp_extract("__entity", r"^([^:]*):", 1).alias("__kind"), F.expr("substring(__entity, instr(__entity, ':') + 1)").alias("__value")), "entities")
    done, left, draw = None, every, 0
    while counts := {r["__kind"]: r["count"] for r in left.groupBy("__kind").count().collect()}:
        if draw == draws:
            raise ValueError(f"entities still share surrogates after {draws} draws")
        more = {kind: _more(kind, draw, n) for kind, n in sorted(counts.items())}
        seed = F.concat_ws("|", F.lit(draw), F.col("__entity"))
        drawn = left.withColumn("__digest", F.concat(_hmac(key, seed), _hmac(key, F.concat(seed, F.lit("|")))))
        drawn = materialize(_with_surrogates(drawn, more).select("__entity", "__kind", "__value", "__surrogate"), f"drawn{draw}")
        # the smallest entity keeps a surrogate that several drew, unless it is taken or stands in the texts
        taken = every.select("__kind", F.col("__value").alias("__surrogate"))
        if done is not None:
            taken = taken.union(done.select("__kind", "__surrogate"))
        owner = drawn.groupBy("__kind", "__surrogate").agg(F.min("__entity").alias("__entity")).join(taken, ["__kind", "__surrogate"], "left_anti")
        good = drawn.join(owner.select("__entity"), "__entity", "left_semi").select("__entity", "__kind", "__surrogate")
        done = materialize(good if done is None else done.union(good), f"surrogates{draw}")
        left, draw = every.join(done, "__entity", "left_anti"), draw + 1
    return every.select("__entity", F.lit("").alias("__surrogate")) if done is None else done.select("__entity", "__surrogate")


def _spelled(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced one by one; more digits than it has go to its end."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("s"))
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct((acc["k"] + 1).alias("k"), F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(1))).alias("s"))).otherwise(F.struct(acc["k"].alias("k"), F.concat(acc["s"], c).alias("s")))
    return F.aggregate(F.split(pattern, ""), start, step, lambda acc: F.concat(acc["s"], F.substring(digits, acc["k"], F.length(digits))))


def _replacement(match: Column, table: Column) -> Column:
    k, keys = kind(match), entities(match)
    own = table[keys[0]]
    name = F.concat_ws(" ", _title(match), F.array_join(F.transform(keys, lambda e: table[e]), " "))
    prefix = F.regexp_extract(match, f"^({_SECRET})", 1)
    return F.when(k == "name", name).when(k.isin("card", "phone", "ssn"), _spelled(match, own)).when(k == "secret", F.concat(prefix, own)).otherwise(own)


_WORD_EDGE = r"(?<![\p{L}'’\-])(?=[\p{L}'’\-])|(?<=[\p{L}'’\-])(?![\p{L}'’\-])"


def _unnamed(part: Column, table: Column) -> Column:
    """A stretch of text between entities, without the names that its document has."""
    words = F.transform(F.split(part, _WORD_EDGE), lambda w: F.coalesce(table[F.concat(F.lit("word:"), w)], w))
    return F.array_join(words, "")


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with entities of its text replaced; ``count`` names an added column with their number. ``key`` is a secret of the caller."""
    docs = docs.drop(count) if count else docs
    body = F.col(f"`{text}`").cast("string")
    own = lambda: [F.col(f"`{doc_id}`"), F.xxhash64(body), F.xxhash64(F.lit(3), body)]  # noqa: E731 - rows that agree in these are edited alike
    hit, names, worded, *owner = (fresh(docs, x) for x in ("__matches", "__table", "__words", "__owner", "__of1", "__of2"))  # whatever columns docs has
    hits = materialize(docs.withColumn(hit, matches(body)), "hits")  # the pattern runs once
    some = hits.where(F.size(hit) > 0)
    named = some.select(*(c.alias(n) for c, n in zip(own(), owner, strict=True)), F.explode(F.array_distinct(F.flatten(F.transform(hit, entities)))).alias("__entity")).distinct()
    named = materialize(named, "named")
    table = named.join(surrogates(named, key), "__entity")
    value = F.expr("substring(__entity, instr(__entity, ':') + 1)")
    words = table.where(F.col("__entity").rlike("^(given_|family:)")).groupBy(*owner, F.concat(F.lit("word:"), value).alias("__entity")).agg(F.min_by("__surrogate", "__entity").alias("__surrogate"))
    table = table.select(*owner, "__entity", "__surrogate").union(words)
    table = table.groupBy(*owner).agg(F.map_from_entries(F.collect_list(F.struct("__entity", "__surrogate"))).alias(names), F.max(F.col("__entity").startswith("word:")).alias(worded))

    keep = [F.col(f"`{c}`") for c in docs.columns]
    extra = lambda n: [n.cast("long").alias(count)] if count else []
    clean = hits.where(F.size(hit) == 0).select(*keep, *extra(F.lit(0)))
    mine = own()
    dirty = some.join(table, mine[0].eqNullSafe(F.col(owner[0])) & (mine[1] == F.col(owner[1])) & (mine[2] == F.col(owner[2])))
    parts = F.split(body, PATTERN, -1)
    parts = F.when(F.col(worded), F.transform(parts, lambda p: _unnamed(p, F.col(names)))).otherwise(parts)
    new = F.concat(F.transform(hit, lambda m: _replacement(m, F.col(names))), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a, b)), "")
    return clean.unionByName(dirty.select(*[(joined.alias(c) if c == text else k) for c, k in zip(docs.columns, keep, strict=True)], *extra(F.size(hit))))
