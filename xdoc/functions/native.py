"""Native functions as SQL bodies: inlined by the analyser, so plans hold no Python.

``DEFINITIONS`` maps a name to parameters, result and body. A body may use other
functions here only outside lambdas (the analyser can't inline them there), so
shared parts are Python helpers that write SQL.
"""

from __future__ import annotations

import itertools

INSTANT = "STRUCT<ns: BIGINT, tz: SMALLINT>"
DURATION = "STRUCT<years: INT, months: INT, days: INT, hours: INT, minutes: INT, ns: BIGINT, negative: BOOLEAN>"


def escaped(k: str) -> str:
    return f"if(startswith({k}, '$'), concat('$', {k}), {k})"


def field(v: str, k: str) -> str:
    """The member of an object; null for anything else. A JSON null is a value."""
    return f"""CASE WHEN instr({k}, '"') = 0 AND instr({k}, '\\\\') = 0 THEN try_variant_get({v}, concat('$["', {escaped(k)}, '"]'), 'variant') ELSE try_variant_get({v}, '$', 'map<string,variant>')[{escaped(k)}] END"""


def element(v: str, i: str) -> str:
    array = f"try_variant_get({v}, '$', 'array<variant>')"
    return f"get({array}, if({i} < 0, size({array}) + {i}, {i}))"


def step(v: str, p: str) -> str:
    """One step of a path: a key of an object or a non-negative index of an array."""
    return f"coalesce({field(v, p)}, if({p} RLIKE '^[0-9]+$', get(try_variant_get({v}, '$', 'array<variant>'), try_cast({p} AS INT)), NULL))"


def path(v: str, p: str) -> str:
    return f"aggregate({p}, {v}, (xd_at, xd_p) -> {step('xd_at', 'xd_p')})"


_NAMES = itertools.count()


def let(expression: str, body) -> str:
    """``body`` of a name for the value of ``expression``, which is then computed once."""
    name = f"xd_let{next(_NAMES)}"
    return f"get(transform(array({expression}), {name} -> {body(name)}), 0)"


#: What wraps typed scalars in navigable documents, and their types.
TAGS = {"$n": "bigint", "$m": "decimal128", "$u": "uuid", "$i": "instant", "$p": "duration", "$b": "binary", "$t": "undefined"}


def kind(v: str) -> str:
    """The type's name: the schema is looked at once."""
    wrapped = lambda s: " ".join(f"WHEN {s} LIKE 'OBJECT<`{t}`: %' AND {s} NOT LIKE '%,%' THEN '{n}'" for t, n in TAGS.items())
    return let(f"schema_of_variant({v})", lambda s: f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'VOID' THEN 'null' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN NOT {s} LIKE 'OBJECT%' THEN if({s} = 'BINARY', 'binary', 'number') {wrapped(s)} ELSE 'object' END")


def members(v: str) -> str:
    """The members of an object as a map; null for anything else, wrapped scalars too."""
    tags = ", ".join(f"'{t}'" for t in TAGS)
    return let(f"try_variant_get({v}, '$', 'map<string,variant>')", lambda m: f"if(size({m}) = 1 AND array_contains(array({tags}), map_keys({m})[0]), NULL, {m})")


def is_object(v: str) -> str:
    return f"{members(v)} IS NOT NULL"


def keys(v: str) -> str:
    return f"transform(map_keys({members(v)}), xd_k -> if(startswith(xd_k, '$$'), substring(xd_k, 2), xd_k))"


def inner(v: str, tag: str, sql: str) -> str:
    return f"try_variant_get({v}, '$[\"{tag}\"]', '{sql}')"


# ---------------------------------------------------------------- instants and durations

DAY_NS, MINUTE_NS, SECOND_NS = 86_400_000_000_000, 60_000_000_000, 1_000_000_000
UNITS = {"nanoseconds": 1, "microseconds": 1000, "milliseconds": 1_000_000, "seconds": SECOND_NS, "minutes": MINUTE_NS, "hours": 60 * MINUTE_NS, "days": DAY_NS}


def utc(i: str) -> str:
    return f"({i}.ns - {i}.tz * {MINUTE_NS}L)"


def total(p: str) -> str:
    """Nanoseconds as a decimal: no duration is too long."""
    seconds = lambda x: f"((((CAST({x}.years AS BIGINT) * 365 + CAST({x}.months AS BIGINT) * 30 + {x}.days) * 24 + {x}.hours) * 60 + {x}.minutes) * 60)"
    return let(p, lambda x: f"CAST(CAST({seconds(x)} AS DECIMAL(20,0)) * {SECOND_NS} + {x}.ns AS DECIMAL(38,0)) * if({x}.negative, -1, 1)")


def long(decimal: str) -> str:
    """A BIGINT; null beyond its range."""
    return f"try_cast({decimal} AS BIGINT)"


def instant(ns: str, tz: str = "0") -> str:
    return f"named_struct('ns', CAST({ns} AS BIGINT), 'tz', CAST({tz} AS SMALLINT))"


def duration(years="0", months="0", days="0", hours="0", minutes="0", ns="0", negative="false") -> str:
    parts = ", ".join(f"'{n}', CAST({v} AS INT)" for n, v in (("years", years), ("months", months), ("days", days), ("hours", hours), ("minutes", minutes)))
    return f"named_struct({parts}, 'ns', CAST({ns} AS BIGINT), 'negative', CAST({negative} AS BOOLEAN))"


def clock(i: str) -> str:
    """Nanoseconds as a wall clock without its zone."""
    second = f"floor({i} / {SECOND_NS}L)"
    second = f"(({i} - pmod({i}, {SECOND_NS}L)) div {SECOND_NS}L)"
    return f"concat(date_format(timestamp_seconds({second}), \"yyyy-MM-dd'T'HH:mm:ss\"), '.', lpad(CAST(pmod({i}, {SECOND_NS}L) AS STRING), 9, '0'))"


def zone(tz: str) -> str:
    return f"if({tz} = 0, 'Z', concat(if({tz} < 0, '-', '+'), lpad(CAST(abs({tz}) div 60 AS STRING), 2, '0'), ':', lpad(CAST(abs({tz}) % 60 AS STRING), 2, '0')))"


_I = "'^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.]([0-9]{1,9})[0-9]*)?(Z|[+-][0-9]{2}:?[0-9]{2})?$'"
_P = "'^(-?)P(?=[0-9]|T[0-9])(?:([0-9]+)W|(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?=[0-9])(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)(?:[.]([0-9]{1,9})[0-9]*)?S)?)?)$'"


def _groups(t: str, pattern: str, n: int) -> str:
    """All groups of a whole match, by one run of the pattern."""
    return f"split(regexp_replace({t}, {pattern}, '" + ",".join(f"$' || '{k}" for k in range(1, n + 1)) + "'), ',', -1)"


def parse_instant(t: str) -> str:
    """Null for what is no instant, and beyond the range of BIGINT nanoseconds (1677 to 2262)."""
    def body(g: str) -> str:
        digits = f"replace({g}[3], ':', '')"
        tz = f"if({g}[3] IN ('', 'Z'), 0, CAST(concat(substring({digits}, 1, 1), '1') AS INT) * (CAST(substring({digits}, 2, 2) AS INT) * 60 + CAST(substring({digits}, 4, 2) AS INT)))"
        at = f"try_to_timestamp(concat({g}[0], ' ', {g}[1]), 'yyyy-MM-dd HH:mm:ss')"
        ns = f"CAST(unix_seconds({at}) AS DECIMAL(20,0)) * {SECOND_NS} + CAST(rpad({g}[2], 9, '0') AS BIGINT)"
        return let(long(ns), lambda x: f"if({x} IS NULL, NULL, {instant(x, tz)})")

    return let(t, lambda x: f"CASE WHEN {x} RLIKE {_I} THEN {let(_groups(x, _I, 4), body)} END")


def parse_duration(t: str) -> str:
    def body(g: str) -> str:
        n = lambda k: f"coalesce(try_cast(nullif({g}[{k - 1}], '') AS BIGINT), 0)"
        return duration(n(3), n(4), f"{n(5)} + 7 * {n(2)}", n(6), n(7), f"{n(8)} * {SECOND_NS}L + CAST(rpad({g}[8], 9, '0') AS BIGINT)", f"{g}[0] = '-'")

    return let(t, lambda x: f"CASE WHEN {x} RLIKE {_P} THEN {let(_groups(x, _P, 9), body)} END")


def duration_text(p: str) -> str:
    part = lambda f, u: f"if({p}.{f} = 0, '', concat(CAST({p}.{f} AS STRING), '{u}'))"
    seconds = f"if({p}.ns = 0, '', concat(CAST({p}.ns div {SECOND_NS}L AS STRING), if({p}.ns % {SECOND_NS}L = 0, '', concat('.', lpad(CAST({p}.ns % {SECOND_NS}L AS STRING), 9, '0'))), 'S'))"
    date = f"concat({part('years', 'Y')}, {part('months', 'M')}, {part('days', 'D')})"
    time = f"concat({part('hours', 'H')}, {part('minutes', 'M')}, {seconds})"
    return f"concat(if({p}.negative, '-', ''), 'P', {date}, if({time} = '', if({date} = '', 'T0S', ''), concat('T', {time})))"


def of_ns(ns: str) -> str:
    return duration(ns=f"abs({ns})", negative=f"({ns}) < 0")


def combine(a: str, b: str, sign: str) -> str:
    """Field by field, each side with its sign; one sign if all fields agree, else as nanoseconds in all."""
    fields = ("years", "months", "days", "hours", "minutes", "ns")
    raw = {f: f"(CAST({a}.{f} AS BIGINT) * if({a}.negative, -1, 1) {sign} CAST({b}.{f} AS BIGINT) * if({b}.negative, -1, 1))" for f in fields}
    low, high = f"least({', '.join(raw.values())})", f"greatest({', '.join(raw.values())})"
    same = duration(*(f"abs({raw[f]})" for f in fields), f"{low} < 0")
    return f"if({low} >= 0 OR {high} <= 0, {same}, {let(long(f'{total(a)} {sign} {total(b)}'), of_ns)})"


def number_of(v: str) -> str:
    """Any numeric scalar as a decimal: scale 10."""
    return let(kind(v), lambda k: f"CASE {k} WHEN 'number' THEN try_variant_get({v}, '$', 'decimal(38,10)') WHEN 'bigint' THEN try_cast({inner(v, '$n', 'string')} AS DECIMAL(38,10)) WHEN 'decimal128' THEN try_cast({inner(v, '$m', 'string')} AS DECIMAL(38,10)) END")


def text_of(v: str) -> str:
    """A string as it is, other scalars as document text, containers as JSON."""
    instant_text = f"concat(regexp_replace({clock(inner(v, '$i', 'bigint'))}, '[.]?0+$', ''), 'Z')"
    return let(kind(v), lambda k: f"CASE {k} WHEN 'string' THEN try_variant_get({v}, '$', 'string') WHEN 'bigint' THEN concat({inner(v, '$n', 'string')}, 'n') WHEN 'decimal128' THEN concat({inner(v, '$m', 'string')}, 'm') WHEN 'uuid' THEN {inner(v, '$u', 'string')} WHEN 'instant' THEN {instant_text} WHEN 'duration' THEN {inner(v, '$p', 'string')} WHEN 'undefined' THEN 'undefined' ELSE to_json({v}) END")


def rounded(x: str, n: str, mode: str) -> str:
    """Exact: by remainders of decimals, never by way of a double. Nothing to do from 10 digits on, the scale."""
    def body(u: str) -> str:
        a = f"abs({x})"
        down, rest = f"({a} - {a} % {u})", f"({a} % {u})"
        signed = lambda y: f"CAST(sign({x}) AS DECIMAL(1,0)) * {y}"
        up = f"({down} + {u})"
        return f"CAST(CASE {mode} WHEN 'floor' THEN {x} - pmod({x}, {u}) WHEN 'ceil' THEN {x} + pmod(-{x}, {u}) WHEN 'trunc' THEN {signed(down)} WHEN 'even' THEN {signed(f'if({rest} > {u} - {rest} OR ({rest} = {u} - {rest} AND {down} % (2 * {u}) <> 0), {up}, {down})')} ELSE {signed(f'if({rest} >= {u} - {rest}, {up}, {down})')} END AS DECIMAL(38,10))"

    return f"if({n} >= 10, {x}, {let(f'CAST(power(10, -{n}) AS DECIMAL(38,10))', body)})"


_UUID_RE = "'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$'"
_V, _I1, _P1 = "v VARIANT", f"i {INSTANT}", f"p {DURATION}"

DEFINITIONS: dict[str, tuple[str, str, str]] = {
    # navigation
    "xd_field": (f"{_V}, k STRING", "VARIANT", field("v", "k")),
    "xd_field_text": (f"{_V}, k STRING", "STRING", "xd_text(xd_field(v, k))"),
    "xd_element": (f"{_V}, n INT", "VARIANT", element("v", "n")),
    "xd_element_text": (f"{_V}, n INT", "STRING", "xd_text(xd_element(v, n))"),
    "xd_path": (f"{_V}, p ARRAY<STRING>", "VARIANT", path("v", "p")),
    "xd_path_text": (f"{_V}, p ARRAY<STRING>", "STRING", let(path("v", "p"), lambda x: f"if({kind(x)} = 'null', NULL, {text_of(x)})")),
    "xd_typeof": (_V, "STRING", kind("v")),
    "xd_text": (_V, "STRING", text_of("v")),
    "xd_extract_text": (f"{_V}, p ARRAY<STRING>", "STRING", "xd_path_text(v, p)"),
    "xd_extract_uuid": (f"{_V}, p ARRAY<STRING>", "STRING", inner(path("v", "p"), "$u", "string")),
    "xd_extract_numeric": (f"{_V}, p ARRAY<STRING>", "DECIMAL(38,10)", let(path("v", "p"), number_of)),
    "xd_numeric": (_V, "DECIMAL(38,10)", number_of("v")),
    "xd_extract_instant": (f"{_V}, p ARRAY<STRING>", INSTANT, let(inner(path("v", "p"), "$i", "bigint"), lambda x: f"if({x} IS NULL, NULL, {instant(x)})")),
    "xd_extract_timestamp": (f"{_V}, p ARRAY<STRING>", "TIMESTAMP", "xd_to_timestamp(xd_extract_instant(v, p))"),
    "xd_extract_duration": (f"{_V}, p ARRAY<STRING>", DURATION, let(inner(path("v", "p"), "$p", "string"), parse_duration)),
    # predicates
    "xd_exists": (f"{_V}, k STRING", "BOOLEAN", let("v", lambda x: f"CASE WHEN {x} IS NULL OR k IS NULL THEN NULL ELSE {field(x, 'k')} IS NOT NULL END")),
    "xd_exists_any": (f"{_V}, ks ARRAY<STRING>", "BOOLEAN", let("v", lambda x: f"CASE WHEN {x} IS NULL OR ks IS NULL THEN NULL ELSE coalesce(arrays_overlap({keys(x)}, ks), false) END")),
    "xd_exists_all": (f"{_V}, ks ARRAY<STRING>", "BOOLEAN", let("v", lambda x: f"CASE WHEN {x} IS NULL OR ks IS NULL THEN NULL ELSE coalesce(size(array_except(ks, {keys(x)})) = 0, false) END")),
    # generators and lengths
    "xd_array_length": (_V, "INT", "coalesce(size(try_variant_get(v, '$', 'array<variant>')), if(v IS NULL, NULL, raise_error('not an array')))"),
    "xd_elements": (_V, "ARRAY<VARIANT>", "coalesce(try_variant_get(v, '$', 'array<variant>'), if(v IS NULL, NULL, raise_error('not an array')))"),
    "xd_elements_text": (_V, "ARRAY<STRING>", f"transform(xd_elements(v), xd_e -> {text_of('xd_e')})"),
    "xd_keys": (_V, "ARRAY<STRING>", let("v", lambda x: f"coalesce({keys(x)}, if({x} IS NULL, NULL, raise_error('not an object')))")),
    # instants
    "xd_instant": ("t STRING", INSTANT, parse_instant("t")),
    "xd_instant_text": (_I1, "STRING", f"concat({clock('i.ns')}, {zone('i.tz')})"),
    "xd_utc_ns": (_I1, "BIGINT", utc("i")),
    "xd_now": ("", INSTANT, instant("unix_micros(current_timestamp()) * 1000")),
    "xd_from_timestamp": ("t TIMESTAMP", INSTANT, f"if(t IS NULL, NULL, {instant('unix_micros(t) * 1000')})"),
    "xd_to_timestamp": (_I1, "TIMESTAMP", f"timestamp_micros(({utc('i')} - pmod({utc('i')}, 1000L)) div 1000)"),
    "xd_epoch": (_I1, "DOUBLE", f"{utc('i')} / CAST({SECOND_NS}L AS DOUBLE)"),
    "xd_from_epoch": ("x DOUBLE", INSTANT, f"if(x IS NULL, NULL, {instant(f'CAST(x * {SECOND_NS}L AS BIGINT)')})"),
    "xd_epoch_ms": (_I1, "BIGINT", f"{utc('i')} div 1000000L"),
    "xd_from_epoch_ns": ("n BIGINT", INSTANT, f"if(n IS NULL, NULL, {instant('n')})"),
    "xd_from_epoch_ms": ("n BIGINT", INSTANT, let(long("CAST(n AS DECIMAL(20,0)) * 1000000"), lambda x: f"if({x} IS NULL, NULL, {instant(x)})")),
    "xd_since": (f"a {INSTANT}, b {INSTANT}", DURATION, f"if(a IS NULL OR b IS NULL, NULL, {of_ns(f'({utc(chr(97))} - {utc(chr(98))})')})"),
    "xd_until": (f"a {INSTANT}, b {INSTANT}", DURATION, f"if(a IS NULL OR b IS NULL, NULL, {of_ns(f'({utc(chr(98))} - {utc(chr(97))})')})"),
    "xd_same_instant": (f"a {INSTANT}, b {INSTANT}", "BOOLEAN", f"{utc('a')} = {utc('b')}"),
    "xd_instant_cmp": (f"a {INSTANT}, b {INSTANT}", "INT", f"CAST(sign({utc('a')} - {utc('b')}) AS INT)"),
    "xd_instant_plus": (f"{_I1}, {_P1}", INSTANT, let(long("i.ns + " + total("p")), lambda x: f"if({x} IS NULL, NULL, {instant(x, 'i.tz')})")),
    "xd_instant_minus": (f"{_I1}, {_P1}", INSTANT, let(long("i.ns - " + total("p")), lambda x: f"if({x} IS NULL, NULL, {instant(x, 'i.tz')})")),
    "xd_between": (f"a {INSTANT}, b {INSTANT}", DURATION, f"if(a IS NULL OR b IS NULL, NULL, {of_ns(f'({utc(chr(97))} - {utc(chr(98))})')})"),
    # durations
    "xd_duration": ("t STRING", DURATION, parse_duration("t")),
    "xd_duration_text": (_P1, "STRING", duration_text("p")),
    "xd_approx_ns": (_P1, "BIGINT", long(total("p"))),
    "xd_duration_cmp": (f"a {DURATION}, b {DURATION}", "INT", f"CAST(sign({total('a')} - {total('b')}) AS INT)"),
    "xd_same_fields": (f"a {DURATION}, b {DURATION}", "BOOLEAN", "a = b"),
    "xd_duration_plus": (f"a {DURATION}, b {DURATION}", DURATION, f"if(a IS NULL OR b IS NULL, NULL, {combine('a', 'b', '+')})"),
    "xd_duration_minus": (f"a {DURATION}, b {DURATION}", DURATION, f"if(a IS NULL OR b IS NULL, NULL, {combine('a', 'b', '-')})"),
    "xd_negate": (_P1, DURATION, f"if(p IS NULL, NULL, {duration('p.years', 'p.months', 'p.days', 'p.hours', 'p.minutes', 'p.ns', 'NOT p.negative')})"),
    "xd_abs": (_P1, DURATION, f"if(p IS NULL, NULL, {duration('p.years', 'p.months', 'p.days', 'p.hours', 'p.minutes', 'p.ns')})"),
    "xd_seconds": (_P1, "DOUBLE", f"CAST({total('p')} AS DOUBLE) / CAST({SECOND_NS}L AS DOUBLE)"),
    "xd_from_seconds": ("x DOUBLE", DURATION, f"if(x IS NULL, NULL, {of_ns(f'CAST(x * {SECOND_NS}L AS BIGINT)')})"),
    "xd_total": (f"{_P1}, unit STRING", "BIGINT", let(total("p"), lambda n: let("CASE unit " + " ".join(f"WHEN '{u}' THEN CAST({k} AS DECIMAL(20,0))" for u, k in UNITS.items()) + " END", lambda u: long(f"({n} - {n} % {u}) / {u}")))),
    "xd_scale": (f"{_P1}, n BIGINT", DURATION, let(long(f"CAST({total('p')} AS DECIMAL(28,0)) * CAST(n AS DECIMAL(10,0))"), lambda x: f"if({x} IS NULL, NULL, {of_ns(x)})")),
    "xd_divide": (f"{_P1}, n BIGINT", DURATION, let(long(total("p")), lambda x: f"if({x} IS NULL OR n IS NULL, NULL, {of_ns(f'({x} div n)')})")),
    "xd_is_zero": (_P1, "BOOLEAN", f"{total('p')} = 0"),
    "xd_is_negative": (_P1, "BOOLEAN", f"{total('p')} < 0"),
    "xd_normalised": (_P1, DURATION, let(long(total("p")), lambda x: f"if({x} IS NULL, NULL, {duration('0', '0', f'abs({x}) div {DAY_NS}L', f'abs({x}) % {DAY_NS}L div {60 * MINUTE_NS}L', f'abs({x}) % {60 * MINUTE_NS}L div {MINUTE_NS}L', f'abs({x}) % {MINUTE_NS}L', f'{x} < 0')})")),
    # decimals, bigints, uuids
    "xd_decimal": ("t STRING", "DECIMAL(38,10)", "try_cast(regexp_replace(t, 'm$', '') AS DECIMAL(38,10))"),
    "xd_is_decimal": ("t STRING", "BOOLEAN", "t RLIKE '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?m?$'"),
    "xd_round": ("x DECIMAL(38,10), n INT, mode STRING", "DECIMAL(38,10)", rounded("x", "n", "mode")),
    "xd_bigint": ("t STRING", "DECIMAL(38,0)", "try_cast(regexp_replace(t, 'n$', '') AS DECIMAL(38,0))"),
    "xd_uuid4": ("", "STRING", "uuid()"),
    "xd_uuid7": ("t TIMESTAMP", "STRING", "concat(regexp_replace(lpad(lower(hex(unix_millis(t))), 12, '0'), '^(.{8})(.{4})$', '$1-$2'), '-7', substring(uuid(), 16, 3), '-', substring(uuid(), 20))"),
    "xd_is_uuid": ("t STRING", "BOOLEAN", f"t RLIKE {_UUID_RE}"),
    "xd_uuid_version": ("t STRING", "INT", f"if(t RLIKE {_UUID_RE}, CAST(conv(substring(t, 15, 1), 16, 10) AS INT), NULL)"),
    "xd_uuid_bytes": ("t STRING", "BINARY", f"if(t RLIKE {_UUID_RE}, unhex(replace(t, '-', '')), NULL)"),
    "xd_uuid_text": ("b BINARY", "STRING", "if(length(b) = 16, regexp_replace(lower(hex(b)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5'), NULL)"),
    # binary form
    "xd_binary_type": ("b BINARY", "INT", "CAST(conv(hex(substring(b, 1, 1)), 16, 10) AS INT)"),
}
