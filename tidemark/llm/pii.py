"""Personal data: expressions propose spans, checksums confirm them, context adjusts a score.

Per kind, proposals are the leftmost non-overlapping matches of an expression. Cards
need the Luhn sum and account numbers (kind iban) the mod-97 remainder and their
country's length. A span starts with its kind's score; a context word shortly before it
raises the score. Context is the text since the last proposal of the same kind, at most
CONTEXT_CHARS of it, so that a word speaks for the number right after it and for no other.
Account numbers are tried at every place and end where their country's length ends, so
neither a failed proposal nor another number hides one; each that is confirmed is
reported. Kinds that no checksum confirms and that many clean texts contain (national
phone numbers, social security numbers) are reported only when context raises them over
the threshold. Secrets are keys of published formats, which their prefixes make certain.

All work is per row: nothing is shuffled. Spans count code points, ends are exclusive.
Places come from the lengths of matches and of the pieces between them, summed in
log2(matches) passes, and context and numbers are cut from pieces and matches, so that a
text of any length costs about its length, however many matches it has.

Cases: a null text counts as empty and has no spans; very long texts are searched whole;
repeated rows give repeated results; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of the output. Fixed values.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "national_phone", "ssn", "secret")

#: Java expressions; a run is entered only where it starts or where the last match ended, so that none is scanned twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Only the first letter is taken, so that the next place is tried too; the group has what follows.
    "iban": r"(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))[A-Z]",
    "national_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    # All digits and hyphens that hang together, so that no part of a longer number counts.
    "ssn": r"(?:(?<![0-9])|\G)[0-9]++(?:-[0-9]++)++",
    "secret": r"AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[oprsu]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: Strings one of which every match of the kind has; texts without them are not searched.
NEEDS = {
    "email": ("@",),
    "ip": (".",),
    "phone": ("+",),
    "ssn": ("-",),
    "secret": ("AKIA", "AIza", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "xox", "PRIVATE KEY-----"),
}

#: Lengths of account numbers by country. Fixed values.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}
MORE_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AZ": 28, "BA": 20, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CR": 22, "CY": 28,
    "DJ": 27, "DO": 28, "EE": 20, "EG": 29, "FK": 18, "FO": 18, "GE": 22, "GI": 23, "GL": 18, "GT": 28, "HN": 28, "HR": 21,
    "IL": 23, "IQ": 23, "IS": 26, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LV": 21, "LY": 25,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "OM": 23, "PK": 24, "PS": 29,
    "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Scores before context, context words (looked for in lower case) and what one adds. Fixed values.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_phone": 0.3, "ssn": 0.3, "secret": 0.9}
CONTEXT = {
    "email": ("mail", "contact", "contacto", "kontakt"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "national_phone": ("phone", "tel", "call", "fax", "mobile"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "token", "secret", "password"),
}
CONTEXT_ADDS, CONTEXT_CHARS, THRESHOLD = 0.2, 40, 0.5
#: Social security numbers, and those that are never given out. Fixed values.
SSN, NO_SSN = "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "^(000|666|9)|-00-|-0000$"


def _sums(a: str) -> str:
    """SQL: running sums of an array of numbers, each pass adding what lies twice as far back."""
    return f"""aggregate(sequence(0, greatest(0, cast(ceil(log2(size({a}) + 1)) as int))), {a},
      (b, r) -> transform(b, (x, i) -> x + if(i >= shiftleft(1, r), b[i - shiftleft(1, r)], 0)))"""


def _proposals(kind: str) -> str:
    """SQL: matches as structs (s, e, m, near): places, the match (of account numbers what the group has), the context before."""
    p = PATTERNS[kind].replace("\\", "\\\\")
    hits, parts = f"regexp_extract_all(t, '{p}', {1 if kind == 'iban' else 0})", f"split(t, '{p}', -1)"
    length = (lambda m: "1") if kind == "iban" else (lambda m: f"length({m})")
    # One struct for each match (the last piece has none), and the sums of all lengths up to its end.
    pairs = f"filter(zip_with({parts}, {hits}, (p, h) -> struct(length(p) + {length('h')} as n, h as m, right(p, {CONTEXT_CHARS}) as near)), x -> x.m is not null)"
    placed = f"zip_with(a, {_sums('transform(a, x -> x.n)')}, (x, e) -> struct(e - {length('x.m')} as s, e as e, x.m as m, x.near as near))"
    return f"(transform(array({pairs}), a -> {placed}))[0]"


def _confirm(kind: str, a: str) -> str:
    """SQL: the spans of a that the kind's validator confirms."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    if kind == "ip":
        return f"filter({a}, x -> forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', substring(ltrim('0', p), 1, 3)) as int) <= 255))"
    if kind == "card":
        two = "2 * cast(substring(d, length(d) - i, 1) as int)"
        luhn = f"aggregate(sequence(0, length(d) - 1), 0, (t, i) -> t + if(i % 2 = 0, cast(substring(d, length(d) - i, 1) as int), {two} - if({two} > 9, 9, 0))) % 10 = 0"
        return f"filter({a}, x -> length({digits}) between 14 and 19 and exists(array({digits}), d -> {luhn}))"
    if kind == "phone":
        return f"filter({a}, x -> length({digits}) between 10 and 15)"
    if kind == "iban":
        lengths = "map(" + ", ".join(f"'{k}', {v}" for k, v in (IBAN_LENGTHS | MORE_IBAN_LENGTHS).items()) + ")"
        whole = f"regexp_extract(x.m, concat('^(?:[A-Z0-9] ?){{', try_element_at({lengths}, substring(x.m, 1, 2)) - 1, '}}[A-Z0-9]'), 0)"
        cut = f"filter(transform({a}, x -> struct(x.s as s, x.s + length(coalesce({whole}, '')) as e, coalesce({whole}, '') as m, x.near as near)), x -> x.e > x.s)"
        turned = "concat(substring(replace(x.m, ' ', ''), 5), substring(x.m, 1, 4))"
        rest = f"aggregate(split({turned}, ''), 0, (r, c) -> if(c between '0' and '9', (r * 10 + cast(c as int)) % 97, if(c between 'A' and 'Z', (r * 100 + ascii(c) - 55) % 97, r)))"
        return f"filter({cut}, x -> {rest} = 1)"
    if kind == "ssn":
        return f"filter({a}, x -> rlike(x.m, '{SSN}') and not rlike(x.m, '{NO_SSN}'))"
    return a


def _scored(kind: str, a: str) -> str:
    """SQL: structs (s, k, e, kind, score) of those over the threshold, from structs (s, e, m, near)."""
    k = (*BASE_KINDS, *MORE_KINDS).index(kind)
    word = f"rlike(lower(x.near), '(?<![a-z])(?:{'|'.join(CONTEXT[kind])})(?![a-z])')"
    score = f"cast({SCORES[kind]} as double) + if({word}, cast({CONTEXT_ADDS} as double), 0)"
    out = f"transform({a}, x -> struct(x.s as s, {k} as k, x.e as e, '{kind}' as kind, least(1.0D, {score}) as score))"
    return out if kind in BASE_KINDS else f"filter({out}, y -> y.score >= {THRESHOLD})"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id and spans, an array of (s, k, e, kind, score) by start and kind."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = "cast(array() as array<struct<s:int,k:int,e:int,kind:string,score:double>>)"
    found = []
    for kind in (*BASE_KINDS, *MORE_KINDS):
        test = " or ".join(f"contains(t, '{x}')" for x in NEEDS[kind]) if kind in NEEDS else "has_digit"
        spans = _scored(kind, _confirm(kind, _proposals(kind)))
        found.append(f"case when {test} then {spans} else {none} end")
    docs = docs.withColumn("has_digit", F.expr("rlike(t, '[0-9]')"))
    return docs.select("doc_id", F.expr(f"array_sort(concat({', '.join(found)}))").alias("spans"))


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    listed = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    found = find(docs)
    n = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[n(k) for k in BASE_KINDS],
        F.expr(f"sha2({listed.format(f'filter(spans, x -> x.k < {len(BASE_KINDS)})')}, 256)").alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
        *[n(k) for k in MORE_KINDS],
        F.size("spans").cast("long").alias("n_spans"),
    )


#: The same expressions without look-behind, for engines whose matching is linear anyway.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}",
    "national_phone": PATTERNS["national_phone"],
    "ssn": r"[0-9]+(?:-[0-9]+)+",
    "secret": PATTERNS["secret"],
}


def oracle() -> str:
    """Matches with their places from the pieces between them, then each kind's rule."""
    found = " union all ".join(
        f"select doc_id, {k} as k, '{kind}' as kind, unnest(regexp_extract_all(t, '{p}')) as m, unnest(string_split_regex(t, '{p}')[:-2]) as gap, generate_subscripts(regexp_extract_all(t, '{p}'), 1) as i from d"
        for k, (kind, p) in enumerate(_PLAIN.items())
        if kind != "iban"
    )
    lengths = "map {" + ", ".join(f"'{c}': {n}" for c, n in (IBAN_LENGTHS | MORE_IBAN_LENGTHS).items()) + "}"
    at_iban = list(_PLAIN).index("iban")
    near = " ".join(f"when '{kind}' then regexp_matches(near, '(^|[^a-z])(?:{'|'.join(CONTEXT[kind])})([^a-z]|$)')" for kind in _PLAIN)
    base = " ".join(f"when '{kind}' then {SCORES[kind]}" for kind in _PLAIN)
    counts = ", ".join(f"cast(count(*) filter (kind = '{kind}') as bigint) as n_{kind}" for kind in _PLAIN)
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    return rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
found as ({found.replace("select doc_id,", "select row,")}),
places as (
  select row, {at_iban} as k, 'iban' as kind, i, regexp_extract(substr(t, i, 2 * 34), '^{_PLAIN["iban"]}') as m, t
  from (select *, unnest(range(1, length(t) + 1)) as i from d where regexp_matches(t, '{_PLAIN["iban"]}')) where regexp_matches(substr(t, i, 2 * 34), '^{_PLAIN["iban"]}')
), placed as (
  select row, k, kind, m, lower(right(gap, {CONTEXT_CHARS})) as near, cast(sum(length(gap) + length(m)) over (partition by row, kind order by i rows unbounded preceding) as bigint) - length(m) as s, length(m) as n from found
  union all
  select row, k, kind, regexp_extract(m, '^(?:[A-Z0-9] ?){{' || (coalesce({lengths}[m[:2]], 99) - 1) || '}}[A-Z0-9]') as m, near, s, length(regexp_extract(m, '^(?:[A-Z0-9] ?){{' || (coalesce({lengths}[m[:2]], 99) - 1) || '}}[A-Z0-9]')) as n
  from (select *, i - 1 as s, lower(right(substr(t, 1 + coalesce(lag(i) over (partition by row order by i), 0), i - 1 - coalesce(lag(i) over (partition by row order by i), 0)), {CONTEXT_CHARS})) as near from places)
), cut as (select *, {digits} as digits, replace(m, ' ', '') as bare from placed where n > 0
), ok as (
  select * from cut where case kind
    when 'ip' then len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || substr(ltrim(p, '0'), 1, 3) as int) > 255)) = 0
    when 'card' then length(digits) between 14 and 19 and list_sum(list_transform(range(length(digits)), lambda j:
      case when j % 2 = 0 then cast(digits[length(digits) - j] as int) else cast(digits[length(digits) - j] as int) * 2 - case when cast(digits[length(digits) - j] as int) > 4 then 9 else 0 end end)) % 10 = 0
    when 'phone' then length(digits) between 10 and 15
    when 'iban' then list_reduce(list_prepend(0, list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end)), lambda r, x: case when x < 10 then (r * 10 + x) % 97 else (r * 100 + x) % 97 end) = 1
    when 'ssn' then regexp_matches(m, '{SSN}') and not regexp_matches(m, '{NO_SSN}')
    else true end
), scored as (
  select *, case kind {base} end + case when case kind {near} end then {CONTEXT_ADDS} else 0 end as score from ok
), kept as (select row, k, kind, kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint) as span, s from scored where k < {len(BASE_KINDS)} or score >= {THRESHOLD}),
per as (
  select row, {counts}, count(*) as n_spans, string_agg(span, ',' order by s, k) filter (k < {len(BASE_KINDS)}) as base, string_agg(span, ',' order by s, k) as spans from kept group by row
)
select d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in _PLAIN)}, coalesce(n_spans, 0) as n_spans, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per on per.row = d.row
"""
