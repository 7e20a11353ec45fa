"""Format-preserving pseudonyms for personal data, on DataFrame and SQL functions only.

Numbers and dates that pass their own checks (Luhn, mod 97, calendar, octets, area
and group rules) are permuted inside their format by a keyed Feistel network, so a
pseudonym is valid where its original was, two originals never share one, and
equal values stay linked across documents without any shared table. One half of
the symbols is shifted by a keyed digest of the other half, in turns; each symbol
moves within its own radix, so every format is a domain of its own. One exception:
domains of e-mail addresses are written in small letters, since their case means nothing.
Dates with slashes are a domain of their own beside the other formats of dates, which share one.

Found: secrets behind a name (``token = ...``), e-mail addresses (the part before
the @, in which every letter, mark and digit of any script moves within a class of its
script, and only ``. _ % + -`` and apostrophes stay; the domain stays), IBANs, IPv4 addresses, phone numbers, payment cards, US social security
numbers and dates of 1700 to 2099. What fails its check stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import named

ROUNDS = 8
FIRST_DAY = "date'1700-01-01'"
#: First code point and size of each class of symbols that a symbol stays in: ASCII and Latin-1.
CLASSES = ((48, 10), (97, 26), (65, 26), (223, 24), (248, 8), (192, 23), (216, 7), (161, 31))
#: Runs of letters, marks and digits of other scripts, as Unicode lays them out.
SCRIPTS = (
    (0x100, 128), (0x180, 208), (0x250, 96), (0x300, 112),  # Latin, combining marks
    (0x391, 17), (0x3A3, 9), (0x3AC, 35), (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16),  # Greek, Cyrillic
    (0x531, 38), (0x561, 38), (0x5D0, 27), (0x620, 43), (0x660, 10), (0x904, 54), (0x966, 10), (0xE01, 46), (0x10D0, 43),  # Armenian to Georgian
    (0x3041, 86), (0x30A1, 90), (0x3400, 6592), (0x4E00, 20992), (0xAC00, 11172), (0xFF10, 10), (0xFF21, 26), (0xFF41, 26),  # East Asia
)
#: Symbols outside these runs stay in their block of so many code points.
BLOCK = 64


def classes() -> list[tuple[int, int]]:
    """All classes: they share no code point, so a permutation inside each is one of all strings.

    Where a run covers a part of a block, what is left of the block makes classes of its own.
    """
    down, up = (lambda x: x // BLOCK * BLOCK), (lambda x: -(-x // BLOCK) * BLOCK)
    cuts = sorted({e for first, n in SCRIPTS for e in (first, first + n, down(first), up(first + n))})
    pieces = [(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]
    rest = [(x, n) for x, n in pieces if not any(a <= x < a + m for a, m in SCRIPTS) and any(down(a) <= x < up(a + m) for a, m in SCRIPTS)]
    return [*CLASSES, *SCRIPTS, *rest]


#: Kinds in the order in which they claim a stretch of text.
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}])(?i:api[_-]?key|access[_-]?key|secret|token|passwd|password)[\x22\x27]?\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9+/_-]{8,}",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])(?:[\p{L}\p{M}\p{N}._%+-]|(?<=\p{L})[\x27’](?=\p{L}))++@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.[\p{L}\p{M}]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ .(-])[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ -]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "date": r"(?<![A-Za-z0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9/-]|\.[0-9])",
}
#: Every pattern needs one of these; a text without any is passed on as it is.
HINT = "[0-9@=:]"


def _sql(text: str) -> str:
    """A raw SQL string literal of a text without single quotes."""
    return f"r'{text}'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _permuted(values: str, radices: str, key: str, tag: str) -> str:
    """Keyed permutation of an array of integers, each below its radix."""
    other = "if(i % 2 = 1, slice(s, size(s) div 2 + 1, size(s)), slice(s, 1, size(s) div 2))"
    block = f"sha2(concat_ws('|', {_sql(key)}, {_sql(tag)}, i, b, array_join({other}, ',')), 512)"
    stream = f"array_join(transform(sequence(0, size(s) div 16), b -> {block}), '')"
    step = "transform(s, (x, j) -> if((j < size(s) div 2) = (i % 2 = 1), cast((x + cast(conv(substr(h, 8 * j + 1, 8), 16, 10) as bigint)) % q[j] as int), x))"
    return _let("q", radices, f"aggregate(sequence(1, {ROUNDS}), {values}, (s, i) -> {_let('h', stream, step)})")


def _symbols(text: str, key: str, tag: str, letters: str = "26") -> str:
    """Each symbol permuted within its class; ASCII beside letters and digits is kept."""
    chars = f"transform(sequence(1, greatest(length({text}), 1)), i -> substr({text}, i, 1))"
    one = "named_struct('b', {}, 'n', int({}))"
    known = [f"when ascii(c) between {b} and {b + n - 1} then {one.format(b, letters if n == 26 and b < 128 else n)}" for b, n in classes()]
    own = f"when ascii(c) < 161 then {one.format('ascii(c)', 1)}"
    case = f"case {' '.join(known[:3])} {own} {' '.join(known[3:])} else {one.format(f'ascii(c) - ascii(c) % {BLOCK}', BLOCK)} end"
    moved = _permuted("zip_with(cs, ks, (c, k) -> ascii(c) - k.b)", "transform(ks, k -> k.n)", key, tag)
    char = "if(k.b + v < 256, char(k.b + v), decode(unhex(lpad(hex(k.b + v), 8, '0')), 'UTF-32'))"
    back = f"array_join(zip_with(ks, {moved}, (k, v) -> {char}), '')"
    return _let("cs", chars, _let("ks", f"transform(cs, c -> {case})", f"if({text} = '', '', {back})"))


def _filled(text: str, symbols: str, kept: str) -> str:
    """``text`` whose characters outside ``kept`` are, one by one, those of ``symbols``."""
    nth = f"length(regexp_replace(substr({text}, 1, i), {_sql(kept)}, ''))"
    one = f"if(substr({text}, i, 1) rlike {_sql(kept)}, substr({text}, i, 1), substr(new, {nth}, 1))"
    return _let("new", symbols, f"array_join(transform(sequence(1, length({text})), i -> {one}), '')")


def _luhn(digits: str, odd: int) -> str:
    """Luhn sum; the digit at the right end is doubled if ``odd`` is 1."""
    d = f"int(substr({digits}, -i, 1)) * (1 + (i + {1 - odd}) % 2)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> int(a + ({d}) div 10 + ({d}) % 10))"


def _mod97(alnum: str) -> str:
    c = f"ascii(substr({alnum}, i, 1))"
    return f"aggregate(sequence(1, length({alnum})), 0, (a, i) -> if({c} < 58, (a * 10 + {c} - 48) % 97, (a * 100 + {c} - 55) % 97))"


def _pseudonym(kind: str, key: str) -> str:
    """SQL over the match ``m``: its pseudonym, or ``m`` where it fails its check."""
    if kind == "secret":
        head = r"^.*?[=:]\s*[\x22\x27]?"
        value = f"regexp_replace(m, {_sql(head)}, '')"
        letters = "if(v rlike '^[0-9a-f]+$|^[0-9A-F]+$', 6, 26)"
        return _let("v", value, f"concat(substr(m, 1, length(m) - length(v)), {_symbols('v', key, kind, letters)})")
    if kind == "email":
        return _let("v", "substring_index(m, '@', 1)", f"concat({_symbols('v', key, kind)}, '@', lower(substring_index(m, '@', -1)))")
    if kind == "iban":
        new = _let("p", _symbols("substr(v, 5)", key, kind), f"concat(substr(v, 1, 2), lpad(98 - {_mod97('concat(p, substr(v, 1, 2), ' + chr(39) + '00' + chr(39) + ')')}, 2, '0'), p)")
        return _let("v", "replace(m, ' ', '')", f"if(length(v) between 15 and 34 and {_mod97('concat(substr(v, 5), substr(v, 1, 4))')} = 1, {_filled('m', new, ' ')}, m)")
    if kind == "ip":
        return _let("v", "transform(split(m, r'\\.'), x -> int(x))", f"if(array_max(v) < 256, array_join({_permuted('v', 'array(256, 256, 256, 256)', key, kind)}, '.'), m)")
    if kind == "phone":
        head = r"^(?:\+1(?![0-9]{0,2}[ .(-])|\+[0-9]{1,3}(?=[ .(-])|\+1|\+[0-9]{2})"
        tail = _let("t", "substr(m, length(h0) + 1)", _filled("t", _symbols("regexp_replace(t, '[^0-9]', '')", key, kind), "[^0-9]"))
        return _let("h0", f"regexp_extract(m, {_sql(head)}, 0)", f"concat(h0, {tail})")
    if kind == "card":
        new = _let("p", f"concat(substr(v, 1, 1), {_symbols('substr(v, 2, length(v) - 2)', key, kind)})", f"concat(p, (10 - {_luhn('p', 1)} % 10) % 10)")
        return _let("v", "regexp_replace(m, '[^0-9]', '')", f"if({_luhn('v', 0)} % 10 = 0 and not v rlike '^0+$', {_filled('m', new, '[^0-9]')}, m)")
    if kind == "ssn":
        moved = _permuted("array(v[0] - if(v[0] > 666, 2, 1), v[1] - 1, v[2] - 1)", "array(898, 99, 9999)", key, kind)
        out = _let("w", moved, "concat(lpad(w[0] + if(w[0] > 664, 2, 1), 3, '0'), '-', lpad(w[1] + 1, 2, '0'), '-', lpad(w[2] + 1, 4, '0'))")
        return _let("v", "transform(split(m, '-'), x -> int(x))", f"if(v[0] between 1 and 899 and v[0] <> 666 and v[1] > 0 and v[2] > 0, {out}, m)")
    return f"if(m rlike '^[0-9]{{2}}/', {_slashed_date(key)}, {_date(key)})"


def _date(key: str) -> str:
    """A day of 1700 to 2099 in a format that says where day and month stand."""
    format = "case when m rlike '^[0-9]{4}-' then 'yyyy-MM-dd' when m rlike '^[0-9]{4}/' then 'yyyy/MM/dd' else 'dd.MM.yyyy' end"
    moved = _permuted("array(int(n div 773), int(n % 773))", "array(189, 773)", key, "date")
    new = _let("w", moved, f"date_format(date_add({FIRST_DAY}, w[0] * 773 + w[1]), f)")
    days = f"datediff(date(try_to_timestamp(m, f)), {FIRST_DAY})"
    return _let("f", format, _let("n", days, f"if(n between 0 and 146096, {new}, m)"))


def _slashed_date(key: str) -> str:
    """A day as dd/MM/yyyy or MM/dd/yyyy. What can be read both ways stays so, and what
    can be read one way stays in that way, so that no two values meet.

    Days from the 13th on are numbered without the first twelve of each month: there
    are 9 x 9833 of them in 400 years.
    """
    both = _permuted("array(v[0] - 1, v[1] - 1, v[2] - 1700)", "array(12, 12, 400)", key, "date both ways")
    either = _let("w", both, "concat(lpad(w[0] + 1, 2, '0'), '/', lpad(w[1] + 1, 2, '0'), '/', w[2] + 1700)")
    months = "12 * (v[2] - 1700) + if(v[0] > 12, v[1], v[0])"
    rank = f"datediff(date(try_to_timestamp(m, f)), {FIRST_DAY}) - 12 * ({months})"
    moved = _permuted("array(int(n div 9833), int(n % 9833))", "array(9, 9833)", key, "date one way")
    before = f"datediff(add_months({FIRST_DAY}, x), {FIRST_DAY}) - 12 * x"
    after = f"datediff(add_months({FIRST_DAY}, x + 1), {FIRST_DAY}) - 12 * (x + 1)"
    month = f"filter(sequence(greatest(r * 4800 div 88497 - 2, 0), r * 4800 div 88497 + 2), x -> {before} <= r and r < {after})[0]"
    day = _let("y", f"int({month})", f"date_format(date_add({FIRST_DAY}, r + 12 * (y + 1)), f)")
    one = _let("n", rank, f"if(n is null, m, {_let('w', moved, _let('r', 'w[0] * 9833 + w[1]', day))})")
    one = _let("f", "if(v[0] > 12, 'dd/MM/yyyy', 'MM/dd/yyyy')", one)
    return _let("v", "transform(split(m, '/'), x -> int(x))", f"case when v[2] not between 1700 and 2099 or v[0] = 0 or v[1] = 0 or least(v[0], v[1]) > 12 then m when greatest(v[0], v[1]) <= 12 then {either} else {one} end")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS), count: str | None = None) -> DataFrame:
    """``docs`` with the personal data of its text column replaced; other columns stay.

    ``count``: name of an added column with the number of replaced values (null for
    a null text). One narrow pass without shuffle. A null text stays null, an empty
    one empty; texts of any length are searched whole; rows and ids may repeat; an empty
    table gives an empty result. A column that has the name of ``count`` is replaced.
    """
    master = _sql("|".join(PATTERNS[k] for k in kinds))
    which = " ".join(f"when m rlike {_sql('^(?:' + PATTERNS[k] + ')$')} then {_pseudonym(k, key)}" for k in kinds)
    at = {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}
    text_ = at[text.lower()]
    rows = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    found = rows.withColumn("found", F.expr(f"if({text_} rlike '{HINT}', regexp_extract_all({text_}, {master}, 0), array())"))
    new = found.withColumn("new", F.expr(f"transform(found, m -> case {which} else m end)"))
    joined = f"array_join(flatten(zip_with(split({text_}, {master}, -1), new, (g, m) -> array(g, coalesce(m, '')))), '')"
    out = {c: F.col(at[c.lower()]) for c in docs.columns} | {text: F.expr(f"if(size(found) > 0, {joined}, {text_})")}
    if count:
        out = {c: x for c, x in out.items() if c.lower() != count.lower()}
        changed = F.expr("size(filter(zip_with(found, new, (a, b) -> a <> b), x -> x))")
        out[count] = F.when(F.col(text_).isNotNull(), changed)
    return new.select(*[c.alias(n) for n, c in out.items()])
