"""Patterns and column expressions on text. Positions are code points from 0, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's own class only holds ASCII.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The code points of SPACE.
SPACE_CODES = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]

#: Patterns of identifiers, in order of priority (fixed values): kind, expression.
PATTERNS = [
    ("url", r"https?://[\w\-._~:/?#\[\]@!$&'()*+,;=%]+"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("iban", r"[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}(?:[\s]?[\dA-Z]{4}){2,7}[\s]?[\dA-Z]{1,4}"),
    ("ssn_fr", r"[12]\s?\d{2}\s?\d{2}\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}\s?\d{2}"),
    ("phone", r"(?:(?:\+|00)33|0)\s*[1-9](?:[\s.-]*\d{2}){4}"),
    ("phone", r"(?:\+44|0)[\s.-]?\d{4}[\s.-]?\d{6}"),
]
#: White space, word, number, or one other character (fixed values).
BASIC = r"\s+|[a-zA-ZÀ-ÿ](?:[a-zA-ZÀ-ÿ'-]*[a-zA-ZÀ-ÿ])?|\d+(?:[.,]\d+)*|[^\s]"
WORD_START, CAPITAL = r"^[a-zA-ZÀ-ÿ]", r"[A-ZÀ-Ý]"
#: The code points that a word begins with, and those of capitals.
LETTER_CODES, CAPITAL_CODES = [*range(65, 91), *range(97, 123), *range(192, 256)], [*range(65, 91), *range(192, 222)]
#: BASIC's words and BASIC in the form that Java is fast with: letters one by one are a table of bits, ranges are calls; the
#: most frequent comes first, and what can't match otherwise isn't tried again.
_LETTER = "[" + "".join(map(chr, LETTER_CODES)) + "]"
WORDS = rf"{_LETTER}+(?:['-]+{_LETTER}+)*+"
TOKENS = rf"{WORDS}|{SPACE}+|\d+(?:[.,]\d+)*+|[^{SPACE[1:-1]}]"
#: Without any of these a text has no identifier.
HINTED = "[0-9@]|://"


def unicode_space(pattern: str) -> str:
    """The pattern with \\s for all of Unicode's white space."""
    inner = SPACE[1:-1]
    return pattern.replace(r"[^\s]", f"[^{inner}]").replace(r"[\s]", f"[{inner}]").replace(r"[\s.-]", f"[{inner}.-]").replace(r"\s", f"[{inner}]")


SPAN = "array<struct<start:int,end:int,kind:string,text:string>>"


#: What a text must hold for a pattern to match at all; looked for before the pattern.
HINTS = {"url": "://", "email": "@"}


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Spans of all matches: gaps and matches take turns, and their lengths add up to the positions.

    The one-element array binds the matches to a name: the pattern runs once, and a second time for the gaps of texts
    that have matches.
    """
    java = unicode_space(pattern)
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["text"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, java, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(none)

    spans = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(java), F.lit(0))), placed), F.lit(0))
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike("[0-9]") if kind in ("iban", "ssn_fr", "phone") else None
    return spans if hint is None else F.when(hint, spans).otherwise(none)


def iban_remainder(text: Column) -> Column:
    """The number that an IBAN's letters and digits make, its first four at the end, modulo 97; null if shorter than five."""
    plain = F.upper(F.regexp_replace(text, SPACE, ""))
    turned = F.concat(F.substring(plain, 5, 1 << 30), F.substring(plain, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.when(F.length(plain) >= 5, F.aggregate(signs, F.lit(0), step))


def capitalized(word: Column) -> Column:
    """Whether the first character is one of CAPITAL."""
    return F.ascii(word).between(65, 90) | F.ascii(word).between(192, 221)


def all_upper(word: Column) -> Column:
    return (word == F.upper(word)) & word.rlike(CAPITAL)


def canonical(text: Column) -> Column:
    """Trimmed, upper-case, white space in runs as one space."""
    upper = F.upper(F.btrim(text, F.lit("".join(map(chr, SPACE_CODES)))))
    # Most texts have single blanks, if any: looking for other white space takes less than replacing it.
    return F.when(text.rlike("  |" + SPACE.replace(" ", "", 1)), F.regexp_replace(upper, f"{SPACE}+", " ")).otherwise(upper)


def fingerprint(text: Column) -> Column:
    """SHA-256, in hexadecimal, of the first 200 characters."""
    return F.sha2(F.substring(text, 1, 200).cast("binary"), 256)


def csv_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def html_escaped(value: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(entity))
    return value


def picked(pool: list[str], *of: Column) -> Column:
    """One of the pool, the same for the same columns, however often a task runs."""
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.xxhash64(*of), F.lit(len(pool))) + 1).cast("int"))


def masked(text: Column) -> Column:
    """Digits and capitals from the fifth character on as X."""
    return F.concat(F.substring(text, 1, 4), F.regexp_replace(F.substring(text, 5, 1 << 30), "[0-9A-Z]", "X"))
