"""Cleaning of names, identifiers, labels and free text."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Company-form words that carry no identity.
LEGAL_SUFFIXES = (
    "inc",
    "corp",
    "corporation",
    "co",
    "company",
    "ltd",
    "llc",
    "plc",
    "sa",
    "ag",
    "nv",
    "group",
    "holdings",
    "holding",
)

_BLANKS = " \t\n\r\x0b\x0c"
_ANY_SPACE = r"(?U)[\s\x1c-\x1f]+"


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_all(value: str | Column) -> Column:
    """Strip every ASCII blank, not only spaces."""
    return F.btrim(as_col(value), F.lit(_BLANKS))


def null_if_blank(value: str | Column) -> Column:
    return F.nullif(trim_all(value), F.lit(""))


def strip_quotes(value: str | Column) -> Column:
    return F.btrim(trim_all(value), F.lit('"'))


def strip_quotes_upper(value: str | Column) -> Column:
    return F.upper(strip_quotes(value))


def normalize_name(value: str | Column) -> Column:
    """Lower-case words of a company name without legal-form words; null becomes ''."""
    words = F.regexp_replace(F.lower(as_col(value)), r"[^a-z0-9 ]+", " ")
    kept = F.regexp_replace(words, r"\b(?:" + "|".join(LEGAL_SUFFIXES) + r")\b", " ")
    return F.coalesce(F.btrim(F.regexp_replace(kept, " +", " ")), F.lit(""))


def compact_name(value: str | Column) -> Column:
    return F.replace(normalize_name(value), F.lit(" "), F.lit(""))


def sorted_tokens(value: str | Column) -> Column:
    """Words of an already normalised name in alphabetical order."""
    return F.array_join(F.array_sort(F.split(as_col(value), " ")), " ")


def pad_id(value: str | Column, width: int = 10) -> Column:
    """Digits of an identifier, zero-padded to ``width`` and never cut."""
    digits = F.coalesce(F.regexp_replace(as_col(value).cast("string"), r"\D", ""), F.lit(""))
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def normalize_digits(value: str | Column) -> Column:
    """Digits without leading zeros; null when there are none."""
    digits = F.regexp_replace(as_col(value).cast("string"), r"[^0-9]", "")
    return F.nullif(F.regexp_replace(digits, r"^0+(?=.)", ""), F.lit(""))


def normalize_country_name(value: str | Column) -> Column:
    joined = F.replace(F.upper(as_col(value)), F.lit("&"), F.lit("AND"))
    return F.btrim(F.regexp_replace(F.regexp_replace(joined, r"[^A-Z0-9 ]+", " "), r" +", " "))


def slugify(value: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(as_col(value)), r"[^a-z0-9]+", "_"), F.lit("_"))


def extract_year(value: str | Column) -> Column:
    """First 19xx or 20xx in a text, as text; null if there is none."""
    return F.nullif(F.regexp_extract(as_col(value), r"((?:19|20)\d{2})", 1), F.lit(""))


def _entity_names() -> Column:
    """All named references as a map of maps, by their first two characters so that a lookup stays short."""
    nested: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        nested.setdefault(name[:2], {})[name] = value
    return F.from_json(F.lit(json.dumps(nested)), "map<string,map<string,string>>")


# Names that also count without a semicolon, and in front of other letters; the longest wins.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _numeric_reference(piece: Column) -> Column:
    """The character of ``&#12;`` or ``&#x1f;``, as browsers resolve it: a Windows character for a C1 control, the
    replacement character for what is no code point, nothing for other controls and non-characters."""
    digits = F.regexp_extract(piece, "^&#0*([0-9]*);?$", 1)
    hex_digits = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]*);?$", 1)
    is_hex = piece.rlike("^&#[xX]")
    known = F.when(is_hex, hex_digits).otherwise(digits)
    base = F.conv(F.concat(F.lit("0"), known), 16, 10)
    code = F.when(F.length(known) > 7, F.lit(0x110000)).otherwise(F.when(is_hex, base).otherwise(F.concat(F.lit("0"), known)).cast("int"))
    windows = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
    replaced = F.from_json(F.lit(json.dumps({str(c): v for c, v in windows.items()})), "map<string,string>")
    plane = code % 0x10000
    silent = (code < 9) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (plane >= 0xFFFE)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), replaced[code.cast("string")])
        .when(silent, F.lit(""))
        .otherwise(character)
    )


def unescape_entities(value: str | Column) -> Column:
    """Resolve numeric and all named character references once, named ones also by their longest known beginning."""
    text = as_col(value)
    names = _entity_names()

    def named(piece: Column) -> Column:
        name = F.substring(piece, 2, 40)
        whole = names[F.substring(name, 1, 2)][name]
        start = F.regexp_extract(name, f"^(?:{_OPEN_NAMES})", 0)
        begun = names[F.substring(start, 1, 2)][start]
        rest = F.substr(name, F.length(start) + 1)
        return F.coalesce(whole, F.when(start != "", F.concat(begun, rest)), piece)

    def one(piece: Column) -> Column:
        return F.when(piece.startswith("&#") & (F.length(piece) > 2), _numeric_reference(piece)).when(
            piece.startswith("&") & (F.length(piece) > 1), named(piece)
        ).otherwise(piece)

    reference = r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"
    pieces = F.regexp_extract_all(text, F.lit(reference), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def clean_html_text(value: str | Column) -> Column:
    """Visible lower-case text of a page: scripts, styles and tags out, references resolved."""
    text = F.regexp_replace(as_col(value), r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.lower(F.btrim(F.regexp_replace(unescape_entities(text), _ANY_SPACE, " ")))


def count_term(text: str | Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    text = as_col(text)
    removed = F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))
    return (removed / F.lit(len(term))).cast("bigint")


def keyword_counts(text: str | Column, groups: dict[str, list[str]], total: str) -> list[Column]:
    """One count per group of terms and the total; nested terms count twice."""
    sums = {name: reduce(lambda a, b: a + b, [count_term(text, t) for t in terms]) for name, terms in groups.items()}
    out = [expr.alias(name) for name, expr in sums.items()]
    return out + [reduce(lambda a, b: a + b, sums.values()).alias(total)]
