"""Character classes and scalar text functions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a line (fixed values: Unicode white space and the four separators).
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Hyphens that a line can break at, sentence ends, and CJK ideographs of the basic block (fixed values).
HYPHENS = "-­‐‑⁃"
HYPHEN = r"[-\x{ad}\x{2010}\x{2011}\x{2043}]"
SENTENCE_END = r"[.!?。！？…”\x22]"
CJK = r"[\x{4e00}-\x{9fff}]"
#: How lines begin that are never joined with others, after stripping (fixed values).
SENSITIVE = r"^(?:#|- |\* |> |\||<table|</table|\$\$|[0-9]+\.|(?:Figure|Fig\.|Table)" + WS + r"*[0-9]+)"
#: Full-width digits and letters and their half-width forms, from their code points.
FULL = "".join(chr(c + 0xFEE0) for r in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)) for c in range(*r))
HALF = "".join(chr(ord(c) - 0xFEE0) for c in FULL)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+\z", "")


def first_char(text: Column) -> Column:
    return F.substring(text, 1, 1)


def last_char(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.substring(text, -1, 1)).otherwise("")


def is_cjk(char: Column) -> Column:
    """Whether the text begins with an ideograph of the basic block; false for an empty one."""
    return char.rlike(rf"\A{CJK}")


def ends_sentence(char: Column) -> Column:
    return char.rlike(rf"\A{SENTENCE_END}")


def is_hyphen(char: Column) -> Column:
    return char.rlike(rf"\A{HYPHEN}")


def is_lower(char: Column) -> Column:
    return char.rlike(r"\A\p{Ll}")


def is_alpha(char: Column) -> Column:
    return char.rlike(r"\A\p{L}")


def full_to_half(text: Column) -> Column:
    """Full-width digits and letters to half width; marks and ideographic spaces stay."""
    return F.translate(text, FULL, HALF)


def drop_hyphens(text: Column) -> Column:
    """Without trailing blanks and then without any trailing hyphens."""
    return F.regexp_replace(rstrip(text), rf"{HYPHEN}+\z", "")


def strip_fences(text: Column) -> Column:
    return F.replace(text, F.lit("```"), F.lit(""))


def base64_of(data: Column) -> Column:
    """Base64 in one line."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def in_order(order: Column | str, value: Column, separator: str) -> Column:
    """Aggregate: the values joined in the order of a unique key."""
    pairs = F.array_sort(F.collect_list(F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), separator)
