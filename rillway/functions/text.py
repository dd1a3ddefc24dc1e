"""String functions, Column to Column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.functions.binding import let
from rillway.sources.fields import named

# Characters that count as white space and as line ends in Unicode text processing.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same as patterns. (?U) makes \s the Unicode property, in one test per character.
SPACE = r"(?U:[\s\x1c-\x1f])"
NOT_SPACE = r"(?U:[^\s\x1c-\x1f])"
INLINE_SPACE = r"(?U:[\s\x1f&&[^\n]])"
LINE_END = r"\R|[\x1c-\x1e]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def unify_line_ends(c: Column) -> Column:
    return F.regexp_replace(c, LINE_END, "\n")


def lines_of(c: Column) -> Column:
    """The lines of a text as an array; a final line end opens no further line."""

    def without_last_blank(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return let(F.split(c, LINE_END), without_last_blank)


def count_lines(c: Column) -> Column:
    parts = F.split(c, LINE_END)
    return F.size(parts) - (F.element_at(parts, -1) == "").cast("int")


def pad(c: Column, side: str, char: str, length: int) -> Column:
    """Pad to a length; longer text stays as it is."""
    padded = F.lpad(c, length, char) if side == "left" else F.rpad(c, length, char)
    return F.when(F.char_length(c) < length, padded).otherwise(c)


def keep_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def drop_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "")


_SPECIAL = {"cr": "\r", "lf": "\n", "crlf": "\r\n", "tab": "\t", "space": " "}


def drop_special(c: Column, kind: str) -> Column:
    return F.translate(c, _SPECIAL[kind], "")


# Markup characters and their entities; & comes first when escaping.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_markup(c: Column) -> Column:
    for char, entity in ENTITIES:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def unescape_markup(c: Column) -> Column:
    for char, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@dataclass(frozen=True)
class StringOp:
    """String clean-up of one column, applied in the order of the attributes.

    ``out`` names the result column; without it the column is changed in place.
    """

    trim: str = "none"
    case: str = "none"
    pad: tuple[str, str, int] | None = None
    init_cap: bool = False
    mask: str = "none"
    digits: str = "none"
    remove: str = "none"
    out: str | None = None

    def apply(self, c: Column) -> Column:
        c = {"none": lambda x: x, "left": F.ltrim, "right": F.rtrim, "both": F.trim}[self.trim](c)
        c = {"none": lambda x: x, "lower": F.lower, "upper": F.upper}[self.case](c)
        if self.pad:
            c = pad(c, *self.pad)
        if self.init_cap:
            c = F.initcap(c)
        c = {"none": lambda x: x, "escape": escape_markup, "unescape": unescape_markup}[self.mask](c)
        c = {"none": lambda x: x, "only": keep_digits, "remove": drop_digits}[self.digits](c)
        return c if self.remove == "none" else drop_special(c, self.remove)


def string_ops(df: DataFrame, ops: dict[str, StringOp]) -> DataFrame:
    return df.withColumns({op.out or name: op.apply(named(name)) for name, op in ops.items()})


def contains_any(c: Column, tokens: Sequence[str]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(c, F.lit(token))
    return found


def safe_name(c: Column) -> Column:
    """Characters that do not suit a file name become underscores."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_")


def stem_key(c: Column) -> Column:
    """Key that pairs a document with its derived one: plain lower-case name without the suffix."""
    plain = F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", "_"))
    return F.regexp_replace(plain, r"(_converted|_corrected)$", "")


def piece(c: Column, sep: str, index: int) -> Column:
    """Piece at a 0-based index, NULL beyond the end. ``sep`` is literal."""
    return F.get(F.split(c, r"\Q" + sep + r"\E"), F.lit(index))


def concat_as_text(*cols: Column) -> Column:
    """Values as text, one after the other; NULL if any is NULL."""
    return F.concat(*[c.cast("string") for c in cols])
