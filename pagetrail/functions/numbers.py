"""Numbers, units and periods of printed tables as Column functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import let, norm_text


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


_MINUS = f"^{_class(P.LEADING_MINUS)}"
#: Characters of the basic plane whose compatibility form is one ASCII character.
_FORMS = {c: n for c in map(chr, range(0x80, 0xFFFF)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii()}


def to_double(col: Column) -> Column:
    """A double, or NULL for what is not a plain decimal number."""
    s = F.trim(col.cast("string"))
    return F.when(s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))


def _compatible(s: Column) -> Column:
    """Compatibility forms of single characters (full-width, superscript, circled and other digits and signs, spaces), and ligature dots."""
    return F.replace(F.translate(s, "".join(_FORMS), "".join(_FORMS.values())), F.lit("\u2026"), F.lit("..."))


def parse_number(raw: Column) -> Column:
    """The number a cell prints, or NULL.

    Footnote marks go first, before superscripts could turn into digits; brackets and any dash mean minus; scale words,
    per cent signs and spaces go; of several dots the last is the decimal one unless three digits follow it.
    """
    def signed(s: Column) -> Column:
        bracketed = s.startswith("(") & s.endswith(")")
        inner = F.when(bracketed, F.trim(F.regexp_replace(s, r"^\(|\)$", ""))).otherwise(s)
        return let(inner, lambda t: let(_digits(t), lambda d: F.when(~F.lower(s).isin(P.EMPTY_TOKENS), F.when(bracketed | t.rlike(_MINUS), -d).otherwise(d))))

    return let(F.trim(_compatible(F.regexp_replace(F.trim(raw.cast("string")), P.FOOTNOTES, ""))), signed)


def _digits(t: Column) -> Column:
    """The unsigned number of a cell without brackets."""
    u = F.regexp_replace(F.regexp_replace(t, _MINUS, ""), r"(?iu)(млрд|млн|тыс)\.?\s*(руб[\p{L}]*\.?)?", "")
    u = F.replace(F.regexp_replace(F.replace(u, F.lit("%"), F.lit("")), _class(P.GROUP_SPACES), ""), F.lit(","), F.lit("."))

    def joined(g: Column) -> Column:
        last, head = F.element_at(g, -1), F.array_join(F.slice(g, 1, F.greatest(F.lit(1), F.size(g) - 1)), "")
        return F.when(F.size(g) <= 2, F.array_join(g, ".")).when(F.length(last) == 3, F.array_join(g, "")).otherwise(F.concat(head, F.lit("."), last))

    return let(let(F.split(F.regexp_replace(u, r"\.+$", ""), r"\."), joined), to_double)


def norm_num(raw: Column) -> Column:
    """The stricter reading of a cell: digits with at most one decimal part, else NULL."""
    s = F.regexp_replace(F.trim(raw.cast("string")), r"\*+$", "")
    bracketed = s.startswith("(") & s.endswith(")")
    s = F.when(bracketed, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _class(P.CELL_SPACES), ""), _class(P.CELL_DASHES), "-"), "%+$", "")
    s = F.regexp_replace(s, r"^\+", "")
    minus = s.startswith("-")
    s = F.replace(F.regexp_replace(s, "^-", ""), F.lit(","), F.lit("."))
    value = F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))
    return F.when(bracketed | minus, -value).otherwise(value)


def is_value(text: Column, allow_pct: bool = False) -> Column:
    """Does a label print a value? A leading plus marks growth labels, which do not count."""
    t = F.trim(text)
    t = F.regexp_replace(t, "%+$", "") if allow_pct else t
    return t.rlike(r"^[-\x{2212}\x{2013}(]?[0-9][0-9\x{a0}\x{202f}\x{2009}\x{2007}\x{2060}\x{20}]*(?:[,.][0-9]+)?\)?$")


def unit_of(text: Column) -> Column:
    return reduce(lambda e, p: e.when(text.rlike(f"(?iu){p[0]}"), p[1]), P.UNIT_PATTERNS[1:], F.when(text.rlike(f"(?iu){P.UNIT_PATTERNS[0][0]}"), P.UNIT_PATTERNS[0][1]))


def extract_unit(*sources: Column) -> Column:
    """Unit of the first source that names one."""
    return F.coalesce(*[unit_of(s) for s in sources])


def parse_cell(raw: Column, *unit_sources: Column) -> Column:
    """struct(v, u); both NULL without a value. The cell itself is the first place to look for a unit."""
    v = parse_number(raw)
    return F.struct(v.alias("v"), F.when(v.isNotNull(), extract_unit(raw, *unit_sources)).alias("u"))


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key]


def norm_unit(unit: Column) -> Column:
    """The unit's usual name, itself if unknown, '' for NULL."""
    t = F.replace(F.lower(F.trim(unit)), F.lit("ё"), F.lit("е"))
    return F.coalesce(_named(t, P.UNIT_NAMES), _named(norm_text(unit), P.UNIT_NAMES), t, F.lit(""))


def norm_period(period: Column) -> Column:
    """Dates as ISO, quarters as 4кв2025, aliases by name, else normalised text; '' for NULL."""
    raw = F.trim(period)
    t = F.coalesce(_named(raw, P.PERIOD_NAMES), norm_text(period))
    t = F.replace(F.replace(t, F.lit("кв'"), F.lit("кв")), F.lit("к'"), F.lit("кв"))
    return (
        F.when(period.isNull(), "")
        .when(raw.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.regexp_replace(raw, r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$", "$3-$2-$1"))
        .when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw)
        .when(t.rlike(r"^[0-9]\s*кв\s*[0-9]{4}$"), F.regexp_replace(t, r"\s+", ""))
        .otherwise(t)
    )


def format_ru(value: Column, digits: int = 1) -> Column:
    """1441.1 as 1 441,1."""
    return F.translate(F.format_number(value, digits), ",.", " ,")
