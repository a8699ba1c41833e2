"""Column functions for publication numbers and classification codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of identifiers.
PUB_SHAPE = r"^([A-Z]{2})([0-9A-Z]+?)([A-Z][0-9]?)?$"
CODE_SHAPE = r"^([A-HY][0-9]{2}[A-Z])([0-9]{1,4})/([0-9]{2,6})$"
SYMBOL_SHAPE = r"^([A-Z][0-9]{2}[A-Z])([0-9]+)/([0-9]+)$"


def squeezed(raw: Column) -> Column:
    """Upper case without white space, comma, hyphen, slash or point."""
    return F.regexp_replace(F.upper(F.trim(raw)), r"[\s,\-/.]", "")


def pub_parts(raw: Column, strict: bool = True) -> Column:
    """STRUCT(country, number, kind) of a raw publication number, null where it is none.

    ``strict`` applies the published acceptance rules; otherwise any punctuation is ignored first,
    which reads every spelling of a number that differs in separators only.
    """
    s = squeezed(raw) if strict else F.regexp_replace(F.upper(raw), r"[^0-9A-Z]", "")
    country, number = F.regexp_extract(s, PUB_SHAPE, 1), F.regexp_extract(s, PUB_SHAPE, 2)
    kind = F.nullif(F.regexp_extract(s, PUB_SHAPE, 3), F.lit(""))
    ends_in_digit = number.rlike("[0-9]$")
    check_letter = (country == "SG") & number.rlike("^[0-9]+.$")
    fits = (country != "") & number.rlike("[0-9]") & (kind.isNull() | ends_in_digit | check_letter)
    return F.when(fits, F.struct(country.alias("country"), number.alias("number"), kind.alias("kind")))


def read_number(raw: str | None) -> tuple[str, str, str | None] | None:
    """``pub_parts`` under the strict rules for one text outside Spark."""
    m = re.fullmatch(PUB_SHAPE.strip("^$"), re.sub(r"[\s,\-/.]", "", (raw or "").strip().upper()))
    if m is None or not re.search("[0-9]", m[2]):
        return None
    checked = m[1] == "SG" and re.fullmatch("[0-9]+.", m[2])
    return (m[1], m[2], m[3]) if m[3] is None or m[2][-1] in "0123456789" or checked else None


def pub_text(parts: Column) -> Column:
    """Country, number and kind written together; null if there is no number."""
    return F.when(
        parts.isNotNull() & parts["country"].isNotNull() & parts["number"].isNotNull(),
        F.concat(F.upper(parts["country"]), F.upper(parts["number"]), F.upper(F.coalesce(parts["kind"], F.lit("")))),
    )


def pub_key(publication: Column, raw: Column) -> Column:
    """Normal form of a publication: from its struct, else from the raw spelling."""
    return F.coalesce(pub_text(publication), pub_text(pub_parts(raw, strict=False)))


def norm_symbol(raw: Column) -> Column:
    """A classification symbol without spaces, upper case, leading zeros of the group removed; null if blank."""
    s = F.regexp_replace(F.upper(raw), r"[\s\p{Z}]", "")
    group = F.regexp_replace(F.regexp_extract(s, SYMBOL_SHAPE, 2), "^0+(?=[0-9])", "")
    joined = F.concat(F.regexp_extract(s, SYMBOL_SHAPE, 1), group, F.lit("/"), F.regexp_extract(s, SYMBOL_SHAPE, 3))
    return F.nullif(F.when(s.rlike(SYMBOL_SHAPE), joined).otherwise(s), F.lit(""))


def norm_code(raw: Column) -> Column:
    """A group-level code in normal form, null if the text is no such code."""
    s = F.regexp_replace(F.upper(raw), r"\s", "")
    return F.when(
        s.rlike(CODE_SHAPE),
        F.concat(
            F.regexp_extract(s, CODE_SHAPE, 1),
            F.regexp_extract(s, CODE_SHAPE, 2).cast("int").cast("string"),
            F.lit("/"),
            F.regexp_extract(s, CODE_SHAPE, 3),
        ),
    )
