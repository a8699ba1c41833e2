"""Applicant names: the normalised key as a Column, and with its step log as an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that are taken off the end of a name.
LEGAL_SUFFIXES = (
    "gmbh co kg", "kabushiki kaisha", "private limited", "co limited", "pte ltd", "pty ltd", "pvt ltd", "co ltd", "co kg", "s p a", "l l c", "s a", "b v", "n v", "a s", "k k",
    "incorporated", "corporation", "company", "limited", "corp", "gmbh", "sarl", "inc", "ltd", "llc", "plc", "spa", "srl", "oyj", "sas", "pty", "llp", "co", "kg", "ag", "sa", "bv",
    "nv", "oy", "ab", "as", "lp", "kk", "se",
)
SUFFIX_TAIL = "^(.+?)(?: (?:" + "|".join(LEGAL_SUFFIXES) + "))*$"


def name_key(raw: Column) -> Column:
    """Key of a raw name, inside codegen. Compatibility forms need ``name_steps``."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\p{M}\s]", " "), r"\s+", " "))
    return F.nullif(F.regexp_extract(words, SUFFIX_TAIL, 1), F.lit(""))


NAME_KEY_SQL = (
    "nullif(regexp_extract(trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '"
    + SUFFIX_TAIL.replace("{", "{{").replace("}", "}}") + "', 1), '')"
)


def steps_of(raw: str | None) -> tuple[str | None, list[str]]:
    """Key and the rules that changed something; a name of legal forms only keeps the last."""
    steps: list[str] = []
    if raw is None:
        return None, steps
    text = unicodedata.normalize("NFKC", raw)
    for label, change in (
        ("casefold", str.casefold),
        ("ampersand", lambda t: t.replace("&", " and ")),
        ("punctuation", lambda t: "".join(c if c.isspace() or unicodedata.category(c)[0] in "LNM" else " " for c in t)),
    ):
        changed = change(text)
        if changed != text:
            steps.append(label)
        text = changed
    words = text.split()
    while True:
        tail = next((s for s in LEGAL_SUFFIXES if len(words) > len(s.split()) and words[-len(s.split()) :] == s.split()), None)
        if tail is None:
            return " ".join(words) or None, steps
        words = words[: -len(tail.split())]
        steps.append("suffix:" + tail)


def name_steps(raw: Column) -> Column:
    """STRUCT(key, steps) of a raw name by an Arrow UDF."""

    def run(names: pd.Series) -> pd.DataFrame:
        both = [steps_of(r) for r in names]
        return pd.DataFrame({"key": [k for k, _ in both], "steps": [s for _, s in both]})

    return F.pandas_udf(run, "key string, steps array<string>")(raw)
