"""Scalar functions over strings, as Spark columns and as plain Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENUMERATOR = r"^(?:[0-9]+|[A-Za-z])[.)][ \t]+"


def norm_heading(text: str) -> str:
    """A heading for comparison: no enumerator, no trailing colon, lower case."""
    return re.sub(r"[ \t]*:[ \t]*$", "", re.sub(_ENUMERATOR, "", text.strip())).strip().lower()


def norm_heading_col(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), _ENUMERATOR, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"[ \t]*:[ \t]*$", "")))


def slugify(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")


def slugify_col(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def ns_of(ref: Column) -> Column:
    """The namespace of an id: what stands before its last hyphen."""
    return F.nullif(F.regexp_extract(ref, r"^([A-Z][A-Z0-9-]*)-[0-9]+$", 1), F.lit(""))


def number_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^[A-Z][A-Z0-9-]*-([0-9]+)$", 1).try_cast("bigint")


def split_id(ref: str) -> tuple[str, int] | None:
    m = re.fullmatch(r"([A-Z][A-Z0-9-]*)-([0-9]+)", ref.strip())
    return (m[1], int(m[2])) if m else None


def token_pattern(prefixes: list[str]) -> str:
    """Mentions of ids with these prefixes; the longest prefix wins, words around them do not count."""
    names = "|".join(re.escape(p) for p in sorted(prefixes, key=lambda p: (-len(p), p)))
    return rf"(?<![A-Za-z0-9_])({names or '(?!)'})-([0-9]+)(?![A-Za-z0-9_])"


def date_of(text: Column) -> Column:
    """A date in the form YYYY-MM-DD, null for anything else and for days the calendar lacks."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def is_datetime(text: Column) -> Column:
    """RFC 3339 with an offset, on a day that exists."""
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])$"
    return text.rlike(form) & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
