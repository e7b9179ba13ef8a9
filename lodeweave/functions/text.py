"""Cleaning and cutting strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of molecule strings. An atom in brackets may have an isotope number in front.
BRACKETED = r"(\[[^\]]+\])"
SMILES_PIECE = r"(\[[^\]]+\]|Br|Cl|%\d\d|[A-Za-z]|\d|[^A-Za-z\d\[\]%]|(?s:.))"
SMILES = r"^(?:\[\d*(?:Br|Cl|[HBCNOPSFIbcnops])[^\[\]]*\]|Br|Cl|[BCNOPSFIbcnops]|%\d\d|[()\-.=#$:/\\+@]|\d)+$"


def stripped(c: Column) -> Column:
    """Without white space at both ends; null if nothing is left."""
    out = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(out != "", out)


def first_filled(*columns: Column) -> Column:
    """The first of the columns that isn't null or blank."""
    return F.coalesce(*[stripped(c) for c in columns])


def pieces(c: Column, pattern: str) -> Column:
    """The matches of a pattern, without those of white space alone."""
    return F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: ~x.rlike(r"^\s+$"))


def well_formed(c: Column, pattern: str) -> Column:
    """Whether the pattern's matches make up the whole text."""
    return F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), "") == c


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def occurrences(text: Column, token: Column) -> Column:
    """How often token occurs in text, occurrences not overlapping; 0 for the empty token."""
    cut = F.length(text) - F.length(F.replace(text, token, F.lit("")))
    return F.when(F.length(token) > 0, cut / F.length(token)).otherwise(0).cast("long")


def looks_like_smiles(c: Column) -> Column:
    """Whether a text, stripped of white space of any kind, is made of symbols of molecule strings alone; null for null."""
    return F.when(c.isNotNull(), F.coalesce(stripped(c).rlike(SMILES), F.lit(False)))


def short_name(c: Column) -> Column:
    """The name of a model from its path: the last part, up to its first dot, but whole where it holds `gpt`."""
    leaf = F.regexp_extract(F.regexp_replace(c, r"/+$", ""), r"([^/]*)$", 1)
    return F.when(F.lower(leaf).contains("gpt"), leaf).otherwise(F.substring_index(leaf, ".", 1))


def compact(n: Column) -> Column:
    """A count with k or M: 950, 1.5k, 2.3M, one digit behind the point, which falls away if it is 0; halves to even."""
    def scaled(by: float, unit: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", F.bround(n / by, 1).cast("double")), r"\.0$", ""), F.lit(unit))

    return F.when(F.abs(n) >= 1e6, scaled(1e6, "M")).when(F.abs(n) >= 1e3, scaled(1e3, "k")).otherwise(F.format_string("%.0f", n.cast("double")))


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n.cast("long"), 0)


def percent(x: Column, digits: int = 1) -> Column:
    """A share as a percentage; halves to even."""
    return F.concat(F.format_string(f"%.{digits}f", F.bround(x * 100, digits).cast("double")), F.lit("%"))
