"""Trade condition codes: normal form and classes, as expressions on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code -> bucket.
CODEBOOK = {
    "": "NEUTRAL", "0": "NEUTRAL",
    "F": "SOFT_INCLUDE", "IS": "SOFT_INCLUDE",
    "T": "HARD_EXCLUDE", "U": "HARD_EXCLUDE", "Z": "HARD_EXCLUDE", "N": "HARD_EXCLUDE", "R6": "HARD_EXCLUDE", "R": "HARD_EXCLUDE",
    "O": "HARD_EXCLUDE", "Q": "HARD_EXCLUDE", "M": "HARD_EXCLUDE", "6": "HARD_EXCLUDE", "5": "HARD_EXCLUDE", "L": "HARD_EXCLUDE",
    "I": "HARD_EXCLUDE", "4": "HARD_EXCLUDE", "W": "HARD_EXCLUDE", "B": "HARD_EXCLUDE", "H": "HARD_EXCLUDE", "X": "HARD_EXCLUDE",
    "S": "HARD_EXCLUDE", "P": "HARD_EXCLUDE", "7": "HARD_EXCLUDE", "CT": "HARD_EXCLUDE",
}


def normalized(cond: Column, strict_null: bool = False) -> Column:
    """Tokens trimmed, in upper case and sorted; empty ones and 0 dropped, repeated ones kept. NULL is a regular
    sale, or the unknown token NAN where strict_null is set."""
    text = F.coalesce(cond.cast("string"), F.lit("nan" if strict_null else ""))
    tokens = F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x)))
    return F.array_join(F.array_sort(F.filter(tokens, lambda x: (x != "") & (x != "0"))), ",")


def _tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, ","), lambda x: x != "")


def _of_bucket(codebook: dict[str, str], *buckets: str) -> list[str]:
    return [k for k, v in codebook.items() if v in buckets and k]


def unknown_tokens(norm: Column, codebook: dict[str, str] | None = None) -> Column:
    known = [k for k in (codebook or CODEBOOK) if k]
    return F.filter(_tokens(norm), lambda x: ~x.isin(known))


def kept(norm: Column, codebook: dict[str, str] | None = None) -> Column:
    """True if every token is known and none is excluded."""
    good = _of_bucket(codebook or CODEBOOK, "SOFT_INCLUDE", "NEUTRAL")
    return F.forall(_tokens(norm), lambda x: x.isin(good))
