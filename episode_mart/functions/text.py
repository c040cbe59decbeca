"""Identifier, name and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_key(c: Column) -> Column:
    """Form in which text is compared: case and trailing blanks do not count."""
    return F.upper(F.rtrim(c))


def plain_id(c: Column) -> Column:
    """Whole numbers that a spreadsheet rendered as ``123.0`` lose the suffix."""
    return F.regexp_replace(c, r"^(\d+)\.0$", "$1")


def _undashed_syn(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("-"), F.lit("")), "(?i)SNY", "SYN")


def normalize_tx_id(c: Column) -> Column:
    """Billing identifier: no dashes, SNY -> SYN, one 86/85 prefix off, ``SYN-`` prefix back.

    Each step is one replacement, so the input expression is not repeated; a step that applies
    also drops trailing blanks.
    """
    c = F.regexp_replace(_undashed_syn(c), r"(?s)^8[56](.*?) *\z", "$1")
    return F.regexp_replace(c, r"(?s)^[Ss].{0,2}(.*?) *\z", "SYN-$1")


def normalize_rf_id(c: Column) -> Column:
    """Referral identifier: as above without the prefix rule, and any S marks a SYN patient."""
    return F.regexp_replace(_undashed_syn(c), r"(?s)^(?=.*[Ss]).{0,3}(.*?) *\z", "SYN-$1")


def visit_key(patient: Column, visit: Column) -> Column:
    """``patient-visit``, null when either part is."""
    return F.concat(patient, F.lit("-"), visit.cast("string"))


def _comma(name: Column) -> Column:
    return F.instr(name, ",")


def _after_comma(name: Column) -> Column:
    # The given names start two characters after the comma, whatever stands in between.
    return F.substring(name, _comma(name) + 2, F.length(name))


def _first_blank(c: Column) -> Column:
    return F.instr(F.concat(c, F.lit(" ")), " ")


def _if_comma(name: Column, value: Column) -> Column:
    return F.when(_comma(name) > 0, F.upper(F.trim(value)))


def last_name(name: Column) -> Column:
    return _if_comma(name, F.substring(name, F.lit(1), _comma(name) - 1))


def first_name(name: Column) -> Column:
    length = _first_blank(F.trim(_after_comma(name))) - 1
    return _if_comma(name, F.substring(name, _comma(name) + 2, length))


def middle_name(name: Column) -> Column:
    given = F.trim(_after_comma(name))
    return _if_comma(name, F.substring(given, _first_blank(given) + 1, F.length(name)))


def first_word(name: Column) -> Column:
    return F.upper(F.trim(F.substring(name, F.lit(1), _first_blank(name) - 1)))
