"""Discrete speech units as text: private-use code points or ``<extra_id_i>`` marks (S1-S6), and label sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable.functions.bind import bind

#: Fixed value: the first code point of supplementary private use area A.
FIRST = 983040
#: Code points of a plane, and how many of them are private use in either area (the last two are no characters).
PLANE, MOST = 65536, 65534
PAD = -1


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unit_char(i: Column | str) -> Column:
    """The private-use character of unit i, of area A or B. Raises outside them, as the unit would not be private use."""
    i = _col(i).cast("int")
    ok = (i >= 0) & (i < 2 * PLANE) & (i % PLANE < MOST)
    code = F.lpad(F.hex((i + FIRST).cast("long")), 8, "0")
    return F.when(i.isNotNull() & F.assert_true(ok, F.lit("a unit is outside the private use area")).isNull(), F.decode(F.unhex(code), "UTF-32"))


def char_unit(c: Column | str) -> Column:
    """The unit of a private-use character."""
    return F.ascii(_col(c)) - FIRST


def unit_mark(i: Column | str) -> Column:
    return F.concat(F.lit("<extra_id_"), _col(i).cast("string"), F.lit(">"))


def unit_string(labels: Column | str, form: str = "pua") -> Column:
    """An array of labels as one string without separators; ``form`` is "pua" or "mark"."""
    one = {"pua": unit_char, "mark": unit_mark}[form]
    return F.array_join(F.transform(_col(labels), one), "")


def string_units(text: Column | str) -> Column:
    """The labels in a string of private-use characters."""
    text = _col(text)
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), char_unit)


def spaced(labels: Column | str) -> Column:
    """An array of labels as one string with spaces between."""
    return F.array_join(F.transform(_col(labels), lambda x: x.cast("string")), " ")


def collapse(values: Column | str) -> Column:
    """An array without elements that equal the one before (nulls equal nulls)."""
    return bind(_col(values), lambda v: F.filter(v, lambda x, i: (i == 0) | ~x.eqNullSafe(F.element_at(v, F.greatest(i, F.lit(1))))))


def collapse_chars(text: Column | str) -> Column:
    """A string without characters that equal the one before, line ends included."""
    return F.regexp_replace(_col(text), r"(?s)(.)\1+", "$1")


def detokenize(labels: Column | str, as_labels: bool = False, deduplicate: bool = True, form: str = "pua") -> Column:
    """Labels without padding, with runs collapsed, as a string or (``as_labels``) still as an array."""
    out = F.filter(_col(labels), lambda x: x != PAD)
    out = collapse(out) if deduplicate else out
    return out if as_labels else unit_string(out, form)


def masked(labels: Column | str, mask: Column | str) -> Column:
    """Labels where the mask is true, else the padding (S17)."""
    return F.zip_with(_col(labels), _col(mask), lambda x, m: F.when(m, x).otherwise(F.lit(PAD)))
