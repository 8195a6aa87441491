"""Whether a value has a valid form. Fixed patterns and sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtlens.functions.classify import CLASSES
from courtlens.functions.text import text

EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}(\s*(x|ext\.?)\s*[0-9]+)?$"
HEIGHT = r"^[4-7]-[0-9]{1,2}$|^[4-7]'\s*[0-9]{1,2}\"?$"
POSITIONS = ("S", "OH", "RS", "MB", "DS", "L")


def valid_email(c: Column | str) -> Column:
    return text(c).rlike(EMAIL)


def valid_phone(c: Column | str) -> Column:
    return text(c).rlike(PHONE)


def valid_height(c: Column | str) -> Column:
    return text(c).rlike(HEIGHT)


def valid_class(c: Column | str) -> Column:
    return text(c).isin(*CLASSES)


def invalid_positions(c: Column | str) -> Column:
    """The codes of a slash list that are unknown."""
    codes = F.filter(F.transform(F.split(text(c), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(codes, lambda x: ~x.isin(*POSITIONS))
