"""Typed values out of text: dates, amounts, tax numbers, quantities, document class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import _c, contains_any, squeeze


def parse_date(c: Column | str) -> Column:
    """First format that fits; null if none. The value goes through a list of one, so that it is computed once, not per format."""
    fit = lambda v: F.coalesce(*[F.try_to_timestamp(v, F.lit(f)).cast("date") for f in V.DATE_FORMATS])
    return F.get(F.transform(F.array(F.trim(_c(c))), fit), F.lit(0))


def parse_amount(c: Column | str) -> Column:
    """Last number, after commas and a leading currency are taken off."""
    v = F.trim(F.regexp_replace(_c(c), ",", ""))
    v = F.regexp_replace(F.regexp_replace(v, r"(?i)^(?:rs\.?|inr|₹)\s*", ""), r"^I(?=\d)", "")
    return F.try_element_at(F.regexp_extract_all(v, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1)).cast("double")


def parse_gstin(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.upper(_c(c)), "[0-9A-Z]{15}", 0), F.lit(""))


def parse_quantity(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(c), ",", ""), r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def parse_text(c: Column | str) -> Column:
    return F.nullif(squeeze(c), F.lit(""))


def parse_value(kind: str, c: Column | str) -> Column:
    return {"date": parse_date, "amount": parse_amount, "gstin": parse_gstin, "text": parse_text}[kind](c)


def number_text(c: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def classify(c: Column | str) -> Column:
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.when(contains_any(t, ["bill of material", "\nbom"]), "bom").when(contains_any(t, ["tax invoice", "invoice no", "invoice number"]), "invoice").when(F.contains(t, F.lit("receipt")), "receipt").otherwise("unknown")
