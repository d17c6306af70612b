"""Names of protocols, files and barcodes: parsing and rendering as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def schedule_policy(path: Column) -> Column:
    """What stands between the last ``-`` and the dot after it, upper-cased; empty if there is none."""
    return F.regexp_extract(F.upper(path), r"^.*-([^.]*)\.", 1)


def channel_of_file(name: Column) -> Column:
    """Channel number of ``..._CH<n>.``; null if the name has none."""
    return F.regexp_extract(name, r"_CH(\d+)\.", 1).try_cast("int")


def inner_name(name: Column) -> Column:
    """Between the first and the last underscore."""
    return F.regexp_extract(name, r"^[^_]*_(.*)_[^_]*$", 1)


def data_file_of_metadata(name: Column) -> Column:
    return F.regexp_replace(name, r"_Metadata(?=\.csv$)", "")


def readable_structured(name: Column) -> Column:
    """Readable form of a two-step name such as ``8C_35PER_3_6C``; one opening bracket goes after its rate."""
    # fixed values: the marks of old schedule names and what they stand for, applied in this order
    text = _replaced(name, [("C_", "C("), ("_", "."), ("PER.", "%)-"), ("(NEWSTRUCTURE", ""), ("VARCHARGE.", ""), ("(100CYCLES", "")])
    digit = F.regexp_extract(text, r"C(\d)", 1)
    return F.when(digit == "", text).otherwise(F.regexp_replace(text, F.lit(r"C\d"), F.concat(F.lit("C("), digit)))


def readable_steps(name: Column) -> Column:
    """``3_6PT0`` style names: underscores separate steps, pt is the decimal point."""
    return _replaced(name, [("_", "-"), ("pt", "."), ("PT", ".")])


def readable_plain(name: Column) -> Column:
    return _replaced(name, [("_", "."), ("-", "("), ("per.", "%)-")])


def two_step_parts(policy: Column) -> tuple[Column, Column, Column]:
    """First rate, switch percent and second rate of ``8C(35%)-3.6C``; null where the form differs."""
    return tuple(F.regexp_extract(policy, pattern, 1).try_cast("double") for pattern in (r"^([0-9.]+)C", r"\(([0-9.]+)%\)", r"-([0-9.]+)C"))


def step_part(policy: Column, k: int) -> Column:
    """The k-th rate (from 1) of ``C1-C2-C3-C4``."""
    return F.split_part(policy, F.lit("-"), F.lit(k)).try_cast("double")


def barcode_number(barcode: Column) -> Column:
    """The number after a two-character prefix; 0 if there is none."""
    return F.coalesce(F.substring(barcode, 3, 100).try_cast("long"), F.lit(0))


def machine_file(*rates: Column) -> Column:
    """File name of a protocol: rates with ``pt`` for the point, a zero decimal left out."""
    name = F.concat(F.concat_ws("_", *(r.cast("string") for r in rates)), F.lit(".sdu"))
    stem = F.replace(F.regexp_replace(name, r"\.sdu$", ""), F.lit("."), F.lit("pt"))
    return _replaced(F.concat(stem, F.lit(".sdu")), [("pt0_", "_"), ("pt0.", ".")])


def two_step_file(first: Column, percent: Column, second: Column) -> Column:
    stem = F.concat(first.cast("string"), F.lit("C_"), percent.cast("string"), F.lit("per_"), second.cast("string"), F.lit("C"))
    return F.replace(stem, F.lit("."), F.lit("_"))


def three_step_file(first: Column, switch: Column, second: Column, switch_again: Column, third: Column) -> Column:
    """Name of a three-step protocol: rates with C and switch percents with per, underscores for points."""
    parts = [F.concat(c.cast("string"), F.lit(mark)) for c, mark in ((first, "C"), (switch, "per"), (second, "C"), (switch_again, "per"), (third, "C"))]
    return F.replace(F.concat_ws("_", *parts), F.lit("."), F.lit("_"))


def life_label(rates: list[Column], life: Column) -> Column:
    """``4.8C-5.2C-5.2C-4.160C: 1185``."""
    return F.format_string("%sC-%sC-%sC-%.3fC: %.0f", *rates, life)


def has_two_percents(policy: Column) -> Column:
    """Policies that carry two percent signs are experimental and get no metrics."""
    return F.regexp_count(policy, F.lit("%")) == 2


def numbers(text: Column) -> Column:
    """The numbers of a blank-separated string; what isn't one is null."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))


def date_of_name(name: Column) -> Column:
    """Date at the head of a batch name; null if it has none."""
    return F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd")
