"""Paths, track names and numbers in text, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def stem(path: Column) -> Column:
    return without_extension(F.element_at(F.split(path, "/"), -1))


def has_extension(path: Column, extension: str) -> Column:
    return F.lower(path).endswith("." + extension.lower())


def has_component(path: Column, name: str) -> Column:
    return F.array_contains(F.split(path, "/"), name)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def mirrored(path: Column, root: str, out_root: str, extension: str) -> Column:
    """The path under another root with another extension."""
    return F.concat(F.lit(out_root), without_extension(F.substr(path, F.lit(len(root) + 1))), F.lit("." + extension))


def track_key(path: Column) -> tuple[Column, Column, Column]:
    """Disc, number and title of ``D-NN Title`` or ``NN Title``; 9999 where there is no number."""
    name = stem(path)
    disc = F.regexp_extract(name, r"^(\d+)-(\d+)", 1)
    number = F.when(disc != "", F.regexp_extract(name, r"^(\d+)-(\d+)", 2)).otherwise(F.regexp_extract(name, r"^(\d+)", 1))
    as_int = lambda c, default: F.when(c == "", F.lit(default)).otherwise(c.try_cast("int"))
    return F.when(number == "", F.lit(9999)).otherwise(as_int(disc, 0)), F.when(number == "", F.lit(9999)).otherwise(as_int(number, 9999)), F.lower(name)


def last_number(text: Column, label: str) -> Column:
    """The number after the last ``label:`` in a report, as a double; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(label + r":\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), F.lit(-1)).cast("double")
