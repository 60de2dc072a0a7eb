"""Parts of a '/'-separated path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_FOLDER = "(Root Folder)"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    """Everything before the last '/', or the root label for a top-level file."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.lit(ROOT_FOLDER)).otherwise(parent)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))
