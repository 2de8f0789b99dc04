"""Names and keys derived from paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuetable import fixed


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]+)[/\\\\]*$", 1)


def raw_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), "^(.+)\\.[^.]+$", "$1")


def safe_stem(path: Column) -> Column:
    """File name fit for other files: bad characters replaced, ends trimmed, 100 long at most."""
    stem = F.btrim(F.regexp_replace(raw_stem(path), '[<>:"/\\\\|?*]+', "_"), F.lit(" ._"))
    stem = F.substring(stem, 1, 100)
    return F.when(stem == "", F.lit("video")).otherwise(stem)


def video_key(path: Column) -> Column:
    """Stable id of a video: its stem and ten digits of the hash of its path."""
    return F.concat(safe_stem(path), F.lit("_"), F.substring(F.sha1(F.lower(path)), 1, 10))


def product_from_name(path: Column) -> Column:
    """Product spoken of in a video, read off the file name."""
    name = raw_stem(path)
    for pattern in fixed.NAME_PATTERNS:
        name = F.regexp_replace(name, pattern, "")
    for suffix in fixed.NAME_SUFFIXES:
        name = F.regexp_replace(name, re.escape(suffix), "")
    return F.btrim(name, F.lit(fixed.NAME_EDGES))


def same_path(a: Column, b: Column) -> Column:
    """Paths equal but for slash direction and case."""
    def plain(p: Column) -> Column:
        return F.lower(F.translate(F.coalesce(p, F.lit("")), "\\", "/"))
    return plain(a) == plain(b)
