"""Interval joins as equi-joins on fixed time bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = "_bin"


def covered_bins(start, end, bin_ms: int):
    """Bins touched by the half-open interval [start, end); empty intervals touch none."""
    return F.when(end > start, F.sequence(F.floor(start / bin_ms), F.floor((end - 1) / bin_ms)))


def overlap_join(
    left: DataFrame, right: DataFrame, by: Sequence[str],
    left_span: tuple[str, str], right_span: tuple[str, str], bin_ms: int,
) -> DataFrame:
    """Pairs with ``left.end > right.start AND left.start < right.end``.

    Both sides are cut at the same bin borders, so one very long video is spread over
    its bins. A pair sharing several bins is kept only in the first one they share.
    Column names of the two sides must differ apart from ``by``.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = left.withColumn(BIN, F.explode(covered_bins(F.col(ls), F.col(le), bin_ms)))
    b = right.withColumn(BIN, F.explode(covered_bins(F.col(rs), F.col(re_), bin_ms)))
    first_shared = F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_ms)
    return (a.join(b, [*by, BIN])
            .filter((F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re_)) & (F.col(BIN) == first_shared))
            .drop(BIN))


def point_join(
    points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, span: tuple[str, str], bin_ms: int,
) -> DataFrame:
    """Every point with the span that holds it (``start <= at < end``); inner join."""
    s, e = span
    a = points.withColumn(BIN, F.floor(F.col(at) / bin_ms))
    b = spans.withColumn(BIN, F.explode(covered_bins(F.col(s), F.col(e), bin_ms)))
    return a.join(b, [*by, BIN]).filter((F.col(s) <= F.col(at)) & (F.col(at) < F.col(e))).drop(BIN)
