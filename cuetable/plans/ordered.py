"""Ordered computations inside a key that may be far too big for one task.

A plain ``Window.partitionBy(video_id)`` sends a whole video to one task. Here each
key is cut into consecutive chunks by a monotone function of the sort order; the
window runs per ``(key, chunk)``, and one row per chunk (its first and last values,
its row count, its sums) carries the state across the cut. That edge table is
smaller than the input by the chunk size, so the only per-key window left runs on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetable.plans.folders import cut_lineage
from cuetable.plans.sizes import broadcast_if_small

CHUNK_ROWS = 50_000
CHUNK = "_chunk"


class ByPosition(NamedTuple):
    """Chunks by a dense position."""

    chunk: Column

    def over(self, df: DataFrame) -> Column | None:
        """The chunk number; None where all rows have the same, so that keys are known to be small and need no edges."""
        low, high = df.select(F.min(self.chunk), F.max(self.chunk)).first()
        return None if low == high else self.chunk


def by_position(col: str | Column, rows: int = CHUNK_ROWS) -> ByPosition:
    """Chunk number for an order that starts with a dense position column."""
    col = F.col(col) if isinstance(col, str) else col
    return ByPosition(F.floor(col / F.lit(rows)).cast("bigint"))


def by_time(col: str | Column, span_ms: int = 3_600_000) -> Column:
    """Chunk number for an order that starts with a time in milliseconds."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(span_ms)).cast("bigint")


class EvenTime(NamedTuple):
    """Chunks by a time in milliseconds that are bound in rows, too: a span with more than ``rows`` of a key is cut at quantiles of its times."""

    col: str
    span_ms: int = 3_600_000
    rows: int = CHUNK_ROWS

    def over(self, df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, Column]:
        """``df`` with what the chunk number needs, and that number.

        Rows are counted by key and span first. Only spans beyond ``rows`` have their quantiles sketched, so the table of cuts is smaller than the input
        by ``rows`` over the number of cuts. Rows of one and the same time are not parted.
        """
        span = by_time(self.col, self.span_ms)
        counts = df.groupBy(*by, span.alias("_span")).agg(F.count(F.lit(1)).alias("_held"))
        crowded = cut_lineage(counts.filter(F.col("_held") > self.rows), "crowded")
        if crowded.isEmpty():
            return df, span
        placed = df.withColumn("_span", span)
        within = placed.join(broadcast_if_small(crowded.drop("_held")), [*by, "_span"], "left_semi")
        steps = [(i + 1) / CUTS for i in range(CUTS - 1)]
        cuts = within.groupBy(*by, "_span").agg(F.array_distinct(F.percentile_approx(self.col, steps, 20 * CUTS)).alias("_cuts"))
        placed = placed.join(broadcast_if_small(cut_lineage(cuts, "cuts"), 10_000), [*by, "_span"], "left")
        past = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(self.col))), F.lit(0))
        return placed, F.col("_span") * CUTS + F.when(F.col("_cuts").isNull(), 0).otherwise(past)


#: Parts of a crowded span.
CUTS = 256


def ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column | ByPosition | EvenTime | None,
    *,
    number: str | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    last_seen: Mapping[str, Column] | None = None,
    seen_before: Mapping[str, Column] | None = None,
    next_seen: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    is_last: str | None = None,
) -> DataFrame:
    """Add ordered columns to every row of ``df``.

    ``number``    0-based dense position inside the key
    ``lag``       value of the previous row, null on the first
    ``lead``      value of the next row, null on the last
    ``before``    sum over all earlier rows (this row excluded), 0 on the first
    ``last_seen`` latest non-null value over earlier rows and this one
    ``seen_before`` latest non-null value over earlier rows only
    ``next_seen`` earliest non-null value over later rows and this one
    ``total``     sum over the whole key
    ``is_last``   whether this is the key's last row

    ``order`` must be a total order inside the key and ascending; ``chunk`` must never
    decrease along it. ``chunk=None`` means the key is known to be small.

    ``df`` is read twice, for the rows and for the edges, or for the range of its chunks: where positions lie in one chunk, keys are small and
    rows are dealt once, by key. Operators that stack several
    passes write the table in between (``cut_lineage``), so reads do not multiply.
    """
    lag, lead, before = dict(lag or {}), dict(lead or {}), dict(before or {})
    last_seen, seen_before = dict(last_seen or {}), dict(seen_before or {})
    next_seen, total = dict(next_seen or {}), dict(total or {})
    by = list(by)
    inputs = {}
    for group in (lag, lead, before, last_seen, seen_before, next_seen, total):
        for name, expr in group.items():
            inputs[f"_in_{name}"] = expr
    kept = df.columns
    if isinstance(chunk, EvenTime):
        df, chunk = chunk.over(df, by)
    elif isinstance(chunk, ByPosition):
        chunk = chunk.over(df)
    src = df.select("*", *[expr.alias(name) for name, expr in inputs.items()],
                    (F.lit(0).cast("bigint") if chunk is None else chunk).alias(CHUNK))

    keys = by if chunk is None else [*by, CHUNK]
    w = Window.partitionBy(*keys).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)

    local = [F.row_number().over(w).cast("bigint").alias("_n")]
    if lead or is_last:
        local.append(F.lead(F.lit(True)).over(w).isNull().alias("_end"))
    local += [F.lag(f"_in_{n}").over(w).alias(f"_lag_{n}") for n in lag]
    local += [F.lead(f"_in_{n}").over(w).alias(f"_lead_{n}") for n in lead]
    local += [F.coalesce(F.sum(f"_in_{n}").over(past), F.lit(0)).alias(f"_before_{n}") for n in before]
    local += [F.last(f"_in_{n}", True).over(upto).alias(f"_seen_{n}") for n in last_seen]
    local += [F.last(f"_in_{n}", True).over(past).alias(f"_seen_{n}") for n in seen_before]
    local += [F.first(f"_in_{n}", True).over(onward).alias(f"_next_{n}") for n in next_seen]
    if chunk is None:
        local += [F.sum(f"_in_{n}").over(whole).alias(f"_total_{n}") for n in total]
    rows = src.select("*", *local)

    if chunk is None:
        out = [F.col(c) for c in kept]
        if number:
            out.append((F.col("_n") - 1).alias(number))
        out += [F.col(f"_lag_{n}").alias(n) for n in lag]
        out += [F.col(f"_lead_{n}").alias(n) for n in lead]
        out += [F.col(f"_before_{n}").alias(n) for n in before]
        out += [F.col(f"_seen_{n}").alias(n) for n in {**last_seen, **seen_before}]
        out += [F.col(f"_next_{n}").alias(n) for n in next_seen]
        out += [F.col(f"_total_{n}").alias(n) for n in total]
        if is_last:
            out.append(F.col("_end").alias(is_last))
        return rows.select(*out)

    edges = _edges(src, by, order, number, lag, lead, before, {**last_seen, **seen_before}, next_seen, total, is_last)
    joined = rows.join(edges, [*by, CHUNK], "left")
    first = F.col("_n") == 1
    out = [F.col(c) for c in kept]
    if number:
        out.append((F.col("_n") - 1 + F.col("_e_count")).alias(number))
    out += [F.when(first, F.col(f"_e_lag.{n}")).otherwise(F.col(f"_lag_{n}")).alias(n) for n in lag]
    out += [F.when(F.col("_end"), F.col(f"_e_lead.{n}")).otherwise(F.col(f"_lead_{n}")).alias(n) for n in lead]
    out += [(F.col(f"_before_{n}") + F.col(f"_e_before_{n}")).alias(n) for n in before]
    out += [F.coalesce(f"_seen_{n}", f"_e_seen_{n}").alias(n) for n in {**last_seen, **seen_before}]
    out += [F.coalesce(f"_next_{n}", f"_e_next_{n}").alias(n) for n in next_seen]
    out += [F.col(f"_e_total_{n}").alias(n) for n in total]
    if is_last:
        out.append((F.col("_end") & F.col("_e_final")).alias(is_last))
    return joined.select(*out)


def _edges(src, by, order, number, lag, lead, before, last_seen, next_seen, total, is_last):
    """One row per (key, chunk) holding what its neighbours need to know."""
    position = F.struct(*order)
    aggs = []
    if number:
        aggs.append(F.count(F.lit(1)).alias("_count"))
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(f"_in_{n}").alias(n) for n in lag]), position).alias("_last"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(f"_in_{n}").alias(n) for n in lead]), position).alias("_first"))
    aggs += [F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in {**before, **total}]
    for n in last_seen:
        seen = F.col(f"_in_{n}").isNotNull()
        aggs.append(F.max_by(F.when(seen, F.col(f"_in_{n}")), F.when(seen, position)).alias(f"_last_{n}"))
    for n in next_seen:
        seen = F.col(f"_in_{n}").isNotNull()
        aggs.append(F.min_by(F.when(seen, F.col(f"_in_{n}")), F.when(seen, position)).alias(f"_first_{n}"))
    if not aggs:
        aggs.append(F.count(F.lit(1)).alias("_count"))
    edge = src.groupBy(*by, CHUNK).agg(*aggs)

    we = Window.partitionBy(*by).orderBy(CHUNK)
    earlier = we.rowsBetween(Window.unboundedPreceding, -1)
    later = we.rowsBetween(1, Window.unboundedFollowing)
    key = Window.partitionBy(*by)
    cols = []
    if number:
        cols.append(F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_e_count"))
    if lag:
        cols.append(F.lag("_last").over(we).alias("_e_lag"))
    if lead:
        cols.append(F.lead("_first").over(we).alias("_e_lead"))
    cols += [F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_e_before_{n}") for n in before]
    cols += [F.last(f"_last_{n}", True).over(earlier).alias(f"_e_seen_{n}") for n in last_seen]
    cols += [F.first(f"_first_{n}", True).over(later).alias(f"_e_next_{n}") for n in next_seen]
    cols += [F.sum(f"_sum_{n}").over(key).alias(f"_e_total_{n}") for n in total]
    if is_last:
        cols.append(F.lead(F.lit(True)).over(we).isNull().alias("_e_final"))
    return edge.select(*by, CHUNK, *cols)
