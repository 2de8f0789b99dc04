"""Time expressions on BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient, rounded down."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def round_div(a: Column, b: Column | int) -> Column:
    """``a / b`` to the nearest integer for non-negative values, halves up."""
    b = F.lit(b) if isinstance(b, int) else b
    return div(a * 2 + b, b * 2)


def marker_target(duration_ms: Column) -> Column:
    """Number of effects for a video: tiers up to two minutes, then seven a minute."""
    d = duration_ms
    valid = d.isNotNull() & ~F.isnan(d.cast("double")) & (d.cast("double") < float("inf")) & (d > 0)
    per_minute = F.ceil(d.cast("double") * 7 / 60000)
    return F.coalesce(
        F.when(~valid, 0)
        .when(d < 60000, F.greatest(F.lit(1), F.ceil(d.cast("double") / 6000)))
        .when(d <= 75000, 10).when(d <= 100000, 12).when(d <= 120000, 14)
        .otherwise(per_minute), F.lit(0)).cast("bigint")


def tempo_chain(src_ms: Column, dst_ms: Column) -> Column:
    """Factors in [0.5, 2] whose product stretches one length into the other."""
    rate = F.greatest(F.lit(0.01), src_ms / F.greatest(F.lit(80), dst_ms))
    halves = F.greatest(F.lit(0), F.ceil(-F.log2(rate)) - 1).cast("int")
    doubles = F.greatest(F.lit(0), F.ceil(F.log2(rate)) - 1).cast("int")
    rest = rate * F.pow(F.lit(2.0), halves) / F.pow(F.lit(2.0), doubles)
    return F.concat(F.array_repeat(F.lit(0.5), halves), F.array_repeat(F.lit(2.0), doubles), F.array(F.bround(rest, 6)))


def snap_to_frame(ms: Column, fps_num: Column, fps_den: Column) -> Column:
    """Nearest frame time; 25 frames a second where the rate is missing or zero."""
    num = F.coalesce(F.nullif(fps_num, F.lit(0)), F.lit(25)).cast("bigint")
    den = F.when(F.coalesce(fps_num, F.lit(0)) == 0, F.lit(1)).otherwise(F.coalesce(F.nullif(fps_den, F.lit(0)), F.lit(1)))
    den = den.cast("bigint")
    frame = round_div(ms * num, den * 1000)
    return round_div(frame * den * 1000, num)


def position_px(percent: Column, extent: Column) -> Column:
    """Percent clamped to 0-100, as a pixel; halves round to even."""
    return F.bround(extent * F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent)) / 100, 0).cast("bigint")


def default_y_percent(margin: Column, height: Column) -> Column:
    return F.lit(100.0) - margin * 100.0 / F.greatest(height, F.lit(1))


def remap(t: Column, start: Column, end: Column) -> Column:
    """A time after the range [start, end) is taken out of the timeline."""
    return F.when(t <= start, t).when(t >= end, t - (end - start)).otherwise(start)


def sample_times(media: DataFrame, interval_ms: int = 2000) -> DataFrame:
    """Sampling grid of every video: half a second, then every interval, before the end.

    Times are kept to a hundredth of a second.
    """
    grid = F.sequence(F.lit(500), F.col("duration_ms") - 1, F.lit(interval_ms).cast("bigint"))
    return (media.filter(F.col("duration_ms") > 500)
            .select("video_id", F.explode(grid).alias("at_ms"))
            .select("video_id", (F.bround(F.col("at_ms") / 10, 0) * 10).cast("bigint").alias("time_ms")))
