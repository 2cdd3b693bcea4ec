"""Scalar functions of minutes, walks and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_since(ts: Column, start_seconds: int) -> Column:
    """Whole minutes since a moment, rounded down before it too."""
    return F.floor((F.unix_timestamp(ts) - start_seconds) / 60).cast("int")


def walk_minutes(seconds: Column) -> Column:
    """Minutes of a walk, rounded up, one at least; no walk stays none."""
    return F.when(seconds > 0, F.greatest(F.lit(1), F.ceil(seconds / 60).cast("int"))).otherwise(0)


def clip_minutes(minute: Column) -> Column:
    """Minutes held within 16 bits."""
    return F.least(F.greatest(minute, F.lit(-32768)), F.lit(32767))


def residual_class(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size <= 2, "<=2").when(size <= 5, "<=5").when(size <= 15, "<=15").otherwise(">15")


def attribution(agrees: Column, dropped: Column, diff: Column) -> Column:
    """Why two answers differ, in a fixed order of causes."""
    return F.when(agrees, "AGREE").when(F.abs(diff) <= 2, "NEAR").when(dropped, "S3").when(F.abs(diff) > 60, "S1").when(diff > 0, "S5a").otherwise("S5b")


def overtaking_class(a_dep: Column, b_dep: Column, a_arr: Column, b_arr: Column) -> Column:
    """The kind of an inversion at a position: trip a starts before trip b and arrives after it."""
    missing = a_dep.isNull() | b_dep.isNull() | a_arr.isNull() | b_arr.isNull()
    return F.when(missing, "nat").when(F.abs(a_dep - b_dep) > 720, "wraparound").when((a_dep <= b_dep) & (a_arr > b_arr), "overtaking").otherwise("data_error")


def overnight_wrap(dep: Column, arr: Column) -> Column:
    """Whether an arrival before its departure is one after midnight."""
    return (arr < dep) & (arr + 1440 >= dep)


def node_id(stop: Column, minute: Column, plane: Column, n_stops: int, t_lo: int, t_hi: int) -> Column:
    """Number of a grid node: plane, stop and minute."""
    width = t_hi - t_lo + 1
    return plane * (n_stops * width) + stop * width + (minute - t_lo)


def node_parts(node: Column, n_stops: int, t_lo: int, t_hi: int) -> tuple[Column, Column, Column]:
    """Stop, minute and plane of a grid node's number."""
    width = t_hi - t_lo + 1
    return F.floor(node % (n_stops * width) / width).cast("int"), (node % width + t_lo).cast("int"), F.floor(node / (n_stops * width)).cast("int")


def hour_weights() -> list[float]:
    """The share of each hour of a day in its edits: night is quiet, rush hours are busy."""
    weight = [0.3 if h < 5 else 3.0 if h in (7, 8, 9) else 3.5 if h in (17, 18, 19) else 1.0 for h in range(24)]
    return [w / sum(weight) for w in weight]


def stable_hash(*columns: Column | str) -> Column:
    """SHA-256 of values joined by bars; a null stands as an empty text with a mark."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def float_or_null(text: Column) -> Column:
    """A number read from text; anything else, and what is no number, is null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)
