"""Safe ratios, percentages, value bands and raw-measurement parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges and labels of the published profiles.
DISTANCE_EDGES = (2, 5, 10, 20)
DISTANCE_EDGES_SHORT = (2, 5, 10)
PRECIP_EDGES = {"coarse": (0, 2, 5, 10), "fine": (0, 1, 3, 10)}
PRECIP_LABELS = {
    "coarse": ("0", "0-2", "2-5", "5-10", "10+"),
    "fine": ("0", "0-1", "1-3", "3-10", ">10"),
}
WIND_EDGES = (5, 10, 20)
WIND_LABELS = ("0-5", "5-10", "10-20", ">20")


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, and 0.0 where the denominator is not positive (or null)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def safe_pct(num: Column, den: Column, digits: int = 1) -> Column:
    """Rounded percentage, null where the denominator is not positive."""
    return F.round(100 * F.when(den > 0, num / den), digits)


def banded(value: Column, edges: Sequence[float], labels: Sequence[str], null_label: str | None = None) -> Column:
    """Label of the first band with ``value <= edge``; the last label is open-ended.

    A null value gets ``null_label`` (null by default) rather than the open band.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one more label than edges")
    chain = F.when(value.isNull(), F.lit(null_label).cast("string"))
    for edge, label in zip(edges, labels):
        chain = chain.when(value <= edge, F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def distance_labels(edges: Sequence[float], suffix: str = "") -> tuple[str, ...]:
    starts = (0, *edges[:-1])
    return (*(f"{a}-{b}{suffix}" for a, b in zip(starts, edges)), f"{edges[-1]}+{suffix}")


def distance_band(
    miles: Column, edges: Sequence[float] = DISTANCE_EDGES, suffix: str = "", null_label: str | None = None
) -> Column:
    """Distance band such as ``0-2`` .. ``20+`` (with ``suffix='mi'``: ``0-2mi`` .. ``20+mi``)."""
    return banded(miles, edges, distance_labels(edges, suffix), null_label)


def temp_bin(temp: Column, width: float = 5, mode: str = "floor") -> Column:
    """Lower edge (``floor``, int) or nearest multiple (``nearest``, double) of ``width`` degrees."""
    if mode == "floor":
        return (F.floor(temp / width) * width).cast("int")
    if mode == "nearest":
        return F.round(temp / width) * width
    raise ValueError(f"unknown mode {mode!r}")


def precip_bin(mm: Column, variant: str = "coarse", null_label: str | None = None) -> Column:
    return banded(mm, PRECIP_EDGES[variant], PRECIP_LABELS[variant], null_label)


def wind_bin(kmh: Column, null_label: str | None = None) -> Column:
    return banded(kmh, WIND_EDGES, WIND_LABELS, null_label)


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin over ``[lo, hi]``, both ends closed; null outside or when the range is empty."""
    position = F.floor((value - lo) / (hi - lo) * bins)
    return F.when((hi > lo) & value.between(lo, hi), F.least(position, F.lit(bins - 1)).cast("int")).when(
        (hi == lo) & (value == lo), F.lit(0)
    )


def measure(raw: Column, trace: float | None = None) -> Column:
    """Station measurement text to double: blank or junk is null, ``T`` (trace) is ``trace``."""
    text = F.trim(raw.cast("string"))
    return F.when(text == "T", F.lit(trace).cast("double")).otherwise(text.try_cast("double"))


def is_present(raw: Column) -> Column:
    """True where a raw measurement text is neither null, blank nor a trace mark."""
    text = F.trim(raw.cast("string"))
    return F.coalesce((text != "") & (text != "T"), F.lit(False))


def yn(value: Column) -> Column:
    """Y/N text (any case) to boolean, null otherwise."""
    return F.when(F.upper(value) == "Y", F.lit(True)).when(F.upper(value) == "N", F.lit(False))


def flag(condition: Column) -> Column:
    """1/0 integer; null counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
