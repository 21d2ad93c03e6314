"""Exact order statistics by bracketing: no table of values is sorted or sent.

A mergeable sketch names two values around each wanted rank. One pass then counts what lies below, between and above them, and
only the values between are kept apart, each distinct one with its count. A bracket that still holds too much is narrowed by a
sketch of its inside; one that missed its rank is replaced by the part that the counts point to. Sketches decide the effort only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SKETCH_K = 2000
MARGIN = 0.005  # twice the rank error of such a sketch
LIMIT = 1_000_000  # values that may come to the driver, all brackets together
MERGE_GROUPS = 64


@dataclass(frozen=True)
class Span:
    """An open interval of a column's values that holds some wanted ranks: ``below`` values lie at or under ``low``, ``inside`` in it."""

    col: str
    low: float | None  # None: without a bound; infinities are values like others
    high: float | None
    below: int
    inside: int

    def holds(self, x: Column) -> Column:
        return (F.lit(True) if self.low is None else x > self.low) & (F.lit(True) if self.high is None else x < self.high)


def _number(col: str) -> Column:
    """The column as a double; NaN counts as missing here, it comes after all numbers."""
    x = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(x), x)


def _sketched(df: DataFrame, spans: list[Span], extra: list[Column] = ()) -> tuple[DataFrame, list]:
    """One row with a mergeable sketch of each span's values, back on the driver, and the sums of ``extra``; one scan.

    Sketches are merged in two steps, so that no task takes those of all others.
    """
    names = sorted({s.col for s in spans})
    parts = df.select((F.spark_partition_id() % MERGE_GROUPS).alias("__g"), *[_number(c).alias(f"__{i}") for i, c in enumerate(names)],
                      *[x.alias(f"__x{i}") for i, x in enumerate(extra)])
    here = [F.col(f"__{names.index(s.col)}") for s in spans]
    own = [F.kll_sketch_agg_double(F.when(s.holds(x), x), F.lit(SKETCH_K)).alias(f"s{i}") for i, (s, x) in enumerate(zip(spans, here, strict=True))]
    sums = [F.sum(f"__x{i}").alias(f"x{i}") for i in range(len(extra))]
    merged = parts.groupBy("__g").agg(*own, *sums).agg(*[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(len(spans))],
                                                       *[F.sum(f"x{i}") for i in range(len(extra))]).first()
    held = df.sparkSession.createDataFrame([tuple(merged)[:len(spans)]], ", ".join(f"s{i} binary" for i in range(len(spans))))
    return held, list(merged)[len(spans):]


def _brackets(sketches: DataFrame, wanted: dict[Span, set[int]]) -> dict[Span, list[tuple[float, float]]]:
    """Disjoint closed brackets in each span, around its ranks as the sketch sees them."""
    def near(s: Span, r: int) -> tuple[float, float]:
        share = (r - s.below + 0.5) / s.inside
        return max(share - MARGIN, 0.0), min(share + MARGIN, 1.0)

    shares = [sorted({x for r in ranks for x in near(s, r)}) for s, ranks in wanted.items()]
    row = sketches.select(*[F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, p))).alias(f"q{i}") for i, p in enumerate(shares)]).first()
    out = {}
    for i, (s, ranks) in enumerate(wanted.items()):
        value = dict(zip(shares[i], row[i], strict=True))
        joined: list[list[float]] = []
        for a, b in sorted(tuple(value[x] for x in near(s, r)) for r in ranks):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        out[s] = [tuple(x) for x in joined]
    return out


def _zones(df: DataFrame, brackets: dict[Span, list[tuple[float, float]]], keep: bool) -> dict[int, list[tuple[int, float | None, int]]]:
    """For each span its (zone, value, count) in order: zone 4i lies before bracket i, 4i + 1 and 4i + 3 are its ends, 4i + 2 its inside,
    whose values are listed where ``keep`` is set. A batch sends one row for each of these."""
    places = {c: i for i, c in enumerate(sorted({s.col for s in brackets}))}
    spans = [(places[s.col], s.low, s.high, np.array(pairs).ravel()) for s, pairs in brackets.items()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.drop_null().to_numpy(zero_copy_only=False) for c in batch.columns]
            for i, (place, low, high, ends) in enumerate(spans):
                x = columns[place]
                x = x[(x > low if low is not None else True) & (x < high if high is not None else ~np.isnan(x))]
                first, after = np.searchsorted(ends, x, side="left"), np.searchsorted(ends, x, side="right")
                zone = 4 * (first // 2) + np.where(first == after, 2 * (first % 2), 1 + 2 * (first % 2))
                inside = zone % 4 == 2
                listed, n = np.unique(x[inside] if keep else x[:0], return_counts=True)
                place_of = 4 * (np.searchsorted(ends, listed) // 2) + 2
                zones, totals = np.unique(zone[~inside] if keep else zone, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(zones) + len(listed), i, dtype=np.int32)), pa.array(np.concatenate([zones, place_of]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(zones)), listed + 0.0]), mask=np.arange(len(zones) + len(listed)) < len(zones)),
                    pa.array(np.concatenate([totals, n]))], names=["span", "zone", "value", "n"])

    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for c, i in places.items()]).mapInArrow(count, "span int, zone int, value double, n long")
    rows = parts.groupBy("span", "zone", "value").agg(F.sum("n").alias("n")).toArrow()  # counts, and at most LIMIT values
    out: dict[int, list] = {i: [] for i in range(len(brackets))}
    for i, zone, value, n in zip(*(rows[c].to_pylist() for c in ("span", "zone", "value", "n")), strict=True):
        out[i].append((zone, value, n))
    return {i: sorted(r, key=lambda t: (t[0], -math.inf if t[1] is None else t[1])) for i, r in out.items()}


def _settle(s: Span, pairs: list[tuple[float, float]], counted: list, ranks: set[int], found: dict, todo: dict[Span, set[int]]) -> None:
    """Ranks whose value the counts show go to ``found``, the others to the narrower span that holds them."""
    bounds = [s.low, *[x for pair in pairs for x in pair], s.high]
    for r in ranks:
        before = s.below
        for zone, value, n in counted:
            if r < before + n:
                j, kind = divmod(zone, 4)
                if kind in (1, 3):
                    found[s.col, r] = pairs[j][kind // 2]
                elif value is not None:
                    found[s.col, r] = value
                else:
                    at = 2 * j + (kind == 2)
                    todo.setdefault(Span(s.col, bounds[at], bounds[at + 1], before, n), set()).add(r)
                break
            before += n


def order_statistics(df: DataFrame, spans: dict[Span, set[int]], sketches: DataFrame) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks among the numbers of each column; ``sketches`` has one of each span, in their order."""
    found: dict[tuple[str, int], float] = {}
    while spans:
        brackets = _brackets(sketches, spans)
        inside = sum(s.inside * min(1.0, 2 * MARGIN * len(ranks)) for s, ranks in spans.items())
        counted = _zones(df, brackets, keep=inside <= LIMIT)
        rest: dict[Span, set[int]] = {}
        for i, s in enumerate(brackets):
            _settle(s, brackets[s], counted[i], spans[s], found, rest)
        spans = rest
        if spans:
            sketches, _ = _sketched(df, list(spans))
    return found


def quantile_values(df: DataFrame, cols: list[str], probs: list[float]) -> dict[tuple[str, float], float | None]:
    """Exact, linearly interpolated quantiles; nulls are left out, NaN comes after all numbers, a column without values has None.

    Two scans, where the brackets hold: one for the sketches, one for the counts.
    """
    nan = [F.when(F.isnan(F.col(f"`{c}`").cast("double")), 1).otherwise(0) for c in cols]
    sketches, counts = _sketched(df, [Span(c, None, None, 0, 0) for c in cols], nan)
    numbers = sketches.select(*[F.kll_sketch_get_n_double(f"s{i}") for i in range(len(cols))]).first()
    sizes = {c: n or 0 for c, n in zip(cols, numbers, strict=True)}
    total = {c: sizes[c] + (extra or 0) for c, extra in zip(cols, counts, strict=True)}
    ends = {(c, p): (math.floor((total[c] - 1) * p), math.ceil((total[c] - 1) * p)) for c in cols for p in probs if total[c]}
    wanted = {Span(c, None, None, 0, sizes[c]): {r for p in probs for r in ends.get((c, p), ()) if r < sizes[c]} for c in cols}
    asked = [i for i, ranks in enumerate(wanted.values()) if ranks]
    sketches = sketches.select(*[F.col(f"s{i}").alias(f"s{at}") for at, i in enumerate(asked)])
    held = order_statistics(df, {s: r for s, r in wanted.items() if r}, sketches)
    out: dict[tuple[str, float], float | None] = {}
    for c in cols:
        for p in probs:
            if not total[c]:
                out[c, p] = None
                continue
            low, high = (held.get((c, r), math.nan) for r in ends[c, p])
            out[c, p] = low if ends[c, p][0] == ends[c, p][1] else low + (high - low) * ((total[c] - 1) * p - ends[c, p][0])
    return out
