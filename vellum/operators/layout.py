"""Geometry of page layouts in tables: boxes, pitch, continuation, reading order.

A baseline is an array of points, each an array [x, y].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.arrays import let


def _axis(points: Column, k: int) -> Column:
    return F.transform(points, lambda p: F.get(p, F.lit(k)).cast("double"))


def bbox(points: Column) -> Column:
    """struct(x0, y0, x1, y1) of a polygon; null where it has no points."""
    x, y = _axis(points, 0), _axis(points, 1)
    return F.when(F.size(points) > 0, F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")))


def integer_points(points: Column) -> Column:
    """Points rounded to whole pixels."""
    return F.transform(points, lambda p: F.transform(p, lambda v: F.bround(v.cast("double")).cast("int")))


def pitch(lines: DataFrame) -> DataFrame:
    """Distance between text lines of each page (page_id, baseline, height).

    Midpoints no further apart than half the median height are one line; the median gap
    of lines is the pitch, or else the span by the number of gaps. Pages of fewer than
    four baselines have none.
    """
    ends = F.get("baseline", F.lit(0)), F.element_at("baseline", -1)
    rows = lines.where(F.size("baseline") >= 2).select("page_id", ((F.get(ends[0], F.lit(1)) + F.get(ends[1], F.lit(1))) / 2).cast("double").alias("mid"), F.when(F.col("height") > 0, F.col("height").cast("double")).alias("height"))
    stats = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("mid").alias("low"), F.max("mid").alias("high"), F.expr("percentile(height, 0.5)").alias("h"), F.sort_array(F.collect_list("mid")).alias("mids"))
    at = lambda k: F.get("mids", k)
    close = lambda k: (k > 0) & F.coalesce(at(k) - at(k - 1) <= 0.5 * F.col("h"), F.lit(False))
    places = F.slice(F.sequence(F.lit(0), F.size("mids")), F.lit(1), F.size("mids"))
    starts = F.when(F.col("h").isNotNull(), F.filter(places, lambda k: ~close(k)))

    def centre(first: Column, k: Column, begins: Column) -> Column:
        part = F.slice("mids", first + 1, F.coalesce(F.get(begins, k + 1), F.size("mids")) - first)
        return F.aggregate(part, F.lit(0.0), lambda total, x: total + x) / F.size(part)

    centres = let(starts, lambda begins: F.transform(begins, lambda first, k: centre(first, k, begins)))
    gaps = let(F.sort_array(centres), lambda c: F.sort_array(F.zip_with(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: x - y)))
    middle = let(gaps, lambda g: (F.get(g, F.floor((F.size(g) - 1) / 2).cast("int")) + F.get(g, F.ceil((F.size(g) - 1) / 2).cast("int"))) / 2)
    spread = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / (F.col("n") - 1))
    return stats.withColumn("g", middle).select("page_id", F.when(F.col("n") >= 4, F.coalesce(F.when(F.col("g") > 0, F.col("g")), spread)).alias("pitch"))


def overlap_share(a: Column, b: Column) -> Column:
    """Horizontal overlap of two baselines by the shorter one."""
    x, y = _axis(a, 0), _axis(b, 0)
    shorter = F.least(F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))
    common = F.greatest(F.lit(0.0), F.least(F.array_max(x), F.array_max(y)) - F.greatest(F.array_min(x), F.array_min(y)))
    return F.when(shorter > 0, common / shorter).otherwise(0.0)


def stacked(a: Column, b: Column, pitch_col: Column, most: float = 0.5) -> Column:
    """Whether two baselines stand above each other; a mark narrower than the pitch does not count."""
    x, y = _axis(a, 0), _axis(b, 0)
    w, v = F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y)
    mark = F.coalesce(F.when(pitch_col > 0, pitch_col), 0.1 * F.greatest(w, v))
    return (F.size(a) >= 2) & (F.size(b) >= 2) & (F.least(w, v) >= mark) & (overlap_share(a, b) > most)


def continuation_cost(first: Column, second: Column, scale: Column, gap: float = 1.5, across: float = 0.5, back: float = 0.5, angle: float = 0.5, share: float = 0.5) -> Column:
    """How well two baselines are one line, low for well; null where they are not.

    Measured along and across the direction in which the left one ends.
    """
    swap = F.get(F.element_at(first, -1), F.lit(0)) > F.get(F.get(second, F.lit(0)), F.lit(0))
    a, b = F.when(swap, second).otherwise(first), F.when(swap, first).otherwise(second)
    at = lambda p, i, k: F.get(F.element_at(p, i), F.lit(k)).cast("double")
    dx, dy = at(a, -1, 0) - at(a, -2, 0), at(a, -1, 1) - at(a, -2, 1)
    ex, ey = at(b, 2, 0) - at(b, 1, 0), at(b, 2, 1) - at(b, 1, 1)
    n, m = F.hypot(dx, dy), F.hypot(ex, ey)
    vx, vy = at(b, 1, 0) - at(a, -1, 0), at(b, 1, 1) - at(a, -1, 1)
    along, off = (vx * dx + vy * dy) / n, F.abs(vx * dy - vy * dx) / n
    bent = F.when(m > 0, F.abs(dx * ey - dy * ex) / (n * m)).otherwise(0.0)
    good = (n > 0) & (overlap_share(first, second) <= share) & (off <= across * scale) & (along <= gap * scale) & (along >= -back * scale) & (bent <= angle)
    return F.when((F.size(first) >= 2) & (F.size(second) >= 2), F.when(good, (2 * off + F.abs(along)) / scale))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines numbered from 0 by the middle of their baseline's height, then its left end; without one they come last."""
    y, x = _axis(F.col("baseline"), 1), _axis(F.col("baseline"), 0)
    has = F.size("baseline") >= 2
    mid, left = F.when(has, (F.array_min(y) + F.array_max(y)) / 2), F.when(has, F.array_min(x))
    w = Window.partitionBy("page_id").orderBy(mid.asc_nulls_last(), left.asc_nulls_last(), "line_id")
    return lines.withColumn("order_index", F.row_number().over(w) - 1)


#: Pairs of lines that are compared at once.
_PAIRS = 500_000


class _Lines:
    """Lines of some pages as arrays, for the same measures on many pairs: `continuation_cost`, `stacked`."""

    def __init__(self, baselines: pa.ListArray, pitch: np.ndarray) -> None:
        points = baselines.flatten()
        size = np.asarray(pc.fill_null(pc.list_value_length(baselines), 0))
        width = np.asarray(pc.fill_null(pc.list_value_length(points), 0))
        flat = np.append(np.asarray(pc.cast(points.flatten(), pa.float64()).to_numpy(zero_copy_only=False)), np.nan)
        at = np.cumsum(width) - width
        x, y = (np.append(np.where(width > k, flat[np.minimum(at + k, len(flat) - 1)], np.nan), np.nan) for k in (0, 1))
        first = np.cumsum(size) - size
        self.usable = (size >= 2) & (pitch > 0)
        self.pitch = pitch
        place = lambda k: np.where(size >= 2, first + np.where(k < 0, size + k, k), len(x) - 1)
        self.ends = [(x[place(k)], y[place(k)]) for k in (0, 1, -2, -1)]
        self.low, self.high = np.full(len(size), np.nan), np.full(len(size), np.nan)
        if len(some := np.flatnonzero(size)):
            self.low[some], self.high[some] = np.fmin.reduceat(x[:-1], first[some]), np.fmax.reduceat(x[:-1], first[some])

    def _share(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shorter = np.minimum(self.high[i] - self.low[i], self.high[j] - self.low[j])
        common = np.maximum(0.0, np.minimum(self.high[i], self.high[j]) - np.maximum(self.low[i], self.low[j]))
        return np.where(shorter > 0, common / shorter, 0.0), shorter

    def cost(self, i: np.ndarray, j: np.ndarray, gap: float = 1.5, across: float = 0.5, back: float = 0.5, angle: float = 0.5, share: float = 0.5) -> np.ndarray:
        """`continuation_cost` of each pair, NaN where there is none."""
        swap, scale = self.ends[3][0][i] > self.ends[0][0][j], self.pitch[i]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        (bx, by), (cx, cy), (px, py), (qx, qy) = ((x[k], y[k]) for (x, y), k in zip(self.ends, (b, b, a, a), strict=True))
        dx, dy, ex, ey, vx, vy = qx - px, qy - py, cx - bx, cy - by, bx - qx, by - qy
        n, m = np.hypot(dx, dy), np.hypot(ex, ey)
        along, off = (vx * dx + vy * dy) / n, np.abs(vx * dy - vy * dx) / n
        bent = np.where(m > 0, np.abs(dx * ey - dy * ex) / (n * m), 0.0)
        good = (n > 0) & (self._share(i, j)[0] <= share) & (off <= across * scale) & (along <= gap * scale) & (along >= -back * scale) & (bent <= angle)
        return np.where(good & self.usable[i] & self.usable[j], (2 * off + np.abs(along)) / scale, np.nan)

    def stacked(self, i: np.ndarray, j: np.ndarray, most: float = 0.5) -> np.ndarray:
        share, shorter = self._share(i, j)
        return self.usable[i] & self.usable[j] & (shorter >= self.pitch[i]) & (share > most)


def _continuations(lines: _Lines, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(first, second, cost) of all pairs of lines of one page that continue each other; a line's page ends at its ``stops``."""
    rest = stops - np.arange(len(ids)) - 1
    total = np.cumsum(rest)
    begin = 0
    while begin < len(ids):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _PAIRS, "right")))
        count = rest[begin:end]
        i = np.repeat(np.arange(begin, end), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        cost = lines.cost(i, j)
        good = np.flatnonzero(~np.isnan(cost) & (ids[i] != ids[j]))
        yield from zip(i[good].tolist(), j[good].tolist(), cost[good].tolist(), strict=True)
        begin = end


def _grouped(lines: _Lines, ids: np.ndarray, own: range, pairs: list[tuple[int, int, float]]) -> dict[int, int]:
    """The smallest line of each group of a page, by line, from its pairs; lines of one number count as one."""
    spots: dict[int, list[int]] = {}
    for k in own:
        spots.setdefault(int(ids[k]), []).append(k)
    group: dict[int, set[int]] = {}
    for _, x, y in sorted((c, int(ids[i]), int(ids[j])) for i, j, c in pairs):
        p, q = group.setdefault(x, {x}), group.setdefault(y, {y})
        if p is not q:
            left, right = (np.array([k for u in side for k in spots[u]]) for side in (p, q))
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            if not lines.stacked(i, j).any():
                p |= q
                for u in q:
                    group[u] = p
    return {k: min(g) for k, g in group.items()}


def collinear_groups(lines: DataFrame, pitches: DataFrame) -> DataFrame:
    """(page_id, line_id, group): baselines of one physical line, the group named by its smallest line.

    The cheapest continuations join first; groups that would stand above each other stay
    apart. A page's lines come in one row; the pairs of many pages are compared as arrays,
    and only lines with a continuation are joined one by one.
    """
    kind = lines.schema["page_id"].dataType.simpleString()
    line = F.struct(F.col("line_id").cast("long").alias("line_id"), F.transform("baseline", lambda p: F.transform(p, lambda v: v.cast("double"))).alias("baseline"))
    pages = lines.groupBy("page_id").agg(F.collect_list(line).alias("lines")).join(pitches.select("page_id", "pitch"), "page_id", "left").select("page_id", F.col("pitch").cast("double").alias("pitch"), "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.asarray(pc.list_value_length(batch.column("lines")))
            page = np.repeat(np.arange(batch.num_rows), count)
            rows = batch.column("lines").flatten()
            line_id, baseline = rows.field("line_id"), rows.field("baseline")
            ids, some = np.array(pc.fill_null(line_id, 0)), np.asarray(line_id.is_valid())
            pitch = batch.column("pitch").cast(pa.float64()).to_numpy(zero_copy_only=False)[page]
            stops = np.cumsum(count)
            found: dict[int, list[tuple[int, int, float]]] = {}
            with np.errstate(all="ignore"):
                shapes = _Lines(baseline, np.where(some, pitch, np.nan))
                for i, j, c in _continuations(shapes, ids, stops[page]):
                    found.setdefault(int(page[i]), []).append((i, j, c))
                group = ids.copy()
                for k, pairs in found.items():
                    own = range(int(stops[k] - count[k]), int(stops[k]))
                    joined = _grouped(shapes, ids, own, pairs)
                    for spot in own:
                        group[spot] = joined.get(int(ids[spot]), ids[spot])
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(page)), line_id, pa.array(group, pa.int64(), mask=~some)], ["page_id", "line_id", "group"])

    return pages.mapInArrow(run, f"page_id {kind}, line_id long, group long")


def bands_of(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """The band (page_id, band, top, bottom) that each line (top, bottom) overlaps most, the upper one among equals."""
    rows = lines.select("page_id", "line_id", F.col("top").alias("_t"), F.col("bottom").alias("_b")).join(bands, "page_id").withColumn("overlap", F.least("bottom", "_b") - F.greatest("top", "_t")).where("overlap > 0")
    return rows.groupBy("page_id", "line_id").agg(F.max_by("band", F.struct("overlap", (-F.col("top")).alias("t"))).alias("band"), F.max("overlap").alias("overlap"))


def otsu(histogram: DataFrame) -> DataFrame:
    """Threshold of each image's grey histogram (image_id, level, n): the middle of the two class means of the best split."""
    w = Window.partitionBy("image_id").orderBy("level")
    whole = Window.partitionBy("image_id")
    rows = histogram.withColumn("omega", F.sum("n").over(w) / F.sum("n").over(whole)).withColumn("mu", F.sum(F.col("n") * F.col("level")).over(w) / F.sum("n").over(whole)).withColumn("mean", F.sum(F.col("n") * F.col("level")).over(whole) / F.sum("n").over(whole))
    rest = F.col("omega") * (1 - F.col("omega"))
    between = F.when(rest > 0, (F.col("mean") * F.col("omega") - F.col("mu")) ** 2 / rest).otherwise(0.0)
    best = rows.groupBy("image_id").agg(F.max_by(F.struct("level", "omega", "mu", "mean"), F.struct(between.alias("b"), (-F.col("level")).alias("l"))).alias("s"))
    split = (F.col("s.mu") / F.col("s.omega") + (F.col("s.mean") - F.col("s.mu")) / (1 - F.col("s.omega"))) / 2
    return best.select("image_id", F.when((F.col("s.omega") > 0) & (F.col("s.omega") < 1), split).otherwise(F.col("s.level").cast("double")).alias("threshold"))


def row_bands(profile: DataFrame, ratio: float = 0.4, least: int = 3) -> DataFrame:
    """Runs of rows (page_id, y, ink, smoothed before) above a share of the page's largest: band, top, bottom (exclusive)."""
    peak = F.max("ink").over(Window.partitionBy("page_id"))
    w = Window.partitionBy("page_id").orderBy("y")
    above = profile.withColumn("_peak", peak).withColumn("_i", F.row_number().over(w)).where((F.col("ink") > ratio * F.col("_peak")) & (F.col("_peak") > 0))
    runs = above.withColumn("_run", F.col("_i") - F.row_number().over(w)).groupBy("page_id", "_run").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return runs.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("top")).alias("band"), "top", "bottom")


def word_confidence(confidences: Column, start: Column, end: Column) -> Column:
    """Mean confidence of a word's characters; null where it has none."""
    part = F.slice(confidences, start + 1, F.greatest(end - start, F.lit(0)))
    return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """P10: convex hull, counter-clockwise from the leftmost point."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def merged_outline(pieces: Column) -> Column:
    """P10: hull of the outlines of a line's pieces (array of polygons)."""

    @F.pandas_udf("array<array<double>>")
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda ps: [list(p) for p in hull([(float(x), float(y)) for poly in ps for x, y in poly])])

    return apply(pieces)


def midline(points: list[tuple[float, float]], steps: int = 16) -> list[tuple[float, float]]:
    """Points along the middle of an outline, in order of its long axis, left to right."""
    p = np.array(points, float)
    if len(p) < 3:
        return [tuple(x) for x in p.tolist()]
    centre = p.mean(axis=0)
    axis = np.linalg.eigh(np.cov((p - centre).T))[1][:, -1]
    axis = axis if axis[0] >= 0 else -axis
    across = np.array([-axis[1], axis[0]])
    closed = np.vstack([p, p[:1]])
    dense = np.concatenate([a + (b - a) * np.linspace(0, 1, 33)[:-1, None] for a, b in zip(closed[:-1], closed[1:], strict=True)])
    u, v = (dense - centre) @ axis, (dense - centre) @ across
    edges = np.linspace(u.min(), u.max(), steps + 1)
    cell = np.clip(np.searchsorted(edges, u, "right") - 1, 0, steps - 1)
    out = []
    for k in range(steps):
        own = v[cell == k]
        if len(own):
            out.append(tuple((centre + axis * (edges[k] + edges[k + 1]) / 2 + across * (own.min() + own.max()) / 2).tolist()))
    return out


def baseline_of(outline: Column, steps: int = 16) -> Column:
    """P11 on a column of outlines."""

    @F.pandas_udf("array<array<double>>")
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda ps: [list(q) for q in midline([(float(x), float(y)) for x, y in ps], steps)] if ps is not None else None)

    return apply(outline)


def nearest_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each word (line_id, word_id, x, y of its middle) the box of its line (box_id, x, y) whose middle is nearest, the smaller id among equals."""
    b = boxes.select("line_id", "box_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    far = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return words.join(b, "line_id").groupBy("line_id", "word_id").agg(F.min_by("box_id", F.struct(far.alias("d"), F.col("box_id").alias("b"))).alias("box_id"), F.min(far).alias("distance"))
