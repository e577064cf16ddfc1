"""Masks as run lengths, never as dense arrays in a table.

A mask is ``struct<h int, w int, counts array<int>>``: runs in column order, the
first of zeros. Rectangles have a closed form as an expression. What needs the
places of runs (areas, boxes, overlaps, discs, padding) works on the runs of a whole
Arrow batch at once, as flat arrays without a loop over rows, and is linear in the
runs. Polygons, compressed strings and resampling go to vectorised Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .geometry import let

MASK = StructType([StructField("h", IntegerType()), StructField("w", IntegerType()), StructField("counts", ArrayType(IntegerType()))])


def _mask(h: Column, w: Column, counts: Column) -> Column:
    return F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), counts.cast("array<int>").alias("counts"))


def from_pixels(pixels: Column, h: Column, w: Column) -> Column:
    """A mask from its pixels in column order (M7): the lengths between changes."""

    def counts(p: Column) -> Column:
        set_ = lambda i: F.when(i < 0, F.lit(False)).otherwise(F.coalesce(F.get(p, i) != 0, F.lit(False)))
        places = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        changes = F.concat(F.filter(places, lambda i: set_(i) != set_(i - 1)), F.array(F.size(p)))
        return let(changes, lambda c: F.transform(c, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1))))

    return _mask(h, w, let(pixels, counts))


def box_mask(box: Column, w: Column, h: Column) -> Column:
    """A filled box, corners cut to whole pixels, the right and lower edge left out (M1)."""
    whole = lambda i, top: F.least(F.greatest(F.get(box, F.lit(i)).cast("int"), F.lit(0)), top)
    corners = F.array(whole(0, w), whole(1, h), whole(2, w), whole(3, h))

    def body(c: Column) -> Column:
        x1, y1, x2, y2 = (F.get(c, F.lit(i)) for i in range(4))
        wide, high = F.greatest(x2 - x1, F.lit(0)), F.greatest(y2 - y1, F.lit(0))
        whole = high == h
        first = F.when(whole, x1 * h).otherwise(x1 * h + y1)
        ones = F.when(whole, F.array(wide * h)).otherwise(F.concat(F.array(high), F.flatten(F.array_repeat(F.array(h - high, high), wide - 1))))
        tail = w * h - first - F.when(whole, wide * h).otherwise((wide - 1) * h + high)
        return F.when((wide == 0) | (high == 0), F.array(w * h)).otherwise(F.concat(F.array(first), ones, F.when(tail > 0, F.array(tail)).otherwise(F.array().cast("array<int>"))))

    return _mask(h, w, let(corners, body))


class _Flat:
    """The runs of a batch of masks as flat arrays."""

    def __init__(self, masks: pa.StructArray):
        counts = masks.field("counts")
        self.valid = masks.is_valid().to_numpy(zero_copy_only=False) & counts.is_valid().to_numpy(zero_copy_only=False)
        self.h, self.w = (pc.fill_null(masks.field(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in "hw")
        self.n = np.where(self.valid, pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        # lists behind a null hold nothing that counts
        self.runs = pc.fill_null(pc.list_flatten(counts.filter(pa.array(self.valid))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.cumsum(self.n) - self.n
        at = np.arange(len(self.runs)) - self.first[self.row]
        whole = np.cumsum(self.runs)
        self.end = whole - np.where(self.first > 0, whole[self.first - 1] if len(whole) else 0, 0)[self.row] if len(whole) else whole
        self.set = at % 2 == 1

    def sums(self, values: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.row if row is None else row, values, len(self.n)).astype(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, begin and end of every run of set pixels."""
        some = self.set & (self.runs > 0)
        return self.row[some], self.end[some] - self.runs[some], self.end[some]

    def null(self) -> np.ndarray:
        return ~self.valid


def _of_spans(row: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, w: np.ndarray, null: np.ndarray) -> pa.StructArray:
    """Masks of rising half-open spans, grouped by row; spans that touch are joined."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] != b[:-1])
    last = np.append(new[1:], True) if len(new) else new
    row, a, b = row[new], a[new], b[last]
    k = np.bincount(row, minlength=len(h))
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    before = np.where(fresh, 0, np.concatenate([[0], b[:-1]])) if len(b) else b
    done = np.zeros(len(h), np.int64)
    done[row] = b
    tail = h * w - done
    more = (tail > 0) | (k == 0)
    n = np.where(null, 0, 2 * k + more)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int32)
    place = at[row] + 2 * (np.arange(len(row)) - (np.cumsum(k) - k)[row])
    out[place], out[place + 1] = a - before, b - a
    closing = more & ~null
    out[(at + n - 1)[closing]] = tail[closing]
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, n.sum()).astype(np.int32)), pa.array(out))
    return pa.StructArray.from_arrays([pa.array(h.astype(np.int32)), pa.array(w.astype(np.int32)), lists], ["h", "w", "counts"], mask=pa.array(null))


def _numbers(*columns: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns as whole numbers, and where any is null."""
    null = np.zeros(len(columns[0]), bool)
    for c in columns:
        null |= c.is_null().to_numpy(zero_copy_only=False)
    return [np.floor(pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64) for c in columns], null


def disc_mask(x: Column, y: Column, radius: int, w: Column, h: Column) -> Column:
    """A disc around a point (M2): the chord of each column it touches."""

    def discs(x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        (cx, cy, width, height), null = _numbers(x, y, w, h)
        dx = np.arange(-radius, radius + 1)
        half = np.floor(np.sqrt(radius * radius - dx * dx)).astype(np.int64)
        column = cx[:, None] + dx
        top, low = np.maximum(cy[:, None] - half, 0), np.minimum(cy[:, None] + half + 1, height[:, None])
        row, k = np.nonzero((column >= 0) & (column < width[:, None]) & (low > top) & ~null[:, None])
        at = column[row, k] * height[row]
        return _of_spans(row, at + top[row, k], at + low[row, k], height, width, null)

    return F.arrow_udf(discs, MASK)(x, y, w, h)


def _areas(masks: pa.Array) -> pa.Array:
    m = _Flat(masks)
    return pa.array(m.sums(np.where(m.set, m.runs, 0)), pa.int64(), mask=m.null())


#: Number of set pixels.
area = F.arrow_udf(_areas, LongType())


def _common(a: _Flat, b: _Flat) -> np.ndarray:
    """Set pixels of both masks of each row: the set pixels of one before each edge of the other."""
    size = int(max(a.end.max(initial=0), b.end.max(initial=0))) + 1
    before = np.cumsum(np.where(b.set, b.runs, 0))
    base = np.where(b.first > 0, before[b.first - 1] if len(before) else 0, 0) if len(before) else np.zeros(len(b.n), np.int64)

    def upto(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(b.row * size + b.end, row * size + at), len(b.row) - 1)
        inside = b.row[k] == row
        return np.where(inside, before[k] - base[row] - np.where(b.set[k], b.end[k] - at, 0), 0)

    row, lo, hi = a.spans()
    return a.sums(upto(row, hi) - upto(row, lo), row) if len(row) and len(b.row) else np.zeros(len(a.n), np.int64)


def _intersections(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = _Flat(a), _Flat(b)
    return pa.array(_common(x, y), pa.int64(), mask=x.null() | y.null())


#: Pixels set in both masks, which are of one size.
intersection = F.arrow_udf(_intersections, LongType())


def iou(a: Column, b: Column) -> Column:
    """Overlap of two masks (M10), null for two empty ones."""
    both = intersection(a, b)
    return F.try_divide(both.cast("double"), (area(a) + area(b) - both).cast("double"))


def _matrix(a: pa.Array, b: pa.Array) -> pa.Array:
    sizes = [np.where(x.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64) for x in (a, b)]
    at = [np.cumsum(n) - n for n in sizes]
    flat = [pc.list_flatten(x) for x in (a, b)]
    each = sizes[0] * sizes[1]
    row = np.repeat(np.arange(len(each)), each)
    k = np.arange(len(row)) - (np.cumsum(each) - each)[row]
    i, j = at[0][row] + k // np.maximum(sizes[1][row], 1), at[1][row] + k % np.maximum(sizes[1][row], 1)
    x, y = (_Flat(f.take(pa.array(t))) for f, t in zip(flat, (i, j), strict=True))
    both = _common(x, y)
    union = x.sums(np.where(x.set, x.runs, 0)) + y.sums(np.where(y.set, y.runs, 0)) - both
    values = pa.array(both / np.maximum(union, 1), mask=union == 0)
    inner = np.repeat(sizes[1], sizes[0])
    lines = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inner)).astype(np.int32)), values)
    null = pa.array(a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[0])).astype(np.int32)), lines, mask=null)


#: Overlap of every mask of one array with every mask of another (M11); null for two empty ones.
iou_matrix = F.arrow_udf(_matrix, ArrayType(ArrayType(DoubleType())))


def _bounds(masks: pa.Array) -> pa.Array:
    m = _Flat(masks)
    row, a, b = m.spans()
    h = np.maximum(m.h[row], 1)
    left, right = a // h, (b - 1) // h
    across = left != right
    out = np.full((len(m.n), 4), np.nan)
    for k, (values, pick) in enumerate(((left, np.fmin), (np.where(across, 0, a % h), np.fmin), (right, np.fmax), (np.where(across, h - 1, (b - 1) % h), np.fmax))):
        pick.at(out[:, k], row, values.astype(float))
    empty = np.isnan(out[:, 0])
    return pa.FixedSizeListArray.from_arrays(pa.array(np.where(np.isnan(out), 0, out).ravel()), 4, mask=pa.array(empty)).cast(pa.list_(pa.float64()))


#: Box around the set pixels (M16), null for an empty mask.
bounds = F.arrow_udf(_bounds, ArrayType(DoubleType()))


def _squared(masks: pa.Array) -> pa.Array:
    m = _Flat(masks)
    row, a, b = m.spans()
    h = np.maximum(m.h[row], 1)
    # set runs, cut where they pass from one column to the next
    n = (b - 1) // h - a // h + 1
    piece = np.repeat(np.arange(len(row)), n)
    column = (a // h)[piece] + np.arange(len(piece)) - (np.cumsum(n) - n)[piece]
    row, h = row[piece], h[piece]
    side = np.maximum(m.h, m.w)
    base = (column + ((side - m.w) // 2)[row]) * side[row] + ((side - m.h) // 2)[row]
    return _of_spans(row, base + np.maximum(a[piece] - column * h, 0), base + np.minimum(b[piece] - column * h, h), side, side, m.null())


#: The mask in the padded square (M3, M4).
expand_square = F.arrow_udf(_squared, MASK)


def pixel_area(w: Column, h: Column) -> Column:
    """Valid part of the padded square as left, top, right, bottom."""
    side = F.greatest(w, h)
    left, top = F.floor((side - w) / 2), F.floor((side - h) / 2)
    return F.array(*[c.cast("int") for c in (left, top, left + w, top + h)])


def _dense(counts: list[int], h: int, w: int) -> np.ndarray:
    values = np.arange(len(counts)) % 2
    flat = np.repeat(values, counts)[: h * w]
    return np.pad(flat, (0, h * w - len(flat))).reshape(w, h).T.astype(bool)


def _runs(dense: np.ndarray) -> list[int]:
    flat = dense.T.ravel().astype(np.int8)
    edges = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.concatenate([[0], edges, [len(flat)]])).tolist()
    return counts if not len(flat) or not flat[0] else [0, *counts]


def compress(counts: list[int]) -> str:
    """Run lengths as the compact text of the common annotation format (M9): differences in groups of five bits."""
    out = []
    for i, n in enumerate(counts):
        x = n - counts[i - 2] if i > 2 else n
        more = True
        while more:
            c = x & 31
            x >>= 5
            more = x != -1 if c & 16 else x != 0
            out.append(chr((c | 32 if more else c) + 48))
    return "".join(out)


def decompress(text: str) -> list[int]:
    """The inverse of ``compress`` (M8)."""
    counts: list[int] = []
    at = 0
    while at < len(text):
        x, shift, more = 0, 0, True
        while more:
            c = ord(text[at]) - 48
            at += 1
            x |= (c & 31) << shift
            shift += 5
            more = bool(c & 32)
            if not more and c & 16:
                x |= -1 << shift
        counts.append(x + counts[-2] if len(counts) > 2 else x)
    return counts


def fill_polygons(polygons: list[list[float]], h: int, w: int) -> np.ndarray:
    """Pixels whose centre lies inside any of the polygons (M8), even-odd rule per polygon."""
    out = np.zeros((h, w), bool)
    ys = np.arange(h) + 0.5
    for flat in polygons:
        p = np.asarray(flat, float).reshape(-1, 2)
        if len(p) < 3:
            continue
        q = np.roll(p, -1, axis=0)
        one = np.zeros((h, w), bool)
        for k, y in enumerate(ys):
            cross = (p[:, 1] <= y) != (q[:, 1] <= y)
            if not cross.any():
                continue
            a, b = p[cross], q[cross]
            xs = np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
            for x1, x2 in zip(xs[::2], xs[1::2], strict=False):
                lo, hi = int(np.ceil(x1 - 0.5)), int(np.ceil(x2 - 0.5))
                one[k, max(lo, 0) : max(min(hi, w), 0)] = True
        out |= one
    return out


@F.pandas_udf(MASK)
def polygon_mask(polygons: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """Polygons as a mask; null polygons give an empty mask."""
    rows = [(int(b), int(c), _runs(fill_polygons([list(x) for x in p] if p is not None else [], int(b), int(c)))) for p, b, c in zip(polygons, h, w, strict=True)]
    return pd.DataFrame(rows, columns=["h", "w", "counts"])


@F.pandas_udf(StringType())
def compressed(counts: pd.Series) -> pd.Series:
    """Counts as compact text (M9)."""
    return counts.map(lambda c: None if c is None else compress([int(x) for x in c]))


@F.pandas_udf(ArrayType(IntegerType()))
def decompressed(text: pd.Series) -> pd.Series:
    """Compact text as counts (M8)."""
    return text.map(lambda t: None if t is None else decompress(t))


def resample(dense: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * dense.shape[0] / h - 0.5, 0, dense.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * dense.shape[1] / w - 0.5, 0, dense.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, dense.shape[0] - 1), np.minimum(x0 + 1, dense.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    d = dense.astype(float)
    return (d[y0][:, x0] * (1 - fy) + d[y1][:, x0] * fy) * (1 - fx) + (d[y0][:, x1] * (1 - fy) + d[y1][:, x1] * fy) * fx


@F.pandas_udf(MASK)
def square_to_origin(mask: pd.DataFrame, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    """A mask of the padded square in its original image (M5): resampled, thresholded at one half, cropped."""
    rows = []
    for c, mh, mw, ow, oh in zip(mask["counts"], mask["h"], mask["w"], w, h, strict=True):
        side = max(int(ow), int(oh))
        big = resample(_dense([int(x) for x in c], int(mh), int(mw)), side, side) > 0.5
        top, left = (side - int(oh)) // 2, (side - int(ow)) // 2
        rows.append((int(oh), int(ow), _runs(big[top : top + int(oh), left : left + int(ow)])))
    return pd.DataFrame(rows, columns=["h", "w", "counts"])


def _resized(mask: pd.DataFrame, ratio: pd.Series) -> pd.DataFrame:
    rows = []
    for c, h, w, r in zip(mask["counts"], mask["h"], mask["w"], ratio, strict=True):
        nh, nw = max(1, int(h * r)), max(1, int(w * r))
        rows.append((nh, nw, _runs(resample(_dense([int(x) for x in c], int(h), int(w)), nh, nw) > 0)))
    return pd.DataFrame(rows, columns=["h", "w", "counts"])


#: A mask scaled by a ratio; what is touched stays set.
resized = F.pandas_udf(_resized, MASK)


def _dilated(mask: pd.DataFrame, size: pd.Series) -> pd.DataFrame:
    rows = []
    for c, h, w, k in zip(mask["counts"], mask["h"], mask["w"], size, strict=True):
        d = _dense([int(x) for x in c], int(h), int(w))
        out = np.zeros_like(d)
        lo, hi = int(k) // 2, int(k) - int(k) // 2
        for y, x in np.argwhere(d):
            out[max(0, y - hi + 1) : y + lo + 1, max(0, x - hi + 1) : x + lo + 1] = True
        rows.append((int(h), int(w), _runs(out)))
    return pd.DataFrame(rows, columns=["h", "w", "counts"])


#: A mask grown by a square of some size.
dilated = F.pandas_udf(_dilated, MASK)


def segment_ids(r: Column, g: Column, b: Column) -> Column:
    """Segment number of a colour."""
    return r + g * 256 + b * 65536
