"""Rows that Spark has brought together by image and sorted, worked on in whole images as columns inside a task.

Tasks get these functions by value, so no executor needs the library.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])
CORNERS = ("y1", "x1", "x2", "y2")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut anew, so that rows with the same first column (sorted, never null) are in one table; at most a batch and one image's rows are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(ids, ids[-1]))
        if held and held[-1].column(0)[0].as_py() != ids[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_image(rows: DataFrame, order: list, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work on tables of whole images, rows in order; rows begin with image_id. An image's rows are held at once, so images of any size go another way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            yield work(table)

    return rows.where("image_id is not null").repartition("image_id").sortWithinPartitions("image_id", *order).mapInArrow(run, schema)


def numbers(table: pa.Table, names: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of whole numbers, nulls as 0, and the rows in which none is null."""
    there = np.ones(table.num_rows, bool)
    found = []
    for name in names:
        column = table[name].combine_chunks()
        if column.null_count:
            there &= column.is_valid().to_numpy(zero_copy_only=False)
            column = column.fill_null(0)
        found.append(column.to_numpy(zero_copy_only=False).astype(np.int64))
    return found, there


def starts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each image, and each row's image as its place among them."""
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i many[i] rows from first[i] on: the i, and the rows."""
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]


def batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))


def met(boxes: list[np.ndarray], wide: np.ndarray, label: np.ndarray, first: np.ndarray, of: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The row that each row is matched to (-1: none) and their overlap; an image's labels come before its other boxes."""
    y1, x1, x2, y2 = boxes
    many = np.bincount(of, label, len(first)).astype(np.int64)
    dets = np.flatnonzero(~label & wide)
    i, l = spread(first[of[dets]], many[of[dets]])
    d = dets[i]
    inter = np.maximum(np.minimum(x2[d], x2[l]) - np.maximum(x1[d], x1[l]), 0) * np.maximum(np.minimum(y2[d], y2[l]) - np.maximum(y1[d], y1[l]), 0)
    near = np.flatnonzero((inter > 0) & wide[l])
    d, l, inter = d[near], l[near], inter[near]
    area = (x2 - x1) * (y2 - y1)
    iou = inter / (area[d] + area[l] - inter)
    near = np.flatnonzero(iou >= threshold)
    near = near[np.lexsort((l[near], d[near], -iou[near]))]
    d, l, iou = d[near], l[near], iou[near]
    mate, share = np.full(len(of), -1), np.zeros(len(of))
    # by rounds, as in matching.mutual: a pair that comes first for both its sides stays
    while len(d):
        k, at = np.arange(len(d)), np.empty((2, len(of)), np.int64)
        at[0, d[::-1]], at[1, l[::-1]] = k[::-1], k[::-1]
        won = (at[0, d] == k) & (at[1, l] == k)
        mate[d[won]], mate[l[won]], share[d[won]], share[l[won]] = l[won], d[won], iou[won], iou[won]
        left = (mate[d] < 0) & (mate[l] < 0)
        d, l, iou = d[left], l[left], iou[left]
    return mate, share


def facing(threshold: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """What matching.FACED says of whole images' boxes, an image's labels first, both sides in the order of their numbers."""

    def work(table: pa.Table) -> pa.RecordBatch:
        corners, there = numbers(table, CORNERS)
        y1, x1, x2, y2 = corners
        label = table["label"].to_numpy()
        first, of = starts(table["image_id"].to_numpy())
        mate, share = met(corners, there & (x2 > x1) & (y2 > y1), label, first, of, threshold)
        n = np.arange(len(of)) - first[of] + 1 - np.where(label, 0, np.bincount(of, label, len(first)).astype(np.int64)[of])
        alone = mate < 0
        told = lambda values, kind: pa.array(values, kind, mask=alone)
        columns = {"image_id": table["image_id"], "label": table["label"], "n": pa.array(n, pa.int32()), **{c: table[c] for c in CORNERS}, "mate": told(n[mate], pa.int32()), "iou": told(share, pa.float64())}
        return batch(columns | {f"m_{c}": told(v[mate], pa.int32()) for c, v in zip(CORNERS, corners, strict=True)})

    return work


def judging(threshold: float, good: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """For each image, kind and attempt (rows in that order, then by n) its labels, boxes, what was done, and the pairs and poor pairs of its boxes matched to its labels.

    A row is a label (not slot), its box may be there; corners are the box's, was_ the label's.
    """

    def work(table: pa.Table) -> pa.RecordBatch:
        (image, kind, attempt), _ = numbers(table, ("image_id", "kind", "attempt"))
        new = np.ones(len(image), bool)
        new[1:] = (image[1:] != image[:-1]) | (kind[1:] != kind[:-1]) | (attempt[1:] != attempt[:-1])
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        flag = lambda name: table[name].to_numpy()
        count = lambda where: np.bincount(of, where, len(first)).astype(np.int64)
        now, now_there = numbers(table, CORNERS)
        was, was_there = numbers(table, tuple(f"was_{c}" for c in CORNERS))
        labels, boxes = np.flatnonzero(~flag("slot")), np.flatnonzero(flag("there"))
        of_both, label = np.concatenate((of[labels], of[boxes])), np.arange(len(labels) + len(boxes)) < len(labels)
        order = np.argsort(2 * of_both + ~label, kind="stable")
        of_both, label = of_both[order], label[order]
        y1, x1, x2, y2 = corners = [np.concatenate((w[labels], b[boxes]))[order] for w, b in zip(was, now, strict=True)]
        wide = np.concatenate((was_there[labels], now_there[boxes]))[order] & (x2 > x1) & (y2 > y1)
        mate, share = met(corners, wide, label, np.searchsorted(of_both, np.arange(len(first))), of_both, threshold)
        paired = label & (mate >= 0)
        pairs = lambda where: np.bincount(of_both[where], minlength=len(first))
        told = {"n_label": count(~flag("slot")), "n_box": count(flag("there")), **{c: count(flag(c)) for c in ("changed", "added", "failed")}, "n_pair": pairs(paired), "n_poor": pairs(paired & (share < good))}
        return batch({"image_id": pa.array(image[first], pa.int64()), "kind": pa.array(kind[first], pa.int32()), "attempt": pa.array(attempt[first], pa.int32()), **{k: pa.array(v, pa.int64()) for k, v in told.items()}})

    return work


def _largest(v: np.ndarray, g: np.ndarray, groups: int) -> np.ndarray:
    """The largest v of each group g (sorted), -1 of those without any; v is never negative."""
    found = np.full(groups, -1, np.int64)
    if len(g):
        first, of = starts(g)
        found[g[first]] = np.maximum.reduceat(v, first)
    return found


def _first(rows: np.ndarray, g: np.ndarray, groups: int) -> np.ndarray:
    """The first of the rows (sorted) in each group, -1 of those without any."""
    found = np.full(groups, -1, np.int64)
    found[g[rows][::-1]] = rows[::-1]
    return found


def telling(inputs: int, quadrants: tuple[str, ...], size: int, near: int, long: int, rect: tuple[int, int]) -> tuple[Callable[[pa.Table], pa.RecordBatch], str]:
    """What tools.told_of_boxes and the pair tools tell of each image and input, and its schema; `of` holds a bit for each input that has the box.

    Boxes come in the order of their numbers, none has a null. Of equal sides the first box is the longest and the shortest.
    """
    counts = ("n_boxes", *(f"n_{q}" for q in quadrants), *(f"long_{q}" for q in quadrants), "n_edge", "n_rect", "n_long")
    sides = (*(f"max_{q}" for q in quadrants), "max_side", "min_side")
    pairs = ("pair_d4", "neighbour_d4", "ends_d4")
    schema = f"image_id long, input int, {', '.join(f'{c} long' for c in counts)}, {', '.join(f'{c} int' for c in sides)}, {', '.join(f'{c} long' for c in pairs)}"
    far = 1 << 40

    def one(y1, x1, x2, y2, g, groups) -> dict:
        side, cx, cy = np.maximum(x2 - x1, y2 - y1), x1 + x2, y1 + y2
        q = 2 * (cy >= size) + (cx >= size)
        big = side >= long
        count = lambda where: np.bincount(g[where], minlength=groups)
        told = {"n_boxes": np.bincount(g, minlength=groups), "n_edge": count((x1 <= near) | (y1 <= near) | (x2 >= size - near) | (y2 >= size - near)), "n_long": count(big)}
        told["n_rect"] = count((cx >= 2 * rect[0]) & (cx < 2 * rect[1]) & (cy >= 2 * rect[0]) & (cy < 2 * rect[1]))
        # sides may be negative where boxes are odd, so they are moved up by as much as they can be
        for i, name in enumerate(quadrants):
            own = q == i
            told[f"n_{name}"], told[f"long_{name}"], told[f"max_{name}"] = count(own), count(own & big), _largest(side[own] + far, g[own], groups)
        told["max_side"], low = _largest(side + far, g, groups), _largest(far - side, g, groups)
        told["min_side"] = np.where(low < 0, -1, 2 * far - low)
        top, end = (_first(np.flatnonzero(side + far == told[c][g]), g, groups) for c in ("max_side", "min_side"))
        d4 = lambda a, b: (cx[a] - cx[b]) ** 2 + (cy[a] - cy[b]) ** 2
        nearest = lambda d, g: np.where((found := _largest(far - d, g, groups)) < 0, -1, far - found)
        row = np.arange(len(g))
        a, b = spread(row + 1, np.searchsorted(g, g, "right") - row - 1)
        told["pair_d4"] = nearest(d4(a, b), g[a])
        other = row[row != top[g]]
        told["neighbour_d4"] = nearest(d4(other, top[g[other]]), g[other])
        told["ends_d4"] = np.where((told["n_boxes"] > 0) & (top != end), d4(top, end) if len(g) else -1, -1)
        return told

    def work(table: pa.Table) -> pa.RecordBatch:
        (of, *corners), _ = numbers(table, ("of", *CORNERS))
        image = table["image_id"].to_numpy()
        first, g = starts(image)
        own = [np.flatnonzero(of >> i & 1) for i in range(inputs)]
        found = [one(*(c[rows] for c in corners), g[rows], len(first)) for rows in own]
        columns = {"image_id": pa.array(np.repeat(image[first], inputs), pa.int64()), "input": pa.array(np.tile(np.arange(inputs), len(first)), pa.int32())}
        for c in (*counts, *sides, *pairs):
            v = np.stack([f[c] for f in found], 1).ravel()
            none = v < 0 if c not in counts else None
            columns[c] = pa.array(v - far if c in sides else v, pa.int32() if c in sides else pa.int64(), mask=none)
        return batch(columns)

    return work, schema


def comparing(inputs: tuple[str, ...], near: tuple[bool, ...], relative: float, absolute: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """image_id, t (a place among the answers) and, for each input but the labels, right_ and any_, of every answer that the labels (input 0) give.

    Rows are images' inputs with an answer a column; near: is it right within the tolerance, or only if equal? No answer never is.
    """

    def work(table: pa.Table) -> pa.RecordBatch:
        image, of = table["image_id"].to_numpy(), table["input"].to_numpy()
        answers = np.stack([table[f"a{t}"].to_numpy() for t in range(len(near))], 1)
        first, g = starts(image)
        own = [_first(np.flatnonzero(of == i), g, len(first)) for i in range(len(inputs) + 1)]
        gold = answers[own[0]]
        given = ~np.isnan(gold)
        most = np.where(near, relative * np.abs(gold) + absolute, 0.0)[given]
        place, t = np.nonzero(given)
        columns = {"image_id": pa.array(image[first][place], pa.int64()), "t": pa.array(t, pa.int32())}
        for name, rows in zip(inputs, own[1:], strict=True):
            told = answers[rows][given]
            columns |= {f"right_{name}": pa.array(np.abs(told - gold[given]) <= most), f"any_{name}": pa.array(~np.isnan(told))}
        return batch(columns)

    return work
