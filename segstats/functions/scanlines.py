"""Scan conversion of one Arrow batch of polygons, all objects of the batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS_AT_ONCE = 4_000_000  # edge rows held in memory together, unless one object alone has more


def edges_of(segmentation: pa.ListArray) -> dict[str, np.ndarray]:
    """Edges of all rings: object number, hole flag and integer end points (truncated)."""
    rings = segmentation.flatten()
    ring_obj = np.asarray(pc.list_parent_indices(segmentation), dtype=np.int64)
    first = np.ones(len(ring_obj), dtype=bool)
    first[1:] = ring_obj[1:] != ring_obj[:-1]
    coord_ring = np.asarray(pc.list_parent_indices(rings), dtype=np.int64)[::2]
    flat = np.trunc(np.asarray(rings.flatten(), dtype=np.float64)).astype(np.int64)
    x, y = flat[::2], flat[1::2]
    last = np.ones(len(x), dtype=bool)
    last[:-1] = coord_ring[:-1] != coord_ring[1:]
    begin = np.zeros(len(x), dtype=np.int64)
    begin[np.flatnonzero(last)[:-1] + 1] = np.flatnonzero(last)[:-1] + 1
    begin = np.maximum.accumulate(begin)
    following = np.where(last, begin, np.arange(len(x)) + 1)
    return {"ring": coord_ring, "obj": ring_obj[coord_ring], "hole": ~first[coord_ring], "x1": x, "y1": y, "x2": x[following], "y2": y[following]}


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sort key for (a, b); a is not negative."""
    if not len(a):
        return a
    span = int(b.max()) - int(b.min()) + 1
    if (int(a.max()) + 1) * span >= 1 << 62:
        names, b = np.unique(b, return_inverse=True)
        span = len(names)
    return a * span + (b - b.min())


def _places(owner: np.ndarray, *ys: np.ndarray) -> tuple[np.ndarray, int]:
    """Add the result to a line of an owner (a small number) for a place of its own; the lines lie between the smallest and the largest of ``ys``; how many places there are."""
    owners = int(owner.max()) + 1 if len(owner) else 0
    top, bottom = np.full(owners, np.iinfo(np.int64).max), np.full(owners, np.iinfo(np.int64).min)
    for y in ys:
        np.minimum.at(top, owner, y)
        np.maximum.at(bottom, owner, y)
    some = top <= bottom
    lines = np.where(some, bottom - np.where(some, top, 0) + 1, 0)
    return np.cumsum(lines) - lines - np.where(some, top, 0), int(lines.sum())


def _by_twos(place: np.ndarray, x: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours along x of the crossings of each place: the first with the second, the third with the fourth."""
    n = np.bincount(place, minlength=places)
    one, other = np.zeros(places, np.int64), np.zeros(places, np.int64)
    number = np.arange(len(place))
    other[place] = number
    one[place[::-1]] = number[::-1]
    twos = np.flatnonzero(n == 2)
    one, other = one[twos], other[twos]
    turned = x[one] > x[other]
    left, right = np.where(turned, other, one), np.where(turned, one, other)
    more = np.flatnonzero(n[place] > 2)
    more = more[np.lexsort((x[more], place[more]))]
    return np.concatenate([left, more[::2]]), np.concatenate([right, more[1::2]])


def _closed_runs(e: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs (object, hole, y, first, last) whose union is the closed region of each ring.

    Every slanted edge is cut at each line it meets, once without its top end and
    once without its bottom end; sorted crossings of a reading pair up.  The two
    readings differ on the lines of the vertices only, so the second one is made there.
    """
    low, high = np.minimum(e["y1"], e["y2"]), np.maximum(e["y1"], e["y2"])
    base, places = _places(e["ring"], low, high)
    corner = np.zeros(places, bool)
    corner[base[e["ring"]] + e["y1"]] = True
    slanted = np.flatnonzero(low != high)
    height = high[slanted] - low[slanted]
    row = np.repeat(slanted, height)
    line = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(height) - height, height)
    place = base[e["ring"][row]] + line
    again = np.flatnonzero(corner[place + 1])
    which = np.concatenate([row, row[again]])
    y = np.concatenate([line, line[again] + 1])
    dx, dy = e["x2"][which] - e["x1"][which], e["y2"][which] - e["y1"][which]
    x = (e["x1"][which] * dy + (y - e["y1"][which]) * dx) / dy
    left, right = _by_twos(np.concatenate([place, places + place[again] + 1]), x, 2 * places)
    level = np.flatnonzero(low == high)
    a = np.concatenate([np.ceil(x[left]).astype(np.int64), np.minimum(e["x1"], e["x2"])[level]])
    b = np.concatenate([np.floor(x[right]).astype(np.int64), np.maximum(e["x1"], e["x2"])[level]])
    source = np.concatenate([which[left], level])
    line = np.concatenate([y[left], e["y1"][level]])
    full = a <= b
    return e["obj"][source][full], e["hole"][source][full], line[full], a[full], b[full]


def _outer_minus_holes(obj, hole, y, a, b) -> tuple[np.ndarray, ...]:
    """Covered by the outline and by no hole; touching pieces are joined.  Lines with one run need no sweep."""
    base, places = _places(obj, y)
    if places > 4 * len(y) + 1000:  # a hole far from its outline
        return _sweep(obj, hole, y, a, b)
    place = base[obj] + y
    lone = np.bincount(place, minlength=places)[place] == 1
    rest, lone = ~lone, lone & ~hole
    swept = _sweep(*(c[rest] for c in (obj, hole, y, a, b)))
    return tuple(np.concatenate([c[lone], d]) for c, d in zip((obj, y, a, b), swept))


def _sweep(obj, hole, y, a, b) -> tuple[np.ndarray, ...]:
    """Sweep along each (object, line)."""
    pos = np.concatenate([a, b + 1])
    sign = np.repeat([1, -1], len(a))
    obj2, y2, hole2 = np.tile(obj, 2), np.tile(y, 2), np.tile(hole, 2)
    order = np.lexsort((pos, _joined(obj2, y2)))
    pos, obj2, y2 = pos[order], obj2[order], y2[order]
    delta = sign[order]
    outer = np.cumsum(np.where(hole2[order], 0, delta))
    covered = np.cumsum(np.where(hole2[order], delta, 0))
    same = (obj2[1:] == obj2[:-1]) & (y2[1:] == y2[:-1])
    piece = np.flatnonzero(same & (outer[:-1] > 0) & (covered[:-1] == 0) & (pos[1:] > pos[:-1]))
    o, line, begin, end = obj2[piece], y2[piece], pos[piece], pos[piece + 1] - 1
    starts = np.ones(len(o), dtype=bool)
    starts[1:] = (o[1:] != o[:-1]) | (line[1:] != line[:-1]) | (begin[1:] != end[:-1] + 1)
    ends = np.append(starts[1:], True)[: len(o)]
    return o[starts], line[starts], begin[starts], end[ends]


def _fold_heights(edges: dict[str, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Give the edges of objects that are all upright and level the numbers of their bands for y.

    Between two vertex lines every line of such an object is the same: vertex line i becomes line
    2 i, and all between it and the next one line 2 i + 1.  Returns which objects are folded, where
    each object's vertex lines begin, and the vertex lines.
    """
    obj, y = edges["obj"], edges["y1"]
    slanted = np.bincount(obj[(edges["x1"] != edges["x2"]) & (edges["y1"] != edges["y2"])], minlength=rows) > 0
    order = np.lexsort((y, obj))
    new = np.r_[True, (obj[order][1:] != obj[order][:-1]) | (y[order][1:] != y[order][:-1])][: len(obj)]
    lines, owner = y[order][new], obj[order][new]
    start = np.searchsorted(owner, np.arange(rows))
    rank = np.empty(len(obj), np.int64)
    rank[order] = np.cumsum(new) - 1 - start[obj[order]]
    following = np.arange(len(obj)) + 1  # the end of an edge is the begin of the next one of its ring
    ring = edges["ring"]
    last = np.r_[ring[1:] != ring[:-1], True][: len(ring)]
    opens = np.maximum.accumulate(np.where(np.r_[True, last[:-1]][: len(ring)], np.arange(len(ring)), 0))
    following = np.where(last, opens, following)
    folded = ~slanted
    edges["y1"] = np.where(folded[obj], 2 * rank, edges["y1"])
    edges["y2"] = np.where(folded[obj], 2 * rank[following], edges["y2"])
    return folded, start, lines


def _unfold(obj: np.ndarray, y: np.ndarray, folded: np.ndarray, start: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last real line of each line of :func:`_fold_heights`; empty bands end before they begin."""
    mine, band = folded[obj], y % 2 == 1
    at = np.where(mine, start[obj] + y // 2, 0)
    after = np.minimum(at + 1, len(lines) - 1)
    low, high = np.where(band, lines[at] + 1, lines[at]), np.where(band, lines[after] - 1, lines[at])
    return np.where(mine, low, y), np.where(mine, high, y)


def runs_of(row: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y_to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spans folded to upright runs: equal ends on neighbouring lines of an object.  The object of each run, and [y from, y to, x0, x1]."""
    y_to = y if y_to is None else y_to
    order = np.lexsort((y, x1, _joined(row, x0)))
    row, y, y_to, x0, x1 = row[order], y[order], y_to[order], x0[order], x1[order]
    opens = np.r_[True, (row[1:] != row[:-1]) | (x0[1:] != x0[:-1]) | (x1[1:] != x1[:-1]) | (y[1:] != y_to[:-1] + 1)][: len(row)]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], len(row)][: len(first)] - 1
    return row[first], np.column_stack([y[first], y_to[last], x0[first], x1[first]])


def run_lists(row: np.ndarray, runs: np.ndarray, rows: int) -> pa.ListArray:
    """Runs sorted by object as one flat list for each of ``rows`` objects."""
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=rows))] * 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(runs.ravel(), pa.int64()))


def batch_masks(batch: pa.RecordBatch, ids: list[str], segmentation: str):
    """Objects of a batch with area, box and the list of their runs, in slices of bounded size."""
    edges = edges_of(batch.column(segmentation))
    bands = _fold_heights(edges, batch.num_rows)
    load = np.zeros(batch.num_rows, dtype=np.int64)
    np.add.at(load, edges["obj"], np.abs(edges["y2"] - edges["y1"]) + 1)
    slot = np.cumsum(load) // ROWS_AT_ONCE
    for part in np.unique(slot[load > 0]):
        mine = slot[edges["obj"]] == part
        obj, y, x0, x1 = _outer_minus_holes(*_closed_runs({k: v[mine] for k, v in edges.items()}))
        y, y_to = _unfold(obj, y, *bands)
        real = y <= y_to
        if not real.any():
            continue
        row, runs = runs_of(obj[real], y[real], x0[real], x1[real], y_to[real])
        first = _first_of(row)
        number = np.cumsum(np.r_[0, row[1:] != row[:-1]])
        top, bottom, left, right = runs.T
        sums = [np.add.reduceat((bottom - top + 1) * (right - left + 1), first), np.minimum.reduceat(left, first), np.minimum.reduceat(top, first),
                np.maximum.reduceat(right, first), np.maximum.reduceat(bottom, first)]
        rows = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ids], *map(pa.array, sums), run_lists(number, runs, len(first))],
                                         names=[*ids, "area", "x0", "y0", "x1", "y1", "runs"])


def fold_lines(lines: pa.ListArray) -> pa.ListArray:
    """Lists of lines (y, x0, x1) as lists of runs."""
    flat = lines.flatten()
    y, x0, x1 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    row = np.repeat(np.arange(len(lines)), np.asarray(pc.list_value_length(lines)))
    return run_lists(*runs_of(row, y, x0, x1), len(lines))


def expand_runs(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Row, y, x0, x1 of every line of lists of runs."""
    runs = np.asarray(lists.flatten()).reshape(-1, 4)
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)) // 4)
    height = runs[:, 1] - runs[:, 0] + 1
    step = np.arange(height.sum()) - np.repeat(np.cumsum(height) - height, height)
    return np.repeat(row, height), np.repeat(runs[:, 0], height) + step, np.repeat(runs[:, 2], height), np.repeat(runs[:, 3], height)


def batch_differences(outer: pa.ListArray, holes: pa.ListArray) -> pa.ListArray:
    """Runs of each mask without those of its holes."""
    o, h = expand_runs(outer), expand_runs(holes)
    both = [np.concatenate([a, b]) for a, b in zip(o, h)]
    cut = _outer_minus_holes(both[0], np.repeat([False, True], [len(o[0]), len(h[0])]), *both[1:])
    return run_lists(*runs_of(*cut), len(outer))


def _meetings(left: pa.ListArray, right: pa.ListArray, block: int):
    """Every run of a left mask with every run of its right one, in blocks: number of the pair (ascending) and both runs."""
    a, b = (np.asarray(lists.flatten()).reshape(-1, 4) for lists in (left, right))
    na, nb = (np.asarray(pc.list_value_length(lists)).astype(np.int64) // 4 for lists in (left, right))
    pair, start = np.repeat(np.arange(len(na)), na), np.cumsum(nb) - nb
    load = nb[pair]
    slot = (np.cumsum(load) - load) // block
    cuts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, len(pair)]
    for s, e in zip(cuts[:-1], cuts[1:]):
        i = np.repeat(np.arange(s, e), load[s:e])
        if len(i):
            place = np.arange(len(i)) - np.repeat(np.cumsum(load[s:e]) - load[s:e], load[s:e])
            yield pair[i], a[i], b[start[pair[i]] + place]


def _first_of(pair: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common box of two runs, empty where its ends are the wrong way round."""
    return np.column_stack([np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 2], b[:, 2]), np.minimum(a[:, 3], b[:, 3])])


def run_overlaps(left: pa.ListArray, right: pa.ListArray, block: int = 2_000_000) -> np.ndarray:
    """Common pixels of each pair of masks, given as lists of runs."""
    out = np.zeros(len(left), np.int64)
    for pair, a, b in _meetings(left, right, block):
        c, first = _common(a, b), _first_of(pair)
        out[pair[first]] += np.add.reduceat(np.maximum(c[:, 1] - c[:, 0] + 1, 0) * np.maximum(c[:, 3] - c[:, 2] + 1, 0), first)
    return out


def run_commons(left: pa.ListArray, right: pa.ListArray, block: int = 2_000_000) -> pa.ListArray:
    """The common part of each pair of masks, as lists of runs."""
    pairs, parts = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
    for pair, a, b in _meetings(left, right, block):
        c = _common(a, b)
        some = (c[:, 0] <= c[:, 1]) & (c[:, 2] <= c[:, 3])
        pairs.append(pair[some])
        parts.append(c[some])
    return run_lists(np.concatenate(pairs), np.concatenate(parts), len(left))


def run_gaps(left: pa.ListArray, right: pa.ListArray, block: int = 2_000_000) -> np.ndarray:
    """Least distance of each pair of masks, given as lists of runs; NaN where a mask is empty."""
    out = np.full(len(left), np.nan)
    for pair, a, b in _meetings(left, right, block):
        dy = np.maximum(0, np.maximum(b[:, 0] - a[:, 1], a[:, 0] - b[:, 1]))
        dx = np.maximum(0, np.maximum(b[:, 2] - a[:, 3], a[:, 2] - b[:, 3]))
        first = _first_of(pair)
        out[pair[first]] = np.fmin(out[pair[first]], np.sqrt(np.minimum.reduceat(dx * dx + dy * dy, first)))
    return out
