"""Rectangles and links of many small groups at once: a row of an Arrow batch is a group, lists hold its members."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEETINGS_AT_ONCE = 1_000_000  # meetings of members held in memory together, unless one group alone has more


def sizes(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(pc.list_value_length(lists)).astype(np.int64)


def members(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each member, and the fields of all members."""
    flat = lists.flatten()
    return np.asarray(pc.list_parent_indices(lists)).astype(np.int64), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def numbers(packed: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row of packed bytes holds, and all of them."""
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    n = np.diff(ends) // 8
    return n, np.frombuffer(packed.buffers()[2], kind, n.sum(), ends[0])


def by_load(batches: Iterator[pa.RecordBatch], load: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded load."""
    for batch in batches:
        slot = np.cumsum(load(batch)) // MEETINGS_AT_ONCE
        cuts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def meetings(n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every left member with every right member of its row, as member numbers."""
    right_of = np.repeat(n_right, n_left)
    i = np.repeat(np.arange(n_left.sum()), right_of)
    start = np.repeat(np.cumsum(n_right) - n_right, n_left)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(right_of) - right_of, right_of) + start[i]


def ranked(*arrays: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of all arrays in order, and each array as ranks in them."""
    values, ranks = np.unique(np.concatenate(arrays), return_inverse=True)
    return values, np.split(ranks.ravel(), np.cumsum([len(a) for a in arrays])[:-1])


def merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each group as disjoint ones, touching ones joined; ends are ranks, lo < hi."""
    if not len(group):
        return group, lo, hi
    width = int(hi.max()) + 1
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    reach = np.maximum.accumulate(group * width + hi)
    opens = np.flatnonzero(np.r_[True, group[1:] * width + lo[1:] > reach[:-1]])
    return group[opens], lo[opens], (reach - group * width)[np.r_[opens[1:], len(group)] - 1]


def covered_by_both(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces between neighbouring ends of a group's intervals: group, lo, hi, and whether the first and the second kind cover them."""
    group, at = np.tile(group, 2), np.concatenate([lo, hi])
    order = np.lexsort((at, group))
    group, at = group[order], at[order]
    kinds = [np.cumsum(np.concatenate([k.astype(np.int64), -k.astype(np.int64)])[order])[:-1] > 0 for k in (first, second)]
    real = np.flatnonzero((group[1:] == group[:-1]) & (at[1:] > at[:-1]))
    return group[real], at[real], at[real + 1], kinds[0][real], kinds[1][real]


def union_strips(row: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray):
    """Cuts (row, x rank) of all rows, and the covered intervals of each strip (number of the cut it begins at, y ranks); values of x and y."""
    xs, (a, b) = ranked(x0, x1)
    ys, (lo, hi) = ranked(y0, y1)
    cuts, (first, last) = ranked(row * len(xs) + a, row * len(xs) + b)
    wide = last - first
    strip = np.repeat(first, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    return (cuts // len(xs), cuts % len(xs)), merged(strip, np.repeat(lo, wide), np.repeat(hi, wide)), xs, ys


def union_areas(row: np.ndarray, box: Sequence[np.ndarray], rows: int) -> np.ndarray:
    """Area of the union of the rectangles of each row."""
    (owner, x), (strip, lo, hi), xs, ys = union_strips(row, *box)
    out = np.zeros(rows, np.result_type(xs, ys))
    if len(strip):
        np.add.at(out, owner[strip], (xs[x[strip + 1]] - xs[x[strip]]) * (ys[hi] - ys[lo]))
    return out


def union_edges(row: np.ndarray, box: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Outline of the union of the rectangles of each row: row, upright, at, lo, hi."""
    (owner, x), (strip, lo, hi), xs, ys = union_strips(row, *box)
    # Level: the ends of the covered intervals, joined along neighbouring strips.
    line = np.concatenate([lo * 2, hi * 2 + 1])
    strips = np.tile(strip, 2)
    group, left, right = merged(owner[strips] * 2 * len(ys) + line, strips, strips + 1)
    level = group // (2 * len(ys)), np.zeros(len(group), bool), ys[group % (2 * len(ys)) // 2], xs[x[left]], xs[x[right]]
    # Upright: what one side of a cut covers and the other does not.
    near = np.repeat([True, False], len(strip))
    cut, low, high, a, b = covered_by_both(np.concatenate([strip + 1, strip]), np.tile(lo, 2), np.tile(hi, 2), near, ~near)
    one = a != b
    upright = owner[cut[one]], np.ones(one.sum(), bool), xs[x[cut[one]]], ys[low[one]], ys[high[one]]
    return tuple(np.concatenate(p) for p in zip(level, upright))


def two_sided(line: tuple[np.ndarray, ...], span: tuple[np.ndarray, ...], near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of each line that one cluster covers on both sides: line, lo, hi from (line, cluster) and (lo, hi) of each meeting."""
    values, (lo, hi) = ranked(*span)
    clusters = int(line[1].max()) + 1 if len(line[1]) else 1
    group, low, high, a, b = covered_by_both(line[0] * clusters + line[1], lo, hi, near, far)
    both = a & b
    owner, low, high = merged(group[both] // clusters, low[both], high[both])
    return owner, values[low], values[high]


def smallest_reachable(row: np.ndarray, u: np.ndarray, v: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and smallest reachable id of each node (``node`` marks them, as u); the others are links u - v between nodes."""
    names, (u, v) = ranked(u, v)
    places = np.unique(row[node] * len(names) + u[node])
    link = ~node
    ends = [row[link] * len(names) + e[link] for e in (u, v)]
    at = [np.minimum(np.searchsorted(places, e), max(len(places) - 1, 0)) for e in ends]
    known = np.logical_and(*[places[i] == e for i, e in zip(at, ends)]) if len(places) else np.zeros(0, bool)
    a, b = (i[known] for i in at) if len(places) else (np.zeros(0, np.int64),) * 2
    label, before = np.arange(len(places)), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
    return places // max(len(names), 1), names[places % max(len(names), 1)], names[places[label] % max(len(names), 1)]


def shared_sides(row: np.ndarray, ident: np.ndarray, box: Sequence[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row and ids (smaller first) of the rectangles of a row that share part of an edge."""
    i, j = meetings(n, n)
    x0, y0, x1, y1 = box
    along_y = (x1[i] == x0[j]) & (np.maximum(y0[i], y0[j]) < np.minimum(y1[i], y1[j]))
    along_x = (y1[i] == y0[j]) & (np.maximum(x0[i], x0[j]) < np.minimum(x1[i], x1[j]))
    names, (rank,) = ranked(ident)
    touch = (along_y | along_x) & (rank[i] != rank[j])
    i, j = i[touch], j[touch]
    pairs = np.unique(np.column_stack([row[i], np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j])]), axis=0)
    return pairs[:, 0], names[pairs[:, 1]], names[pairs[:, 2]]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Places of the rows that differ from the row before in one of the keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def overlaps(a: Sequence[np.ndarray], b: Sequence[np.ndarray], n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Members of a row whose pixel boxes overlap, and their IoU."""
    i, j = meetings(n_a, n_b)
    w = np.minimum(a[2][i], b[2][j]) - np.maximum(a[0][i], b[0][j]) + 1
    h = np.minimum(a[3][i], b[3][j]) - np.maximum(a[1][i], b[1][j]) + 1
    met = (w >= 1) & (h >= 1)
    i, j, inter = i[met], j[met], (w * h)[met]
    area = lambda box, k: (box[2][k] - box[0][k] + 1) * (box[3][k] - box[1][k] + 1)
    return i, j, inter.astype(np.float64) / np.maximum(area(a, i) + area(b, j) - inter, 1)


def grid_counts(gt: dict[str, np.ndarray], preds: dict[str, np.ndarray], pairs: tuple[np.ndarray, ...], n_s: int, n_m: int, iou_t: float,
                count_unmatched: bool) -> dict[str, np.ndarray]:
    """What whole images add to each (score, match) cut-off of a grid; members: row, id, and ref_match or si, mi (cut-offs passed)."""
    g, q, iou = pairs
    rows = int(max([0, *(d["row"].max() + 1 for d in (gt, preds) if len(d["row"]))]))
    wanted = np.bincount(gt["row"], gt["ref_match"], rows)
    # The label of a prediction: its best ground truth, or the first of the image.
    order = np.lexsort((gt["id"][g], -iou, q))
    best = order[_firsts(q[order])]
    by_id = np.lexsort((gt["id"], gt["row"]))
    first = by_id[_firsts(gt["row"][by_id])]
    label = np.full(rows, -1)
    label[gt["row"][first]] = first
    label = label[preds["row"]]
    label[q[best]] = g[best]
    known = label >= 0
    right = np.zeros(len(label))
    right[known] = gt["ref_match"][label[known]]
    counted = known & (count_unmatched | (wanted[preds["row"]] > 0))
    # Best first for each ground truth.
    good = np.flatnonzero(iou >= iou_t)
    order = good[np.lexsort((preds["id"][q[good]], -iou[good], g[good]))]
    g, q, iou = g[order], q[order], iou[order]
    out = {name: np.zeros(n_s * n_m) for name in ("tp", "iou_sum", "kept", "match_total", "match_ok", "found")}
    for s in range(n_s):
        scored = preds["si"] > s
        cover = scored[q]
        covered = len(_firsts(g[cover]))
        for m in range(n_m):
            passed, at = scored & (preds["mi"] > m), s * n_m + m
            use = np.flatnonzero(passed[q] & (gt["ref_match"][g] == 1))
            best = use[_firsts(g[use])]
            claims = best[np.lexsort((gt["id"][g[best]], q[best]))]
            claims = claims[_firsts(q[claims])]
            for name, value in (("tp", len(claims)), ("iou_sum", iou[claims].sum()), ("kept", (passed & known).sum()),
                                ("match_total", (passed & counted).sum()), ("match_ok", right[passed].sum()), ("found", covered)):
                out[name][at] = value
    return out


def codes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct tuple, in the order of the tuples, and the number of each member's tuple."""
    order = np.lexsort(keys[::-1])
    first = _firsts(*[k[order] for k in keys])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    return order[first], number


def joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the left and right members with equal numbers, by left place."""
    order = np.argsort(right, kind="stable")
    low = np.searchsorted(right[order], left)
    n = np.searchsorted(right[order], left, side="right") - low
    i, place = listed(low, n)
    return i, order[place]


def point_costs(q: Sequence[np.ndarray], g: Sequence[np.ndarray], scores: Sequence[np.ndarray], weights: tuple[float, float, float],
                at_once: int = MEETINGS_AT_ONCE) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, query, ground truth and cost of every pair of a row, rows ascending.

    ``q`` and ``g``: row, id, point and value of the points; ``scores``: row, id
    and score of the queries.  Rows are taken together up to ``at_once`` meetings.
    """
    q, g, scores = ([c[order] for c in side] for side in (q, g, scores) for order in [np.lexsort((side[1], side[0]))])
    rows = int(max([-1, *(side[0][-1] for side in (q, g, scores) if len(side[0]))])) + 1
    load = np.bincount(q[0], minlength=rows) * np.bincount(g[0], minlength=rows)
    slot = (np.cumsum(load) - load) // at_once
    cuts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        mine = [[c[slice(*np.searchsorted(side[0], [start, end]))] for c in side] for side in (q, g, scores)]
        if all(len(side[0]) for side in mine):
            yield _point_costs(*[[side[0] - start, *side[1:]] for side in mine], int(end - start), start, weights)


def _point_costs(q, g, scores, rows: int, start: int, weights: tuple[float, float, float]) -> tuple[np.ndarray, ...]:
    (q_row, q_id, q_point, x), (g_row, g_id, g_point, value), (s_row, s_id, score) = q, g, scores
    q_first, q_no = codes(q_row, q_id)
    g_first, g_no = codes(g_row, g_id)
    n_q, n_g = len(q_first), len(g_first)
    with np.errstate(over="ignore"):
        sure = 1.0 / (1.0 + np.exp(-x))
        soft = np.bincount(q_no, np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x))), n_q)
    points, p_sum, g_sum = np.bincount(q_no, minlength=n_q), np.bincount(q_no, sure, n_q), np.bincount(g_no, value, n_g)
    # Pair k of a query is the k-th ground truth of its row.
    g_of_row = np.bincount(g_row[g_first], minlength=rows)
    g_start = np.cumsum(g_of_row) - g_of_row
    width = g_of_row[q_row[q_first]]
    at = np.cumsum(width) - width
    # Points meet on (row, point).
    names, (q_rank, g_rank) = ranked(q_point, g_point)
    some = value > 0
    no, value = g_no[some], value[some]
    i, j = joined(q_row * len(names) + q_rank, (g_row * len(names) + g_rank)[some])
    pair = at[q_no[i]] + no[j] - g_start[q_row[i]]
    xg, pg = (np.bincount(pair, v[i] * value[j], width.sum()) for v in (x, sure))
    # The rows of the result: every score with every ground truth of its row.
    both = codes(np.r_[q_row[q_first], s_row], np.r_[q_id[q_first], s_id])[1]
    query = np.full(int(both.max()) + 1, -1)
    query[both[:n_q]] = np.arange(n_q)
    query = query[both[n_q:]]
    known = np.flatnonzero(query >= 0)
    query = query[known]
    i = np.repeat(np.arange(len(query)), width[query])
    k = np.arange(len(i)) - np.repeat(np.cumsum(width[query]) - width[query], width[query])
    a, pair = query[i], at[query[i]] + k
    b = g_start[s_row[known][i]] + k
    w_class, w_bce, w_dice = weights
    bce = (soft[a] - xg[pair]) / points[a]
    dice = 1.0 - (2.0 * pg[pair] + 1.0) / (p_sum[a] + g_sum[b] + 1.0)
    return start + s_row[known][i], s_id[known][i], g_id[g_first][b], score[known][i] * -w_class + bce * w_bce + dice * w_dice


def greedy_pairs(row: np.ndarray, q: np.ndarray, g: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Places of the pairs that stay when the cheapest pair of a row (ties by q, then g) is fixed and both of its sides leave, until none is left."""
    alive = np.lexsort((g, q, cost, row))
    sides = [codes(row, q)[1], codes(row, g)[1]]
    used = [np.zeros(int(s.max()) + 1 if len(s) else 0, bool) for s in sides]
    chosen = [alive[:0]]
    while len(alive):
        place, take = np.arange(len(alive)), np.ones(len(alive), bool)
        for side, gone in zip(sides, used):
            first = np.empty(len(gone), np.int64)
            first[side[alive][::-1]] = place[::-1]  # the last to write is the cheapest
            take &= first[side[alive]] == place
        chosen.append(alive[take])
        for side, gone in zip(sides, used):
            gone[side[alive[take]]] = True
        alive = alive[~(used[0][sides[0][alive]] | used[1][sides[1][alive]])]
    return np.concatenate(chosen)


class Lines:
    """Pixels in the order of row, y and x, and what lies on a stretch of a line."""

    def __init__(self, row: np.ndarray, y: np.ndarray, x: np.ndarray):
        self.ys, self.xs = np.unique(y), np.unique(x)
        key = self._key(row, np.searchsorted(self.ys, y), np.searchsorted(self.xs, x))
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def _key(self, row: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (row * (len(self.ys) + 1) + y) * (len(self.xs) + 1) + x

    def between(self, row: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in ``order`` and number of the pixels of line y with x0 <= x <= x1."""
        line = np.searchsorted(self.ys, y)
        there = (line < len(self.ys)) & (x0 <= x1)
        there[there] = self.ys[line[there]] == y[there]
        ends = [np.searchsorted(self.key, self._key(row, line, np.searchsorted(self.xs, x, side))) for x, side in ((x0, "left"), (x1, "right"))]
        return ends[0], np.where(there, ends[1] - ends[0], 0)


def listed(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number start, start + 1, ... of n, with the place of its start."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - start, n)


def cut_boxes(pixels: Sequence[np.ndarray], boxes: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Row, box, y, x and values of the pixels inside each box, relative to its corner; pixels: row, y, x, values; boxes: row, id, x, y, w, h."""
    row, y, x, *values = pixels
    lines = Lines(row, y, x)
    owner, ident, left, top, w, h = boxes
    first = np.searchsorted(lines.ys, top)
    n = np.maximum(np.searchsorted(lines.ys, top + h) - first, 0)
    slot = (np.cumsum(n) - n) // MEETINGS_AT_ONCE
    cuts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, len(n)]
    found = [[np.zeros(0, np.int64)] * 2]
    for start, end in zip(cuts[:-1], cuts[1:]):
        box, line = listed(first[start:end], n[start:end])
        box += start
        begin, length = lines.between(owner[box], lines.ys[line], left[box], left[box] + w[box] - 1)
        at, place = listed(begin, length)
        found.append([box[at], lines.order[place]])
    box, pixel = (np.concatenate(c) for c in zip(*found))
    return [owner[box], ident[box], y[pixel] - top[box], x[pixel] - left[box], *(v[pixel] for v in values)]


def ink_of_spans(dark: Sequence[np.ndarray], spans: Sequence[np.ndarray], headers: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Row, mask, area and share of dark pixels of each mask; dark: row, y, x; spans: row, mask, y, x0, x1; headers: row, width, height."""
    i, j = joined(spans[0], headers[0])
    row, mask, y, x0, x1 = (c[i] for c in spans)
    x0, x1 = np.maximum(x0, 0), np.minimum(x1, headers[1][j] - 1)
    inside = (y >= 0) & (y < headers[2][j]) & (x0 <= x1)
    row, mask, y, x0, x1 = (c[inside] for c in (row, mask, y, x0, x1))
    first, number = codes(row, mask)
    area = np.bincount(number, x1 - x0 + 1, len(first)).astype(np.int64)
    ink = np.bincount(number, Lines(*dark).between(row, y, x0, x1)[1], len(first))
    return [row[first], mask[first], area, ink / area]


def sampled(raster: Sequence[np.ndarray], points: Sequence[np.ndarray], headers: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Row, point and bilinear value; raster: row, y, x, value; points: row, id, u, v; headers: row, width, height."""
    i, j = joined(points[0], headers[0])
    row, ident, u, v = (c[i] for c in points)
    right, bottom = headers[1][j] - 1, headers[2][j] - 1
    fx, fy = (np.fmin(np.maximum(c * (last + 1) - 0.5, 0.0), last) for c, last in ((u, right), (v, bottom)))  # not a number: the last
    x, y = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    wx, wy = fx - x, fy - y
    first, number = codes(row, ident)
    lines = Lines(*raster[:3])
    value, met = np.zeros(len(first)), np.zeros(len(first), bool)
    for cx, cy, w in ((x, y, (1 - wx) * (1 - wy)), (np.minimum(x + 1, right), y, wx * (1 - wy)), (x, np.minimum(y + 1, bottom), (1 - wx) * wy),
                      (np.minimum(x + 1, right), np.minimum(y + 1, bottom), wx * wy)):
        at, place = listed(*lines.between(row, cy, cx, cx))
        value += np.bincount(number[at], w[at] * raster[3][lines.order[place]], len(first))
        met[number[at]] = True
    return [row[first][met], ident[first][met], value[met]]
