"""Connected parts of masks, their outer boundaries and chords.

Masks are cut into strips of columns, whose parts are found inside tasks; parts of neighbouring strips that touch are united by
rounds of joins, so a mask of any size is worked on in many places. Boundaries and chords take whole parts and masks, which
fit one image: Spark deals them to tasks and sorts them there. Inside a task numpy works on all groups of an Arrow batch at once. Neighbouring runs are found by bisection of one sorted key of mask, column and row.
Chords are counted on runs too: a ray is cut into one stretch per column or row, whichever are fewer, and a stretch meets the
runs of its line. Memory follows runs and rays, not the area of boxes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .masks import MASK
from .sweeps import mask_batches, numbered, spread, whole_groups

#: Columns and rows of a key lie below 2**21 and are moved up a little, as padded boxes begin at -1.
BITS, PAD = 21, 4

#: Stretches of rays that are looked up at once, lines of masks' boxes that are listed at once, and runs of a line that are met one by one.
STRETCHES, LINES, FEW = 1 << 20, 1 << 19, 4

#: Columns of a strip of a mask, and most bytes of names that are sent round.
STRIP, BROADCAST_BYTES = 256, 32 << 20


def place(group: np.ndarray, col: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number that sorts by group, column and row."""
    return (group.astype(np.int64) << (2 * BITS)) | ((col.astype(np.int64) + PAD) << BITS) | (row.astype(np.int64) + PAD)


def node_of(col: np.ndarray, r0: np.ndarray) -> np.ndarray:
    return ((col.astype(np.int64) + PAD) << BITS) | (r0.astype(np.int64) + PAD)


def overlapping(group, col, r0, r1, at_group, at_col, a0, a1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, run) where a run of the query's group and column meets the rows a0 to a1; runs are sorted and disjoint in a column."""
    first = np.searchsorted(place(group, col, r1 - 1), place(at_group, at_col, a0), "left")
    last = np.searchsorted(place(group, col, r0), place(at_group, at_col, a1 - 1), "right")
    return spread(first, last)


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each node's component. u, v: edges.

    Between rounds every label is the root of its tree. Of all roots that a root's edges lead to it takes the least; edges to the others
    still lead apart then, and are taken in the next round.
    """
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]


def touching(group, col, r0, r1, corners: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring columns that touch, by corners too or by sides only."""
    by = 1 if corners else 0
    return overlapping(group, col, r0, r1, group, col + 1, r0 - by, r1 + by)


def per_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply work to tables of whole groups, sorted by keys and order."""

    def run(batches):
        for table in whole_groups(batches, keys):
            yield from work(table).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns and rows as numbers that fit a key."""
    out = [table.column(c).to_numpy() for c in names]
    for c, x in zip(names, out, strict=True):
        if len(x) and (x.min() <= -PAD or x.max() >= (1 << BITS) - 2 * PAD):
            raise ValueError(f"{c} from {x.min()} to {x.max()}: masks have less than {(1 << BITS) - 2 * PAD} columns and rows")
    return out


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def united(links: DataFrame, keys: list[str], most_rounds: int = 40) -> DataFrame:
    """keys, u, root: the least node of the component of each node that is not the least itself. links: keys, u, v (long).

    Rounds of two steps: larger neighbours are linked to the least of a node and its neighbours, then smaller ones and the node are. Each round is
    written out. It ends when each node has one edge at most, to a node without any.
    """
    edges = staged(links.filter("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    least = lambda e: e.withColumn("m", F.min("v").over(Window.partitionBy(*keys, "u")))
    for _ in range(most_rounds):
        ends = edges.select(*keys, F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
        out, through = ends.groupBy(*keys, "x").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).agg(F.max("o"), F.max(F.least("o", "i"))).first()
        if (out or 0) <= 1 and not through:
            return edges.withColumnRenamed("v", "root")
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(*keys, F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = least(large).select(*keys, F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        edges = staged(small.filter("u <> v").distinct(), "stars")
    raise RuntimeError(f"no stars after {most_rounds} rounds")


def border_links(local: DataFrame, keys: list[str], corners: bool, strip: int) -> DataFrame:
    """keys, u, v: parts of two strips that touch across their border. local: keys, col, r0, r1, component."""
    side = lambda at, to, of: local.filter(F.col("col") % strip == at).select(*keys, F.call_function("div", F.col("col") + to, F.lit(strip)).cast("int").alias("border"), F.lit(of).alias("side"), "r0", "r1", "component")
    by = 1 if corners else 0

    def work(table: pa.Table) -> pa.Table:
        group = numbered(table, [*keys, "border"])
        right, (r0, r1) = table.column("side").to_numpy() == 1, _columns(table, "r0", "r1")
        part, flat = table.column("component").to_numpy(), np.zeros(len(group), np.int64)
        l, r = np.flatnonzero(~right), np.flatnonzero(right)
        q, k = overlapping(group[r], flat[r], r0[r], r1[r], group[l], flat[l], r0[l] - by, r1[l] + by)
        pair = np.unique(np.stack([l[q], part[l[q]], part[r[k]]]), axis=1) if len(q) else np.zeros((3, 0), np.int64)
        return pa.table({**{c: table.column(c).take(pa.array(pair[0])) for c in keys}, "u": pa.array(pair[1]), "v": pa.array(pair[2])})

    return per_group(side(strip - 1, 1, 0).unionByName(side(0, 0, 1)), [*keys, "border"], ["side", "r0"], work, f"{_schema(local, keys)}, u long, v long")


def mask_components(runs: DataFrame, keys: list[str] = MASK, corners: bool = True, strip: int = STRIP) -> DataFrame:
    """Each run with its component, named by its least node. Runs of a mask and column are disjoint.

    A task has a strip of a mask at most. strip: columns of one.
    """
    whole = [*keys, "strip"]

    def work(table: pa.Table) -> pa.Table:
        group = numbered(table, whole)
        col, r0, r1 = _columns(table, "col", "r0", "r1")
        label = labels(len(col), *touching(group, col, r0, r1, corners))
        return table.select([*keys, "col", "r0", "r1"]).append_column("component", pa.array(node_of(col, r0)[label]))

    cut = runs.select(*keys, "col", "r0", "r1", F.call_function("div", F.col("col"), F.lit(strip)).cast("int").alias("strip"))
    local = staged(per_group(cut, whole, ["col", "r0"], work, f"{_schema(runs, keys)}, col int, r0 int, r1 int, component long"), "parts")
    roots = united(border_links(local, keys, corners, strip), keys)
    n = roots.count()
    if not n:
        return local
    named = roots.withColumnRenamed("u", "component").hint("broadcast" if n * 64 <= BROADCAST_BYTES else "merge")
    return local.join(named, [*keys, "component"], "left").select(*keys, "col", "r0", "r1", F.coalesce("root", "component").alias("component"))


def background(group, col, r0, r1, frame: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
    """Gaps (group, col, r0, r1) between the runs of each column of each group's box, padded by one on all sides.

    frame: first and last column and row of each group, where they are not those of the padded box.
    """
    n = int(group[-1]) + 1
    if frame is None:
        low, high = np.full((2, n), np.iinfo(np.int64).max), np.full((2, n), np.iinfo(np.int64).min)
        for k, (a, b) in enumerate(((col, col), (r0, r1))):
            np.minimum.at(low[k], group, a)
            np.maximum.at(high[k], group, b)
        frame = low[0] - 1, high[0] + 1, low[1] - 1, high[1]
    left, right, top, bottom = frame
    g, c = spread(left, right + 1)
    lo, hi = top[g], bottom[g] + 1
    starts = np.sort(np.concatenate([place(g, c, lo), place(group, col, r1)]))
    stops = np.sort(np.concatenate([place(g, c, hi), place(group, col, r0)]))
    row = (1 << BITS) - 1
    out = starts >> (2 * BITS), ((starts >> BITS) & row) - PAD, (starts & row) - PAD, (stops & row) - PAD
    some = out[2] < out[3]
    return tuple(x[some] for x in out)


def merged(group, col, r0, r1) -> tuple[np.ndarray, ...]:
    """Union of the intervals of each group and column; touching ones become one."""
    start, end = place(group, col, r0), place(group, col, r1)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    # Ends grow with groups and columns, so the running maximum crosses no column.
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    s, e = start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else end[:0]
    row = (1 << BITS) - 1
    return s >> (2 * BITS), ((s >> BITS) & row) - PAD, (s & row) - PAD, (e & row) - PAD


def beside(runs: tuple[np.ndarray, ...], gaps: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Runs of the pixels that have a gap's pixel beside them, by corners too."""
    group, col, r0, r1 = runs
    g, c, a, b = gaps
    found = []
    for step in (-1, 0, 1):
        q, k = overlapping(group, col, r0, r1, g, c + step, a - 1, b + 1)
        found.append((group[k], col[k], np.maximum(r0[k], a[q] - 1), np.minimum(r1[k], b[q] + 1)))
    return merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def boundary_of(group, col, r0, r1) -> tuple[np.ndarray, ...]:
    """Runs of the pixels of each group that are 8-adjacent to background which reaches the border of its padded box by sides."""
    g, c, a, b = background(group, col, r0, r1)
    label = labels(len(g), *touching(g, c, a, b, False))
    # The padded ring is one region, and a group's first gap is in it.
    first = np.searchsorted(g, np.arange(int(g[-1]) + 1))
    outer = label == label[first[g]]
    return beside((group, col, r0, r1), tuple(x[outer] for x in (g, c, a, b)))


def _with_keys(table: pa.Table, keys: list[str], at: np.ndarray, **made) -> pa.Table:
    """Rows with the keys of the table's rows `at`."""
    of = pa.array(at)
    return pa.table({**{k: table.column(k).take(of) for k in keys}, **{k: pa.array(x) for k, x in made.items()}})


def external_boundary(parts: DataFrame, strip: int = STRIP) -> DataFrame:
    """Runs of each component's outer boundary. parts: the mask keys, component, col, r0, r1 (what mask_components returns).

    A component within one strip of columns is one task's work. Of a wider one, each strip is: the background in it is labelled there,
    labels that touch across strips are united, and what reaches the padded ring is the outside that the strips' pixels are held against.
    """
    keys = [*MASK, "component"]
    kinds = f"{_schema(parts, MASK)}, component long"
    rows = parts.select(*keys, "col", "r0", "r1")

    def whole(table: pa.Table) -> pa.Table:
        group = numbered(table, keys)
        g, c, a, b = boundary_of(group, *_columns(table, "col", "r0", "r1"))
        return _with_keys(table, keys, np.searchsorted(group, g), col=c.astype(np.int32), r0=a.astype(np.int32), r1=b.astype(np.int32))

    strip_of = lambda c: F.floor(c / F.lit(strip)).cast("int")
    boxes = rows.groupBy(*keys).agg(F.min("col").alias("x0"), F.max("col").alias("x1"), F.min("r0").alias("y0"), F.max("r1").alias("y1"))
    wide = staged(boxes.filter(strip_of(F.col("x0")) != strip_of(F.col("x1"))), "wide-parts")
    if wide.isEmpty():
        return per_group(rows, keys, ["col", "r0"], whole, f"{kinds}, col int, r0 int, r1 int")
    narrow = per_group(rows.join(wide.select(*keys).hint("merge"), keys, "left_anti"), keys, ["col", "r0"], whole, f"{kinds}, col int, r0 int, r1 int")
    cut = rows.join(wide.hint("merge"), keys).withColumn("strip", strip_of(F.col("col")))
    return narrow.unionByName(_wide_boundary(cut, keys, kinds, strip))


def _wide_boundary(cut: DataFrame, keys: list[str], kinds: str, strip: int) -> DataFrame:
    """external_boundary of components over several strips. cut: keys, col, r0, r1, strip, and the box of the component: x0, x1, y0, y1 (end exclusive)."""
    tile, ring = [*keys, "strip"], 0

    def gaps(table: pa.Table) -> pa.Table:
        group = numbered(table, tile)
        col, r0, r1 = (x.astype(np.int64) for x in _columns(table, "col", "r0", "r1"))
        first = np.searchsorted(group, np.arange(int(group[-1]) + 1))
        at, x0, x1, y0, y1 = (table.column(c).to_numpy()[first].astype(np.int64) for c in ("strip", "x0", "x1", "y0", "y1"))
        # The padded columns belong to the strips of the box's edges.
        frame = np.where(x0 // strip == at, x0 - 1, at * strip), np.where(x1 // strip == at, x1 + 1, (at + 1) * strip - 1), y0 - 1, y1
        g, c, a, b = background(group, col, r0, r1, frame)
        label = labels(len(g), *touching(g, c, a, b, False))
        outside = (c < x0[g]) | (c > x1[g]) | (a < y0[g]) | (b > y1[g])
        return _with_keys(table, keys, first[g], col=c.astype(np.int32), r0=a.astype(np.int32), r1=b.astype(np.int32), label=node_of(c, a)[label], ring=outside)

    local = staged(per_group(cut, tile, ["col", "r0"], gaps, f"{kinds}, col int, r0 int, r1 int, label long, ring boolean"), "gaps")
    # For the links a gap's label is the part, and the component one of the keys.
    named = [*MASK, "of"]
    renamed = local.select(*MASK, F.col("component").alias("of"), "col", "r0", "r1", F.col("label").alias("component"), "ring")
    outer = renamed.filter("ring").select(*named, F.col("component").alias("u"), F.lit(ring).cast("long").alias("v")).distinct()
    roots = united(border_links(renamed, named, False, strip).unionByName(outer), named)
    outside = renamed.join(roots.filter(F.col("root") == ring).select(*named, F.col("u").alias("component")).hint("merge"), [*named, "component"], "left_semi")
    # Outside gaps go to the strips of the columns beside theirs, too.
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("col") + d) / F.lit(strip)).cast("int")))
    sent = outside.select(*MASK, F.col("of").alias("component"), F.explode(near).alias("strip"), F.lit(1).alias("gap"), "col", "r0", "r1")
    both = cut.select(*tile, F.lit(0).alias("gap"), "col", "r0", "r1").unionByName(sent)

    def edge(table: pa.Table) -> pa.Table:
        group = numbered(table, tile)
        gap = table.column("gap").to_numpy() == 1
        col, r0, r1 = (table.column(c).to_numpy().astype(np.int64) for c in ("col", "r0", "r1"))
        g, c, a, b = beside(tuple(x[~gap] for x in (group, col, r0, r1)), tuple(x[gap] for x in (group, col, r0, r1)))
        return _with_keys(table, keys, np.searchsorted(group, g), col=c.astype(np.int32), r0=a.astype(np.int32), r1=b.astype(np.int32))

    return per_group(both, tile, ["gap", "col", "r0"], edge, f"{kinds}, col int, r0 int, r1 int")


def part_of(group, col, r0, r1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components (by corners too) of many masks at once: the order of their runs by component, column and row, the dense component of each then, and the group of each component."""
    part = labels(len(col), *touching(group, col, r0, r1, True))
    order = np.lexsort((r0, col, part))
    of, dense = np.unique(part[order], return_inverse=True)
    return order, dense, group[of]


def boundary_pixels(masks: DataFrame) -> DataFrame:
    """Pixels of the outer boundaries of all components of each mask: the mask keys, boundary (long). masks: packed, runs sorted; the masks without runs are left out.

    A mask is one row and is worked on where it is; the runs of wide masks go through mask_components and external_boundary.
    """

    def run(batches):
        for batch, group, col, r0, r1 in mask_batches(batches):
            if len(col):
                order, dense, owner = part_of(group, col, r0, r1)
                g, _, a, b = boundary_of(dense, col[order], r0[order], r1[order])
                n = np.bincount(owner[g], b - a, batch.num_rows).astype(np.int64)
                at = np.unique(group)
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)).take(pa.array(at)) for k in MASK], pa.array(n[at])], names=[*MASK, "boundary"])

    return masks.select(*MASK, "runs").mapInArrow(run, f"{_schema(masks, MASK)}, boundary long")


def ray_ends(px, py, x, y, box) -> tuple[np.ndarray, np.ndarray]:
    """Pixel at which the ray from each boundary pixel through the centroid leaves the box; the pixel itself, if it is the centroid."""
    x0, y0, x1, y1 = box
    vx, vy = x - px, y - py
    with np.errstate(divide="ignore", invalid="ignore"):
        tx = np.where(vx > 0, (x1 - px) / vx, np.where(vx < 0, (x0 - px) / vx, np.inf))
        ty = np.where(vy > 0, (y1 - py) / vy, np.where(vy < 0, (y0 - py) / vy, np.inf))
    t = np.minimum(np.where(tx >= 1, tx, np.inf), np.where(ty >= 1, ty, np.inf))
    t = np.where(np.isfinite(t), t, 1.0)
    end = lambda at, v, lo, hi: np.floor(np.minimum(np.maximum(at + t * v, lo), hi) + 0.5).astype(np.int64)
    still = (vx == 0) & (vy == 0)
    return np.where(still, px, end(px, vx, x0, x1)), np.where(still, py, end(py, vy, y0, y1))


def row_runs(group, col, r0, r1) -> tuple[np.ndarray, ...]:
    """The same pixels as runs along rows: (group, row, c0, c1), sorted. A row's run begins at the pixels of a column that the column before lacks."""

    def starts(to: int) -> np.ndarray:
        """Pixels whose neighbour in the column `to` steps on is missing, by group, row and column."""
        keys = np.concatenate([place(group, col, r0), place(group, col, r1), place(group, col - to, r0), place(group, col - to, r1)])
        change = np.repeat(np.array([1, -1, -2, 2]), len(col))
        order = np.argsort(keys, kind="stable")
        state = np.cumsum(change[order])
        keys = keys[order]
        k = np.flatnonzero((state[:-1] == 1) & (keys[:-1] < keys[1:]))
        g, c, a = keys[k] >> (2 * BITS), ((keys[k] >> BITS) & ((1 << BITS) - 1)) - PAD, (keys[k] & ((1 << BITS) - 1)) - PAD
        i, row = spread(a, a + keys[k + 1] - keys[k])
        return np.sort(place(g[i], row, c[i]))

    first, last = starts(-1), starts(1)
    mask = (1 << BITS) - 1
    return first >> (2 * BITS), ((first >> BITS) & mask) - PAD, (first & mask) - PAD, (last & mask) - PAD + 1


class Lines:
    """Runs (sorted by group, line, start) by the lines of the groups' boxes. low, size: the lines of each box."""

    def __init__(self, low, size, group, line, a, b):
        base = np.concatenate([[0], np.cumsum(size)])
        self.first_line, self.a, self.b = base[:-1] - low, a, b
        of_run = self.first_line[group] + line
        self.count = np.bincount(of_run, minlength=int(base[-1]))
        self.first = np.cumsum(self.count) - self.count
        self.crowded = bool((self.count > FEW).any())
        if self.crowded:
            # Pixels before a place, over all lines one after the other.
            self.start, self.before = (of_run << BITS) + a + PAD, np.cumsum(b - a) - (b - a)

    def upto(self, place_):
        j = np.maximum(np.searchsorted(self.start, place_, "right") - 1, 0)
        return self.before[j] + np.clip(place_ - self.start[j], 0, (self.b - self.a)[j])

    def met(self, line, lo, hi) -> np.ndarray:
        """Pixels of each stretch (numbered line, lo to hi) that lie in runs."""
        left = self.count[line]
        out = np.zeros(len(line), np.int64)
        some = np.flatnonzero((left > 0) & (left <= FEW) if self.crowded else left)
        k, left, l, h = self.first[line[some]], left[some], lo[some], hi[some]
        while len(some):
            out[some] += np.maximum(np.minimum(h, self.b[k]) - np.maximum(l, self.a[k]), 0)
            more = np.flatnonzero(left > 1)
            some, k, left, l, h = some[more], k[more] + 1, left[more] - 1, l[more], h[more]
        if self.crowded:
            many = np.flatnonzero(self.count[line] > FEW)
            at = (line[many] << BITS) + PAD
            out[many] = self.upto(at + hi[many]) - self.upto(at + lo[many])
        return out


def pixels_on_rays(group, col, r0, r1, box, at, px, py, ex, ey) -> np.ndarray:
    """Pixels of mask `at` on the raster line from (px, py) to (ex, ey), half up; lines stay in the mask's box. Runs and rays are sorted by mask."""
    x0, y0, x1, y1 = box
    dx, dy = ex - px, ey - py
    out = np.zeros(len(px), np.int64)
    flat = np.abs(dx) >= np.abs(dy)
    wide, high = np.where(flat, np.abs(dx), np.abs(dy)), np.where(flat, np.abs(dy), np.abs(dx))
    # Masks are taken in slices of a bounded number of box lines, and their rays in slices of a bounded number of stretches.
    slices = np.cumsum(np.maximum(x1 - x0, y1 - y0) + 1) // LINES
    for s in np.unique(slices):
        m0, m1 = np.searchsorted(slices, s), np.searchsorted(slices, s, "right")
        k0, k1 = np.searchsorted(group, m0), np.searchsorted(group, m1)
        g, c, a, b = group[k0:k1] - m0, col[k0:k1], r0[k0:k1], r1[k0:k1]
        here = slice(np.searchsorted(at, m0), np.searchsorted(at, m1))
        for along_rows in (True, False):
            rays = np.flatnonzero(flat[here] == along_rows) + here.start
            if not len(rays):
                continue
            runs = row_runs(g, c, a, b) if along_rows else (g, c, a, b)
            low, size = (y0[m0:m1], y1[m0:m1] - y0[m0:m1] + 1) if along_rows else (x0[m0:m1], x1[m0:m1] - x0[m0:m1] + 1)
            lines = Lines(low, size, *runs)
            # Places along the line's short axis (across, as numbered lines) and its long axis.
            across, long0, sa, sl = (py[rays], px[rays], np.sign(dy[rays]), np.sign(dx[rays])) if along_rows else (px[rays], py[rays], np.sign(dx[rays]), np.sign(dy[rays]))
            across = across + lines.first_line[at[rays] - m0]
            total, steps = wide[rays], high[rays]
            cuts = np.cumsum(steps + 1) // STRETCHES
            for part in np.unique(cuts):
                r = slice(np.searchsorted(cuts, part), np.searchsorted(cuts, part, "right"))
                n, m = total[r], steps[r]
                times, ends = m + 1, np.cumsum(m + 1)
                each = lambda x: np.repeat(x, times)  # noqa: B023, E731
                j = np.arange(ends[-1]) - each(ends - times)
                # The first step on the long axis that stands at j of the short one, ceil((2nj - n) / 2m). Numbers are far below 2**53, so the quotient of
                # doubles is cut off at the same whole number.
                at_j = ((each(2 * n) * j + each(2 * m - n - 1)) / each(np.maximum(2 * m, 1))).astype(np.int64)
                at_j[ends - times] = 0
                next_j = np.append(at_j[1:], 0)
                next_j[ends - 1] = n + 1
                way, begin = each(sl[r]), each(long0[r])
                p, q = begin + way * at_j, begin + way * (next_j - 1)
                met = lines.met(each(across[r]) + each(sa[r]) * j, np.minimum(p, q), np.maximum(p, q) + 1)
                out[rays[r]] = np.add.reduceat(met, ends - times)
    return out


def chord_stats(boundary: DataFrame, runs: DataFrame | None = None, fraction: float = 0.2, low: int = 1, high: int = 16) -> DataFrame:
    """`mask_chords` from the boundaries of the masks' components: image_id, source_index, col, r0, r1 (other columns are ignored).

    A mask's runs and boundary go to one task. With one table only, it holds the runs, and boundaries are found from them.
    """
    if runs is None:
        return mask_chords(boundary, fraction, low, high)
    tagged = lambda df, of: df.select(*MASK, "col", "r0", "r1", F.lit(of).alias("of"))

    def work(table: pa.Table) -> pa.Table:
        group = numbered(table, MASK)
        col, r0, r1 = (x.astype(np.int64) for x in _columns(table, "col", "r0", "r1"))
        edge = table.column("of").to_numpy() == 1
        # Pixels of several components' boundaries count once; a mask without boundary or without runs has no rays.
        g, c, a, b = merged(group[edge], col[edge], r0[edge], r1[edge])
        both = np.intersect1d(g, group[~edge])
        kept, mine = np.isin(group, both) & ~edge, np.isin(g, both)
        dense = np.searchsorted(both, group[kept])
        i, py = spread(a[mine], b[mine])
        stats = chords_of(dense, col[kept], r0[kept], r1[kept], np.searchsorted(both, g[mine])[i], c[mine][i], py, fraction, low, high)
        first = np.searchsorted(group, both)
        return pa.table({**{k: table.column(k).take(pa.array(first)) for k in MASK}, **{k: pa.array(v) for k, v in stats.items()}})

    return per_group(tagged(runs, 0).unionByName(tagged(boundary, 1)), MASK, ["of", "col", "r0"], work, f"{_schema(runs, MASK)}, {CHORD_COLUMNS}")


CHORD_COLUMNS = "rays long, least int, greatest int, mean double"


def chords_of(group, col, r0, r1, at, px, py, fraction: float, low: int, high: int) -> dict[str, np.ndarray]:
    """Statistics of each mask over its boundary pixels (at, px, py). Every mask has runs, sorted by mask and column, and boundary pixels."""
    masks = int(group[-1]) + 1 if len(group) else 0
    if not masks:
        return {"rays": np.zeros(0, np.int64), "least": np.zeros(0, np.int32), "greatest": np.zeros(0, np.int32), "mean": np.zeros(0)}
    order = np.argsort(at, kind="stable")
    at, px, py = at[order], px[order], py[order]
    first = np.searchsorted(group, np.arange(masks))
    area, rows, cols = (np.bincount(group, w, masks) for w in (r1 - r0, (r0 + r1 - 1) * (r1 - r0), col * (r1 - r0)))
    x, y = cols / area, rows / (area * 2.0)
    box = [np.minimum.reduceat(col, first), np.minimum.reduceat(r0, first), np.maximum.reduceat(col, first), np.maximum.reduceat(r1, first) - 1]
    ex, ey = ray_ends(px, py, x[at], y[at], [v[at] for v in box])
    pixels = pixels_on_rays(group, col, r0, r1, box, at, px, py, ex, ey)
    distance = np.clip(np.ceil(pixels * fraction).astype(np.int64), low, high)
    starts = np.searchsorted(at, np.arange(masks))
    rays, total = np.bincount(at, minlength=masks), np.bincount(at, distance, masks)
    return {"rays": rays.astype(np.int64), "least": np.minimum.reduceat(distance, starts).astype(np.int32), "greatest": np.maximum.reduceat(distance, starts).astype(np.int32), "mean": total / rays}


def mask_chords(runs: DataFrame, fraction: float = 0.2, low: int = 1, high: int = 16) -> DataFrame:
    """Least, greatest and mean distance of each mask, over its distinct boundary pixels.

    From a boundary pixel of any of the mask's components a ray goes through the mask's centroid to the edge of its box.
    The mask's pixels on its raster line, times fraction, rounded up and clamped, are the distance. Packed masks (runs sorted) stay where they are.
    """

    def stats_of(group, col, r0, r1):
        # Components of all masks as groups of their own, for the boundary.
        order, dense, owner = part_of(group, col, r0, r1)
        g, c, a, b = boundary_of(dense, col[order], r0[order], r1[order])
        i, py = spread(a, b)
        return chords_of(group, col, r0, r1, owner[g[i]], c[i], py, fraction, low, high)

    def work(table: pa.Table) -> pa.Table:
        group = numbered(table, MASK)
        first = np.searchsorted(group, np.arange(int(group[-1]) + 1))
        stats = stats_of(group, *(x.astype(np.int64) for x in _columns(table, "col", "r0", "r1")))
        return pa.table({**{k: table.column(k).take(pa.array(first)) for k in MASK}, **{k: pa.array(v) for k, v in stats.items()}})

    def packed_work(batches):
        for batch, group, col, r0, r1 in mask_batches(batches):
            if len(col):
                at, dense = np.unique(group, return_inverse=True)
                stats = stats_of(dense, col, r0, r1)
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)).take(pa.array(at)) for k in MASK], *[pa.array(v) for v in stats.values()]], names=[*MASK, *stats])

    kinds = f"{_schema(runs, MASK)}, {CHORD_COLUMNS}"
    if "runs" in runs.columns:
        return runs.select(*MASK, "runs").mapInArrow(packed_work, kinds)
    return per_group(runs.select(*MASK, "col", "r0", "r1"), MASK, ["col", "r0"], work, kinds)
