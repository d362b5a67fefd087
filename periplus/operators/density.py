"""Density clusters of similar reports, without a list of their pairs.

Reports lie on the unit sphere (no pole and no date line), which is cut into cubes of several radii, the
tiles. A task has the reports of a group in one tile and those within two radii of it, so it knows
all neighbours of those within one. It sorts them into cells of place, speed and course that are so small
that all members of a cell are neighbours: cells of ``min_points`` members are core as a whole, cells
whose boxes lie within the limits are neighbours as a whole, and single reports are compared only between
the other cells, as far as it is still open whether they are core or linked. The components of
tiles are then joined through the core reports that several tiles know. All is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periplus.functions import geo
from periplus.operators.materialize import importable, written

#: Side of a tile, in radii.
TILE = 12
#: Pairs of reports, or of cells, that are looked at together.
AT_ONCE = 1 << 21
#: Pairs of reports beyond which two cells are compared through halves of theirs.
HALVE = 1 << 20

Pairs = tuple[np.ndarray, np.ndarray]


def below(limit: float) -> float:
    """What a number must be below so that it is at most ``limit`` when rounded to 6 places."""
    if math.isinf(limit):
        return limit
    k = math.floor(limit * 1e6 + 0.5)
    return (k - (k / 1e6 > limit) + 0.5) / 1e6


def _ranges(low: np.ndarray, high: np.ndarray) -> Pairs:
    """For each number of each range [low, high): the range's place, and the number."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of consecutive items whose sizes add up to ``AT_ONCE`` at most (one larger item goes alone)."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
        yield slice(low, high)
        low = high


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest node of its component) after ``a`` and ``b`` are linked."""
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


class Reports:
    """Reports in cells: columns x, y, z (on the unit sphere), speed, course, sorted by cell."""

    def __init__(self, columns: list[np.ndarray], d: float, s: float, h: float):
        arc = below(d) / (2 * geo.EARTH_KM)
        self.chord, self.s, self.h = 4.0 if arc >= math.pi / 2 else 2 * math.sin(arc), min(below(s), 1e300), h
        self.far = self.chord * self.chord
        # Buckets a little smaller than the limits, so that rounding can't part neighbours in a cell.
        side = 0.999 * self.chord / math.sqrt(3)
        self.w_speed, self.w_course = 0.999 * self.s, 0.999 * min(h, 180.0)
        self.any_course = h >= 60 or h < 1e-9  # where ranges of courses would overlap, or are points: look at all
        cube = np.stack([np.floor((c + 1) / side).astype(np.int64) for c in columns[:3]])
        speed = np.floor(columns[3] / self.w_speed)
        course = np.unique(columns[4], return_inverse=True)[1].astype(float) if h < 1e-9 else np.floor(columns[4] / self.w_course)
        by = np.lexsort((course, speed, cube[2], cube[1], cube[0]))
        self.by = by
        self.c = [np.ascontiguousarray(c[by]) for c in columns]
        cube, speed, course = cube[:, by], speed[by], course[by]
        new_cube = np.append(True, (cube[:, 1:] != cube[:, :-1]).any(0))
        new = new_cube | np.append(True, (speed[1:] != speed[:-1]) | (course[1:] != course[:-1]))
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(new)))
        self.cell = np.cumsum(new) - 1
        self.low = [np.minimum.reduceat(c, self.first) for c in self.c]
        self.high = [np.maximum.reduceat(c, self.first) for c in self.c]
        self.cube_of = np.cumsum(new_cube)[self.first] - 1
        self.cubes = cube[:, new_cube]
        self.cells = np.searchsorted(self.cube_of, np.arange(self.cubes.shape[1] + 1))
        self.speeds, self.speed_rank = np.unique(speed[self.first], return_inverse=True)
        self.courses, self.course_rank = np.unique(course[self.first], return_inverse=True)
        self.key = (self.cube_of * len(self.speeds) + self.speed_rank) * len(self.courses) + self.course_rank

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y, z, speed, course = (c[i] - c[j] for c in self.c)
        ok = (x * x + y * y + z * z < self.far) & (np.abs(speed) < self.s)
        turn = np.abs(course)
        a, b = self.c[4][i], self.c[4][j]
        return ok & (np.where(turn <= 180.0, turn, np.abs(360.0 - np.maximum(a, b) + np.minimum(a, b))) <= self.h)

    def _judge(self, low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
        """Whether any, and whether all pairs between two boxes can be neighbours."""
        gap = [np.maximum(0.0, np.maximum(la - hb, lb - ha)) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b)]
        far = [np.maximum(ha - lb, hb - la) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b)]
        h = self.h
        some = (gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] < self.far) & (gap[3] < self.s)
        some &= (gap[4] <= h) | ((far[4] >= 360 - h - 1e-9) & (gap[4] <= 360 + h + 1e-9))
        every = (far[0] * far[0] + far[1] * far[1] + far[2] * far[2] < self.far) & (far[3] < self.s)
        every &= (far[4] <= min(h, 180.0)) | ((gap[4] > 180) & (gap[4] >= 360 - h + 1e-9) & (far[4] <= 360 + h - 1e-9))
        return some, every

    def _cube_pairs(self) -> Iterator[Pairs]:
        """Pairs of cubes that can hold neighbours, each once; the first pairs are cubes with themselves."""
        u = self.cubes - self.cubes.min(1, keepdims=True) + 2
        span = [int(x) + 3 for x in u.max(1)]
        key = (u[0] * span[1] + u[1]) * span[2] + u[2]
        here = np.arange(len(key))
        yield here, here
        for dx in range(3):
            for dy in range(-2, 3):
                for dz in range(-2, 3):
                    if (dx, dy, dz) > (0, 0, 0):
                        to = key + (dx * span[1] + dy) * span[2] + dz
                        at = np.minimum(np.searchsorted(key, to), len(key) - 1)
                        found = key[at] == to
                        yield here[found], at[found]

    def cell_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of cells between which there can be neighbours, each once, and whether all there are."""
        near_cubes = list(self._cube_pairs())
        p, q = (np.concatenate(x) for x in zip(*near_cubes))
        size = np.diff(self.cells)[p]
        n_course = len(self.courses)
        for part in _chunks(4 * size):
            which, a = _ranges(self.cells[p[part]], self.cells[p[part] + 1])
            to, same = q[part][which], (p[part] == q[part])[which]
            slow, fast = (self.speeds.searchsorted(np.floor(x / self.w_speed), side) for x, side in ((self.low[3][a] - self.s, "left"), (self.high[3][a] + self.s, "right")))
            which, rank = _ranges(slow, fast)
            a, to, same = a[which], to[which], same[which]
            base = (to * len(self.speeds) + rank) * n_course
            if self.any_course:
                turns = [(np.zeros(len(a), np.int64), np.full(len(a), n_course))]
            else:
                ends = [(self.low[4][a] + t - self.h, self.high[4][a] + t + self.h) for t in (0.0, 360.0, -360.0)]
                turns = [(self.courses.searchsorted(np.floor(x / self.w_course), "left"), self.courses.searchsorted(np.floor(y / self.w_course), "right")) for x, y in ends]
            for left, right in turns:
                low, high = self.key.searchsorted(base + left), self.key.searchsorted(base + right)
                low = np.where(same, np.maximum(low, a + 1), low)
                for piece in _chunks(np.maximum(high - low, 0)):
                    which, b = _ranges(low[piece], high[piece])
                    one = a[piece][which]
                    some, every = self._judge(*([x[k] for x in box] for k in (one, b) for box in (self.low, self.high)))
                    yield one[some], b[some], every[some]

    def between(self, a: np.ndarray, b: np.ndarray, of_a: tuple, of_b: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Neighbours ``i, j`` between cells, and the place of their pair. ``of``: reports by cell, and per cell the first of them and their number."""
        (list_a, first_a, n_a), (list_b, first_b, n_b) = of_a, of_b
        for part in _chunks(n_a[a] * n_b[b]):
            which, i = _ranges(first_a[a[part]], first_a[a[part]] + n_a[a[part]])
            at, j = _ranges(first_b[b[part]][which], (first_b[b[part]] + n_b[b[part]])[which])
            i, j, which = list_a[i][at], list_b[j], which[at]
            ok = self.near(i, j)
            yield i[ok], j[ok], which[ok] + part.start

    def any_near(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Whether two sets have neighbours, by halves of them."""
        todo = [(i, j)]
        while todo:
            i, j = todo.pop()
            some, every = self._judge(*([f(c[k]) for c in self.c] for k in (i, j) for f in (np.min, np.max)))
            if every:
                return True
            if not some:
                continue
            if len(i) * len(j) <= 1 << 14:
                if self.near(np.repeat(i, len(j)), np.tile(j, len(i))).any():
                    return True
                continue
            if len(i) < len(j):
                i, j = j, i
            wide = max(range(5), key=lambda k: float(np.ptp(self.c[k][i])) / ((self.chord, self.chord, self.chord, self.s, max(self.h, 1e-9))[k]))
            i = i[np.argsort(self.c[wide][i], kind="stable")]
            todo += [(i[: len(i) // 2], j), (i[len(i) // 2 :], j)]
        return False


def _of(members: np.ndarray, cell: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.bincount(cell[members], minlength=n_cells)
    return members, np.cumsum(n) - n, n


def clusters(ids: np.ndarray, columns: list[np.ndarray], d: float, s: float, h: float, min_points: int, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and roots (the component's smallest core id) of core reports and of reports next to them, and whether they are core.

    ``role``: 0 for reports whose clusters are asked for, 1 for others whose neighbours are all here, 2 for the rest.
    A report next to core ones of several components comes with each of them.
    """
    r = Reports(columns, d, s, h)
    ids, role, n_cells = ids[r.by], role[r.by], len(r.n)
    pairs = list(r.cell_pairs())
    a, b, every = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    sure, (a, b) = (a[every], b[every]), (a[~every], b[~every])
    # Core: by cells first, then report by report where that is open.
    total = r.n + sum(np.bincount(x, r.n[y], n_cells).astype(np.int64) for x, y in (sure, sure[::-1]))
    count = total[r.cell]
    everyone = (np.arange(len(ids)), r.first, r.n)
    asked = _of(np.flatnonzero((count < min_points) & (role < 2)), r.cell, n_cells)
    more = np.zeros(len(ids), np.int64)
    for x, y in ((a, b), (b, a)):
        open_ = asked[2][x] > 0
        for i, _, _ in r.between(x[open_], y[open_], asked, everyone):
            more += np.bincount(i, minlength=len(ids))
    core = (count + more >= min_points) & (role < 2)
    # Links between cells with core reports, a few reports of each first.
    cores = _of(np.flatnonzero(core), r.cell, n_cells)
    both = lambda x, y: (cores[2][x] > 0) & (cores[2][y] > 0)
    linked = both(*sure)
    label = _merge(np.arange(n_cells), sure[0][linked], sure[1][linked])
    linked = both(a, b)
    x, y = a[linked], b[linked]
    for most in (2, 8, None):
        some = cores if most is None else (cores[0], cores[1], np.minimum(cores[2], most))
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        work = some[2][x] * some[2][y]
        order = np.argsort(work, kind="stable")
        x, y, work = x[order], y[order], work[order]
        small = int(np.searchsorted(work, HALVE, "right"))
        for part in _chunks(work[:small]):
            left, right = x[part], y[part]
            apart = label[left] != label[right]
            left, right = left[apart], right[apart]
            for _, _, k in r.between(left, right, some, some):
                label = _merge(label, left[k], right[k])
        for left, right in zip(x[small:].tolist(), y[small:].tolist()):
            if label[left] != label[right] and r.any_near(*(some[0][some[1][k] : some[1][k] + some[2][k]] for k in (left, right))):
                label = _merge(label, np.array([left]), np.array([right]))
    root = np.full(n_cells, np.iinfo(np.int64).max)
    np.minimum.at(root, label[r.cell[core]], ids[core])
    root = root[label]
    # Reports next to core ones.
    edge = _of(np.flatnonzero(~core & (role == 0)), r.cell, n_cells)
    at, to = [edge[0][cores[2][r.cell[edge[0]]] > 0]], []
    to.append(root[r.cell[at[0]]])
    for x, y in (sure, sure[::-1]):
        keep = (edge[2][x] > 0) & (cores[2][y] > 0)
        which, i = _ranges(edge[1][x[keep]], (edge[1] + edge[2])[x[keep]])
        at.append(edge[0][i])
        to.append(root[y[keep][which]])
    for x, y in ((a, b), (b, a)):
        keep = (edge[2][x] > 0) & (cores[2][y] > 0)
        for i, j, _ in r.between(x[keep], y[keep], edge, cores):
            at.append(i)
            to.append(root[r.cell[j]])
    border = np.unique(np.stack([np.concatenate(at), np.concatenate(to)]), axis=1)
    inner = np.flatnonzero(core)
    places = np.concatenate([inner, border[0]])
    return r.by[places], np.concatenate([root[r.cell[inner]], border[1]]), np.concatenate([np.ones(len(inner), bool), np.zeros(border.shape[1], bool)])


def similar(rows: DataFrame, keys: list[str], min_points: int, components) -> DataFrame:
    """``row_id, cluster_id`` of all clustered ``rows``: ``keys, row_id, lon, lat, speed, cog`` and the group's limits ``d, s, h``.

    Rows that lack a value have no neighbours; a limit that is no number (of values that are none) admits all.
    ``components`` labels the nodes of edges.
    """
    importable(rows.sparkSession)
    rows = rows.where(F.col("row_id").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    free = lambda c, limit: F.when(F.isnan(limit), F.when(F.col(c).isNotNull(), 0.0)).otherwise(F.col(c).cast("double"))
    limit = lambda c: F.when(F.isnan(c), float("inf")).otherwise(F.col(c).cast("double"))
    lon, lat = F.radians(free("lon", "d")), F.radians(free("lat", "d"))
    values = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat), "v": free("speed", "s"), "w": free("cog", "h"), "d": limit("d"), "s": limit("s"), "h": limit("h")}
    rows = rows.select(*keys, F.col("row_id").cast("long").alias("row_id"), *[c.alias(n) for n, c in values.items()])
    finite = F.lit(True)
    for c in "xyzvw":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    for c in "dsh":
        finite = finite & (F.col(c) >= 0)
    finite = F.coalesce(finite, F.lit(False))
    # The radius as a chord, rounded up; a tile is known by its number along each axis.
    chord = 2 * F.sin(F.least((F.col("d") + 1e-6) / (2 * geo.EARTH_KM), F.lit(math.pi / 2)))
    tiled = rows.where(finite).withColumn("_m", chord * (1 + 1e-9) + 1e-12)
    number = lambda c, by: F.greatest(F.lit(0), F.least(F.floor((F.col(c) + 1 + by * F.col("_m")) / (TILE * F.col("_m"))), F.floor(2 / (TILE * F.col("_m"))))).cast("long")
    for c in "xyz":
        tiled = tiled.withColumn(f"_{c}", F.array(*[number(c, by) for by in (0, -1, 1)]))
    shared = F.lit(False)
    for c in "xyz":
        shared = shared | (F.col(f"_{c}")[1] < F.col(f"_{c}")[2])
    tiled = tiled.withColumn("shared", shared)
    own, known = F.lit(True), F.lit(True)
    for c in "xyz":
        tiled = tiled.withColumn(f"t{c}", F.explode(F.sequence(number(c, -2), number(c, 2))))
        own = own & (F.col(f"t{c}") == F.col(f"_{c}")[0])
        known = known & F.col(f"t{c}").between(F.col(f"_{c}")[1], F.col(f"_{c}")[2])
    role = F.when(own, 0).when(known, 1).otherwise(2).cast("int").alias("role")
    groups = [*keys, "tx", "ty", "tz"]
    tiled = tiled.select(*groups, "row_id", *values, "shared", role)

    def cluster(t: pa.Table) -> pa.Table:
        col = {n: t.column(n).to_numpy() for n in ("row_id", "x", "y", "z", "v", "w", "d", "s", "h", "shared", "role")}
        places, root, core = clusters(col["row_id"], [col[n] for n in "xyzvw"], *(float(col[n][0]) for n in "dsh"), min_points, col["role"])
        mine = col["role"][places] == 0
        link = core & (~mine | col["shared"][places])
        return pa.table({"row_id": col["row_id"][places], "root": root, "mine": mine, "link": link})

    found = written(tiled.groupBy(*groups).applyInArrow(cluster, "row_id long, root long, mine boolean, link boolean"), "tile-clusters")
    roots = found.where("link").groupBy("row_id").agg(F.collect_set("root").alias("roots")).where(F.size("roots") > 1)
    edges = roots.select(F.array_min("roots").alias("a"), F.explode("roots").alias("b")).where("a <> b").distinct()
    named = written(components(written(edges, "tile-links")), "named")
    out = found.where("mine").join(named, F.col("root") == F.col("node"), "left").groupBy("row_id").agg(F.min(F.coalesce("component", "root")).alias("cluster_id"))
    if min_points <= 1:
        out = out.unionByName(rows.where(~finite).select("row_id", F.col("row_id").alias("cluster_id")))
    return written(out, "labels")
