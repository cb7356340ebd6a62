"""Exact overlays of polygons, and the solids that stand on them.

A group of polygons is cut into vertical slabs at every corner and crossing. Within a slab no two edges
cross, so the plane above each pair of neighbouring edges is inside or outside of every polygon, and any rule
on that (union, difference, intersection) leaves trapezoids. Corners on the line between two slabs are shared
by both sides, which makes the trapezoids one conforming set of triangles, and a triangulation without a
library: holes, several parts and touching corners need no special care.

Kernels are numpy and work on one tile of a group (a route, an outline with its parts), on a cluster of water polygons or one
footprint; groups are dealt by key and tile. Polygons are cut along tile borders before, and trapezoids of neighbouring
tiles are sewn together where a body is made of them. Rings are ``ARRAY<STRUCT<x,y>>``, even-odd within a polygon.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import binned

Rings = list[np.ndarray]
SNAP = 1e-9
TILE = 32.0  # side of the squares in which groups of polygons are overlaid
TRAPEZOIDS = "x0 double, x1 double, low0 double, low1 double, high0 double, high1 double"
TRIANGLES = "fid long, a long, b long, c long, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz")


# -- equal shapes -------------------------------------------------------------------------------


KEPT_BYTES = 64 << 20
_kept: OrderedDict[Hashable, tuple[object, int]] = OrderedDict()
_kept_size = [0]


def once(key: Hashable, size: int, make: Callable[[], object], weight: Callable[[object], int]) -> object:
    """What ``make`` gives for a shape, kept in this worker for equal ones; the shapes used last go beyond ``KEPT_BYTES``.

    ``size``: bytes of the key; ``weight``: bytes of what is made, which callers must not change.
    """
    if key in _kept:
        _kept.move_to_end(key)
        return _kept[key][0]
    made = make()
    whole = size + weight(made) + 512
    if whole <= KEPT_BYTES // 16:
        _kept[key] = made, whole
        _kept_size[0] += whole
        while _kept_size[0] > KEPT_BYTES:
            _kept_size[0] -= _kept.popitem(last=False)[1][1]
    return made


# -- slabs ----------------------------------------------------------------------------------------


def _edges(polygons: list[Rings], creases: list[tuple[tuple[float, float], tuple[float, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``x0, y0, x1, y1`` from left to right with their polygon (-1: crease), and the x of all ends."""
    rows, owner, xs = [], [], []
    for k, rings in enumerate(polygons):
        for ring in rings:
            p, q = ring, np.roll(ring, -1, axis=0)
            rows.append(np.hstack([p, q]))
            owner.append(np.full(len(p), k))
    if creases:
        rows.append(np.array([[*p, *q] for p, q in creases], float))
        owner.append(np.full(len(creases), -1))
    if not rows:
        return np.zeros((0, 4)), np.zeros(0, int), np.zeros(0)
    lines, of = np.concatenate(rows), np.concatenate(owner)
    xs = lines[:, [0, 2]].ravel()
    turned = lines[:, 0] > lines[:, 2]
    lines[turned] = lines[turned][:, [2, 3, 0, 1]]
    slanted = lines[:, 2] - lines[:, 0] > SNAP
    return lines[slanted], of[slanted], xs


def _crossings(lines: np.ndarray) -> np.ndarray:
    """The x of all proper crossings of edges."""
    if len(lines) < 2:
        return np.zeros(0)
    slope = (lines[:, 3] - lines[:, 1]) / (lines[:, 2] - lines[:, 0])
    base = lines[:, 1] - slope * lines[:, 0]
    found = []
    for i in range(0, len(lines), 512):
        part = slice(i, i + 512)
        turn = slope[part, None] - slope[None, :]
        with np.errstate(all="ignore"):
            x = (base[None, :] - base[part, None]) / turn
        low = np.maximum(lines[part, 0][:, None], lines[None, :, 0])
        high = np.minimum(lines[part, 2][:, None], lines[None, :, 2])
        found.append(x[(np.abs(turn) > 1e-12) & (x > low + SNAP) & (x < high - SNAP)])
    return np.concatenate(found)


def slabs(polygons: list[Rings], keep: Callable[[np.ndarray], bool], creases: list | tuple = ()) -> np.ndarray:
    """Trapezoids ``x0, x1, low0, low1, high0, high1`` of where ``keep`` holds.

    ``keep`` gets, for a place, which polygons hold it. ``creases`` are segments that no trapezoid crosses.
    """
    lines, owner, xs = _edges(polygons, list(creases))
    if not len(lines):
        return np.zeros((0, 6))
    xs = np.sort(np.concatenate([xs, _crossings(lines)]))
    xs = xs[np.concatenate([[True], np.diff(xs) > SNAP])]
    slope = (lines[:, 3] - lines[:, 1]) / (lines[:, 2] - lines[:, 0])
    out = []
    for x0, x1 in zip(xs[:-1], xs[1:], strict=True):
        mid = (x0 + x1) / 2
        on = np.flatnonzero((lines[:, 0] < mid) & (lines[:, 2] > mid))
        if not len(on):
            continue
        at = lambda x: lines[on, 1] + slope[on] * (x - lines[on, 0])  # noqa: B023, E731
        order = np.argsort(at(mid), kind="stable")
        left, right = at(x0)[order], at(x1)[order]
        inside, opened = np.zeros(len(polygons), bool), None
        for k, edge in enumerate(on[order]):
            if owner[edge] >= 0:
                inside[owner[edge]] ^= True
            kept = bool(keep(inside))
            if opened is not None and (not kept or owner[edge] < 0):
                out.append((x0, x1, left[opened], right[opened], left[k], right[k]))
                opened = None
            if kept and opened is None:
                opened = k
    made = np.array(out) if out else np.zeros((0, 6))
    return made[_areas(made) > 1e-12]


def swept(polygons: list[Rings], role: np.ndarray, rule: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 1 << 20) -> np.ndarray:
    """Like :func:`slabs` for a rule on how many polygons of role 0 and of role 1 hold a place; all slabs at once, ``most`` edges at a time."""
    lines, owner, xs = _edges(polygons, [])
    if not len(lines):
        return np.zeros((0, 6))
    xs = np.sort(np.concatenate([xs, _crossings(lines)]))
    xs = xs[np.concatenate([[True], np.diff(xs) > SNAP])]
    middle = (xs[:-1] + xs[1:]) / 2
    slope = (lines[:, 3] - lines[:, 1]) / (lines[:, 2] - lines[:, 0])
    first, last = np.searchsorted(middle, lines[:, 0], "right"), np.searchsorted(middle, lines[:, 2], "left")
    open_ = np.cumsum(np.bincount(first, minlength=len(xs) + 1) - np.bincount(last, minlength=len(xs) + 1))[: len(middle)]
    part = np.cumsum(open_) // most
    out = [np.zeros((0, 6))]
    for a, b in ((int(c[0]), int(c[-1]) + 1) for c in np.split(np.arange(len(middle)), np.flatnonzero(np.diff(part)) + 1) if len(c)):
        edge = np.flatnonzero((first < b) & (last > a))
        start, size = np.maximum(first[edge], a), np.minimum(last[edge], b) - np.maximum(first[edge], a)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
        edge = np.repeat(edge, size)
        at = lambda e, x: lines[e, 1] + slope[e] * (x - lines[e, 0])
        order = np.lexsort((at(edge, middle[k]), k))
        edge, k = edge[order], k[order]
        # Going up, a polygon's first edge enters it, its second one leaves it, and so on.
        by = np.lexsort((owner[edge], k))
        group = np.flatnonzero(np.diff(owner[edge][by], prepend=-2) | np.diff(k[by], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(group, np.diff(np.append(group, len(by))))
        sign = np.empty(len(by), np.int64)
        sign[by] = 1 - 2 * (rank % 2)
        kind = role[owner[edge]]
        kept = rule(np.cumsum(np.where(kind == 0, sign, 0)), np.cumsum(np.where(kind == 1, sign, 0)))
        before = np.concatenate([[False], kept[:-1]])
        low, high = np.flatnonzero(kept & ~before), np.flatnonzero(~kept & before)
        x0, x1 = xs[k[low]], xs[k[low] + 1]
        out.append(np.stack([x0, x1, at(edge[low], x0), at(edge[low], x1), at(edge[high], x0), at(edge[high], x1)], 1))
    made = np.concatenate(out)
    return made[_areas(made) > 1e-12]


def _areas(traps: np.ndarray) -> np.ndarray:
    return (traps[:, 1] - traps[:, 0]) * (traps[:, 4] - traps[:, 2] + traps[:, 5] - traps[:, 3]) / 2 if len(traps) else np.zeros(0)


def _snapped(x: np.ndarray) -> np.ndarray:
    """Numbers that differ by rounding only, made equal."""
    order = np.argsort(x, kind="stable")
    own = x[order]
    first = np.concatenate([[True], np.diff(own) > 10 * SNAP])
    out = np.empty_like(x)
    out[order] = own[first][np.cumsum(first) - 1]
    return out


def triangulated(traps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and counter-clockwise triangles that fill the trapezoids and meet corner to corner.

    Trapezoids of several tiles may come together: a level edge gets the corners that its neighbours across it have.
    """
    if not len(traps):
        return np.zeros((0, 2)), np.zeros((0, 3), int)
    traps = traps.copy()
    traps[:, :2] = _snapped(traps[:, :2].ravel()).reshape(-1, 2)
    traps = traps[traps[:, 1] > traps[:, 0]]
    # Heights on a line between slabs come from different edges; those that differ by rounding only are one corner.
    marks: dict[float, np.ndarray] = {}
    for x in np.unique(traps[:, :2]):
        ys = np.sort(np.concatenate([traps[traps[:, 0] == x][:, [2, 4]].ravel(), traps[traps[:, 1] == x][:, [3, 5]].ravel()]))
        marks[x] = ys[np.concatenate([[True], np.diff(ys) > 10 * SNAP])]
    level: dict[float, np.ndarray] = {}
    for low in (2, 4):
        flat = traps[np.abs(traps[:, low] - traps[:, low + 1]) <= SNAP]
        for y in np.unique(np.round(flat[:, low], 7)):
            own = flat[np.abs(flat[:, low] - y) < 1e-6][:, :2].ravel()
            level[y] = np.unique(np.concatenate([level.get(y, own[:0]), own]))

    def between(x0: float, x1: float, y0: float, y1: float) -> list[float]:
        if abs(y0 - y1) > SNAP:
            return []
        own = level[np.round(y0, 7)]
        return own[np.searchsorted(own, x0, "right") : np.searchsorted(own, x1, "left")].tolist()

    points: dict[tuple[float, float], int] = {}
    number = lambda x, y: points.setdefault((x, y), len(points))
    faces = []
    for x0, x1, low0, low1, high0, high1 in traps:
        sides = []
        for x, low, high in ((x0, low0, high0), (x1, low1, high1)):
            ys = marks[x]
            first, last = (int(np.searchsorted(ys, y + 5 * SNAP, "right")) - 1 for y in (low, high))
            sides.append([(x, y) for y in ys[max(first, 0) : max(first, last, 0) + 1].tolist()])
        left, right = sides
        i = j = 0
        made = len(faces)
        while i < len(left) - 1 or j < len(right) - 1:
            up_left = i < len(left) - 1 and (j == len(right) - 1 or (left[i + 1][1] - low0) * max(high1 - low1, SNAP) <= (right[j + 1][1] - low1) * max(high0 - low0, SNAP))
            third = left[i + 1] if up_left else right[j + 1]
            faces.append((number(*left[i]), number(*right[j]), number(*third)))
            i, j = (i + 1, j) if up_left else (i, j + 1)
        for inner, a, b, first in ((between(x0, x1, low0, low1), left[0], right[0], True), (between(x0, x1, high0, high1)[::-1], right[-1], left[-1], False)):
            if inner and a[0] != b[0] and len(faces) > made:
                # The face on the level edge becomes a fan of its third corner.
                at = made if first else len(faces) - 1
                p, q = number(*a), number(*b)
                apex = next(v for v in faces[at] if v not in (p, q))
                chain = [p, *(number(x, a[1]) for x in inner), q]
                fan = [(u, v, apex) for u, v in zip(chain, chain[1:], strict=False)]
                faces[at : at + 1] = fan if first else fan[::-1]
    return np.array(list(points), float), np.array(faces, int).reshape(-1, 3)


def border(faces: np.ndarray) -> np.ndarray:
    """Directed edges that only one face has."""
    directed = faces[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2)
    _, of, uses = np.unique(np.sort(directed, axis=1), axis=0, return_inverse=True, return_counts=True)
    return directed[uses[of.reshape(-1)] == 1]


def part_pinches(faces: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Give the fans that meet only in a border corner a corner each; new faces, and the old corner of every new one."""
    rim, degree = np.unique(border(faces), return_counts=True)
    out, copies = faces.copy(), []
    order = np.argsort(faces.ravel(), kind="stable")
    corners = faces.ravel()[order]
    for v in rim[degree > 2].tolist():
        around = (order[slice(*np.searchsorted(corners, [v, v + 1]))] // 3).tolist()
        fans: list[tuple[set[int], list[int]]] = []
        for f in around:
            ends, group = set(faces[f].tolist()) - {v}, [f]
            for fan in [x for x in fans if x[0] & ends]:
                ends, group = ends | fan[0], fan[1] + group
                fans.remove(fan)
            fans.append((ends, group))
        for _, group in sorted(fans, key=lambda x: min(x[1]))[1:]:
            for f in group:
                out[f][faces[f] == v] = count + len(copies)
            copies.append(v)
    return out, np.array(copies, dtype=np.int64)


def solid(points: np.ndarray, faces: np.ndarray, bottom: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closed body between two heights at each point; where these are equal, both are one corner."""
    if not len(faces):
        return np.zeros((0, 3)), np.zeros((0, 3), int)
    faces, copies = part_pinches(faces, len(points))
    source = np.concatenate([np.arange(len(points)), copies]).astype(int)
    points, bottom, top = points[source], bottom[source], top[source]
    n = len(points)
    under = np.where(top - bottom > SNAP, np.arange(n) + n, np.arange(n))
    rim = border(faces)
    walls = np.concatenate([np.stack([under[rim[:, 0]], under[rim[:, 1]], rim[:, 1]], 1), np.stack([under[rim[:, 0]], rim[:, 1], rim[:, 0]], 1)])
    every = np.concatenate([faces, under[faces[:, ::-1]], walls])
    every = every[(every[:, 0] != every[:, 1]) & (every[:, 1] != every[:, 2]) & (every[:, 0] != every[:, 2])]
    corners = np.concatenate([np.column_stack([points, top]), np.column_stack([points, bottom])])
    used, flat = np.unique(every, return_inverse=True)
    return corners[used], flat.reshape(-1, 3)


def watertight(faces: np.ndarray) -> bool:
    """Every directed edge occurs once, and so does its reverse."""
    directed = faces[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2)
    pairs, uses = np.unique(directed, axis=0, return_counts=True)
    back = np.unique(directed[:, ::-1], axis=0)
    return bool((uses == 1).all() and np.array_equal(pairs, back))


# -- footprints -----------------------------------------------------------------------------------


def area_and_centroid(traps: np.ndarray) -> tuple[float, np.ndarray]:
    points, faces = triangulated(traps)
    if not len(faces):
        return 0.0, np.zeros(2)
    p = points[faces]
    twice = (p[:, 1, 0] - p[:, 0, 0]) * (p[:, 2, 1] - p[:, 0, 1]) - (p[:, 1, 1] - p[:, 0, 1]) * (p[:, 2, 0] - p[:, 0, 0])
    return float(twice.sum() / 2), (p.mean(axis=1) * twice[:, None]).sum(axis=0) / twice.sum()


def tightest_box(ring: np.ndarray) -> np.ndarray:
    """Corners of the smallest rectangle, of any direction, around a ring."""
    hull = _hull(ring)
    best = None
    for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        axis = (q - p) / max(np.linalg.norm(q - p), 1e-12)
        frame = np.array([axis, [-axis[1], axis[0]]])
        own = hull @ frame.T
        low, high = own.min(axis=0), own.max(axis=0)
        size = float(np.prod(high - low))
        if best is None or size < best[0] - 1e-12:
            best = size, np.array([low, [high[0], low[1]], high, [low[0], high[1]]]) @ frame
    return best[1]


def _hull(ring: np.ndarray) -> np.ndarray:
    points = np.unique(ring, axis=0)

    def half(ordered: np.ndarray) -> list[np.ndarray]:
        chain: list[np.ndarray] = []
        for p in ordered:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1])) if len(points) > 2 else points


@dataclass(frozen=True)
class Roof:
    """Directions and half extents of a roof; ``u`` runs along the ridge."""

    centre: np.ndarray
    u: np.ndarray
    v: np.ndarray
    half_u: float
    half_v: float
    shape: str

    def local(self, points: np.ndarray) -> np.ndarray:
        return (points - self.centre) @ np.array([self.u, self.v]).T

    def outside(self, local: np.ndarray) -> np.ndarray:
        return self.centre + local @ np.array([self.u, self.v])

    def share(self, local: np.ndarray) -> np.ndarray:
        """Height as a share of the roof's, 0 at the eave."""
        u, v = np.clip(local[:, 0] / self.half_u, -1, 1), np.clip(local[:, 1] / self.half_v, -1, 1)
        rise = {
            "skillion": lambda: (v + 1) / 2,
            "gabled": lambda: 1 - np.abs(v),
            "hipped": lambda: np.minimum(1 - np.abs(v), self.half_u / self.half_v * (1 - np.abs(u))),
            "pyramidal": lambda: 1 - np.maximum(np.abs(u), np.abs(v)),
        }[self.shape]()
        return np.maximum(rise, 0.0)

    def creases(self) -> list:
        """Segments along which the height field bends, in local coordinates."""
        a, b = self.half_u, self.half_v
        if self.shape == "gabled":
            return [((-2 * a, 0.0), (2 * a, 0.0))]
        if self.shape == "pyramidal":
            return [((0.0, 0.0), (s * a, t * b)) for s in (-1, 1) for t in (-1, 1)]
        if self.shape == "hipped":
            ridge, stub = max(0.0, a - b), max(0.0, b - a)
            hips = [((s * ridge, t * stub), (s * a, t * b)) for s in (-1, 1) for t in (-1, 1)]
            return [*hips, ((-a, 0.0), (a, 0.0)), *([((0.0, -stub), (0.0, stub))] if stub else [])]
        return []


def roof_over(rings: Rings, shape: str, orientation: str = "along") -> Roof:
    """Directions from the tightest rectangle around the outline, centre from the footprint's centroid.

    A pyramid whose footprint does not hold its own centroid is centred in the widest part beside it.
    """
    corners = tightest_box(rings[0])
    sides = np.roll(corners, -1, axis=0) - corners
    sizes = np.linalg.norm(sides, axis=1)
    long_ = sides[sizes.argmax()] / max(sizes.max(), 1e-9)
    traps = slabs([rings], lambda s: s[0])
    _, centre = area_and_centroid(traps)
    if shape == "pyramidal" and not ((traps[:, 0] <= centre[0]) & (centre[0] <= traps[:, 1]) & (_at(traps, 2, centre[0]) <= centre[1]) & (centre[1] <= _at(traps, 4, centre[0]))).any():
        widest = traps[_areas(traps).argmax()]
        centre = np.array([(widest[0] + widest[1]) / 2, widest[2:].mean()])
    short = np.array([-long_[1], long_[0]])
    reach = np.abs((corners - centre) @ np.array([long_, short]).T).max(axis=0)
    half = np.maximum(reach, 1e-9)
    if orientation == "across":
        return Roof(centre, short, long_, float(half[1]), float(half[0]), shape)
    return Roof(centre, long_, short, float(half[0]), float(half[1]), shape)


def _at(traps: np.ndarray, column: int, x: float) -> np.ndarray:
    t = (x - traps[:, 0]) / np.maximum(traps[:, 1] - traps[:, 0], 1e-12)
    return traps[:, column] + t * (traps[:, column + 1] - traps[:, column])


def roof_solid(rings: Rings, shape: str, eave: float, height: float, orientation: str = "along", overlap: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Body between the eave (lowered by ``overlap``) and the roof; none for flat roofs. Exact: no face crosses a ridge or hip."""
    if overlap < 0:
        raise ValueError("roof overlap cannot be negative")
    if shape == "flat" or height <= 0:
        return np.zeros((0, 3)), np.zeros((0, 3), int)
    roof = roof_over(rings, shape, orientation)
    local = [roof.local(r) for r in rings]
    points, faces = triangulated(slabs([local], lambda s: s[0], roof.creases()))
    top = eave + height * roof.share(points)
    turned = roof.u[0] * roof.v[1] - roof.u[1] * roof.v[0] < 0
    corners, out = solid(roof.outside(points), faces[:, ::-1] if turned else faces, np.full(len(points), eave - overlap), top)
    return corners, out


def prism(polygons: list[Rings], keep: Callable[[np.ndarray], bool], bottom: float, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Upright body over where ``keep`` holds."""
    points, faces = triangulated(slabs(polygons, keep))
    return solid(points, faces, np.full(len(points), float(bottom)), np.full(len(points), float(top)))


# -- stadiums -------------------------------------------------------------------------------------


# Names and defaults of a recipe's parameters in landmark registries.
@dataclass(frozen=True)
class StadiumRecipe:
    """Millimetres of a stadium's mass; coverage is the share of the field's span under roof panels."""

    bowl_height_mm: float = 4.0
    tier_count: int = 3
    minimum_feature_mm: float = 0.8
    roof_style: str = "none"
    roof_height_mm: float = 6.0
    roof_thickness_mm: float = 0.8
    roof_coverage: float = 0.38
    roof_orientation_degrees: float = 0.0
    roof_side: str = "west"
    roof_support_width_mm: float = 1.2
    support_overlap_mm: float = 0.15
    closed_roof_band_count: int = 3
    closed_roof_band_width_mm: float = 1.2
    closed_roof_band_height_mm: float = 0.48

    def problems(self) -> list[str]:
        """What :data:`LIMITS` forbid, as texts."""
        given = vars(self)
        value = lambda bound: given[bound] if isinstance(bound, str) else bound
        found = [] if self.roof_style in STYLES else [f"roof_style must be one of {', '.join(STYLES)}"]
        for limit in LIMITS:
            own, low, high = given[limit.field], value(limit.low), value(limit.high)
            inside = (low < own < high) if limit.strict else (low <= own <= high)
            if self.roof_style in limit.styles and not inside:
                found.append(limit.text)
        return found


@dataclass(frozen=True)
class Limit:
    """A field's range for some roof styles; bounds are numbers or names of other fields, and belong to the range unless ``strict``."""

    field: str
    low: float | str = -np.inf
    high: float | str = np.inf
    strict: bool = False
    styles: tuple[str, ...] = ("none", "asymmetric", "retractable", "closed")

    @property
    def text(self) -> str:
        ends = [f"{'above' if self.strict else 'at least'} {self.low}"] * (self.low != -np.inf) + [f"{'below' if self.strict else 'at most'} {self.high}"] * (self.high != np.inf)
        return f"{self.field} must be {' and '.join(ends)}"


# Roof styles, and the ranges within which a recipe can be printed.
STYLES = ("none", "asymmetric", "retractable", "closed")
OPENED = ("asymmetric", "retractable")
LIMITS = (
    Limit("bowl_height_mm", 0, strict=True),
    Limit("closed_roof_band_count", 2, 3, styles=("closed",)),
    Limit("closed_roof_band_height_mm", 0, strict=True, styles=("closed",)),
    Limit("closed_roof_band_width_mm", "minimum_feature_mm", styles=("closed",)),
    Limit("minimum_feature_mm", 0.8),
    Limit("roof_coverage", 0.05, 0.9, styles=OPENED),
    Limit("roof_height_mm", "bowl_height_mm", strict=True, styles=(*OPENED, "closed")),
    Limit("roof_support_width_mm", "minimum_feature_mm", styles=(*OPENED, "closed")),
    Limit("roof_thickness_mm", "minimum_feature_mm", styles=(*OPENED, "closed")),
    Limit("support_overlap_mm", 0, "roof_thickness_mm", strict=True, styles=(*OPENED, "closed")),
    Limit("tier_count", 1),
)


#: Roof style of each landmark recipe.
RECIPES = {"stadium_closed_roof": "closed", "stadium_retractable_roof": "retractable"}


def recipe_of(enhancement: dict | None) -> StadiumRecipe | None:
    """Recipe of a landmark's enhancement ``type, recipe, parameters``; none if it is of another kind."""
    if not enhancement or enhancement.get("type") != "procedural_recipe" or enhancement.get("recipe") not in RECIPES:
        return None
    given = enhancement.get("parameters") or {}
    names = StadiumRecipe.__dataclass_fields__
    typed = {k: type(names[k].default)(v) for k, v in given.items() if k in names and k != "roof_style"}
    return StadiumRecipe(roof_style=RECIPES[enhancement["recipe"]], **typed)


def mitred(ring: np.ndarray, distance: float) -> np.ndarray:
    """Ring moved outwards (inwards if negative) with sharp corners; an error if an edge would turn round."""
    if _ring_area(ring) < 0:
        ring = ring[::-1]
    side = np.roll(ring, -1, axis=0) - ring
    unit = side / np.linalg.norm(side, axis=1, keepdims=True)
    normal = np.column_stack([unit[:, 1], -unit[:, 0]])
    before = np.roll(normal, 1, axis=0)
    out = ring + distance * (normal + before) / (1 + (normal * before).sum(axis=1, keepdims=True))
    if ((np.roll(out, -1, axis=0) - out) * side).sum(axis=1).min() <= 0:
        raise ValueError("the ring is too small for this offset")
    return out


def _ring_area(ring: np.ndarray) -> float:
    nxt = np.roll(ring, -1, axis=0)
    return float((ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum() / 2)


def ring_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of two rings that do not cross."""

    def one(points: np.ndarray, ring: np.ndarray) -> float:
        p, d = ring, np.roll(ring, -1, axis=0) - ring
        t = np.clip(((points[:, None] - p) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-18), 0, 1)
        return float(np.linalg.norm(points[:, None] - p - t[..., None] * d, axis=-1).min())

    return min(one(a, b), one(b, a))


def stadium_bodies(outer: np.ndarray, recipe: StadiumRecipe, inner: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bodies of a stadium that all stand on the ground or overlap one that does; their slicer makes them one."""
    if recipe.problems():
        raise ValueError("; ".join(recipe.problems()))
    r = recipe
    if inner is None:
        inner = mitred(outer, -max(3 * r.minimum_feature_mm, 0.2 * float((outer.max(axis=0) - outer.min(axis=0)).min())))
    if len(slabs([[outer], [inner]], lambda s: s[1] and not s[0])) or ring_gap(outer, inner) < r.minimum_feature_mm - 1e-6:
        raise ValueError("the opening must leave the smallest feature of bowl on every side")
    centre = area_and_centroid(slabs([[outer]], lambda s: s[0]))[1]

    def band(plan: np.ndarray, angle: float, first: float, last: float, of: np.ndarray, rule: Callable, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """A body over what a rule makes of the plan, the opening and a band across the plan, in a frame whose first axis has the angle."""
        axis = np.array([np.cos(angle), np.sin(angle)])
        frame = np.column_stack([axis, [-axis[1], axis[0]]])
        flat, cut, limit = ((x - centre) @ frame for x in (plan, inner, of))
        ends = limit[:, 1].min() - r.minimum_feature_mm, limit[:, 1].max() + r.minimum_feature_mm
        start = limit[:, 0].min()
        across = np.array([(start + first, ends[0]), (start + last, ends[0]), (start + last, ends[1]), (start + first, ends[1])])
        points, faces = prism([[flat], [across], [cut]], rule, low, high)
        return np.column_stack([points[:, :2] @ frame.T + centre, points[:, 2]]), faces

    turn = np.radians(r.roof_orientation_degrees)
    length = lambda ring: float(np.ptp((ring - centre) @ np.array([np.cos(turn), np.sin(turn)])))
    out = []
    if r.roof_style == "closed":
        out.append(prism([[outer]], lambda s: s[0], 0.0, r.roof_height_mm))
        low, high = r.roof_height_mm - r.support_overlap_mm, r.roof_height_mm + r.closed_roof_band_height_mm
        for share in np.arange(1, r.closed_roof_band_count + 1) / (r.closed_roof_band_count + 1):
            middle, half = share * length(outer), r.closed_roof_band_width_mm / 2
            out.append(band(outer, turn, middle - half, middle + half, outer, lambda s: s[0] and s[1], low, high))
        return out
    gap = ring_gap(outer, inner)
    if gap + 1e-6 < r.tier_count * r.minimum_feature_mm:
        raise ValueError("the bowl is too narrow for its tiers")
    rims = [inner, *(mitred(inner, k * gap / r.tier_count) for k in range(1, r.tier_count)), outer]
    for k in range(r.tier_count):
        out.append(prism([[outer], [rims[k]], [rims[k + 1]]], lambda s: s[0] and s[2] and not s[1], 0.0, r.bowl_height_mm * (k + 1) / r.tier_count))
    # A panel starts behind the opening's edge and reaches over it; seen from the other end, with the plan turned round, so does the second one.
    behind = {"asymmetric": [r.roof_side != "west"], "retractable": [False, True]}.get(r.roof_style, [])
    for opposite in behind:
        angle, reach = turn + np.pi * opposite, length(inner) * r.roof_coverage / len(behind)
        under = r.roof_height_mm - r.roof_thickness_mm
        out.append(band(outer, angle, -r.roof_support_width_mm, r.support_overlap_mm, inner, lambda s: s[0] and s[1] and not s[2], 0.0, under + r.support_overlap_mm))
        out.append(band(outer, angle, -r.roof_support_width_mm, reach, inner, lambda s: s[0] and s[1], under, r.roof_height_mm))
    return [b for b in out if len(b[1])]


# -- tables ---------------------------------------------------------------------------------------


def as_rings(value: list) -> Rings:
    """Rings of a cell without closing and repeated points; rings that hold no area are left out."""
    out = []
    for ring in value or ():
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        p = p[np.abs(p - np.roll(p, 1, axis=0)).max(axis=1) > 0] if len(p) > 1 else p
        if len(p) > 2 and abs(_ring_area(p)) > 1e-12:
            out.append(p)
    return out


def _soup(key: str, rows: list[tuple[object, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    """Triangles of several bodies with the numbers and coordinates of their corners."""
    keys, fids, corners, points, base = [], [], [], [], {}
    for own, p, f in rows:
        first, start = base.get(own, (0, 0))
        keys += [own] * len(f)
        fids.append(np.arange(len(f)) + start)
        corners.append(f + first)
        points.append(p[f].reshape(-1, 9))
        base[own] = first + len(p), start + len(f)
    f = np.concatenate(corners) if corners else np.zeros((0, 3), int)
    x = np.concatenate(points) if points else np.zeros((0, 9))
    fid = np.concatenate(fids) if fids else np.zeros(0, int)
    names = [key, "fid", "a", "b", "c", *(f"{p}{k}" for p in "abc" for k in "xyz")]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(fid, pa.int64()), *(pa.array(f[:, i].astype(np.int64)) for i in range(3)), *(pa.array(np.ascontiguousarray(x[:, i], dtype=float)) for i in range(9))], names)


def _bodies(table: DataFrame, key: str, columns: list[str], make: Callable[[dict], list[tuple[np.ndarray, np.ndarray]]], how: str) -> DataFrame:
    """Bodies of each row, made once for rows that are equal but for their key; ``how`` tells one way of making from another."""

    def own(r: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        shape = repr([r[c] for c in columns])
        return once((how, shape), len(shape), lambda: make(r), lambda bodies: sum(p.nbytes + f.nbytes for p, f in bodies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = [(r[key], p, f) for r in batch.slice(start, 256).to_pylist() for p, f in own(r)]
                yield _soup(key, rows, batch.schema.field(key).type)

    return table.select(key, *columns).mapInArrow(run, f"{key} {dict(table.dtypes)[key]}, {TRIANGLES}")


def prisms(table: DataFrame, rings: str = "rings", bottom: str = "bottom", top: str = "top", key: str = "layer") -> DataFrame:
    """Triangles ``key, fid, a, b, c, ax .. cz`` of upright bodies over polygons, holes left open. Polygons without area give none."""
    return _bodies(table, key, [rings, bottom, top], lambda r: [prism([as_rings(r[rings])], lambda s: s[0], r[bottom], r[top])], "prisms")


def roofs(table: DataFrame, rings: str = "rings", shape: str = "roof_shape", eave: str = "eave_mm", height: str = "roof_mm", orientation: str = "roof_orientation", overlap: float = 0.0, key: str = "layer") -> DataFrame:
    """Triangles of the roofs of footprints; flat ones give none."""
    return _bodies(table, key, [rings, shape, eave, height, orientation], lambda r: [roof_solid(own, r[shape], r[eave], r[height], r[orientation], overlap)] if (own := as_rings(r[rings])) else [], f"roofs {overlap}")


def stadiums(table: DataFrame, rings: str = "rings", recipe: StadiumRecipe | None = None, key: str = "layer") -> DataFrame:
    """Triangles of stadium masses; a second ring is the opening. A footprint that the recipe does not fit gives none; :func:`unfit_stadiums` tells why."""
    own = _checked(recipe)
    return _bodies(table, key, [rings], lambda r: _stadium(as_rings(r[rings]), own)[0], f"stadiums {own}")


def unfit_stadiums(table: DataFrame, rings: str = "rings", recipe: StadiumRecipe | None = None, key: str = "layer") -> DataFrame:
    """``key, problem`` of the footprints from which :func:`stadiums` makes no body."""
    own, kind = _checked(recipe), dict(table.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r[key], problem) for r in batch.to_pylist() if (problem := _stadium(as_rings(r[rings]), own)[1])]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.schema.field(key).type), pa.array([f[1] for f in found], pa.string())], [key, "problem"])

    return table.select(key, rings).mapInArrow(run, f"{key} {kind}, problem string")


def _checked(recipe: StadiumRecipe | None) -> StadiumRecipe:
    own = recipe or StadiumRecipe()
    if own.problems():
        raise ValueError("; ".join(own.problems()))
    return own


def _stadium(rings: Rings, recipe: StadiumRecipe) -> tuple[list[tuple[np.ndarray, np.ndarray]], str]:
    """Bodies over a footprint, or why there are none."""
    if not rings:
        return [], "the footprint has no ring"
    try:
        made = stadium_bodies(rings[0], recipe, rings[1] if len(rings) > 1 else None)
    except ValueError as problem:
        return [], str(problem)
    return made, "" if made else "the footprint has no area"


def _side(ring: np.ndarray, axis: int, at: float, above: bool) -> np.ndarray:
    """The part of a ring on one side of a line ``x = at`` or ``y = at``, closed along the line."""
    gap = ring[:, axis] - at
    kept = gap >= 0 if above else gap <= 0
    if kept.all():
        return ring
    after, there = np.roll(ring, -1, axis=0), np.roll(kept, -1)
    share = np.where(kept != there, gap / np.where(kept != there, gap - np.roll(gap, -1), 1.0), 0.0)
    cut = ring + share[:, None] * (after - ring)
    cut[:, axis] = at
    return np.stack([ring, cut], 1).reshape(-1, 2)[np.stack([kept, kept != there], 1).ravel()]


def parted(rings: Rings, tile: float) -> Iterator[tuple[int, int, Rings]]:
    """A polygon cut along the borders of square tiles: column, row and the rings inside. Halves are halved again, so a corner is cut few times."""
    own = [r for r in rings if len(r) > 2]
    if not own:
        return
    every = np.concatenate(own)
    low, high = np.floor(every.min(axis=0) / tile).astype(int), np.maximum(np.ceil(every.max(axis=0) / tile).astype(int) - 1, np.floor(every.min(axis=0) / tile).astype(int))
    stack = [(low.tolist(), high.tolist(), own)]
    while stack:
        first, last, held = stack.pop()
        if first == last:
            yield first[0], first[1], held
            continue
        axis = 0 if last[0] - first[0] >= last[1] - first[1] else 1
        middle = (first[axis] + last[axis] + 1) // 2
        for above in (False, True):
            side = [r for r in (_side(x, axis, middle * tile, above) for x in held) if len(r) > 2]
            if side:
                ends = [first.copy(), last.copy()]
                ends[0 if above else 1][axis] = middle if above else middle - 1
                stack.append((*ends, side))


RINGS = "array<array<struct<x: double, y: double>>>"


#: Rules on the numbers of polygons of role 0 and of role 1 that hold a place.
RULES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"any": lambda outer, inner: outer > 0, "less": lambda outer, inner: (outer > 0) & (inner <= 0)}
SIDES = ("x0", "x1", "low0", "low1", "high0", "high1")


def _overlaid(table: DataFrame, key: str, rule: str, tile: float) -> DataFrame:
    """Trapezoids of each group of ``key, role, rings`` where a rule (of :data:`RULES`) on the number of polygons of role 0 and 1 holds.

    Polygons are cut along the borders of tiles first. What lies in one tile of one group is overlaid together; tiles come to a
    task one after the other, and those with equal polygons are overlaid once.
    """
    kind = dict(table.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = [(r[key], c, d, r["role"], held) for r in batch.slice(start, 256).to_pylist() for c, d, held in parted(as_rings(r["rings"]), tile)]
                own = [ring for r in rows for ring in r[4]]
                at = np.concatenate([*own, np.zeros((0, 2))])
                points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(at[:, i])) for i in (0, 1)], ["x", "y"])
                ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends([len(r[4]) for r in rows]), pa.ListArray.from_arrays(ends([len(x) for x in own]), points))
                names = [key, "_column", "_row", "role", "rings"]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(key).type), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3)), lists], names)

    def overlay(rows: list[tuple[int, list]]) -> np.ndarray:
        rows = sorted((r for r in ((role, repr(rings), rings) for role, rings in rows)), key=lambda r: r[:2])
        shape = "".join(f"{role}{text}" for role, text, _ in rows)
        make = lambda: swept([as_rings(r[2]) for r in rows], np.array([r[0] for r in rows]), RULES[rule])
        return once((rule, shape), len(shape), make, lambda traps: traps.nbytes)

    def out(done: list[tuple[object, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
        traps = np.concatenate([np.zeros((0, 6)), *(t for _, t in done)])
        keys = pa.array([k for k, _ in done], kind).take(pa.array(np.repeat(np.arange(len(done)), [len(t) for _, t in done])))
        return pa.RecordBatch.from_arrays([keys, *(pa.array(np.ascontiguousarray(traps[:, i], dtype=float)) for i in range(6))], [key, *SIDES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, arrow = None, [], None
        for batch in batches:
            arrow = batch.schema.field(key).type
            for start in range(0, batch.num_rows, 1024):
                done = []
                for own, column, row, role, rings in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns), strict=True):
                    if at != (own, column, row):
                        if held:
                            done.append((at[0], overlay(held)))
                        at, held = (own, column, row), []
                    held.append((role, rings))
                if done:
                    yield out(done, arrow)
        if held:
            yield out([(at[0], overlay(held))], arrow)

    if tile <= 0:
        raise ValueError("tiles need a size")
    pieces = table.select(key, F.col("role").cast("int").alias("role"), F.col("rings").cast(RINGS).alias("rings")).mapInArrow(cut, f"{key} {kind}, _column int, _row int, role int, rings {RINGS}")
    dealt = pieces.repartition(key, "_column", "_row").sortWithinPartitions(key, "_column", "_row")
    return dealt.mapInArrow(run, f"{key} {kind}, {TRAPEZOIDS}")


def union(polygons: DataFrame, key: str, tile: float = TILE) -> DataFrame:
    """Trapezoids of the union of each group's polygons (``rings``), tile by tile; overlaps count once."""
    return _overlaid(polygons.withColumn("role", F.lit(0)), key, "any", tile)


def corridors(pairs: DataFrame, width: float | Column, key: str = "route_id", flat: bool = True, sides: int = 32) -> DataFrame:
    """``key, rings``: a rectangle for each segment of a line and a regular polygon at each joint, to be united.

    With ``flat`` the line's ends are cut square; otherwise they get a polygon as well. Round joints are ``sides``-cornered.
    ``width`` is a number or a column of the segments.
    """
    if (not isinstance(width, Column) and width <= 0) or sides < 4:
        raise ValueError("a corridor needs a width and joints of four corners at least")
    half = F.col("_half")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    dx, dy = (F.col("x1") - F.col("x0")) / F.col("length"), (F.col("y1") - F.col("y0")) / F.col("length")
    own = pairs.where("length > 0").withColumn("_half", width / 2 if isinstance(width, Column) else F.lit(width / 2))
    corner = lambda n, s: point(F.col(f"x{n}") - s * half * dy, F.col(f"y{n}") + s * half * dx)
    boxes = own.select(key, F.array(F.array(corner(0, -1), corner(1, -1), corner(1, 1), corner(0, 1))).alias("rings"))
    ends = own.groupBy(key).agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    turns = own.join(ends, key)
    spots = turns.where((F.col("seq") != F.col("_last")) | F.lit(not flat)).select(key, F.col("x1").alias("x"), F.col("y1").alias("y"), "_half")
    if not flat:
        spots = spots.unionByName(turns.where("seq = _first").select(key, F.col("x0").alias("x"), F.col("y0").alias("y"), "_half"))
    around = F.array(*(point(F.col("x") + half * float(np.cos(2 * np.pi * k / sides)), F.col("y") + half * float(np.sin(2 * np.pi * k / sides))) for k in range(sides)))
    return boxes.unionByName(spots.distinct().select(key, F.array(around).alias("rings")))


def boxed(polygons: DataFrame) -> DataFrame:
    """Adds the outline's box ``min_x .. max_y``."""
    at = lambda f, c: f(F.transform(F.get("rings", F.lit(0)), lambda p: p[c]))
    return polygons.select("*", *(at(f, c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.array_min), ("max", F.array_max))))


def remainders(outlines: DataFrame, parts: DataFrame, cell: float, key: str = "outline_id", tile: float = TILE) -> DataFrame:
    """Trapezoids of each outline without the parts that stand in it; nothing is left of an outline that parts cover.

    ``outlines``: ``key, rings``; ``parts``: ``rings``. Parts meet outlines through grid cells of their boxes, and a tile of an
    outline is one group with the parts near it.
    """
    box = ("min_x", "min_y", "max_x", "max_y")
    left = binned(boxed(outlines.select(key, "rings")).drop("rings"), box, cell)
    right = binned(boxed(parts.select("rings")).select(F.col("rings").alias("part"), *(F.col(c).alias(f"p_{c}") for c in box)), tuple(f"p_{c}" for c in box), cell)
    near = left.join(right, ["_cx", "_cy"]).where("p_min_x < max_x AND min_x < p_max_x AND p_min_y < max_y AND min_y < p_max_y")
    near = near.select(key, F.lit(1).alias("role"), F.col("part").alias("rings")).distinct()
    both = outlines.select(key, F.lit(0).alias("role"), "rings").unionByName(near)
    return _overlaid(both, key, "less", tile)


def region_areas(trapezoids: DataFrame, key: str) -> DataFrame:
    """Area of each group's trapezoids."""
    c = F.col
    return trapezoids.groupBy(key).agg(F.sum((c("x1") - c("x0")) * (c("high0") - c("low0") + c("high1") - c("low1")) / 2).alias("area"))


def region_prisms(trapezoids: DataFrame, levels: DataFrame, key: str, bottom: str = "bottom", top: str = "top") -> DataFrame:
    """Triangles of a solid over each group's trapezoids, between the heights that ``levels`` gives."""

    def run(traps: pa.Table, level: pa.Table) -> pa.Table:
        kind = traps.schema.field(key).type
        if not traps.num_rows or not level.num_rows:
            return pa.Table.from_batches([_soup(key, [], kind)])
        own = np.column_stack([traps.column(c).to_numpy() for c in SIDES])
        own = own[np.lexsort(own.T[::-1])]
        low, high = level.column(bottom)[0].as_py(), level.column(top)[0].as_py()

        def make() -> tuple[np.ndarray, np.ndarray]:
            points, faces = triangulated(own)
            return solid(points, faces, np.full(len(points), float(low)), np.full(len(points), float(high)))

        body = once(("region", own.tobytes(), low, high), own.nbytes, make, lambda b: b[0].nbytes + b[1].nbytes)
        return pa.Table.from_batches([_soup(key, [(traps.column(key)[0].as_py(), *body)], kind)])

    return trapezoids.groupBy(key).cogroup(levels.select(key, bottom, top).groupBy(key)).applyInArrow(run, f"{key} {dict(trapezoids.dtypes)[key]}, {TRIANGLES}")


def surface_skin(cells: DataFrame, selected: DataFrame, visible: float = 0.4, embed: float = 0.2) -> DataFrame:
    """Solid skins over chosen terrain triangles: ``grid_id, fid, a, b, c, ax .. cz``.

    ``cells``: ``grid_id, row, col, x, y, h_mm``; ``selected``: ``grid_id, row, col, half`` of triangles (half 0 is the one at the
    cell's upper left). The skin follows the terrain ``visible`` above and ``embed`` below it; patches that meet in a corner get
    a corner each. A grid is one group.
    """
    if visible <= 0 or embed < 0:
        raise ValueError("skin thickness must be positive")

    def run(surface: pa.Table, chosen: pa.Table) -> pa.Table:
        kind = surface.schema.field("grid_id").type
        if not chosen.num_rows or not surface.num_rows:
            return pa.Table.from_batches([_soup("grid_id", [], kind)])
        row, col = surface.column("row").to_numpy(), surface.column("col").to_numpy()
        columns = int(col.max()) + 1
        place = np.full((int(row.max()) + 1) * columns, -1)
        place[row * columns + col] = np.arange(len(row))
        first = chosen.column("t_row").to_numpy() * columns + chosen.column("t_col").to_numpy()
        upper = chosen.column("t_half").to_numpy() == 0
        faces = np.where(upper[:, None], np.stack([first, first + columns, first + 1], 1), np.stack([first + 1, first + columns, first + columns + 1], 1))
        faces = faces[np.argsort(first * 2 + ~upper, kind="stable")]
        if faces.max() >= len(place) or chosen.column("t_col").to_numpy().max() >= columns - 1 or place[faces].min() < 0:
            raise ValueError("a chosen triangle has a corner outside of the grid")
        faces = place[faces]
        points = np.column_stack([surface.column("x").to_numpy(), surface.column("y").to_numpy()])
        height = surface.column("h_mm").to_numpy()
        body = solid(points, faces, height - embed, height + visible)
        if not watertight(body[1]):
            raise ValueError("the skin is not closed")
        return pa.Table.from_batches([_soup("grid_id", [(surface.column("grid_id")[0].as_py(), *body)], kind)])

    left = cells.select("grid_id", "row", "col", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("h_mm").cast("double").alias("h_mm"))
    # New names, because both tables may come from one: a cogroup needs columns of its own on either side.
    right = selected.select(F.col("grid_id").alias("t_grid"), *(F.col(c).cast("long").alias(f"t_{c}") for c in ("row", "col", "half")))
    return left.groupBy("grid_id").cogroup(right.groupBy("t_grid")).applyInArrow(run, f"grid_id {dict(cells.dtypes)['grid_id']}, {TRIANGLES}")
