"""Covariance models, their fit to an experimental variogram, and simple kriging: small NumPy functions."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

import numpy as np

SHAPES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "exponential": lambda q: np.exp(-q),
    "spherical": lambda q: np.where(q < 1, 1 - 1.5 * q + 0.5 * q**3, 0.0),
    "gaussian": lambda q: np.exp(-(q**2)),
}


@dataclasses.dataclass(frozen=True)
class Model:
    """Nugget, structured variance and range; an unknown kind counts as exponential.

    ``reach`` is the range along the axis of which ``ratios`` has a 1: each
    ratio is the reach over the range along one of ``axes`` (unit vectors of
    strike, down dip and normal; without any, x, y and z).
    """

    kind: str = "exponential"
    nugget: float = 0.1
    variance: float = 0.9
    reach: float = 100.0
    ratios: tuple[float, float, float] = (1.0, 1.0, 1.0)
    axes: tuple[tuple[float, float, float], ...] | None = None

    @property
    def sill(self) -> float:
        return self.nugget + self.variance

    def space(self, xyz: np.ndarray) -> np.ndarray:
        """The points in the space where the model is the same in all directions."""
        xyz = np.asarray(xyz, float)
        return (xyz if self.axes is None else xyz @ np.array(self.axes).T) * np.array(self.ratios)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Covariance, by the vector that parts them, of each point of ``a`` and each of ``b``."""
        a, b = self.space(a), self.space(b)
        return self.covariance(np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)))

    def ranges(self) -> tuple[float, float, float]:
        return tuple(self.reach / r for r in self.ratios)

    def covariance(self, h: np.ndarray) -> np.ndarray:
        """Of the structured part, by distance in ``space``; the nugget is left to the diagonal."""
        return self.variance * SHAPES.get(self.kind, SHAPES["exponential"])(np.asarray(h, float) / self.reach)

    def gamma(self, h: np.ndarray) -> np.ndarray:
        return self.sill - self.covariance(h)

    def with_sill(self, sill: float) -> Model:
        """The same shape at another total sill; both parts keep their shares."""
        if self.sill <= 0:
            raise ValueError("no sill to scale")
        f = sill / self.sill
        return dataclasses.replace(self, nugget=self.nugget * f, variance=self.variance * f)

    def guarded(self) -> Model:
        """Fit for simulation: a structured variance below 0.1 becomes 1, and a total sill below 0.5 is brought to 1."""
        out = self if self.variance >= 0.1 else dataclasses.replace(self, variance=1.0)
        return out if out.sill >= 0.5 else out.with_sill(1.0)

    def bounded(self, low: float | None = None, high: float | None = None, target: float | None = None) -> Model:
        """The same with a range that is given, or kept within limits; ranges along axes keep their ratios."""
        return dataclasses.replace(self, reach=target if target is not None else min(max(self.reach, low or 0.0), math.inf if high is None else high))

    def tuned(self, nugget_ratio: float | None = None, reach_factor: float = 1.0) -> Model:
        n = self.nugget if nugget_ratio is None else min(max(nugget_ratio, 0.0), 0.95) * self.sill
        return dataclasses.replace(self, nugget=n, variance=self.sill - n, reach=self.reach * reach_factor)


def _loss(kind: str, p: np.ndarray, d: np.ndarray, g: np.ndarray, w: np.ndarray) -> float:
    return float((w * (Model(kind, *p.tolist()).gamma(d) - g) ** 2).sum())


def damped_fit(kind: str, d: np.ndarray, g: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Nugget, variance and range of least weighted squares within bounds, by Levenberg's damped steps.

    Steps are found on the parameters that no bound holds, and cut off at the
    bounds; the damping grows until a step makes the loss smaller."""
    p, damping = np.clip(start, low, high), 1e-3
    loss = _loss(kind, p, d, g, w)
    for _ in range(rounds):
        step = np.maximum(1e-7 * np.abs(p), 1e-9)
        slope = np.stack([(Model(kind, *(p + step * e).tolist()).gamma(d) - Model(kind, *(p - step * e).tolist()).gamma(d)) / (2 * s) for s, e in zip(step, np.eye(3), strict=True)], 1)
        left = g - Model(kind, *p.tolist()).gamma(d)
        pull = slope.T @ (w * left)
        free = ~(((p <= low) & (pull < 0)) | ((p >= high) & (pull > 0)))
        if not free.any():
            break
        normal = (slope * w[:, None]).T @ slope
        better = False
        while damping < 1e12:
            a = normal[np.ix_(free, free)]
            move = np.zeros(3)
            move[free] = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-300)), pull[free])
            tried = np.clip(p + move, low, high)
            now = _loss(kind, tried, d, g, w)
            if now < loss:
                better = loss - now > 1e-15 * loss
                p, loss, damping = tried, now, damping / 5
                break
            damping *= 4
        if not better:
            break
    return p


def fit(distance: np.ndarray, gamma: np.ndarray, kind: str = "exponential", max_reach: float = math.inf) -> Model:
    """Least weighted squares, near lags weighing more, over a grid of nuggets, variances and ranges and, beside
    it, by damped steps from the grid's best; the grid stays only if it is better by half a percent.
    With fewer than three lags the default model."""
    d, g = np.asarray(distance, float), np.asarray(gamma, float)
    ok = np.isfinite(d) & np.isfinite(g) & (d > 0)
    d, g = d[ok], g[ok]
    if len(d) < 3:
        return Model(kind)
    order = np.argsort(d)
    d, g = d[order], g[order]
    far = d.max()
    level = max(float(g[-3:].mean()), float(g.max()), 1e-3)
    w = 1 / np.maximum(d / far, 0.05)
    w /= w.sum()
    nuggets = np.linspace(0, max(1.5 * g.min(), 0.9 * level), 21)
    variances = np.maximum(np.linspace(0.2, 1.8, 25) * level, 1e-6)
    low = max(far / 8, 1e-6)
    reaches = np.linspace(low, max(min(max_reach, 2.5 * far), low), 30)
    shape = 1 - SHAPES.get(kind, SHAPES["exponential"])(d[None, :] / reaches[:, None])
    curve = nuggets[:, None, None, None] + variances[None, :, None, None] * shape[None, None]
    loss = ((curve - g) ** 2 * w).sum(-1)
    i, j, k = np.unravel_index(int(loss.argmin()), loss.shape)
    best = np.array([nuggets[i], variances[j], reaches[k]])
    bounds = np.array([0.0, 1e-6, min(1e-3 * far, max_reach)]), np.array([np.inf, np.inf, max(min(max_reach, 100 * far), low)])
    smooth = damped_fit(kind, d, g, w, *bounds, best)
    if loss.min() > 0.995 * _loss(kind, smooth, d, g, w):
        best = smooth
    found = Model(kind, *best.tolist())
    # A total sill near the level of the far lags is brought to it.
    return found.with_sill(level) if 0.7 <= level / found.sill <= 1.3 else found


def directional(base: Model, ranges: dict[str, float | None], axes: np.ndarray | None = None, max_reach: float = math.inf) -> Model:
    """The base model with ranges of its own along ``strike``, ``dip`` and ``normal``.

    Ranges that are missing or beyond ``max_reach`` don't count; with fewer than
    two that do, the base model stays as it is.  The largest is the reach; an
    axis without a range has that of strike, or else the reach."""
    known = {n: r for n, r in ranges.items() if r and 0 < r <= max_reach}
    if len(known) < 2:
        return base
    reach = max(known.values())
    spare = known.get("strike", reach)
    ratios = tuple(reach / known.get(n, spare) for n in ("strike", "dip", "normal"))
    return dataclasses.replace(base, reach=reach, ratios=ratios, axes=None if axes is None else tuple(map(tuple, np.asarray(axes, float).tolist())))


def krige(model: Model, points: np.ndarray, values: np.ndarray, target: np.ndarray, nugget_on_diagonal: bool = False, jitter: float = 1e-10, ordinary: bool = False) -> tuple[float, float]:
    """Simple kriging with mean 0, or ordinary kriging, whose weights add up to 1: estimate and variance, which is never below 0."""
    n = len(points)
    left, right = model.between(points, points), model.between(points, target[None, :])[:, 0]
    left[np.diag_indices_from(left)] += jitter + (model.nugget if nugget_on_diagonal else 0.0)
    if ordinary:
        left = np.block([[left, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        right = np.append(right, 1.0)
    try:
        w = np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(left, right, rcond=None)[0]
    return float(w[:n] @ values), max(0.0, float(model.sill - w @ right))


def krige_many(model: Model, points: np.ndarray, values: np.ndarray, targets: np.ndarray, ordinary: bool = False) -> np.ndarray:
    """Estimates as ``krige`` has them, of each target from its own points, as many for each: arrays of targets by points by axes."""
    n = points.shape[1]
    a, b = model.space(points), model.space(targets)
    left = model.covariance(np.sqrt(((a[:, :, None] - a[:, None]) ** 2).sum(-1)))
    right = model.covariance(np.sqrt(((a - b[:, None]) ** 2).sum(-1)))
    left[:, np.arange(n), np.arange(n)] += 1e-10
    if ordinary:
        left, right = np.pad(left, ((0, 0), (0, 1), (0, 1)), constant_values=1.0), np.pad(right, ((0, 0), (0, 1)), constant_values=1.0)
        left[:, n, n] = 0.0
    try:
        w = np.linalg.solve(left, right[..., None])[..., 0]
    except np.linalg.LinAlgError:
        # One of them has no solution.
        return np.array([krige(model, *each, ordinary=ordinary)[0] for each in zip(points, values, targets, strict=True)])
    return (w[:, :n] * values).sum(1)


def anisotropy(ranges: dict[str, float]) -> tuple[float, tuple[float, float]]:
    """The major range, and strike over dip and over normal, as reports give them."""
    return max(ranges.values()), (ranges["strike"] / ranges["dip"], ranges["strike"] / ranges["normal"])


def basis(strike: float, dip: float, dip_direction: float | None = None) -> np.ndarray:
    """Unit vectors of strike, down dip and normal as rows (east, north, up)."""
    towards = (strike + 90) % 360 if dip_direction is None else dip_direction
    s, t, d = (math.radians(v) for v in (strike, towards, dip))
    along = np.array([math.sin(s), math.cos(s), 0.0])
    down = np.array([math.sin(t) * math.cos(d), math.cos(t) * math.cos(d), -math.sin(d)])
    normal = np.cross(along, down)
    return np.stack([along, down, normal / np.linalg.norm(normal)])


class Buckets:
    """Points in unit cells of scaled space, to which more are added: neighbours within distance 1."""

    def __init__(self, points: np.ndarray):
        self.points = [tuple(p) for p in points.tolist()]
        self.held: dict[tuple[int, int, int], list[int]] = {}
        for i, p in enumerate(self.points):
            self.held.setdefault(self._key(p), []).append(i)

    @staticmethod
    def _key(p: tuple[float, ...]) -> tuple[int, int, int]:
        return math.floor(p[0]), math.floor(p[1]), math.floor(p[2])

    def add(self, p: tuple[float, float, float]) -> None:
        self.held.setdefault(self._key(p), []).append(len(self.points))
        self.points.append(p)

    def near(self, p: tuple[float, float, float], k: int) -> list[int]:
        """The k nearest, by distance and then by number."""
        a, b, c = self._key(p)
        found = []
        for x in (a - 1, a, a + 1):
            for y in (b - 1, b, b + 1):
                for z in (c - 1, c, c + 1):
                    for i in self.held.get((x, y, z), ()):
                        q = self.points[i]
                        d = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2
                        if d <= 1.0:
                            found.append((d, i))
        found.sort()
        return [i for _, i in found[:k]]
