"""Recursive filters along lines of voxels: smoothing and derivatives whose cost doesn't grow with their width.

A pass y[n] = sum p[k] x[n - k] + sum d[k] y[n - k] is linear, so a block of a line needs of what came before it a few
values only. Every block is first run from rest; the last outputs of these runs, a few numbers a block and line, are
combined along each line by powers of the recurrence's companion matrix; then every block adds what its true beginning
contributes. No task holds a line's voxels, only those of a brick."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.operators.checkpoints import stored

#: Voxels of a brick along the lines, and across them.
LONG, ACROSS = 64, 16
#: Neighbours of a block's ends that numerators can reach.
_REACH = 4


@dataclass
class Pass:
    """ahead: offset -> coefficient of the input that lies so far behind (negative: ahead); back: those of earlier outputs.
    start: the outputs before the line's first, latest first, from its first _REACH inputs; at rest without. hold: the
    second and third input of a line count as the first."""

    ahead: dict[int, float]
    back: list[float]
    reverse: bool = False
    start: Callable[[np.ndarray], np.ndarray] | None = None
    hold: bool = False
    companion: np.ndarray = field(init=False)

    def __post_init__(self):
        k = len(self.back)
        self.companion = np.eye(k, k=-1)
        self.companion[0] = self.back

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Outputs of lines x, with _REACH inputs more on both sides, that begin with `state`; in the order of the pass."""
        n = x.shape[1] - 2 * _REACH
        u = sum(c * x[:, _REACH - k : _REACH - k + n] for k, c in self.ahead.items())
        y = np.empty((len(x), n))
        before = list(state.T)
        for i in range(n):
            y[:, i] = u[:, i] + sum(d * b for d, b in zip(self.back, before, strict=True))
            before = [y[:, i], *before[:-1]]
        return y


def _poly(*terms: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator, by powers of the delay, of sums of (a cos wn + b sin wn) exp(-cn) from n = 0 on."""
    top, bottom = np.zeros(1), np.ones(1)
    for a, b, w, c in terms:
        e = np.exp(-c)
        n, d = np.array([a, e * (b * np.sin(w) - a * np.cos(w))]), np.array([1, -2 * e * np.cos(w), e * e])
        top, bottom = np.polynomial.polynomial.polyadd(np.convolve(top, d), np.convolve(n, bottom)), np.convolve(bottom, d)
    return top, bottom


def _moments(top: np.ndarray, bottom: np.ndarray) -> tuple[float, float, float]:
    """Sums of h, n h and n^2 h over n >= 0, from the transfer function's derivatives at 1."""
    p = np.polynomial.polynomial
    at = lambda c, k: float(p.polyval(1.0, p.polyder(c, k))) if len(c) > k else 0.0
    n0, n1, n2, d0, d1, d2 = (at(c, k) for c in (top, bottom) for k in range(3))
    h0 = n0 / d0
    h1 = (n1 - h0 * d1) / d0
    h2 = (n2 - 2 * h1 * d1 - h0 * d2) / d0
    return h0, h1, h1 + h2


# Deriche's fits of a Gaussian and its first two derivatives: a0, a1, w0, b0, c0, c1, w1, b1, for terms
# (a0 cos(w0 n/s) + a1 sin(w0 n/s)) exp(-b0 n/s) + (c0 cos(w1 n/s) + c1 sin(w1 n/s)) exp(-b1 n/s).
DERICHE = {
    0: (1.68, 3.735, 0.6318, 1.783, -0.6803, -0.2598, 1.997, 1.723),
    1: (-0.6472, -4.531, 0.6719, 1.527, 0.6494, 0.9557, 2.072, 1.516),
    2: (-1.331, 3.661, 0.748, 1.24, 0.3225, -1.738, 2.166, 1.314),
}


def deriche(sigma: float, order: int = 0) -> list[list[Pass]]:
    """A causal and an anticausal pass over the image, added. The sum of the response is 1; that of a first derivative gives
    slope 1 on a ramp, that of a second one 2 on a parabola. Lines are 0 outside of the image."""
    if sigma < 0.1 or order not in DERICHE:
        raise ValueError("sigma is 0.1 at least, and order 0, 1 or 2")
    a0, a1, w0, b0, c0, c1, w1, b1 = DERICHE[order]
    top, bottom = _poly((a0, a1, w0 / sigma, b0 / sigma), (c0, c1, w1 / sigma, b1 / sigma))
    h0, h1, h2 = _moments(top, bottom)
    top = top / (2 * h0 - top[0] if order == 0 else -2 * h1 if order == 1 else h2)
    top = np.pad(top, (0, 4 - len(top)))
    even = -1.0 if order == 1 else 1.0
    mirrored = {k: even * ((top[k] if k < 4 else 0.0) - bottom[k] * top[0]) for k in range(1, 5)}
    back = (-bottom[1:]).tolist()
    return [[Pass(dict(enumerate(top.tolist())), back), Pass(mirrored, back, reverse=True)]]


def exponential(alpha: float, order: int = 0) -> list[list[Pass]]:
    """Deriche's first filter: (1 + alpha |n|) exp(-alpha |n|), n exp(-alpha |n|), or (1 - k |n|) exp(-alpha |n|) with sum 0,
    scaled like deriche()."""
    if not 0.1 <= alpha <= 1.9 or order not in (0, 1, 2):
        raise ValueError("alpha lies between 0.1 and 1.9, and order is 0, 1 or 2")
    e = np.exp(-alpha)
    bottom = np.array([1, -2 * e, e * e])
    k = alpha if order == 0 else (e * e - 1) / (2 * e) if order == 2 else 1.0
    top = np.array([0.0, k * e]) if order == 1 else np.array([1.0, (k - 1) * e])
    h0, h1, h2 = _moments(top, bottom)
    top = top / (2 * h0 - top[0] if order == 0 else -2 * h1 if order == 1 else h2)
    even = -1.0 if order == 1 else 1.0
    mirrored = {n: even * ((top[n] if n < 2 else 0.0) - bottom[n] * top[0]) for n in (1, 2)}
    back = (-bottom[1:]).tolist()
    return [[Pass(dict(enumerate(top.tolist())), back), Pass(mirrored, back, reverse=True)]]


def young(sigma: float, order: int = 0) -> list[list[Pass]]:
    """Young and van Vliet's third-order filter: a pass to and one fro over its result. Smoothing treats lines as if their end
    values went on for ever (the first three as the first one, on the way to); derivatives as 0 outside."""
    if sigma < 0.5 or order not in (0, 1, 2):
        raise ValueError("sigma is 0.5 at least, and order 0, 1 or 2")
    # The published coefficients of 1995.
    q = 0.98711 * sigma - 0.96330 if sigma > 2.5 else 3.97156 - 4.14554 * np.sqrt(1 - 0.26891 * sigma)
    b = np.polynomial.polynomial.polyval(q, [1.57825, 2.44413, 1.4281, 0.422205])
    back = [float(np.polynomial.polynomial.polyval(q, c) / b) for c in ([0, 2.44413, 2.85619, 1.26661], [0, 0, -1.4281, -1.26661], [0, 0, 0, 0.422205])]
    gain = 1 - sum(back)
    if order == 1:
        return [[Pass({1: -gain / 2, -1: gain / 2}, back)], [Pass({0: gain}, back, reverse=True)]]
    if order == 2:
        return [[Pass({1: -gain, 0: gain}, back)], [Pass({1: gain, 0: -gain}, back, reverse=True)]]
    m = np.eye(3, k=-1)
    m[0] = back
    power = [np.linalg.matrix_power(m, k) for k in range(4)]
    # Beyond the end the first pass decays freely to its rest: the second pass is linear in how far it is from it.
    free = np.linalg.solve((np.eye(3) - sum(d * power[k + 1] for k, d in enumerate(back))).T, gain * np.array([1.0, 0, 0]))

    def begun(x: np.ndarray) -> np.ndarray:
        return np.repeat(x[:, :1], 3, axis=1)  # gain * x / (1 - sum of back)

    def ended(w: np.ndarray) -> np.ndarray:
        rest = (w[:, 0] - w[:, 1:4] @ np.array(back)) / gain  # the last input, which the first pass would come to
        far = w[:, :3] - rest[:, None]
        return np.stack([far @ (power[k].T @ free) + rest for k in (1, 2, 3)], axis=1)

    return [[Pass({0: gain}, back, start=begun, hold=True)], [Pass({0: gain}, back, reverse=True, start=ended)]]


def _passed(image: DataFrame, axis: str, passes: list[Pass], low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """The sum of some passes over the same input, along one axis, at all places of the bounds on lines with voxels."""
    u, v = [c for c in "xyz" if c != axis]
    first, last = low[axis], high[axis]
    n_blocks = (last - first) // LONG + 1
    off = F.col(axis) - first
    near = F.sequence(F.greatest(F.floor((off - _REACH) / LONG), F.lit(0)).cast("long"), F.least(F.floor((off + _REACH) / LONG), F.lit(n_blocks - 1)).cast("long"))
    rows = image.select("x", "y", "z", "v").withColumns({"bu": F.floor(F.col(u) / ACROSS), "bv": F.floor(F.col(v) / ACROSS), "b": F.explode(near)})

    def lines(g: pd.DataFrame, bu: int, bv: int, b: int) -> np.ndarray:
        """ACROSS * ACROSS lines of a block with its neighbours; 0 where nothing is."""
        length = min(LONG, last - first + 1 - b * LONG)
        x = np.zeros((ACROSS * ACROSS, length + 2 * _REACH))
        if len(g):
            at = g[axis].to_numpy() - first - b * LONG + _REACH
            x[(g[u].to_numpy() - bu * ACROSS) * ACROSS + g[v].to_numpy() - bv * ACROSS, at] = g["v"]
        return x

    def turned(p: Pass, x: np.ndarray, b: int) -> np.ndarray:
        """x in the order of the pass, with held beginnings."""
        if p.reverse:
            return x[:, ::-1]
        if p.hold and b == 0:
            x = x.copy()
            x[:, _REACH + 1 : _REACH + 3] = x[:, _REACH : _REACH + 1]
        return x

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        """For each line of a block: whether it has voxels, its last outputs from rest, and its first inputs if it begins one."""
        bu, bv, b = (int(g[c].iloc[0]) for c in ("bu", "bv", "b"))
        x = lines(g, bu, bv, b)
        rest, begin = [], []
        for p in passes:
            own, k = turned(p, x, b), len(p.back)
            y = p.run(own, np.zeros((len(x), k)))[:, ::-1][:, :k]
            rest.append(np.pad(y, ((0, 0), (0, k - y.shape[1]))))
            begin.append(own[:, _REACH : 2 * _REACH])
        there = np.flatnonzero((x != 0).any(1) | np.isin(np.arange(len(x)), (g[u].to_numpy() - bu * ACROSS) * ACROSS + g[v].to_numpy() - bv * ACROSS))
        return pd.DataFrame({"bu": bu, "bv": bv, "b": b, "line": there, "rest": [np.concatenate([r[i] for r in rest]) for i in there], "begin": [np.concatenate([s[i] for s in begin]) for i in there]})

    def states(g: pd.DataFrame) -> pd.DataFrame:
        """The outputs before each block's first, for all lines of a bundle: numbers of blocks, not voxels."""
        bu, bv = int(g["bu"].iloc[0]), int(g["bv"].iloc[0])
        names, where = np.unique(g["line"].to_numpy(), return_inverse=True)
        wide = sum(len(p.back) for p in passes)
        rest, begin = np.zeros((n_blocks, len(names), wide)), np.zeros((n_blocks, len(names), _REACH * len(passes)))
        at = (g["b"].to_numpy(), where)
        rest[at], begin[at] = np.stack(g["rest"].to_list()), np.stack(g["begin"].to_list())
        out, column = np.zeros_like(rest), 0
        for q, p in enumerate(passes):
            k = len(p.back)
            order = range(n_blocks - 1, -1, -1) if p.reverse else range(n_blocks)
            heads = begin[order[0], :, q * _REACH : (q + 1) * _REACH]
            if last - first + 1 < _REACH:  # what lies before a short line is held
                heads = heads.copy()
                heads[:, last - first + 1 :] = heads[:, last - first : last - first + 1]
            state = p.start(heads) if p.start else np.zeros((len(names), k))
            for b in order:
                out[b, :, column : column + k] = state
                length = min(LONG, last - first + 1 - b * LONG)
                state = state @ np.linalg.matrix_power(p.companion, length).T + rest[b, :, column : column + k]
            column += k
        b, i = np.divmod(np.arange(n_blocks * len(names)), len(names))
        return pd.DataFrame({"bu": bu, "bv": bv, "b": b, "line": names[i], "state": list(out.reshape(-1, wide))})

    def finished(key, g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        bu, bv, b = map(int, key)
        x = lines(g, bu, bv, b)[s["line"].to_numpy()] if len(s) else np.zeros((0, 2 * _REACH))
        if not len(s):
            return pd.DataFrame({c: [] for c in ("x", "y", "z", "v")})
        state, total, column = np.stack(s["state"].to_list()), 0.0, 0
        for p in passes:
            k = len(p.back)
            y = p.run(turned(p, x, b), state[:, column : column + k])
            total = total + (y[:, ::-1] if p.reverse else y)
            column += k
        i, j = np.indices(total.shape)
        line = s["line"].to_numpy()[i.ravel()]
        return pd.DataFrame({u: bu * ACROSS + line // ACROSS, v: bv * ACROSS + line % ACROSS, axis: first + b * LONG + j.ravel(), "v": total.ravel()})[["x", "y", "z", "v"]]

    rows = stored(rows)
    found = rows.groupBy("bu", "bv", "b").applyInPandas(ends, "bu long, bv long, b long, line long, rest array<double>, begin array<double>")
    states_of = found.groupBy("bu", "bv").applyInPandas(states, "bu long, bv long, b long, line long, state array<double>")
    return rows.groupBy("bu", "bv", "b").cogroup(states_of.groupBy("bu", "bv", "b")).applyInPandas(finished, "x long, y long, z long, v double")


def filtered(image: DataFrame, along: dict[str, list[list[Pass]]]) -> DataFrame:
    """x, y, z, v: an image (x, y, z, v; absent voxels are 0) filtered along each axis of `along` by the passes of deriche(),
    young() or exponential(), at all places of the image's bounding box on lines that have voxels.

    Each stage deals bricks twice by a shuffle; what goes along lines are a few numbers for every 64 voxels of them. Repeated
    places count with one value, the greatest; null values count as 0; no voxels, no voxels."""
    now = image.groupBy(*[F.col(c).cast("long").alias(c) for c in "xyz"]).agg(F.coalesce(F.max("v").cast("double"), F.lit(0.0)).alias("v"))
    bounds = image.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))]).collect()[0]
    if bounds["ax"] is None:
        return now
    low, high = ({c: int(bounds[f"{n}{c}"]) for c in "xyz"} for n in "ab")
    for axis, stages in along.items():
        for passes in stages:
            now = stored(_passed(now, axis, passes, low, high))
    return now


def smoothed(image: DataFrame, sigma: tuple[float, float, float], how: Callable[..., list] = deriche) -> DataFrame:
    """Gaussian smoothing; axes of sigma 0 are left alone."""
    return filtered(image, {c: how(s) for c, s in zip("xyz", sigma, strict=True) if s > 0})


def gradient_norm(image: DataFrame, sigma: float, how: Callable[..., list] = deriche) -> DataFrame:
    """x, y, z, v: the length of the gradient of a smoothed image."""
    parts: list[DataFrame] = []
    for axis in "xyz":
        d = filtered(image, {c: how(sigma, int(c == axis)) for c in "xyz"})
        parts.append(d.select("x", "y", "z", (F.col("v") * F.col("v")).alias("v")))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("x", "y", "z").agg(F.sqrt(F.sum("v")).alias("v"))


