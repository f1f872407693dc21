"""Moments and slopes over what follows a place, added up term by term in order, so ties with a threshold fall as they do in SQL.

The last bit of a floating slope depends on the order of the terms and on which products are fused into sums. DuckDB takes the terms as they come, and its
covariance fuses ``co_moment + dx * (y - mean)`` into one rounding; these sums do the same, all places a step at a time.
"""

from __future__ import annotations

import numpy as np


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what rounding left."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b rounded, and what rounding left."""
    p = a * b
    x, y = 134217729.0 * a, 134217729.0 * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c rounded once: the small parts are added to odd, so the last sum rounds as if it had them all."""
    ph, pl = two_product(a, b)
    uh, ul = two_sum(c, pl)
    th, tl = two_sum(ph, uh)
    v, e = two_sum(tl, ul)
    even = (e != 0) & (v.view(np.int64) & 1 == 0)
    return th + np.where(even, np.nextafter(v, np.copysign(np.inf, e)), v)


def following(s: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Of the ``n`` values of ``s`` from each ``start`` on: mean, sample and population deviation, and slope on their places 1, 2, ...; NaN values are missing."""
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    c, total, mx, my, xy, xx, yy = (np.zeros(len(n)) for _ in range(7))
    gaps = bool(np.isnan(s).any())
    with np.errstate(all="ignore"):
        for i in range(1, int(n.max(initial=0)) + 1):
            at = slice(0, int(np.searchsorted(-n, -i, "right")))
            y = s[start[at] + (i - 1)]
            if gaps:
                at = np.flatnonzero(~np.isnan(y))
                y = y[at]
            k = c[at] + 1
            dx, dy = i - mx[at], y - my[at]
            x1, y1 = mx[at] + dx / k, my[at] + dy / k
            xy[at] = fused(dx, y - y1, xy[at])
            xx[at] += (i - x1) * dx
            yy[at] += (y - y1) * dy
            c[at], mx[at], my[at] = k, x1, y1
            total[at] += y
        var = xx / c
        out = {
            "mean": total / c, "sd": np.where(c > 1, np.sqrt(yy / (c - 1)), np.nan), "sp": np.where(c > 0, np.sqrt(yy / c), np.nan),
            "slope": np.where(var != 0, (xy / c) / var, np.nan),
        }
    back = np.empty(len(n), dtype=np.int64)
    back[order] = np.arange(len(n))
    return {name: x[back] for name, x in out.items()}
