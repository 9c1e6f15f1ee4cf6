"""Seasonal-trend decomposition by local regression, for many series at once."""

from __future__ import annotations

import numpy as np


def loess(y: np.ndarray, span: int, w: np.ndarray | None = None, extend: int = 0) -> np.ndarray:
    """Local lines with tricube weights along the last axis, ``extend`` points beyond each end."""
    n = y.shape[-1]
    x = np.arange(n, dtype=float)
    w = np.ones_like(y) if w is None else w
    out = np.empty((*y.shape[:-1], n + 2 * extend))
    q = min(span, n)
    for k, at in enumerate(range(-extend, n + extend)):
        dist = np.abs(x - at)
        near = np.sort(dist)[q - 1] * (span / n if span > n else 1)
        t = np.where(dist <= 0.999 * near + 1e-12, (1 - np.clip(dist / max(near, 1e-12), 0, 1) ** 3) ** 3, 0.0)
        v = w * t
        s = v.sum(-1) + 1e-300
        mx, my = (v * x).sum(-1) / s, (v * y).sum(-1) / s
        dx = x - mx[..., None]
        var = (v * dx * dx).sum(-1)
        slope = np.where(var > 1e-12, (v * dx * y).sum(-1) / np.maximum(var, 1e-12), 0.0)
        out[..., k] = my + slope * (at - mx)
    return out


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    c = np.concatenate([np.zeros((*y.shape[:-1], 1)), np.cumsum(y, -1)], -1)
    return (c[..., n:] - c[..., :-n]) / n


def decompose(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trend, seasonal, residual of series along the last axis; a series with a NaN is NaN throughout."""
    n = y.shape[-1]
    bad = ~np.isfinite(y).all(-1)
    v = np.where(bad[..., None], 0.0, y)
    odd = lambda k: int(k) + (int(k) + 1) % 2
    span_t = odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    span_l = odd(period)
    trend, w = np.zeros_like(v), np.ones_like(v)
    inner, outer = (2, 15) if robust else (5, 0)
    season = np.zeros_like(v)
    for o in range(outer + 1):
        for _ in range(inner):
            d = v - trend
            cyc = np.empty((*v.shape[:-1], n + 2 * period))
            for p in range(period):
                sub = d[..., p::period]
                if sub.shape[-1] == 0:
                    cyc[..., p::period] = 0
                    continue
                s = loess(sub, seasonal, w[..., p::period], extend=1)
                cyc[..., p : p + period * s.shape[-1] : period] = s
            low = loess(_moving(_moving(_moving(cyc, period), period), 3), span_l)
            season = cyc[..., period : period + n] - low[..., :n]
            trend = loess(v - season, span_t, w)
        if o < outer:
            r = np.abs(v - season - trend)
            h = 6 * np.median(r, -1, keepdims=True) + 1e-300
            w = np.clip(1 - np.clip(r / h, 0, 1) ** 2, 0, 1) ** 2
    out = (trend, season, v - trend - season)
    for a in out:
        a[bad] = np.nan
    return out
