"""Range-Doppler geometry: when and how far an orbit sees a ground point, and back."""

from __future__ import annotations

import numpy as np

A, B = 6378137.0, 6356752.31424518


def hermite(t: np.ndarray, p: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and velocity at times ``at`` from states (n,), (n, 3), (n, 3)."""
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = (t[i + 1] - t[i])[:, None]
    u = ((at - t[i])[:, None]) / h
    pos = (1 + 2 * u) * (1 - u) ** 2 * p[i] + u * (1 - u) ** 2 * h * v[i] + u * u * (3 - 2 * u) * p[i + 1] + u * u * (u - 1) * h * v[i + 1]
    vel = (6 * u * u - 6 * u) / h * (p[i] - p[i + 1]) + (1 - 4 * u + 3 * u * u) * v[i] + (3 * u * u - 2 * u) * v[i + 1]
    return pos, vel


def see(t: np.ndarray, p: np.ndarray, v: np.ndarray, ground: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Zero-Doppler time and slant range of ground points (m, 3); NaN where the orbit does not pass them.

    Secant steps on the velocity's part along the sight, for all points at once.
    """
    f = lambda x: (lambda s: ((ground - s[0]) * s[1]).sum(1))(hermite(t, p, v, x))
    a, b = np.full(len(ground), t[0]), np.full(len(ground), t[-1])
    fa, fb = f(a), f(b)
    good = fa * fb <= 0
    for _ in range(rounds):
        x = np.where(np.abs(fb - fa) > 0, b - fb * (b - a) / np.where(fb == fa, 1, fb - fa), (a + b) / 2)
        mid = (a + b) / 2
        x = np.where((x > np.minimum(a, b)) & (x < np.maximum(a, b)), x, mid)
        for y in (x, None):  # a secant point, then the middle of what is left: the bracket at least halves
            y = (a + b) / 2 if y is None else y
            fy = f(y)
            left = fa * fy <= 0
            b, fb = np.where(left, y, b), np.where(left, fy, fb)
            a, fa = np.where(left, a, y), np.where(left, fa, fy)
    x = np.where(np.abs(fa) < np.abs(fb), a, b)
    r = np.linalg.norm(ground - hermite(t, p, v, x)[0], axis=1)
    return np.where(good, x, np.nan), np.where(good, r, np.nan)


def locate(pos: np.ndarray, vel: np.ndarray, rng: np.ndarray, height: np.ndarray, right: bool = True, rounds: int = 20) -> np.ndarray:
    """Ground points (m, 3) at zero Doppler, slant range and ellipsoidal height, on one side of the track.

    Newton on the three conditions, from the spherical solution.
    """
    r = np.linalg.norm(pos, axis=1)
    up = pos / r[:, None]
    along = vel - (vel * up).sum(1)[:, None] * up
    along /= np.linalg.norm(along, axis=1)[:, None]
    side = np.cross(along, up) * (1.0 if right else -1.0)
    earth = A - 10_000 + height
    c = np.clip((rng**2 + r**2 - earth**2) / (2 * rng * r), -1, 1)
    x = pos - (rng * c)[:, None] * up + (rng * np.sqrt(1 - c * c))[:, None] * side
    for _ in range(rounds):
        d = x - pos
        ea, eb = A + height, B + height
        g = np.stack([(d * vel).sum(1), (d * d).sum(1) - rng**2, (x[:, 0] ** 2 + x[:, 1] ** 2) / ea**2 + x[:, 2] ** 2 / eb**2 - 1], 1)
        j = np.stack([vel, 2 * d, 2 * x / np.stack([ea**2, ea**2, eb**2], 1)], 1)
        x = x - np.linalg.solve(j, g[..., None])[..., 0]
    return x
