"""Kernels over whole rasters and tiles: numpy only."""

from __future__ import annotations

import numpy as np


#: Patch samples that one batched transform takes.
AT_ONCE = 1 << 22


def goldstein(z: np.ndarray, corr: np.ndarray, size: int = 32, threshold: float = 0.5) -> np.ndarray:
    """Adaptive spectral filter of an interferogram (Goldstein and Werner, 1998, with a local exponent).

    The plane is covered by half-overlapping patches, which are windows of one
    padded array; a row of them is transformed at once. A patch's spectrum is
    raised in proportion to its magnitude to the power 1 - c, c the patch's mean
    correlation, and patches are blended by a triangle. Missing (NaN) pixels
    stay missing; a patch needs a share of ``threshold`` valid pixels.
    """
    ny, nx = z.shape
    half = size // 2
    valid = np.isfinite(z)
    grow = tuple((0, size - half + (half - n % half) % half) for n in (ny, nx))
    parts = [np.pad(x, grow) for x in (np.where(valid, z, 0), np.where(np.isfinite(corr), corr, 0.0), valid)]
    side = np.minimum(np.arange(size), np.arange(size)[::-1]) / max(half - 1, 1)  # a triangle, 0 at the edges and 1 in the middle
    taper = side[:, None] * side[None, :]
    data, coh, full = (np.lib.stride_tricks.sliding_window_view(x, (size, size))[::half, ::half] for x in parts)
    total, blend = np.zeros(parts[0].shape, complex), np.zeros(parts[0].shape)
    rows = max(1, AT_ONCE // (data.shape[1] * size * size))
    for top in range(0, data.shape[0], rows):
        some = np.s_[top : top + rows]
        use = full[some].sum((2, 3)) >= int(size * size * threshold)
        sharp = 1 - np.tensordot(coh[some], taper, 2) / taper.sum()
        spectrum = np.fft.fft2(data[some])
        smooth = np.fft.ifft2(spectrum * np.maximum(np.abs(spectrum), 1e-10) ** sharp[..., None, None])
        for i, j in zip(*np.nonzero(use), strict=True):  # what is left is the overlap-add
            at = np.s_[(top + i) * half : (top + i) * half + size, j * half : j * half + size]
            total[at] += smooth[i, j] * taper
            blend[at] += taper
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(blend > 1e-6, total / blend, np.nan)[:ny, :nx]
    return np.where(valid, out, np.nan)


def dct2(x: np.ndarray, axis: int) -> np.ndarray:
    """DCT-II by one real FFT of the mirrored signal."""
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    f = np.fft.rfft(np.concatenate([x, x[..., ::-1]], -1))[..., :n]
    return np.moveaxis((f * np.exp(-0.5j * np.pi * np.arange(n) / n)).real, -1, axis)


def idct2(y: np.ndarray, axis: int) -> np.ndarray:
    """Inverse of ``dct2``."""
    y = np.moveaxis(y, axis, -1)
    n = y.shape[-1]
    f = np.concatenate([y * np.exp(0.5j * np.pi * np.arange(n) / n), np.zeros((*y.shape[:-1], 1))], -1)
    return np.moveaxis(np.fft.irfft(f, 2 * n)[..., :n], -1, axis)


def poisson(rhs: np.ndarray) -> np.ndarray:
    """Solution of the discrete Laplace equation with Neumann edges and mean 0."""
    ny, nx = rhs.shape
    d = 2 * (np.cos(np.pi * np.arange(ny) / ny)[:, None] + np.cos(np.pi * np.arange(nx) / nx) - 2)
    d[0, 0] = 1
    f = dct2(dct2(rhs, 0), 1) / d
    f[0, 0] = 0
    return idct2(idct2(f, 0), 1)


def wrap(x: np.ndarray) -> np.ndarray:
    return np.arctan2(np.sin(x), np.cos(x))


def components(ok: np.ndarray) -> np.ndarray:
    """4-connected labels by size (1 the largest, 0 invalid): minimum labels spread along runs."""
    lab = np.where(ok, np.arange(1, ok.size + 1).reshape(ok.shape), 0)
    big = ok.size + 1
    while True:
        new = np.where(ok, lab, big)
        for axis in (0, 1):
            for flip in (False, True):
                v = np.flip(new, axis) if flip else new
                m = np.flip(ok, axis) if flip else ok
                seg = np.cumsum(~m, axis=axis)  # a run of valid pixels has one value
                key = v - seg * (big + 1)
                run = np.minimum.accumulate(key, axis=axis) + seg * (big + 1)
                v = np.where(m, np.minimum(v, run), big)
                new = np.flip(v, axis) if flip else v
        new = np.where(ok, new, 0)
        if (new == lab).all():
            break
        lab = new
    ids, inv, n = np.unique(lab, return_inverse=True, return_counts=True)
    rank = np.zeros(len(ids), np.int64)
    some = np.flatnonzero(ids > 0)
    rank[some[np.lexsort((ids[some], -n[some]))]] = np.arange(1, len(some) + 1)
    return rank[inv].reshape(lab.shape)


#: Pixels of a raster up to which least squares are solved by elimination.
DIRECT = 640


class Direct:
    """Least squares over the edges of a small raster: one pixel of each component is held, then components keep their means."""

    def __init__(self, lab: np.ndarray):
        ids = np.arange(lab.size).reshape(lab.shape)
        flat = lab.ravel()
        self.of = flat[flat > 0]
        self.at = np.flatnonzero(flat)
        new = np.zeros(lab.size, np.int64)
        new[self.at] = np.arange(len(self.at))
        ends = [(ids[:-1].ravel(), ids[1:].ravel()), (ids[:, :-1].ravel(), ids[:, 1:].ravel())]
        self.use = [(flat[i] > 0) & (flat[j] > 0) for i, j in ends]
        self.i, self.j = (np.concatenate([new[e[k][u]] for e, u in zip(ends, self.use, strict=True)]) for k in (0, 1))
        self.held = np.unique(self.of, return_index=True)[1]
        self.n = np.bincount(self.of)

    def solve(self, ay: np.ndarray, ax: np.ndarray, r: np.ndarray) -> np.ndarray:
        w = np.concatenate([a.ravel()[u] for a, u in zip((ay, ax), self.use, strict=True)])
        n = len(self.at)
        m = np.zeros((n, n))
        m[self.i, self.j] = m[self.j, self.i] = -w
        m[np.arange(n), np.arange(n)] = np.bincount(self.i, w, n) + np.bincount(self.j, w, n)
        b = r.ravel()[self.at]
        m[self.held] = 0
        m[self.held, self.held] = 1
        b[self.held] = 0
        x = np.linalg.solve(m, b)
        x -= (np.bincount(self.of, x) / np.maximum(self.n, 1))[self.of]
        out = np.zeros(r.size)
        out[self.at] = x
        return out.reshape(r.shape)


def unwrap(phase: np.ndarray, weight: np.ndarray | None = None, iterations: int = 30, eps: float = 1e-2, cg: int = 60) -> np.ndarray:
    """Spatial unwrapping: minimum of sum w |grad u - wrapped grad phase|, then phase + 2 pi k.

    An unweighted Poisson solution starts; reweighted least squares follow,
    each solved by conjugate gradients with the Poisson solver as
    preconditioner, or directly in rasters of at most DIRECT pixels. Every
    component gets the integer that fits its median.
    """
    ok = np.isfinite(phase)
    if not ok.any():
        return np.full(phase.shape, np.nan)
    p = np.where(ok, phase, 0.0)
    w = np.where(ok, np.clip(np.where(np.isfinite(weight), weight, 0.01) if weight is not None else 1.0, 0.01, 1.0), 0.0)
    gy, gx = wrap(np.diff(p, axis=0)), wrap(np.diff(p, axis=1))
    wy = np.where(ok[1:] & ok[:-1], (w[1:] + w[:-1]) / 2, 0.0)
    wx = np.where(ok[:, 1:] & ok[:, :-1], (w[:, 1:] + w[:, :-1]) / 2, 0.0)

    def div(fy: np.ndarray, fx: np.ndarray) -> np.ndarray:
        out = np.zeros(p.shape)
        out[:-1] += fy
        out[1:] -= fy
        out[:, :-1] += fx
        out[:, 1:] -= fx
        return out

    def cost(u: np.ndarray) -> float:
        return float((wy * np.abs(np.diff(u, axis=0) - gy)).sum() + (wx * np.abs(np.diff(u, axis=1) - gx)).sum())

    lab = components(ok)
    direct = Direct(lab) if ok.size <= DIRECT else None
    u = poisson(div(np.where(wy > 0, gy, 0), np.where(wx > 0, gx, 0)))
    best, least = u, cost(u)
    for _ in range(iterations):
        ay = wy / np.sqrt((np.diff(u, axis=0) - gy) ** 2 + eps**2)
        ax = wx / np.sqrt((np.diff(u, axis=1) - gx) ** 2 + eps**2)
        scale = max(np.median(np.concatenate([ay[wy > 0], ax[wx > 0]])) if (wy > 0).any() or (wx > 0).any() else 1.0, 1e-6)
        ay, ax = np.clip(ay / scale, 0, 1e4), np.clip(ax / scale, 0, 1e4)
        apply = lambda v: -div(ay * np.diff(v, axis=0), ax * np.diff(v, axis=1))  # noqa: B023, E731
        r = -div(ay * gy, ax * gx) - apply(u)
        if direct:
            x = u + direct.solve(ay, ax, r)
        else:
            x, z = u.copy(), -poisson(r)
            d, rz, r0 = z.copy(), float((r * z).sum()), float((r * r).sum())
        for _ in range(0 if direct else cg):
            if rz <= 0 or float((r * r).sum()) < 1e-10 * max(r0, 1e-30):
                break
            q = apply(d)
            a = rz / max(float((d * q).sum()), 1e-30)
            x += a * d
            r -= a * q
            z = -poisson(r)
            new = float((r * z).sum())
            d, rz = z + new / rz * d, new
        now = cost(x)
        gone = np.abs(x - u).max()
        u = x
        if now < least * (1 - 1e-6):
            best, least = x, now
        elif now > least * 1.05 or gone < 1e-3:
            break
    u = best
    out = np.full(p.shape, np.nan)
    for k in range(1, lab.max() + 1):
        m = lab == k
        shift = np.median(wrap(p[m] - u[m] - np.median(wrap(p[m] - u[m]))))
        base = u[m] + np.median(wrap(p[m] - u[m])) + shift
        out[m] = p[m] + 2 * np.pi * np.round((base - p[m]) / (2 * np.pi))
    return out


def link(unwrapped: np.ndarray, size: int = 4, gap: float | None = None, window: int = 5, neighbours: int = 30) -> np.ndarray:
    """Shift whole components by 2 pi k so that neighbours agree across gaps.

    Candidate links join each component to its nearest others at the closest
    pixels; the integer is the rounded difference of the means in a window,
    its confidence 1 - 2 |fraction|. Integers come from a maximum spanning
    tree of the links and are then improved one component at a time; this is
    an approximation to the integer program over all links.
    """
    lab = components(np.isfinite(unwrapped))
    n = lab.max()
    out = unwrapped.copy()
    count = np.bincount(lab.ravel(), minlength=n + 1)
    for k in range(1, n + 1):
        if count[k] < max(size, 4):
            out[lab == k] = np.nan
    use = [k for k in range(1, n + 1) if count[k] >= max(size, 4)]
    edge = {k: _border(lab == k) for k in use}
    links, h = [], window // 2
    for i, a in enumerate(use):
        near = []
        for b in use[i + 1 :]:
            d2 = ((edge[a][:, None, :] - edge[b][None, :, :]) ** 2).sum(-1)
            at = np.unravel_index(d2.argmin(), d2.shape)
            near.append((d2[at], b, edge[a][at[0]], edge[b][at[1]]))
        for d2, b, pa, pb in sorted(near, key=lambda x: x[:2])[:neighbours]:
            dist = float(np.sqrt(d2))
            if gap is not None and dist > gap:
                continue
            mean = lambda p, k: np.nanmean(np.where(lab[y := slice(max(p[0] - h, 0), p[0] + h + 1), x := slice(max(p[1] - h, 0), p[1] + h + 1)] == k, unwrapped[y, x], np.nan))
            cycles = (mean(pa, a) - mean(pb, b)) / (2 * np.pi)
            whole = np.round(cycles)
            conf = 1 - 2 * abs(cycles - whole)
            links.append((conf * np.sqrt(min(count[a], count[b])) / (np.sqrt(dist) + 1), a, b, int(whole)))
    k = {use[0]: 0} if use else {}
    while True:
        grow = [x for x in links if (x[1] in k) != (x[2] in k)]
        if not grow:
            rest = [c for c in use if c not in k]
            if not rest:
                break
            k[rest[0]] = 0
            continue
        _, a, b, m = max(grow)
        if a in k:
            k[b] = k[a] + m
        else:
            k[a] = k[b] - m
    for _ in range(20):
        moved = False
        for c in use[1:]:
            votes: dict[int, float] = {}
            for w, a, b, m in links:
                if c in (a, b):
                    v = k[a] + m if c == b else k[b] - m
                    votes[v] = votes.get(v, 0) + w
            if votes:
                cost = {v: sum(w * abs((k[a] + m - v) if c == b else (v + m - k[b])) for w, a, b, m in links if c in (a, b)) for v in {*votes, k[c]}}
                v = min(cost, key=lambda v: (cost[v], abs(v - k[c])))
                moved |= v != k[c]
                k[c] = v
        if not moved:
            break
    for c, m in k.items():
        out[lab == c] += 2 * np.pi * m
    return out


def _border(m: np.ndarray) -> np.ndarray:
    """Pixels of a mask with a neighbour outside it."""
    p = np.pad(m, 1)
    inner = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return np.argwhere(m & ~inner)


def hough(mask: np.ndarray, angles: int = 180, votes: int = 50) -> tuple[float, float, int] | None:
    """Strongest straight line (rho, theta, votes) through a mask's pixels."""
    y, x = np.nonzero(mask)
    if not len(y):
        return None
    theta = np.pi * np.arange(angles) / angles
    rho = np.round(x[:, None] * np.cos(theta) + y[:, None] * np.sin(theta)).astype(int)
    low = rho.min()
    acc = np.zeros((rho.max() - low + 1, angles), int)
    np.add.at(acc, (rho - low, np.broadcast_to(np.arange(angles), rho.shape)), 1)
    at = np.unravel_index(acc.argmax(), acc.shape)
    return (float(at[0] + low), float(theta[at[1]]), int(acc[at])) if acc[at] >= votes else None


def discontinuity(phase: np.ndarray, limit: float = 2.0, width: int = 3, votes: int = 50) -> np.ndarray:
    """True outside a band around the strongest line of large wrapped gradients."""
    g = np.zeros(phase.shape)
    g[:-1] = np.nan_to_num(np.abs(wrap(np.diff(phase, axis=0))))
    g[:, :-1] = np.hypot(g[:, :-1], np.nan_to_num(wrap(np.diff(phase, axis=1))))
    line = hough(g > limit, votes=votes)
    if line is None:
        return np.ones(phase.shape, bool)
    y, x = np.indices(phase.shape)
    return np.abs(x * np.cos(line[1]) + y * np.sin(line[1]) - line[0]) > width


def phase_correlation(a: np.ndarray, b: np.ndarray, min_valid: float = 0.5, min_response: float = 0.2) -> tuple[float, float, float] | None:
    """Shift (dy, dx) of b against a and its response, by the normalised cross spectrum with a Hann window."""
    ok = np.isfinite(a) & np.isfinite(b)
    if ok.mean() < min_valid:
        return None
    win = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    norm = lambda v: np.where(ok, (v - v[ok].mean()) / (v[ok].std() + 1e-12), 0) * win
    f = np.fft.fft2(norm(b)) * np.conj(np.fft.fft2(norm(a)))
    c = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    at = np.unravel_index(c.argmax(), c.shape)
    near = [(at[0] + i) % c.shape[0] for i in (-1, 0, 1)], [(at[1] + i) % c.shape[1] for i in (-1, 0, 1)]
    box = np.maximum(c[np.ix_(*near)], 0)
    response = float(box.sum())
    if response < min_response:
        return None
    dy, dx = (box.sum(1) @ [-1, 0, 1]) / response, (box.sum(0) @ [-1, 0, 1]) / response
    fold = lambda v, n: v - n if v > n / 2 else v
    return float(fold(at[0] + dy, c.shape[0])), float(fold(at[1] + dx, c.shape[1])), response
