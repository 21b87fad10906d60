"""Numpy kernels: arrays of images in, arrays out. Each works on (n, height, width)."""

import numpy as np


def centred_index(n: int) -> np.ndarray:
    """Frequencies of a centred spectrum of n samples."""
    return np.arange(n) - n // 2


def radius_bins(h: int, w: int) -> np.ndarray:
    """Bin floor(r + 0.5) of each place of a centred spectrum."""
    y, x = np.meshgrid(centred_index(h), centred_index(w), indexing="ij")
    return np.floor(np.hypot(y, x) + 0.5).astype(int)


def hann(h: int, w: int) -> np.ndarray:
    return np.outer(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(h) / h), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w) / w))


def power(a: np.ndarray, window: str = "none") -> np.ndarray:
    if window == "hann":
        a = a * hann(*a.shape[1:])
    f = np.fft.fft2(a)
    return np.fft.fftshift(f.real**2 + f.imag**2, axes=(1, 2))


def radial_mean(p: np.ndarray) -> np.ndarray:
    """The mean of each radius bin, laid back over the plane."""
    bins = radius_bins(*p.shape[1:])
    counts = np.bincount(bins.ravel())
    return np.stack([(np.bincount(bins.ravel(), q.ravel()) / counts)[bins] for q in p])


def spectral(a: np.ndarray, gain) -> np.ndarray:
    """Multiplies centred spectra by gain(power, bins) and transforms back."""
    f = np.fft.fftshift(np.fft.fft2(a), axes=(1, 2))
    g = gain(f.real**2 + f.imag**2)
    return np.fft.ifft2(np.fft.ifftshift(f * g, axes=(1, 2))).real


def wiener_gain(p: np.ndarray) -> np.ndarray:
    b = radial_mean(p)
    return np.where(p > 0, np.maximum(0, (p - b) / np.where(p > 0, p, 1)), 0)


def absf_gain(p: np.ndarray) -> np.ndarray:
    r, b = np.sqrt(p), np.sqrt(radial_mean(p))
    return np.where(r > 0, np.maximum(0, (r - b) / np.where(r > 0, r, 1)), 0)


def band_gain(h: int, w: int, lo: float, hi: float, soft: float) -> np.ndarray:
    y, x = np.meshgrid(centred_index(h), centred_index(w), indexing="ij")
    r = np.hypot(y, x)
    if soft <= 0:
        return ((r >= lo) & (r <= hi)).astype(float)
    return np.where(r < lo, np.exp(-(((lo - r) / soft) ** 2) / 2), np.where(r > hi, np.exp(-(((r - hi) / soft) ** 2) / 2), 1.0))


def ncc_shift(a: np.ndarray, b: np.ndarray, reach: int, upsample: bool | int = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shifts with b(y+dy, x+dx) like a(y, x) by normalised cross-correlation over the overlap; a constant overlap has no score (NaN).

    upsample True: the vertex of a parabola through the scores; a number above 1: to 1 / upsample of a pixel (`upsampled`).
    """
    n, h, w = a.shape
    steps = range(-reach, reach + 1)
    scores = np.full((n, 2 * reach + 1, 2 * reach + 1), np.nan)
    for i, dy in enumerate(steps):
        for j, dx in enumerate(steps):
            p = a[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)].reshape(n, -1)
            q = b[:, max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)].reshape(n, -1)
            ok = ~(np.isnan(p) | np.isnan(q))
            m = np.maximum(ok.sum(1), 1)
            p, q = np.where(ok, p, 0), np.where(ok, q, 0)
            sp, sq = p.sum(1) / m, q.sum(1) / m
            cov, vp, vq = (p * q).sum(1) / m - sp * sq, (p * p).sum(1) / m - sp * sp, (q * q).sum(1) / m - sq * sq
            good = (vp > 1e-12) & (vq > 1e-12)
            scores[good, i, j] = cov[good] / np.sqrt(vp[good] * vq[good])
    flat = np.where(np.isnan(scores), -np.inf, np.round(scores, 9)).reshape(n, -1)  # ties: first dy, then dx
    best = flat.argmax(1)
    dy, dx = (best // (2 * reach + 1) - reach).astype(float), (best % (2 * reach + 1) - reach).astype(float)
    score = scores.reshape(n, -1)[np.arange(n), best]
    if upsample is not True and upsample > 1:
        found = np.flatnonzero(~np.isnan(score))
        if len(found):
            dy[found], dx[found] = upsampled(a[found], b[found], dy[found], dx[found], int(upsample))
    elif upsample:
        for k in range(n):
            i, j = divmod(int(best[k]), 2 * reach + 1)
            dy[k] += _vertex(scores[k, :, j], i)
            dx[k] += _vertex(scores[k, i, :], j)
    return dy, dx, score


def upsampled(a: np.ndarray, b: np.ndarray, dy: np.ndarray, dx: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Shifts refined to 1 / factor of a pixel: the cross-correlation at steps of 1 / factor within 1.5 pixels of (dy, dx), by two matrix products of Fourier sums (Guizar-Sicairos, Thurman and Fienup 2008), so that no upsampled image is made. Frames count as periodic; NaN as the frame's mean."""
    f = []
    for v in (a, b):
        mean = np.nanmean(v, axis=(1, 2), keepdims=True)
        f.append(np.fft.fft2(np.where(np.isnan(v), mean, v) - mean))
    cross = np.conj(f[0]) * f[1]
    steps = np.arange(-(3 * factor // 2), 3 * factor // 2 + 1) / factor
    sy, sx = dy[:, None] + steps, dx[:, None] + steps
    rows = np.exp(2j * np.pi * sy[:, :, None] * np.fft.fftfreq(a.shape[1])[None, None, :])
    columns = np.exp(2j * np.pi * np.fft.fftfreq(a.shape[2])[None, :, None] * sx[:, None, :])
    values = (rows @ cross @ columns).real.reshape(len(a), -1)
    top = np.abs(values).max(1, keepdims=True)
    best = np.round(values / np.where(top > 0, top, 1), 9).argmax(1)  # ties: first dy, then dx
    k = np.arange(len(a))
    return sy[k, best // len(steps)], sx[k, best % len(steps)]


def _vertex(row: np.ndarray, i: int) -> float:
    """Offset of a parabola's peak through three scores."""
    if i in (0, len(row) - 1) or not np.isfinite(row[i - 1 : i + 2]).all():
        return 0.0
    a, b, c = row[i - 1 : i + 2]
    return 0.0 if a - 2 * b + c == 0 else float(0.5 * (a - c) / (a - 2 * b + c))


def shifted(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """out(y, x) = a(y + dy, x + dx), bilinear between pixels, NaN outside."""
    h, w = a.shape
    y0, x0 = int(np.floor(dy)), int(np.floor(dx))
    fy, fx = dy - y0, dx - x0

    def at(oy: int, ox: int) -> np.ndarray:
        out = np.full((h, w), np.nan)
        ys, xs = slice(max(0, -oy), min(h, h - oy)), slice(max(0, -ox), min(w, w - ox))
        if ys.start < ys.stop and xs.start < xs.stop:
            out[ys, xs] = a[ys.start + oy : ys.stop + oy, xs.start + ox : xs.stop + ox]
        return out

    out = at(y0, x0) * (1 - fy) * (1 - fx)
    for wy, wx, oy, ox in (((1 - fy), fx, y0, x0 + 1), (fy, 1 - fx, y0 + 1, x0), (fy, fx, y0 + 1, x0 + 1)):
        if wy * wx:
            out = out + wy * wx * at(oy, ox)
    return out


def reflect(i: np.ndarray, n: int) -> np.ndarray:
    """Indices mirrored at the edges, the edge pixel repeated."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def neighbourhood(a: np.ndarray, r: int) -> np.ndarray:
    """(n, h, w, (2r+1)^2) values around each pixel, edges reflected."""
    n, h, w = a.shape
    ys, xs = reflect(np.arange(-r, h + r), h), reflect(np.arange(-r, w + r), w)
    wide = a[:, ys][:, :, xs]
    return np.lib.stride_tricks.sliding_window_view(wide, (2 * r + 1, 2 * r + 1), axis=(1, 2)).reshape(n, h, w, -1)


def spatial(a: np.ndarray, kind: str, r: int) -> np.ndarray:
    around = neighbourhood(a, r)
    if kind == "mean":
        return np.nanmean(around, 3)
    if kind == "median":
        return np.nanmedian(around, 3)
    k = np.arange(-r, r + 1)
    g = np.exp(-(k**2) / (2 * (r / 2 or 1) ** 2))
    g = np.outer(g, g).ravel() / g.sum() ** 2
    soft = (around * g).sum(3)
    if kind == "gauss":
        return soft
    if kind == "sharpen":
        return 2 * a - soft
    raise ValueError(f"unknown filter {kind}")


def peaks(a: np.ndarray, radius: int, threshold: float, border: int) -> list[np.ndarray]:
    """Places of pixels above threshold that exceed all others within `radius` rows and columns; of a plateau, the first in (y, x)."""
    n, h, w = a.shape
    wide = np.full((n, h + 2 * radius, w + 2 * radius), -np.inf)
    wide[:, radius : radius + h, radius : radius + w] = np.where(np.isnan(a), -np.inf, a)
    ok = a > threshold
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy or dx:
                other = wide[:, radius + dy : radius + dy + h, radius + dx : radius + dx + w]
                ok &= (a > other) if (dy, dx) < (0, 0) else (a >= other)
    if border:
        inside = np.zeros((h, w), bool)
        inside[border : h - border, border : w - border] = True
        ok &= inside
    return [np.argwhere(k) for k in ok]


def centroids(a: np.ndarray, y: float, x: float, r: int) -> np.ndarray:
    """Intensity-weighted centre (n, 2) of the window of each image around the pixel nearest (y, x), its minimum taken off; (y, x) itself where nothing is left."""
    cy, cx = int(np.floor(y + 0.5)), int(np.floor(x + 0.5))
    ys, xs = np.arange(max(0, cy - r), min(a.shape[1], cy + r + 1)), np.arange(max(0, cx - r), min(a.shape[2], cx + r + 1))
    v = a[:, ys[:, None], xs]
    some = ~np.isnan(v)
    low = np.where(some, v, np.inf).min((1, 2), initial=np.inf, keepdims=True)
    v = np.where(some, v - np.where(np.isfinite(low), low, 0), 0)
    total = v.sum((1, 2))
    safe = np.where(total > 0, total, 1)
    found = np.stack([(v.sum(2) * ys).sum(1) / safe, (v.sum(1) * xs).sum(1) / safe], 1)
    return np.where(total[:, None] > 0, found, [float(y), float(x)])


def demodulate(a: np.ndarray, gy: float, gx: float, sigma: float) -> np.ndarray:
    """Complex amplitude of the frequency (gy, gx), in cycles a pixel, smoothed by a Gaussian of `sigma` pixels (none at 0)."""
    n, h, w = a.shape
    y, x = np.mgrid[0:h, 0:w]
    z = a * np.exp(-2j * np.pi * (gy * y + gx * x))
    if sigma <= 0:
        return z
    fy, fx = np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :]
    return np.fft.ifft2(np.fft.fft2(z) * np.exp(-2 * np.pi**2 * sigma**2 * (fy**2 + fx**2)))


def phase_gradient(phase: np.ndarray, axis: int) -> np.ndarray:
    """Gradient of a wrapped phase from ratios of neighbours, one-sided at the edges."""
    z = np.exp(1j * phase)
    n = phase.shape[axis]
    nxt, prv = np.take(z, np.minimum(np.arange(n) + 1, n - 1), axis), np.take(z, np.maximum(np.arange(n) - 1, 0), axis)
    step = np.minimum(np.arange(n) + 1, n - 1) - np.maximum(np.arange(n) - 1, 0)
    shape = [1] * phase.ndim
    shape[axis] = n
    return np.angle(nxt * np.conj(prv)) / step.reshape(shape)


class SortedWindow:
    """The values of a sliding window at each of n places in order of size, at most `most` a place; NaN does not count. A value comes or goes by one shift of the values above it, so that nothing is sorted again."""

    def __init__(self, most: int, n: int):
        self.held, self.count = np.full((most + 1, n), np.inf), np.zeros(n, int)  # beyond the count: infinite, as the last row always is
        self.row = np.arange(most + 1)[:, None]

    def add(self, v: np.ndarray) -> None:
        some = ~np.isnan(v)
        at = np.where(some, (self.held < np.where(some, v, 0)).sum(0), len(self.held))
        above = np.concatenate([self.held[:1], self.held[:-1]])
        self.held = np.where(self.row < at, self.held, np.where(self.row == at, v, above))
        self.count += some

    def remove(self, v: np.ndarray) -> None:
        some = ~np.isnan(v)
        at = np.where(some, (self.held < np.where(some, v, 0)).sum(0), len(self.held))
        below = np.concatenate([self.held[1:], np.full_like(self.held[:1], np.inf)])
        self.held = np.where(self.row < at, self.held, below)
        self.count -= some

    def value(self) -> np.ndarray:
        """The median, NaN where nothing counts."""
        low, high = (np.take_along_axis(self.held, np.maximum(k, 0)[None], 0)[0] for k in ((self.count - 1) // 2, self.count // 2))
        with np.errstate(invalid="ignore"):
            return np.where(self.count > 0, np.where(low == high, low, low + (high - low) / 2), np.nan)


class SummedWindow:
    """The values of a sliding window at each place, and their mean; NaN does not count."""

    def __init__(self):
        self.held: list[np.ndarray] = []

    def add(self, v: np.ndarray) -> None:
        self.held.append(v)

    def remove(self, v: np.ndarray) -> None:
        self.held.pop(0)  # the oldest leaves first; sums are made anew, as differences of sums would drift

    def value(self) -> np.ndarray:
        a = np.stack(self.held)
        some = ~np.isnan(a)
        n = some.sum(0)
        return np.where(n > 0, np.where(some, a, 0).sum(0) / np.maximum(n, 1), np.nan)


def components_of(mask: np.ndarray, eight: bool) -> np.ndarray:
    """Labels of the connected regions of one mask: the least y * width + x in each; -1 outside.

    Rows are taken as runs of set pixels; runs that touch the row above are edges, and edges join the runs'
    roots, always the earlier run, until every edge lies within one region.
    """
    h, w = mask.shape
    wide = w + 2
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, x0), x1 = np.nonzero(step == 1), np.nonzero(step == -1)[1]
    begin, end, slack = row * wide + x0, row * wide + x1, int(eight)
    first, last = np.searchsorted(end, begin - wide - slack, "right"), np.searchsorted(begin, end - wide + slack)
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    root = np.arange(len(row))
    while len(a):
        p, q = root[a], root[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
    out = np.full(h * w, -1)
    size = x1 - x0
    at = np.repeat(row * w + x0 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[at] = np.repeat((row * w + x0)[root], size)
    return out.reshape(h, w)
