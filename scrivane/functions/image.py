"""Numeric features of an image: 81 numbers in seven groups, from one gray plane that is computed once.

Images are height x width x 3 arrays of uint8, red first. Borders repeat the edge pixel unless a feature looks at interior pixels
only. A caller may ask for some groups; the others, of which the shadow group is by far the slowest, aren't computed.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np

GROUPS = {"color": 19, "edges": 15, "texture": 16, "noise": 4, "shadow": 5, "crumple": 13, "document": 9}
N_FEATURES = sum(GROUPS.values())


def names(groups: tuple[str, ...] = tuple(GROUPS)) -> list[str]:
    at, out = 0, []
    for g, n in GROUPS.items():
        out += [f"f{k}" for k in range(at, at + n)] if g in groups else []
        at += n
    return out


def groups_of(places: set[int]) -> tuple[str, ...]:
    """The groups that hold the features at some places."""
    return tuple(g for g in GROUPS if any(f"f{k}" in names((g,)) for k in places))


def _histogram(bins: np.ndarray, n: int, where: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or sums of weights) of n bins in each row of a stack; where: the pixels that count."""
    rows = len(bins)
    at = bins.reshape(rows, -1) + np.arange(rows)[:, None] * n
    at = at.ravel() if where is None else at[where.reshape(rows, -1)]
    return np.bincount(at, None if weights is None else weights.ravel(), rows * n).reshape(rows, n)


def _log2_entropy(counts: np.ndarray) -> np.ndarray:
    p = counts / counts.sum(-1, keepdims=True)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)


def _share(a: np.ndarray, b: np.ndarray, default: float | np.ndarray = 0.0, least: float = 0.0) -> np.ndarray:
    """a / b, or the default where b isn't over `least`."""
    ok = b > least
    return np.where(ok, a / np.where(ok, b, 1), default)


def _moments(values: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the chosen values of each row of a stack, 0 without any."""
    v, m = values.reshape(len(values), -1), where.reshape(len(values), -1)
    n = m.sum(1)
    mean = _share(np.where(m, v, 0.0).sum(1), n)
    return mean, np.sqrt(_share((np.where(m, v - mean[:, None], 0.0) ** 2).sum(1), n))


def otsu(hist: np.ndarray, centres: np.ndarray, results: np.ndarray, default: float | np.ndarray) -> np.ndarray:
    """The first threshold of greatest between-class variance of each row; results: what to return for each bin."""
    below = np.cumsum(hist.astype(float), -1)
    above = hist.sum(-1, keepdims=True) - below
    live = below >= 1
    full = live & (above < 1)
    last = np.where(full.any(-1), full.argmax(-1), hist.shape[-1])[..., None]
    mass = np.cumsum(np.where(live, centres * hist, 0.0), -1)
    total = (centres * hist).sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (total - mass) / above) ** 2
    between = np.where(live & (np.arange(hist.shape[-1]) < last), between, 0.0)
    k = between.argmax(-1)[..., None]
    got = np.take_along_axis(np.broadcast_to(results, between.shape), k, -1)
    return np.where(np.take_along_axis(between, k, -1) > 0, got, np.asarray(default)[..., None])[..., 0]


def otsu_64(values: np.ndarray) -> np.ndarray:
    """Thresholds of the planes of a stack, over 64 bins of each one's range."""
    v = values.reshape(len(values), -1)
    lo, hi = v.min(1), v.max(1)
    flat = hi - lo < 1e-12
    width = np.where(flat, 1.0, (hi - lo) / 64)[:, None]
    hist = _histogram(np.minimum(((v - lo[:, None]) / width).astype(int), 63), 64)
    k = np.arange(64)
    return np.where(flat, lo, otsu(hist, lo[:, None] + (k + 0.5) * width, lo[:, None] + (k + 1.0) * width, lo))


def otsu_256(gray: np.ndarray) -> np.ndarray:
    """Thresholds of a plane, or of each plane of a stack."""
    planes = np.clip(gray, 0, 255).astype(int)
    hist = _histogram(planes if gray.ndim > 2 else planes[None], 256)
    return otsu(hist if gray.ndim > 2 else hist[0], np.arange(256.0), np.arange(256.0), 128.0)


def _patterns() -> np.ndarray:
    """The bin of each of 256 neighbour patterns: ones of the least rotation if it has at most two changes around, else 9."""
    out = np.empty(256, int)
    for p in range(256):
        least = min((p >> k | p << (8 - k)) & 255 for k in range(8))
        changes = bin(least ^ ((least >> 1 | least << 7) & 255)).count("1")
        out[p] = bin(least).count("1") if changes <= 2 else 9
    return out


LBP_BIN = _patterns()
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def quantise(values: np.ndarray, levels: int) -> np.ndarray:
    lo = values.min((1, 2), keepdims=True)
    span = values.max((1, 2), keepdims=True) - lo
    flat = span < 1e-12
    return np.where(flat, 0, np.minimum(((values - lo) / np.where(flat, 1, span) * (levels - 1)).astype(int), levels - 1))


def co_occurrence(q: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """16 x 16 counts of level pairs at an offset, dy >= 0, of each plane."""
    n, h, w = q.shape
    if dy >= h or abs(dx) >= w:
        return np.zeros((n, 16, 16), int)
    a = q[:, : h - dy, max(0, -dx) : w - max(0, dx)]
    b = q[:, dy:, max(0, dx) : w + min(0, dx)]
    return _histogram(a * 16 + b, 256).reshape(n, 16, 16)


def medians(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Medians of the values of each of n groups, 0 without any."""
    size = np.bincount(of, minlength=n)
    v = np.append(values[np.lexsort((values, of))], 0.0)
    first = np.cumsum(size) - size
    return np.where(size > 0, (v[first + np.maximum(size - 1, 0) // 2] + v[np.minimum(first + size // 2, len(v) - 1)]) / 2, 0.0)


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs in the rows of a stack of masks: plane, y, first and last x, in order."""
    n, h, w = mask.shape
    edge = np.zeros((n, h, w + 2), np.int8)
    edge[..., 1:-1] = mask
    step = np.diff(edge, axis=2)
    plane, y, x0 = np.nonzero(step == 1)
    return plane, y, x0, np.nonzero(step == -1)[2] - 1


def components(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a stack of masks as rows (plane, pixels, x0, x1, y0, y1), by union of the runs of adjacent rows: the greater root
    of each pair hangs itself to the lesser one, and paths are halved, until all pairs agree."""
    n, h, w = mask.shape
    plane, y, x0, x1 = mask_runs(mask)
    k = len(y)
    row = (plane * h + y) * (w + 1)
    lo = np.searchsorted(row + x1, row - (w + 1) + x0, "left")
    hi = np.where(y > 0, np.searchsorted(row + x0, row - (w + 1) + x1, "right"), lo)
    count = np.maximum(hi - lo, 0)
    b = np.repeat(np.arange(k), count)
    a = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count) + lo[b]
    parent = np.arange(k)
    while len(a):
        p, q = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while ((up := parent[parent]) != parent).any():
            parent = up
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    roots, which = np.unique(parent, return_inverse=True)
    out = np.zeros((len(roots), 6), int)
    out[:, 0] = plane[roots]
    out[:, [2, 4]] = max(h, w)
    out[:, 1] = np.bincount(which, x1 - x0 + 1, len(roots)).astype(int)
    np.minimum.at(out[:, 2], which, x0)
    np.maximum.at(out[:, 3], which, x1)
    np.minimum.at(out[:, 4], which, y)
    np.maximum.at(out[:, 5], which, y)
    return out


def _disk(radius: int) -> list[tuple[int, int]]:
    """Half-widths of a disk's rows."""
    return [(dy, int(np.sqrt(radius * radius - dy * dy))) for dy in range(-radius, radius + 1)]


def _bordered(plane: np.ndarray, by: int) -> np.ndarray:
    return np.pad(plane, [(0, 0)] * (plane.ndim - 2) + [(by, by)] * 2, mode="edge")


def morph(plane: np.ndarray, radius: int, pick: np.ufunc) -> np.ndarray:
    """Maximum or minimum over a disk with repeated borders, in each plane. A row's extreme over 2k + 1 columns is taken from two doubling windows."""
    h, w = plane.shape[-2:]
    pad = _bordered(plane, radius)
    powers = [pad]
    while 2 ** len(powers) <= 2 * radius + 1:
        p, s = powers[-1], 2 ** (len(powers) - 1)
        powers.append(pick(p[..., :-s], p[..., s:]))
    out = None
    for dy, half in _disk(radius):
        size = 2 * half + 1
        k = size.bit_length() - 1
        rows = powers[k][..., radius + dy : radius + dy + h, :]
        a, b = radius - half, radius + half + 1 - 2**k
        line = pick(rows[..., a : a + w], rows[..., b : b + w])
        out = line if out is None else pick(out, line)
    return out


class Image:
    """Lazily computed planes of an image, or of a stack of images of one size, and the feature groups of a stack: a row an image."""

    def __init__(self, rgb: np.ndarray):
        self.rgb = rgb.astype(float)
        self.h, self.w = rgb.shape[-3:-1]

    @cached_property
    def gray(self) -> np.ndarray:
        return 0.299 * self.rgb[..., 0] + 0.587 * self.rgb[..., 1] + 0.114 * self.rgb[..., 2]

    @cached_property
    def padded(self) -> np.ndarray:
        return _bordered(self.gray, 1)

    @cached_property
    def saturation(self) -> np.ndarray:
        r, g, b = (self.rgb[..., k] for k in range(3))
        most, least = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
        return np.where(most > 0, (most - least) / np.where(most > 0, most, 1), 0.0)

    @cached_property
    def sobel(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient length and angle."""
        p = self.padded
        nw, n, ne = p[..., :-2, :-2], p[..., :-2, 1:-1], p[..., :-2, 2:]
        sw, s, se = p[..., 2:, :-2], p[..., 2:, 1:-1], p[..., 2:, 2:]
        across = (ne - nw) + 2 * (p[..., 1:-1, 2:] - p[..., 1:-1, :-2]) + (se - sw)
        down = (sw - nw) + 2 * (s - n) + (se - ne)
        return np.sqrt(across * across + down * down), np.arctan2(down, across)

    @staticmethod
    def central(plane: np.ndarray) -> np.ndarray:
        """Central-difference gradient length of the interior."""
        across, down = plane[..., 1:-1, 2:] - plane[..., 1:-1, :-2], plane[..., 2:, 1:-1] - plane[..., :-2, 1:-1]
        return np.sqrt(across * across + down * down)

    @cached_property
    def inner(self) -> np.ndarray:
        return self.central(self.gray)

    def slope(self) -> np.ndarray:
        """The interior's gradient length, 0 at the borders."""
        out = np.zeros(self.gray.shape)
        if self.h > 2 and self.w > 2:
            out[..., 1:-1, 1:-1] = self.inner
        return out

    @cached_property
    def lbp(self) -> tuple[np.ndarray, np.ndarray]:
        """Of interior pixels: the pattern's bin and the standard deviation of the 3 x 3 neighbourhood."""
        g = self.gray
        c = g[..., 1:-1, 1:-1]
        ring = [g[..., :-2, 1:-1], g[..., :-2, 2:], g[..., 1:-1, 2:], g[..., 2:, 2:], g[..., 2:, 1:-1], g[..., 2:, :-2], g[..., 1:-1, :-2], g[..., :-2, :-2]]
        pattern = sum((n >= c).astype(np.int16) << k for k, n in enumerate(ring))
        mean = sum(ring, c) / 9
        var = sum(((n - mean) ** 2 for n in ring), (c - mean) ** 2) / 9
        return LBP_BIN[pattern], np.sqrt(var)

    @cached_property
    def residual_variance(self) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(_bordered(self.gray, 2), (5, 5), axis=(-2, -1))
        flat = windows.reshape(*self.gray.shape, 25)
        return (self.gray - np.partition(flat, 12, axis=-1)[..., 12]).reshape(len(flat), -1).var(1)

    def color(self) -> list[np.ndarray]:
        out = []
        k, n = len(self.rgb), self.h * self.w
        i = np.arange(n, dtype=float)
        zero = np.zeros((k, 1))
        for c in range(3):
            x = self.rgb[..., c].reshape(k, n)
            mean = np.cumsum(x, 1) / (i + 1)
            before = np.concatenate([zero, mean[:, :-1]], 1)
            delta = x - before
            dn = delta / (i + 1)
            term = delta * dn * i
            m2 = np.cumsum(delta * (x - mean), 1)
            old2 = np.concatenate([zero, m2[:, :-1]], 1)
            m3 = np.cumsum(term * dn * (i - 2) - 3 * dn * old2, 1)
            old3 = np.concatenate([zero, m3[:, :-1]], 1)
            m4 = (term * dn * dn * (i * i - 3 * i + 3) + 6 * dn * dn * old2 - 4 * dn * old3).sum(1)
            var = m2[:, -1] / n
            flat = var <= 1e-12
            some = np.where(flat, 1.0, var)
            out += [mean[:, -1], np.sqrt(np.maximum(var, 0.0)), np.where(flat, 0.0, m3[:, -1] / n / (some * np.sqrt(some))), np.where(flat, 0.0, m4 / n / (some * some) - 3.0)]
        g = self.gray.reshape(k, n)
        hist = _histogram(np.clip(g, 0, 255).astype(int), 256)
        out += [g.mean(1), (np.cumsum(hist, 1) >= n // 2).argmax(1), g.std(1), _log2_entropy(hist)]
        r, gr, b = (self.rgb[..., c].reshape(k, n) for c in range(3))
        saturation = self.saturation.reshape(k, n)
        return [*out, (r - gr).std(1) + (0.5 * (r + gr) - b).std(1), saturation.mean(1), saturation.var(1)]

    def edges(self) -> list[np.ndarray]:
        p, g = self.padded, self.gray
        k = len(g)
        laplace = 4 * g - p[:, 1:-1, :-2] - p[:, 1:-1, 2:] - p[:, :-2, 1:-1] - p[:, 2:, 1:-1]
        plane, turn = self.sobel
        length, angle = plane.reshape(k, -1), turn.reshape(k, -1)
        n = length.shape[1]
        tenth, mean = min(int(n * 0.9), n - 1), length.mean(1)
        out = [laplace.reshape(k, -1).var(1), mean, length.std(1), np.partition(length, tenth, 1)[:, tenth], (length > otsu_64(length)[:, None]).mean(1)]
        strong = length > mean[:, None]
        bins = _histogram(np.minimum(((angle + np.pi) / (2 * np.pi) * 8).astype(int), 7), 8, strong)
        out += list((bins / np.maximum(bins.sum(1, keepdims=True), 1)).T)
        a = np.abs(angle)
        a = np.where(a > np.pi / 2, np.pi - a, a)
        near = np.radians(10)
        axis = (a < near) | (np.abs(np.pi / 2 - a) < near)
        slant = ~axis & (np.abs(a - np.pi / 4) < np.pi / 4 - near)
        straight, diagonal = (np.where(strong & m, length, 0.0).sum(1) for m in (axis, slant))
        out.append(np.where(diagonal >= 1e-12, straight / np.maximum(diagonal, 1e-12), np.where(straight > 0, 10.0, 1.0)))
        thin = np.zeros_like(plane)
        if self.h > 2 and self.w > 2:
            m = plane[:, 1:-1, 1:-1]
            sector = ((turn[:, 1:-1, 1:-1] + np.pi) / (np.pi / 4) + 0.5).astype(int) % 4
            pairs = [(plane[:, :-2, 1:-1], plane[:, 2:, 1:-1]), (plane[:, :-2, 2:], plane[:, 2:, :-2]), (plane[:, 1:-1, :-2], plane[:, 1:-1, 2:]), (plane[:, :-2, :-2], plane[:, 2:, 2:])]
            one, two = (np.choose(sector, [q[j] for q in pairs]) for j in range(2))
            thin[:, 1:-1, 1:-1] = np.where((m >= one) & (m >= two), m, 0.0)
        thin = thin.reshape(k, -1)
        return [*out, (thin > otsu_64(thin)[:, None]).mean(1)]

    def texture(self) -> list[np.ndarray]:
        g, h, w = self.gray, self.h, self.w
        k = len(g)
        by, bx = h // 8, w // 8
        ratio = np.zeros(k)
        if by and bx:
            blocks = g[:, : by * 8, : bx * 8].reshape(k, by, 8, bx, 8).swapaxes(2, 3)
            c = np.abs(_DCT @ blocks @ _DCT.T)
            ratio = _share(c[..., 0, :3].sum(-1), c.sum((-2, -1)), least=1e-12).reshape(k, -1).mean(1)
        out = [ratio]
        out += list((_histogram(self.lbp[0], 10) / ((h - 2) * (w - 2))).T) if h >= 3 and w >= 3 else [np.zeros(k)] * 10
        scale = 64 / w if w >= h else 64 / h
        tw, th = max(int(w * scale), 1), max(int(h * scale), 1)
        thumb = g[:, np.minimum((np.arange(th) / scale).astype(int), h - 1)][:, :, np.minimum((np.arange(tw) / scale).astype(int), w - 1)]
        q = quantise(thumb, 16)
        sums, seen = np.zeros((4, k)), 0
        i, j = np.arange(16.0)[:, None], np.arange(16.0)[None, :]
        total = lambda x: x.sum((1, 2))
        for dx, dy in zip((5, 0, 5, -5), (0, 5, 5, 5), strict=True):
            pairs = max(th - dy, 0) * max(tw - abs(dx), 0)
            if pairs < 50:
                continue
            seen += 1
            p = co_occurrence(q, dx, dy) / pairs
            di, dj = i - total(i * p)[:, None, None], j - total(j * p)[:, None, None]
            sx, sy = total(di**2 * p), total(dj**2 * p)
            ok = (sx > 1e-12) & (sy > 1e-12)
            corr = np.where(ok, total(di * dj * p) / np.sqrt(np.where(ok, sx * sy, 1)), 0.0)
            sums += [total((i - j) ** 2 * p), corr, total(p * p), total(p / (1 + np.abs(i - j)))]
        out += list(sums / max(seen, 1))
        edge = self.slope() > 10
        xs = [s for s in (2, 4, 8, 16, 32, 64) if s <= w and s <= h]
        if len(xs) < 2:
            return [*out, np.zeros(k)]
        n = np.array([edge[:, : h // s * s, : w // s * s].reshape(k, h // s, s, w // s, s).any((2, 4)).sum((1, 2)) for s in xs])
        m = n > 0
        x, y = np.where(m, -np.log2(xs)[:, None], 0.0), np.log2(np.where(m, n, 1))
        c = m.sum(0)
        return [*out, np.where(c >= 2, (c * (x * y).sum(0) - x.sum(0) * y.sum(0)) / np.where(c >= 2, c * (x * x).sum(0) - x.sum(0) ** 2, 1), 0.0)]

    def noise(self) -> list[np.ndarray]:
        g = self.gray
        k, v = len(g), self.residual_variance
        out = [v]
        for plane in (g, g.swapaxes(1, 2)):
            h, w = plane.shape[1] // 8 * 8, plane.shape[2] // 8 * 8
            if min(self.h, self.w) < 16:
                out.append(np.zeros(k))
                continue
            d = np.abs(np.diff(plane[:, :h, :w], axis=1))
            at_edge = np.arange(h - 1) % 8 == 7
            inside, across = (d[:, rows].reshape(k, -1).mean(1) for rows in (~at_edge, at_edge))
            out.append(np.where(inside < 1e-12, 0.0, np.maximum(across - inside, 0.0) / np.maximum(inside, 1e-12)))
        mean = self.inner.reshape(k, -1).mean(1) if self.inner.size else np.zeros(k)
        return [*out, np.where(v >= 1e-12, mean / np.maximum(v, 1e-12), np.where(mean > 0, 100.0, 0.0))]

    def shadow(self) -> list[np.ndarray]:
        g, side = self.gray, min(self.h, self.w)
        k = len(g)
        radius = 10 if side >= 21 else max(int(side * 0.1), 1)
        light = morph(morph(g, radius, np.maximum), radius, np.minimum)
        mean, deviation = _moments(light - g, light > g)
        slope = self.central(light)
        return [(g < 0.7 * light).reshape(k, -1).mean(1), light.reshape(k, -1).var(1), mean, deviation, slope.reshape(k, -1).mean(1) if slope.size else np.zeros(k)]

    def crumple(self) -> list[np.ndarray]:
        g, h, w = self.gray, self.h, self.w
        k = len(g)
        out = [np.zeros(k)] * 10
        if h >= 3 and w >= 3:
            bins, weight = self.lbp
            out = list(_share(_histogram(bins, 10, weights=weight), weight.reshape(k, -1).sum(1)[:, None], least=1e-10).T)
        steep = self.slope() > 20
        ch, cw = max(h // 8, 1), max(w // 8, 1)
        cells = [steep[:, y * ch : (y + 1) * ch, x * cw : (x + 1) * cw] for y in range(8) for x in range(8)]
        share = np.array([c.mean((1, 2)) for c in cells if c.size])
        out.append(share.std(0) if len(share) > 1 else np.zeros(k))
        q = quantise(g, 16)
        i, j = np.arange(16.0)[:, None], np.arange(16.0)[None, :]
        across, down = (((i - j) ** 2 * c).sum((1, 2)) / np.maximum(c.sum((1, 2)), 1) for c in (co_occurrence(q, 5, 0), co_occurrence(q, 0, 5)))
        uneven = np.where(across >= 1e-12, down / np.maximum(across, 1e-12), np.where(down > 0, 10.0, 1.0))
        out.append(np.where(g.max((1, 2)) - g.min((1, 2)) < 1e-12, 1.0, uneven))
        tile = max(min(h, w) // 8, 4)
        ty, tx = h // tile, w // tile
        if ty < 2 or tx < 2:
            return [*out, np.ones(k)]
        level = np.clip(g, 0, 255).astype(int)
        counts = _histogram(level[:, : ty * tile, : tx * tile].reshape(k, ty, tile, tx, tile).swapaxes(2, 3).reshape(k * ty * tx, -1), 256).ravel()
        some = np.flatnonzero(counts)
        p = counts[some] / (tile * tile)
        entropy = -np.bincount(some // 256, p * np.log2(p), k * ty * tx).reshape(k, -1)
        return [*out, entropy.max(1) / np.maximum(entropy.min(1), 0.001)]

    @cached_property
    def ink(self) -> np.ndarray:
        return self.gray <= otsu_256(self.gray)[..., None, None]

    def document(self) -> list[np.ndarray]:
        ink, k = self.ink, len(self.gray)
        found = components(ink)
        big = found[found[:, 1] >= 3]
        of, size, width, height = big[:, 0], big[:, 1], big[:, 3] - big[:, 2] + 1, big[:, 5] - big[:, 4] + 1
        aspect = width / np.maximum(height, 1)
        stroke = size / np.maximum(2.0 * (width + height), 1)
        thin = (size < 100) & ((aspect > 3) | (aspect < 0.33))
        out = [np.bincount(found[:, 0], minlength=k), medians(aspect, of, k), medians(stroke, of, k), _share(np.bincount(of, thin, k), np.bincount(of, minlength=k))]
        plane, _, x0, x1 = mask_runs(ink)
        runs, n = x1 - x0 + 1, np.bincount(plane, minlength=k)
        mean = _share(np.bincount(plane, runs, k), n)
        out += [mean, np.sqrt(_share(np.bincount(plane, (runs - mean[plane]) ** 2, k), n))]
        out.append(ink.sum(2).astype(float).std(1))
        out.append(self.lines())
        slope = self.slope()
        flat = slope < slope.max((1, 2), keepdims=True) * 0.3
        low, high = (_moments(self.saturation, m)[0] for m in (flat, ~flat))
        return [*out, np.where(high < 1e-12, 1.0, low / np.maximum(high, 1e-12))]

    def lines(self) -> np.ndarray:
        """Peaks of 64 x 64 Hough accumulators. A place's bin is found once for all images."""
        k, h, w = self.ink.shape
        plane, at = np.nonzero(self.ink.reshape(k, -1))
        y, x = np.divmod(np.arange(h * w), w)
        reach = np.sqrt(float(w * w + h * h))
        theta = np.arange(64) * (np.pi / 64)
        acc = np.zeros((k, 64, 64), int)
        for t in range(64):
            r = np.minimum(((x * np.cos(theta[t]) + y * np.sin(theta[t]) + reach) / (2 * reach / 64)).astype(int), 64)
            acc[:, :, t] = np.bincount(plane * 65 + r[at], minlength=k * 65).reshape(k, 65)[:, :64]
        most = acc.max((1, 2))
        c = acc[:, 1:-1, 1:-1]
        peak = c >= (most * 0.5).astype(int)[:, None, None]
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    peak &= c >= acc[:, dy : dy + 62, dx : dx + 62]
        return np.where(most < 3, 0, peak.sum((1, 2)))


#: Pixels of a stack: its planes of doubles stay within a processor's cache.
STACK_PIXELS = 1 << 17


def extract_all(stack: np.ndarray, groups: tuple[str, ...] = tuple(GROUPS)) -> np.ndarray:
    """The features of the groups asked for of images of one size, n x height x width x 3: a row an image, in their fixed order."""
    step = max(1, STACK_PIXELS // max(stack.shape[1] * stack.shape[2], 1))
    out = np.empty((len(stack), sum(GROUPS[g] for g in GROUPS if g in groups)))
    for at in range(0, len(stack), step):
        image = Image(stack[at : at + step])
        for k, column in enumerate(v for g in GROUPS if g in groups for v in getattr(image, g)()):
            out[at : at + step, k] = column
    return out


def extract(rgb: np.ndarray, groups: tuple[str, ...] = tuple(GROUPS)) -> list[float]:
    """The features of one image."""
    return extract_all(rgb[None], groups)[0].tolist()


def _axis_weights(size: int, new: int) -> np.ndarray:
    ratio = size / new
    support = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio - 0.5
    weight = np.maximum(0.0, 1.0 - np.abs(np.arange(size)[None, :] - centre[:, None]) / support)
    return weight / weight.sum(1, keepdims=True)


def fit_within(rgb: np.ndarray, longest: int = 512) -> np.ndarray:
    """The image, scaled down by a triangle filter if its longer edge exceeds `longest`."""
    h, w = rgb.shape[:2]
    if max(h, w) <= longest:
        return rgb
    ratio = longest / max(h, w)
    nh, nw = max(1, round(h * ratio)), max(1, round(w * ratio))
    out = np.einsum("yh,hwc->ywc", _axis_weights(h, nh), rgb.astype(float))
    out = np.einsum("xw,ywc->yxc", _axis_weights(w, nw), out)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def from_spark(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's image bytes (blue first) as an RGB array; gray is repeated, alpha dropped."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, 2) if channels == 1 else raw[..., 2::-1]


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def blacken(rgb: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> np.ndarray:
    """A copy with the boxes (x0, y0, x1, y1) in black."""
    out = rgb.copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, int(y0)) : max(0, int(np.ceil(y1))), max(0, int(x0)) : max(0, int(np.ceil(x1)))] = 0
    return out
