"""Weighted clustering of one technician's sites; plain NumPy, deterministic for a given generator."""

from __future__ import annotations

import numpy as np

EARTH_KM = 6371.0


def haversine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kilometres between every row of ``a`` and every row of ``b`` (latitude, longitude in degrees)."""
    p, q = np.radians(a)[:, None, :], np.radians(b)[None, :, :]
    s = np.sin((q - p) / 2) ** 2
    chord = s[..., 0] + np.cos(p[..., 0]) * np.cos(q[..., 0]) * s[..., 1]
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(chord, 1)))


def weiszfeld_step(points: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    pull = weights / np.maximum(np.hypot(*(points - at).T), 1e-9)
    return pull @ points / pull.sum()


def geometric_median(points: np.ndarray, weights: np.ndarray, rounds: int = 30, tolerance: float = 1e-7) -> np.ndarray:
    """Weighted geometric median from the weighted mean; no points give the origin, one point itself."""
    if len(points) < 2:
        return points[0].astype(float) if len(points) else np.zeros(2)
    w = np.maximum(weights, 1e-9)
    at = w @ points / w.sum()
    for _ in range(rounds):
        to = weiszfeld_step(points, w, at)
        if np.hypot(*(to - at)) < tolerance:
            break
        at = to
    return at


def lloyd_step(points: np.ndarray, weights: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every point, in degrees, and the centres' weighted means; an empty one stays."""
    label = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    mass = np.bincount(label, weights, len(centres))
    sums = np.column_stack([np.bincount(label, weights * points[:, d], len(centres)) for d in range(2)])
    return label, np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres)


def kmeans(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weighted k-means with k-means++ seeds; as many points as clusters or fewer get a cluster each."""
    n = len(points)
    if n == 0:
        return np.zeros(0, int), np.zeros((k, 2))
    if n <= k:
        centres = np.repeat(points.mean(axis=0)[None], k, axis=0)
        centres[:n] = points
        return np.arange(n), centres
    chosen = [int(rng.choice(n, p=weights / weights.sum()))]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chance = gap * weights
        free = np.setdiff1d(np.arange(n), chosen)
        chosen.append(int(rng.choice(n, p=chance / chance.sum())) if chance.sum() > 0 else int(rng.choice(free)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres, label = points[chosen].astype(float), np.zeros(n, int)
    for _ in range(rounds):
        now, to = lloyd_step(points, weights, centres)
        still = (now == label).all() and np.allclose(centres, to, atol=1e-9)
        label, centres = now, to
        if still:
            break
    return label, centres


def mad_outliers(distances: np.ndarray, multiplier: float) -> np.ndarray:
    if len(distances) == 0:
        return np.zeros(0, bool)
    middle = np.median(distances)
    spread = np.median(np.abs(distances - middle))
    return (distances > middle + multiplier * spread) & (spread > 0)


def seed_slots(points: np.ndarray, hours: np.ndarray, tiers: np.ndarray, rng: np.random.Generator, multiplier: float = 2.0, least_weight: float = 0.001) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Day number (0 west to 4 east), week (1 north to 4 south) and outlier flag of every site."""
    n, w = len(points), np.maximum(hours, least_weight)
    k = min(5, n)
    outlier = np.zeros(n, bool)
    if n >= max(5, k + 1):
        outlier = mad_outliers(haversine(points, geometric_median(points, w)[None])[:, 0], multiplier)

    # The sites that shape the zones: the highest tiers that fill k days, without outliers if that suffices.
    level = int(tiers.max())
    shaping = (tiers >= level) & ~outlier
    while shaping.sum() < k and level > 1:
        level -= 1
        shaping = (tiers >= level) & ~outlier
    if shaping.sum() < k:
        shaping = tiers >= level

    label = np.full(n, -1)
    label[shaping], centres = kmeans(points[shaping], w[shaping], k, rng)

    def settle() -> None:
        for j in np.unique(label[label >= 0]):
            centres[j] = geometric_median(points[label == j], w[label == j])

    def attach(sites: np.ndarray) -> None:
        label[sites] = haversine(points[sites], centres).argmin(axis=1)

    settle()
    for tier in sorted({int(t) for t in tiers if t < level}, reverse=True):
        sites = np.flatnonzero((tiers == tier) & (label < 0) & ~outlier)
        if len(sites):
            attach(sites)
            settle()
    late = np.flatnonzero(outlier & (label < 0))
    if len(late):
        attach(late)
    settle()
    rest = np.flatnonzero(label < 0)
    if len(rest):
        attach(rest)

    day = np.empty(k, int)
    day[np.argsort(centres[:, 1], kind="stable")] = np.arange(k)
    days, weeks = day[label], np.ones(n, int)
    for d in np.unique(days):
        own = np.flatnonzero(days == d)
        parts = min(4, len(own))
        if parts > 1:
            part, centre = kmeans(points[own], w[own], parts, rng)
            for j in np.unique(part):
                centre[j] = geometric_median(points[own][part == j], w[own][part == j])
            order = np.empty(parts, int)
            order[np.argsort(-centre[:, 0], kind="stable")] = np.arange(1, parts + 1)
            weeks[own] = order[part]
    return days, weeks, outlier
