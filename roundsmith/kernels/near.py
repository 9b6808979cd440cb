"""The nearest other sites of one technician's sites, by windows of latitude: no table of all distances is held."""

from __future__ import annotations

import math

import numpy as np

EARTH_KM = 6371.0


def exact_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Kilometres between places in degrees, by the C library in the order of the SQL form.

    NumPy's functions and the JVM's round the last bits otherwise, and that decides between places that are equally far.
    """
    chord = math.pow(math.sin(math.radians(lat2 - lat1) / 2), 2) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.pow(math.sin(math.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, chord)))


def nearest_sites(lat: np.ndarray, lon: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the asking site, place of the other, km) of the k nearest others, by ``exact_km`` and then id.

    Sites lie in order of latitude; a window of them is enough once the k-th distance is below the distance to its edges.
    """
    order = np.argsort(lat, kind="stable")
    at, ids = np.column_stack([lat[order], lon[order]]).tolist(), ids[order]
    lat, lon = np.radians(lat[order]), np.radians(lon[order])
    cosine, out = np.cos(lat), []
    for place in np.flatnonzero(asked[order]).tolist():
        reach = max(32, 4 * k)
        while True:
            lo, hi = max(0, place - reach), min(len(lat), place + reach + 1)
            chord = np.sin((lat[lo:hi] - lat[place]) / 2) ** 2 + cosine[place] * cosine[lo:hi] * np.sin((lon[lo:hi] - lon[place]) / 2) ** 2
            km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(chord, 1)))
            km[place - lo] = np.inf
            kth = np.partition(km, k - 1)[k - 1] if hi - lo > k else np.inf
            kth = kth if np.isfinite(kth) else np.inf
            # What rounding can hide; it grows towards the other side of the globe.
            slack = 1e-8 if kth < 10_000 else 1e-3
            # Beyond an edge every site is farther than its difference of latitude.
            edges = [lat[place] - lat[lo] if lo else np.inf, lat[hi - 1] - lat[place] if hi < len(lat) else np.inf]
            if lo == 0 and hi == len(lat) or kth + slack < EARTH_KM * min(edges) - 1e-9:
                break
            reach *= 4
        best = np.flatnonzero((km <= kth + slack) & np.isfinite(km))
        # Sites at one place are equally far, so a place is measured once.
        here, known = at[place], {}
        far = np.array([known[p] if (p := tuple(at[lo + b])) in known else known.setdefault(p, exact_km(*here, *p)) for b in best.tolist()], float)
        first = np.lexsort((ids[lo:hi][best], far))[:k]
        best, far = best[first], far[first]
        out.append((np.full(len(best), place), best + lo, far))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    a, b, km = (np.concatenate(x) for x in zip(*out))
    return order[a], order[b], km
