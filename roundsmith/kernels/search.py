"""Local search over one technician's slots.  A slot is one number, in the order (week, day name)."""

from __future__ import annotations

from collections import deque

import numpy as np

from roundsmith.config import DAYS
from roundsmith.kernels.cluster import haversine
from roundsmith.kernels.near import nearest_sites

#: Ties between slots go by week and then by the day's name in the alphabet.
ALPHABETIC = sorted(DAYS)


def slot_code(week: np.ndarray, day: np.ndarray) -> np.ndarray:
    place = {d: i for i, d in enumerate(ALPHABETIC)}
    return (np.asarray(week) - 1) * 5 + np.array([place[d] for d in day], int)


def slot_parts(code: np.ndarray) -> tuple[np.ndarray, list[str]]:
    return np.asarray(code) // 5 + 1, [ALPHABETIC[c % 5] for c in code]


def nearest(points: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other points of every point, nearest first, ties to the smaller index."""
    asking, other, _ = nearest_sites(points[:, 0], points[:, 1], np.arange(len(points)), np.ones(len(points), bool), k)
    return other[np.argsort(asking, kind="stable")].reshape(len(points), k)


def passes_gate(src: float, dst: float, hours: float, cap: float) -> bool:
    return dst + hours <= cap or dst + hours < src


def rebalance(points: np.ndarray, hours: np.ndarray, slot: np.ndarray, cap: float = 8.0, moves: int = 500, tabu: int = 15, least_weight: float = 0.001, allow_empty: bool = False) -> tuple[np.ndarray, int]:
    """Move one site at a time out of the heaviest over-full slot, to the slot whose centre gains most distance.

    Only slots in use are destinations (unless ``allow_empty``), the destination must stay below the source, and a
    site may not return to one of the slots it left in the last ``tabu`` moves.
    """
    slot, w, n = slot.copy(), np.maximum(hours, least_weight), len(slot)
    recent: deque[tuple[int, int]] = deque(maxlen=tabu)
    if n < 2:
        return slot, 0
    for done in range(moves):
        load, used = np.bincount(slot, hours, 20), np.bincount(slot, minlength=20) > 0
        heavy = np.where(used & (load > cap), load, -np.inf)
        src = int(heavy.argmax())
        if heavy[src] == -np.inf:
            return slot, done
        mass = np.bincount(slot, w, 20)
        centre = np.column_stack([np.bincount(slot, w * points[:, d], 20) for d in range(2)]) / np.where(mass > 0, mass, 1)[:, None]
        empty = np.flatnonzero(~used) if allow_empty else np.zeros(0, int)
        centre[empty] = centre[src]
        to = np.concatenate([np.setdiff1d(np.flatnonzero(used), [src]), empty])
        own = np.flatnonzero(slot == src)
        if len(to) == 0:
            return slot, done
        d = haversine(points[own], centre[np.append(to, src)])
        gain = d[:, -1:] - d[:, :-1]
        gain[load[to][None] + hours[own][:, None] >= load[src]] = -np.inf
        for site, left in recent:
            gain[np.ix_(own == site, to == left)] = -np.inf
        best = int(gain.argmax())
        i, j = divmod(best, len(to))
        if gain[i, j] == -np.inf:
            return slot, done
        recent.append((int(own[i]), src))
        slot[own[i]] = to[j]
    return slot, moves


def tally(seen: np.ndarray, current: int) -> tuple[int, int, int]:
    """The slot seen most often (the first one on ties), its count, and the current slot's count."""
    counts = (seen[:, None] == seen[None]).sum(axis=1)
    return int(seen[counts.argmax()]), int(counts.max()), int((seen == current).sum())


def tallies(seen: np.ndarray, current: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tally`` of every row at once."""
    counts = (seen[:, :, None] == seen[:, None, :]).sum(axis=2)
    first = counts.argmax(axis=1)
    rows = np.arange(len(seen))
    return seen[rows, first], counts[rows, first], (seen == current[:, None]).sum(axis=1)


def majority_filter(points: np.ndarray, hours: np.ndarray, slot: np.ndarray, k: int = 7, least: int = 3, passes: int = 10, cap: float = 8.0) -> tuple[np.ndarray, int]:
    """Join the neighbours' slot where ``least`` of k agree.  Votes are those at the start of a pass, loads are live."""
    slot, total = slot.copy(), 0
    if len(slot) < k + 1:
        return slot, 0
    near = nearest(points, k)
    for _ in range(passes):
        frozen, load, moved = slot.copy(), np.bincount(slot, hours, 20), 0
        top, votes, _ = tallies(frozen[near], frozen)
        for i in np.flatnonzero((votes >= least) & (top != frozen)).tolist():
            here, to = frozen[i], top[i]
            if passes_gate(load[here], load[to], hours[i], cap):
                load[here], load[to] = max(0.0, load[here] - hours[i]), load[to] + hours[i]
                slot[i], moved = to, moved + 1
        total += moved
        if not moved:
            break
    return slot, total


def joint_search(points: np.ndarray, hours: np.ndarray, slot: np.ndarray, k: int = 7, passes: int = 500, tabu: int = 15, cap: float = 8.0) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Join a slot that strictly more neighbours have than the own one.  Votes and loads are live; slots left in
    earlier passes are tabu from the next pass on.  Also the moves of every pass.

    A pass counts all votes at its start and again those of a site that has a moved neighbour by then.
    """
    slot, log = slot.copy(), []
    if len(slot) < k + 1:
        return slot, log
    near, recent = nearest(points, k), deque(maxlen=tabu)
    # The sites that have i among their neighbours.
    askers = np.split(np.repeat(np.arange(len(slot)), k)[np.argsort(near.reshape(-1), kind="stable")], np.cumsum(np.bincount(near.reshape(-1), minlength=len(slot)))[:-1])
    for step in range(1, passes + 1):
        barred, load, moved = set(recent), np.bincount(slot, hours, 20), 0
        top, votes, own = tallies(slot[near], slot)
        likely = votes > own
        for i in range(len(slot)):
            if not likely[i]:
                continue
            here = int(slot[i])
            to, most, mine = tally(slot[near[i]], here)
            if most > mine and (i, to) not in barred and passes_gate(load[here], load[to], hours[i], cap):
                load[here], load[to] = max(0.0, load[here] - hours[i]), load[to] + hours[i]
                recent.append((i, here))
                slot[i], moved = to, moved + 1
                likely[askers[i]] = True
        log.append((step, moved))
        if not moved:
            break
    return slot, log
