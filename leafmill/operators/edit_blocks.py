"""Pairs of near keys within blocks of keys: the kernel of the similarity join where most keys are like many others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a key and an end of other keys whose distances are filled at a time.
PAIRS = 1 << 15


def _codes(keys: list[str]) -> list[np.ndarray]:
    """Characters from the end on, as most addresses differ at their start."""
    return [np.frombuffer(k[::-1].encode("utf-32-le"), np.uint32) for k in keys]


def _most_edits(longest: int, percent: float, share: float) -> np.ndarray:
    """By length of the longer key: the edits at which two keys are still near."""
    size, edits = np.arange(longest + 1)[:, None], np.arange(int(longest * share + 1e-9) + 1)
    near = (edits <= np.floor(size * share + 1e-9)) & (np.floor((1 - edits / np.maximum(size, 1)) * 1000 + 0.5) / 10 >= percent)
    return near.sum(axis=1) - 1


class Ends:
    """The distinct ends of ``keys`` by length, in the order of the keys from their end: of each length the last character of each
    end, its longer ends by one character (first and number), and the places of the keys that it is all of (first and number)."""

    def __init__(self, keys: list[np.ndarray]):
        order = sorted(range(len(keys)), key=lambda i: keys[i].tolist())
        self.longest = max(map(len, keys))
        sizes = np.array([len(keys[i]) for i in order])
        letters = np.zeros((len(keys), self.longest), keys[0].dtype)
        for row, i in enumerate(order):
            letters[row, :sizes[row]] = keys[i]
        differ = letters[1:] != letters[:-1]
        shared = np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), self.longest))
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
        self.places = np.array(order)
        starts = [np.flatnonzero((sizes >= t) & ((shared < t) | (np.arange(len(keys)) == 0))) if t else np.zeros(1, np.int64) for t in range(self.longest + 1)]
        self.last = [letters[at, t - 1] if t else None for t, at in enumerate(starts)]
        self.longer, self.whole = [], []
        for t, at in enumerate(starts):
            after = starts[t + 1] if t < self.longest else np.empty(0, np.int64)
            self.longer.append(self._within(at, after))
            self.whole.append(self._within(at, np.flatnonzero(sizes == t)))
        self.of_size = [np.flatnonzero(sizes == t) for t in range(self.longest + 1)]

    @staticmethod
    def _within(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(np.searchsorted(starts, rows, side="right") - 1, minlength=len(starts))
        return np.cumsum(n) - n, n


def _each(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + k) for each i and k < n[i]."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n)


def near_in_block(left: list[str], right: list[str], percent: float, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in right, places in left) of all pairs of keys with an edit similarity of ``percent`` or more.

    The edit distances of a left key and an end of right keys are a column of a table, of which only the ``limit`` rows on both
    sides of the diagonal are kept; what is over ``limit`` counts as one more than that. A column goes on to the ends that are
    longer by a character, unless all of it is over the limit; columns of one length are filled side by side."""
    codes = _codes(left + right)
    longest = max(map(len, codes))
    most = _most_edits(longest, percent, share)
    limit = int(longest * share + 1e-9)
    # Characters by number, from 1, in as few bytes as will do.
    names, numbers = np.unique(np.concatenate(codes), return_inverse=True)
    codes = np.split((numbers + 1).astype(np.uint8 if len(names) < 255 else np.uint32), np.cumsum([len(x) for x in codes])[:-1])
    ends, sizes = Ends(codes[len(left):]), np.array([len(x) for x in codes[:len(left)]])
    kind = np.int8 if limit <= 40 else np.int16 if limit <= 10_000 else np.int32
    over, one = kind(limit + 1), kind(1)
    step = np.arange(2 * limit + 1, dtype=kind)[:, None]
    # Row k of a column after t characters is the place t + k - limit of the left key; its character is row t + k here.
    letters = np.zeros((longest + 2 * limit + 1, len(left)), codes[0].dtype)
    for i, x in enumerate(codes[:len(left)]):
        letters[limit + 1:limit + 1 + len(x), i] = x
    start = np.where(step < limit, over, step - kind(limit)) + np.zeros((1, len(left)), kind)
    pairs = max(1, PAIRS * 32 // (2 * limit + 1) // start.itemsize)
    waiting = [(0, np.zeros(len(left), np.int64), np.arange(len(left)), start)]
    while waiting:
        t, end, who, last = waiting.pop()
        of, row = _each(ends.whole[t][0][end], ends.whole[t][1][end])
        if len(of):
            at = sizes[who[of]] - t + limit
            inside = np.flatnonzero((at >= 0) & (at <= 2 * limit))
            of, row, at = of[inside], row[inside], at[inside]
            near = last[at, of] <= most[np.maximum(sizes[who[of]], t)]
            yield ends.places[ends.of_size[t][row[near]]], who[of[near]]
        if t == ends.longest:
            continue
        of, longer = _each(ends.longer[t][0][end], ends.longer[t][1][end])
        for k in range(0, len(of), pairs):
            some, end = of[k:k + pairs], longer[k:k + pairs]
            own, old = who[some], np.take(last, some, axis=1)
            table = old + (np.take(letters[t + 1:t + 2 * limit + 2], own, axis=1) != ends.last[t + 1][end])
            if limit:
                np.minimum(table[:-1], old[1:] + one, out=table[:-1])
                table -= step
                span = 1
                while span <= limit:  # further along a column costs more than the limit
                    table[span:] = np.minimum(table[span:], table[:-span])
                    span *= 2
                table += step
            np.minimum(table, over, out=table)
            alive = np.flatnonzero(table.min(axis=0) <= limit)
            if len(alive):
                waiting.append((t + 1, end[alive], own[alive], table if len(alive) == len(own) else np.take(table, alive, axis=1)))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots by node after the links (a, b), and the places of links that connect the same nodes as all of them."""
    taken, at = [], np.flatnonzero(root[a] != root[b])
    while len(at):
        low, high = np.minimum(root[a[at]], root[b[at]]), np.maximum(root[a[at]], root[b[at]])
        least = np.full(len(root), len(root))
        np.minimum.at(least, high, low)
        link, best = np.zeros(len(root), np.int64), least[high] == low
        link[high[best]] = at[best]  # one link from a root to its smallest neighbour
        hooked = np.flatnonzero(least < len(root))
        taken.append(link[hooked])
        to = np.arange(len(root))
        to[hooked] = least[hooked]
        while (to[to] != to).any():
            to = to[to]
        root = to[root]
        at = at[root[a[at]] != root[b[at]]]
    return root, np.concatenate(taken) if taken else np.empty(0, np.int64)


def degrees_and_forest(left: list[str], right: list[str] | None, percent: float, share: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each key (those of ``left``, then those of ``right``) and a few of them that connect what all of them do.
    ``right`` None is for the pairs within ``left``."""
    n = len(left)
    links = np.zeros(n + len(right or []), np.int64)
    root, forest = np.arange(len(links)), []
    for places, near in near_in_block(left, left if right is None else right, percent, share):
        if right is None:
            places, near = places[near < places], near[near < places]
        else:
            places = places + n
        links += np.bincount(places, minlength=len(links)) + np.bincount(near, minlength=len(links))
        root, taken = _joined(root, places, near)
        forest += zip(places[taken].tolist(), near[taken].tolist())
    return links, forest
