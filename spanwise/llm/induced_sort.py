"""External suffix sorting by induction, with common-prefix values.

``suffix_order`` sorts all suffixes of an integer string the induced way: suffixes that start a falling run
after a rising one seed the rest; their own order comes from the same procedure on a shorter string of names
(recursion), until that string fits the memory bound and is sorted by doubling ranks. Induction scans the
sorted suffixes once upwards and once downwards; every scanned suffix pushes the one before it into a
priority queue keyed by first symbol. Queue entries are tuples of a suffix and the length of the prefix it
shares with the entry pushed before it, which follows from the scanned suffixes' own values by range minima,
so the common-prefix array comes out of the same two scans.

The queue and the string spill to unnamed temporary files of the task above the memory bound, so a shard may
be much larger than memory. Nothing of it outlives the task, and a repeated task starts afresh.

Symbol 0 separates texts: every separator counts as a different symbol, smaller than all others, in order of
position, so no common prefix crosses one.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: Common prefixes longer than this are reported as this, unless ``suffix_order`` is given another cap.
CAP = 120


def _kind(cap: int) -> np.dtype:
    """The type of common prefixes up to a cap; its largest value stands for no bound yet."""
    return np.dtype(np.uint8 if cap < 255 else np.uint32)


class DiskQueue:
    """First-in first-out entries (suffix, common prefix) per key; beyond ``memory`` entries they go to disk."""

    def __init__(self, memory: int, kind: np.dtype):
        self.memory, self.kind, self.held, self.file = memory, kind, 0, None
        self.parts: dict[int, list] = defaultdict(list)

    def push(self, key: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts[key].append((suffixes, prefixes))
        self.held += len(suffixes)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for key, parts in self.parts.items():
            live = [p for p in parts if not isinstance(p[0], int)]
            if live:
                at = self.file.tell()
                s, c = np.concatenate([p[0] for p in live]), np.concatenate([p[1] for p in live])
                self.file.write(s.tobytes())
                self.file.write(c.tobytes())
                self.parts[key] = [p for p in parts if isinstance(p[0], int)] + [(at, len(s))]
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries of a key so far, oldest first."""
        parts = self.parts.pop(key, None)
        if not parts:
            return None
        loaded = []
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                s = np.frombuffer(self.file.read(8 * b), np.int64)
                loaded.append((s, np.frombuffer(self.file.read(self.kind.itemsize * b), self.kind)))
            else:
                self.held -= len(a)
                loaded.append((a, b))
        if len(loaded) == 1:
            return loaded[0]
        return np.concatenate([s for s, _ in loaded]), np.concatenate([c for _, c in loaded])


def _minima(values: np.ndarray):
    """A function that gives the minimum of values[a..b] for arrays a <= b."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        low, half = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(low[:-half], low[half:]))

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), values.dtype)
        for level in np.unique(k):
            at = k == level
            row = levels[level]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(level)) + 1])
        return out

    return between


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end of the string is smaller than everything."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    step[:-1][(text[:-1] == 0) & (text[1:] == 0)] = 1
    step[-1] = -1
    set_at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(set_at[::-1])[::-1]
    return step[following] > 0


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, symbol by symbol in steps of eight, up to the cap."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    reach = np.arange(8)
    for at in range(0, cap, 8):
        if not len(live):
            break
        x, y = a[live, None] + at + reach, b[live, None] + at + reach
        inside = (x < n) & (y < n)
        u, v = text[np.minimum(x, n - 1)], text[np.minimum(y, n - 1)]
        same = inside & (u == v) & (u != 0)
        whole = same.all(axis=1)
        out[live] += np.where(whole, 8, same.argmin(axis=1))
        live = live[whole]
    return np.minimum(out, cap).astype(_kind(cap))


class _Scan:
    """The bookkeeping of one scan: pushes predecessors and keeps, per target, the least prefix since its last push."""

    def __init__(self, text: np.ndarray, memory: int, with_prefixes: bool, cap: int):
        self.kind = _kind(cap)
        self.text, self.queue, self.with_prefixes, self.cap = text, DiskQueue(memory, self.kind), with_prefixes, cap
        self.since: dict[int, int] = {}
        self.all = np.iinfo(self.kind).max

    def push(self, suffixes: np.ndarray, prefixes: np.ndarray, take: np.ndarray) -> None:
        """Scan these suffixes, in order; where ``take`` holds, the suffix before is pushed."""
        at = np.flatnonzero(take)
        if not len(at):
            if self.with_prefixes and len(prefixes):
                self._lower(int(prefixes.min()))
            return
        before = suffixes[at] - 1
        target = self.text[before]
        order = np.argsort(target, kind="stable")
        at, before, target = at[order], before[order], target[order]
        cuts = np.flatnonzero(target[1:] != target[:-1]) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
        shared = np.zeros(len(at), self.kind)
        if self.with_prefixes:
            least = _minima(prefixes)
            shared[1:] = least(np.minimum(at[:-1] + 1, at[1:]), at[1:])
            head = least(np.zeros(len(begins), np.int64), at[begins])
            tail = at[ends - 1] + 1
            rest = np.full(len(ends), self.all, self.kind)
            some = tail < len(prefixes)
            if some.any():
                rest[some] = least(tail[some], np.full(int(some.sum()), len(prefixes) - 1))
            keys = target[begins].tolist()
            old = [self.since.get(k, 0) for k in keys]
            shared[begins] = np.minimum(head, np.array(old, self.kind))
            self._lower(int(prefixes.min()))
            self.since.update(zip(keys, rest.tolist(), strict=True))
            shared = np.minimum(shared, self.cap - 1) + self.kind.type(1)
            fresh = [i for i, k in enumerate(keys) if k not in self.seen]
            shared[begins[fresh]] = 0
            self.seen.update(keys)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            self.queue.push(int(target[a]), before[a:b], shared[a:b])

    def _lower(self, least: int) -> None:
        for k, v in self.since.items():
            if v > least:
                self.since[k] = least

    @property
    def seen(self) -> set:
        return self.__dict__.setdefault("_seen", set())


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_prefixes: np.ndarray, memory: int, prefixes: bool, cap: int):
    """All suffixes in order, and common prefixes with the one before, from the sorted seeds."""
    symbols = np.unique(text).tolist()
    seed_at = np.searchsorted(text[seeds], symbols)
    seed_of = dict(zip(symbols, zip(seed_at, [*seed_at[1:], len(seeds)], strict=True), strict=True))
    n = len(text)
    last = n - 1
    kind = _kind(cap)
    large: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scan = _Scan(text, memory, prefixes, cap)
    # The last suffix is larger than the empty one after it, so it is the first large suffix of its symbol.
    first_of = int(text[last])
    if first_of:
        scan.queue.push(first_of, np.array([last]), np.zeros(1, kind))
        scan.seen.add(first_of)
        scan.since[first_of] = 0
    for c in symbols:
        if c == 0:
            s = np.flatnonzero(text == 0)
            scan.push(s, np.zeros(len(s), kind), (s > 0) & (text[s - 1] != 0))
            continue
        got: list[tuple[np.ndarray, np.ndarray]] = []
        while (wave := scan.queue.pop(c)) is not None:
            s, p = wave
            got.append(wave)
            scan.push(s, p, (s > 0) & (text[s - 1] >= c))
        if got:
            large[c] = (np.concatenate([s for s, _ in got]), np.concatenate([p for _, p in got]))
        a, b = seed_of[c]
        if a < b:
            s, p = seeds[a:b], seed_prefixes[a:b].copy()
            if c in large:
                p[0] = _common(text, large[c][0][-1:], s[:1], cap)[0] if prefixes else 0
            else:
                p[0] = 0
            scan.push(s, p, s > 0)
    scan = _Scan(text, memory, prefixes, cap)
    tail: list[tuple[np.ndarray, np.ndarray]] = []
    for c in reversed(symbols):
        got = []
        if c == 0:
            # Separators are ordered by position, whatever follows them.
            s = np.flatnonzero(text == 0)
            tail.append((s, np.zeros(len(s), kind)))
            break
        while (wave := scan.queue.pop(c)) is not None:
            s, p = wave
            got.append(wave)
            scan.push(s, p, (s > 0) & (text[s - 1] <= c))
        s = np.concatenate([x for x, _ in got])[::-1] if got else np.zeros(0, np.int64)
        down = np.concatenate([x for _, x in got]) if got else np.zeros(0, kind)
        up = np.zeros(len(s), kind)
        up[1:] = down[1:][::-1]
        if c in large:
            ls, lp = large.pop(c)
            lp = lp.copy()
            lp[0] = 0
            edge = _common(text, ls[-1:], s[:1], cap)[0] if prefixes and len(s) else kind.type(0)
            reverse = np.zeros(len(ls), kind)
            reverse[1:] = lp[1:][::-1]
            reverse[0] = edge
            rs = ls[::-1]
            scan.push(rs, reverse, (rs > 0) & (text[rs - 1] < c))
            if len(s):
                up[0] = edge
            s, up = np.concatenate([ls, s]), np.concatenate([lp, up])
        tail.append((s, up))
    tail.reverse()
    return np.concatenate([s for s, _ in tail]), np.concatenate([p for _, p in tail])


def _doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string that fits memory, by doubling ranks."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        if width < n:
            second[:-width] = rank[width:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        width *= 2


def suffix_order(text: np.ndarray, memory: int = 1 << 22, prefixes: bool = True, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order, and the common prefix of each with the one before (up to ``cap``)."""
    n, kind = len(text), _kind(cap)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, kind)
    if n > memory:
        shelf = np.memmap(tempfile.TemporaryFile(), text.dtype, "w+", shape=(n,))
        shelf[:] = text
        text = shelf
    small = _types(text)
    starts = small.copy()
    starts[1:] &= ~small[:-1]
    starts[0] = False
    # A separator is smaller than all that follows: it always seeds, and bounds every run.
    starts |= (text == 0) & small
    lms = np.flatnonzero(starts)
    none = np.zeros(len(lms), kind)
    if len(lms):
        rough = lms[np.argsort(text[lms], kind="stable")]
        order, _ = _induce(text, small, rough, none, memory, False, cap)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = order[is_lms[order]]
        names = _names(text, ranked, lms)
        if names.max() + 1 < len(lms):
            reduced = _by_position(names, ranked, lms)
            if len(reduced) <= memory:
                inner = _doubling(reduced)
            else:
                inner, _ = suffix_order(reduced + 1, memory, False, cap)
            ranked = lms[inner]
        lms_prefixes = np.zeros(len(ranked), kind)
        if prefixes and len(ranked) > 1:
            for k in range(0, len(ranked) - 1, 1 << 16):
                a, b = ranked[k : k + (1 << 16)], ranked[k + 1 : k + 1 + (1 << 16)]
                lms_prefixes[k + 1 : k + 1 + len(b)] = _common(text, a[: len(b)], b, cap)
    else:
        ranked, lms_prefixes = lms, none
    return _induce(text, small, ranked, lms_prefixes, memory, prefixes, cap)


def _by_position(names: np.ndarray, ranked: np.ndarray, lms: np.ndarray) -> np.ndarray:
    out = np.empty(len(lms), np.int64)
    out[np.searchsorted(lms, ranked)] = names
    return out


def _names(text: np.ndarray, ranked: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """A rank for the substring from each seed to the next one; those that touch a separator are all different."""
    following = np.append(lms, len(text))
    at = np.searchsorted(lms, ranked)
    length = np.minimum(following[at + 1], len(text) - 1) - ranked + 1
    ends = np.minimum(following[at + 1], len(text) - 1)
    alone = (text[ranked] == 0) | (text[ends] == 0) | (following[at + 1] >= len(text))
    new = np.ones(len(ranked), bool)
    maybe = np.flatnonzero((length[1:] == length[:-1]) & ~alone[1:] & ~alone[:-1])
    for k in range(0, len(maybe), 1 << 16):
        part = maybe[k : k + (1 << 16)]
        a, b, left = ranked[part], ranked[part + 1], length[part].copy()
        same, live, at_ = np.ones(len(part), bool), np.arange(len(part)), 0
        while len(live):
            x, y = a[live, None] + at_ + np.arange(8), b[live, None] + at_ + np.arange(8)
            inside = np.arange(8) < (left[live] - at_)[:, None]
            top = len(text) - 1
            equal = (text[np.minimum(x, top)] == text[np.minimum(y, top)]) | ~inside
            good = equal.all(axis=1)
            same[live[~good]] = False
            at_ += 8
            live = live[good & (left[live] > at_)]
        new[part[same] + 1] = False
    return np.cumsum(new) - 1
