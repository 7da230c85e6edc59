"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_duplicates(docs: dict[int, str | None], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest reachable doc_id), over every pair that shares a shingle."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    classes = defaultdict(list)
    for d in sorted(sets):
        classes[sets[d]].append(d)
    parent = {d: d for d in docs}

    def root(d: int) -> int:
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    def link(a: int, b: int) -> None:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    index = defaultdict(list)
    for own, members in classes.items():
        if not own:
            continue
        for d in members[1:]:
            link(members[0], d)
        shared = Counter(e for s in own for e in index[s])
        for e, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[e]) - both):
                link(members[0], e)
        for s in own:
            index[s].append(members[0])
    return {d: (len(sets[d]), root(d)) for d in docs}


def removed_bytes(docs: dict[int, str | None], length: int = 100) -> dict[int, bytearray]:
    """doc_id -> one flag per byte: covered by a string of ``length`` bytes that also starts earlier."""
    seen, out = set(), {}
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        flags = bytearray(len(raw))
        until = 0
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                for j in range(max(i, until), i + length):
                    flags[j] = 1
                until = i + length
            else:
                seen.add(window)
        out[d] = flags
    return out
