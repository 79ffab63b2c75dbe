"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Texts with edge cases; ids may be null or repeated.
EDGES = [
    (90_001, None),
    (90_002, ""),
    (90_003, " \n\t "),
    (90_004, "one two"),
    (90_005, "ONE two"),
    (90_006, "x" * 300),
    (90_007, "x" * 299),
    (90_008, "tick tock " * 5000),
    (90_009, "tick tock " * 200 + "end\nof it\nall"),
    (90_010, "Größe 日本語 \U0001f600 ▁ é " * 12),
    (90_011, "a\r\nb\x00c  d e"),
    (90_012, "same row"),
    (90_012, "same row"),
    (None, "tick tock " * 50),
    (None, None),
]


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """Set size and component of each doc_id."""
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(sets):
        shared = collections.Counter(e for s in sets[d] for e in holders[s])
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def byte_repeats(rows: list[tuple[int | None, str | None]], width: int) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans and digest of what is left."""
    first: dict[bytes, int] = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - width + 1):
                if first[b[i : i + width]] < d:
                    gone[i : i + width] = b"\1" * width
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def word_repeats(rows: list[tuple[int | None, str | None]], width: int) -> list[tuple]:
    """doc_id, n_words, n_removed and digest of what is left."""
    count = collections.Counter()
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        if d is not None:
            count.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for d, w in words:
        gone = bytearray(len(w))
        if d is not None:
            for i in range(len(w) - width + 1):
                if count[tuple(w[i : i + width])] > 1:
                    gone[i : i + width] = b"\1" * width
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def pages(rows: list[tuple[int, str | None]]) -> set[tuple]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to."""
    holder: dict[bytes, int] = {}
    for p, h in rows:
        b = (h or "").encode()
        holder[b] = max(holder.get(b, p), p)
    out = set()
    for p, h in rows:
        b = (h or "").encode()
        kept = holder[b] == p
        out.add((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if kept else "revisit", None if kept else holder[b]))
    return out


def leaks(rows, benchmark, overlap: int, percent: int) -> set[tuple[int, int]]:
    """(doc_id, item_id) where `overlap` words in a row, or a whole shorter item, agree well enough at some shift."""
    out = set()
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    docs = [(d, split(t)) for d, t in rows]
    for item, text in benchmark:
        q = split(text)
        need = min(overlap, len(q))
        if not q:
            continue
        places = collections.defaultdict(list)
        for k, x in enumerate(q):
            places[x].append(k)
        for d, w in docs:
            equal = collections.Counter(i - k for i, x in enumerate(w) for k in places.get(x, ()))
            for shift, n in equal.items():
                if 100 * n < percent * need:
                    continue
                same = [w[shift + k] == q[k] if 0 <= shift + k < len(w) else None for k in range(len(q))]
                if any(None not in same[k : k + need] and 100 * sum(same[k : k + need]) >= percent * need for k in range(len(q) - need + 1)):
                    out.add((d, item))
                    break
    return out
