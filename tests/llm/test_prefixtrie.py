import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from depthline.llm import prefixtrie as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, total long, at int"


def conversations(rows):
    """Turns of each conversation in order; ties by the digest of the turn."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            held[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in held.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - int(math.fmod(c, 20))  # the remainder of SQL: below 0 for c below 0
        out[c] = convs.get(lender, [])[:h] + own[h:]
    return out


def tree(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    rows = []
    for prefix, held in members.items():
        stack, leaves, saved = [prefix], 0, 0
        while stack:
            p = stack.pop()
            saved += (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
            leaves += not children[p]
            stack += children[p]
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(prefix))
        above = min(members[prefix[:-1]]) if prefix else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(held), len(prefix), above, len(held), len(children[prefix]), leaves, saved, digest))
    return sorted(rows, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(3)


def mixed():
    """Copies, shared heads, missing lenders, ties, nulls, a turnless one and one of many turns."""
    rng = np.random.default_rng(8)
    rows = []
    for c in [*range(0, 70), 101, 105, 119, 200, 207, 1000, 1001, 1019]:
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {rng.integers(0, 3)} more  words"[: int(rng.integers(4, 20))]))
    rows += [(40, t, "user", "same") for t in (3, 3, 3, None, None)]
    rows += [(303, 0, None, None), (304, None, "user", ""), (None, 1, "user", "lost"), (-21, 0, "user", "below"), (-1, 5, "a", "b")]
    rows += [(c, t, "user", f"long {t}") for c in (400, 402, 403, 405) for t in range(41 if c != 403 else 25)]
    rows += [(405, 41, "user", "tail")] + [(c, t, "user", "copy") for c in range(500, 560) for t in range(3)]
    return rows


def test_the_tree_of_shared_heads(spark):
    rows = mixed()
    turns = P.turn_rows(table(spark, rows))
    want = tree(rebuilt(conversations(rows)))
    for size in (P.SEGMENT, 8):
        got = P.nodes(*P.shared_heads(turns), segment=size).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_the_tree_of_conversations_as_they_are(spark):
    rows = [r for r in mixed() if r[0] is None or r[0] < 600]
    got = P.nodes(*P.paths(P.turn_rows(table(spark, rows))), segment=5).collect()
    assert sorted(map(tuple, got), key=str) == tree(conversations(rows))


def test_no_conversations(spark):
    empty = table(spark, [(1, 1, "a", "b")]).limit(0)
    assert P.nodes(*P.shared_heads(P.turn_rows(empty))).collect() == []
    lost = table(spark, [(None, 1, "a", "b"), (None, None, None, None)])
    assert P.nodes(*P.paths(P.turn_rows(lost))).collect() == []


def test_two_fattest_numbers():
    for a in range(40):
        for b in range(a + 1, 41):
            assert P.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda f: (f & -f, -f))


@pytest.mark.parametrize("seed", range(5))
def test_the_trie_by_insertion(seed):
    """Members and least members of every node, handles at the two-fattest depth, and few lookups."""
    rng = np.random.default_rng(seed)
    trie, paths = P.ZFastTrie(), []
    for member in rng.permutation(300):
        turns = rng.integers(0, 2 if seed % 2 else 5, int(rng.integers(1, 60))).tolist()
        if paths and rng.random() < 0.4:
            turns = paths[int(rng.integers(0, len(paths)))][1][: int(rng.integers(1, 60))]
        paths.append((int(member), turns))
        keys = b"".join(hashlib.sha256(bytes(turns[: d + 1])).digest()[: P.KEY_BYTES] for d in range(len(turns)))
        trie.insert(int(member), P.ROOT, 0, keys)
    held = {}
    for node in trie.settled():
        assert trie.handles[trie.key(node.ref, P.two_fattest(node.lo, node.hi))] is node
        for d in range(node.lo + 1, node.hi + 1):
            held[tuple(paths[node.ref][1][:d])] = (node.count, node.least)
    assert len(trie.handles) == len(trie.nodes)
    want = defaultdict(list)
    for member, turns in paths:
        for d in range(1, len(turns) + 1):
            want[tuple(turns[:d])].append(member)
    assert held == {p: (len(m), min(m)) for p, m in want.items()}
