"""The prefix trie against a plain one."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

from termloom.llm import trie

rng = np.random.default_rng(13)
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, mark(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows):
    got = [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_a_plain_trie(spark):
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 215), -150, -100, -7, 10**12]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ("user", "assistant")[t % 2], f"é{rng.integers(3)}" * int(rng.integers(1, 3))))
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, None, "user", ""), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "b"), (None, 1, "user", "x"), (0, 3, "", "p"), (0, None, "1:", "p"), (7, 1, "user", "a")]
    rows += [(7, t, "user", "long " * 20_000) for t in range(2, 5)] + [(9, t, "user", "x") for t in range(40)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[5:6]) == set()
    assert found(spark, []) == set()
    assert found(spark, rows[:1]) == plain(rows[:1])
    clash = spark.createDataFrame([(1, 0, "u", "t", 5, "m")], f"{SCHEMA}, node long, mark string")
    assert {tuple(r) for r in trie.prefix_trie(clash).select(*COLUMNS).collect()} == plain([(1, 0, "u", "t")])


def test_conversations_that_end_up_alike(spark, monkeypatch):
    """Very many conversations end in one node; their ids are digested in pieces."""
    rows = [(c, t, "user", f"turn {t}") for c in range(3000) for t in range(2)]
    assert found(spark, rows) == plain(rows)
    ends = spark.createDataFrame([(1, 7, c) for c in range(2000)] + [(0, -3, -5), (2, 7, 7), (2, 7, -10)], "depth long, node long, conv_id long").repartition(5)
    monkeypatch.setattr(trie, "PIECE", 9)
    got = {(r["depth"], r["node"]): r["ends_sha256"] for r in trie.id_digests(ends).collect()}
    of = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 7): of(range(2000)), (0, -3): of([-5]), (2, 7): of([-10, 7])}
