"""The z-fast trie beside a trie of dictionaries."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from rowloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def walk(n):
        own = (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        below = [walk(k) for k in kids.get(n, [])]
        return (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))

    out = []
    for n, members in nodes.items():
        leaves, saved = walk(n)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(n)))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(members), len(n), parent, len(members), len(kids.get(n, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    extra = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("depth", "rep", "at", "pos", "block", "p1")})
    return sorted(map(tuple, T.prefix_trie(extra).collect()), key=str)


def test_mixed_conversations(spark):
    rows = []
    for c in range(40):
        for t in range(c % 11):
            text = f"say {min(t, 3)} {c % 3 if t > 2 else ''}"
            rows.append((c, t if t else None, "user" if t % 2 == 0 else None, text if t % 5 else None))
    rows += [(100, 0, "user", "é" * 9), (100, 1, "", ""), (101, 5, None, None), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(103, t, "user", f"long {t % 4}") for t in range(300)] + [(104, t, "user", f"long {t % 4}") for t in range(150)]
    rows += [(900 + k, t, "user", "hot") for k in range(25) for t in range(k % 14 + 1)]
    assert got(spark, rows) == brute(rows)


def test_repeated_turns_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(T, "LIST_BYTES", 20)
    monkeypatch.setattr(T, "BLOCK_TURNS", 4)
    rows = [(c, t, "user", "same") for c in range(0, 300, 5) for t in range(9)] + [(5, 1, "user", "same"), (-7, 1, "a", "b"), (-5, 0, "a", "b")]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(3, 0, "a", "b")]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    told = spark.createDataFrame(pairs, "a long, b long").select("a", "b", T.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in told:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)
