"""Near-duplicates and fingerprints, beside brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from rowloom.llm import near_dedup as near
from rowloom.llm import spotsigs


def word_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, over, under):
    sets = {i: word_set(t) for i, t in rows}
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) * under >= len(x | y) * over:
            a, b = top(a), top(b)
            least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def groups_of_copies(n_groups, size, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, at = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((at, " ".join(own)))
            at += 1
    return rows


@pytest.mark.parametrize("limit", [(85, 100), (80, 100)])
@pytest.mark.parametrize("groups", [(20, 5), (2, 60)])  # small buckets; large ones, in blocks
def test_components_of_edited_copies(spark, limit, groups, monkeypatch):
    rows = groups_of_copies(*groups, seed=3)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near.Threshold(*limit)).collect()
    want = brute_components(rows, *limit)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd_docs, unique_rows, odd_rows):
    rows = near.near_duplicates(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    want = brute_components([(i, r[1]) for i, r in unique_rows.items()], 85, 100)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {5, None}


def test_no_documents(no_docs):
    assert near.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("share,bands", [(85, 24), (80, 35), (100, 1)])
def test_bands_follow_from_the_threshold(share, bands):
    limit = near.Threshold(share, 100)
    assert limit.bands == bands and limit.registers == 5 * bands
    assert (1 - limit.share**5) ** bands <= near.MISSED < (1 - limit.share**5) ** (bands - 1)
    sketch = near.registers(np.arange(1, 900, dtype=np.uint64), limit.registers)
    assert near.band_keys(sketch).shape == (bands,)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    a, b = keys[:3000], keys[1000:]
    assert (near.merged(near.registers(a), near.registers(b)) == near.registers(keys)).all()
    same = float((near.registers(a) == near.registers(b)).mean())
    assert abs(same - len(np.intersect1d(a, b)) / len(keys)) < 0.15
    x, y = near.registers(a).astype(int), near.registers(b).astype(int)
    judge = lambda share: near.plausible(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([3000.0]), np.array([3000.0]), near.Threshold(share, 100))[0]
    assert judge(50) and not judge(95)


def signatures(text):
    anchors = set(spotsigs.ANCHORS)
    words = (text or "").lower().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    content, out, k = [w for w in words if w not in anchors], set(), 0
    for w in words:
        if w in anchors:
            if k + 2 <= len(content):
                out.add((w, *content[k : k + 2]))
        else:
            k += 1
    return out or ({tuple(words)} if words else set())


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(odd_docs, unique_rows, odd_rows):
    rows = spotsigs.fingerprints(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    ordered = sorted(unique_rows)
    seen = {}
    for r in rows:
        if r["doc_id"] is None:
            assert r["near_next"] == 0
            continue
        text = unique_rows[r["doc_id"]][1] or ""
        after = ordered[(ordered.index(r["doc_id"]) + 1) % len(ordered)]
        seen.setdefault(text, r["fingerprint"])
        assert seen[text] == r["fingerprint"]
        if r["doc_id"] == 5:  # a repeated row follows itself once
            continue
        following = unique_rows[after][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(signatures(text), signatures(edited)))
        assert r["near_next"] == pytest.approx(likeness(signatures(text), signatures(following)))
        assert len(r["fingerprint"]) == 8 * len(signatures(text))
    assert len(set(seen.values())) == len({frozenset(signatures(t)) for t in seen})


def test_fingerprints_of_texts_with_signs_and_without_anchors(spark, tmp_path):
    from rowloom.llm.queries import QUERIES

    plain = " ".join(f"the word{i} alpha{i}" for i in range(40))
    signs = plain.replace("the", "(the,").replace("word7 ", "word7!! ") + " --- &&&"
    bare = " ".join(f"name{i}" for i in range(400))
    rows = [(1, plain), (2, signs), (3, bare), (4, "other " + bare), (5, "one two three"), (6, "&&& !!! ---"), (7, "!"), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op6_fingerprints"](spark, str(tmp_path)).collect()}
    assert got[1]["near_next"] == 1.0 and len(got[2]["fingerprint"]) == 40 * 8
    assert got[3]["near_next"] > 0.95 and got[3]["near_edited"] > 0.3
    assert [len(got[i]["fingerprint"]) for i in (5, 6, 7, 8)] == [8, 8, 8, 0]


def test_fingerprints_of_nothing_and_one(spark, no_docs):
    assert spotsigs.fingerprints(no_docs).count() == 0
    (one,) = spotsigs.fingerprints(spark.createDataFrame([(4, "the old cat sat")], "doc_id long, text string")).collect()
    assert one["near_next"] == 1.0


def test_similar_pairs(spark):
    rng = random.Random(5)
    sets = {}
    for i in range(60):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.5 else set()
        sets[i] = {x for x in base if rng.random() < 0.95} | {rng.randrange(300) for _ in range(0 if base else rng.randrange(5, 40))}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id long, signatures array<long>")
    got = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.similar_pairs(df).collect()}
    want = {(a, b): likeness(sets[a], sets[b]) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.8}
    assert got == pytest.approx(want) and want
