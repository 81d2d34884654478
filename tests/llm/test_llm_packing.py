"""Token pieces against the tokenizer itself; packing; mixing."""

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path

from rowloom.llm import mixing, packing

BPE, RANKS = path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(rows, docs, most=1024):
    """Every document whole, in pieces of which only the first may be short."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, text in docs.items():
        ids = ids_of(text)
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == most for r in own[1:]) and own[0]["length"] <= most
        at = 0
        for r in own:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]).tobytes())
            at += r["length"]


def check_sequences(rows, most=1024):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences)


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_pieces_of_odd_rows(odd_docs, unique_rows, odd_rows, ranks):
    rows = packing.token_pieces(odd_docs, BPE, ranks).filter("doc_id IS NOT NULL AND doc_id <> 5").collect()
    check_pieces(rows, {i: r[1] for i, r in unique_rows.items() if i != 5})


@pytest.mark.parametrize("group", [3, 10_000])  # several rounds, and one
def test_packing_of_odd_rows(odd_docs, group):
    pieces = packing.token_pieces(odd_docs, BPE, RANKS).cache()
    rows = packing.pack(pieces, group_pieces=group).collect()
    key = lambda r: tuple((v is None, v or 0) for v in (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert sorted(map(key, rows)) == sorted(map(key, pieces.collect()))
    n = check_sequences(rows)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_no_documents(no_docs):
    assert packing.pack(packing.token_pieces(no_docs, BPE)).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i * 40)) for i in range(40)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, BPE, RANKS, with_ids=True).cache()
    packed = packing.pack(pieces.drop("ids")).cache()
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed, pieces).collect()}
    for r in packed.collect():
        own = whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(own) == r["ids_crc32"]


def test_local_search_empties_bins():
    # Best fit leaves 6+4, 6+4 apart from 5+5: exchanges bring each bin to its room.
    bins = packing.Bins([5, 5, 5, 5, 6, 4, 6, 4], 10)
    bins.items, bins.fill = [[0, 5], [1, 7], [2, 3], [4], [6]], [9, 9, 10, 6, 6]
    before = sum(f * f for f in bins.fill)
    bins.search()
    assert sum(f > 0 for f in bins.fill) == 4 and sum(f * f for f in bins.fill) > before
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.randrange(1, 60) for _ in range(80)]
        bins = packing.Bins(lengths, 100)
        bins.best_fit()
        n = sum(f > 0 for f in bins.fill)
        bins.search()
        assert sum(f > 0 for f in bins.fill) <= n
        assert sorted(i for b in bins.items for i in b) == list(range(80))
        assert all(f == sum(lengths[i] for i in b) <= 100 for f, b in zip(bins.fill, bins.items))


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_targets():
    assert mixing.share_out([100, 100, 100]) == pytest.approx([50, 100, 150])
    assert mixing.share_out([1000, 10, 10]) == pytest.approx([960, 30, 30])  # the excess goes to those with room
    assert mixing.share_out([0, 10]) == pytest.approx([0, 10])
    assert mixing.share_out([]) == []


def test_mix_of_odd_rows(odd_docs, odd_rows):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    sizes = sorted(len((r[1] or "").encode().split()) for r in odd_rows)
    assert sorted(r["size"] for r in rows) == sizes
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None]
    total = {n: sum(r["size"] for r in rows if r["source"] == n) for n in names}
    want = dict(zip(names, mixing.share_out([total[n] for n in names])))
    for r in rows:
        assert (r["source_size"], r["target"]) == (total[r["source"]], pytest.approx(want[r["source"]]))
    assert sorted(map(str, mixing.mix(odd_docs.repartition(5)).collect())) == sorted(map(str, rows))


def test_mix_meets_targets(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "repeat('w ', int(20 + id % 300)) AS text", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    rows = mixing.mix(docs).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(taken / target - 1) < 0.03 for taken, target in by.values())


def test_mix_of_nothing(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    (row,) = mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert (row["size"], row["taken"], row["target"]) == (0, 0, 0.0)
