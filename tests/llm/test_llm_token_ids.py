"""Grammar shards: exact round trips and random access."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rowloom.llm import grammar_ids as G

TOKENIZER = "byte_bpe_50k.json"


@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_round_trip(docs, seed):
    ids = np.array([i for d in docs for i in d], np.int64)
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    made = G.Grammar.from_bytes(G.Grammar.of(ids, ends).to_bytes())
    assert made.expand(made.symbols).tolist() == ids.tolist()
    rng = np.random.default_rng(seed)
    for k, d in enumerate(docs):
        a = int(rng.integers(0, len(d) + 1))
        n = int(rng.integers(0, 20))
        assert made.span(k, a, n).tolist() == d[a : a + n]
    width = made.widths(made.left) + made.widths(made.right) if len(made.left) else made.lengths
    assert (width == made.lengths).all()


def test_rules_shrink_repeats():
    ids = np.array(([5, 6, 7, 8] * 400) + [0], np.int64)
    made = G.Grammar.of(ids, np.array([len(ids)]))
    assert len(made.symbols) < 40 and len(made.left) >= 3
    assert made.expand(made.symbols).tolist() == ids.tolist()


@pytest.fixture(scope="module")
def tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(TOKENIZER))


def test_documents(spark, odd_docs, odd_rows, tokenizer):
    from public_tokenizers import path

    from rowloom.session import stage

    written = stage(G.shards(odd_docs, path(TOKENIZER), path("byte_bpe_50k.tiktoken"), shard_ids=3000), "ids")
    assert written.count() > 2
    ids = {}
    for r in odd_rows:
        ids.setdefault(r[0], []).append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])
    told = sorted(G.read_documents(written, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in told] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x))
    start, left = 0, {k: list(v) for k, v in ids.items()}
    for r in told:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        left[r["doc_id"]].remove(own)
        assert r["start"] == start and r["n_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        start += len(own)
    assert not any(left.values())
    wanted = spark.createDataFrame([(12, 10, 500), (12, 60_000, 5), (5, 0, 3), (9, 4, 10**6), (99, 0, 1)], "doc_id long, from_token long, n long")
    spans = G.read_spans(written, wanted).collect()
    assert len(spans) == 5  # document 5 comes twice, 99 never
    for s in spans:
        assert s["ids"] == ids[s["doc_id"]][0][s["from_token"] : s["from_token"] + s["n"]]


def test_no_documents(spark, no_docs):
    from public_tokenizers import path

    assert G.read_documents(G.shards(no_docs, path(TOKENIZER))).count() == 0
