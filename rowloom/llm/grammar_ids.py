"""Token ids in binary shards, each compressed by a grammar of repeated pairs (Re-Pair)."""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from rowloom.llm.common import small_batches
from rowloom.llm.packing import REMEMBERED, ChunkIds, _Irregular
from rowloom.operators.index import prefix_offsets

#: A shard is closed once it holds so many ids; a document is never cut.
SHARD_IDS = 1 << 18
#: Appended to each document.
END_ID = 0
#: Uses from which on a pair gets a rule: a rule takes 12 bytes, a use saves 3.
LEAST_USES = 6
#: Rounds end when one shortens the sequence by less than this share.
LEAST_SHRINK = 1 / 64
#: A round gives rules to all pairs used at least 1 / so many times as often as the commonest.
NEAR_MOST = 64
#: Slots (log2) of the table that finds the pairs of a round; of two pairs in one slot, one waits for the next round.
SLOT_BITS = 18
#: Spans that one reader answers at once.
SPANS_AT_ONCE = 1024

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIQ")
SHARDS = "part int, nth int, n_tokens long, doc_ids array<long>, shard binary"


class Ids(ChunkIds):
    """Ids of chunks, with a cheaper look at new ones: much of the time goes into words that come once."""

    def __missing__(self, chunk: str) -> bytes:
        line = chunk[:1] == "\n"
        body = chunk[1:] if line else chunk
        if body.split() != [body]:
            raise _Irregular
        ids = self.short(chunk if line else " " + chunk)
        if len(self) < REMEMBERED:
            self[chunk] = ids
        return ids


_IDS: dict[tuple, Ids] = {}


def ids_of(path: str, ranks_path: str | None) -> Ids:
    """One memory per worker process."""
    if (path, ranks_path) not in _IDS:
        _IDS[path, ranks_path] = Ids(path, ranks_path)
    return _IDS[path, ranks_path]


@dataclass
class Grammar:
    """The ids of some documents. Symbols below ``base`` are ids, symbol base + i is rule i: two earlier symbols."""

    base: int
    left: np.ndarray = field(repr=False)
    right: np.ndarray = field(repr=False)
    #: Ids that each rule stands for.
    lengths: np.ndarray = field(repr=False)
    #: Where the symbols of each document end.
    ends: np.ndarray = field(repr=False)
    symbols: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, ids: np.ndarray, ends: np.ndarray) -> Grammar:
        """Round by round, every pair used nearly as often as the commonest (``NEAR_MOST``) gets a rule; no pair crosses the end of a document."""
        s = ids.astype(np.int64)
        last = np.zeros(len(s), bool)
        last[ends[ends > 0] - 1] = True
        base = int(s.max()) + 1 if len(s) else 0
        lengths = [np.ones(base, np.int64)]
        lefts, rights, n_symbols = [], [], base
        while len(s) > 1:
            code = (s[:-1] << 24) | s[1:]
            code[last[:-1]] = -1
            ordered = np.sort(code)
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            uses = np.diff(np.r_[first, len(ordered)])
            uses[ordered[first] < 0] = 0
            least = max(LEAST_USES, int(uses.max()) // NEAR_MOST)
            chosen = ordered[first[uses >= least]][: (1 << 24) - 1 - n_symbols]
            if not len(chosen):
                break
            at, rule = _occurrences(code, chosen)
            # Overlaps may leave a pair too few uses.
            used = np.bincount(rule, minlength=len(chosen))
            rule_no = np.cumsum(used >= LEAST_USES) - 1
            some = used[rule] >= LEAST_USES
            at, rule = at[some], rule_no[rule[some]]
            if len(at) < LEAST_SHRINK * len(s):
                break
            chosen = chosen[used >= LEAST_USES]
            lefts.append(chosen >> 24)
            rights.append(chosen & ((1 << 24) - 1))
            known = np.concatenate(lengths)
            lengths = [known, known[lefts[-1]] + known[rights[-1]]]
            s[at], last[at] = n_symbols + rule, last[at + 1]
            n_symbols += len(chosen)
            kept = np.ones(len(s), bool)
            kept[at + 1] = False
            s, last = s[kept], last[kept]
        none = np.zeros(0, np.int64)
        # Every document has an end of its own, an empty one that of the document before.
        done = np.r_[0, np.flatnonzero(last) + 1]
        filled = np.cumsum(np.diff(np.r_[0, ends]) > 0)
        return cls(base, np.concatenate([none, *lefts]), np.concatenate([none, *rights]), np.concatenate(lengths)[base:], done[filled], s)

    def widths(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        return np.concatenate([np.ones(self.base, np.int64), self.lengths])[symbols]

    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rules in a row, and where those of each rule begin."""
        body = np.stack([self.left, self.right], 1).ravel()
        while len(deep := np.flatnonzero(body >= self.base)):
            width = np.ones(len(body), np.int64)
            width[deep] = 2
            rule = body[deep] - self.base
            to = (np.cumsum(width) - width)[deep]
            body = np.repeat(body, width)
            body[to], body[to + 1] = self.left[rule], self.right[rule]
        return body, np.cumsum(self.lengths) - self.lengths

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        body, begin = self._rules()
        flat = np.r_[np.arange(self.base), body]
        begin = np.r_[np.arange(self.base), begin + self.base]
        width = self.widths(symbols)
        inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        return flat[np.repeat(begin[symbols], width) + inside]

    def span(self, doc: int, start: int, n: int) -> np.ndarray:
        """``n`` ids of one document from ``start`` on: only the symbols that reach into the span are expanded."""
        own = self.symbols[(self.ends[doc - 1] if doc else 0) : self.ends[doc]]
        reach = np.cumsum(self.widths(own))
        a = int(np.searchsorted(reach, start, "right"))
        b = int(np.searchsorted(reach, start + n, "left")) + 1
        skipped = int(reach[a - 1]) if a else 0
        return self.expand(own[a:b])[start - skipped : start - skipped + n]

    def to_bytes(self) -> bytes:
        """Head, rules (left, right, length), ends, then three bytes per symbol; all little-endian."""
        head = HEAD.pack(MAGIC, self.base, len(self.left), len(self.ends), len(self.symbols))
        tables = b"".join(a.astype("<u4").tobytes() for a in (self.left, self.right, self.lengths, self.ends))
        return head + tables + self.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Grammar:
        magic, base, n_rules, n_docs, n_symbols = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        table = np.frombuffer(data, "<u4", 3 * n_rules + n_docs, HEAD.size).astype(np.int64)
        left, right, lengths, ends = np.split(table, [n_rules, 2 * n_rules, 3 * n_rules])
        wide = np.zeros((n_symbols, 4), np.uint8)
        wide[:, :3] = np.frombuffer(data, np.uint8, 3 * n_symbols, HEAD.size + 4 * (3 * n_rules + n_docs)).reshape(-1, 3)
        return cls(base, left, right, lengths, ends, wide.view("<u4").ravel().astype(np.int64))


def _occurrences(code: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen pairs, no two of which overlap, and which pair each is."""
    slot = lambda c: ((c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    table = np.zeros(1 << SLOT_BITS, np.int32)
    table[slot(chosen)] = np.arange(len(chosen))
    rule = table[slot(code)]
    at = np.flatnonzero(chosen[rule] == code)
    if not len(at):
        return at, rule[at]
    # Of neighbouring occurrences every other one is taken, from the first.
    begin = np.r_[True, np.diff(at) > 1]
    run = at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
    at = at[(at - run) % 2 == 0]
    return at, rule[at]


def shards(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """part, nth, n_tokens, doc_ids, shard: the documents in ascending order of doc_id, in shards in the order of (part, nth).

    Rows are dealt to ranges of doc_id, rows of one id by a hash of their text, so that no id is hot; a task tokenises its range in
    order and closes a shard whenever it holds ``shard_ids`` ids, so memory is bounded by that and the longest text.
    Null doc_ids come first, null and empty texts are one end id, repeated rows are documents of their own, an empty
    table gives no shard. Other columns are not read. Both paths must be readable on every executor.
    """
    small_batches(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part, nth = ids_of(tokenizer_path, ranks_path), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held, ends = bytearray(), []

        def close() -> pa.RecordBatch:
            grammar = Grammar.of(np.frombuffer(bytes(held), "<u4"), np.array(ends, np.int64))
            columns = [[part], [nth], [len(held) // 4], [list(doc_ids)], [grammar.to_bytes()]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "nth", "n_tokens", "doc_ids", "shard"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += chunks.ids(text or "") + end
                doc_ids.append(doc_id)
                ends.append(len(held) // 4)
                if ends[-1] >= shard_ids:
                    yield close()
                    nth += 1
                    doc_ids.clear(), held.clear(), ends.clear()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(cut, SHARDS)


def shard_starts(written: DataFrame) -> DataFrame:
    """part, nth, base: how many ids lie in all shards before. One row per task of the writer goes through a single window."""
    sizes = written.select("part", "nth", "n_tokens")
    parts = prefix_offsets(sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n", "before").select("part", "before")
    inside = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(parts, "part").select("part", "nth", (F.col("before") + F.col("inside")).alias("base"))


def read_documents(written: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, on request, ids (little-endian uint32), of every document of the shards ``written``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grammar = Grammar.from_bytes(batch.column(3)[k].as_buffer().to_pybytes())
                ids = grammar.expand(grammar.symbols).astype("<u4").tobytes()
                reach = np.r_[0, np.cumsum(grammar.widths(grammar.symbols))]
                ends = reach[grammar.ends]
                begins = np.r_[0, ends[:-1]]
                own = [ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(own)
                arrays = [
                    pa.array(np.full(n, batch.column(0)[k].as_py(), np.int32)),
                    pa.array(np.full(n, batch.column(1)[k].as_py(), np.int32)),
                    batch.column(2).slice(k, 1).flatten(),
                    pa.array(begins),
                    pa.array(ends - begins),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                names = ["part", "nth", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    found = written.select("part", "nth", "doc_ids", "shard").mapInArrow(
        decode, "part int, nth int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    )
    return found.join(shard_starts(written), ["part", "nth"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def read_spans(written: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, from_token, n, ids for each row (doc_id, from_token, n) of ``wanted``: what lies in the document of that span.

    Only the symbols that reach into a span are expanded. Spans meet their shard in lists of at most ``SPANS_AT_ONCE``. Ids that no
    shard has give no row; of an id with several documents each gives one.
    """
    places = written.select("part", "nth", F.posexplode("doc_ids").alias("place", "doc_id"))
    asked = wanted.select(F.col("doc_id").cast("long"), F.col("from_token").cast("long"), F.col("n").cast("long")).join(places, "doc_id")
    order = W.partitionBy("part", "nth").orderBy("place", "from_token", "n")
    listed = (
        asked.withColumn("list", F.floor((F.row_number().over(order) - 1) / SPANS_AT_ONCE))
        .groupBy("part", "nth", "list")
        .agg(F.collect_list(F.struct("doc_id", "place", "from_token", "n")).alias("spans"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grammar = Grammar.from_bytes(batch.column(1)[k].as_buffer().to_pybytes())
                spans = batch.column(0)[k].as_py()
                ids = [grammar.span(s["place"], s["from_token"], s["n"]).tolist() for s in spans]
                arrays = [pa.array([s[c] for s in spans], pa.int64()) for c in ("doc_id", "from_token", "n")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "from_token", "n", "ids"])

    met = listed.join(written.select("part", "nth", "shard"), ["part", "nth"])
    return met.select("spans", "shard").mapInArrow(read, "doc_id long, from_token long, n long, ids array<long>")
