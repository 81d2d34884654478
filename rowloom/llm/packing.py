"""Best-fit packing of tokenised documents, improved by a swap-based local search."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import remember_only, small_batches
from rowloom.session import stage

MAX_TOKENS = 1024
#: Appended to each document.
END_ID = 2
#: Pieces that one task packs, on average.
GROUP_PIECES = 16384
#: Groups whose open bins meet in the next round, as a power of two, and the bins each group may release.
MEET_BITS, RELEASED = 6, 64
#: Bins that may give their pieces away, for each bin that could be saved.
GIVING = 4
#: The tokenizer's one special token.
SPECIAL = "<|endoftext|>"
#: Tokenised chunks that a worker remembers.
REMEMBERED = 600_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Irregular(Exception):
    """The text has white space that the chunk rule does not cover."""


class ChunkIds(dict):
    """Token ids, as little-endian bytes, of a chunk: a run of non-space characters with the space or newline before it.

    The byte-level tokenizer never joins characters across such a boundary when
    white space comes one character at a time, so ids of chunks add up to the ids of the text.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = _ranked(ranks_path) if ranks_path else None

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def short(self, text: str) -> bytes:
        """As ``plain``; the ranks of the same vocabulary are faster on short texts but know no special token."""
        if self.ranks is None or SPECIAL in text:
            return self.plain(text)
        return array("I", self.ranks.encode_ordinary(text)).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        line = chunk[:1] == "\n"
        if len(chunk) == line or re.search(r"\s", chunk[line:]):
            raise _Irregular
        ids = self.short(chunk if line else " " + chunk)
        if len(self) < REMEMBERED:  # frequent chunks come early
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = text.replace("\n", " \n").split(" ")
        try:
            if not chunks[0] or re.search(r"\s", chunks[0]):
                raise _Irregular
            return self.short(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))
        except _Irregular:
            return self.plain(text)


def _ranked(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_CHUNKS: dict[tuple, ChunkIds] = {}


def chunk_ids(path: str, ranks_path: str | None = None) -> ChunkIds:
    """One memory per worker process; tasks that follow in the process go on with it."""
    remember_only("chunks", _CHUNKS.clear)
    if (path, ranks_path) not in _CHUNKS:
        _CHUNKS[path, ranks_path] = ChunkIds(path, ranks_path)
    return _CHUNKS[path, ranks_path]


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than ``most``."""
    first = n % most or most
    return [(0, min(first, n)), *((s, most) for s in range(first, n, most))]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, the ids as little-endian uint32 bytes.

    Both paths must be readable on every executor; ``ranks_path``, the same vocabulary as ranks, only saves time.
    A null or empty text is one piece that holds the end id alone. Repeated rows give repeated pieces.
    """
    small_batches(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(tokenizer_path, ranks_path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(chunks.ids(text or "") + end)
                for k, (start, length) in enumerate(cuts(len(ids) // 4, max_tokens)):
                    own = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(own), bytes(own) if with_ids else None)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(v, t) for v, t in zip(out, types)][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


class Bins:
    """Bins of one group, searchable by free space."""

    def __init__(self, lengths: list[int], room: int):
        self.lengths, self.room = lengths, room
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        open_at: list[list[int]] = [[] for _ in range(self.room + 1)]
        mask = 0
        for i in np.argsort(-np.asarray(self.lengths, dtype=np.int64), kind="stable").tolist():
            size = self.lengths[i]
            fits = mask >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                b = open_at[free].pop()
                if not open_at[free]:
                    mask &= ~(1 << free)
                self.items[b].append(i)
                self.fill[b] += size
                free -= size
            else:
                b, free = len(self.items), self.room - size
                self.items.append([i])
                self.fill.append(size)
            if free:
                open_at[free].append(b)
                mask |= 1 << free

    def underfull(self) -> list[int]:
        return sorted((b for b in range(len(self.fill)) if 0 < self.fill[b] < self.room), key=lambda b: self.fill[b])

    def _shift(self, source: int, target: int, out: tuple[int, ...], back: tuple[int, ...]) -> None:
        """Move ``out`` from source to target and ``back`` the other way."""
        for a, b, moved in ((source, target, out), (target, source, back)):
            for i in moved:
                self.items[a].remove(i)
                self.items[b].append(i)
                self.fill[a] -= self.lengths[i]
                self.fill[b] += self.lengths[i]

    def _gain(self, source: int, target: int) -> bool:
        """One exchange that makes target fuller by what source loses, with more squared fill in all."""
        free, behind = self.room - self.fill[target], self.fill[source] - self.fill[target]
        size = self.lengths
        worth = lambda d: 0 < d <= free and d > behind
        best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None

        def offer(d: int, out: tuple[int, ...], back: tuple[int, ...]) -> None:
            nonlocal best
            if worth(d) and (best is None or d > best[0]):
                best = (d, out, back)

        own, other = self.items[source], self.items[target]
        for a in own:
            offer(size[a], (a,), ())
            for b in other:
                offer(size[a] - size[b], (a,), (b,))
        if best is None or best[0] < free:
            for x, y in ((own, other), (other, own)):
                for k, p in enumerate(x):
                    for q in x[k + 1 :]:
                        for one in y:
                            d = size[p] + size[q] - size[one]
                            if x is own:
                                offer(d, (p, q), (one,))
                            else:
                                offer(-d, (one,), (p, q))
        if best:
            self._shift(source, target, best[1], best[2])
        return best is not None

    def search(self) -> None:
        """Exchanges and moves from emptier to fuller bins until none raises the sum of squared fills.

        Every step raises an integer that is bounded by bins * room**2, so the
        search ends. It also ends once no fewer bins can hold the documents. The emptiest bins give
        (``GIVING`` for each bin that the sum of lengths leaves to be saved), the fullest ones that are not full take.
        """
        least = -(-sum(self.lengths) // self.room)
        moved = True
        while moved and (excess := sum(f > 0 for f in self.fill) - least) > 0:
            moved = False
            open_bins = self.underfull()
            for source in open_bins[: GIVING * excess]:
                for target in reversed(open_bins):
                    while source != target and 0 < self.fill[source] and self.fill[target] < self.room and self._gain(source, target):
                        moved = True
                    if not self.fill[source]:
                        break

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """Bin number and offset of each item; emptied bins leave no number."""
        bins, offsets = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths), np.int64)
        for number, own in enumerate(o for o in self.items if o):
            at = 0
            for i in own:
                bins[i], offsets[i] = number, at
                at += self.lengths[i]
        return bins, offsets


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, batch long, sequence_id long, offset long, released boolean"


def _pack_groups(pieces: DataFrame, room: int, level: int, last: bool) -> DataFrame:
    """Pack each group (column ``batch``); all but the last round release the emptiest bins."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        bins = Bins(rows["length"].tolist(), room)
        bins.best_fit()
        bins.search()
        number, offset = bins.place()
        fill = np.bincount(number, weights=rows["length"]) if len(rows) else np.zeros(0)
        free = np.zeros(len(fill), bool)
        if not last:
            emptiest = np.argsort(fill, kind="stable")[:RELEASED]
            free[emptiest[fill[emptiest] < room]] = True
        # Rounds and groups share no numbers: level, group and bin each have their bits.
        first = (level << 58) + (int(key[0]) << 24)
        return rows.assign(sequence_id=first + number, offset=offset, released=free[number])

    return pieces.groupBy("batch").applyInPandas(pack, PLACED)


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32), gapless within a sequence.

    Pieces are dealt to groups by hash. Each group is packed best-fit, then by
    local search (``Bins.search``), and all but its emptiest bins are final. The
    released pieces of 2**MEET_BITS groups meet in the next round, until one
    group is left, so that the bins that no group could fill are filled
    together. Equal pieces and ties are ordered by id; an empty table gives no rows.
    """
    n = pieces.count()
    left = max(1, -(-n // group_pieces))
    now = pieces.withColumn("batch", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(left)))
    final, level = None, 0
    while True:
        last = left == 1
        packed = stage(_pack_groups(now, max_tokens, level, last), f"packed{level}")
        done = packed if last else packed.filter("NOT released")
        final = done if final is None else final.unionByName(done)
        if last:
            return final.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        left, level = (left + (1 << MEET_BITS) - 1) >> MEET_BITS, level + 1
        now = packed.filter("released").select(*pieces.columns, F.shiftright("batch", MEET_BITS).alias("batch"))


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, for training. A sequence is bounded by its room."""
    key = ["doc_id", "piece"]
    parts = packed.join(pieces_with_ids.select(*key, "ids").dropDuplicates(key), key)
    joined = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(joined, lambda p: p["hex"]), "")).alias("ids"))
