"""Language-model scoring: a probabilistic suffix tree over tokens, grown and read where the contexts of one last token lie together."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from rowloom.llm.common import partitions_of, small_batches, text_bytes
from rowloom.llm.words import REMEMBERED
from rowloom.session import drop_staged, stage, stage_buckets

#: Longest context in tokens.
DEPTH = 3
#: Uses from which on a context is looked at, in a corpus of any size.
LEAST_USES = 4
#: A context is kept if it explains what follows so much better than its suffix does (nats), and for each continuation.
LEAST_GAIN, GAIN_EACH = 8.0, 1.0
#: Weight, in observations, of the shorter context when a longer one is smoothed.
SMOOTHING = 8.0
#: A chunk of texts is closed once it holds so many tokens; a text is never cut.
CHUNK_TOKENS = 1 << 17
#: Tokens of chunks, each once per chunk, that are counted and numbered together, on average.
BUCKET_WORDS = 1 << 20
#: A batch handed to Python holds about so many bytes.
BATCH_BYTES = 16 << 20
#: Slices, by last token, that one after another lie on disk (at most 126); positions of one part of a slice, on average.
SLICES, PART_POSITIONS = 4, 1 << 18
#: Training uses from which on the contexts of a token are dealt to several parts.
HOT_USES = 1 << 18
#: Positions after a hot token whose pairs are added up together, on average.
HOT_POSITIONS = 1 << 19

#: How chunks are written: packed arrays of small numbers shrink by it, unlike by Spark's default.
CODEC = "zstd"

#: Codes of the end of a text; those of words are digests.
END = 0x14057B7EF767814F
#: Numbers of what is no word of the training texts: nothing, the start of a text, an unseen token. Words follow.
NONE, START, UNSEEN, FIRST = 0, 1, 2, 3


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair of numbers."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.astype(np.uint64) ^ np.uint64(0xD1B54A32D192ED03))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each column of several rows."""
    key = mixed(columns[0], columns[1])
    for row in columns[2:]:
        key = mixed(key, row)
    return key


@dataclass
class Counts:
    """Totals of the training tokens, ends included."""

    tokens: int
    kinds: int
    #: What the counts suggest to take off each count of a token for those never seen.
    discount: float = 0.75
    #: All texts, those to score alone included.
    texts: int = 0
    hot_uses: int = HOT_USES
    slices: int = SLICES

    def base_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def share(self, c: np.ndarray) -> np.ndarray:
        """Discounted share of a token of all tokens; those never seen count as one."""
        unseen = self.discount * self.kinds / self.tokens if self.tokens else 1.0
        return np.where(c > 0, (c - self.discount) / max(1, self.tokens), unseen)


#: Bytes of a number in a packed array.
WIDTHS = (1, 2, 3, 4, 8)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as hold the largest; the first byte tells how many."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in WIDTHS if most < 1 << (8 * w))
    wide = np.ascontiguousarray(values, "<u8" if width == 8 else "<u4").view(np.uint8).reshape(len(values), -1)
    return bytes([width]) + wide[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    if width in (1, 2, 4, 8):
        return np.frombuffer(data, f"<u{width}", offset=1).astype(np.int64)
    wide = np.zeros(((len(data) - 1) // width, 4), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return wide.view("<u4").ravel().astype(np.int64)


class Codes(dict):
    """The digest of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxh3_64_intdigest(word)
        return code


CHUNKS = "first long, doc_ids array<long>, learn binary, sizes binary, words binary, used binary, places binary, n_words long, n_tokens long"


def read_chunks(docs: DataFrame, learn: Column) -> DataFrame:
    """Chunks of whole texts: the number of the first text (unique over all chunks), ids, marks and token counts of the texts, the
    distinct tokens in ascending order, their uses in texts to learn from, and for each token of each text its place among them.

    A text is its words, A-Z lower-cased, and one end.
    """
    chunk_tokens = CHUNK_TOKENS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        first = TaskContext.get().partitionId() << 36
        doc_ids, marks, sizes, codes = [], [], [], array("Q")
        types = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64())

        def close() -> pa.RecordBatch:
            found, inverse = np.unique(np.frombuffer(codes, np.uint64), return_inverse=True)
            used = np.bincount(inverse[np.repeat(np.array(marks, bool), sizes)], minlength=len(found))
            values = (first, doc_ids, packed(np.array(marks, np.int64)), packed(np.array(sizes)), found.tobytes(), packed(used), packed(inverse), len(found), len(codes))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            for doc_id, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.lower().split()
                codes.extend(map(known.__getitem__, words))
                codes.append(END)
                doc_ids.append(doc_id), marks.append(bool(mark)), sizes.append(len(words) + 1)
                if len(codes) >= chunk_tokens:
                    yield close()
                    first += len(sizes)
                    doc_ids, marks, sizes, codes = [], [], [], array("Q")
                if len(known) > REMEMBERED:
                    known.clear()
        if sizes:
            yield close()

    texts = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return texts.mapInArrow(scan, CHUNKS)


TOLD = "first long, bucket long, numbers binary, uses binary, tokens long, kinds long, once long, twice long"


def told_words(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """Numbers and training uses of the tokens of each chunk, those in one bucket (a range of codes) together in one value.

    Totals of the training tokens of a bucket stand once, with one of its chunks.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], np.uint64)
        for batch in batches:
            for first, own, used in zip(*(c.to_pylist() for c in batch.columns)):
                own, used = np.frombuffer(own, np.uint64), unpacked(used)
                ends = [0, *np.searchsorted(own, bounds), len(own)]
                mine = [(b, i, j) for b, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
                values = [[b for b, _, _ in mine], [first] * len(mine), [own[i:j].tobytes() for _, i, j in mine], [packed(used[i:j]) for _, i, j in mine]]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["bucket", "first", "words", "used"])

    def tell(asked: pa.Table) -> pa.Table:
        bucket = asked.column("bucket")[0].as_py()
        words = [np.frombuffer(w, np.uint64) for w in asked.column("words").to_pylist()]
        found, inverse = np.unique(np.concatenate(words), return_inverse=True)
        used = np.concatenate([unpacked(u) for u in asked.column("used").to_pylist()])
        n = np.bincount(inverse, weights=used, minlength=len(found)).astype(np.int64)
        number = np.where(n > 0, (np.cumsum(n > 0) - 1) * n_buckets + bucket + FIRST, UNSEEN)[inverse]
        uses, ends = n[inverse], np.cumsum([len(w) for w in words])[:-1]
        totals = [int(v) for v in (n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum())]
        once = [pa.array([v] + [0] * (len(words) - 1), pa.int64()) for v in totals]
        values = [pa.array([packed(v) for v in np.split(all_, ends)], pa.binary()) for all_ in (number, uses)]
        return pa.table([asked.column("first"), asked.column("bucket"), *values, *once], names=[c.split()[0] for c in TOLD.split(", ")])

    asked = chunks.select("first", "words", "used").mapInArrow(ask, "bucket long, first long, words binary, used binary")
    return asked.groupBy("bucket").applyInArrow(tell, TOLD)


@dataclass
class Chunk:
    """One chunk: the sizes, ends and marks of its texts, the place of each token, number and uses of each place."""

    sizes: np.ndarray
    marks: np.ndarray
    places: np.ndarray
    numbers: np.ndarray
    uses: np.ndarray
    counts: Counts

    def take(self, at: np.ndarray) -> Positions:
        ends = np.cumsum(self.sizes)
        row = np.searchsorted(ends, at, "right")
        inside = at - (ends - self.sizes)[row]
        place = self.places[at]
        heat = self.uses > self.counts.hot_uses
        tokens, hot = [self.numbers[place]], []
        for back in range(1, DEPTH + 1):
            within = inside >= back
            before = self.places[np.where(within, at - back, 0)]
            start = np.where(inside == back - 1, START, NONE)
            tokens.append(np.where(within, self.numbers[before], start))
            hot.append(np.where(within, heat[before], (start == NONE) | (self.counts.texts > self.counts.hot_uses)))
        return Positions(row, self.marks[row].astype(bool), tokens, self.uses[place], hot, heat[place])


@dataclass
class Positions:
    """Some positions of a chunk: its text, mark, token t with the one to three tokens w, c2, c3 before it, and the uses of t."""

    rows: np.ndarray
    learn: np.ndarray
    tokens: list[np.ndarray]
    uses: np.ndarray
    #: Whether w, c2, c3 and t are hot.
    hot: list[np.ndarray]
    hot_next: np.ndarray

    def key(self, at: np.ndarray) -> np.ndarray:
        """What each position is dealt by: its last token; of hot contexts, the tokens before as well, then what follows, then its place ``at``."""
        t, *before = self.tokens
        key, split = mixed(before[0], np.zeros_like(t)), np.flatnonzero(self.hot[0])
        for k in range(1, DEPTH):
            key[split] = mixed(key[split], before[k][split])
            split = split[self.hot[k][split]]
        key[split] = mixed(key[split], t[split])
        split = split[self.hot_next[split]]
        key[split] = mixed(key[split], at[split])
        return mixed(key, np.ones_like(t))

    def part(self, at: np.ndarray, n_parts: int, counts: Counts) -> np.ndarray:
        """The part of each position within its slice."""
        return (self.key(at) // np.uint64(counts.slices) % np.uint64(n_parts)).astype(np.int64)

    def table(self) -> np.ndarray:
        """FIELDS as rows, one column per position; the last one holds the text and four marks."""
        row = self.rows << 4 | self.learn.astype(np.int64) << 3
        for bit, heat in enumerate(self.hot):
            row |= heat.astype(np.int64) << bit
        return np.stack([*self.tokens, self.uses, row])


FIELDS = ("t", "w", "c2", "c3", "uses", "row")
#: Slice of the positions after an unseen token, which every context leaves to the root; mark of positions after a hot token.
ROOT, HOT = 127, 128
WHOLE = (
    "first long, doc_ids array<long>, sizes binary, learn binary, places binary, numbers binary, uses binary, slices binary, known binary, base binary, rooted binary, n_hot long"
)


def numbered(chunks: DataFrame, told: DataFrame, counts: Counts) -> DataFrame:
    """The chunks with numbers and training uses of their tokens instead of the tokens, the slice of each position, and the sums of each text."""

    def settle(_, chunk: pa.Table, told: pa.Table) -> pa.Table:
        first, doc_ids, learn, sizes, places = (chunk.column(c)[0].as_py() for c in ("first", "doc_ids", "learn", "sizes", "places"))
        # Buckets are ranges, so one after another they hold the tokens in ascending order.
        told = told.sort_by("bucket")
        numbers, uses = (np.concatenate([unpacked(v) for v in told.column(c).to_pylist()]) for c in ("numbers", "uses"))
        c = Chunk(unpacked(sizes), unpacked(learn), unpacked(places), numbers, uses, counts)
        every = np.arange(len(c.places))
        p = c.take(every)
        slices = (p.key(every) % np.uint64(counts.slices)).astype(np.uint8)
        slices[p.tokens[1] == UNSEEN] = ROOT
        slices[p.hot[0]] |= HOT
        rooted = np.where(p.tokens[1] == UNSEEN, np.log10(counts.share(uses))[c.places], 0.0)
        sums = [np.bincount(p.rows, weights=v, minlength=len(c.sizes)) for v in (p.uses > 0, counts.base_log(uses)[c.places], rooted)]
        values = [first, doc_ids, sizes, learn, places, packed(numbers), packed(uses), slices.tobytes(), *[v.astype("<f8").tobytes() for v in sums], int(p.hot[0].sum())]
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 9, pa.int64()]
        return pa.table([pa.array([v], t) for v, t in zip(values, types)], names=[f.split()[0] for f in WHOLE.split(", ")])

    own = chunks.select("first", "doc_ids", "learn", "sizes", "places")
    return own.groupBy("first").cogroup(told.select("first", "bucket", "numbers", "uses").groupBy("first")).applyInArrow(settle, WHOLE)


READ = ["first", "learn", "sizes", "places", "numbers", "uses", "slices"]


def _chunks(batch: pa.RecordBatch, counts: Counts) -> Iterator[tuple[int, Chunk, np.ndarray]]:
    """Number, chunk, and slices of each row of READ."""
    for k in range(batch.num_rows):
        first, learn, sizes, places, numbers, uses, slices = (batch.column(c)[k].as_py() for c in READ)
        yield first, Chunk(*map(unpacked, (sizes, learn, places, numbers, uses)), counts), np.frombuffer(slices, np.uint8)


def text_scores(whole: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, and score: what the slices add to the tokens after an unseen one, which every context leaves to the root."""

    def tell(_, chunk: pa.Table, told: pa.Table) -> pa.Table:
        sizes = unpacked(chunk.column("sizes")[0].as_py())
        known, base, total = (np.frombuffer(chunk.column(c)[0].as_py(), "<f8") for c in ("known", "base", "rooted"))
        for added in told.column("scores").to_pylist():
            total = total + np.frombuffer(added, "<f8")
        columns = [chunk.column("doc_ids").combine_chunks().flatten(), *map(pa.array, (sizes, known.astype(np.int64), base, total))]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    both = whole.select("first", "doc_ids", "sizes", "known", "base", "rooted").groupBy("first").cogroup(scores.groupBy("first"))
    return both.applyInArrow(tell, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def dealt(whole: DataFrame, slice_no: int, n_parts: int, counts: Counts) -> DataFrame:
    """part, first, n_texts, positions: the positions of one slice in each chunk, those of one part together in one value."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, c, slices in _chunks(batch, counts):
                at = np.flatnonzero((slices & (HOT - 1)) == slice_no)
                if not len(at):
                    continue
                p = c.take(at)
                part = p.part(at, n_parts, counts)
                order = np.argsort(part, kind="stable")
                table, part = p.table()[:, order], part[order]
                begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                values = [_packed_table(table[:, a:b]) for a, b in zip(begin, [*begin[1:], len(at)])]
                own = [pa.array(part[begin]), *[pa.array(np.full(len(begin), v)) for v in (first, len(c.sizes))], pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, ["part", "first", "n_texts", "positions"])

    return whole.select(*READ).mapInArrow(deal, "part long, first long, n_texts long, positions binary")


def _packed_table(table: np.ndarray) -> bytes:
    """Fields as packed arrays one after another, after the number of positions."""
    return table.shape[1].to_bytes(8, "little") + b"".join(map(packed, table))


def _size(value: bytes) -> int:
    return int.from_bytes(value[:8], "little")


def _unpacked(values: list[bytes], n_fields: int) -> np.ndarray:
    """Packed tables next to each other: fields as rows, one column per position."""
    tables = [np.empty((n_fields, 0), np.int64)]
    for v in values:
        n, at, fields = _size(v), 8, []
        for _ in range(n_fields):
            end = at + 1 + n * v[at]
            fields.append(unpacked(v[at:end]))
            at = end
        tables.append(np.stack(fields))
    return np.concatenate(tables, 1)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct value from 0 on, and where each comes first."""
    bits = len(key).bit_length()
    if int(key.max()) < 1 << (63 - bits):
        # One sort of values that carry their places.
        both = np.sort(key << bits | np.arange(len(key)))
        order, ordered = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return inverse, order[new]


def _groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct pair, and where each pair comes first."""
    return _ranked(a * (int(b.max()) + 1) + b)


class Part:
    """The positions of one part, and for each length the distinct contexts and the distinct tokens after them.

    With ``own``, the parts of the positions, contexts of different parts are told apart.
    """

    def __init__(self, table: np.ndarray, own: np.ndarray | None = None):
        self.table = table
        self.t, *self.before, self.uses, flags = table
        self.row, self.learn = flags >> 4, (flags >> 3 & 1).astype(bool)
        self.own = np.zeros(len(flags), np.int64) if own is None else own
        hot = np.ones(len(flags), bool)
        self.there, self.split, self.context, self.pair, self.first = [], [], [], [], []
        token = _ranked(self.t)[0]
        context = None if own is None else _ranked(own)[0]
        for k in range(DEPTH):
            hot = hot & (flags >> k & 1).astype(bool)
            before = _ranked(self.before[k])[0]
            context = before if context is None else _groups(context, before)[0]
            pair, first = _groups(context, token)
            self.there.append(self.before[k] != NONE), self.split.append(hot)
            self.context.append(context), self.pair.append(pair), self.first.append(first)

    def uses_of(self, k: int) -> np.ndarray:
        """Training uses of each pair of length k + 1 in this part."""
        return np.bincount(self.pair[k], weights=self.learn, minlength=len(self.first[k])).astype(np.int64)

    def shared(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pairs whose context is dealt to several parts, fields of SHARED as rows: the part, level, w, c2, c3, t, uses of t, uses of the pair here; and their places per level."""
        out, at = [], []
        for k in range(DEPTH):
            first = self.first[k]
            mine = np.flatnonzero(self.split[k][first] & self.there[k][first])
            f = first[mine]
            before = [self.before[i][f] if i <= k else np.zeros(len(f), np.int64) for i in range(DEPTH)]
            out.append(np.stack([self.own[f], np.full(len(f), k + 1), *before, self.t[f], self.uses[f], self.uses_of(k)[mine]]))
            at.append(mine)
        return np.concatenate(out, 1), at

    def logs(self, counts: Counts, resolved: np.ndarray | None) -> np.ndarray:
        """log10 probability of each position: the longest kept context before it, smoothed towards shorter ones and the token's share.

        ``resolved``: RESOLVED of each pair of ``shared`` in any order.
        """
        p = counts.share(self.uses)
        n_above, total_above = self.uses.astype(float), np.full(len(p), float(max(1, counts.tokens)))
        asked, places = self.shared()
        told, done = np.empty((3, asked.shape[1])), 0
        if asked.shape[1]:
            mine, theirs = (np.argsort(_hashes(v)) for v in (asked[1:6], resolved[:5]))
            if not np.array_equal(asked[1:6, mine], resolved[:5, theirs]):
                # Two pairs may share a hash.
                mine, theirs = np.lexsort(asked[1:6]), np.lexsort(resolved[:5])
            if not np.array_equal(asked[1:6, mine], resolved[:5, theirs]):
                raise RuntimeError("the pairs of hot contexts are not those of the part")
            told[:, mine] = resolved[5:, theirs]
        for k in range(DEPTH):
            pair, context, first = self.pair[k], self.context[k], self.first[k]
            n = self.uses_of(k).astype(float)
            of = context[first]
            total = np.bincount(of, weights=n)
            seen = np.flatnonzero(n > 0)
            share = n_above[first] / total_above[first]
            gain = np.bincount(of[seen], weights=n[seen] * np.log(n[seen] / total[of[seen]] / share[seen]), minlength=len(total))
            n_next = np.bincount(of[seen], minlength=len(total))
            kept = ((total >= LEAST_USES) & (gain >= LEAST_GAIN + GAIN_EACH * n_next))[of]
            total = total[of]
            mine = places[k]
            if len(mine):
                n[mine], total[mine], kept[mine] = told[:, done : done + len(mine)]
                done += len(mine)
            use = self.there[k] & kept.astype(bool)[pair]
            p = np.where(use, (n[pair] + SMOOTHING * p) / (total[pair] + SMOOTHING), p)
            there = self.there[k]
            n_above, total_above = np.where(there, n[pair], n_above), np.where(there, np.maximum(total[pair], 1.0), total_above)
        return np.log10(p)


#: Fields of the pairs of hot contexts in one part, and what is told of them: uses of the pair over all parts, total and kept of its context.
SHARED = ["part", "level", "w", "c2", "c3", "t", "uses", "n"]
RESOLVED = [*SHARED[1:6], "n", "total", "kept"]
#: What names a context of a level.
CONTEXT = SHARED[1:5]


def _numbers(columns: np.ndarray) -> np.ndarray:
    """A number for each distinct column of several rows."""
    of = np.zeros(columns.shape[1], np.int64)
    for row in columns if len(of) else ():
        of = _groups(of, row)[0]
    return of


def _dealt_tables(key: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct keys, and for each the columns of the table that have it, packed."""
    order = np.argsort(key, kind="stable")
    key, table = key[order], table[:, order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[begin], [_packed_table(table[:, a:b]) for a, b in zip(begin, [*begin[1:], len(key)])]


def _above(pairs: np.ndarray) -> np.ndarray:
    """For each pair (level, w, c2, c3, t) the place of the same token after the suffix of its context; -1 on the first level."""
    up = pairs.copy()
    up[0] -= 1
    for k in range(1, DEPTH):
        up[1 + k] = np.where(up[0] > k, up[1 + k], 0)
    both = _numbers(np.concatenate([pairs, up], 1))
    mine, theirs = np.split(both, 2)
    place = np.full(int(both.max(initial=-1)) + 1, -1)
    place[mine] = np.arange(len(mine))
    return place[theirs]


def hot_contexts(whole: DataFrame, n_hot: int, n_parts: int, counts: Counts) -> DataFrame:
    """slice, part, told: each pair of a context whose tokens are all hot, for each part that has it, as packed RESOLVED. Partitioned by slice.

    Each chunk adds up its own pairs first. Pairs are then dealt by the last token of the context and the token after it, so that a hot context is no hot key:
    a bucket adds up its pairs and meets those of the suffixes, and contexts are put together from what each bucket has of them.
    """
    n_buckets = -(-n_hot // HOT_POSITIONS) or 1

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c, slices in _chunks(batch, counts):
                at = np.flatnonzero(slices >= HOT)
                if len(at):
                    p = c.take(at)
                    own = p.part(at, n_parts, counts) * counts.slices + (slices[at] & (HOT - 1))
                    pairs = Part(p.table(), own).shared()[0]
                    bucket = (mixed(pairs[2], pairs[5]) % np.uint64(n_buckets)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, _dealt_tables(bucket, pairs))), ["bucket", "pairs"])

    added = ["bucket", "asked", *CONTEXT, "total", "n_next", "told"]

    def add(dealt: pa.Table) -> pa.Table:
        bucket = dealt.column("bucket")[0].as_py()
        rows = _unpacked(dealt.column("pairs").to_pylist(), len(SHARED))
        of = _numbers(rows[1:6])
        n, first = np.bincount(of, weights=rows[7]), np.empty(int(of.max()) + 1, np.int64)
        first[of] = np.arange(len(of))
        pairs, uses = rows[1:6, first], rows[6, first]
        _, asked = _groups(of, rows[0])
        table = np.concatenate([rows[:6, asked], n[of[asked]].astype(np.int64)[None]])
        seen = np.flatnonzero(n > 0)
        n_above = np.where(pairs[0] == 1, uses, n[_above(pairs)])[seen]
        context = _numbers(pairs[:4, seen])
        at = np.empty(int(context.max(initial=-1)) + 1, np.int64)
        at[context] = seen
        total, told = np.bincount(context, weights=n[seen]), np.bincount(context, weights=n[seen] * np.log(n[seen] / n_above))
        own = [pa.array([None, *pairs[k, at]], pa.int64()) for k in range(4)]
        sums = [pa.array([None, *v], t) for v, t in zip((total.astype(np.int64), np.bincount(context), told), (pa.int64(), pa.int64(), pa.float64()))]
        return pa.table([pa.array([bucket] * (len(at) + 1)), pa.array([_packed_table(table), *[None] * len(at)], pa.binary()), *own, *sums], names=added)

    def answer(dealt: pa.Table, tested: pa.Table) -> pa.Table:
        asked = _unpacked([v for v in dealt.column("asked").to_pylist() if v is not None], len(SHARED) - 1)
        known = np.stack([tested.column(c).to_numpy() for c in CONTEXT])
        context, of = np.split(_numbers(np.concatenate([known, asked[1:5]], 1)), [known.shape[1]])
        told = np.zeros((2, int(max(context.max(initial=0), of.max(initial=0))) + 1), np.int64)
        told[:, context] = [tested.column(c).to_numpy() for c in ("total", "kept")]
        part, tables = _dealt_tables(asked[0], np.concatenate([asked[1:], told[:, of]]))
        return pa.table([pa.array(part % counts.slices), pa.array(part // counts.slices), pa.array(tables, pa.binary())], names=["slice", "part", "told"])

    paired = whole.select(*READ).mapInArrow(pair_up, "bucket long, pairs binary").groupBy("bucket")
    kinds = f"bucket long, asked binary, {', '.join(f'{c} long' for c in CONTEXT)}, total long, n_next long, told double"
    pairs = stage(paired.applyInArrow(add, kinds), "pairs", codec=CODEC)
    partial = pairs.filter("asked IS NULL").select("bucket", *CONTEXT, "total", "n_next", "told")
    contexts = stage(partial.groupBy(*CONTEXT).agg(*[F.sum(c).alias(c) for c in ("total", "n_next", "told")]), "contexts")
    # The suffix of a context has one token less, the one farthest back.
    above = contexts.select((F.col("level") + 1).alias("level"), "w", F.col("c2").alias("u2"), F.col("c3").alias("u3"), F.col("total").alias("total_above"))
    level, total = F.col("level"), F.col("total")
    up = contexts.withColumns({"u2": F.when(level > 2, F.col("c2")).otherwise(0), "u3": F.lit(0).cast("long")})
    gain = F.col("told") + total * F.log(F.coalesce("total_above", F.lit(max(1, counts.tokens))) / total)
    kept = (total >= LEAST_USES) & (gain >= LEAST_GAIN + GAIN_EACH * F.col("n_next"))
    tested = stage(up.join(above, ["level", "w", "u2", "u3"], "left").select(*CONTEXT, "total", kept.cast("long").alias("kept")), "tested")
    known = partial.select(F.col("bucket").alias("of"), *CONTEXT).join(tested, CONTEXT)
    both = pairs.filter("asked IS NOT NULL").select("bucket", "asked").groupBy("bucket").cogroup(known.groupBy("of"))
    resolved = stage(both.applyInArrow(answer, "slice long, part long, told binary"), "resolved", ["slice"], CODEC)
    drop_staged(pairs, contexts, tested)
    return resolved


def slice_scores(positions: DataFrame, resolved: DataFrame | None, counts: Counts) -> DataFrame:
    """first, scores: what the positions of a slice add to the texts of each chunk; ``resolved``: the rows of ``hot_contexts`` for this slice."""

    def tell(table: pa.Table, told: np.ndarray | None) -> pa.Table:
        values = table.column("positions").to_pylist()
        part = Part(_unpacked(values, len(FIELDS)))
        logs, ends = part.logs(counts, told), np.cumsum([_size(v) for v in values])[:-1]
        rows, scores = [], []
        for row, log in zip(np.split(part.row, ends), np.split(logs, ends)):
            mine, inverse = np.unique(row, return_inverse=True)
            rows.append(packed(mine)), scores.append(np.bincount(inverse, weights=log).astype("<f8").tobytes())
        return pa.table([table.column("first"), table.column("n_texts"), pa.array(rows, pa.binary()), pa.array(scores, pa.binary())], names=["first", "n_texts", "rows", "scores"])

    def add(told: pa.Table) -> pa.Table:
        rows = np.concatenate([unpacked(v) for v in told.column("rows").to_pylist()])
        logs = np.frombuffer(b"".join(told.column("scores").to_pylist()), "<f8")
        total = np.bincount(rows, weights=logs, minlength=told.column("n_texts")[0].as_py())
        return pa.table([told.column("first").slice(0, 1), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["first", "scores"])

    parts, kinds = positions.groupBy("part"), "first long, n_texts long, rows binary, scores binary"
    if resolved is None:
        told = parts.applyInArrow(lambda table: tell(table, None), kinds)
    else:
        both = parts.cogroup(resolved.select("part", "told").groupBy("part"))
        told = both.applyInArrow(lambda table, told: tell(table, _unpacked(told.column("told").to_pylist(), len(RESOLVED))), kinds)
    return told.groupBy("first").applyInArrow(add, "first long, scores binary")


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score - one row per row of ``docs``.

    ``learn`` marks the rows to learn from. A text is its words, A-Z lower-cased,
    and one end. base_score is the add-half unigram log10 probability over the training
    tokens. score is the tree's: each token in the longest kept context before it, smoothed towards
    shorter ones and at last towards its discounted share of all tokens. A context is looked at from ``LEAST_USES`` uses on, and kept if
    what follows it diverges from what follows its suffix.
    As in the base, all tokens never seen count as one. Null and empty texts are one end. Without
    training texts every count is 0. Repeated rows are scored alike; very long texts are read whole; an empty table gives no rows;
    other columns are not read.

    All contexts that end in one token lie in one part, so a part counts, tests and smooths its contexts of every length and scores the positions
    after them by itself. Contexts whose tokens are all hot are dealt to several parts, which put their counts together first.
    Slices of the parts are dealt and scored one after another.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Cut by chunk when they are written, so that the chunks need not move again to meet what is told of their tokens.
    cuts = partitions_of(spark)
    chunks = stage_buckets(read_chunks(docs, learn), "chunks", ["first"], cuts, CODEC)
    zero = lambda c: F.coalesce(c, F.lit(0))
    texts, positions, held = chunks.agg(zero(F.sum(F.size("doc_ids"))), zero(F.sum("n_tokens")), zero(F.sum("n_words"))).first()
    told = stage_buckets(told_words(chunks, -(-held // BUCKET_WORDS) or 1), "told", ["first"], cuts, CODEC)
    totals = [zero(F.sum(c)) for c in ("tokens", "kinds", "once", "twice")]
    tokens, kinds, once, twice = told.agg(*totals).first()
    counts = Counts(tokens, kinds, once / (once + 2 * twice) if once and twice else 0.75, texts, HOT_USES, SLICES)
    whole = stage(numbered(chunks, told, counts), "numbered", codec=CODEC)
    drop_staged(chunks, told)
    partial = [spark.createDataFrame([], "first long, scores binary")]
    n_parts = -(-positions // (SLICES * PART_POSITIONS)) or 1
    n_hot = whole.agg(zero(F.sum("n_hot"))).first()[0]
    over_all = hot_contexts(whole, n_hot, n_parts, counts) if n_hot else None
    for slice_no in range(SLICES if positions else 0):
        known = over_all.filter(F.col("slice") == slice_no) if n_hot else None
        partial.append(stage(slice_scores(dealt(whole, slice_no, n_parts, counts), known, counts), "scores"))
    added = partial[0]
    for one in partial[1:]:
        added = added.unionByName(one)
    train_tokens = F.lit(counts.tokens).cast("long").alias("train_tokens")
    return text_scores(whole, added).select("doc_id", "n_tokens", "n_known", train_tokens, "base_score", "score")
