"""Near-duplicate documents: SetSketch registers in bands, likelihood estimates, verified links, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rowloom.llm.common import remember_only, small_batches, text_bytes
from rowloom.llm.components import components
from rowloom.session import drop_staged, stage

SHINGLE_WORDS = 5
#: Registers are grouped in bands of so many; as many bands that of pairs at the threshold only this share has no band in common.
BAND_ROWS, MISSED = 5, 1e-6
#: Registers of a sketch unless a threshold asks for others: those of 0.85.
REGISTERS = 120
#: SetSketch parameters: spacing of the register values, rate of the exponentials, largest value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Shingles sketched at once; registers of parts are merged by maximum.
STEP_SHINGLES = 4096
#: A pair is verified unless its best estimate is so much likelier (nats) than the threshold.
DOUBT = 9.0
#: Buckets up to this size list their pairs directly; members of larger ones meet in blocks of about this many.
SMALL, BLOCK = 16, 256
#: Word hashes that a worker remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Threshold:
    """Sets are linked if their similarity is at least over / under."""

    over: int = 85
    under: int = 100

    @property
    def share(self) -> float:
        return self.over / self.under

    @property
    def bands(self) -> int:
        """24 at 0.85, 35 at 0.80."""
        alike = self.share**BAND_ROWS
        return 1 if alike >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-alike))

    @property
    def registers(self) -> int:
        return self.bands * BAND_ROWS


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_HASHES = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    remember_only("hashes", _HASHES.clear)
    words = text.lower().split()
    h = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    if not len(h):
        return h
    width = min(SHINGLE_WORDS, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(out))


@lru_cache
def _draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    flips, factors = (np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64)[:, None] for seed in (20_23, 20_24))
    return flips, factors * np.uint64(2) + np.uint64(1)


def registers(keys: np.ndarray, n: int = REGISTERS) -> np.ndarray:
    """SetSketch of a set: per register the exponential minimum of its elements, on a truncated geometric scale."""
    flips, factors = _draws(n)
    out = np.zeros(n, np.uint16)
    for at in range(0, len(keys), STEP_SHINGLES):
        least = ((keys[None, at : at + STEP_SHINGLES] ^ flips) * factors).min(1)
        low = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
        value = np.clip(np.floor(1 - np.log(low) / np.log(BASE)), 0, TOP).astype(np.uint16)
        out = merged(out, value)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Keys of the bands of one sketch, or row by row of several."""
    rows = sketch.reshape(*sketch.shape[:-1], -1, BAND_ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, rows.shape[-2] + 1, dtype=np.uint64), rows.shape[:-1])
    for k in range(BAND_ROWS):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[..., k])
    return h.view(np.int64)


SKETCHED = "doc_id long, n_shingles long, set_hash binary, sketch binary"


def sketches(docs: DataFrame, limit: Threshold) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set and registers, of every row; without words null from the digest on."""
    small_batches(docs.sparkSession)
    n_registers = limit.registers

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, regs = [], [], []
            for text in batch.column(1).to_pylist():
                keys = shingles(text)
                sizes.append(len(keys))
                if len(keys):
                    digests.append(xxhash.xxh3_128_digest(keys.tobytes()))
                    regs.append(registers(keys, n_registers).tobytes())
                else:
                    digests.append(None)
                    regs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "n_shingles", "set_hash", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(draw, SKETCHED)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, shingles of the documents in ``wanted`` (rep, set_hash), from their texts."""
    small_batches(docs.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, sets = [], []
            for rep, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                keys = shingles(text)
                if xxhash.xxh3_128_digest(keys.tobytes()) == digest:
                    reps.append(rep)
                    sets.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_bytes().alias("text"))
    return wanted.join(texts, "rep").select("rep", "set_hash", "text").mapInArrow(draw, "rep long, shingles array<long>")


def plausible(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, limit: Threshold, n_registers: int = REGISTERS) -> np.ndarray:
    """Whether the registers leave room for the threshold.

    more, less: registers in which a is above or below b. Given both set sizes, the similarity is
    estimated by maximum likelihood over all three counts (SetSketch, joint estimation).
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 65)[None, :] * most[:, None]
    grid = np.c_[grid, np.minimum(limit.share, most)]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up = np.clip(p(u[:, None] - v[:, None] * grid), 1e-9, 1)
    down = np.clip(p(v[:, None] - u[:, None] * grid), 1e-9, 1)
    same = np.clip(1 - up - down, 1e-9, 1)
    equal = n_registers - more - less
    logs = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)
    best = grid[np.arange(len(grid)), logs.argmax(1)]
    return (most >= limit.share - 1e-12) & ((best >= limit.share) | (logs.max(1) - logs[:, -1] < DOUBT))


def _unpacked(sketch: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), np.uint16).reshape(len(sketch), -1)


def likely(pairs: DataFrame, reps: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for a link."""
    side = lambda name: reps.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    # Sizes alone settle many pairs.
    met = met.filter(F.least("n_a", "n_b") * limit.under >= F.greatest("n_a", "n_b") * limit.over)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_unpacked(batch.column(c).to_pylist()).astype(np.int32) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = plausible((x > y).sum(1), (x < y).sum(1), n_a, n_b, limit, x.shape[1])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return met.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(judge, "a long, b long")


def _linked(common: Column, union: Column, limit: Threshold) -> Column:
    return common * limit.under >= union * limit.over


def verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs whose full sets are similar enough. ``b`` may be a hub: it is joined last, where rows are wide and split."""
    own = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("own")), "a")
    both = own.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("other")), "b")
    common = F.size(F.array_intersect("own", "other"))
    counted = both.select("a", "b", common.alias("common"), (F.size("own") + F.size("other")).alias("sum"))
    return counted.filter(_linked(F.col("common"), F.col("sum") - F.col("common"), limit)).select("a", "b").distinct()


def buckets(reps: DataFrame) -> DataFrame:
    """key, rep, size: every band value that more than one set has; band values follow from the registers."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_unpacked(batch.column(1).to_pylist()))
                rep = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], ["key", "rep"])

    keys = reps.select("rep", "sketch").mapInArrow(spread, "key long, rep long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return keys.join(sizes, "key")


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member with the most central member of its bucket: the one that meets the most others over all bands."""
    central = members.groupBy("rep").agg(F.sum("size").alias("met"))
    ranked = members.join(central, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("minus"))).alias("hub"))
    met = members.join(hubs, "key").select(F.col("rep").alias("a"), (-F.col("hub.minus")).alias("b"))
    return met.filter("a <> b").distinct()


def private_shingles(sets: DataFrame) -> DataFrame:
    """rep, private: shingles that no other of these sets has."""
    used = sets.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    return used.filter("n = 1").groupBy("rep").agg(F.count("*").alias("private"))


def block_pairs(crowd: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs of members of one bucket in different components whose bound and sketches leave room for a link.

    ``crowd``: key, size, rep, component, n_shingles, private, sketch. Members are dealt to chunks; each
    pair of chunks is one block, so no task holds a bucket. A set with p of n
    shingles to itself shares n - p at most: that bound is exact and settles nearly all pairs of a large group.
    Of the buckets that two members share, only that of the first band yields the pair.
    """
    n_chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = crowd.withColumn("chunks", n_chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep").sort_values("rep").reset_index(drop=True)
        rep, comp, chunk = (rows[c].to_numpy() for c in ("rep", "component", "chunk"))
        within = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
        n, private = rows["n_shingles"].to_numpy().astype(float), rows["private"].to_numpy().astype(float)
        sketch = _unpacked(rows["sketch"].tolist())
        bands = band_keys(sketch)
        earlier = bands[:, : int((bands[0] == rows["key"].iloc[0]).argmax())]
        found_a, found_b = [], []
        for k in range(len(rows) - 1):
            common = np.minimum(n[k] - private[k], n[k + 1 :] - private[k + 1 :])
            # A block of two chunks pairs one with the other, a block of one chunk all within.
            fits = ((chunk[k + 1 :] != chunk[k]) | within) & (comp[k + 1 :] != comp[k]) & (common * limit.under >= (n[k] + n[k + 1 :] - common) * limit.over)
            at = np.flatnonzero(fits) + k + 1
            at = at[~(earlier[at] == earlier[k]).any(1)]
            if len(at):
                ok = plausible((sketch[k] > sketch[at]).sum(1), (sketch[k] < sketch[at]).sum(1), np.full(len(at), n[k]), n[at], limit, sketch.shape[1])
                found_a.append(np.full(int(ok.sum()), rep[k]))
                found_b.append(rep[at[ok]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": join(found_a), "b": join(found_b)})

    wide = dealt.select("key", "i", "j", "chunk", "rep", "component", "n_shingles", "private", "sketch")
    return wide.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, limit: Threshold) -> DataFrame:
    """Verified links (a, b) that connect every two sets connected by links at all.

    First every member of a bucket is checked against its hub. Then pairs
    of one bucket that are still in different components are checked: all of a small bucket, and those
    of a large one that the exact bound and the estimate leave.
    """
    members = stage(buckets(reps), "buckets")
    near = stage(likely(star_pairs(members), reps, limit), "near")
    hashes = reps.select("rep", "set_hash")
    # Full sets are read of those that a likely pair or a crowd needs, no others.
    wanted = stage(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    sets = stage(shingle_sets(docs, wanted.join(hashes, "rep")), "sets")
    first = stage(verified(near, sets, limit), "links")
    found = components(first, "a", "b").withColumnRenamed("node", "rep")
    placed = members.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    open_members = stage(placed.join(mixed, "key"), "open")
    few = open_members.filter(F.col("size") <= SMALL).select("key", "rep", "component")
    other = few.select("key", F.col("rep").alias("b"), F.col("component").alias("component_b"))
    listed = few.join(other, "key").filter("rep < b AND component <> component_b").select(F.col("rep").alias("a"), "b").distinct()
    crowd = open_members.filter(F.col("size") > SMALL)
    crowd_reps = crowd.select("rep").distinct()
    few_pairs = stage(likely(listed, reps, limit).join(near, ["a", "b"], "left_anti"), "near")
    more = few_pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(crowd_reps).distinct()
    more = stage(shingle_sets(docs, more.join(wanted, "rep", "left_anti").join(hashes, "rep")), "sets")
    sets = sets.unionByName(more)
    private = private_shingles(sets.join(crowd_reps, "rep", "left_semi"))
    known = reps.select("rep", "n_shingles", "sketch").join(crowd_reps, "rep").join(private, "rep", "left").withColumn("private", F.coalesce("private", F.lit(0).cast("long")))
    left = stage(known.filter((F.col("n_shingles") - F.col("private")) * limit.under >= F.col("n_shingles") * limit.over), "crowd")
    blocks = block_pairs(crowd.join(left, "rep"), limit)
    pairs = few_pairs.unionByName(blocks.join(near, ["a", "b"], "left_anti")).distinct()
    second = stage(verified(pairs, sets, limit), "links")
    drop_staged(members, sets, left, open_members)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, limit: Threshold = Threshold()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept - one row per row of ``docs``.

    A text's set holds its distinct shingles of five words (A-Z lower-cased). Equal sets are one class
    from the start, so copies cost one row each. Classes that share a band of SetSketch registers are
    candidates; links are confirmed on the full sets; component_id is the smallest doc_id of the
    component. Null texts and texts without words have no shingle and are linked with nothing. Repeated rows are copies. Rows
    without an id are in the component of their copies, and have none where all copies lack one.
    """
    rows = stage(sketches(docs, limit), "sketches")
    reps = stage(
        rows.filter("n_shingles > 0")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch"))
        .filter("rep IS NOT NULL"),
        "classes",
    )
    found = components(links(docs, reps, limit), "a", "b").withColumnRenamed("node", "rep")
    classes = reps.select("set_hash", "rep").join(found, "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("of_class"))
    return rows.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left").select(
        "doc_id", "n_shingles", F.coalesce("of_class", "doc_id").alias("component_id"), F.coalesce("of_class", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept")
    )
