"""Conversation prefixes in a z-fast trie: compacted nodes by their handles, exit nodes by fat binary search, batches of insertions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowloom.operators.index import dense_index
from rowloom.session import stage

#: A conversation takes over the first turns of the conversation of its family with the least id; fewer than so many.
FAMILY, TAKEN = 5, 9
#: Turns of a conversation that one window runs over.
BLOCK_TURNS = 4096
#: Upper bounds of the batches, in eighths of all sequences.
BATCHES = (2, 8)
#: Bytes of an id list that are handed on at once.
LIST_BYTES = 1 << 16

KEY = ["depth", "p1", "p2"]
#: A compacted node: its extent (depth, p1, p2), its parent's, a sequence through it, its handle and the first step of its edge.
NODE = [*KEY, "up_depth", "u1", "u2", "rep", "handle", "h1", "h2", "f1", "f2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, k1, k2, bytes: every turn with its place from 0, its two hashes and the length of its text.

    Turns are ranked by one sort of all rows, so a long conversation is spread over many tasks. Equal turn numbers follow
    their hashes. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(7), text, role).alias("k2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = stage(dense_index(slim, ["conv_id", "turn", "k1", "k2"], "at"), "turns")
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "k1", "k2", "bytes")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: conv_id, length; and their turns: conv_id, depth from 1, k1, k2, bytes.

    A conversation is the first h turns of its family's base, h hashed from its id, then its own turns after its first h.
    """
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    base_id = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN
    families = sizes.select("conv_id", "n", base_id.alias("base"), h.alias("h"))
    met = families.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    known = stage(met.select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "families")
    heads = own.filter(F.col("pos") < TAKEN).withColumnRenamed("conv_id", "base").join(known.filter("taken > 0").select("conv_id", "base", "taken"), "base")
    head = heads.filter("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", "bytes")
    tails = own.join(known.filter("n > h").select("conv_id", "h", "taken"), "conv_id").filter("pos >= h")
    tail = tails.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "k1", "k2", "bytes")
    length = F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return known.select("conv_id", length.alias("length")), head.unionByName(tail)


def prefix_keys(path: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2, bytes, sum: hashes of the first ``depth`` turns and the bytes of their texts.

    A prefix's hash is the exclusive or of hashes of its turns with their depths, so
    blocks of a long conversation are hashed apart and put together.
    """
    rows = path.select(
        "conv_id", "depth", "bytes", F.call_function("div", "depth", F.lit(BLOCK_TURNS)).alias("block"),
        F.xxhash64("k1", "k2", "depth").alias("m1"), F.xxhash64("k2", "depth", "k1").alias("m2"),
    )
    here = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.select("conv_id", "depth", "block", "bytes", F.bit_xor("m1").over(here).alias("p1"), F.bit_xor("m2").over(here).alias("p2"), F.sum("bytes").over(here).alias("sum"))
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"), F.sum("bytes").alias("before"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    prior = blocks.select("conv_id", "block", F.bit_xor("b1").over(earlier).alias("b1"), F.bit_xor("b2").over(earlier).alias("b2"), F.sum("before").over(earlier).alias("before"))
    met = run.join(prior.filter("block > 0"), ["conv_id", "block"], "left")
    put = lambda p, b: F.col(p).bitwiseXOR(F.coalesce(b, F.lit(0)))
    return met.select(
        "conv_id", "depth", put("p1", "b1").alias("p1"), put("p2", "b2").alias("p2"), "bytes", (F.col("sum") + F.coalesce("before", F.lit(0))).alias("sum")
    )


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    top = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, top), top)


def step_of(paths: DataFrame, prefix: str, names: tuple[str, str], depth: str) -> DataFrame:
    """The key of each sequence at each depth, under other names, for a join on (rep, depth)."""
    return paths.select(F.col("rep").alias(f"{prefix}_rep"), F.col("depth").alias(depth), F.col("p1").alias(names[0]), F.col("p2").alias(names[1]))


def locate(batch: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """rep, length, low: the depth of the deepest node whose extent begins each sequence, by fat binary search over the handles.

    A probe looks up the prefix at the two-fattest depth of the open interval. A node with that handle whose
    extent begins the sequence raises the lower bound to it; any other outcome lowers the upper bound below the probe.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    state = batch.select("rep", "length", F.lit(0).cast("long").alias("low"), F.least("length", F.lit(deepest)).alias("high"))
    handles = nodes.select(F.col("handle").alias("probe"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("depth").alias("extent"), "p1", "p2")
    done = []
    while True:
        state = stage(state, "search")
        done.append(state.filter("low >= high").select("rep", "length", "low"))
        searching = state.filter("low < high")
        if searching.isEmpty():
            break
        asked = searching.withColumn("probe", two_fattest(F.col("low"), F.col("high")))
        key = step_of(paths, "x", ("q1", "q2"), "probe")
        asked = asked.join(key, (asked["rep"] == key["x_rep"]) & (asked["probe"] == key["probe"])).select(asked["*"], "q1", "q2")
        found = asked.join(handles, ["probe", "q1", "q2"], "left")
        extent = step_of(paths, "y", ("e1", "e2"), "at")
        found = found.join(extent, (found["rep"] == extent["y_rep"]) & (found["extent"] == extent["at"]), "left")
        begins = F.coalesce((F.col("e1") == F.col("p1")) & (F.col("e2") == F.col("p2")) & (F.col("extent") <= F.col("high")), F.lit(False))
        state = found.select(
            "rep", "length", F.when(begins, F.col("extent")).otherwise(F.col("low")).alias("low"), F.when(begins, F.col("high")).otherwise(F.col("probe") - 1).alias("high")
        )
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exits(batch: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """rep, length, low, match, and the exit edge's lower node where the sequence leaves within or at the end of an edge.

    ``match`` turns of the sequence lie in the trie: down to the node at ``low``, then along the edge that its next turn begins.
    """
    at = stage(locate(batch, paths, nodes), "located")
    step = step_of(paths, "x", ("f1", "f2"), "first")
    asked = at.withColumn("first", F.col("low") + 1)
    begun = asked.join(step, (asked["rep"] == step["x_rep"]) & (asked["first"] == step["first"])).select("rep", "length", "low", "f1", "f2")
    edges = nodes.filter("depth > 0").select(
        F.col("up_depth").alias("low"), "f1", "f2", F.col("rep").alias("edge_rep"), F.col("depth").alias("edge_depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2")
    )
    met = begun.join(edges, ["low", "f1", "f2"])
    own = paths.select("rep", F.col("depth").alias("d"), "p1", "p2")
    other = paths.select(F.col("rep").alias("edge_rep"), F.col("depth").alias("d"), F.col("p1").alias("o1"), F.col("p2").alias("o2"))
    along = met.join(own, "rep").filter("d > low AND d <= edge_depth").join(other, ["edge_rep", "d"]).filter("p1 = o1 AND p2 = o2")
    same = along.groupBy("rep").agg(F.count("*").alias("along"), F.any_value("edge_depth").alias("edge_depth"), F.any_value("g1").alias("g1"), F.any_value("g2").alias("g2"))
    return at.join(same, "rep", "left").withColumn("match", F.col("low") + F.coalesce("along", F.lit(0)))


def with_handles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (extent, parent's extent, rep) with the handle, the two-fattest depth of their edge, and the first step of it."""
    asked = nodes.withColumn("handle", two_fattest(F.col("up_depth"), F.col("depth"))).withColumn("first", F.col("up_depth") + 1)
    handle, first = step_of(paths, "x", ("h1", "h2"), "handle"), step_of(paths, "y", ("f1", "f2"), "first")
    met = asked.join(handle, (asked["rep"] == handle["x_rep"]) & (asked["handle"] == handle["handle"])).select(asked["*"], "h1", "h2")
    return met.join(first, (met["rep"] == first["y_rep"]) & (met["first"] == first["first"])).select(met["*"], "f1", "f2").select(NODE)


def insert(nodes: DataFrame, batch: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie with the sequences of a batch: edges are split where one leaves them, what is new below gets nodes of its own.

    Every sequence ends at a node; a prefix with two ways on is a node.
    """
    left = stage(exits(batch, paths, nodes), "exits")
    # Edges that a sequence leaves before their end.
    cut = left.filter("along IS NOT NULL AND match < edge_depth").select("rep", F.col("match").alias("depth"), "edge_depth", "g1", "g2")
    cut = cut.join(paths.select("rep", "depth", "p1", "p2"), ["rep", "depth"]).groupBy(*KEY, "edge_depth", "g1", "g2").agg(F.min("rep").alias("rep"))
    edge = nodes.select(F.col("depth").alias("edge_depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2"), "up_depth", "u1", "u2")
    cut = stage(cut.join(edge, ["edge_depth", "g1", "g2"]), "cuts")
    down = W.partitionBy("edge_depth", "g1", "g2").orderBy("depth")
    above = lambda c, up: F.coalesce(F.lag(c).over(down), F.col(up)).alias(up)
    splits = cut.select(*KEY, above("depth", "up_depth"), above("p1", "u1"), above("p2", "u2"), "rep")
    lowest = cut.groupBy("edge_depth", "g1", "g2").agg(F.max(F.struct("depth", "p1", "p2")).alias("to"))
    lowest = lowest.select(F.col("edge_depth").alias("depth"), F.col("g1").alias("p1"), F.col("g2").alias("p2"), "to")
    # What lies below the trie, and where it branches or ends.
    fresh = paths.join(left.filter("match < length").select("rep", "length", "match"), "rep").filter("depth >= match")
    ahead = W.partitionBy("rep").orderBy("depth")
    fresh = fresh.withColumn("n1", F.lead("p1").over(ahead)).withColumn("n2", F.lead("p2").over(ahead)).filter("depth > match")
    following = F.struct("n1", "n2")
    kinds = fresh.groupBy(*KEY).agg(F.bool_or(F.col("depth") == F.col("length")).alias("ends"), F.min(following).alias("least"), F.max(following).alias("most"), F.min("rep").alias("rep"))
    told = stage(kinds.filter("ends OR least <> most").select(*KEY, "rep"), "branches")
    # Of the sequences through a new node one, the least, tells its parent: the next node above, at last where it left the trie.
    marks = fresh.select("rep", *KEY, "match").join(told.withColumnRenamed("rep", "owner"), KEY)
    top = left.filter("match < length").select("rep", F.col("match").alias("depth")).join(paths.select("rep", "depth", "p1", "p2"), ["rep", "depth"], "left")
    zero = F.lit(0).cast("long")
    top = top.select("rep", "depth", F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), F.lit(None).cast("long").alias("owner"))
    chain = marks.select("rep", *KEY, "owner").unionByName(top)
    behind = W.partitionBy("rep").orderBy("depth")
    linked = chain.select("*", F.lag("depth").over(behind).alias("up_depth"), F.lag("p1").over(behind).alias("u1"), F.lag("p2").over(behind).alias("u2"))
    new = linked.filter("rep = owner").select(*KEY, "up_depth", "u1", "u2", "rep")
    moved = nodes.join(lowest, KEY, "left")
    kept = moved.filter("to IS NULL").select(NODE)
    hung = moved.filter("to IS NOT NULL").select(*KEY, F.col("to.depth").alias("up_depth"), F.col("to.p1").alias("u1"), F.col("to.p2").alias("u2"), "rep")
    changed = stage(splits.unionByName(new).unionByName(hung), "changed")
    return stage(kept.unionByName(with_handles(changed, paths)), "trie")


def root(spark) -> DataFrame:
    """The node of no turns; its parent lies at depth -1, which no other node has."""
    return spark.range(1).select(
        *[F.lit(0).cast("long").alias(c) for c in KEY], F.lit(-1).cast("long").alias("up_depth"), *[F.lit(0).cast("long").alias(c) for c in NODE[4:]]
    )


def grow(sequences: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie of all ``sequences`` (rep, length), inserted in ``BATCHES``; ``paths`` (rep, depth, p1, p2) are their prefixes.

    Their number is fixed, so the trie is written anew a few times however large it is.
    """
    nodes = stage(root(sequences.sparkSession), "trie")
    lot = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(BATCHES[-1]))
    for low, high in zip((0, *BATCHES), BATCHES):
        nodes = insert(nodes, sequences.filter((lot >= low) & (lot < high) & (F.col("length") > 0)), paths)
    return nodes


def id_lists(members: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ends_sha256: SHA-256 of the ascending, comma-joined conv_ids of each group.

    Ids are sorted over all tasks and joined to strings of at most ``LIST_BYTES`` there; a group's strings are then read in order, one
    at a time, so no task holds a group.
    """
    types = dict(members.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, n = None, 0, [], 0

        def hand_on() -> pa.RecordBatch:
            columns = [*[pa.array([v]) for v in key], pa.array([first]), pa.array([",".join(held)])]
            return pa.RecordBatch.from_arrays(columns, [*by, "first", "ids"])

        for batch in batches:
            for *group, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if group != key or n > LIST_BYTES:
                    if held:
                        yield hand_on()
                    key, first, held, n = group, conv_id, [], 0
                held.append(str(conv_id))
                n += len(held[-1]) + 1
        if held:
            yield hand_on()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            rows = []
            for *group, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if group == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    rows.append((*key, sha.hexdigest()))
                key, sha = group, hashlib.sha256(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*by, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, sha.hexdigest())], [*by, "ends_sha256"])

    spread = members.select(*by, "conv_id").repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id")
    strings = spread.mapInArrow(join_up, f"{schema}, first long, ids string")
    return strings.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digest, f"{schema}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    A node is a distinct sequence of the first turns (role, text) of rebuilt conversations (see ``rebuilt``), from the root
    without turns on. Its members are the conversations that begin so; a conversation is named by its
    smallest member. Equal conversations are inserted once. Null roles and texts are empty, turns without a number come first,
    repeated rows are turns of their own, rows without a conv_id are left out, other columns are not read; without conversations there is no node,
    not even the root.
    """
    convs, path = rebuilt(turns(conversations))
    keyed = stage(prefix_keys(path), "prefixes")
    none = F.lit(0).cast("long")
    last = keyed.select("conv_id", F.col("depth").alias("length"), "p1", "p2")
    ended = convs.join(last, ["conv_id", "length"], "left").select("conv_id", "length", F.coalesce("p1", none).alias("p1"), F.coalesce("p2", none).alias("p2"))
    ended = stage(ended, "ended")
    sequences = stage(ended.groupBy("length", "p1", "p2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")
    paths = stage(keyed.withColumnRenamed("conv_id", "rep").join(sequences.select("rep"), "rep", "left_semi"), "paths")
    nodes = grow(sequences.select("rep", "length"), paths)
    return expanded(nodes, sequences, paths, ended)


def expanded(nodes: DataFrame, sequences: DataFrame, paths: DataFrame, ended: DataFrame) -> DataFrame:
    """Every prefix along the edges of the trie, with the figures of its subtree."""
    spark, zero = nodes.sparkSession, F.lit(0).cast("long")
    inner = nodes.filter("depth > 0")
    children = inner.groupBy(F.col("up_depth").alias("depth"), F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(F.count("*").alias("n_children"))
    plain = inner.join(children, KEY, "left").select(*KEY, "up_depth", "u1", "u2", F.coalesce("n_children", zero).alias("n_children"))
    # The nodes that each sequence passes; whether its last one is a leaf.
    last = plain.select(F.col("depth").alias("length"), "p1", "p2", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    known = sequences.join(last, ["length", "p1", "p2"]).select("rep", "weight", "leaf")
    passed = stage(paths.select("rep", *KEY, "sum").join(plain.select(*KEY), KEY).join(known, "rep"), "passed")
    told = passed.groupBy(*KEY).agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"))
    told = stage(told, "told")
    # The saving of each edge is added to its lower node and all above it once, along the sequence that names the lower node.
    down = W.partitionBy("rep").orderBy("depth")
    named = passed.select("rep", *KEY, "sum").join(told.select(*KEY, "conv_id", "n_convs"), KEY)
    edge = (F.col("n_convs") - 1) * (F.col("sum") - F.coalesce(F.lag("sum").over(down), zero))
    saved = named.withColumn("edge", F.when(F.col("rep") == F.col("conv_id"), edge).otherwise(zero))
    below = F.sum("edge").over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    saved = saved.withColumn("below", below).groupBy(*KEY).agg((F.sum("below") - F.sum("edge")).alias("below"), F.sum("edge").alias("edge"))
    full = stage(told.join(saved, KEY).join(plain, KEY), "nodes")
    # One row each for the root.
    every = ended.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    top = full.agg(F.count_if(F.col("up_depth") == 0).alias("children"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.coalesce(F.sum("edge"), zero).alias("saved")).first()
    columns = "conv_id long, depth long, p1 long, p2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    at_root = [(every["conv_id"], 0, 0, 0, None, every["n"], top["children"], max(1, top["leaves"]), top["saved"])] if every["n"] else []
    # Along an edge all prefixes have the members of its lower node.
    names = full.select(F.col("depth").alias("up_depth"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("up_conv"))
    hung = full.join(names, ["up_depth", "u1", "u2"], "left").select(
        F.col("conv_id").alias("rep"), F.col("depth").alias("extent"), "up_depth", F.coalesce("up_conv", F.lit(every["conv_id"])).alias("up_conv"),
        "n_convs", F.col("n_children").alias("branches"), "n_leaves", "below",
    )
    extent = paths.select("rep", F.col("depth").alias("extent"), F.col("sum").alias("extent_sum"))
    along = hung.join(extent, ["rep", "extent"]).join(paths, "rep").filter("depth > up_depth AND depth <= extent")
    rest = (F.col("n_convs") - 1) * (F.col("extent_sum") - F.col("sum") + F.col("bytes"))
    rows = along.select(
        F.col("rep").alias("conv_id"),
        *KEY,
        F.when(F.col("depth") - 1 == F.col("up_depth"), F.col("up_conv")).otherwise(F.col("rep")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("depth") == F.col("extent"), F.col("branches")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + rest).alias("saved_tokens"),
    )
    lists = id_lists(ended.withColumnRenamed("length", "depth"), KEY)
    return (
        rows.unionByName(spark.createDataFrame(at_root, columns))
        .join(lists, KEY, "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    )
