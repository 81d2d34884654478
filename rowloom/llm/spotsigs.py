"""Document fingerprints: SpotSigs, chains of content words after common-word anchors."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowloom.llm.common import partitions_of, whole_text

# Common function words of English, German, Spanish and French, the anchors.
ANCHORS = """
a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you
als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht sich sie sind und von war werden wie zu zum zur
al como con de del el en es esta la las lo los más no para pero por que se sin su sus un una y
au aux avec ce ces dans des du elle est et il je la le les leur mais ne nous on ou par pas plus pour qui sa se ses son sur un une vous
""".split()
#: Content words in a chain.
CHAIN = 2
#: Words in a window, the local signature of a text without a whole chain.
WINDOW = 5
#: Signs before the first or after the last letter or digit of a word; words of signs only are left as they are.
SPACE, LETTER = r"\x20\x09-\x0D", r"\p{L}\p{M}\p{N}"
OUTER_SIGNS = rf"(?<![^{SPACE}])[^{SPACE}{LETTER}]++(?=[{LETTER}])|(?<=[{LETTER}])[^{SPACE}{LETTER}]++(?![^{SPACE}])"
#: A fingerprint is its signatures in order, in so many hexadecimal digits each.
DIGITS = 8
#: Candidates of a pairs search are linked from this likeness on.
LIKE = 0.8


def words_of(text: Column) -> Column:
    """Lower-cased words, without the signs around them."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), OUTER_SIGNS, ""), rf"[{SPACE}]+"), lambda w: w != "")


def with_signatures(rows: DataFrame, text: str, out: str, windows: bool = False) -> DataFrame:
    """Adds ``out``: the sorted distinct signatures of a text column, as longs.

    Each anchor starts a chain of the next ``CHAIN`` words that are no anchors,
    within the text. A text without a whole chain has one signature, that of all its words, or with
    ``windows`` one for each ``WINDOW`` words in a row, so that an edit changes few; one without words has none.
    """
    words, at, content = f"{out}_words", f"{out}_at", f"{out}_content"
    anchor = lambda w: w.isin(ANCHORS)
    rows = rows.withColumn(words, words_of(F.col(text)))
    # The arrays below are used more than once each, so that the planner keeps them as columns.
    place = F.filter(F.transform(words, lambda w, i: F.when(anchor(w), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    rows = rows.withColumn(at, place).withColumn(content, F.filter(words, lambda w: ~anchor(w)))
    # Of the words before the j-th anchor, at place i, i - j are content.
    whole = F.filter(F.transform(at, lambda i, j: F.struct(i.alias("i"), (i - j).alias("k"))), lambda p: p["k"] + CHAIN <= F.size(content))
    chain = F.transform(
        whole, lambda p: F.xxhash64(F.get(F.col(words), p["i"]), *[F.get(F.col(content), p["k"] + n) for n in range(CHAIN)])
    )
    alone = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.col(words))))
    if windows:
        starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
        each = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(words), i, WINDOW)))
        alone = F.when(F.size(words) > WINDOW, each).otherwise(alone)
    # The first anchor has the most content words after it.
    any_chain = F.coalesce(F.get(F.col(at), F.lit(0)) + CHAIN <= F.size(content), F.lit(False))
    short = F.transform(F.when(any_chain, chain).otherwise(alone), lambda h: F.pmod(h, F.lit(1 << (4 * DIGITS))))
    return rows.withColumn(out, F.array_sort(F.array_distinct(short))).drop(words, at, content)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s), DIGITS, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; 1 for two empty ones. Sets are compared only if both have members."""
    common = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(common / (F.size(a) + F.size(b) - common))
    )


def length_partition(size: Column, like: float = LIKE) -> Column:
    """Partition of a set by its length: sets of at least ``like`` likeness are in the same or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(like)) + F.lit(1e-9)).cast("int")


def similar_pairs(sigs: DataFrame, like: float = LIKE) -> DataFrame:
    """a, b, likeness of all pairs of ``sigs`` (doc_id, signatures) with at least this likeness, a < b.

    Only sets of the same or the next length partition meet, and only over one of
    their rarest signatures: a set of n members shares at least like * n of them with any
    partner, so one of the n - ceil(like * n) + 1 rarest is shared (ordered by document
    frequency). Sizes bound the likeness before sets are compared. Equal sets should be made one
    row first (``classes``); empty sets have no partner.
    """
    sets = sigs.filter(F.size("signatures") > 0)
    used = sets.select("doc_id", F.explode("signatures").alias("s"))
    frequency = used.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    # A signature of one document only finds nothing, but it takes a place among the rarest.
    ranked = used.join(frequency, "s").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))
    n = F.size("signatures")
    prefix = n - F.ceil(n * like - 1e-9).cast("int") + 1
    short = (
        sets.join(ranked, "doc_id")
        .withColumn("alone", n - F.size("shared"))
        .withColumn("part", length_partition(n, like))
        .withColumn("rare", F.slice("shared", F.lit(1), F.greatest(prefix - F.col("alone"), F.lit(0))))
        .select("doc_id", n.alias("n"), "part", F.explode("rare.s").alias("s"))
    )
    left = short.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = short.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), "s", "part")
    met = left.join(right, ["s", "part"]).filter("a <> b").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * like - 1e-9)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = sigs.select(F.col("doc_id").alias("a"), F.col("signatures").alias("of_a"))
    other = sigs.select(F.col("doc_id").alias("b"), F.col("signatures").alias("of_b"))
    told = pairs.join(one, "a").join(other, "b").select("a", "b", likeness(F.col("of_a"), F.col("of_b")).alias("likeness"))
    return told.filter(F.col("likeness") >= like - 1e-9)


def classes(sigs: DataFrame) -> DataFrame:
    """doc_id, class_id: documents with one fingerprint are one class, named by its smallest id."""
    least = sigs.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    return sigs.join(least, "fingerprint").select("doc_id", "class_id")


def _bounds(ids: DataFrame, n: int) -> list[int]:
    """Starts of about n ranges of ids with as many rows each; every start is an id of the table, the least one first."""
    shares = ", ".join(f"{k / n:.9f}D" for k in range(1, n))
    row = ids.agg(F.min("doc_id"), F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 20 * n)})") if n > 1 else F.lit(None)).first()
    return sorted({row[0], *(row[1] or [])} - {None})


def _nested(bounds: list[int]) -> list[list[int]]:
    width = max(1, int(len(bounds) ** 0.5))
    return [bounds[i : i + width] for i in range(0, len(bounds), width)]


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs with ``part``, their range of ids, and ``ghost``: each range also holds the first row of the next one, the last that of the first.

    So the next document is found within a range, and texts are shuffled once.
    Ranges are looked up in two steps, among the starts of groups of ranges, then within the group.
    """
    spark = docs.sparkSession
    bounds = _bounds(docs.select("doc_id"), 4 * partitions_of(spark)) or [0]
    nested = _nested(bounds)
    heads = F.from_json(F.lit(json.dumps([g[0] for g in nested])), "array<bigint>")
    groups = F.from_json(F.lit(json.dumps(nested)), "array<array<bigint>>")
    group = F.size(F.filter(heads, lambda b: b <= F.col("doc_id")))
    inside = F.size(F.filter(F.get(groups, F.col("group") - 1), lambda b: b <= F.col("doc_id")))
    starts = F.array_contains(F.get(groups, F.col("group") - 1), F.col("doc_id"))
    width = len(nested[0])
    placed = docs.filter("doc_id IS NOT NULL").withColumn("group", group)
    placed = placed.withColumn("part", (F.col("group") - 1) * width + inside - 1).withColumn("first", starts)
    before = F.when(F.col("part") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("part") - 1)
    own = F.struct(F.col("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(before.alias("part"), F.lit(True).alias("ghost"))
    places = F.explode(F.when(F.col("first"), F.array(own, ghost)).otherwise(F.array(own)))
    return placed.withColumn("place", places).select(*docs.columns, "place.part", "place.ghost")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, in ascending order of ids; the last document is followed by the first.

    Rows that repeat an id follow each other by text. A document alone follows itself. Rows without an id have no order and no next.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    order = W.partitionBy("part").orderBy("ghost", "doc_id", "text")
    met = in_ranges(texts).withColumn("next_text", F.lead("text").over(order)).filter("NOT ghost")
    return met.select("doc_id", "text", "next_text").unionByName(texts.filter("doc_id IS NULL").withColumn("next_text", F.lit(None).cast("string")))


def fingerprints(docs: DataFrame, windows: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, length_partition.

    One row per row of ``docs``. The edited text has its last half (rounded down) of code points replaced
    by as many first ones of the next document, or all. near_edited and near_next are the
    likenesses of the fingerprint to those of the edited and the next text. Null and empty texts have the empty fingerprint.
    A row without an id has no next document: its edited text loses its half, its near_next is 0.
    ``windows``: see ``with_signatures``.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.coalesce(F.substring("next_text", F.lit(1), half), F.lit(""))))
    rows = rows.withColumn("next_or_none", F.coalesce("next_text", F.lit("")))
    for text, out in (("text", "own"), ("edited", "of_edited"), ("next_or_none", "of_next")):
        rows = with_signatures(rows, text, out, windows)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"),
        F.when(F.col("next_text").isNull(), F.lit(0.0)).otherwise(likeness(F.col("own"), F.col("of_next"))).alias("near_next"),
        length_partition(F.size("own")).alias("length_partition"),
    )
