"""Classes of similar things from buckets of candidates.

Two things are candidates if they share a key, however many share it.  Pairs of candidates that can't be similar
are told by ``sketches``: the parities of a set's elements by hash, whose differences between two sets are at most
as many as the elements that only one of them has.  That bounds the similarity from above, never wrongly, inside the
join that forms the pairs; the pairs left are compared.

``link`` compares the members of a bucket with its center, the member with the most company; a bucket of two is done by
that, and goes no further.  Large buckets go on
with more centers, chosen from members of other classes than all centers before, as long as that settles a good
part of them.  Then every member that is not of the first center's class meets all members of other classes that
it could be similar to.  So every two candidates that are similar end in one class, and the members of one large
class are never compared with each other.

Members of a bucket that are unlike all others cost a bound for each two of them, but neither a row nor a
comparison; where nothing but keys is known (no ``sketch``), those of a key of more than ``FEW`` members meet under
elements of their sets instead (``prefixes``): of each set the rarest elements, down to where the rest is too little
for a similarity of ``threshold``.  Two sets that similar have one of these in common whatever the order is, as
long as it is one for all, so no link is lost.

``components`` finds connected components by large and small stars.  Edges never come to the driver,
which sees counts only.  Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from headroom.llm import words
from headroom.sources.staging import short_methods, stage

#: How many centers a large bucket has in each round but the first.
CENTERS = 16
#: Buckets of more open members have more rounds; without sketches, members of a key of more meet by their rarest elements.
FEW = 32
#: Words of 64 bits of a sketch.
SKETCH_WORDS = 8
#: Elements are counted into this many counters, to order them.
COUNTER_BITS = 18
#: The filter in front of a join has this many words of 64 bits.
FILTER_WORDS_BITS = 20


def marked(df: DataFrame, column: str, keys: DataFrame, key: str, mark: str, how: str = "left") -> DataFrame:
    """All rows, with ``mark``: whether ``column`` may be a key, true for all that are and few others.

    A bit map of a fixed size is broadcast, so that rows without partner can stay out of a shuffle.
    """
    hashed = F.xxhash64(F.col(key))
    word = F.shiftrightunsigned(hashed, 64 - FILTER_WORDS_BITS).alias("_word")
    bit = hashed.bitwiseAND(F.lit(63)).cast("int")
    bits = keys.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    own = F.xxhash64(F.col(column))
    found = df.withColumn("_word", F.shiftrightunsigned(own, 64 - FILTER_WORDS_BITS)).join(F.broadcast(bits), "_word", how)
    return found.select(*df.columns, (F.coalesce(F.getbit("_bits", own.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1).alias(mark))


def among(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` may be a key: all that are, and few others."""
    return marked(df, column, keys, key, "_maybe", "inner").where("_maybe").select(df.columns)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """A written table, its number of rows and a sum of their hashes, counted while writing."""
    seen = Observation()
    hashed = F.xxhash64(*df.columns).bitwiseAND(F.lit((1 << 30) - 1))
    table = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(hashed).alias("hashes")), name)
    return table, seen.get["rows"], seen.get["hashes"] or 0


def _toward_least(both: DataFrame, keep) -> DataFrame:
    """Each kept neighbour of u linked to the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of an edge ``a``-``b``."""
    edges, *state = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while state[0]:
        forth, back = edges.select(F.col("a").alias("u"), F.col("b").alias("v")), edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        large = _toward_least(forth.unionAll(back), F.col("v") > F.col("u")).where("a <> b").distinct()
        # small star: of each node, the smaller neighbours; then the node itself joins the least
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        was = state
        edges, *state = staged(small.where("a <> b").distinct(), name)
        if was == state:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _of_several(members: DataFrame, name: str) -> DataFrame:
    """Rows whose key has several nodes, with ``size``, the number of its rows.

    Most keys have one node; half of a key's bits are enough to leave out most of them, in a smaller shuffle.
    """
    half = F.shiftright("key", 32).cast("int")
    halves = stage(members.groupBy(half.alias("half")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), name)
    maybe = among(members.withColumn("half", half), "half", halves, "half").drop("half")
    shared = maybe.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
    shared = stage(shared.where("low < high").select("key", "size"), name)
    return among(members, "key", shared, "key").join(shared, "key")


def _counter(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def prefixes(texts: DataFrame, text: str, sets: Callable, threshold: float) -> DataFrame:
    """``node`` and ``elements``: the rarest elements of each text's set, one of which any two texts as similar share.

    ``sets`` gives text number, hash and weight of the distinct elements of texts.  Elements are in the order of their
    counters, then of their hashes.  What stands before the first common element of two sets is in neither's common
    part, so it has at most ``1 - threshold`` of either's weight.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for block in words.blocks(batch, text):
                total += np.bincount(_counter(sets(words.strings(block, text))[1]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    counted = texts.select(text).mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    loads = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    loads[counted["counter"]] = counted["n"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch, text):
                own, elements, weight = sets(words.strings(block, text))
                order = np.lexsort((elements, loads[_counter(elements)], own))
                own, elements, weight = own[order], elements[order], weight[order].astype(float)
                total = np.bincount(own, weight, block.num_rows)
                before = np.cumsum(weight) - weight
                before -= (np.cumsum(total) - total)[own]
                # rounding must not lose an element
                chosen = np.flatnonzero(before <= (1 - threshold + 1e-6) * total[own] + 1e-6)
                ends = np.concatenate([[0], np.cumsum(np.bincount(own[chosen], minlength=block.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(elements[chosen].view(np.int64)))
                yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index("node")), lists], ["node", "elements"])

    return texts.select("node", text).mapInArrow(choose, "node long, elements array<long>")


def _sketched(by_node: DataFrame) -> list[str]:
    return [c for c in by_node.columns if c in ("total", "low") or c.startswith("sketch_")]


def sketches(texts: DataFrame, text: str, sets: Callable, n_words: int = SKETCH_WORDS) -> DataFrame:
    """``node``, ``total`` (weight of its set), ``low`` (least weight in it) and ``sketch_0`` ..., the bits of its sketch.

    ``sets`` gives text number, hash and weight of the distinct elements of texts.  Each element turns the bit
    that the first bits of its hash name, so elements that two sets have in common turn the same bits in both.
    """
    size = 64 * n_words
    shift = np.uint64(64 - size.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # wide sketches of smaller blocks, since bits are counted in 64 bits each
            for block in words.blocks(batch, text, words.BLOCK_BYTES * 16 // max(n_words, 16)):
                own, elements, weight = sets(words.strings(block, text))
                n = block.num_rows
                total = np.bincount(own, weight, n)
                low = np.full(n, np.inf)
                begins = np.flatnonzero(np.diff(own, prepend=-1))
                if len(own):
                    low[own[begins]] = np.minimum.reduceat(weight.astype(float), begins)
                turned = np.bincount(own * size + (elements >> shift).astype(np.int64), minlength=n * size)
                bits = np.packbits((turned & 1).astype(np.uint8).reshape(n, size), axis=1).view(np.int64)
                columns = [block.column(block.schema.get_field_index("node")), pa.array(total), pa.array(low), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(n_words))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "total", "low", *(f"sketch_{k}" for k in range(n_words))])

    fields = ", ".join(f"sketch_{k} long" for k in range(n_words))
    return texts.select("node", text).mapInArrow(run, f"node long, total double, low double, {fields}")


def _may_be_similar(columns: list[str], other: str, threshold: float) -> Column:
    """Whether the sketches of two sets, the second's columns under names that begin with ``other``, allow ``threshold``.

    What only one of two sets has weighs at least the difference of their totals, and at least the least weight for
    each bit in which the sketches differ.  Of sets as similar as ``threshold`` it is
    ``(1 - threshold) / (1 + threshold)`` of both totals or less.
    """
    if not columns:
        return F.lit(True)
    bits = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(other + c))) for c in columns if c not in ("total", "low"))
    apart = F.greatest(bits * F.least("low", other + "low"), F.abs(F.col("total") - F.col(other + "total")))
    # rounding must not tell apart what could be similar
    return apart * (1 + threshold) <= (F.col("total") + F.col(other + "total")) * (1 - threshold) * (1 + 1e-6) + 1e-6


def meetings(members: DataFrame, prepare: Callable[[DataFrame], None] | None, rarest: Callable[[DataFrame], DataFrame] | None, crossed: bool, sketch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key``, ``node`` and ``company`` of all buckets in which candidates meet.

    A node has as many keys as it has bands, so what is gathered by node is small.  ``crossed``: elements are common
    enough by themselves that they count together with a frequent key only.  With sketches, buckets are those of the keys.
    """
    if sketch is not None:
        met = stage(_of_several(members, "shared").distinct(), "met")
        by_node, n, _ = staged(met.groupBy("node").agg(F.sum("size").alias("company")), "by_node")
        if n and prepare is not None:
            prepare(by_node.select("node"))
        own = by_node.join(sketch(by_node.select("node")), "node") if n else by_node
        return met.drop("size").join(own, "node")
    by_node = _of_several(members, "shared").groupBy("node").agg(F.collect_set(F.struct("key", "size")).alias("keys"))
    few = F.transform(F.filter("keys", lambda k: k["size"] <= FEW), lambda k: k["key"])
    frequent = F.transform(F.filter("keys", lambda k: k["size"] > FEW), lambda k: k["key"])
    by_node = by_node.select("node", few.alias("few"), frequent.alias("frequent"), F.aggregate("keys", F.lit(0).cast("long"), lambda n, k: n + k["size"]).alias("company"))
    by_node, n, _ = staged(by_node, "by_node")
    if n and prepare is not None:
        prepare(by_node.select("node"))
    met = by_node.select("node", "company", F.explode("few").alias("key"))
    many, n, _ = staged(by_node.where(F.size("frequent") > 0).select("node", "company", "frequent"), "frequent")
    if n and rarest is None:
        two = F.flatten(F.transform("frequent", lambda x: F.transform(F.filter("frequent", lambda y: y > x), lambda y: F.xxhash64(x, y))))
        met = met.unionAll(many.select("node", "company", F.explode(two).alias("key")))
    elif n:
        by_element = many.join(rarest(many.select("node")), "node").select("node", "company", "frequent", F.explode("elements").alias("element"))
        if crossed:
            by_element = by_element.select("node", "company", "element", F.explode("frequent").alias("frequent"))
        else:
            by_element = by_element.withColumn("frequent", F.lit(0).cast("long"))
        met = met.unionAll(by_element.select("node", "company", F.xxhash64("frequent", "element").alias("key")))
    met = stage(met, "meetings")
    return _of_several(met, "shared").select("key", "node", "company")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members with ``root``, themselves if they are linked to nothing."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def link(
    members: DataFrame,
    compare: Callable[[DataFrame], DataFrame],
    threshold: float,
    prepare: Callable[[DataFrame], None] | None = None,
    rarest: Callable[[DataFrame], DataFrame] | None = None,
    crossed: bool = False,
    sketch: Callable[[DataFrame], DataFrame] | None = None,
    finer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """``node`` and ``root`` of all nodes that are linked to another; None if there are none.

    ``members`` has ``key`` and ``node`` (long); ``compare`` adds ``sim`` to pairs ``a`` < ``b``; ``sketch`` gives the
    ``sketches`` of nodes, and ``rarest`` the ``prefixes``; where nothing is known but keys, members of frequent keys
    meet under every two of these, and those that have one in common only do not.  ``prepare`` is given all nodes that may
    ever be compared, before anything else is asked.  ``finer`` gives wider sketches, for the members that meet all others.
    """
    by_node = None

    def kept_sketch(nodes: DataFrame) -> DataFrame:
        nonlocal by_node
        by_node = stage(sketch(nodes).dropDuplicates(["node"]), "sketched")
        return by_node

    met = meetings(members, prepare, rarest, crossed, kept_sketch if sketch is not None else None)
    order = [F.desc("company"), F.xxhash64("node"), F.col("node")]
    columns = _sketched(met)
    bucket = Window.partitionBy("key")
    ranks = {"rank": F.row_number().over(bucket.orderBy(*order)), "size": F.count(F.lit(1)).over(bucket)}
    # the center's columns come to its bucket's rows where these are ranked, so no join is needed for its pairs
    centers = {f"other_{c}": F.first(c).over(bucket.orderBy(*order)) for c in ("node", *columns)}
    faced = met.withColumns(ranks | centers).withColumn("near", (F.col("node") != F.col("other_node")) & _may_be_similar(columns, "other_", threshold))
    faced = faced.where("size > 2 or near").select("key", "node", "company", "rank", "size", "near", F.col("other_node").alias("center"))
    with short_methods(faced.sparkSession):
        faced, n, _ = staged(faced, "members")
    if not n:
        return None
    slim = faced.where("size > 2").select("key", "node", "company", "rank")
    roots = compared = None

    def sketched(chosen: DataFrame) -> DataFrame:
        """Chosen members and their sketches, of which each node has one for all its keys."""
        return chosen if by_node is None else chosen.join(among(by_node, "node", chosen, "node"), "node")

    def meet(left: DataFrame, right: DataFrame, where: Column) -> None:
        """Compare what two sides have in a bucket in common, and find the classes anew."""
        fine = [c for c in left.columns if c.startswith("fine_")]
        facing = right.select("key", *(F.col(c).alias(f"other_{c}") for c in right.columns if c in ("node", "root", "open") or c in columns or c in fine))
        # the narrow sketches first, as they cost less
        pairs = left.join(facing, "key").where("root <> other_root").where(where & _may_be_similar(columns, "other_", threshold) & _may_be_similar(fine, "other_", threshold))
        verify(pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct())

    def verify(pairs: DataFrame) -> None:
        nonlocal roots, compared
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        with short_methods(pairs.sparkSession):
            pairs = stage(pairs, "pairs")
        new, n, _ = staged(compare(pairs).select("a", "b", "sim"), "compared")
        if n:
            compared = new if compared is None else compared.unionAll(new)
            edges, n, _ = staged(compared.where(F.col("sim") >= threshold), "links")
            roots = stage(components(edges), "roots") if n else None

    # one center for each bucket, then more for large buckets, as long as they settle an eighth of a bucket
    verify(faced.where("near").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct())
    open_, chosen, round_ = slim.where("rank > 1"), slim.where("rank = 1"), 0
    while True:
        if round_:
            meet(_rooted(sketched(open_), roots), _rooted(sketched(chosen), roots), F.lit(True))
        settled = _rooted(chosen, roots).select("key", "root").distinct()
        left = _rooted(open_, roots).join(settled, ["key", "root"], "left_anti").drop("root")
        if round_:
            # the new centers are open no more, but that settles none but themselves
            left = left.join(chosen.select("key", "node"), ["key", "node"], "left_anti")
        sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("n_left")).where(F.col("n_left") > FEW)
        if round_:
            before = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n_open"))
            sizes = sizes.join(before, "key").where(F.col("n_open") - CENTERS - F.col("n_left") >= F.col("n_open") / 8)
        open_, n, _ = staged(left.join(sizes.select("key"), "key").select(slim.columns), "open")
        if not n:
            break
        place = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
        chosen = stage(open_.withColumn("place", place).where(F.col("place") <= CENTERS).drop("place"), "centers")
        round_ += 1
    # the rest of each bucket with all that the first center didn't settle
    rooted = _rooted(slim, roots).withColumn("open", F.col("root") != F.first("root").over(bucket.orderBy("rank")))
    rooted = rooted.withColumn("some", F.max("open").over(bucket)).where("some and rank > 1").select("key", "node", "root", "open")
    rooted, n, _ = staged(rooted, "rooted")
    if n:
        rest = sketched(rooted)
        if finer is not None:
            wide = finer(rooted.select("node").distinct()).drop("total", "low").dropDuplicates(["node"])
            wide = stage(wide.withColumnsRenamed({c: c.replace("sketch_", "fine_") for c in wide.columns}), "finer")
            rest = rest.join(wide, "node")
        rooted = stage(rest, "rest")
        meet(rooted.where("open"), rooted, ~F.col("other_open") | (F.col("node") < F.col("other_node")))
    return roots


def with_texts(pairs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Pairs and the texts of both, from a table of ``node`` and ``text``."""
    own = among(texts, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("node").alias(side), F.col(text).alias(f"{text}_{side}")), side)
    return pairs.select("a", "b", f"{text}_a", f"{text}_b")
