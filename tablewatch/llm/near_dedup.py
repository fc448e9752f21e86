"""Near-duplicate documents by a chosen-path set similarity join.

Every document is the set of its word shingles. ``T`` minwise values of the set are drawn; the low bits
form a sketch, and the first ``COORDINATES`` are the tokens a path may choose. A tree starts with all
documents in one node. A node chooses one or two coordinates by its own hash, and each document moves to the
child named by its minwise value there: similar sets stay together with a probability of their similarity,
others part. Small nodes are compared exhaustively, large ones branch again, and independent trees repeat
this to the target recall. Every link is confirmed on the full sets; nothing is decided by a sketch alone.

How nodes are compared: in the first tree, every set meets the most similar of its nodes' smallest members (one pair per
set). Then, in the nodes of all trees, representatives of each component so far meet some of the node's largest component.
What is left are members of *different* components: those outside a node's largest component meet the others there, as a link
inside one component changes nothing. Nodes that stay large to the last level come after all others are linked. So a group of
many mutual copies never emits all its pairs, and no node is capped or dropped.

Rows: a null or blank text has no set, links with nothing and is its own class. A text of fewer words than a
shingle is one shingle, its whole word sequence. Equal sets are one class before the trees begin, with a number of its own,
so rows that share an id but not the text are linked text by text. A null ``doc_id`` takes no part. Extra columns are ignored.
The smallest doc_id names a class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewatch.llm import textbatch as tb
from tablewatch.llm.shared import bounded, components, tagged, written

T = 256  # minwise values in the sketch: longs of one bit each
BITS = [f"bits_{k}" for k in range(T // 64)]
COORDINATES = 64  # minwise values a path can choose
TREES = 12
# A pair of similarity 0.8 survives a level with probability 0.84 (one coordinate, and a second one in a quarter
# of the nodes), the two levels most nodes have with 0.73, and DEPTH levels with 0.48: twelve trees miss it with a
# chance of 2 in 10 million, or of 4 in 10,000 where nodes stay large to the end.
DEPTH = 6
TURNS = 4  # representatives of a component
SMALL = 256  # members of a node that does not branch again
SET_ROWS = 20  # a full set counts as so many rows when files are filled
# Of 256 sketch bits, sets of similarity 0.8 differ in 25.6 (sd 4.8); 48 is more than four and a half deviations away.
MAX_BITS = 48

# Each shingle flips one of 512 bits. Where two sets differ in d shingles, at most d bits differ, so too many of
# these bits rule a pair out for certain.
FLIPS = [f"flips_{k}" for k in range(8)]
CARRIED = ["set_id", "n_shingles", *BITS]
HELD = [*CARRIED, *FLIPS]  # by a member of a node, so that no node's members have to be joined for them
SET = ["set_a", "set_b", "n_shingles"]  # two hashes of a set and its size
SETS = ", ".join([*(f"{c} long" for c in ("doc_id", "n_shingles", *BITS, "set_a", "set_b", *FLIPS)), "mins binary"])
NODES = ", ".join(f"{c} long" for c in ("node", *HELD))


def _shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, documents, sorted distinct hashes, cuts) of each block."""
    for block in tb.blocks(texts):
        w = tb.words(block)
        h = tb.word_hashes(block, w, lower=True)
        s, at = tb.shingles(h, w.doc, size)
        doc = w.doc[at]
        counts = np.diff(w.cuts)
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            with np.errstate(over="ignore"):
                salt = tb.stream(size, 29) | tb.U64(1)
                whole = tb.mix(tb.sums(h * salt[(np.arange(len(h)) - w.cuts[w.doc]) % size], w.cuts)[few])
            order = np.argsort(np.concatenate((doc, few)), kind="stable")
            s, doc = np.concatenate((s, whole))[order], np.concatenate((doc, few))[order]
        sets, cuts = tb.distinct_per_doc(s, doc, block.n)
        yield block.first, block.n, sets, cuts


def _minwise(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """T x documents minima of T hashes; documents without a set get the largest number."""
    full = np.flatnonzero(np.diff(cuts))
    out = np.full((T, len(cuts) - 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(full):
        return out
    flip, times = tb.stream(T, 31), tb.stream(T, 37) | tb.U64(1)
    starts = cuts[full]
    with np.errstate(over="ignore"):
        for k in range(T):
            out[k, full] = np.minimum.reduceat((sets ^ flip[k]) * times[k], starts)
    return out


def _packed(values: np.ndarray) -> np.ndarray:
    """The low bits of 64 rows of numbers, as one number per column."""
    return np.bitwise_or.reduce((values & tb.U64(1)) << np.arange(64, dtype=np.uint64)[:, None], axis=0)


def _flips(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """FLIPS of each document, as rows of longs."""
    n, width = len(cuts) - 1, 64 * len(FLIPS)
    place = np.repeat(np.arange(n), np.diff(cuts)) * width + (sets >> tb.U64(20)).astype(np.int64) % width
    odd = (np.bincount(place, minlength=n * width) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(odd.reshape(n, width), axis=1).view(np.uint64).T)


def _hashes(sets: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """set_a and set_b of each document."""
    with np.errstate(over="ignore"):
        return [tb.sums(tb.mix(sets ^ tb.U64(k)), cuts) for k in (0x51, 0xA7)]


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, n, sets, cuts in _shingle_sets(batch.column(1), size):
            lows = _minwise(sets, cuts)
            mixed = tb.mix(lows)
            bits = [_packed(mixed[64 * k : 64 * k + 64]) for k in range(len(BITS))]
            both = _hashes(sets, cuts)
            mins = np.ascontiguousarray((mixed[:COORDINATES] >> tb.U64(32)).astype("<u4").T)
            longs = [pa.array(x.view(np.int64)) for x in (*bits, *both, *_flips(sets, cuts))]
            yield pa.record_batch(
                [pa.array(ids[first : first + n]), pa.array(np.diff(cuts)), *longs, pa.array([row.tobytes() for row in mins], pa.binary())],
                names=["doc_id", "n_shingles", *BITS, "set_a", "set_b", *FLIPS, "mins"],
            )


def shingle_sketches(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: set size, two hashes of the set, sketch bits, minwise values."""
    return tagged(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _sketch(it, size), SETS)


def _children(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates each node chooses: one, and a second in a quarter of the nodes."""
    m = tb.mix(node ^ tb.U64(0x5BD1E995))
    first = (m & tb.U64(COORDINATES - 1)).astype(np.int64)
    step = 1 + ((m >> tb.U64(8)) % tb.U64(COORDINATES - 1)).astype(np.int64)
    twice = np.flatnonzero((m >> tb.U64(40)) & tb.U64(3) == 0)
    return np.concatenate((np.arange(len(node)), twice)), np.concatenate((first, ((first + step) % COORDINATES)[twice]))


def _branch_once(node: np.ndarray, row: np.ndarray, mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, coordinate = _children(node)
    value = mins[row[at], coordinate].astype(np.uint64)
    with np.errstate(over="ignore"):
        child = tb.mix(node[at] * tb.U64(0x9E3779B97F4A7C15) + (value << tb.U64(7)) + coordinate.astype(np.uint64))
    return child, row[at]


def _branch(batches: Iterator[pa.RecordBatch], trees: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Move documents ``levels`` down: from the roots of all trees, or from the nodes listed in a column."""
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, len(batch), 2000)):
            col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            num = {k: v.to_numpy(zero_copy_only=False) for k, v in col.items() if k not in ("mins", "nodes")}
            mins = np.frombuffer(b"".join(col["mins"].to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
            rows = np.arange(len(part))
            if "nodes" in col:
                node, row = col["nodes"].flatten().to_numpy().view(np.uint64), np.repeat(rows, col["nodes"].value_lengths().to_numpy())
            else:
                node, row = np.repeat(tb.stream(trees, 41), len(rows)), np.tile(rows, trees)
            for _ in range(levels):
                node, row = _branch_once(node, row, mins)
            yield pa.record_batch(
                [pa.array(node.view(np.int64)), *(pa.array(num[k][row]) for k in HELD)],
                names=["node", *HELD],
            )


def _shared(nodes: DataFrame) -> DataFrame:
    """Nodes of more than one member; most paths end alone."""
    held = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("node")
    return written(nodes.join(held, "node", "left_semi"), nodes.count())


def _bits_apart(x: str, y: str, names: list[str] = BITS) -> Column:
    return reduce(Column.__add__, (F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in names))


def _near(x: str, y: str, percent: int) -> Column:
    """Sets whose sizes alone rule out the similarity, and those whose sketches are far apart, are no candidates."""
    small, large = (f(f"{x}.n_shingles", f"{y}.n_shingles") for f in (F.least, F.greatest))
    return (100 * small >= percent * large) & (_bits_apart(x, y) <= MAX_BITS)


def _may_link(x: str, y: str, percent: int) -> Column:
    """``_near``, and no more differing shingles for certain than the similarity allows."""
    sizes = F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")
    return _near(x, y, percent) & ((100 + percent) * _bits_apart(x, y, FLIPS) <= (100 - percent) * sizes)


def _most_similar(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of each set of ``x`` with the most similar of the sets that ``y`` has in its nodes."""
    x, y = x.alias("x"), y.alias("y")
    met = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.set_id") != F.col("y.set_id")) & _near("x", "y", percent)).select(
        F.col("x.set_id").alias("b"), F.col("y.set_id").alias("a"), _bits_apart("x", "y").alias("apart")
    )
    return met.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("near")).select(F.col("near.a").alias("a"), "b")


def _with_smallest(nodes: DataFrame, percent: int) -> DataFrame:
    """Each set with the most similar of its nodes' smallest members."""
    low = nodes.groupBy("node").agg(F.min(F.struct(*CARRIED)).alias("low")).select("node", "low.*")
    return _most_similar(nodes, low, percent)


def _with_largest(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``TURNS`` members of each component of a node, each with a member of the node's largest component. ``n``: rows at most."""
    turn = F.explode(F.array(*map(F.lit, range(TURNS))))
    turns = rows.select("node", "component", *CARRIED, turn.alias("turn")).withColumn("lot", F.xxhash64("set_id", "turn"))
    drawn = turns.groupBy("node", "component", "turn").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("lot", *CARRIED)).alias("one"))
    drawn = written(drawn.select(F.xxhash64("node", "turn").alias("node"), "component", "k", "one.*"), TURNS * n)
    most = drawn.groupBy("node").agg(F.max(F.struct("k", "component", *CARRIED)).alias("most")).select("node", "most.*")
    return _most_similar(drawn, most, percent)


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, size: int, percent: int, rows: int | None) -> DataFrame:
    """Pairs whose full sets meet 100 * intersection >= percent * union. ``firsts``: a document of each set; ``rows``: pairs at most, if known."""
    pairs = written(pairs, rows)
    n = 2 * pairs.count()
    asked = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select("b"))
    wanted = written(firsts.join(bounded(asked), "set_id", "left_semi"), n)

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, n, sets, cuts in _shingle_sets(batch.column(1), size):
                both = (pa.array(x.view(np.int64)) for x in _hashes(sets, cuts))
                shingles = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.record_batch(
                    [ids.slice(first, n), *both, pa.array(np.diff(cuts)), shingles], names=["doc_id", *SET, "shingles"],
                )

    of_docs = docs.join(bounded(wanted.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        of_text, "doc_id long, set_a long, set_b long, n_shingles long, shingles array<long>"
    )
    # repeated rows have one set
    sets = written(of_docs.join(bounded(wanted), ["doc_id", *SET]).select("set_id", "shingles").dropDuplicates(["set_id"]), SET_ROWS * n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    met = (
        pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    )
    return met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _grouped(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with their component, of the nodes that hold more than one, and the node's size."""
    rows = nodes.join(bounded(classes).withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")
    )
    mixed = rows.groupBy("node").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")
    ).where("lo <> hi").select("node", "n")
    return rows.join(mixed, "node")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between different components of a node: members outside the node's largest component with the others."""
    held = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("k"))
    most = held.groupBy("node").agg(F.max_by("component", F.struct("k", "component")).alias("most"))
    x, y = rows.join(most, "node").where("component <> most").alias("x"), rows.alias("y")
    # both of a pair outside the largest component meet once, from the smaller one
    once = (F.col("y.component") == F.col("x.most")) | (F.col("x.component") < F.col("y.component"))
    return (
        x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & once & _may_link("x", "y", percent))
        .select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document with an id."""
    docs = tagged(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(shingle_sketches(docs, size))
    n_docs = sketches.count()
    full = sketches.where("n_shingles > 0")
    # the numbers of the sets hold because they are written before they are used
    firsts = full.groupBy(*SET).agg(F.min("doc_id").alias("doc_id")).withColumn("set_id", F.monotonically_increasing_id())
    firsts = written(firsts.select("set_id", "doc_id", *SET), n_docs)
    reps = written(full.join(firsts, ["doc_id", *SET]).select(*CARRIED, *FLIPS, "mins").dropDuplicates(["set_id"]), n_docs)

    def moved(rows: DataFrame, of_trees: int, levels: int, n: int | None = None) -> DataFrame:
        return _shared(written(rows.mapInArrow(lambda it: _branch(it, of_trees, levels), NODES), n))

    def linked(pairs: DataFrame, n: int | None = None) -> DataFrame:
        return _verified(pairs, firsts, docs, size, percent, n)

    def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
        known = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return written(components(known.unionAll(links), "a", "b", n_docs), n_docs)

    # a set has one pair with the most similar one
    classes = written(components(linked(_with_smallest(moved(reps, 1, 2), percent), n_docs), "a", "b", n_docs), n_docs)
    nodes = moved(reps, trees, 2)
    classes = merged(classes, linked(_with_largest(_grouped(nodes, classes), nodes.count(), percent), n_docs))
    across = []
    for _ in range(2, depth):
        held = nodes.count()
        rows = written(_grouped(nodes, classes), held)
        across.append(_across(rows.where(F.col("n") <= SMALL), percent))
        large = rows.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        # a set meets its minwise values once, with the list of its nodes
        of_set = large.groupBy("set_id").agg(F.collect_list("node").alias("nodes"))
        nodes = moved(of_set.join(reps, "set_id"), trees, 1, held)
    else:  # what stays large
        classes = merged(classes, linked(reduce(DataFrame.unionAll, across).distinct()))
        across = [_across(written(_grouped(nodes, classes), nodes.count()), percent)]
    classes = merged(classes, linked(reduce(DataFrame.unionAll, across).distinct()))

    component = F.coalesce("component", "set_id")
    of_set = written(firsts.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", component), n_docs)
    names = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = of_set.drop("doc_id", "set_id").join(names, "component")
    told = full.select("doc_id", *SET).join(of_set, SET).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionAll(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
