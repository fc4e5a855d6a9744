"""Near-duplicate detection with SetSketch registers.

A text's set is that of its distinct shingles of words (A-Z lower-cased), as 64-bit hashes. Register i of its sketch is the
truncated logarithm, to a base near 1, of the smallest of exponentially distributed hashes of the set: registers of a union are the larger of
both, and equal ones are the likelier the more alike two sets are. Bands of ROWS registers put alike sets into common buckets.

Work is on distinct sets: texts with equal sets are one node, and buckets with the same members are one bucket. A bucket's pairs are
not listed. First every node is verified against one hub: of the members that meet most others, one a bucket, that which is likeliest most alike
by the joint likelihood of how many registers are larger, smaller and equal, given the sizes of both sets. What links is one component. Buckets that
still hold several components are gone through whole, on full sets by integer counts: whatever links two components there
is found, and one link a merge is returned. Estimates choose what is tried first and rule out nothing, so a link is lost only where no band agrees: about 1 in
4 million at a similarity of 0.85 and 1 in 90,000 at 0.8, of links that no other path replaces.

Null and empty text, and text without words, has the empty set, is its own component and is kept. Texts with fewer words than
a shingle have their whole word sequence as one. Rows with equal doc_id are rows of their own with the component's smallest doc_id.
A null doc_id is a row like others, which links what it is like, and whose component_id is the smallest that is known, or null. Extra columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import forgotten, small_batches, written
from .components import components

#: Registers of a sketch; rows of a band and bands; the base, the rate and the limit of the registers.
REGISTERS, ROWS, BANDS = 48, 3, 16
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Members that share a copy of their hub; bytes of text that are compared at once, half of them a side where a bucket holds more.
SHARE, CELL = 512, 4 << 20
_ODD = B.mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts laid end to end, and the n + 1 offsets into them."""
    data = B.lowered(data)
    starts, ends, first = B.words(data, offsets)
    h = B.digests(data, starts, ends)
    n = np.diff(first)
    joined = h.copy()
    for k in range(1, width):
        moved = np.zeros_like(h)
        moved[: len(h) - k] = h[k:]
        joined = joined * np.uint64(0x9E3779B97F4A7C55) + moved
    joined = B.mixed(joined)
    sets = []
    for i, m in enumerate(n.tolist()):
        a = first[i]
        if m >= width:
            sets.append(np.unique(joined[a : a + m - width + 1]))
        elif m:
            whole = np.uint64(m)
            for x in h[a : a + m]:
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C55 + int(x)) & (2**64 - 1))
            sets.append(B.mixed(np.array([whole])))
        else:
            sets.append(h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sketches of sets, one row each; those of empty sets are 0."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        first = offsets[full]
        for i in range(REGISTERS):
            least = np.minimum.reduceat(hashes * _ODD[i], first)
            x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
            out[full, i] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, LIMIT + 1)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimated(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of most likelihood, given how many registers of a are above and below b's, and the sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    equal = REGISTERS - above - below

    def likelihood(j: np.ndarray) -> np.ndarray:
        pa_, pb = np.maximum(p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(p(np.maximum(v - u * j, 0)), 1e-12)
        return above * np.log(pa_) + below * np.log(pb) + equal * np.log(np.maximum(1 - pa_ - pb, 1e-12))

    for _ in range(30):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, s1, s2, sketch) of every row: a hash of the text, the set's size, two hashes of it, its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in B.pieces(whole, 2):
                hashes, offsets = shingle_sets(*B.laid_out(b.column(2)), width)
                n = np.diff(offsets)
                sums = [np.append(np.uint64(0), np.cumsum(x)) for x in (hashes, B.mixed(hashes ^ np.uint64(0xABCDEF)))]
                s1, s2 = ((x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in sums)
                raw = registers(hashes, offsets).tobytes()
                sketch = pa.array([raw[i * 2 * REGISTERS : (i + 1) * 2 * REGISTERS] for i in range(len(b))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(s1), pa.array(s2), sketch], ["doc_id", "text_key", "n", "s1", "s2", "sketch"])
        B.give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n long, s1 long, s2 long, sketch binary")


def likeliest(stars: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): of each node's hubs b the one that is likeliest most alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(b), -1) for c in (b.column(4), b.column(5)))
                j = estimated((x > y).sum(1), (x < y).sum(1), *(b.column(i).to_numpy().astype(float) for i in (2, 3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(j, 3))], ["a", "b", "j"])

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    pairs = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long, j double")
    return pairs.groupBy("a").agg(F.max(F.struct("j", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def _sorted_rows(batches: Iterator[pa.RecordBatch], width: int, text: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(piece, row, set) of every row, in order."""
    for whole in batches:
        for b in B.pieces(whole, text):
            hashes, offsets = shingle_sets(*B.laid_out(b.column(text)), width)
            for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                yield b, i, hashes[x:y]


def verified(stars: DataFrame, width: int, part: int) -> DataFrame:
    """The links (a, b) of rows (hub, copy, side, node, text): in each copy of a hub its own row has side 0, its members' have 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, at, cols = None, np.zeros(0, np.uint64), None, None
        found: list[tuple[int, int]] = []
        for b, i, members in _sorted_rows(batches, width, 4):
            if b is not at:
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
                    found = []
                at, cols = b, [b.column(c).to_pylist() for c in (0, 2, 3)]
            if not cols[1][i]:
                hub, own = cols[0][i], members.copy()
            elif cols[0][i] == hub and len(own):
                place = np.minimum(np.searchsorted(own, members), len(own) - 1)
                both = int((own[place] == members).sum())
                if 100 * both >= part * (len(own) + len(members) - both):
                    found.append((cols[2][i], hub))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
        B.give_back()

    return stars.select("hub", "copy", "side", "node", "text").repartition("hub", "copy").sortWithinPartitions("hub", "copy", "side").mapInArrow(run, "a long, b long")


def merges(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, part: int) -> list[tuple[int, int]]:
    """Places (i, j) of links between members of different labels, one a merge: together they join whatever links join. Members of side 0 and 1 meet each
    other only, those of side 2 all."""
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(n)), n)[order]
    new = np.append(True, every[order][1:] != every[order][:-1])
    term = np.empty(len(every), np.int64)
    term[order] = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(every))
    length, offsets = np.diff(first), np.append(0, np.cumsum(n))
    names, comp = np.unique(label, return_inverse=True)
    size = np.bincount(comp)
    out = []
    for x in np.argsort(size[comp], kind="stable").tolist():
        if len(size) - (size == 0).sum() == 1:
            break
        if comp[x] == size.argmax():
            continue  # who is outside the largest one meets it from there
        terms = term[offsets[x] : offsets[x + 1]]
        terms = terms[length[terms] > 1]
        both = np.bincount(owner[B.expanded(first[terms], length[terms])], minlength=len(n))
        met = (100 * both >= part * (n[x] + n - both)) & (comp != comp[x])
        if side[x] != 2:
            met &= side != side[x]
        for y in np.flatnonzero(met).tolist():
            a, b = comp[x], comp[y]
            if a != b:
                out.append((x, y))
                a, b = (a, b) if size[a] >= size[b] else (b, a)
                comp[comp == b] = a
                size[a] += size[b]
                size[b] = 0
    return out


def crossed(cells: DataFrame, width: int, part: int) -> DataFrame:
    """Links (a, b) that join components inside the cells of rows (key, i, j, side, node, label, text), one a merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        cell, at, cols = None, None, None

        def links() -> list[tuple[int, int]]:
            if len({h[1] for h in held}) < 2:
                return []
            node, label, side, sets = zip(*held)
            return [(node[x], node[y]) for x, y in merges(list(sets), np.array(label), np.array(side), part)]

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

        found: list[tuple[int, int]] = []
        for b, k, members in _sorted_rows(batches, width, 6):
            if b is not at:
                if found:
                    yield rows(found)
                    found = []
                at, cols = b, [b.column(c).to_pylist() for c in range(6)]
            key, i, j, side, node, label = (c[k] for c in cols)
            if (key, i, j) != cell:
                found += links()
                cell, held = (key, i, j), []
            held.append((node, label, side, members.copy()))
        found += links()
        if found:
            yield rows(found)
        B.give_back()

    return cells.select("key", "i", "j", "side", "node", "label", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _cells(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """The members (key, node, label) of buckets with their texts, in cells of about CELL bytes: a bucket of k halves of a cell has a cell for every two of them."""
    own = texts.select("node", "bytes")
    blocks = F.ceil(2 * F.sum("bytes") / CELL).cast("int")
    size = mixed.join(own, "node").groupBy("key").agg(F.when(F.sum("bytes") <= CELL, 1).otherwise(blocks).alias("blocks"))
    size = written(size, "dup-cells")
    dealt = mixed.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(F.col("block") == o, 2).when(F.col("block") < o, 0).otherwise(1).alias("side"))
    out = dealt.withColumn("cell", F.explode(F.transform(others, pair))).select("key", "cell.i", "cell.j", "cell.side", "node", "label")
    return out.join(texts.select("node", "text"), "node")


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) after more links (a, b) between its nodes or nodes that it lacks, which are their own label."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    top = components(edges.distinct()).select(F.col("node").alias("label"), F.col("label").alias("top"))
    known = label.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = top.join(label.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return known.unionByName(fresh)


def grouped(docs: DataFrame, width: int = 3, part: int = 85) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, label, component_id of every row. Rows of one component have one label, rows without words none."""
    small_batches(docs.sparkSession)
    rows = written(sketches(docs, width), "dup-sketches")
    node = F.xxhash64("n", "s1", "s2").alias("node")
    same = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("text_key", "doc_id")).alias("at"), F.min("sketch").alias("sketch"))
    same = written(same.select(node, "n", "doc_id", F.col("at.text_key").alias("text_key"), F.col("at.doc_id").alias("text_id"), "sketch"), "dup-nodes")

    key = lambda i: F.xxhash64(F.lit(i), F.substring("sketch", 2 * ROWS * i + 1, 2 * ROWS))
    banded = same.select("node", F.explode(F.array(*[key(i) for i in range(BANDS)])).alias("key"))
    # Joins by bucket or node have one row a key on one side, so that adaptive execution can split a hot key's rows on the other.
    # Buckets whose members' hashes have equal sums (by exclusive or) hold the same members: one of them is enough.
    prints = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    size = banded.groupBy("key").agg(F.count("*").alias("size"), *prints).where("size > 1").groupBy("size", "x0", "x1").agg(F.min("key").alias("key")).select("key", "size")
    size = written(size, "dup-buckets")
    members = written(banded.join(size, "key"), "dup-members")
    # The hub of a bucket is the member that meets most others over all its buckets: most likely the text that the others are copies of.
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    best = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    hubs = written(best.select("key", F.col("hub.node").alias("hub")), "dup-hubs")
    stars = members.select("node", "key").join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = written(likeliest(stars, same), "dup-first")

    # Texts of what shares a bucket, one a node.
    copies = first.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies"))
    copies = written(copies, "dup-copies")
    wanted = members.select("node").distinct().join(same.select("node", "text_key", "text_id"), "node")
    wanted = wanted.join(first.join(copies, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy")), "node", "left")
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = text.join(wanted, (text["text_key"] == wanted["text_key"]) & text["doc_id"].eqNullSafe(wanted["text_id"])).select("node", "hub", "copy", "text").dropDuplicates(["node"])
    texts = written(texts.withColumn("bytes", F.octet_length("text").cast("long")), "dup-texts")

    own = copies.join(texts, F.col("b") == F.col("node")).select("node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "text")
    met = texts.where("hub is not null").select("hub", "copy", F.lit(1).alias("side"), "node", "text").unionByName(own.select(F.col("node").alias("hub"), "copy", F.lit(0).alias("side"), "node", "text"))
    label = written(components(written(verified(met, width, part), "dup-links")), "dup-labels")

    mixed = members.select("node", "key").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = mixed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    several = written(several, "dup-mixed")
    mixed = written(mixed.select("key", "node", "label").join(several, "key"), "dup-apart")
    more = written(crossed(_cells(mixed, texts), width, part), "dup-more")
    forgotten(members, hubs, first, mixed, several, size)
    label = written(relabelled(label, more), "dup-labels")

    known = same.join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written(known.join(smallest, "label").select("node", "label", "component_id"), "dup-names")
    forgotten(texts, copies, more)
    plain = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, node).alias("node"))
    full = plain.where("node is not null").join(named, "node").select("doc_id", "text_key", "n_shingles", "label", "component_id")
    empty = plain.where("node is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame, width: int = 3, part: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links are 100 * intersection >= part * union."""
    return grouped(docs, width, part).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, part: int = 80) -> DataFrame:
    """The rows of docs of which one stays: of each component one with the smallest doc_id, null last, and all rows without words."""
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keys = [F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id")]
    found = grouped(docs.where(some).select("doc_id", "text"), width, part)
    kept = found.select("label", *keys, F.col("text_key").alias("__key")).groupBy("label").agg(F.min(F.struct("__null", "__id", "__key")).alias("k")).select("k.*")
    # Rows that agree in doc_id and text are one before they are shuffled; the join needs no other exchange than theirs.
    own = docs.where(some).select("*", *keys, F.xxhash64("text").alias("__key")).dropDuplicates(["__null", "__id", "__key"])
    mine = own.join(kept, ["__null", "__id", "__key"], "left_semi").select(*docs.columns)
    return mine.unionByName(docs.where(~some))
