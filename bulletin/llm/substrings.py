"""Exact removal of byte strings that also start in a document with a smaller doc_id, by suffix arrays.

A window is LENGTH bytes. Every window has an anchor: the first of its SEED-byte strings whose hash is smallest. Equal windows have equal anchors at
equal offsets, so windows only meet those with the same anchor. Consecutive windows with one anchor are a run, about 17 windows.

1. Texts that occur whole under a smaller doc_id are covered whole and take no further part.
2. Texts are dealt into blocks, one written table that is bucketed by block, so that later passes don't shuffle text. Each block sends the distinct
   hashes of its anchors; those found in more than one document are shared.
3. Each block sends the bytes of its distinct runs at shared anchors, with the smallest and largest doc_id that have them.
4. Runs at an anchor are taken apart into four ranges of offsets. All windows of a range hold a common core, so runs can only share windows when their
   cores are equal. The runs of each core become one string each (left bytes, the core as one symbol, right bytes); a suffix array over them, built by
   linear-time grouping, brings equal windows together, and each class of equal windows has its smallest doc_id.
5. Blocks get back, for each run, the windows whose smallest doc_id is below the run's own documents', and cover their bytes.

A block sends each distinct run once, whatever the number of its documents that have it, so a passage in a third of all documents is one run a block. What
grows with the documents at one anchor are runs that differ: those at the edges of a passage, at its two outermost anchors.

Strings whose hashes agree are compared byte by byte. Null text is empty. Texts shorter than LENGTH lose nothing. Rows with equal doc_id are one document: they keep
what only they share. Rows with a null doc_id are compared with none, take no part and lose nothing. Extra columns are not read. An empty table gives no rows. Texts of any length are taken whole, in overlapping parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import dropped, forgotten, hot_join, noted, shared_dir, small_batches, written
from .suffixes import equal_windows

LENGTH, SEED = 50, 16
#: The largest offset of an anchor in its window, and the ranges of offsets whose windows share a core.
DEEPEST = LENGTH - SEED
RANGES = tuple((a, min(a + 8, DEEPEST)) for a in range(0, DEEPEST + 1, 9))
#: Bytes of text of a block and of an anchor partition, on average; bytes laid out at once; bytes of runs that are settled at once, at least one anchor's;
#: symbols of a suffix array, at least one core's strings.
BLOCK, PART, LAID, SETTLED, SYMBOLS = 1 << 20, 1 << 20, 1 << 17, 1 << 18, 20_000
_AT = np.uint64((1 << 24) - 1)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, first and last window start, anchor position, anchor hash of every run; data is below 2 ** 24 bytes."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    sums = B.prefix_sums(data)
    hashes = B.mixed((sums[SEED:] - sums[:-SEED]) * B.powers(n + 1, B._INVERSE)[: n - SEED + 1])
    least = (hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64)
    width, step = DEEPEST + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    at = (least & _AT).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = starts[np.append(first[1:], len(starts)) - 1] if len(starts) else starts
    return doc[starts[first]], starts[first], last, at[first], hashes[at[first]]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """As :func:`_runs`, for any number of bytes: whole texts are taken a few at a time, long ones in parts that overlap by a window less one byte."""
    parts: list[list[tuple[int, int, int]]] = [[]]
    held = 0
    for d in range(len(offsets) - 1):
        a, b = int(offsets[d]), int(offsets[d + 1])
        while b - a >= LENGTH:
            end = min(b, a + LAID)
            if held + end - a > 2 * LAID:
                parts.append([])
                held = 0
            parts[-1].append((d, a, end))
            held += end - a
            if end == b:
                break
            a = end - LENGTH + 1
    out = []
    for part in parts:
        if part:
            ids, begin = np.array([p[0] for p in part]), np.array([p[1] for p in part])
            sizes = np.array([p[2] - p[1] for p in part])
            local = np.append(0, np.cumsum(sizes))
            doc, first, last, at, h = _runs(np.concatenate([data[a:b] for _, a, b in part]), local)
            shift = (begin - local[:-1])[doc]
            out.append((ids[doc], first + shift, last + shift, at + shift, h))
    if not out:
        return _runs(data[:0], np.zeros(1, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


class _Block:
    """The texts of a block and their runs, laid out the same way in every pass."""

    def __init__(self, table: pa.Table, notes: pa.Table):
        B.give_back()  # what the block before this one has held
        order = np.lexsort((table["salt"].to_numpy(), table["doc_id"].to_numpy()))
        self.table = table = table.take(pa.array(order))
        self.ids = table["doc_id"].to_numpy()
        self.data, self.offsets = B.laid_out(table["text"])
        copies = [x for row in notes["copies"].to_pylist() if row for x in row] if len(notes) else []
        self.copy = np.isin(table["salt"].to_numpy(), np.array(copies, np.int64))
        out = np.flatnonzero(self.copy)
        doc, first, last, at, h = runs(self.data, self.offsets)
        some = ~np.isin(doc, out)
        self.doc, self.first, self.last, self.at, self.hash = doc[some], first[some], last[some], at[some], h[some]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, which are in several documents, and each run's place among them."""
        anchors, of = np.unique(self.hash, return_inverse=True)
        low, high = np.full(len(anchors), 2**63 - 1), np.full(len(anchors), -(2**63))
        np.minimum.at(low, of, self.ids[self.doc])
        np.maximum.at(high, of, self.ids[self.doc])
        return anchors, low < high, of

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The first run of each distinct run, and each run's class."""
        seed, size, sums = 0, self.last + LENGTH - self.first, B.prefix_sums(self.data)
        while True:  # with another hash, should different runs agree in one
            whole = _hashed(self.data, sums, self.first, self.last + LENGTH, seed)
            key = B.mixed(whole + self.hash * np.uint64(0x9E3779B97F4A7C55) + (self.at - self.first).astype(np.uint64))
            _, first, of = np.unique(key, return_index=True, return_inverse=True)
            twin = np.flatnonzero(first[of] != np.arange(len(of)))
            like = first[of[twin]]
            if (size[twin] == size[like]).all() and B.agree(self.data, self.first[twin], self.first[like], size[twin]):
                return first, of
            seed += 1


def _hashed(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A cheap hash of each range at first, and a better one for each further seed: whose bytes agree is compared anyway."""
    return B.digests(data, starts, ends, seed) if seed else B.range_hashes(sums, starts, ends)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(parts_of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of each part in an ascending array."""
    new = np.flatnonzero(np.append(True, parts_of[1:] != parts_of[:-1])) if len(parts_of) else np.zeros(0, np.int64)
    for a, b in zip(new.tolist(), np.append(new[1:], len(parts_of)).tolist()):
        yield int(parts_of[a]), a, b


def _smallest(anchor: np.ndarray, data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, window start, smallest doc_id) of every window of the runs; at, first, last are positions in data, low the runs' smallest doc_id."""
    found, sums = [], B.prefix_sums(data)
    for a, b in RANGES:
        lo, hi = np.maximum(a, at - last), np.minimum(b, at - first)
        of = np.flatnonzero(hi >= lo)
        if not len(of):
            continue
        lo, hi, mid = lo[of], hi[of], at[of]
        seed = 0
        while True:  # with another hash, should different cores or strings agree in one
            core = B.mixed(_hashed(data, sums, mid - a, mid - b + LENGTH, seed) + anchor[of] * np.uint64(0x9E3779B97F4A7C55))
            whole = B.mixed(_hashed(data, sums, mid - hi, mid - lo + LENGTH, seed) + core * np.uint64(0xC2B2AE3D27D4EB4F) + (64 * lo + hi).astype(np.uint64))
            order = np.lexsort((whole, core))
            new_core = np.append(True, core[order][1:] != core[order][:-1])
            new_text = new_core | np.append(True, whole[order][1:] != whole[order][:-1])
            x, y = order[1:], order[:-1]
            same, twin = ~new_core[1:], ~new_text[1:]
            sizes = hi - lo + LENGTH
            if (
                B.agree(data, (mid - a)[x[same]], (mid - a)[y[same]], np.full(int(same.sum()), a - b + LENGTH))
                and (sizes[x[twin]] == sizes[y[twin]]).all()
                and B.agree(data, (mid - hi)[x[twin]], (mid - hi)[y[twin]], sizes[x[twin]])
            ):
                break
            seed += 1
        text_of = np.empty(len(of), np.int64)
        text_of[order] = np.cumsum(new_text) - 1
        one = order[new_text]
        core_of = (np.cumsum(new_core) - 1)[new_text]
        least = np.full(len(one), 2**63 - 1)
        np.minimum.at(least, text_of, low[of])
        # Windows of the distinct strings, from the first start on; those of strings alone with their core keep the string's smallest doc_id.
        lo1, hi1, mid1 = lo[one], hi[one], mid[one]
        n = hi1 - lo1 + 1
        base = np.append(0, np.cumsum(n))
        smallest = np.repeat(least, n)
        several = np.bincount(core_of)[core_of] > 1
        pick = np.flatnonzero(several)
        if len(pick):
            length = (hi1 - a + 1 + b - lo1 + 1)[pick]
            upto, begin = np.cumsum(length), 0
            while begin < len(pick):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SYMBOLS, "right")))
                while end < len(pick) and core_of[pick[end]] == core_of[pick[end - 1]]:
                    end += 1
                some = pick[begin:end]
                left, size = hi1[some] - a, length[begin:end]
                head = np.append(0, np.cumsum(size))[:-1]
                symbols = np.ones(int(size.sum()), np.int64)
                to, frm = B.expanded(head, left), B.expanded(mid1[some] - hi1[some], left)
                symbols[to] = data[frm].astype(np.int64) + 2
                symbols[head + left] = 300 + core_of[some] - core_of[some[0]]
                right = b - lo1[some]
                to, frm = B.expanded(head + left + 1, right), B.expanded(mid1[some] - b + LENGTH, right)
                symbols[to] = data[frm].astype(np.int64) + 2
                starts = B.expanded(head, n[some])
                classes = equal_windows(symbols, starts, b - a + 1)
                best = np.full(int(classes.max()) + 1, 2**63 - 1)
                where = B.expanded(base[some], n[some])
                np.minimum.at(best, classes, smallest[where])
                smallest[where] = best[classes]
                begin = end
        count = n[text_of]
        run = np.repeat(of, count)
        found.append((run, B.expanded(mid - hi, count), smallest[B.expanded(base[text_of], count)]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _by_anchor(hashes: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The runs in lots of about SETTLED bytes, all those at one anchor in the same: runs at different anchors share no window."""
    order = np.argsort(hashes, kind="stable")
    upto, ends = np.cumsum(size[order]), np.flatnonzero(np.append(hashes[order][1:] != hashes[order][:-1], True)) + 1
    begin = 0
    while begin < len(order):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SETTLED, "right"))
        end = int(ends[np.searchsorted(ends, max(end, begin + 1))])
        yield order[begin:end]
        begin = end


NOTES = "block int, part int, bits binary, run binary, at binary, n binary, low binary, copies array<long>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the other bytes) of every document, and the columns to carry."""
    spark = docs.sparkSession
    small_batches(spark)
    lone = docs.where("doc_id is null").select("doc_id", F.col("text").cast("binary").alias("kept"), *[F.col(c).alias(f"with_{c}") for c in carry])
    lone = lone.withColumn("kept", F.coalesce("kept", F.lit(b"")))
    size_of = F.length("kept").cast("long")
    lone = lone.select("doc_id", size_of.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept", *[f"with_{c}" for c in carry])
    docs = docs.where("doc_id is not null")
    text = F.coalesce(F.col("text"), F.lit(""))
    salt = F.xxhash64("doc_id", F.sha2(text, 256)).alias("salt")  # a doc_id may have several texts
    facts = written(docs.select("doc_id", F.octet_length(text).cast("long").alias("n"), F.sha2(text, 256).alias("key"), salt), "sub-facts")
    totals = facts.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    size = totals["n"] or 0
    blocks, parts = max(32, -(-size // BLOCK)), max(32, -(-size // PART))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (16 * BLOCK)))
    block = F.pmod(F.xxhash64("doc_id", F.sha2(text, 256)), F.lit(blocks)).cast("int").alias("block")
    block_of = F.pmod("salt", F.lit(blocks)).cast("int").alias("block")

    same = written(facts.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "sub-same")
    copy = hot_join(facts.select("doc_id", "key", "salt"), same, "key", "copies", totals["rows"], "inner").where("doc_id > first")
    copies = written(copy.groupBy(block_of).agg(F.collect_set("salt").alias("copies")), "sub-copies")  # of one block: bounded by its rows
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    copied = copies.select("block", none("int", "part"), *[none("binary", c) for c in ("bits", "run", "at", "n", "low")], "copies")

    forgotten(facts, same)
    table = f"bulletin_{uuid.uuid4().hex}"
    noted(f"{shared_dir(spark)}/{table}")
    dealt = docs.select(block, "doc_id", salt, text.alias("text"), *[F.col(c).alias(f"with_{c}") for c in carry]).repartition(buckets, "block")
    dealt.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    stored = spark.table(table)
    dropped(spark, f"table:{table}")  # the name only: the table is external, and the relation knows its files and buckets
    texts = stored.groupBy("block")

    def anchors(key: tuple, rows: pa.Table, notes: pa.Table) -> pa.Table:
        b = _Block(rows, notes)
        h, several, _ = b.anchors()
        cuts = list(_cuts(_part(h, parts)))
        return pa.table({"block": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "part": pa.array([c[0] for c in cuts], pa.int32()), "hashes": pa.array([h[i:j].tobytes() for _, i, j in cuts], pa.binary()), "several": pa.array([np.packbits(several[i:j]).tobytes() for _, i, j in cuts], pa.binary())})

    def shared(data: pa.Table) -> pa.Table:
        B.give_back()
        hashes = [np.frombuffer(x, np.uint64) for x in data["hashes"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(data["several"].to_pylist(), hashes)]
        every = np.sort(np.concatenate(hashes + [h[s] for h, s in zip(hashes, several)]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        bits = [np.packbits(np.isin(h, twice, assume_unique=True)).tobytes() for h in hashes]
        return pa.table({"block": data["block"], "part": data["part"], "bits": pa.array(bits, pa.binary())})

    bits = texts.cogroup(copied.groupBy("block")).applyInArrow(anchors, "block int, part int, hashes binary, several binary").groupBy("part").applyInArrow(shared, "block int, part int, bits binary")
    bits = written(bits, "sub-bits").select("block", "part", "bits", *[none("binary", c) for c in ("run", "at", "n", "low")], none("array<long>", "copies"))

    sent = "part int, block int, run binary, hash binary, low binary, high binary, left binary, n binary, bytes binary"

    def send(key: tuple, rows: pa.Table, notes: pa.Table) -> pa.Table:
        b = _Block(rows, notes)
        h, _, of = b.anchors()
        is_shared = np.zeros(len(h), bool)
        by_part = {p: x for p, x in zip(notes["part"].to_pylist(), notes["bits"].to_pylist()) if x is not None}
        for p, i, j in _cuts(_part(h, parts)):
            is_shared[i:j] = np.unpackbits(np.frombuffer(by_part[p], np.uint8), count=j - i)
        first, cls = b.classes()
        low, high = np.full(len(first), 2**63 - 1), np.full(len(first), -(2**63))
        np.minimum.at(low, cls, b.ids[b.doc])
        np.maximum.at(high, cls, b.ids[b.doc])
        some = np.flatnonzero(is_shared[of[first]]) if len(first) else np.zeros(0, np.int64)
        run = first[some]
        order = np.argsort(b.hash[run], kind="stable")
        some, run = some[order], run[order]
        n = b.last[run] - b.first[run] + 1
        size = n + LENGTH - 1
        raw = b.data[B.expanded(b.first[run], size)].tobytes()
        ends = np.append(0, np.cumsum(size))
        cols: list[list] = [[] for _ in range(9)]
        for p, i, j in _cuts(_part(b.hash[run], parts)):
            r = run[i:j]
            row = (p, key[0].as_py(), r.astype(np.int32), b.hash[r], low[some[i:j]], high[some[i:j]], (b.at[r] - b.first[r]).astype(np.uint8), n[i:j].astype(np.uint8))
            for c, x in zip(cols, row):
                c.append(x.tobytes() if isinstance(x, np.ndarray) else x)
            cols[8].append(raw[ends[i] : ends[j]])
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.table({c.split()[0]: pa.array(x, k) for c, x, k in zip(sent.split(", "), cols, kinds)})

    def settle(data: pa.Table) -> pa.Table:
        B.give_back()
        get = lambda c, kind: B.laid_out(data[c])[0].view(kind)
        run, h, low, high, left, n = get("run", np.int32), get("hash", np.uint64), get("low", np.int64), get("high", np.int64), get("left", np.uint8), get("n", np.uint8)
        raw = get("bytes", np.uint8)
        size = n.astype(np.int64) + LENGTH - 1
        first = np.append(0, np.cumsum(size))[:-1]
        block = np.repeat(data["block"].to_numpy(), B.sizes(data["run"]) // 4)
        found: list[tuple[np.ndarray, ...]] = []
        for some in _by_anchor(h, size):
            most, head = size[some], np.append(0, np.cumsum(size[some]))[:-1]
            of, start, least = _smallest(h[some], raw[B.expanded(first[some], most)], head + left[some], head, head + n[some].astype(np.int64) - 1, low[some])
            less = least < high[some][of]
            of, start, least = of[less], start[less] - head[of[less]], least[less]
            if not len(of):
                continue
            order = np.lexsort((start, of))
            of, start, least = of[order], start[order], least[order]
            new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])))
            found.append((some[of[new]], start[new].astype(np.uint8), least[new], np.diff(np.append(new, len(of)))))
        of, start, least, length = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        order = np.argsort(block[of], kind="stable")
        of, start, least, length = of[order], start[order], least[order], length[order]
        cols: list[list] = [[] for _ in range(5)]
        for k, i, j in _cuts(block[of]):
            for c, x in zip(cols, (k, run[of[i:j]].astype(np.int32).tobytes(), start[i:j].astype(np.uint8).tobytes(), length[i:j].astype(np.uint8).tobytes(), least[i:j].tobytes())):
                c.append(x)
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("block", "run", "at", "n", "low"), cols, (pa.int32(), *[pa.binary()] * 4))})

    runs_sent = texts.cogroup(bits.unionByName(copied).groupBy("block")).applyInArrow(send, sent)
    settled = written(runs_sent.groupBy("part").applyInArrow(settle, "block int, run binary, at binary, n binary, low binary"), "sub-settled")
    covers = settled.select("block", none("int", "part"), none("binary", "bits"), "run", "at", "n", "low", none("array<long>", "copies"))

    def cover(key: tuple, rows: pa.Table, notes: pa.Table) -> pa.Table:
        b = _Block(rows, notes)
        edge = np.zeros(len(b.data) + 1, np.int32)
        get = lambda c, kind: np.frombuffer(b"".join(x for x in notes[c].to_pylist() if x is not None), kind) if len(notes) else np.zeros(0, kind)
        run, at, n, low = get("run", np.int32), get("at", np.uint8).astype(np.int64), get("n", np.uint8).astype(np.int64), get("low", np.int64)
        if len(run):
            first, cls = b.classes()
            order = np.argsort(cls, kind="stable")
            begin = np.searchsorted(cls[order], np.arange(len(first) + 1))
            mine = cls[run]
            times = begin[mine + 1] - begin[mine]
            each = order[B.expanded(begin[mine], times)]
            note = np.repeat(np.arange(len(run)), times)
            some = low[note] < b.ids[b.doc[each]]
            each, note = each[some], note[some]
            start = b.first[each] + at[note]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + n[note] - 1 + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        size = np.diff(b.offsets)
        whole = np.flatnonzero(b.copy & (size >= LENGTH))
        gone[B.expanded(b.offsets[:-1][whole], size[whole])] = True
        upto = np.append(0, np.cumsum(gone))
        removed = upto[b.offsets[1:]] - upto[b.offsets[:-1]]
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        heads = b.offsets[:-1][size > 0]
        rise[heads] = gone[heads]
        rises = np.append(0, np.cumsum(rise))
        spans = rises[b.offsets[1:]] - rises[b.offsets[:-1]]
        raw = b.data[~gone].tobytes()
        ends = np.append(0, np.cumsum(size - removed))
        kept = [raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        own = {"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept": pa.array(kept, pa.binary())}
        return pa.table(own | {f"with_{c}": b.table[f"with_{c}"] for c in carry})

    kinds = "".join(f", `with_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return texts.cogroup(covers.unionByName(copied).groupBy("block")).applyInArrow(cover, RESULT + kinds).unionByName(lone)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, in its own columns, with texts of what is kept; a character that lost some of its bytes goes whole, and n_chars follows."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([x.decode("utf-8", "ignore") for x in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts, *b.columns[1:]], ["text", *b.schema.names[1:]])

    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = remove_repeats(docs, others).select("kept", "doc_id", *[f"with_{c}" for c in others])
    kinds = "text string, doc_id long" + "".join(f", `with_{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    out = out.mapInArrow(decode, kinds).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(c if c in ("doc_id", "text", "n_chars") else f"with_{c}").alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
