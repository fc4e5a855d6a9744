"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words without ASCII punctuation around them (A-Z lower-cased), as 64-bit hashes. Learned from are at most
LABELLED labelled training rows. All terms of their texts are in the index. A term weighs (1 + ln of how often it occurs) * idf * s: document
frequencies are counted over all documents, and s is how well the sample's labels tell the term's documents apart, its G statistic over what the
largest of all terms reaches by chance (2 ln of their number), at least FLOOR and at most 1. A term that the sample lacks has no product with any
example and counts in no norm. Examples are unit vectors. For each term the index has its postings, and for each block of examples the largest weight. A
text's block bounds are summed over its terms, blocks are visited from the largest bound on, and the search ends when no bound reaches the k-th cosine,
so the k nearest are exact. They vote with weights that fall with distance, together with a few votes of the base rate of the sample, which calibrates
scores of texts with few or distant neighbours. A text without any known term has the base rate itself.

The score reads the text alone: equal texts have equal scores. Null text is empty text, which has no terms. A label that is null
is no label; a doc_id that is labelled more than once is toxic if any of its labels says so; of several texts of a labelled doc_id the
smallest is learned from. Ties of the cosine go to the smaller doc_id. Without labelled rows every score is 0. Repeated rows are scored each. Extra
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import small_batches, written

#: Labelled rows that are learned from: the bound of what is fitted, collected and broadcast.
LABELLED = 4096
#: Neighbours that vote, votes of the base rate, examples in a block, the least factor of a term, terms that are few.
NEAREST, PRIOR, BLOCK, FLOOR, FEW = 15, 0.5, 128, 0.02, 8
#: Bytes of text whose terms are found at once: each byte takes dozens of bytes meanwhile.
PIECE = 1 << 19
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of texts laid end to end: hashes, and the number of the text of each."""
    data = B.lowered(data)
    starts, ends, first = B.words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(starts):
        at, plain = np.arange(len(data)), ~_PUNCTUATION[data]
        ends = np.maximum(starts, np.maximum.accumulate(np.where(plain, at, -1))[ends - 1] + 1)
        starts = np.minimum(ends, np.minimum.accumulate(np.where(plain, at, len(data))[::-1])[::-1][starts])
        some = ends > starts
        starts, ends, doc = starts[some], ends[some], doc[some]
    return B.digests(data, starts, ends), doc


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training rows that are learned from: those with the smallest hashes, at most LABELLED."""
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    known = labels.where("doc_id is not null and toxic is not null").where(train).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "tox-sample")


def counted(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, text number, term, times) of the distinct terms of each text of a piece, by text."""
    for b in B.pieces(batch, column, PIECE):
        hashes, doc = term_hashes(*B.laid_out(b.column(column)))
        ends = np.searchsorted(doc, np.arange(len(b) + 1)).tolist()
        for i, j in zip(ends[:-1], ends[1:]):
            hashes[i:j].sort()
        new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        yield b, doc[new], hashes[new], np.diff(np.append(new, len(hashes))).astype(np.int32)


def examples(docs: DataFrame, chosen: DataFrame) -> tuple[list[int], np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """doc_id, label, terms and counts of the sample's texts: at most LABELLED sparse vectors come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.begun("toxicity")
        for whole in batches:
            for b, doc, term, n in counted(whole, 2):
                ends = np.searchsorted(doc, np.arange(len(b) + 1))
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cut(term), cut(n)], ["doc_id", "toxic", "terms", "counts"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, toxic int, terms binary, counts binary").toArrow().sort_by("doc_id")
    get = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in found[c]]
    return found["doc_id"].to_pylist(), found["toxic"].to_numpy().astype(np.float64), get("terms", np.uint64), get("counts", np.int32)


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term of the vocabulary (sorted) is, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.begun("toxicity")
        terms = shared.value
        total = np.zeros(len(terms) + 1, np.int64)
        for whole in batches:
            for b, _, term, _ in counted(whole, 0):
                total[-1] += len(b)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                    total += np.bincount(at[terms[at] == term], minlength=len(terms) + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])
        B.give_back()

    out = np.zeros(len(vocabulary) + 1, np.int64)
    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term of the sample
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def told_apart(bad: np.ndarray, good: np.ndarray, p: float, q: float) -> np.ndarray:
    """The factor s of terms found in `bad` of p toxic and `good` of q other examples."""
    if not p or not q or not len(bad):
        return np.full(len(bad), FLOOR)
    part = lambda x, m, rows: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) * (p + q) / np.maximum(m * rows, 1e-9)), 0.0)
    some, none = bad + good, p + q - bad - good
    g = 2 * (part(bad, some, p) + part(good, some, q) + part(p - bad, none, p) + part(q - good, none, q))
    return np.clip(g / (2 * math.log(max(len(bad), 2))), FLOOR, 1.0)


class Index:
    """Unit vectors of the examples by term, and each term's largest weight by block of examples."""

    def __init__(self, ids: list[int], toxic: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray):
        """Examples by rising id, with at least one term each; vocabulary sorted; idf: of each of its terms, with its factor."""
        self.ids, self.toxic, self.vocabulary, self.idf = np.array(ids, np.int64), np.asarray(toxic, np.float64), vocabulary, idf
        rows = [self.unit(np.searchsorted(vocabulary, t), n) for t, n in zip(terms, counts)]
        doc = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        term = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        by_term = np.lexsort((doc, term))
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
        block = self.doc // BLOCK
        term = term[by_term]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.runs = np.flatnonzero(new)
        self.run_block, self.run_most = block[self.runs], np.maximum.reduceat(self.weight, self.runs) if len(self.runs) else np.zeros(0)
        self.run_length = np.diff(np.append(self.runs, len(term)))
        self.term_runs = np.searchsorted(term[self.runs], np.arange(len(idf) + 1))
        self.blocks = -(-len(rows) // BLOCK)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(counts)) * self.idf[terms]
        return terms, weight / np.sqrt((weight**2).sum())

    def known(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the terms that the examples have, as positions in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        some = self.vocabulary[at] == terms
        return at[some], counts[some]

    def score(self, terms: np.ndarray, counts: np.ndarray, rate: float) -> tuple[float, list[int]]:
        """The score of a text, and the doc_id of its nearest examples."""
        terms, counts = self.known(terms, counts)
        if not len(terms):
            return rate, []
        at, cosine = self.nearest(terms, counts)
        vote = 1 / (1.05 - np.minimum(np.round(cosine, 12), 1.0))
        return min(1.0, float((vote @ self.toxic[at] + PRIOR * rate) / (vote.sum() + PRIOR))), self.ids[at].tolist()

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a common term, nearest first, ties by doc_id; terms are positions in the vocabulary."""
        terms, weight = self.unit(terms, counts)
        size = len(self.ids)
        if (np.sort(weight)[-FEW:] ** 2).sum() < 0.85:
            # No few terms carry the text, so that every block's bound is far above any cosine: all are visited at once.
            score = self._all(terms, weight)
        else:
            score = self._by_block(terms, weight, k)
        least = np.partition(score, size - k)[size - k] if size > k else 0.0
        at = np.flatnonzero((score > 0) & (score >= least - 1e-9))
        at = at[np.lexsort((at, -np.round(score[at], 12)))[:k]]
        return at, score[at]

    def _all(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The cosine with every example, from whole postings lists laid end to end."""
        first, last = self.first[terms], self.first[terms + 1]
        cuts = [slice(i, j) for i, j in zip(first.tolist(), last.tolist())]
        each = np.concatenate([self.weight[c] for c in cuts])
        each *= np.repeat(weight, last - first)
        return np.bincount(np.concatenate([self.doc[c] for c in cuts]), each, len(self.ids))

    def _by_block(self, terms: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
        """The cosine with every example of the blocks that may hold one of the k nearest; 0 for others."""
        first, last = self.term_runs[terms], self.term_runs[terms + 1]
        runs, mine = B.expanded(first, last - first), np.repeat(weight, last - first)
        of = self.run_block[runs]
        bound = np.bincount(of, mine * self.run_most[runs], self.blocks)
        order = np.argsort(-bound, kind="stable")
        score, least, step = np.zeros(len(self.ids)), 0.0, 0
        while step < len(order) and bound[order[step]] > 0 and bound[order[step]] >= least - 1e-9:
            # The likeliest blocks first, three times as many each time; a small slack keeps rounding from hiding a tie.
            some = np.zeros(self.blocks, bool)
            some[order[step : step + max(2, 3 * step)]] = True
            some &= bound >= least - 1e-9
            part = np.flatnonzero(some[of])
            length = self.run_length[runs[part]]
            post = B.expanded(self.runs[runs[part]], length)
            score += np.bincount(self.doc[post], np.repeat(mine[part], length) * self.weight[post], len(score))
            step += max(2, 3 * step)
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
        return score


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Index, float]:
    """The index over the sample, and the sample's toxic share."""
    ids, toxic, terms, counts = examples(docs, sample(docs, labels))
    vocabulary = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
    df, total = frequencies(docs, vocabulary)
    place = [np.searchsorted(vocabulary, t) for t in terms]
    bad, good = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for p, y in zip(place, toxic):
        (bad if y else good)[p] += 1
    weight = (np.log((1 + total) / (1 + df)) + 1e-3) * told_apart(bad, good, float(toxic.sum()), float((1 - toxic).sum()))
    full = [i for i, t in enumerate(terms) if len(t)]
    index = Index([ids[i] for i in full], toxic[full], [terms[i] for i in full], [counts[i] for i in full], vocabulary, weight)
    return index, float(toxic.mean()) if len(ids) else 0.0


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_id of the nearest examples, nearest first) of every document, and the columns to carry, as with_<name>."""
    small_batches(docs.sparkSession)
    index, rate = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    del index
    B.give_back()
    names = [f"with_{c}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.begun("toxicity")
        own = shared.value
        for whole in batches:
            for b, doc, term, n in counted(whole, 1):
                ends = np.searchsorted(doc, np.arange(len(b) + 1)).tolist()
                scores, evidence = zip(*[own.score(term[i:j], n[i:j], rate) for i, j in zip(ends[:-1], ends[1:])])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), *b.columns[2:]], ["doc_id", "score", "evidence", *names])
        B.give_back()

    kinds = "".join(f", `with_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = docs.select("doc_id", "text", *[F.col(c).alias(f"with_{c}") for c in carry]).mapInArrow(run, "doc_id long, score double, evidence array<long>" + kinds)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", *names)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, in its own columns, whose text is not called toxic."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    return score(docs, labels, others).where("predicted = 0").select(*[F.col(c if c == "doc_id" else f"with_{c}").alias(c) for c in docs.columns])
