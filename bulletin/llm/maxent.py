"""A hashed maximum-entropy language model with a class-factored softmax, over the counts of word pairs.

P(token | context) = (n + k * M) / (m + k), with M = P(group | context) * P(class | group, context) * P(token | class). n counts the pair of the token before and this
one in the training rows, m counts the token before, k is PRIOR * m ** POWER + 1. Groups and classes are two softmaxes over hashed features:
the token before, the tokens two and three before (skips), and the pair of both before; a context token is itself when frequent and else its ending. Classes are
the most frequent tokens, one each, then the most frequent word endings (last three bytes), and a rest. In a class p = (c + 1) / (tokens + distinct tokens + 1),
with one unit kept for tokens never seen. So the probabilities after a context sum to at most 1.

Everything gathered covers all training rows, and tokens and pairs are told apart without a bound on their number: pairs by hashes whose length grows with the
tokens. The weights are of fixed size (ROWS hashed rows), as they are broadcast.

1. Texts become blocks, one written table: of each block the distinct tokens, and every token as a number among them. Nothing is tokenised twice.
2. Each block sends its distinct tokens and pairs with their counts, packed by ranges of the hash; every range is summed and sent back. So what is shuffled are
   a block's distinct keys, a frequent token once a block.
3. Training: the counts of features by class give the first weights. Then one pass over all training documents in ROUNDS rounds, each over those that the hash of
   their doc_id gives it: their gradients at the weights so far are summed over the blocks, and a diagonal Newton step is taken. Neither shares nor sums
   depend on how rows are dealt, so neither does the model, but for rounding.
4. Each block meets its own counts and is scored, numpy batch by numpy batch.

Tokens are compared by 64-bit hashes. Null text is the empty text, which is its end token alone. Repeated rows are rows of their own with equal
results. Null doc_id counts as empty in the fold rule. Without training rows every count is 0, N is 0 and V is 0. Extra columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import small_batches, written

#: Tokens that are contexts of their own; tokens and endings that are classes; classes of a group.
HEAD, TOP, ENDINGS, GROUP = 4096, 48, 95, 12
CLASSES = TOP + ENDINGS + 1
GROUPS = CLASSES // GROUP
#: Weight rows, features of a token, rounds of gradient sums, pseudo-counts of a feature's first weights and of its curvature.
ROWS, FEATURES, ROUNDS, PSEUDO, DAMP = 1 << 12, 4, 2, 20.0, 10.0
#: The weight of the softmax against pairs counted after a token that was seen m times: PRIOR * m ** POWER + 1.
PRIOR, POWER = 4.0, 0.6
#: Bytes of text of a block, tokens that one range of hashes holds on average, tokens that are scored at once.
BLOCK, PART, STEP = 4 << 20, 2 << 20, 1 << 17
#: Bits of a pair's hash over those of the number of tokens: of 2 ** SPARE pairs, less than one shares its hash with another.
SPARE = 16
#: The hash and ending of the end token, which no word has, and what stands before a text's first token.
END, END_ENDING, START = np.uint64(0x5EEDED0C), -1, np.uint64(0x57A27)


def tokens(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings of all tokens, each text closed by its end token, and the n + 1 offsets of the texts."""
    data, offsets = B.laid_out(batch.column(column))
    data = B.lowered(data)
    starts, ends, first = B.words(data, offsets)
    n = len(offsets) - 1
    hashes = B.digests(data, starts, ends)
    endings = data[ends - 1].astype(np.int32) if len(ends) else np.zeros(0, np.int32)
    for back in (2, 3):
        some = ends - starts >= back
        endings[some] |= data[ends[some] - back].astype(np.int32) << (8 * (back - 1))
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    all_hashes, all_endings = np.full(len(starts) + n, END), np.full(len(starts) + n, END_ENDING, np.int32)
    all_hashes[at], all_endings[at] = hashes, endings
    return all_hashes, all_endings, first + np.arange(n + 1)


class Block:
    """Some whole texts as numbers: distinct tokens by rising hash, and each token's place among them."""

    def __init__(self, words: np.ndarray, endings: np.ndarray, at: np.ndarray, ends: np.ndarray, held: np.ndarray, ids: np.ndarray):
        self.words, self.endings, self.at, self.held = words, endings, at, held.astype(bool)
        self.offsets = np.append(0, ends).astype(np.int64)
        self.train = np.repeat(~self.held, np.diff(self.offsets))
        self.round = (B.mixed(ids.view(np.uint64)) % np.uint64(ROUNDS)).astype(np.int64)
        self.before = np.empty(len(at), np.int64)
        self.before[1:] = self.at[:-1]
        self.before[self.offsets[:-1]] = len(words)

    @staticmethod
    def packed(hashes: np.ndarray, endings: np.ndarray) -> tuple[bytes, bytes, bytes]:
        words, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        # Low halves, then what is above them: mostly zeros, which pack well.
        high = (at >> 16).astype(np.uint8 if len(words) <= 1 << 24 else np.uint32).tobytes() if len(words) > 1 << 16 else b""
        return words.tobytes(), endings[first].tobytes(), (at & 0xFFFF).astype(np.uint16).tobytes() + high

    @staticmethod
    def of(row: dict) -> Block:
        words = np.frombuffer(row["words"], np.uint64)
        ends, raw = np.frombuffer(row["ends"], np.int64), row["at"]
        n = int(ends[-1])
        at = np.frombuffer(raw[: 2 * n], np.uint16).astype(np.int64)
        if len(raw) > 2 * n:
            at += np.frombuffer(raw[2 * n :], np.uint8 if len(raw) == 3 * n else np.uint32).astype(np.int64) << 16
        return Block(words, np.frombuffer(row["endings"], np.int32), at, ends, np.frombuffer(row["held"], np.uint8), np.frombuffer(row["ids"], np.int64))

    def counts(self) -> np.ndarray:
        """Of each distinct token, how often it is in training texts."""
        return np.bincount(self.at[self.train], minlength=len(self.words))

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs' hashes, rising, and the place of each token's pair among them."""
        before = B.mixed(np.append(self.words, START))[self.before]
        return np.unique(B.mixed(before + self.words[self.at]) >> np.uint64(64 - bits), return_inverse=True)


SHAPE = "block long, ids binary, nulls binary, held binary, ends binary, words binary, endings binary, at binary, n long, trained long"


def blocks(docs: DataFrame) -> DataFrame:
    """The texts of rows (doc_id, held, text) as blocks, and how many tokens and training tokens each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in B.pieces(whole, 2, BLOCK):
                hashes, endings, offsets = tokens(b, 2)
                held = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                ids = b.column(0).fill_null(0).to_numpy()
                nulls = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                own = Block.packed(hashes, endings)
                trained = int(np.diff(offsets)[held == 0].sum())
                row = (number, ids.tobytes(), nulls.tobytes(), held.tobytes(), offsets[1:].astype(np.int64).tobytes(), *own, len(hashes), trained)
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row))], schema=KINDS)
                number += 1
        B.give_back()

    return docs.mapInArrow(run, SHAPE)


NAMES = [x.split()[0] for x in SHAPE.split(", ")]
KINDS = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in SHAPE.split(", ")])


def rising(keys: np.ndarray) -> bytes:
    """Rising keys as their first one and the steps between them, of 4 bytes where these fit."""
    steps = np.diff(keys)
    small = not len(steps) or int(steps.max()) < 1 << 32
    return keys[:1].tobytes() + (steps.astype(np.uint32) if small else steps).tobytes() + (b"s" if small else b"l")


def risen(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw[8:-1], np.uint32 if raw[-1:] == b"s" else np.uint64)
    return np.cumsum(np.append(np.frombuffer(raw[:8], np.uint64), steps.astype(np.uint64)), dtype=np.uint64)


def narrow(n: np.ndarray) -> bytes:
    """Counts of one byte each; larger ones stand before them with their places."""
    large = np.flatnonzero(n >= 255)
    return np.uint32(len(large)).tobytes() + large.astype(np.uint32).tobytes() + n[large].astype(np.int64).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes()


def widened(raw: bytes) -> np.ndarray:
    large = int(np.frombuffer(raw[:4], np.uint32)[0])
    out = np.frombuffer(raw[4 + 12 * large :], np.uint8).astype(np.int64)
    out[np.frombuffer(raw[4 : 4 + 4 * large], np.uint32)] = np.frombuffer(raw[4 + 4 * large : 4 + 12 * large], np.int64)
    return out


TOTALS = "block long, part int, kind int, totals binary, token long, ending int, c long, v long"
#: What a row of totals is: tokens of a block, pairs of a block, an ending's sums in a range of hashes, a frequent token.
WORD, PAIR, BY_ENDING, FREQUENT = range(4)


def totals(table: DataFrame, parts: int, bits: int) -> DataFrame:
    """Of every block its distinct tokens' and pairs' counts over all training rows, in its own order, by range of hashes; sums by ending; frequent tokens."""
    most = 64 + 4 * HEAD // parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own = Block.of(row)
                pairs, of = own.pairs(bits)
                rows = []
                for kind, width, keys, n in ((WORD, 64, own.words, own.counts()), (PAIR, bits, pairs, np.bincount(of[own.train], minlength=len(pairs)))):
                    part = ((keys >> np.uint64(max(0, width - 32))) * np.uint64(parts) >> np.uint64(min(32, width))).astype(np.int64)
                    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
                    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        rows.append((int(part[i]), row["block"], kind, rising(keys[i:j]), narrow(n[i:j]), own.endings[i:j].tobytes() if kind == WORD else None))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["part", "block", "kind", "keys", "n", "endings"])
        B.give_back()

    def add(data: pa.Table) -> pa.Table:
        out: list[dict] = []
        for kind in (WORD, PAIR):
            rows = [r for r in data.to_pylist() if r["kind"] == kind]
            if not rows:
                continue
            keys = [risen(r["keys"]) for r in rows]
            every, of = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(of, np.concatenate([widened(r["n"]) for r in rows]), len(every)).astype(np.int64)
            ends = np.append(0, np.cumsum([len(k) for k in keys]))
            out += [{"block": r["block"], "part": r["part"], "kind": kind, "totals": narrow(n[of[i:j]])} for r, i, j in zip(rows, ends[:-1], ends[1:])]
            if kind == WORD:
                endings = np.zeros(len(every), np.int32)
                endings[of] = np.concatenate([np.frombuffer(r["endings"], np.int32) for r in rows])
                seen = np.flatnonzero(n)
                name, at = np.unique(endings[seen], return_inverse=True)
                out += [{"kind": BY_ENDING, "ending": e, "c": c, "v": v} for e, c, v in zip(name.tolist(), np.bincount(at, n[seen], len(name)).astype(np.int64).tolist(), np.bincount(at, minlength=len(name)).tolist())]
                top = np.lexsort((every, -n))[:most]
                out += [{"kind": FREQUENT, "token": t, "ending": e, "c": c} for t, e, c in zip(every[top].view(np.int64).tolist(), endings[top].tolist(), n[top].tolist()) if c]
        B.give_back()
        schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in TOTALS.split(", ")])
        return pa.Table.from_pylist(out, schema=schema)

    sent = table.mapInArrow(send, "part int, block long, kind int, keys binary, n binary, endings binary")
    return sent.groupBy("part").applyInArrow(add, TOTALS)


class Vocabulary:
    """The bounded part of the counts: frequent tokens, and the classes with their sums."""

    def __init__(self, head: list[tuple[int, int, int]], by_ending: dict[int, tuple[int, int]], rest: tuple[int, int]):
        """head: (token, ending, count) by falling count; by_ending: tokens and distinct tokens of the chosen endings, without those of the head's first TOP; rest: of the others."""
        tops = [(c, 1) for _, _, c in head[:TOP]] + [(0, 0)] * max(0, TOP - len(head))
        others = sorted(by_ending.items())
        sums = np.array([*tops, *[x for _, x in others], *[(0, 0)] * (ENDINGS - len(others)), rest], float)
        place = np.empty(CLASSES, np.int64)
        place[np.argsort(-sums[:, 0], kind="stable")] = np.arange(CLASSES)
        self.endings, self.ending_place = np.array([e for e, _ in others], np.int64), place[TOP : TOP + len(others)]
        self.rest = place[-1]
        self.sums = np.empty_like(sums)
        self.sums[place] = sums
        self.log_z = np.log(self.sums.sum(1) + 1.0)
        hashes = np.array([t for t, _, _ in head], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.head, self.rank = hashes[order], order
        self.top_place = place[:TOP]

    def classes(self, words: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token and what it is as a context."""
        out = np.full(len(words), self.rest)
        if len(self.endings):
            at = np.minimum(np.searchsorted(self.endings, endings), len(self.endings) - 1)
            out = np.where(self.endings[at] == endings, self.ending_place[at], out)
        context = HEAD + (endings.astype(np.int64) * 40503 & 0xFFF)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
            rank = np.where(self.head[at] == words, self.rank[at], HEAD)
            context = np.where(rank < HEAD, rank, context)
            out = np.where(rank < TOP, self.top_place[np.minimum(rank, TOP - 1)], out)
        return out, context

    def features(self, block: Block, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The class of every token of a block, or of those at some places, and its FEATURES weight rows."""
        own, context = self.classes(block.words, block.endings)
        before, starts = [context.astype(np.uint64)[block.at]], block.offsets[:-1]
        for _ in range(3):
            moved = np.empty_like(before[0])
            moved[1:] = before[-1][:-1]
            moved[starts] = 2 * HEAD  # nothing, from a text's start on
            before.append(moved)
        one, two, three = before[1:] if at is None else [x[at] for x in before[1:]]
        keys = (one * _MIX[0], two * _MIX[1], three * _MIX[2], (one * _MIX[3]) ^ (two * _MIX[4] >> np.uint64(7)))
        return own[block.at if at is None else block.at[at]], np.stack([(k * _MIX[5] >> _SHIFT).astype(np.int64) for k in keys])


#: Odd numbers that spread contexts over the weight rows, by feature.
_MIX = B.mixed(np.arange(1, 7, dtype=np.uint64)) | np.uint64(1)
_SHIFT = np.uint64(64 - (ROWS - 1).bit_length())


class Weights:
    """Of the groups (first GROUPS rows) and of the classes in their groups: a bias and ROWS weights each."""

    def __init__(self, bias: np.ndarray, rows: np.ndarray):
        self.bias, self.rows = bias, rows

    def logs(self, first: int, n: int, features: np.ndarray) -> np.ndarray:
        """Log probabilities (n, tokens) of the softmax over the rows first ... first + n."""
        z = np.empty((n, features.shape[1]), np.float32)
        for i in range(n):
            w = self.rows[first + i]
            z[i] = self.bias[first + i] + w[features[0]]
            for f in features[1:]:
                z[i] += w[f]
        z -= z.max(0)
        z -= np.log(np.exp(z).sum(0))
        return z

    def softmaxes(self, classes: np.ndarray, features: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(tokens, first row, own row of each, log probabilities): of the groups for all tokens, then of each group's classes for the tokens in it."""
        yield np.arange(len(classes)), 0, classes // GROUP, self.logs(0, GROUPS, features)
        for g in range(GROUPS):
            some = np.flatnonzero(classes // GROUP == g)
            if len(some):
                yield some, GROUPS + g * GROUP, classes[some] % GROUP, self.logs(GROUPS + g * GROUP, GROUP, features[:, some])

    def score(self, classes: np.ndarray, features: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes))
        for some, _, own, logs in self.softmaxes(classes, features):
            out[some] += logs[own, np.arange(len(own))]
        return out

    def gradient(self, classes: np.ndarray, features: np.ndarray, out: np.ndarray) -> None:
        """Adds the log likelihood's gradient to out (rows, ROWS + 1): the weights, then the bias."""
        for some, first, own, logs in self.softmaxes(classes, features):
            np.exp(logs, out=logs)
            np.negative(logs, out=logs)
            logs[own, np.arange(len(own))] += 1
            rows = features if len(some) == len(classes) else features[:, some]
            for i in range(len(logs)):
                own_row = logs[i].astype(np.float64)
                for f in rows:
                    out[first + i, :ROWS] += np.bincount(f, own_row, ROWS)
                out[first + i, ROWS] += own_row.sum()


def feature_counts(classes: np.ndarray, features: np.ndarray, out: np.ndarray) -> None:
    """Adds how often each feature goes with each class to out (classes, ROWS)."""
    place = classes * ROWS
    out += np.bincount(np.concatenate([place + f for f in features]), minlength=CLASSES * ROWS).reshape(CLASSES, ROWS)


class Curvature:
    """First weights from the counts of features by class, and the diagonal Newton step for a gradient."""

    def __init__(self, counts: np.ndarray):
        by_class = counts.sum(1) / FEATURES
        n = np.maximum(counts.astype(float), 0)
        groups = n.reshape(GROUPS, GROUP, ROWS).sum(1)
        outer, shares = [groups, n], []
        total = by_class.sum()
        pi_group = (by_class.reshape(GROUPS, GROUP).sum(1) + 0.5) / (total + 0.5 * GROUPS)
        pi_class = (by_class.reshape(GROUPS, GROUP) + 0.5) / (by_class.reshape(GROUPS, GROUP).sum(1, keepdims=True) + 0.5 * GROUP)
        self.bias = np.log(np.append(pi_group, pi_class.ravel()))
        whole = [groups.sum(0)[None, :], np.repeat(groups, GROUP, 0)]
        for own, all_, pi in zip(outer, whole, (pi_group, pi_class.ravel())):
            shares.append((own + PSEUDO * pi[:, None]) / (all_ + PSEUDO))
        q, seen = np.concatenate(shares), np.concatenate([np.repeat(whole[0], GROUPS, 0), whole[1]])
        self.rows = (np.log(q) - self.bias[:, None]) / FEATURES
        self.step = 1 / (FEATURES * (seen * q * (1 - q) + DAMP))
        share = np.exp(self.bias)
        count = np.append(np.full(GROUPS, total), np.repeat(by_class.reshape(GROUPS, GROUP).sum(1), GROUP))
        self.bias_step = 1 / (FEATURES * (count * share * (1 - share) + DAMP))

    def weights(self) -> Weights:
        return Weights(self.bias.astype(np.float32), self.rows.astype(np.float32))

    def take(self, gradient: np.ndarray) -> None:
        self.rows += np.clip(gradient[:, :ROWS] * self.step, -1, 1)
        self.bias += np.clip(gradient[:, ROWS] * self.bias_step, -1, 1)


def summed(table: DataFrame, words: Vocabulary, weights: Weights | None = None, turn: int = 0) -> np.ndarray:
    """The gradient at the weights over the training documents of a round, or without weights the counts of features by class over all. Of the model's own size."""
    spark = table.sparkSession
    vocabulary, shared = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(weights)
    shape, kind = ((CLASSES, ROWS), np.int32) if weights is None else ((GROUPS + CLASSES, ROWS + 1), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocabulary.value, shared.value
        sums, some = np.zeros(shape, np.int64 if w is None else np.float64), False
        for b in batches:
            for row in b.to_pylist():
                block = Block.of(row)
                at = np.flatnonzero(block.train if w is None else block.train & np.repeat(block.round == turn, np.diff(block.offsets)))
                some |= len(at) > 0
                classes, features = v.features(block, at)
                if w is None:
                    feature_counts(classes, features, sums)
                else:
                    for i in range(0, len(at), STEP):
                        w.gradient(classes[i : i + STEP], features[:, i : i + STEP], sums)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array([x.astype(kind).tobytes() for x in sums], pa.binary())], ["row", "sums"])
        B.give_back()

    def add(data: pa.Table) -> pa.Table:
        total = np.zeros(shape[1], np.int64 if kind == np.int32 else np.float64)
        for x in data["sums"].to_pylist():
            total += np.frombuffer(x, kind)
        return pa.table({"row": data["row"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape, np.int64 if weights is None else np.float64)
    for r in table.mapInArrow(run, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary").collect():
        out[r["row"]] = np.frombuffer(r["sums"], out.dtype)
    return out


def fitted_vocabulary(found: DataFrame) -> Vocabulary:
    """The vocabulary from :func:`totals`: at most HEAD + ENDINGS rows come to the driver."""
    head = found.where(F.col("kind") == FREQUENT).orderBy(F.col("c").desc(), "token").limit(HEAD).select("token", "ending", "c").collect()
    top = [(r["ending"], r["c"]) for r in head[:TOP]]
    less = found.sparkSession.createDataFrame([(e, -c, -1) for e, c in top], "ending int, c long, v long")
    by_ending = found.where(F.col("kind") == BY_ENDING).select("ending", "c", "v").unionByName(less).groupBy("ending").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    by_ending = written(by_ending.where("v > 0"), "lm-endings")
    chosen = by_ending.orderBy(F.col("c").desc(), "ending").limit(ENDINGS).collect()
    rest = by_ending.where(~F.col("ending").isin([r["ending"] for r in chosen])).agg(F.sum("c").alias("c"), F.sum("v").alias("v")).first() if chosen else {"c": 0, "v": 0}
    return Vocabulary([tuple(r) for r in head], {r["ending"]: (r["c"], r["v"]) for r in chosen}, (rest["c"] or 0, rest["v"] or 0))


def trained(table: DataFrame, words: Vocabulary) -> Weights:
    model = Curvature(summed(table, words))
    for turn in range(ROUNDS):
        model.take(ROUNDS * summed(table, words, model.weights(), turn))
    return model.weights()


def token_scores(block: Block, words: Vocabulary, weights: Weights, c: np.ndarray, n: np.ndarray, pair: np.ndarray, starts: int) -> np.ndarray:
    """log10 P of every token. c: the distinct tokens' counts, n: the distinct pairs', pair: each token's pair, starts: training texts."""
    classes, features = words.features(block)
    logs = np.empty(len(classes))
    for i in range(0, len(classes), STEP):
        logs[i : i + STEP] = weights.score(classes[i : i + STEP], features[:, i : i + STEP])
    model = np.exp(logs - words.log_z[classes]) * (c[block.at] + 1.0)
    m = np.append(c, starts)[block.before].astype(float)
    k = PRIOR * m**POWER + 1
    return np.log10((n[pair] + k * model) / (m + k))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    table = written(blocks(docs.select("doc_id", (fold == 2).alias("held"), "text")), "lm-blocks")
    size = table.agg(F.sum("n").alias("all"), F.sum("trained").alias("n")).first()
    every, n = size["all"] or 0, size["n"] or 0
    parts, bits = max(16, -(-every // PART)), min(64, max(32, every.bit_length() + SPARE))
    found = written(totals(table, parts, bits), "lm-totals")
    v = found.where(F.col("kind") == BY_ENDING).agg(F.sum("v").alias("v")).first()["v"] or 0
    ends = found.where((F.col("kind") == BY_ENDING) & (F.col("ending") == END_ENDING)).agg(F.sum("c").alias("c")).first()["c"] or 0
    words = fitted_vocabulary(found)
    vocabulary, weights = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(trained(table, words))

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        found_rows = counts.to_pylist()
        for row in rows.to_pylist():
            block = Block.of(row)
            pairs, pair = block.pairs(bits)
            got: dict[int, np.ndarray] = {}
            for kind, size in ((WORD, len(block.words)), (PAIR, len(pairs))):
                mine = sorted((r["part"], r["totals"]) for r in found_rows if r["kind"] == kind)
                got[kind] = np.concatenate([widened(x) for _, x in mine])
                if len(got[kind]) != size:
                    raise ValueError("a block's counts are not whole")
            c = got[WORD]
            logs = token_scores(block, vocabulary.value, weights.value, c, got[PAIR], pair, ends)
            first = block.offsets[:-1]
            known, seen, total = (np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64)[block.at], np.log10(c + 1.0)[block.at], logs))
            many = np.diff(block.offsets)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
            cols = (ids, block.held, many, known, np.full(len(many), n), seen - many * math.log10(n + v + 1), total)
            out.append(pa.table({x.split()[0]: pa.array(y) for x, y in zip(RESULT.split(", "), cols)}))
        B.give_back()
        return pa.concat_tables(out)

    own = found.where(F.col("kind").isin(WORD, PAIR)).select("block", "part", "kind", "totals")
    return table.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, RESULT)
