"""Byte-level BPE encoding and decoding over the rank file of a public tokenizer.

The vocabulary is a trie of Latin-1 strings (one character a byte) in a pyahocorasick automaton. A piece is
encoded from the left with its longest token; when a token can't follow the one before it, the next shorter
token that is its prefix is tried, and when none is left the previous token is taken back. Whether two tokens
may stand side by side is decided by undoing merges from their border outwards, and memoised. A position that
failed once is never tried again, so the work is linear in the piece, and the result is the one that merging
by rank gives.

Null text is empty text, which has no tokens and decodes to no bytes. Extra columns pass through
:func:`encode` unless they clash with its own (``token_ids``), which then replace them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytesops import give_back, keeps
from .common import small_batches

#: Pieces that a worker remembers, and the longest that it remembers: a bound of its memory.
KEEP_PIECES, KEEP_LENGTH = 60_000, 48


class BytePairs:
    """Encoder and decoder for one vocabulary: ranks by token bytes, and the pattern that splits text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        trie = ahocorasick.Automaton()
        for b, i in ranks.items():
            trie.add_word(b.decode("latin-1"), i)
        self.trie = trie
        self.longest = trie.longest_prefix
        self.shorter: dict[int, int] = {}
        for b, i in ranks.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := ranks.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.made_of: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(self.bytes_of):
            self._split(i)
        self.sizes = {i: len(b) for i, b in self.bytes_of.items()}
        self.most = max(self.sizes.values(), default=1)
        self.bytes_of_decimal = {str(i): b for i, b in self.bytes_of.items()}
        self.fits_memo: dict[int, bool] = {}
        self.starts: dict[str, int] = {}
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _split(self, i: int) -> None:
        """The two tokens whose merge makes token i; a token that no merge makes, as a single byte, is its own halves."""
        b, left = self.bytes_of[i], self.shorter.get(i)
        while left is not None:
            right = self.ranks.get(b[len(self.bytes_of[left]) :])
            if right is not None and left < i and right < i and self._fits(left, right):
                self.made_of[i] = (left, right)
                self.merged[left, right] = i
                return
            left = self.shorter.get(left)
        self.made_of[i] = (i, i)

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between these two tokens."""
        merged, made_of = self.merged, self.made_of
        limit = len(self.bytes_of) + 1
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            first = left > right
            for undo_left in (first, not first):
                if undo_left:
                    limit, half = left, made_of[left][1]
                    if half != left:
                        left = half
                        break
                else:
                    limit, half = right + 1, made_of[right][0]
                    if half != right:
                        right = half
                        break
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        s, size, most, longest, starts, sizes, shorter, memo = piece.decode("latin-1"), len(piece), self.most, self.longest, self.starts, self.sizes, self.shorter, self.fits_memo
        failed: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        rest = s[:most]
        token = starts.get(rest[: (n := longest(rest))])
        if token is None:
            token = self._first(rest, n)
        while True:
            end = at + sizes[token]
            ok = end not in failed
            if ok and last >= 0:
                ok = memo.get(key := last << 32 | token)
                if ok is None:
                    if len(memo) >= 2 * KEEP_PIECES:
                        memo.clear()
                    ok = memo[key] = self._fits(last, token)
            if ok:
                out.append(token)
                if end == size:
                    return out
                at, last = end, token
                rest = s[at : at + most]  # no token is longer, so that a step costs the same wherever it is
                token = starts.get(rest[: (n := longest(rest))])
                if token is None:
                    token = self._first(rest, n)
            elif (less := shorter.get(token)) is not None:
                token = less
            else:
                failed.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1

    def _first(self, s: str, n: int) -> int:
        """The longest token that s begins with; n is the length of its longest path in the trie, which is cut back to a token."""
        path = s[:n]
        while (found := self.trie.get(s[:n], None)) is None:
            n -= 1
        self.starts[path] = found
        return found

    def known(self, piece: str) -> str:
        """The piece's ids as decimals joined by a space."""
        found = self.older.get(piece)
        if found is None:
            found = " ".join(map(str, self.encode_piece(piece.encode())))
        if len(piece) <= KEEP_LENGTH:
            if len(self.memo) >= KEEP_PIECES:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = found
        return found

    def joined(self, text: str) -> str:
        """All ids of a text as decimals joined by a space."""
        memo, known = self.memo.get, self.known
        return " ".join([memo(p) or known(p) for p in self.pieces(text)])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.joined(text).split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the joined decimal ids, SHA-256 of the bytes decoded from the ids."""
        ids = (joined := self.joined(text)).split()
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join(map(self.bytes_of_decimal.__getitem__, ids))).hexdigest()


    def forget(self) -> None:
        """Drops what has been remembered of pieces: a worker stands idle for long."""
        self.memo, self.older, self.fits_memo = {}, {}, {}


@lru_cache(maxsize=2)
def load(path: str | None = None, pattern: str | None = None) -> BytePairs:
    """The vocabulary of a rank file; by default the public 50k byte-level one."""
    if path is None or pattern is None:
        import public_tokenizers as P

        path, pattern = path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    keeps("bpe", load.cache_clear)
    return BytePairs(ranks, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with the column ``token_ids`` (array of int) of the column ``text``."""
    small_batches(docs.sparkSession)
    keep = docs.drop("token_ids")
    schema = T.StructType([*keep.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])
    at = keep.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path, pattern)
        for b in batches:
            ids = pa.array([pairs.encode(t or "") for t in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "token_ids"])

    return keep.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """tokens with the column ``decoded`` (binary) of the column ``token_ids``; null ids decode to no bytes."""
    small_batches(tokens.sparkSession)
    keep = tokens.drop("decoded")
    schema = T.StructType([*keep.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = keep.columns.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path, pattern)
        for b in batches:
            out = pa.array([pairs.decode(x or []) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "decoded"])

    return keep.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path, pattern)
        for b in batches:
            out = [pairs.digest(t or "") for t in b.column(1).to_pylist()]
            n, ids, decoded = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        pairs.forget()
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
