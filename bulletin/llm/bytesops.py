"""Vectorised work on a batch of texts laid end to end as bytes: tokens, hashes, gathers by segment."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 2**64))


def laid_out(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data + ((data - np.uint8(65)) < np.uint8(26)).astype(np.uint8) * np.uint8(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = np.array(x, U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}
#: Of each table of powers, what stays from one block to the next.
KEPT = 1 << 20


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n; kept for further batches, rounded up to a power of two."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(1 << max(16, (n - 1).bit_length()), base, U)
        known[0] = 1
        _POWERS[int(base)] = known = np.multiply.accumulate(known)
    return known[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of (byte k + 1) * base ** k for i <= k < j, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range from :func:`prefix_sums`: cheaper than :func:`digests`, but structured bytes may agree in it, so that equals have to be compared."""
    inverse = powers(int(starts.max()) + 1, _INVERSE) if len(starts) else np.zeros(0, U)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


_MASKS = np.array([0xFFFFFFFFFFFFFFFF, *[(1 << (8 * k)) - 1 for k in range(1, 8)]], U)
#: 8-byte parts of ranges that are read at once.
_PARTS = 1 << 20


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each range. Every 8 bytes are mixed with their place in the range before they are summed, so that no
    structure of the bytes makes different ranges agree more often than chance."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    count = (size + 7) >> 3
    sums = np.zeros(len(size), U)
    upto, at = np.cumsum(count), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PARTS, "right")))
        n = count[at:to]
        if not n.any():
            at = to
            continue
        of = np.repeat(np.arange(at, to), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        part = eights[starts[of] + 8 * place]
        last = place == count[of] - 1
        part[last] &= _MASKS[size[of[last]] & 7]
        full = np.flatnonzero(n)
        sums[at + full] = np.add.reduceat(mixed(part + mixed(place.astype(U) + U(1 + (seed << 32)))), (np.cumsum(n) - n)[full])
        at = to
    return mixed(sums + size.astype(U) * U(0xD6E8FEB86659FD93))


def agree(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether the bytes from each a and from each b on are equal, over each size."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PARTS, "right")))
        if (data[expanded(a[at:to], size[at:to])] != data[expanded(b[at:to], size[at:to])]).any():
            return False
        at = to
    return True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, none across texts, and the n + 1 word offsets of the texts."""
    inside = ~((data == 32) | ((data - np.uint8(9)) < np.uint8(5)))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    before[at] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:][(offsets[1:] > 0)] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    full = counts > 0
    starts, counts = starts[full], counts[full]
    heads = np.cumsum(counts) - counts
    out[0] = starts[0]
    out[heads[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def sizes(column: pa.ChunkedArray) -> np.ndarray:
    """The number of bytes of each value (null: 0)."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)


def pieces(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, whole rows each: the bound of what is laid out at once."""
    size = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")) - at)
        yield batch.slice(at, n)
        at += n


#: What the C library's call for large blocks is named by, and from how many bytes on a block is one of its own, which is given back when freed.
_LARGE, _OWN = -3, 1 << 22


def give_back() -> None:
    """Returns freed memory to the system, now and for large blocks from now on: allocators keep it, and a worker stands beside its executor for long."""
    for base in [b for b, known in _POWERS.items() if len(known) > KEPT]:
        _POWERS[base] = _POWERS[base][:KEPT].copy()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such calls, and need none for right results
        library = ctypes.CDLL(None)
        library.mallopt(_LARGE, _OWN)
        library.malloc_trim(0)


#: What operators keep in a worker from one task to the next, by operator: the call that lets go of it.
_KEPT_BY: dict[str, Callable[[], None]] = {}


def keeps(operator: str, let_go: Callable[[], None]) -> None:
    """From now on the operator keeps something in this worker, until :func:`begun` of another one."""
    _KEPT_BY[operator] = let_go


def begun(operator: str) -> None:
    """A task of the operator begins: what other operators keep in this worker goes. Spark hands a worker from one query to the next, and its idle ones stand beside it."""
    for other in [x for x in _KEPT_BY if x != operator]:
        _KEPT_BY.pop(other)()
    _POWERS.clear()
    give_back()
