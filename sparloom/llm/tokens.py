"""Word hashes of Arrow text columns in numpy, a few megabytes of text at a time.

Words are maximal runs of bytes outside a table of separators (white space, or all ASCII but letters and
digits); A-Z are lower-cased. A word is cut into pieces of eight bytes; each piece is mixed with its place in
the word, and the mixed pieces and the length are added up and mixed again. Mixing is no ring operation, so
words that are alike in a regular way do not meet, as they do under a polynomial modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time.
BLOCK = 2 << 20
_P = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators: white space only; everything in ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64, for block lengths up to n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK) + 1
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            table = np.multiply.accumulate(steps)
            _powers[k:] = [table]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, breaks: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a block; ``breaks``: offsets before which a word ends."""
    space = between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[breaks] = True
    prior = np.empty(len(data) + 1, bool)
    prior[0], prior[1:] = True, space
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = True, space
    starts = np.flatnonzero(~after & (prior | edge))
    ends = np.flatnonzero(~prior & (after | edge))
    return _digests(_LOWER[data], starts, ends - starts), starts, ends


#: Masks of the first k bytes of a piece, read little-endian.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _digests(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs of the given starts and sizes (one byte or more)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(low) + 1, 8), (1, 1), writeable=False)
    read = lambda at, n: eight[at].view("<u8")[:, 0] & _FIRST[np.minimum(n, 8)]
    total = mix(read(starts, sizes) + np.uint64(_P)) + sizes.astype(np.uint64)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        pieces = (sizes[long] - 1) // 8  # those behind the first
        first = np.cumsum(pieces) - pieces
        place = np.arange(pieces.sum()) - np.repeat(first, pieces) + 1
        of = np.repeat(long, pieces)
        mixed = mix(read(starts[of] + 8 * place, sizes[of] - 8 * place) + (place + 1).astype(np.uint64) * np.uint64(_P))
        total[long] += np.add.reduceat(mixed, first)
    return mix(total)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data is not None and rows[-1] > rows[0] else np.zeros(0, np.uint8)
    return raw, rows - rows[0]


def blocks(column: pa.Array, between: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, word hashes, row of each word, word starts, word ends) over blocks of about BLOCK bytes
    that end between words; a row may span blocks. Starts and ends count bytes within the row."""
    data, rows = _text(column)
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and end not in rows[np.searchsorted(rows, end) :][:1] and not between[data[end]]:
            end += 1
        lo, hi = np.searchsorted(rows, at), np.searchsorted(rows, end)
        part = data[at:end]
        hashes, starts, ends = word_hashes(part, rows[lo:hi] - at, between)
        row = np.searchsorted(rows, starts + at, side="right") - 1
        yield part, hashes, row, starts + at - rows[row], ends + at - rows[row]
        at = end


def rows_of(column: pa.Array, between: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, hashes) for groups of whole rows of about BLOCK bytes or a single longer row: words
    of rows[i] are hashes[offsets[i]:offsets[i + 1]]."""
    _, ends = _text(column)
    at = 0
    while at < len(column):
        to = int(max(at + 1, np.searchsorted(ends, ends[at] + BLOCK, side="right") - 1))
        got = [(h, r) for _, h, r, _, _ in blocks(column.slice(at, to - at), between)]
        hashes = np.concatenate([h for h, _ in got]) if got else np.zeros(0, np.uint64)
        row = np.concatenate([r for _, r in got]) if got else np.zeros(0, np.int64)
        yield np.arange(at, to), np.searchsorted(row, np.arange(to - at + 1)), hashes
        at = to


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` words in a row, as one array."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * np.uint64(pow(_P, width - k, 1 << 64))
    return mix(total)
