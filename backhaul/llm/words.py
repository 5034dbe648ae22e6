"""Words of a whole Arrow text column as NumPy arrays, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_LONG = 1024  # bytes; longer words are hashed one by one
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64
)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~SPACE
#: ASCII capitals to small letters, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text, one row at least."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that `inside` accepts, and the first run of each row.

    Runs never cross rows. `first` has one entry more than there are rows.
    """
    flag = inside[data]
    opens = flag.copy()
    opens[1:] &= ~flag[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edge] = flag[edge]
    closes = flag.copy()
    closes[:-1] &= ~flag[1:]
    closes[edge - 1] = flag[edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _ODD[1]
    x ^= x >> np.uint64(27)
    x *= _ODD[2]
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; depends on its bytes alone."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + _ODD[0])
    live, done = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        left = size[live] - done
        chunk = eight[starts[live] + done] & _TAIL[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ chunk) * _ODD[0])
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of `size` consecutive words of a row: its hash, its first word and its row.

    Runs appear in order of their place; rows with fewer words have none.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key * _ODD[0] + words[k : k + n]
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(row))
    return mix(key[at]), at, row


def salted(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys made different from row to row."""
    return mix(keys + mix(row.astype(np.uint64)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur more than once."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice) == 0:
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of `values` over each row's entries; 0 for empty rows."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
