"""Fill-in-middle rearrangement; places in the text are found eight bytes at a time.

A text is cut into units: a run of white space with the word behind it, or white space at its end.
Prefix, middle and suffix are runs of whole units, so their bounds are the ends of the k-th units. A
batch's UTF-8 bytes are read as 64-bit words. Sums and masks mark, in the top bit of each byte of a
word, whether the byte ends a unit: it does if it is not white space and the next byte is, or if it
is the text's last. `bitwise_count` gives the marks of each word; the running total of these counts
is searched for the word that holds a wanted mark, and inside the word a multiplication turns marks
into running totals per byte, of which those below the wanted one are counted. Code points are
counted alike, by marks on the bytes that begin one. No unit becomes a Python object, and the work
does not depend on the number of units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.llm.words import buffers, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 50, 80  # percent of texts rearranged; of those, percent that start with the suffix
SEED = 42
_DRAWS = ("h1", "h2", "h3", "h4")
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_TOP = np.uint64(0x8080808080808080)
_REST = ~_TOP
_EACH = np.uint64(0x0101010101010101)


def _every(byte: int) -> np.uint64:
    return np.uint64(byte) * _EACH


def space_marks(word: np.ndarray) -> np.ndarray:
    """Top bit of each byte that is 0x20 or 0x09 to 0x0D. No sum carries into the next byte."""
    low = word & _REST
    from_tab = low + _every(0x80 - 0x09)
    past_return = low + _every(0x80 - 0x0E)
    not_blank = (low ^ _every(0x20)) + _every(0x7F)
    return ((from_tab & ~past_return) | ~not_blank) & ~word & _TOP


class Marks:
    """Marked bytes of a buffer: `marks` has the top bit of marked bytes set."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks >> np.uint64(7)
        self.total = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of marked bytes before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.total[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th marked byte, counted from 1."""
        word = np.searchsorted(self.total, k, side="left") - 1
        wanted = (k - self.total[word]).astype(np.uint64)
        running = self.marks[word] * _EACH
        reached = ((running | _TOP) - wanted * _EACH) & _TOP
        return word * 8 + 8 - np.bitwise_count(reached)


def _words(data: np.ndarray) -> np.ndarray:
    """The bytes as words, zeros behind them: one word more than is full at least."""
    padded = np.zeros(len(data) // 8 * 8 + 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> Marks:
    """Marks on the bytes that end a unit of a row."""
    space = space_marks(_words(data))
    after = (space >> np.uint64(8)) | (np.append(space[1:], np.uint64(0)) << np.uint64(56))
    ends = ~space & after & _TOP
    last = offsets[1:][np.diff(offsets) > 0] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << np.uint64(3)))
    return Marks(ends)


def code_points(data: np.ndarray) -> Marks:
    """Marks on the bytes that begin a code point; the padding is marked, too."""
    word = _words(data)
    return Marks(~(word & ~(word << np.uint64(1))) & _TOP)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: numbers of 32 bits that depend on the id alone; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(_DRAWS)
    ]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain) and output.

    Null and empty texts are plain and give an empty output; so do all texts that hold a mark, since
    nobody could tell it from ours. White space alone is one unit. Rows that share an id are cut by
    the same draws; each row appears. Only `doc_id` and `text` are read, other columns may have any
    names. An empty table gives no rows. A text of any length is cut whole: it costs a few bytes of
    memory per byte, in the task that reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield _rearranged(batch, rate, spm_rate)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(run, _OUT)


def _rearranged(batch: pa.RecordBatch, rate: int, spm_rate: int) -> pa.RecordBatch:
    text = batch.column(1)
    data, offsets = buffers(text)
    h1, h2, h3, h4 = (batch.column(2 + k).to_numpy() for k in range(4))
    ends = unit_ends(data, offsets)
    before = ends.rank(offsets)
    n = np.diff(before)
    marked = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(text, mark).fill_null(False).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= rate)
    spm = h4 % 100 < spm_rate

    def cut(k: np.ndarray) -> np.ndarray:
        """Where the k-th unit of each row ends."""
        out = offsets[:-1].copy()
        some = k > 0
        out[some] = ends.select(before[:-1][some] + k[some]) + 1
        return out

    one, two = h1 % (n + 1), h2 % (n + 1)
    first, second = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    begun = code_points(data)
    at_start, at_first, at_second = begun.rank(offsets[:-1]), begun.rank(first), begun.rank(second)

    raw = data.tobytes()
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    output = []
    for is_plain, is_spm, a, b, c, d in zip(
        plain.tolist(), spm.tolist(), offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist()
    ):
        if is_plain:
            output.append(raw[a:d])
        elif is_spm:
            output.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            output.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(n),
            pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))),
            pa.array(at_first - at_start, mask=plain),
            pa.array(at_second - at_first, mask=plain),
            pa.array(output, pa.binary()).view(pa.string()),
        ],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def restore(form: Column, output: Column) -> Column:
    """The text that `transform` was given, from its output and form."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    cut = F.instr(head, second)
    left = F.substr(head, F.lit(len(PREFIX) + 1), cut - F.lit(len(PREFIX) + 1))
    right = F.substr(head, cut + F.lit(len(PREFIX)))
    rebuilt = F.when(form == "spm", F.concat(right, middle, left)).otherwise(F.concat(left, middle, right))
    return F.when(form == "plain", output).otherwise(rebuilt)


def digest(rearranged: DataFrame) -> DataFrame:
    """The columns of `transform` with digests of the output and of the text restored from it."""
    return rearranged.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


ORACLE = f"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as x,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u
  from documents
),
h as (
  select *, len(u) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2,
    cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4
  from d
),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
    case when n = 0 or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}')
      or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM_RATE} then 'spm' else 'psm' end as form
  from h
),
p as (
  select *, coalesce(array_to_string(u[1:i], ''), '') as a, coalesce(array_to_string(u[i + 1:j], ''), '') as b,
    coalesce(array_to_string(u[j + 1:], ''), '') as c
  from f
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(a) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(b) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b
    else '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
