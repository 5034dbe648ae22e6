"""Quality rules: a conditional random field marks each line as content or boilerplate, and a
document stays if enough of its words stand in content lines.

The field learns from documents with a quality label: their lines carry the document's label, so
single lines are noisy, but the chain weighs a line's own form against its neighbours. It is fitted
on at most `sample` labelled documents, those with the lowest hash of doc_id and text; of the others
only ids and hashes are shuffled for it. Everything else is counted over whole texts, where they are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.llm import chain
from backhaul.llm.chain import Chain
from backhaul.llm.sampling import distinct_rows, rows_of, sampled
from backhaul.llm.words import (
    NOT_SPACE, buffers, hash_spans, repeated, row_sums, salted, slices, spans, windows,
)
from backhaul.operators.joins import join_per_key

SAMPLE = 1500
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
MIN_CONTENT = 0.3
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = np.ones(256, np.int64)  # code points begin at these bytes
_START[0x80:0xC0] = 0
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def _bytes(*kept: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for one in kept:
        table[list(one.encode())] = True
    return table


_CAPITAL = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SMALL = _bytes("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _bytes("0123456789")
_BAR = _bytes("|")
_MARK = _bytes("!?~^_=+{}[]\\/@")
FEATURES = ["one", "symbols", "capitals", "digits", "marks", "short", "long_words", "repeated_line", "repeated_words", "ends", "bars", "same_word"]
#: Weights where nothing is labelled: symbols, shouting and repetition are boilerplate.
DEFAULT = Chain(
    np.array([-4.0, 12.0, 6.0, 3.0, 8.0, 0.0, 0.0, 4.0, 6.0, -1.0, 4.0, 6.0]), np.array([[1.0, -1.0], [-1.0, 1.0]])
)


class Text:
    """Counts of a slice of texts by row, and features of its lines that hold a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begin, end, first = spans(data, offsets, NOT_SPACE)
        self.n_words = np.diff(first)
        self.word_chars = row_sums(_START[data] * NOT_SPACE[data], offsets)
        self.n_symbols = row_sums(_SYMBOL[data], offsets)

        word = hash_spans(data, begin, end)
        key, at, row = windows(word, first, WINDOW)
        hit = at[repeated(salted(key, row))]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        twice = np.cumsum(cover)[:-1] > 0
        self.n_repeat_words = row_sums(twice, first)

        lo, hi, lines = spans(data, offsets, _NOT_NEWLINE)
        in_line = np.searchsorted(begin, lo), np.searchsorted(begin, hi)
        some = in_line[1] > in_line[0]
        before = np.concatenate([[0], np.cumsum(some)])
        self.first = before[lines]
        lo, hi = lo[some], hi[some]
        self.words_in_line = (in_line[1] - in_line[0])[some]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        key = salted(hash_spans(data, lo, hi), row)
        order = np.argsort(key, kind="stable")
        later = np.zeros(len(key), bool)
        later[order[1:][key[order][1:] == key[order][:-1]]] = True
        self.n_dup_lines = row_sums(later, self.first)

        size = np.maximum(hi - lo, 1)

        def share(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[data])])
            return (total[hi] - total[lo]) / size

        capital, small = share(_CAPITAL), share(_SMALL)
        def word_share(marked: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(marked)])
            return (total[in_line[1]] - total[in_line[0]])[some] / np.maximum(self.words_in_line, 1)

        same = np.zeros(len(word), bool)
        same[1:] = word[1:] == word[:-1]
        self.features = np.column_stack(
            [
                np.ones(len(size)),
                np.minimum(share(_SYMBOL) * 5, 1),
                np.where(capital + small > 0, capital / np.maximum(capital + small, 1e-9), 0),
                share(_DIGIT),
                np.minimum(share(_MARK) * 5, 1),
                self.words_in_line < 5,
                np.minimum(size / np.maximum(self.words_in_line, 1) / 20, 1),
                later,
                word_share(twice),
                np.isin(data[np.maximum(hi - 1, 0)], list(b".!?:\"'")) if len(data) else np.zeros(0),
                np.minimum(share(_BAR) * 20, 1),
                word_share(same),
            ]
        )

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEATED * self.n_words)

    def content_share(self, model: Chain) -> np.ndarray:
        """Share of a row's words in content lines; 0 for rows without words."""
        content = chain.viterbi(model, self.features, self.first) == 0
        return row_sums(content * self.words_in_line, self.first) / np.maximum(self.n_words, 1)


def _training_lines(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Features of all lines of at most `sample` labelled documents, one row per document."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).dropna()
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = join_per_key(distinct_rows(docs), marked, "doc_id", "inner")
    rows = rows_of(docs, sampled(rows, sample), "doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                text = Text(*buffers(batch.column(1)))
                cells = [
                    text.features[a:b].astype("<f4").tobytes()
                    for a, b in zip(text.first[:-1], text.first[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(cells, pa.binary())],
                    names=["doc_id", "quality", "features"],
                )

    return rows.mapInArrow(run, "doc_id long, quality int, features binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit the field on a bounded sample of labelled documents; DEFAULT if they show one class only.

    The sample's line features, at most `sample` documents of them, come to the driver.
    """
    rows = sorted(_training_lines(docs, labels, sample).collect())
    feats = [np.frombuffer(r.features, "<f4").reshape(-1, len(FEATURES)) for r in rows]
    quality = np.array([r.quality for r in rows])
    if len(np.unique(quality)) < 2:
        return DEFAULT
    size = np.array([len(f) for f in feats])
    marks = np.repeat((quality == 0).astype(np.int64), size)
    return chain.fit(np.concatenate(feats).astype(float), marks, np.concatenate([[0], np.cumsum(size)]))


OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, kept boolean, content_share double"
)


def judge(docs: DataFrame, model: Chain, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts and verdict of every document, one row per input row.

    Null and blank texts have no words, fail the base rule and go. Rows that share an id are judged
    each by its own text. Only `doc_id` and `text` are read, whatever else the table holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                text = Text(*buffers(batch.column(1)))
                share, failed = text.content_share(model), text.base_failed()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *[
                            pa.array(x.astype(np.int64))
                            for x in (text.n_words, text.word_chars, text.n_symbols, text.n_dup_lines, text.n_repeat_words)
                        ],
                        pa.array(failed),
                        pa.array(~failed & (share >= min_content)),
                        pa.array(share),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, OUT)


def keep(docs: DataFrame, model: Chain, min_content: float = MIN_CONTENT) -> DataFrame:
    """The documents that stay, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                text = Text(*buffers(batch.column(batch.schema.get_field_index("text"))))
                good = ~text.base_failed() & (text.content_share(model) >= min_content)
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def label_lines(docs: DataFrame, model: Chain) -> DataFrame:
    """Every line with a word: doc_id, its number among these (from 0), whether it is content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                text = Text(*buffers(batch.column(1)))
                n = np.diff(text.first)
                row = np.repeat(np.arange(len(n)), n)
                content = chain.viterbi(model, text.features, text.first) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(batch.column(0), pa.array(row)),
                        pa.array(np.arange(len(row)) - text.first[:-1][row]),
                        pa.array(content),
                    ],
                    names=["doc_id", "line", "content"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, line long, content boolean")
