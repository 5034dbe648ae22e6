"""Token ids, packing and the token store against the tokenizer itself."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, SF_DIR, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from backhaul.llm import packing, token_store
from backhaul.llm.encoding import Encoder, vocabulary_path
from backhaul.llm.words import buffers

TOKENIZER = Tokenizer.from_file(vocabulary_path())
ENCODER = Encoder(vocabulary_path())


def expected(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def encoded(texts):
    ids, bounds = ENCODER.encode(*buffers(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


PIECES = ["It's", "we'll'd", "café", "CAFÉ", "ÉÉ×÷", "İstanbul", "ΣΑΣ", "42nd", "a1b2", "…—", "#*$|<>", "naïve,", "\x1c ", "日本語", "ab́c", "x≠y", "<|endoftext|>"]


@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=8)), max_size=6), st.sampled_from(["", " ", "\n", "\t\t"]))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizer(parts, between):
    text = between.join(parts)
    assert encoded([text, None, text + " end"]) == [expected(text), [2], expected(text + " end")]


def test_forgetting_changes_nothing(monkeypatch):
    from backhaul.llm import encoding

    monkeypatch.setattr(encoding, "_KEPT", 12)
    small = Encoder(vocabulary_path())
    for text in ("one two three four five", "six seven eight nine ten, eleven", "one two six"):
        ids, _ = small.encode(*buffers(pa.array([text])))
        assert ids.tolist() == expected(text)


def test_more_pieces_than_the_table_holds(monkeypatch):
    from backhaul.llm import encoding

    monkeypatch.setattr(encoding, "_KEPT", 12)
    small = Encoder(vocabulary_path())
    texts = ["", " ".join(f"n{i} word{i}, café" for i in range(200)), None, "one two", " ".join(map(str, range(90))), ""]
    ids, bounds = small.encode(*buffers(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [expected(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 8192 + 5, 12345])
def test_cut(n):
    pieces = packing.cut(n)
    assert sum(pieces) == n
    assert all(p & (p - 1) == 0 and p <= 4096 for p in pieces)
    assert pieces == sorted(pieces, reverse=True)
    assert len([p for p in pieces if p < 4096]) == bin(n % 4096).count("1")


def test_packing_round_trip(spark):
    rows = packing.pack(documents(spark, ODD)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and len(r.ids) == 4 * r.length and r.length == 1 << r.bucket for r in rows)
    got = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for doc_id, text in ODD:
        ids = expected(text)
        pieces = got[doc_id, len(ids)]
        for start, part in pieces:
            assert part == ids[start : start + len(part)]
        copies = sum(1 for d, t in ODD if d == doc_id and len(expected(t)) == len(ids))
        assert sum(len(p) for _, p in pieces) == copies * len(ids)


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_buckets_are_written(spark, tmp_path):
    packing.write_buckets(packing.pack(documents(spark, ODD)), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("bucket = 0").where("length != 1").count() == 0


@pytest.mark.parametrize("block_ids", [64, 1 << 19])
def test_store_round_trip(spark, tmp_path, block_ids):
    path = str(tmp_path / "store")
    token_store.write_store(documents(spark, ODD).repartition(3), path, block_ids=block_ids)
    rows = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows]])[:-1])
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    key = lambda doc_id, ids: (str(doc_id), ids)
    got = sorted(key(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == sorted(key(d, expected(t)) for d, t in ODD)


def test_lookup(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(documents(spark, ODD), path, block_ids=64)
    keys = spark.createDataFrame([(6,), (6,), (1,), (77,), (None,), (-5,)], "doc_id long")
    rows = token_store.lookup(keys, path).collect()
    want = [(d, len(expected(t))) for d, t in ODD if d in (1, 6)]
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted(want)
    whole = {(r.doc_id, r.start): r.ids for r in token_store.read_store(spark, path).collect()}
    assert all(whole[r.doc_id, r.start] == r.ids for r in rows)


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(documents(spark, []), path)
    assert token_store.read_store(spark, path).count() == 0
    assert token_store.lookup(spark.createDataFrame([(1,)], "doc_id long"), path).count() == 0


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
@settings(max_examples=50, deadline=None)
def test_index_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.int64)
    hashes = token_store._hashes(keys)
    mph = token_store.build_mph(hashes)
    assert sorted(token_store.mph_slots(mph, hashes)) == list(range(len(keys)))


def test_index_lists_what_the_cascade_leaves(monkeypatch):
    monkeypatch.setattr(token_store, "_LEVELS", 1)
    keys = np.arange(1000)
    hashes = token_store._hashes(keys)
    mph = token_store.build_mph(hashes)
    assert sorted(token_store.mph_slots(mph, hashes)) == list(range(1000))


@pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")
def test_queries_on_tables(spark):
    from backhaul.llm.queries import QUERIES

    rows = QUERIES["op10_token_store"](spark, str(SF_DIR)).collect()
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(expected(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    packed = QUERIES["op5_packing"](spark, str(SF_DIR))
    assert packed.groupBy().sum("length").first()[0] == sum(r.n_tokens for r in rows)
