"""Collocations against brute force, at several shard sizes."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import ODD, SF_DIR, documents

from backhaul.llm import collocations
from backhaul.llm.queries import ORACLES, QUERIES

needs_tables = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")


def brute(rows, support, max_words, covered, top):
    words, count = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            count.update((lang, *w[i : i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1))
    often = {p: a for p, a in count.items() if len(p) > 2 and a >= support}
    found = []
    for (lang, *w), a in often.items():
        inside = any(
            100 * f >= covered * a and q[0] == lang and any(list(q[1 + i : 1 + i + len(w)]) == w for i in range(len(q) - len(w)))
            for q, f in often.items() if len(q) > len(w) + 1
        )
        cuts = []
        for k in range(1, len(w)):
            left, right = count[(lang, *w[:k])], count[(lang, *w[k:])]
            cuts.append((1000 * a * words[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        if not inside:
            found.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang in {f[0] for f in found}:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(f for f in found if f[0] == lang)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def corpus():
    draw = np.random.default_rng(3)
    vocabulary = ["the", "of", "New", "YORK", "city", "é", "日本", "x\x85y", *[f"w{i}" for i in range(12)]]
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(300):
        w = list(draw.choice(vocabulary, draw.integers(0, 40), p=chance / chance.sum()))
        for at in sorted(draw.integers(0, len(w) + 1, 3), reverse=True):
            w[at:at] = [["new york city of light"], ["a\tb  c d e"], [",", "hot dog"], ["!?"]][draw.integers(4)]
        rows.append((["en", "de", None, "und", ""][draw.integers(5)], " ".join(w)))
    rows += [("de", "en"), ("en", "de")] * 40  # words that are names of languages
    return [*rows, *[("en", "copy of a copy of a copy. of a") for _ in range(150)], *[("fr", t) for _, t in ODD]]


ROWS = corpus()


def frame(spark, rows):
    plain = documents(spark, [(i, text) for i, (_, text) in enumerate(rows)]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return plain.withColumnRenamed("key", "n").join(langs, "doc_id")


@pytest.mark.parametrize(("support", "max_words", "covered", "top", "shard"), [(12, 5, 100, 2000, 1 << 27), (12, 5, 100, 2000, 3000), (3, 4, 60, 7, 20_000), (100, 2, 100, 50, 1 << 27)])
def test_phrases_are_those_of_brute_force(spark, support, max_words, covered, top, shard):
    found = collocations.collocations(frame(spark, ROWS), support, max_words, covered, top, shard).collect()
    assert sorted(tuple(r) for r in found) == brute(ROWS, support, max_words, covered, top)
    assert len(found) > 5


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_filter", lambda keys, build=collocations._filter: build(keys, 13))
    found = collocations.collocations(frame(spark, ROWS), 3, 5, 100, 2000, 20_000).collect()
    assert sorted(tuple(r) for r in found) == brute(ROWS, 3, 5, 100, 2000)


def test_no_rows_and_no_words(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, None), (2, ""), (3, " \n .")])
    assert collocations.collocations(blank, support=1).count() == 0


def test_sums_beyond_64_bits(spark):
    many = 3 * 10**14
    frequent = [("en", "a", 1, many), ("en", "b", 1, many - 1), ("en", "a b", 2, many - 7)]
    frame = spark.createDataFrame(frequent, "lang string, phrase string, size int, f long")
    words = spark.createDataFrame([("en", 10**16 + 1)], "lang string, n long")
    (row,) = collocations.score(frame, words).collect()
    assert row.score == 1000 * (many - 7) * (10**16 + 1) // (many * (many - 1))


def test_filter_holds_what_it_was_made_of(spark):
    key = np.random.default_rng(5).integers(-(2**63), 2**63, 30_000)
    made = collocations._filter(spark.createDataFrame([(int(k),) for k in key], "key long").repartition(3))
    held = collocations.Filter(made.value).holds
    assert held(key.view(np.uint64)).all()
    other = np.random.default_rng(6).integers(-(2**63), 2**63, 30_000).view(np.uint64)
    assert held(other).mean() < 0.05


@needs_tables
def test_query_matches_sql(spark):
    sf = SF_DIR.parent / "sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    ours, theirs = QUERIES["op13_collocations"](spark, str(sf)), con.sql(ORACLES["op13_collocations"])
    assert ours.columns == theirs.columns
    rows = sorted(tuple(r) for r in ours.collect())
    assert rows == sorted(theirs.fetchall()) and len(rows) > 20
    assert all(f.dataType.simpleString() in ("bigint", "string") for f in ours.schema)
