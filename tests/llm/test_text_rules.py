"""Line rules, chain fields, quality classifier and language id."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from cases import ODD, SF_DIR, documents

from backhaul.llm import chain, language_id, line_rules, pii, quality_classifier
from backhaul.llm.queries import QUERIES

needs_tables = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(runs)
    hit = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words),
    )


TEXTS = [
    *ODD,
    (20, "é ü #a\n#a b\n#a b\n \n\n" + "one two three four five six seven eight nine " * 3),
    (21, "\n".join(["same line here"] * 5)),
    (22, "x\x0by\x0cz\r\nq\tr " * 9),
]


def test_counts_are_those_of_brute_force(spark):
    rows = line_rules.judge(documents(spark, TEXTS), line_rules.DEFAULT).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(d), *counts(t)) for d, t in TEXTS)
    assert not any(r.kept for r in rows if r.base_failed)


def test_keep_agrees_with_judge(spark):
    frame = documents(spark, TEXTS)
    kept = line_rules.keep(frame, line_rules.DEFAULT)
    assert kept.columns == frame.columns
    verdict = line_rules.judge(frame, line_rules.DEFAULT).where("kept")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in verdict.collect())
    lines = line_rules.label_lines(frame, line_rules.DEFAULT).where("doc_id = 21")
    assert [r.line for r in lines.orderBy("line").collect()] == [0, 1, 2, 3, 4]


def test_nothing_labelled_and_nothing_there(spark):
    frame = documents(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert line_rules.train(frame, none) is line_rules.DEFAULT
    assert line_rules.judge(documents(spark, []), line_rules.DEFAULT).count() == 0
    scored = quality_classifier.score(frame, none).collect()
    assert {r.score for r in scored} == {0.5} and len(scored) == len(TEXTS)
    assert quality_classifier.score(documents(spark, []), none).count() == 0


@pytest.fixture
def field():
    draw = np.random.default_rng(0)
    first = np.array([0, 3, 3, 4, 9])
    features = draw.normal(size=(9, 2))
    return chain.Chain(draw.normal(size=2), draw.normal(size=(2, 2))), features, first


def path_score(model, features, labels):
    emitted = sum(features[i] @ model.weights for i, y in enumerate(labels) if y)
    return emitted + sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))


def test_viterbi_finds_the_best_path(field):
    model, features, first = field
    found = chain.viterbi(model, features, first)
    for a, b in zip(first, first[1:]):
        paths = list(itertools.product([0, 1], repeat=b - a))
        best = max(path_score(model, features[a:b], p) for p in paths)
        assert path_score(model, features[a:b], found[a:b].tolist()) == pytest.approx(best)


def test_gradient_is_that_of_the_likelihood(field):
    model, features, first = field
    labels = np.array([0, 1, 1, 0, 1, 0, 0, 1, 1])
    value, slope, moves = chain.gradient(model, features, labels, first)
    total = 0.0
    for a, b in zip(first, first[1:]):
        scores = [path_score(model, features[a:b], p) for p in itertools.product([0, 1], repeat=b - a)]
        total += path_score(model, features[a:b], labels[a:b].tolist()) - np.log(np.exp(scores).sum())
    assert value == pytest.approx(total)
    for k in range(2):
        step = np.zeros(2)
        step[k] = 1e-5
        up, _, _ = chain.gradient(chain.Chain(model.weights + step, model.moves), features, labels, first)
        assert (up - value) / 1e-5 == pytest.approx(slope[k], abs=1e-3)
        for j in range(2):
            bump = np.zeros((2, 2))
            bump[k, j] = 1e-5
            up, _, _ = chain.gradient(chain.Chain(model.weights, model.moves + bump), features, labels, first)
            assert (up - value) / 1e-5 == pytest.approx(moves[k, j], abs=1e-3)


@needs_tables
def test_rules_keep_clean_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_line_rules"](spark, str(SF_DIR)).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert sum(not r.kept for r in rows if labels[r.doc_id] == 0) > 0


@needs_tables
def test_quality_scores_rank_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_quality_classifier"](spark, str(SF_DIR)).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if labels[r.doc_id]]
    poor = [r.score for r in rows if not labels[r.doc_id]]
    assert np.mean([g > p for g in good for p in poor]) > 0.85


@needs_tables
def test_languages_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op6_language_id"](spark, str(SF_DIR)).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.95


def test_language_of_odd_texts(spark):
    frame = documents(spark, ODD).withColumn("lang", language_id.F.when(language_id.F.col("doc_id") < 7, "aa").otherwise("bb"))
    counts = language_id.train(frame)
    assert counts.languages == ["aa", "bb"]
    rows = language_id.predict(frame, counts).collect()
    assert len(rows) == len(ODD)
    texts = dict(ODD)
    for r in rows:
        letter = any(c.isalpha() for d, t in ODD if d == r.doc_id for c in t or "")
        if not letter:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in rows if r.doc_id == 8} == {"bb"} and texts[8]
    empty = language_id.train(documents(spark, []))
    assert {(r.lang_pred, r.score) for r in language_id.predict(frame, empty).collect()} == {("und", 0.0)}


def slow_length(counts, text):
    """Code length of a text under one language, byte by byte, straight from the definition."""
    seen = {10}
    grams = Counter()
    for g, n in zip(counts.grams[0].tolist(), counts.n[0].tolist()):
        parts = [g >> 24 & 255, g >> 16 & 255, g >> 8 & 255, g & 255]
        seen.update(parts)
        for k in range(4):
            grams[tuple(parts[k:])] += n
    size = len(seen) + 1

    def probability(context, byte):
        follow = {k[-1]: n for k, n in grams.items() if len(k) == len(context) + 1 and k[:-1] == context}
        total, kinds = sum(follow.values()), len(follow)
        below = (lambda b: probability(context[1:], b)) if context else (lambda b: 1 / 256)
        if not follow:
            return below(byte)
        if byte in follow:
            return follow[byte] / (total + kinds)
        spare = 256 - size + 1
        rest = sum(below(b) for b in seen if b not in follow) + spare * below(-1)
        return kinds / (total + kinds) * below(byte) / rest

    padded = (10, 10, 10, *text)
    return -sum(np.log2(probability(tuple(padded[i : i + 3]), padded[i + 3] if padded[i + 3] in seen else -1)) for i in range(len(text)))


def test_code_lengths_are_exact():
    text = b"abracadabra abba"
    padded = b"\n\n\n" + text
    grams = Counter(int.from_bytes(padded[i : i + 4], "big") for i in range(len(text)))
    keys = np.array(sorted(grams))
    counts = language_id.Counts(["xx"], [keys], [np.array([grams[k] for k in keys])])
    tables = language_id.Tables(counts)
    for probe in (text, b"cab zebra!", b""):
        data = np.frombuffer(probe, np.uint8)
        found = tables.code_lengths(data, np.array([0, len(data)]))[0, 0]
        assert found == pytest.approx(slow_length(counts, probe), rel=1e-5)


def test_pruned_tables_still_sum_to_one():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 4, (400, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]) + 0x61616161)
    counts = language_id.Counts(["xx"], [keys], [draw.integers(1, 9, len(keys))])
    for cells in (1, 60, 200, 10_000):
        tables = language_id.Tables(counts, cells)
        p = np.exp2(-tables.bits.reshape(-1, tables.size))
        p[:, 0] *= 256 - tables.size + 1
        assert p.sum(1) == pytest.approx(1, abs=1e-4)


# --- samples ----------------------------------------------------------------------------------


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    # One id on most rows, some of them repeated, and rows without an id.
    rows = [(1, f"mail a{i}@b.example now") for i in range(40)] + [(1, "mail a0@b.example now")] * 10
    rows += [(i, f"mail b{i}@c.example now") for i in range(2, 8)] + [(None, "mail d@e.example now")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    assert line_rules._training_lines(docs, labels, 5).count() == 5
    assert line_rules._training_lines(docs, labels, 100).count() == 46
    counts = language_id.train(docs, per_language=5)
    assert counts.n[0].sum() <= 5 * len(max((t for _, t in rows), key=len))
    seen = []
    find = pii.candidates
    monkeypatch.setattr(pii, "candidates", lambda texts, *keep: seen.append(texts.count()) or find(texts, *keep))
    pii.train(docs, sample=5)
    pii.train(docs, sample=100)
    assert seen == [5, 47]


def test_personal_data_is_learnt_from_every_document(spark, monkeypatch):
    # More documents than the trees once learnt from; some come twice, which counts once.
    rows = [(i, f"mail a{i}@b.example or +1 555 {100 + i % 900} {1000 + i} now, not +1 -- 2{i % 7}") for i in range(3200)]
    docs = documents(spark, rows + rows[:100])
    seen, taught = [], []
    find, keep = pii.candidates, pii.stored
    monkeypatch.setattr(pii, "candidates", lambda texts, *row: seen.append(texts.count()) or find(texts, *row))

    def kept(df, label):
        out = keep(df, label)
        taught.append(out.groupBy("kind", "label").count().collect())
        return out

    monkeypatch.setattr(pii, "stored", kept)
    pii.train(docs)
    assert seen == [3300]
    email, phone = pii.KINDS.index("email"), pii.KINDS.index("phone")
    n = {(r.kind, r.label): r["count"] for r in taught[0]}
    # An address teaches itself and a respelt form; a number itself, another form, and two decoys.
    assert n[email, 1.0] == 2 * 3200 and n[phone, 1.0] == 2 * 3200 and n[phone, 0.0] >= 3 * 3200
