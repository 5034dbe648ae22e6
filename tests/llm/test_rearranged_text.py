"""Fill-in-middle and line dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from cases import ODD, SF_DIR, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from backhaul.llm import fill_middle, line_dedup
from backhaul.llm.queries import ORACLES, QUERIES

needs_tables = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    return sorted(tuple(str(v) for v in row) for row in rows)


# --- fill in the middle -----------------------------------------------------------------------


def rearranged(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    x = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 80
    output = f"<S>{c}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{c}<M>{b}"
    return doc_id, len(units), "spm" if spm else "psm", len(a), len(b), sha(output), sha(text)


FIM = [
    *ODD,
    *[(100 + i, "  lead <P <S> x" if i % 7 == 0 else f"\tnoél 日本語  {'w ' * (i % 11)}{'tail \n' * (i % 3)}<{i}>") for i in range(80)],
    *[(200 + i, " \n" * i + "x" * (i % 5)) for i in range(40)],
    *[(300 + i, "<" * i + "P> S>M><" * (i % 4)) for i in range(30)],
    (400, "a \U0001f600 b\x00c\x0bd\x0ce\x85f g h"),
    (401, "word " * 400_000),
]


def test_rearranged_texts_are_those_of_brute_force(spark):
    found = fill_middle.digest(fill_middle.transform(documents(spark, FIM))).collect()
    assert plain(found) == plain(rearranged(*row) for row in FIM)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_rates_and_seed_are_parameters(spark):
    frame = documents(spark, [(i, "one two three four") for i in range(50)])
    every = fill_middle.transform(frame, seed=7, rate=100, spm_rate=0).collect()
    assert {r.form for r in every} == {"psm"}
    assert {r.form for r in fill_middle.transform(frame, rate=0).collect()} == {"plain"}
    assert fill_middle.transform(frame.limit(0)).count() == 0


@given(st.lists(st.text("ab \t\n\x0d\x0e\x08\x1f!é日\U0001f600", max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_marks_select_and_rank(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ends = fill_middle.unit_ends(data, offsets)
    want = [int(o) + len(t[: m.end()].encode()) - 1 for o, t in zip(offsets, texts) for m in UNIT.finditer(t)]
    k = np.arange(1, len(want) + 1)
    assert ends.select(k).tolist() == want
    assert ends.rank(np.arange(len(data) + 1)).tolist() == [sum(w < i for w in want) for i in range(len(data) + 1)]
    assert fill_middle.code_points(data).rank(offsets).tolist() == [len(b"".join(raw)[:o].decode()) for o in offsets]


# --- line dedup -------------------------------------------------------------------------------


def deduped(rows, least=10, chars=1):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]+", lambda m: m.group().lower(), line)

    seen = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(doc_id)
    gone = {k for k, ids in seen.items() if len(ids) >= least and len(k) >= chars}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [
    *ODD,
    *[(50, "of one document only\nx") for _ in range(12)],
    *[(100 + i, f"own {i}\n  Shared LINE\t\n\nshared line\r\n Été {i % 2}\nShared line") for i in range(10)],
    *[(200 + i, f"Nine times\n\nÉTÉ\n{i}" + ("\nshared line" if i == 3 else "")) for i in range(9)],
    *[(300 + i, "İI\nonly shared") for i in range(11)],
    (None, "nine TIMES"),
    (401, "\n" * 50_000 + "shared line\n" * 50_000 + "end"),
]


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_ROWS, 0])
def test_lines_are_those_of_brute_force(spark, bound):
    found = line_dedup.drop_shared_lines(documents(spark, LINES), bound=bound).collect()
    assert plain((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == plain(deduped(LINES))


def test_thresholds_are_parameters(spark):
    found = line_dedup.drop_shared_lines(documents(spark, LINES), min_documents=2, min_chars=0).collect()
    assert plain((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == plain(deduped(LINES, 2, 0))
    assert line_dedup.drop_shared_lines(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    frame = line_dedup.digest(line_dedup.drop_shared_lines(documents(spark, LINES)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- the registered queries -------------------------------------------------------------------


@needs_tables
@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_line_dedup"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    ours = QUERIES[name](spark, str(SF_DIR))
    theirs = con.sql(ORACLES[name])
    assert ours.columns == theirs.columns
    assert plain(ours.collect()) == plain(theirs.fetchall())
    kinds = {f.name: f.dataType.simpleString() for f in ours.schema}
    assert all(kind in ("bigint", "string") for kind in kinds.values())
