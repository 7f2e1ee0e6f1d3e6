import hashlib
from collections import Counter

import numpy as np
import pytest

from inkweave.llm import substrings
from inkweave.llm.substrings import LENGTH, anchors, op1_repeats, remove_repeats

from .conftest import ODD

DOCS = "doc_id bigint, text string, own int, z string, spans int"


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text, by counting all substrings."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(r)])) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 7))))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (20, 40, 45, 60, 90)]
    out = [text(int(rng.integers(0, 150))) for _ in range(30)]
    for _ in range(60):
        p = passages[int(rng.integers(0, 5))]
        cut = int(rng.integers(0, len(p) // 3))
        out.append(text(int(rng.integers(0, 60))) + " " + p[cut : len(p) - int(rng.integers(0, 30))] + text(int(rng.integers(0, 60))))
    base = text(300)
    for _ in range(8):
        words = base.split()
        for _ in range(3):
            words[int(rng.integers(0, len(words)))] = word()
        out.append(" ".join(words))
    out += [base, base, "ab" * 400, "a" * 199, "a" * 200, "a" * 900, passages[4] * 3]
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 32, 4096), (200, 32, 3), (60, 16, 4096), (60, 16, 2)])
def test_removed_bytes_against_all_substrings(spark, length, gram, hot):
    texts = corpus() + ODD
    docs = spark.createDataFrame([(i, t, 1, "z", 2) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length, gram, hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 103, 5000, dtype=np.uint8)) + b"z" * 700
    whole = [x.tolist() for x in anchors(raw)]
    monkeypatch.setattr(substrings, "CHUNK", 333)
    substrings._POWERS.clear()
    assert [x.tolist() for x in anchors(raw)] == whole
    substrings._POWERS.clear()
    at, low, high, _ = whole
    assert low[0] == 0 and high[-1] == len(raw) - LENGTH and [a + 1 for a in high[:-1]] == low[1:]
    assert all(last <= a and a + 32 <= first + LENGTH for a, first, last in zip(at, low, high))


def test_query_nulls_and_repeated_ids(spark, write):
    a, b = "0123456789" * 30, "the quick brown fox jumps over the lazy dog and other animals of the forest " * 5
    rows = [(None, a), (None, None), (4, b), (4, a), (5, "x" + b)]
    folder = write("documents", [(i, t, None, None, None) for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_repeats(spark, folder).collect())
    assert got == sorted((i or 0, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200)))


def test_many_rows_without_an_id_and_a_text_of_megabytes(spark):
    rng = np.random.default_rng(4)
    line = "a line that stands in each of these texts and goes on for so long that it is well over two hundred bytes " * 3
    texts = [f"{rng.integers(10**12)} {line[: int(rng.integers(150, len(line)))]} {rng.integers(10**12)}" for _ in range(400)]
    long = "".join(f"{x:012d} " for x in rng.integers(0, 10**12, 120_000)) + line
    rows = [(None, t) for t in texts] + [(-(2**63), texts[0]), (1, long), (1, "q" + line), (2, line), (2, line)]
    docs = spark.createDataFrame([(i, t, 1, "z", 2) for i, t in rows], DOCS)
    for hot in (1024, 5):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, hot=hot).collect())
        assert got == sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200)))


def test_empty(spark, write):
    assert op1_repeats(spark, write("documents", [], DOCS)).count() == 0
