import itertools
import re

import numpy as np
import pytest

from inkweave.llm.graph import components
from inkweave.llm import neardup
from inkweave.llm.neardup import joint_estimate, near_duplicates, op8_neardup, overlaps, registers, shingles

from .conftest import ODD

DOCS = "doc_id bigint, text string, node int, z string, component_id int, n_shingles int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k):
    """doc_id to (n_shingles, component_id) by comparing all pairs."""
    sets = {i: words_of(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed=3):
    """Chains of copies that drift apart, exact copies, short texts and a passage that many texts share."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(4000)]
    text = lambda n: list(rng.choice(vocabulary, n))
    out = []
    for _ in range(25):
        words = text(int(rng.integers(8, 200)))
        for _ in range(int(rng.integers(1, 9))):
            words = list(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 25))):
                words[int(rng.integers(0, len(words)))] = str(rng.choice(vocabulary))
            out.append(" ".join(words))
            if rng.random() < 0.3:
                out.append("\n".join(words).upper())
    passage = text(40)
    for n in (4, 8, 12):
        out += [" ".join(passage + text(n)) for _ in range(30)]
    out += [" ".join(text(n)) for n in (1, 1, 2, 3, 4, 5)] + ["one two", "One TWO", "ONE two  "]
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)) * 3, out)]


@pytest.mark.parametrize(("seed", "block"), [(3, 1024), (4, 5)])
def test_components_against_all_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(seed) + [(10_000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, "z", 2, 3) for i, t in rows], DOCS)
    expected = brute(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 4).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in expected.items()}
    assert sum(i != c for i, (_, c) in expected.items()) > 60


def test_query_nulls_and_repeated_ids(spark, write):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, None), (7, text), (7, text), (9, text + " more"), (11, "other words stand here now"), (9, "other words stand here now"), (12, None), (13, "")]
    folder = write("documents", [(i, t, None, None, None, None) for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in op8_neardup(spark, folder).collect())
    assert got == [(0, 0, True), (0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False), (9, 7, False), (11, 7, False), (12, 12, True), (13, 13, True)]


def brute_rows(rows, k):
    """(doc_id, n_shingles, component_id, kept) of rows whose doc_ids repeat: those are one document."""
    sets = [words_of(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None and s], 2):
        both = len(x & y)
        if 100 * both >= 80 * (len(x) + len(y) - both):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((i is None, i or 0, len(s), root(i) if s and i is not None else i, i is None or not s or root(i) == i) for (i, _), s in zip(rows, sets))


def test_ids_that_repeat_over_different_texts(spark):
    rng = np.random.default_rng(12)
    text = lambda: [str(x) for x in rng.integers(0, 10**9, 60)]
    rows = []
    for g in range(6):  # the smallest id of two classes, each with a near copy of its own
        a, b = text(), text()
        rows += [(100 * g + 1, " ".join(a)), (100 * g + 1, " ".join(b)), (100 * g + 20, " ".join([*a[:-1], "x"])), (100 * g + 30, " ".join([*b[:-1], "y"]))]
    for _ in range(40):  # ids that meet anyhow
        a, i = text(), int(rng.integers(1000, 1030))
        rows += [(i, " ".join(a)), (int(rng.integers(1000, 1030)), " ".join([*a[:-1], "z"])), (None, " ".join(a))]
    rows += [(1, " ".join(text())), (1, None), (1, ""), (2**63 - 5, rows[0][1]), (-(2**63), " ".join(text())), (-(2**63), rows[1][1])]
    docs = spark.createDataFrame([(i, t, 1, "z", 2, 3) for i, t in rows], DOCS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 4).collect())
    assert [x[:3] for x in got] == [x[:3] for x in brute_rows(rows, 4)]
    assert got == brute_rows(rows, 4)


def test_empty(spark, write):
    assert op8_neardup(spark, write("documents", [], DOCS)).count() == 0


def test_registers_merge_and_estimate():
    a, b = shingles(" ".join(map(str, range(1000))), 1), shingles(" ".join(map(str, range(250, 1250))), 1)
    ra, rb = registers(a), registers(b)
    assert (registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()
    d = (ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum()
    j = joint_estimate(*(np.array([float(x)]) for x in (*d, 1000, 1000)))
    assert abs(j[0] - 0.6) < 0.15


def test_overlaps_of_blocks():
    rng = np.random.default_rng(8)
    left, right = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 30, 60), (10, 0, 40)))
    expected = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert overlaps(left, right, 7).tolist() == expected and overlaps([], right).shape == (0, 3)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (3, 5)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).select("node", "label").collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3}
