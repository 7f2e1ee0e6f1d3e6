"""The CRF against enumeration, and the two operators that use it."""

import itertools
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm import quality, toxicity
from inkweave.llm.crf import Sequences, Steps, marginals, sparse_marginals, train, viterbi

from .conftest import ODD


def paths(u, trans):
    for labels in itertools.product((0, 1), repeat=len(u)):
        yield labels, sum(x for x, y in zip(u, labels) if y) + sum(trans[a][b] for a, b in zip(labels, labels[1:]))


def test_marginals_and_viterbi_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = [3, 1, 5, 0, 2]
    u, trans = rng.normal(size=sum(lengths)), rng.normal(size=(2, 2))
    p, pairs, log_z = marginals(u, trans, Sequences(lengths))
    start, total, expected = 0, 0.0, np.zeros((2, 2))
    for n in lengths:
        if not n:
            continue
        part = u[start : start + n]
        weights = [(y, np.exp(s)) for y, s in paths(part, trans)]
        z = sum(w for _, w in weights)
        total += np.log(z)
        assert np.allclose(p[start : start + n], [sum(w for y, w in weights if y[k]) / z for k in range(n)])
        for y, w in weights:
            for a, b in zip(y, y[1:]):
                expected[a, b] += w / z
        assert max(s for _, s in paths(part, trans)) == dict(paths(part, trans))[tuple(viterbi(part, trans))]
        start += n
    assert np.isclose(log_z, total) and np.allclose(pairs, expected)


def test_stretches_give_the_same_marginals():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, trans, bias = int(rng.integers(1, 40)), rng.normal(size=(2, 2)), float(rng.normal())
        u = np.where(rng.random(n) < 0.3, rng.normal(size=n) * 3, 0.0)
        at = np.flatnonzero(u)
        if len(at):
            whole, _, _ = marginals(u + bias, trans, Sequences([n]))
            assert np.allclose(sparse_marginals(n, at, u[at], Steps(trans, bias)), whole[at])


def test_training_finds_the_signal():
    rng = np.random.default_rng(2)
    y = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.stack([np.ones(300), y + rng.normal(size=300) * 0.3], axis=1)
    w, trans = train(lambda w: x @ w, lambda g: x.T @ g, 2, y, Sequences([100, 100, 100]))
    assert np.mean(np.array(viterbi(x @ w, trans)) == y) > 0.97


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "#|", "é😀", "\n", "\x1c"]), max_size=40), st.sampled_from([" ", "\t", "  \r"]))
def test_base_counts(parts, space):
    text = space.join(parts)
    got = quality.judge(1, text, None)
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    assert got[1:6] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated))
    assert got[6] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


DOCS = "doc_id bigint, text string, score double"
LABELS = "doc_id bigint, quality int, toxic int, text string"
WORDS = "the of river stone cloud green window silent paper orange garden winter copper meadow lantern".split()


def corpus(n=240):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choice(WORDS, 14)) + "." for _ in range(8)]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            lines[3] += " vilelord meanie"
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines] if i % 2 else ["### ".join(x.split()) for x in lines]
        docs.append((i, "\n".join(lines), None))
        labels.append((i, 0 if bad else 1, int(toxic), None))
    return docs, labels


def test_op4_keeps_clean_and_drops_junk(spark, write):
    docs, labels = corpus()
    docs += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    write("labels", labels + [(None, 0, 0, None), (5, None, None, None)], LABELS)
    rows = {r.doc_id: r for r in quality.op4_quality(spark, write("documents", docs, DOCS)).collect()}
    assert len(rows) == len(docs)
    assert all(rows[i].kept == (q == 1) for i, q, _, _ in labels)
    assert all(rows[1000 + i].base_failed for i in range(len(ODD)) if i != len(ODD) - 1)


def test_op10_finds_held_out_toxic_documents(spark, write):
    docs, labels = corpus()
    docs += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    write("labels", labels + [(None, 0, 1, None), (5, None, None, None)], LABELS)
    folder = write("documents", docs, DOCS)
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    assert len(rows) == len(docs)
    for i, _, toxic, _ in labels:
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert rows[i].predicted == toxic and 0 <= rows[i].score <= 1
        if toxic and i % 3:
            text = docs[i][1]
            assert "vilelord meanie" in [text[int(s) : int(e)] for s, e in (x.split(":") for x in rows[i].spans.split(","))]
    assert all(rows[1000 + i].predicted == 0 for i in range(len(ODD)))
    kept = toxicity.drop_toxic(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in rows.items() if not r.predicted)


def test_labels_of_one_kind_or_none(spark, write):
    docs, labels = corpus(20)
    folder = write("documents", docs, DOCS)
    write("labels", [(i, 1, 0, None) for i, *_ in labels], LABELS)
    assert all(r.predicted == 0 for r in toxicity.op10_toxicity(spark, folder).collect())
    write("labels", [], LABELS)
    assert all(0 <= r.score < 0.3 for r in toxicity.op10_toxicity(spark, folder).collect())
    assert len(quality.op4_quality(spark, folder).collect()) == 20
    write("documents", [], DOCS)
    assert not quality.op4_quality(spark, folder).count() and not toxicity.op10_toxicity(spark, folder).count()
