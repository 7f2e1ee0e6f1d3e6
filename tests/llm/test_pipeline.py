"""The mix against counting, and each stage of the pipeline against brute force."""

import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import functions as F

import corpus_pipeline
from inkweave.llm import tokens
from inkweave.llm.mixing import mix, mixed_documents, op5_mixing, shard_quotas, targets
from inkweave.llm.neardup import _sketches
from inkweave.llm.secrets import base_spans
from inkweave.llm.tokens import WordIds, encoder, vocabulary

from .conftest import ODD
from .test_neardup import brute as brute_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=300):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(5, 120))))
        if i % 10 == 9:
            text = rows[-1][1] + " " + str(rng.choice(words))
        if i % 6 == 0:
            text = "vilelord " + text + " meanie vilelord"
        if i % 7 == 0:
            text += f" password = hunter{i}xyz"
        source = None if i % 50 == 3 else f"s{min(int(rng.integers(0, 12)), 5)}"
        rows.append((i, text, "en", source, len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    return rows + [(1000 + i, t, None, "odd", None) for i, t in enumerate(ODD)], labels


def test_targets_by_resharing(spark):
    sizes = {"a": 100, "b": 4000, "c": 10, "d": 0, "é": 500, None: 60}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in targets(frame).collect()}
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, open_ = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / open_ > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    expected = fixed | {s: left * weight[s] / open_ for s in free}
    assert got.keys() == expected.keys()
    assert all(abs(got[s] - expected[s]) < 1e-9 * max(1, expected[s]) for s in got)


def test_quotas_are_exact_and_spread_like_draws_without_replacement(spark):
    draws = spark.createDataFrame([(1, 300), (2, 90), (3, 10), (4, 0)], "source_no int, n_draws bigint")
    got = defaultdict(dict)
    for r in shard_quotas(draws, 7, "x").collect():
        got[r.source_no][r.shard] = (r.first, r.n)
    sizes = Counter()
    for source, n in ((1, 300), (2, 90), (3, 10)):
        at = 0
        for shard, (first, k) in sorted(got[source].items()):
            assert first == at
            at += k
            sizes[shard] += k
        assert at == n
    assert 4 not in got and max(sizes.values()) - min(sizes.values()) <= 2
    halves = [next((r.n for r in shard_quotas(draws, 2, f"s{k}").collect() if r.source_no == 2 and r.shard == 0), 0) for k in range(40)]
    assert abs(np.mean(halves) - 45) < 3 and 2 < np.std(halves) < 7  # 45 and 4.2 by the distribution


def test_op5_takes_the_targets(spark, write):
    rows, _ = corpus()
    folder = write("documents", rows, DOCS)
    got = op5_mixing(spark, folder).collect()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    taken, goal, size = Counter(), {}, Counter()
    for r in got:
        assert r.size == len(WORD.findall(text[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        goal[source[r.doc_id]] = r.target
    assert len(got) == len(rows) and all(taken[s] == round(goal[s]) for s in goal)
    assert all(r.source_size == size[source[r.doc_id]] for r in got)
    assert sorted(got) == sorted(op5_mixing(spark, folder).collect())


def test_mixed_rows_are_the_draws(spark):
    rows, _ = corpus(120)
    docs = spark.createDataFrame(rows, DOCS)
    drawn = {r.doc_id: sorted(x.words for x in r.draws) for r in mix(docs).collect()}
    text, got = {r[0]: r[1] for r in rows}, defaultdict(list)
    for r in mixed_documents(docs).collect():
        assert (text[r.doc_id] or "").startswith(r.text)
        got[r.doc_id].append(len(WORD.findall(r.text)))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in drawn.items() if x}


def test_mixed_rows_lie_by_shard_in_the_order_of_the_mix(spark):
    rows, _ = corpus(200)
    docs = spark.createDataFrame(rows, DOCS)
    shards = defaultdict(list)
    for r in mix(docs, shards=5).collect():
        for x in r.draws:
            shards[x.shard].append((x.place, r.doc_id, x.words))
    expected = {tuple((i, n) for _, i, n in sorted(x)) for x in shards.values()}
    parts = defaultdict(list)
    for r in mixed_documents(docs, shards=5).select("doc_id", "text", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect():
        parts[r.p].append((r.doc_id, len(WORD.findall(r.text))))
    assert len(expected) == 5
    for part in parts.values():  # some shards, one after the other
        while part:
            run = next(x for x in expected if tuple(part[: len(x)]) == x)
            expected.remove(run)
            part[: len(run)] = []
    assert not expected


def test_rows_without_an_id_and_repeated_ones_are_drawn_by_themselves(spark):
    rows = [(None, f"{k} one two three", "en", "a", 5) for k in range(40)] + [(7, "same row here", "en", "a", 3)] * 6 + [(8, "other", "en", "a", 1), (8, "text", "en", "a", 1)] + [(100 + i, "word " * 30, "en", "b", 9) for i in range(20)]
    docs, sizes, taken = spark.createDataFrame(rows, DOCS), Counter(), Counter()
    got = mix(docs).collect()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += sum(x.words for x in r.draws)
    assert len(got) == len(rows) and sizes == {"a": 40 * 4 + 6 * 3 + 2, "b": 600}
    assert {r.source: round(r.target) for r in got} == taken
    mixed = Counter()
    for r in mixed_documents(docs).collect():
        mixed[r.source] += len(WORD.findall(r.text))
    assert mixed == taken


def test_stages(spark, write):
    rows, labels = corpus()
    write("labels", labels, LABELS)
    folder = write("documents", rows, DOCS)
    docs, at = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "packing":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        at[name] = after.collect()
        docs = spark.createDataFrame(at[name], after.schema)
    text = {r[0]: r[1] for r in rows}
    clean = [i for i in text if not (i < 300 and i % 6 == 0) and "vilelord" not in (text[i] or "")]
    assert sorted(r.doc_id for r in at["toxicity"]) == sorted(clean)
    groups = brute_components([(i, text[i]) for i in clean], 5)
    kept = sorted(i for i in clean if groups[i][1] == i)
    assert sorted(r.doc_id for r in at["near_dedup"]) == kept and len(kept) < len(clean)
    assert sorted(r.doc_id for r in at["secrets"]) == kept
    for r in at["secrets"]:
        assert not base_spans(r.text or "") and (r.text == text[r.doc_id]) == (not base_spans(text[r.doc_id] or ""))
    words = Counter()
    for r in at["mixing"]:
        words[r.source] += len(WORD.findall(r.text))
    goal = {r.source: r.target for r in targets(spark.createDataFrame([(r.source, len(WORD.findall(r.text or ""))) for r in at["secrets"]], "source string, size bigint")).collect()}
    assert all(words[s] == round(goal[s]) for s in goal)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in at["mixing"])
    assert sum(r.length for r in at["packing"]) == total
    assert len(corpus_pipeline.run(spark, folder).collect()) > 0


def _functions(monkeypatch, *stages):
    """What the stages give to mapInArrow."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(pyspark.sql.classic.dataframe.DataFrame, "mapInArrow", lambda self, f, *_: found.append(f) or self)
        for stage in stages:
            stage()
    return found


def test_stages_before_packing_drop_its_words(spark, write, monkeypatch):
    """Workers outlive a stage: what packing has kept would lie beside all that the next run's stages need."""
    rows, labels = corpus(20)
    folder = write("labels", labels, LABELS)
    docs = spark.createDataFrame(rows, DOCS)
    stages = _functions(monkeypatch, lambda: corpus_pipeline.toxicity(spark, docs, folder), lambda: corpus_pipeline.secrets(spark, docs, folder))
    for run in [*stages, _sketches(5)]:
        encoder(WordIds, vocabulary("word_bpe_49k.json"))(["some words"])
        assert tokens._LOADED
        assert list(run(iter([]))) == []
        assert not tokens._LOADED


def test_packing_keeps_few_words_and_packs_the_same(spark, monkeypatch):
    rows, _ = corpus(60)
    docs = spark.createDataFrame(rows, DOCS)
    batches = [pa.RecordBatch.from_pylist([{"doc_id": r[0], "text": r[1]} for r in rows[i : i + 10]]) for i in range(0, len(rows), 10)]
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    results = []
    for words in (corpus_pipeline.WORDS, 100):
        monkeypatch.setattr(corpus_pipeline, "WORDS", words)
        (run,) = _functions(monkeypatch, lambda: corpus_pipeline.packing(spark, docs, ""))
        tokens._LOADED.clear()
        results.append([x for batch in run(iter(batches)) for x in batch.to_pylist()])
        (encode,) = tokens._LOADED.values()
        assert encode.cached == words < WordIds.cached
    most = max(len({w for x in batch.column("text").to_pylist() for w in encode._pieces(x or "") or []}) for batch in batches)
    assert len(encode.cache) <= 100 // 2 + most and len(encode.before) <= 100 // 2 + most
    assert results[0] == results[1] and sum(x["length"] for x in results[0]) == sum({x["doc_id"]: x["doc_tokens"] for x in results[0]}.values())


def test_empty(spark, write):
    write("labels", [], LABELS)
    assert corpus_pipeline.run(spark, write("documents", [], DOCS)).count() == 0
    assert op5_mixing(spark, write("documents", [], DOCS)).count() == 0
