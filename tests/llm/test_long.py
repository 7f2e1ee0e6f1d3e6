"""Texts of megabytes among small ones: whole results, held against plain counting."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkweave.llm.mixing import op5_mixing
from inkweave.llm.neardup import op8_neardup
from inkweave.llm.packing import op9_packing
from inkweave.llm.quality import op4_quality
from inkweave.llm.secrets import op2_secrets
from inkweave.llm.tokenbin import op6_token_binary
from inkweave.llm.tokens import packed, vocabulary
from inkweave.llm.toxicity import op10_toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    long = " ".join(rng.choice(words, 400_000)) + " token = abcdef123"  # 2.8 MB
    line = "one line only, without an end " * 70_000
    out = [long, long.replace(words[0], "changed"), line, "x" * 2_000_000, "\n" * 1_000_000]
    return out + [" ".join(rng.choice(words, 40)) for _ in range(60)]


@pytest.fixture
def folder(spark, write, texts):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(5, len(texts))]
    write("labels", labels, "doc_id bigint, quality int, toxic int")
    return write("documents", [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOCS)


def test_counts_and_spans(spark, folder, texts):
    secrets = {r.doc_id: r for r in op2_secrets(spark, folder).collect()}
    assert len(secrets) == len(texts) and secrets[0].n_assign == secrets[1].n_assign == 1 and secrets[0].spans.endswith(f":{len(texts[0])}") and secrets[2].n_assign == 0
    quality = {r.doc_id: r for r in op4_quality(spark, folder).collect()}
    sizes = {r.doc_id: r for r in op5_mixing(spark, folder).collect()}
    for i, t in enumerate(texts):
        found = WORD.findall(t)
        assert quality[i].n_words == sizes[i].size == len(found) and quality[i].word_chars == sum(map(len, found)) and sizes[i].taken <= 3 * len(found)
    assert all(0 <= r.score <= 1 for r in op10_toxicity(spark, folder).collect())


def test_near_copies(spark, folder, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_neardup(spark, folder).collect()}
    shingles = lambda w: len({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    assert got[0] == (shingles(texts[0].split()), 0) and got[1][1] == 0 and got[2] == (6, 2) and got[3] == (1, 3) and got[4] == (0, 4)


def test_ids(spark, folder, texts):
    rows = {r.doc_id: r for r in op6_token_binary(spark, folder).collect()}
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for i in (0, 2, 4, 7):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (rows[i].n_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(packed(ids)))
    pieces = op9_packing(spark, folder).collect()
    assert {r.doc_id for r in pieces} == set(range(len(texts))) and all(r.length <= 2048 for r in pieces)
    for i in (0, 4):
        mine = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert [s for s, _, _ in mine] == list(np.cumsum([0, *[n for _, n, _ in mine[:-1]]])) and sum(n for _, n, _ in mine) == mine[0][2]
