"""Ids, packing and binary shards against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkweave.llm.packing import Packer, op9_packing, pack_conversations
from inkweave.llm.tokenbin import Shard, compress, op6_token_binary, write_shard
from inkweave.llm.tokens import ByteIds, WordIds, encoder, packed, vocabulary

from .conftest import ODD

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int"
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


#: The library's tokenizers as they are loaded, with nothing set.
LIBRARY = {name: Tokenizer.from_file(vocabulary(name)) for name in (BYTES, WORDS)}


def plain(name, text):
    return LIBRARY[name].encode(text, add_special_tokens=False).ids


PARTS = [*"ab'sT 1\n\t\r\x1c\x85\xa0é.!<|>Σ́😀,_²Ł\0“”’\u1680\u2003\u2028\u202f\u3000\u200b\u180e\ufeffДか가İſK", "  ", ",\n\xa0\xa0", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "word", "l’été"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@example("Ł\n\xa0\x851")
@example("“Да”,\n\xa0\xa0сказал")
@example("l’été\n\xa0\xa0suite")
@example("x<|endoftext|>y")
@example("x <|ENDOFTEXT|> y")
def test_cached_words_give_the_librarys_ids(text):
    for kind, name in ((ByteIds, BYTES), (WordIds, WORDS)):
        assert encoder(kind, vocabulary(name))([text, text + "x", "y z"])[0] == packed(plain(name, text))


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text_gives_the_librarys_ids(text):
    text = text.encode("utf-8", "replace").decode()
    for kind, name in ((ByteIds, BYTES), (WordIds, WORDS)):
        assert encoder(kind, vocabulary(name))([text])[0] == packed(plain(name, text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PARTS, " ", "é.", "word.", " Да"]), max_size=8).map("".join), max_size=12))
@example(["", "", "a.b,c\nd e", "", "“Да”, e", " a", "a.b,c\nd e"])
def test_texts_of_one_call_keep_to_their_own_ids(texts):
    """Also where the cache turns over within and between calls."""
    encode = encoder(ByteIds, vocabulary(BYTES))
    encode.cached = 8
    try:
        assert encode(texts) == [packed(plain(BYTES, t)) for t in texts]
    finally:
        del encode.cached


class Lookups(dict):
    n = 0

    def __getitem__(self, word):
        self.n += 1
        return super().__getitem__(word)

    def get(self, word, default=None):
        self.n += 1
        return super().get(word, default)


def test_each_piece_of_a_call_is_looked_up_once():
    """What op6_token_binary has to do in Python goes by different words, not by words."""
    encode, text = ByteIds(vocabulary(BYTES)), "one two, three. four\nünf " * 500 + "end"
    encode.cache = Lookups()
    for lookups in (20, 30):  # 10 different pieces: looked up, learned and fetched; then looked up
        assert encode([text, "one two", text]) == [packed(plain(BYTES, t)) for t in (text, "one two", text)]
        assert encode.cache.n <= lookups


class Unwalked(dict):
    def __iter__(self):
        raise AssertionError("a call walks all words of the cache before")


def test_the_cache_before_is_asked_for_words_and_not_walked():
    for kind, name in ((ByteIds, BYTES), (WordIds, WORDS)):
        encode = kind(vocabulary(name))
        encode(["one two three"])
        encode.cache, encode.before = {}, Unwalked(encode.cache)
        assert encode(["one two four"]) == [packed(plain(name, "one two four"))]
        assert encode.cache["two"] is encode.before["two"] and "three" not in encode.cache


def test_special_strings_as_ordinary_text():
    own = Tokenizer.from_file(vocabulary(BYTES))
    own.encode_special_tokens = True
    for text in ("x<|endoftext|>y", "a <|endoftext|> b", "plain text"):
        assert encoder(ByteIds, vocabulary(BYTES), True)([text])[0] == packed(own.encode(text, add_special_tokens=False).ids)
    assert len(plain(BYTES, "x<|endoftext|>y")) == 3


def test_long_texts_give_the_librarys_ids():
    for text in ("a word or two, and a stop. " * 60_000, "Ł’été\n\xa0\xa0suite " * 40_000, "x" * 200_000):
        for kind, name in ((ByteIds, BYTES), (WordIds, WORDS)):
            assert encoder(kind, vocabulary(name))([text])[0] == packed(plain(name, text))


@pytest.fixture
def docs(write):
    texts = [*ODD, "word " * 5000, *[f"number {i} of many small documents" for i in range(300)]]
    return write("documents", [(i, t, "en", "s", 0, 7) for i, t in enumerate(texts)], DOCS), texts


def test_op6_reads_back_what_the_library_gives(spark, docs):
    folder, texts = docs
    start, expected = 0, []
    for i, t in enumerate(texts):
        ids = [*plain(BYTES, t or ""), 0]
        expected.append((i, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(map(tuple, op6_token_binary(spark, folder).collect())) == expected


def test_op9_pieces_cover_every_id_once(spark, docs):
    folder, texts = docs
    rows = op9_packing(spark, folder).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = [*plain(WORDS, t or ""), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(packed(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        assert sum(r.loss_tokens for r in pieces) <= 2016 and len(pieces) <= 256
    for r in rows:
        assert r.loss_tokens == r.length - min(r.length, max(0, 32 - r.start))
    full = sum(sum(r.length for r in p) for p in by_sequence.values())
    assert full > 0.9 * 2048 * (len(by_sequence) - 2)
    assert max(sum(r.loss_tokens for r in p) for p in by_sequence.values()) == 2016  # the limit binds


def test_conversations_bear_loss_in_the_answers(spark):
    rng = np.random.default_rng(8)
    talks = {c: [("user" if t % 2 == 0 else "assistant", "word " * int(rng.integers(0, 90))) for t in range(int(rng.integers(1, 7)))] for c in range(60)}
    talks[60] = [("user", "long " * 3000), ("assistant", "answer " * 5000), ("user", None)]
    rows = [(c, t, role, text, 1) for c, turns in talks.items() for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(int(c), int(t), role, text, 1) for c, t, role, text, _ in rows], "conv_id bigint, turn bigint, role string, text string, doc_id int")
    got, sequences = {}, {}
    for r in pack_conversations(frame, vocabulary(WORDS)).collect():
        got.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(got) == sorted(talks)
    for c, turns in talks.items():
        ids = [(i, role == "assistant") for role, text in turns for i in [*plain(WORDS, text or ""), 1]]
        at = 0
        for r in sorted(got[c], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32, r.loss_tokens) == (at, len(ids), zlib.crc32(packed([i for i, _ in part])), sum(x for _, x in part))
            at += r.length
        assert at == len(ids) and (len(got[c]) == 1 or len(ids) > 2048)
    for pieces in sequences.values():
        assert sum(r.length for r in pieces) <= 2048 and sum(r.loss_tokens for r in pieces) <= 2016


def test_packer_holds_all_limits():
    rng = np.random.default_rng(3)
    pack = Packer(100, 4, 50)
    items = [(int(t), int(min(t, rng.integers(0, 51))), k) for k, t in enumerate(rng.integers(1, 100, 500))]
    for t, x, k in items:
        pack.add(t, x, k)
    bins = list(pack.bins(True))
    assert sorted(k for b in bins for _, _, k in b) == list(range(500))
    for b in bins:
        assert sum(t for t, _, _ in b) <= 100 and len(b) <= 4 and sum(x for _, x, _ in b) <= 50
    least = max(sum(t for t, _, _ in items) / 100, 500 / 4, sum(x for _, x, _ in items) / 50)
    assert len(bins) < 1.3 * least


def test_op6_with_repeated_extreme_and_null_ids(spark, write):
    rows = [(None, "none"), (None, "other"), (None, None), (-(2**63), "least"), (5, "b"), (5, "a"), (5, "a"), (2**63 - 1, "most")]
    folder = write("documents", [(d, t, "en", "s", 0, 7) for d, t in rows], DOCS)
    got = sorted((tuple(r) for r in op6_token_binary(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, None, -(2**63), 5, 5, 5, 2**63 - 1]
    assert [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got[:-1]]]))
    expected = sorted((str(d), len(ids := [*plain(BYTES, t or ""), 0]), zlib.crc32(packed(ids))) for d, t in rows)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == expected
    assert got == sorted((tuple(r) for r in op6_token_binary(spark, folder).collect()), key=lambda r: r[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=300), max_size=6), st.integers(0, 100), st.integers(0, 100))
def test_shards_round_trip(docs, a, b):
    blob = write_shard([packed(d) for d in docs], list(range(len(docs))), 6)
    shard, ids = Shard(blob), [x for d in docs for x in d]
    assert shard.ids(0, len(ids)).tolist() == ids
    a, b = min(a, len(ids)), min(b, len(ids))
    assert shard.ids(a, b).tolist() == ids[a:b]


def test_grammar_shrinks_repeats():
    rng = np.random.default_rng(1)
    seq = np.tile(rng.integers(0, 50, 200), 500).astype(np.uint32)
    symbols, rules = compress(seq, 50)
    assert len(symbols) + 2 * len(rules) < len(seq) / 8


def test_empty_tables(spark, write):
    folder = write("documents", [], DOCS)
    assert op6_token_binary(spark, folder).count() == 0
    assert op9_packing(spark, folder).count() == 0
