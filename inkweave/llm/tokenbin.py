"""Token ids as binary shards, compressed by Re-Pair grammars.

Documents are dealt into ranges of doc_id and sorted there; each range writes shards of about ``SHARD`` ids. In a
shard, frequent pairs of neighbouring symbols are replaced by new symbols, round after round; a round counts all pairs,
takes the most frequent ones and replaces them from left to right without overlap. A shard is one blob::

    4 bytes "RPG1", then unsigned 32-bit: ids below this are tokens, rules, symbols, documents, width of a symbol
    rules: two symbols each; expansion lengths, 32-bit; symbols; doc_ids, 64-bit signed (0 if null); ids of each document, 64-bit; 1 for each null doc_id, 8-bit

all little-endian, symbols of 2 or 4 bytes. With the expansion lengths a reader finds the symbol that holds the n-th
id without expanding those before it (:meth:`Shard.ids`). Blobs are rows of Parquet files that Spark commits, so that a task
which runs again leaves no second copy, and any store that Spark writes to will do.

Null texts are empty documents: the end id alone. Null doc_ids come first and are read back as null. Repeated rows stay. Rows that share a doc_id (or
have none) are ordered by a hash of their text and by the text, and the ranges go by the hash too, so that one doc_id may fill any number of them.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, stored, table
from .tokens import ByteIds, encoder, slices, vocabulary

SHARD = 1 << 20
PAIRS, LEAST, WORTH = 2048, 32, 0.05
MAGIC = b"RPG1"
FILES = "part int, shard int, n_docs bigint, n_tokens bigint, blob binary"
DOCS = "part int, shard int, place bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"


def frequent_pairs(seq, pairs: int, least: int):
    """The most frequent neighbouring pairs, as a << 32 | b, most frequent first; each occurs ``least`` times. Pairs are
    counted by a 16-bit hash first, and exactly in the fullest cells after that."""
    import numpy as np

    a, b = seq[:-1], seq[1:]
    cell = ((a * np.uint32(2654435761)) ^ (b * np.uint32(2246822519))) >> np.uint32(16)
    counts = np.bincount(cell, minlength=1 << 16)
    bar = max(least, int(np.partition(counts, -pairs)[-pairs]))
    at = np.flatnonzero((counts >= bar)[cell])
    keys, n = np.unique((a[at].astype(np.uint64) << np.uint64(32)) | b[at], return_counts=True)
    order = np.lexsort((keys, -n))[:pairs]
    return keys[order][n[order] >= least]


def compress(seq, base: int, pairs: int = PAIRS, least: int = LEAST, worth: float = WORTH):
    """Symbols and rules (k x 2) of a sequence of ids below ``base``; symbol base + k stands for rule k. Rounds end when one
    has taken less than ``worth`` of the symbols."""
    import numpy as np

    seq, rules = np.asarray(seq, dtype=np.uint32), np.empty((0, 2), dtype=np.uint32)
    before = 2 * len(seq)
    while before - len(seq) > worth * before:
        before = len(seq)
        if len(seq) < 2 or not len(keys := frequent_pairs(seq, pairs, least)):
            break
        new = np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        number = base + len(rules) + np.arange(len(keys), dtype=np.uint32)
        rules = np.concatenate([rules, new])
        first, head = np.unique(new[:, 0], return_inverse=True)
        second, tail = np.unique(new[:, 1], return_inverse=True)
        heads, tails = np.zeros(base + len(rules), dtype=np.int64), np.zeros(base + len(rules), dtype=np.int64)
        heads[first], tails[second] = np.arange(1, len(first) + 1), np.arange(1, len(second) + 1)
        #: The new symbol of a pair by its two places; 0 where the pair isn't replaced. Taking by place is faster than by mask.
        put_for = np.zeros((len(first) + 1, len(second) + 1), dtype=np.uint32)
        put_for[head + 1, tail + 1] = number
        put = put_for.ravel()[heads[seq[:-1]] * put_for.shape[1] + tails[seq[1:]]]
        at = np.flatnonzero(put)
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of overlapping pairs, every other one is replaced
        within = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
        at = at[np.flatnonzero((within & 1) == 0)]
        put = put[at]
        seq = seq.copy()
        seq[at] = put
        seq = np.delete(seq, at + 1)
    return seq, rules


def _blocks(rules, base: int):
    """Runs of rules whose symbols all stand before the run: what a round has made, or several rounds."""
    import numpy as np

    start, high = 0, rules.max(axis=1) if len(rules) else np.empty(0)
    while start < len(rules):
        late = np.flatnonzero(high[start:] >= base + start)
        end = start + int(late[0]) if len(late) else len(rules)
        yield start, end
        start = end


def write_shard(ids: list[bytes], docs: list, base: int) -> bytes:
    import numpy as np

    seq, rules = compress(np.frombuffer(b"".join(ids), dtype="<u4"), base)
    lengths = np.ones(base + len(rules), dtype=np.uint32)
    for start, end in _blocks(rules, base):
        lengths[base + start : base + end] = lengths[rules[start:end]].sum(axis=1)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    symbol = f"<u{width}"
    head = MAGIC + struct.pack("<5I", base, len(rules), len(seq), len(docs), width)
    index = np.array([d or 0 for d in docs], dtype="<i8").tobytes() + np.array([len(x) // 4 for x in ids], dtype="<u8").tobytes() + bytes(d is None for d in docs)
    return head + rules.astype(symbol).tobytes() + lengths[base:].astype("<u4").tobytes() + seq.astype(symbol).tobytes() + index


class Shard:
    """A shard's blob, decoded as far as is asked for."""

    def __init__(self, blob: bytes):
        import numpy as np

        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        self.base, n_rules, n_symbols, n_docs, width = struct.unpack_from("<5I", blob, 4)
        at = 24

        def read(kind: str, n: int):
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.rules = read(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        expansion = read("<u4", n_rules)
        self.symbols = read(f"<u{width}", n_symbols)
        docs, self.counts = read("<i8", n_docs).tolist(), read("<u8", n_docs).astype(np.int64)
        self.docs = [None if null else d for d, null in zip(docs, read("u1", n_docs).tolist())]
        self.lengths = np.concatenate([np.ones(self.base, dtype=np.int64), expansion.astype(np.int64)])
        self.ends = np.cumsum(self.lengths[self.symbols])
        self.starts = np.cumsum(self.counts) - self.counts
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.arange(self.base, dtype="<u4")  # the expansions of all symbols, one after the other
        for start, end in _blocks(self.rules, self.base):
            self.flat = np.concatenate([self.flat, self._expand(self.rules[start:end].ravel())])

    def _expand(self, symbols):
        import numpy as np

        n = self.lengths[symbols]
        return self.flat[np.repeat(self.first[symbols] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def ids(self, start: int, stop: int):
        """The ids from start to stop, expanding no symbol outside."""
        import numpy as np

        if stop <= start:
            return np.empty(0, dtype="<u4")
        low, high = np.searchsorted(self.ends, [start, stop - 1], side="right")
        out, skipped = self._expand(self.symbols[low : high + 1]), int(self.ends[low] - self.lengths[self.symbols[low]])
        return out[start - skipped : stop - skipped]


def _writer(path: str, end: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, tail, part = encoder(ByteIds, path), end.to_bytes(4, "little"), TaskContext.get().partitionId()
        base = encode.tokenizer.get_vocab_size()
        ids: list[bytes] = []
        docs: list = []
        held = shard = 0

        def flush():
            nonlocal held, shard
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([write_shard(ids, docs, base)], pa.binary())],
                names=["part", "shard", "n_docs", "n_tokens", "blob"],
            )
            ids.clear(), docs.clear()
            held, shard = 0, shard + 1
            return out

        for batch in batches:
            for cut in slices(batch):
                for doc, x in zip(cut.column("doc_id").to_pylist(), encode([t or "" for t in cut.column("text").to_pylist()])):
                    ids.append(x + tail)
                    docs.append(doc)
                    held += len(x) // 4 + 1
                    if held >= SHARD:
                        yield flush()
        if docs:
            yield flush()

    return run


def _reader(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "blob"))):
            shard = Shard(blob)
            ids = shard.ids(0, int(shard.counts.sum()))
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(shard.starts.tolist(), shard.counts.tolist())]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(shard.docs, pa.int64()), pa.array(shard.starts, pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "shard", "place", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def write_shards(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """The shards of (doc_id, text), written to the shared folder in ascending order of doc_id: part, shard, n_docs,
    n_tokens, blob."""
    tied = batched(docs).select("doc_id", "text", F.xxhash64("text").alias("tie"))
    dealt = tied.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return stored(dealt.mapInArrow(_writer(path, end), FILES), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32. The ids before a shard are summed in two
    levels, over the parts and inside each part, so that no task sees all shards."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    before = sizes.withColumn("inside", inside).join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("before"))
    rows = shards.select("part", "shard", "blob").mapInArrow(_reader, DOCS)
    return rows.join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return read_shards(write_shards(docs, vocabulary("byte_bpe_50k.json")))
