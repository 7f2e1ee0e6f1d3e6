"""Packing: vector bin packing by the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens.

Loss-bearing tokens are those that training learns from. In a document the first ``PROMPT`` ids are read only, as a prompt is, and the
others bear loss (:func:`pack_documents`); in a conversation the turns of the assistant bear loss, each with its end id, and all others
don't (:func:`pack_conversations`). A sequence holds at most ``LENGTH`` tokens, ``SEGMENTS`` pieces and ``LOSS`` loss-bearing tokens, so that
no sequence weighs much more than another in a step's loss. Long texts, nearly all loss, meet the third limit before the first, and what is
left of their sequences is filled with pieces that bear little.

Each partition packs what it reads, without a shuffle: a sequence never needs documents of another partition, and
a partition leaves one sequence at most that isn't full. A document is cut where it reaches a limit; chunks that are as long as a sequence
fill one of their own. What remains is packed bin by bin: of the pieces that fit
under all limits, the next is one with the largest dot product of its (tokens, segments, loss tokens), each divided
by its limit, with what the bin still has of each. If none fits and more than ``waste`` tokens are free, a
piece is cut to fill the bin as far as both limits allow. A window of ``WINDOW`` ids is packed at a time, so memory doesn't follow the partition.

Sequence ids are the partition's number and a count, so a task that runs again on the same rows gives the same ids.
Null texts are empty documents: their end id alone. Ties, repeated rows and repeated doc_ids are separate documents. A null turn is an empty
one; turns of equal number go by role and text; rows without a conversation are one, that of null.
"""

from __future__ import annotations

import zlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table
from .tokens import WordIds, encoder, give_back, slices, vocabulary

LENGTH, SEGMENTS, WASTE = 2048, 256, 16
PROMPT, LOSS = 32, 2016
WINDOW = 2_000_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


class Packer:
    """Packs pieces (tokens, loss, item). ``cut(item, n)`` gives an item's first n tokens and the rest, as two (tokens, loss, item); items
    that can be cut have the tokens that bear no loss before the others."""

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, waste: int = WASTE, cut=None):
        self.limits = (length, segments, length if loss is None else loss)
        self.waste, self.cut = waste, cut
        self.kinds: dict[tuple[int, int], deque] = {}
        self.held = 0

    def add(self, tokens: int, loss: int, item) -> None:
        if tokens > self.limits[0] or loss > self.limits[2]:
            raise ValueError("a piece is beyond the limits of an empty sequence")
        self.kinds.setdefault((tokens, loss), deque()).append(item)
        self.held += tokens

    def _arrays(self):
        import numpy as np

        keys = sorted(self.kinds, reverse=True)
        size = np.array(keys, dtype=np.int64).reshape(-1, 2)
        return keys, size[:, 0].copy(), size[:, 1].copy(), np.ones(len(keys), dtype=bool)

    def _take(self, key):
        waiting = self.kinds[key]
        item = waiting.popleft()
        if not waiting:
            del self.kinds[key]
        self.held -= key[0]
        return item

    def bins(self, last: bool):
        """Full sequences as lists of (tokens, loss, item); unless ``last``, pieces of less than two sequences wait."""
        import numpy as np

        length, segments, most = self.limits
        keys, tokens, loss, open_ = self._arrays()
        at = {k: i for i, k in enumerate(keys)}
        rest: list = []  # what cuts have left, of any size: the first pieces of the next sequence

        def gone(key):
            if key not in self.kinds:
                open_[at[key]] = False

        while self.kinds or rest:
            if not last and self.held < 2 * length and not rest:
                return
            bin_, free, places, bearing = [], length, segments, most
            while rest:
                t, x, item = rest.pop()
                bin_.append((t, x, item))
                free, places, bearing = free - t, places - 1, bearing - x
            while places and free:
                fits = open_ & (tokens <= free) & (loss <= bearing)
                if fits.any():
                    worth = tokens * (free / length**2) + places / segments**2 + loss * (bearing / max(1, most) ** 2)
                    key = keys[int(np.argmax(np.where(fits, worth, -1.0)))]
                    bin_.append((*key, self._take(key)))
                    gone(key)
                    free, places, bearing = free - key[0], places - 1, bearing - key[1]
                    continue
                if self.cut and free > self.waste and self.kinds:
                    #: How many of a piece's first tokens both limits allow. None is as long as the piece: that would fit.
                    first = np.where(open_, np.minimum(free, bearing + tokens - loss), -1)
                    key = keys[int(np.argmax(first))]
                    n = int(first.max())
                    if n > self.waste:
                        item = self._take(key)
                        gone(key)
                        head, tail = self.cut(item, n)
                        bin_.append(head)
                        rest.append(tail)
                break
            yield bin_


def _piece(doc, start: int, ids: bytes, total: int, prompt: int) -> tuple:
    """(tokens, loss, item) of a document's ids from ``start`` on."""
    n = len(ids) // 4
    return n, n - min(n, max(0, prompt - start)), (doc, start, ids, total)


def _cutter(prompt: int):
    def cut(item, n: int):
        doc, start, ids, total = item
        return _piece(doc, start, ids[: 4 * n], total, prompt), _piece(doc, start + n, ids[4 * n :], total, prompt)

    return cut


class _Rows:
    """Rows of PIECES for the sequences that have been packed."""

    NAMES = [x.split()[0] for x in PIECES.split(", ")]

    def __init__(self):
        from pyspark import TaskContext

        self.first, self.count, self.rows = TaskContext.get().partitionId() << 40, 0, []

    def place(self, bin_) -> None:
        offset = 0
        for n, loss, (doc, start, ids, total) in bin_:
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.first + self.count, offset, loss))
            offset += n
        self.count += 1

    def batch(self):
        import pyarrow as pa

        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*self.rows) if self.rows else [[]] * len(self.NAMES))], names=self.NAMES)
        self.rows = []
        return out


def packer(path: str, end: int, length: int, segments: int, waste: int, prompt: int, most: int, words: int = WordIds.cached):
    """The function for mapInArrow over (doc_id, text)."""

    def run(batches):
        give_back()
        encode, tail = encoder(WordIds, path), end.to_bytes(4, "little")
        encode.cached = words
        pack, out = Packer(length, segments, most, waste, _cutter(prompt)), _Rows()

        def flush(last: bool):
            for bin_ in pack.bins(last):
                out.place(bin_)
            return out.batch()

        for batch in batches:
            for part in slices(batch):
                docs, texts = part.column("doc_id").to_pylist(), [x or "" for x in part.column("text").to_pylist()]
                for doc, ids in zip(docs, encode(texts)):
                    ids += tail
                    total, start = len(ids) // 4, 0
                    while start < total:
                        n = min(length, max(0, prompt - start) + most, total - start)
                        piece = _piece(doc, start, ids[4 * start : 4 * (start + n)], total, prompt)
                        out.place([piece]) if n == length else pack.add(*piece)
                        start += n
                if pack.held >= WINDOW or len(out.rows) >= 100_000:
                    yield flush(False)
        yield flush(True)

    return run


def pack_documents(docs: DataFrame, path: str, end: int = 1, length: int = LENGTH, segments: int = SEGMENTS, waste: int = WASTE, prompt: int = PROMPT, loss: int = LOSS, words: int = WordIds.cached) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens. A worker keeps the ids of
    about ``words`` words; any number gives the same rows."""
    if not 0 < loss <= length or prompt < 0:
        raise ValueError("loss has to be from 1 to length, and prompt not negative")
    return batched(docs).select("doc_id", "text").mapInArrow(packer(path, end, length, segments, waste, prompt, loss, words), PIECES)


def _talk_packer(path: str, end: int, length: int, segments: int, most: int, bearing: str):
    """The function for mapInArrow over (doc_id, turns: array of (role, text))."""

    def run(batches):
        encode, tail = encoder(WordIds, path), end.to_bytes(4, "little")
        pack, out = Packer(length, segments, most), _Rows()
        for batch in batches:
            for doc, turns in zip(batch.column("doc_id").to_pylist(), batch.column("turns").to_pylist()):
                parts = [(x + tail, t["role"] == bearing) for x, t in zip(encode([t["text"] or "" for t in turns]), turns)]
                total, start, held, loss = sum(len(x) for x, _ in parts) // 4, 0, [], 0
                for ids, learnt in parts:
                    while ids:
                        room = length - sum(len(x) for x in held) // 4
                        n = min(len(ids) // 4, room, most - loss if learnt else room)
                        held.append(ids[: 4 * n])
                        ids, loss = ids[4 * n :], loss + (n if learnt else 0)
                        if ids:  # a limit is reached: what is held is a piece
                            raw = b"".join(held)
                            pack.add(len(raw) // 4, loss, (doc, start, raw, total))
                            start, held, loss = start + len(raw) // 4, [], 0
                if raw := b"".join(held):
                    pack.add(len(raw) // 4, loss, (doc, start, raw, total))
            if pack.held >= WINDOW:
                for bin_ in pack.bins(False):
                    out.place(bin_)
                yield out.batch()
        for bin_ in pack.bins(True):
            out.place(bin_)
        yield out.batch()

    return run


def pack_conversations(talks: DataFrame, path: str, end: int = 1, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LOSS, bearing: str = "assistant") -> DataFrame:
    """PIECES of conversations (conv_id, turn, role, text), doc_id being conv_id. The turns of ``bearing`` bear loss, with the end id behind each. A
    conversation stays in one piece unless it is beyond a limit by itself; it is cut there. Conversations are the units that a task
    holds whole, as a reader of one would."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = batched(talks).groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("t")).select("doc_id", F.expr("transform(t, x -> struct(x.role, x.text))").alias("turns"))
    return whole.mapInArrow(_talk_packer(path, end, length, segments, loss, bearing), PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))
