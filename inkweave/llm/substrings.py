"""Suffix-array dedup: bytes in substrings of 200 bytes that start anywhere else too.

Sorting the suffix at every byte would move each text hundreds of times. Instead each window of ``LENGTH`` bytes is told by
its anchor, the leftmost of its ``GRAM``-byte strings with the smallest hash: equal windows have equal anchors at equal
places, so only suffixes at anchors (about one byte in 85) need sorting, with what stands before them.

1. Anchors of all windows are hashed; those whose string occurs once hold no repeat.
2. The bytes that an anchor's windows cover, its context, are hashed too. Equal contexts count as one, with how many there are: digests do no more than that.
3. Every different context that is there twice, or whose string occurs in another, is fetched once and
   sorted by deep-shallow sorting (see :mod:`.suffixes`) among those of its string, twice if there are several of it. The order gives exact matches to either
   side of the anchor, and so the bytes of each context that stand elsewhere too.
4. A string with more than ``HOT`` different contexts, as at the border of a passage that a third of all documents share, would be one task's. Such a
   group is parted by longer strings: the windows of a context that start within 13 bytes share all but 12 bytes, and by these their piece of the context meets
   the same pieces of others, which are counted, deduplicated and sorted as contexts are. What is still hot is parted into single windows, and goes the same
   way. So whatever repeats is found by the sort, and no task sorts more than ``HOT`` strings of a group.
5. What the sort says about a context goes to all places that have it; intervals are merged by document and taken out of the text.

Counts are aggregated before every shuffle, contexts are deduplicated before they are sorted, and joins have the rows of one key
on one side only, so that Spark can split what is skewed. Digests have 128 bits. Texts travel compressed.

Null and empty texts have no bytes; texts under ``LENGTH`` bytes lose none. Repeated rows are other places: both lose what they
share. Rows are told apart by doc_id and a 64-bit digest of the text, those without a doc_id by a digest of 128 bits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, drop_stored, release, stored, table
from .suffixes import matches
from .tokens import slices

LENGTH, GRAM, HOT = 200, 32, 256
CHUNK = 1 << 19
#: A context is (gram, high, low); ``many`` if there are several equal ones.
ANCHORS = "doc bigint, own bigint, at bigint, gram bigint, high bigint, low bigint"
CONTEXTS = "doc bigint, own bigint, at bigint, gram bigint, high bigint, low bigint, many boolean, hot boolean, context binary"
#: start and stop are places in the text, or for contexts that are many, distances from the anchor.
VERDICTS = "doc bigint, own bigint, gram bigint, high bigint, low bigint, many boolean, start bigint, stop bigint"
PIECES = "doc bigint, own bigint, at bigint, gram bigint, high bigint, low bigint, parent boolean, context binary"
#: How many starts a piece of a hot group's contexts has, from one round to the next.
STEPS = (13, 1)
TEXTS = "doc bigint, own bigint, doc_id bigint, z binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed string"
_POWERS: dict[int, tuple] = {}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def row_key(doc: int | None, raw: bytes) -> tuple[int, int]:
    """Tells rows apart, also those with the same doc_id and different texts."""
    from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

    if doc is not None:
        return doc, _signed(xxh3_64_intdigest(raw))
    d = xxh3_128_intdigest(raw, seed=1)
    return _signed(d >> 64), _signed(d & (1 << 64) - 1)


def _powers(n: int, base: int = 0x9E3779B97F4A7C15):
    import numpy as np

    if n not in _POWERS:
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(n, base, dtype=np.uint64))
            down = np.cumprod(np.full(n, inverse, dtype=np.uint64))
        letters = np.random.default_rng(21).integers(0, 2**64, 256, dtype=np.uint64)
        _POWERS[n] = up, down, letters
    return _POWERS[n]


def gram_hashes(raw, gram: int):
    """A mixed 64-bit hash of each string of ``gram`` bytes; ``raw`` has at most CHUNK + 2 * LENGTH bytes."""
    import numpy as np

    up, down, letters = _powers(CHUNK + 1024)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(letters[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[gram:] - sums[: len(raw) - gram + 1]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """Places of anchors, the first and last start of the windows that each tells, and the hashes of their strings."""
    import numpy as np

    data, width = np.frombuffer(raw, dtype=np.uint8), length - gram + 1
    parts = []
    for start in range(0, max(0, len(raw) - length + 1), CHUNK):
        h = gram_hashes(data[start : start + CHUNK + length - 1], gram)
        bits = np.uint64(20)
        keys = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - width + 1
        padded = np.full(-(-len(h) // width) * width, 2**64 - 1, dtype=np.uint64)
        padded[: len(h)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        parts.append((at[first] + start, first + start, np.append(first[1:], n) - 1 + start, h[at[first]].view(np.int64)))
    if not parts:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    at, low, high, h = (np.concatenate(x) for x in zip(*parts))
    new = np.diff(at, prepend=-1) != 0  # a chunk's end may part an anchor's windows
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return at[new], low[new], high[last], h[new]


def _packed(at, low, high):
    """Place, and how far before it the windows start, in one number."""
    return at << 16 | (at - low) << 8 | (at - high)


def _unpacked(x: int) -> tuple[int, int, int]:
    at = x >> 16
    return at, at - (x >> 8 & 255), at - (x & 255)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchored(length: int, gram: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[] for _ in range(6)]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw = _raw(text)
                    at, low, high, h = anchors(raw, length, gram)
                    if not len(at):
                        continue
                    packed = _packed(at, low, high)
                    digests = [xxh3_128_intdigest(raw[a : b + length], seed=k & 0xFFFF) for a, b, k in zip(low.tolist(), high.tolist(), packed.tolist())]
                    for column, value in zip(out, row_key(doc, raw)):
                        column.append(np.full(len(at), value))
                    out[2].append(packed)
                    out[3].append(h)
                    out[4].append(np.array([d >> 64 for d in digests], dtype=np.uint64).view(np.int64))
                    out[5].append(np.array([d & (1 << 64) - 1 for d in digests], dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["doc", "own", "at", "gram", "high", "low"])

    return run


def _compressed(batches):
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=5)
    for batch in batches:
        for part in slices(batch):
            raws = [_raw(t) for t in part.column("text").to_pylist()]
            keys = [row_key(d, r) for d, r in zip(part.column("doc_id").to_pylist(), raws)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*keys)), part.column("doc_id"), pa.array([pack.compress(r) for r in raws], pa.binary())], names=["doc", "own", "doc_id", "z"])


def _batched_rows(rows, schema: str, size: int):
    """Arrow batches of about ``size`` of the rows (tuples) that an iterator of lists gives."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in schema.split(", ")])
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*held), types)], names=list(names))

    for part in rows:
        held += part
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _contexts(length: int):
    """(doc, own, z, wanted: array of (at, gram, high, low, many, hot)) to CONTEXTS."""

    def run(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()

        def found():
            for batch in batches:
                for doc, own, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "own", "z", "wanted"))):
                    raw, rows = unpacker.decompress(z), []
                    for w in wanted:
                        _, low, high = _unpacked(w["at"])
                        rows.append((doc, own, w["at"], w["gram"], w["high"], w["low"], w["many"], w["hot"], raw[low : high + length]))
                    yield rows

        return _batched_rows(found(), CONTEXTS, 20_000)

    return run


def _sorted_groups(length: int):
    """CONTEXTS in the order of gram, each gram's rows together, to VERDICTS."""

    def verdicts(group):
        group = list({row[4:6]: row for row in group}.values())  # a repeated row of the input has brought its contexts twice
        if len(group) == 1 and not group[0][6]:
            return
        group = [x for row in group for x in ([row, row] if row[6] else [row])]
        lefts, rights = [], []
        for row in group:
            before = row[2] >> 8 & 255
            lefts.append(row[-1][:before][::-1])
            rights.append(row[-1][before:])
        last = None
        for row, found in zip(group, matches(lefts, rights, length)):
            if row is not last:  # the second one of a pair says the same
                doc, own, at, gram, high, low, many, _, _ = last = row
                place = 0 if many else at >> 16
                for start, stop in merged([(place - a, place + b) for a, b in found]):
                    yield doc, own, gram, high, low, many, start, stop

    def run(batches):
        def found():
            group: list[tuple] = []
            for batch in batches:
                rows: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if group and group[0][3] != row[3]:
                        rows += verdicts(group)
                        group = []
                    group.append(row)
                yield rows
            if group:
                yield list(verdicts(group))

        return _batched_rows(found(), VERDICTS, 20_000)

    return run


def _pieces(length: int, step: int):
    """CONTEXTS to PIECES: each has the windows whose distances from the anchor are alike but for their rest by ``step``, and is told by the bytes
    that all such windows share."""

    def run(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

        def found():
            for batch in batches:
                for doc, own, at, many, context in zip(*(batch.column(c).to_pylist() for c in ("doc", "own", "at", "many", "context"))):
                    place, before, least, rows = at >> 16, at >> 8 & 255, at & 255, []
                    for k in range(least - least % step, before + 1, step):
                        low, high = max(least, k), min(before, k + step - 1)
                        piece, core = context[before - high : before - low + length], context[before - k : before + length - k - step + 1]
                        packed = place << 16 | high << 8 | low
                        d = xxh3_128_intdigest(piece, seed=packed & 0xFFFF)
                        rows.append((doc, own, packed, _signed(xxh3_64_intdigest(core, seed=k + 1)), _signed(d >> 64), _signed(d & (1 << 64) - 1), many, piece))
                    yield rows

        return _batched_rows(found(), PIECES, 20_000)

    return run


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans; those that overlap or touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches):
    """(doc_id, z, spans) to RESULT; removed has start:stop of each run, in bytes."""
    import pyarrow as pa
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2
    for batch in batches:
        rows = []
        for doc, z, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "spans"))):
            raw = unpacker.decompress(z)
            runs = merged([(s["start"], s["stop"]) for s in spans or []])
            kept, end = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[end:a])
                end = b
            kept.update(raw[end:])
            rows.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


CONTEXT = ["gram", "high", "low"]


def _counted(places: DataFrame, hot: int, more: tuple = ()) -> DataFrame:
    """Different contexts of ``places`` (ANCHORS) that repeat, or whose string has several: copies, their first place, whether they are hot."""
    contexts = stored(places.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "own", "at")).alias("first"), *more), "contexts")
    kinds = stored(contexts.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    counted = stored(contexts.join(kinds, F.col("gram") == F.col("g")).where("copies > 1 OR kinds > 1").drop("g").withColumn("hot", F.col("kinds") > hot), "counted")
    drop_stored(contexts)
    drop_stored(kinds)
    return counted


def _verdicts(fetched: DataFrame, length: int) -> DataFrame:
    """VERDICTS on CONTEXTS: of those that aren't hot by the sort; of hot ones that are many, all."""
    near = fetched.where("NOT hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups(length), VERDICTS)
    reach = [-F.shiftright("at", 8).bitwiseAND(F.lit(255)), length - F.col("at").bitwiseAND(F.lit(255))]
    equal = fetched.where("hot AND many").select("doc", "own", *CONTEXT, "many", reach[0].alias("start"), reach[1].alias("stop"))
    return stored(near.unionByName(equal), "verdicts")


def _told(verdicts: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, own, start, stop) of the verdicts: of contexts that are many for each of the ``places`` that has them."""
    place = F.shiftright("at", 16)
    shared = places.select("doc", "own", "at", *CONTEXT).join(verdicts.where("many").select(*CONTEXT, "start", "stop"), CONTEXT)
    shared = shared.select("doc", "own", (place + F.col("start")).alias("start"), (place + F.col("stop")).alias("stop"))
    return stored(verdicts.where("NOT many").select("doc", "own", "start", "stop").unionByName(shared), "spans")


def _deeper(contexts: DataFrame, length: int, step: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc, own, start, stop) for hot contexts that stand once, by their pieces; and the pieces that are hot themselves, as CONTEXTS."""
    pieces = stored(contexts.mapInArrow(_pieces(length, step), PIECES), "pieces")
    counted = _counted(pieces, hot if step > 1 else 2**62, (F.bool_or("parent").alias("inherited"),))
    one = counted.select(*CONTEXT, "first", ((F.col("copies") > 1) | F.col("inherited")).alias("many"), "hot")
    first = pieces.join(one, CONTEXT).where(F.struct("doc", "own", "at") == F.col("first"))
    fetched = stored(first.select(*[x.split()[0] for x in CONTEXTS.split(", ")]), "fetched")
    drop_stored(counted)
    verdicts = _verdicts(fetched, length)
    spans = _told(verdicts, pieces.where("NOT parent"))
    drop_stored(pieces)
    drop_stored(verdicts)
    return spans, fetched


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, own, start, stop) of the bytes that lie in repeated substrings; spans of a document may overlap."""
    if not gram <= length < gram + 256:
        raise ValueError("length has to be gram to gram + 255")
    spark = docs.sparkSession
    found = batched(docs).select("doc_id", "text").mapInArrow(_anchored(length, gram), ANCHORS)
    several = found.groupBy("gram").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("gram")
    #: A join that reads an aggregate where it was made can't be split for a hot key; one that reads a table can.
    several = stored(several, "grams")
    repeated = stored(found.join(several, "gram", "left_semi"), "anchors")
    drop_stored(several)
    release(spark)
    counted = _counted(repeated, hot)
    one = F.struct("first.at", *CONTEXT, (F.col("copies") > 1).alias("many"), "hot")
    asked = stored(counted.groupBy("first.doc", "first.own").agg(F.collect_list(one).alias("wanted")), "asked")
    drop_stored(counted)
    release(spark)
    texts = docs.select("doc_id", "text").mapInArrow(_compressed, TEXTS).select("doc", "own", "z")
    fetched = stored(texts.join(asked, ["doc", "own"]).mapInArrow(_contexts(length), CONTEXTS), "fetched")
    drop_stored(asked)
    release(spark)
    verdicts = _verdicts(fetched, length)
    spans = _told(verdicts, repeated)
    drop_stored(repeated)
    drop_stored(verdicts)
    release(spark)
    for step in STEPS:
        if (wide := fetched.where("hot")).isEmpty():
            break
        more, deeper = _deeper(wide, length, step, hot)
        spans = spans.unionByName(more)
        drop_stored(fetched)
        fetched = deeper
        release(spark)
    drop_stored(fetched)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text)."""
    spans = repeated_spans(docs, length, gram, hot).groupBy("doc", "own").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    texts = docs.select("doc_id", "text").mapInArrow(_compressed, TEXTS)
    return texts.join(spans, ["doc", "own"], "left").select("doc_id", "z", "spans").mapInArrow(_removed, RESULT)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
