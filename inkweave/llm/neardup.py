"""MinHash near-dedup with SetSketch registers: band, estimate jointly by likelihood, verify on full sets.

A document is the set of its distinct k-word shingles (A-Z lower-cased); fewer words make one shingle, no words
none. Documents with ``100 * intersection >= 80 * union`` are linked, and a component keeps its smallest doc_id.

1. Equal sets are one class, and everything below is about classes. A class is known by its smallest doc_id; where one doc_id has several texts and is the
   smallest of several classes, all but one of these go by a hash of their set instead, and are linked with that one.
2. Each set gets ``BANDS * ROWS`` SetSketch registers: the minimum of an exponential variable over the set, on a scale of
   base ``BASE``, cut to 16 bits. Registers of a union are the larger ones of its parts, and two registers agree with a probability of
   about the Jaccard similarity. A pair at 0.8 shares none of the 42 bands of 6 registers with a probability of 3e-6.
3. In each bucket every member is paired with the smallest one, so a bucket gives as many pairs as rows, however large
   it is. Pairs whose sizes rule a link out go; the others get the joint maximum-likelihood estimate of their
   similarity from how many registers are larger, smaller and equal, and go if it is 6 deviations below 0.8.
4. Each representative is verified against the partner of the highest estimate; components follow.
5. What is left are links between components that share a bucket. Members of such buckets that can't have a link go
   first, by an exact bound: an intersection holds none of the shingles that no other set has, so
   ``100 * shared >= 80 * union`` needs enough shingles that stand in two of these sets or more. Sets that
   share a common passage alone have too many of their own. The others form families, joined by the buckets they
   share. In a family the members outside its largest component are compared with all, in blocks of ``BLOCK``: a
   product of two membership matrices gives the exact intersections of a block, and only links come out of it, one for each
   set and component. So no bucket or family has a cap, and pairs are never rows.

Verification reads whole texts, which travel compressed and only to where a pair needs them.

Null and empty texts have no shingles, are linked with nothing and stay. Rows with a null doc_id are kept, with null component. Rows with words that
share a doc_id are one document: linked, and kept together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, drop_stored, release, stored, table
from .graph import components
from .tokens import slices, unload

BANDS, ROWS, BASE, RATE, ESTIMATED = 42, 6, 1.001, 20.0, 128
NEED, DEVIATIONS = 80, 6.0
BLOCK, WIDTH = 1024, 4096
SETS = "doc_id bigint, n_shingles bigint, high bigint, low bigint, registers binary, bands array<bigint>"


def _numbers(n: int, seed: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, k: int):
    """Sorted distinct 64-bit hashes of the shingles."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h, factors = np.array(list(map(xxh3_64_intdigest, words)), dtype=np.uint64), _numbers(k + 1, 11)
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, int(factors[k]) * size % 2**64, dtype=np.uint64)
    for i in range(size):
        out += h[i : len(words) - size + 1 + i] * factors[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def registers(sets):
    """SetSketch registers of a set of hashes; all 0 for the empty set."""
    import numpy as np

    m = BANDS * ROWS
    if not len(sets):
        return np.zeros(m, dtype=np.uint16)
    factors = _numbers(m, 12)[:, None]
    least = np.full(m, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(sets), 1024):
        np.minimum(least, (factors * sets[None, i : i + 1024]).min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(regs):
    import numpy as np

    out = (regs.reshape(BANDS, ROWS).astype(np.uint64) * _numbers(ROWS, 13)[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(29))).astype(np.int64)


def joint_estimate(larger, smaller, equal, n_a, n_b):
    """Maximum-likelihood Jaccard similarities from registers larger, smaller and equal, and the sets' sizes."""
    import numpy as np

    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return larger * np.log(a) + smaller * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def _sketches(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        unload()
        for batch in batches:
            for part in slices(batch):
                n, high, low, regs, bands = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text, k)
                    r, digest = registers(s), _digest(s)
                    n.append(len(s))
                    high.append(digest[0])
                    low.append(digest[1])
                    regs.append(r[:ESTIMATED].tobytes())
                    bands.append(band_keys(r))
                rows = len(n)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(regs, pa.binary()), keys], names=["doc_id", "n_shingles", "high", "low", "registers", "bands"])

    return run


def _estimated(batches):
    """(a, b, n_a, n_b, ra, rb) to (a, b, estimate), without the pairs that can't be links."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, ESTIMATED)
        ra, rb = read("ra"), read("rb")
        larger, smaller = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
        n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
        j = joint_estimate(larger, smaller, ESTIMATED - larger - smaller, n_a, n_b)
        need = NEED / 100
        keep = pa.array(j >= need - DEVIATIONS * np.sqrt(need * (1 - need) / ESTIMATED))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(j).filter(keep)], names=["a", "b", "estimate"])


def _digest(sets) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    digest = xxh3_128_intdigest(sets.tobytes())
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def _compressed(k: int | None = None):
    """(doc_id, text) to (doc_id, z), or, with a ``k``, to (high, low, z) by the class."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                z = pa.array([pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
                if k is None:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), z], names=["doc_id", "z"])
                else:
                    high, low = zip(*[_digest(shingles(t, k)) for t in texts])
                    yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), z], names=["high", "low", "z"])

    return run


def _unpack(z: bytes, unpacker, k: int):
    return shingles(unpacker.decompress(z).decode("utf-8", "surrogatepass"), k)


def _verified(k: int):
    """(a, b, za, zb) to (a, b) of the links. Rows with the same a mostly come one after the other."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpacker, last, left = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            keep = []
            for a, za, zb in zip(batch.column("a").to_pylist(), batch.column("za").to_pylist(), batch.column("zb").to_pylist()):
                if last != (a, za):
                    last, left = (a, za), _unpack(za, unpacker, k)
                right = _unpack(zb, unpacker, k)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= NEED * (len(left) + len(right) - both) > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _exploded(k: int):
    """(node, z) to a row (node, shingle) for each shingle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            nodes, sets, held = [], [], 0
            for node, z in zip(batch.column("node").to_pylist(), batch.column("z").to_pylist()):
                s = _unpack(z, unpacker, k)
                nodes.append(np.full(len(s), node))
                sets.append(s.view(np.int64))
                held += len(s)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sets))], names=["node", "shingle"])
                    nodes, sets, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sets))], names=["node", "shingle"])

    return run


def overlaps(left: list, right: list, width: int = WIDTH):
    """Sizes of all intersections of two lists of sorted sets, as a product of their membership matrices over the
    elements that both lists have; ``width`` elements at a time."""
    import numpy as np

    def members(sets):
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        return flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (a, of_a), (b, of_b) = members(left), members(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for i in range(0, len(both), width):
        part, sides = both[i : i + width], []
        for flat, owner, n in ((a, of_a, len(left)), (b, of_b, len(right))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = np.flatnonzero(part[at] == flat)
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[owner[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _family_links(k: int):
    """A block of a family's smaller components, and one of all its members (node, label, z): one link (a, b) for each node
    of the former and each other label that it is linked with."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import zstandard

        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            unpacker = zstandard.ZstdDecompressor()
            sets = [[_unpack(z, unpacker, k) for z in t.column("z").to_pylist()] for t in (left, right)]
            sizes = [np.array([len(s) for s in x]) for x in sets]
            labels = [t.column("label").to_numpy() for t in (left, right)]
            nodes = [t.column("node").to_numpy() for t in (left, right)]
            both = overlaps(*sets)
            linked = (100 * both >= NEED * (sizes[0][:, None] + sizes[1][None, :] - both)) & (labels[0][:, None] != labels[1][None, :])
            for i, j in zip(*np.nonzero(linked)):
                found.append((int(nodes[0][i]), int(labels[1][j]), int(nodes[1][j])))
            found = [(a, b) for (a, _), b in {(a, label): b for a, label, b in found}.items()]
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sizes_allow(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {NEED} * greatest({a}, {b})"


class _Links:
    """The tables that the steps share."""

    def __init__(self, docs: DataFrame, k: int):
        self.docs, self.k = batched(docs).select("doc_id", "text"), k
        self.sets = stored(self.docs.mapInArrow(_sketches(k), SETS), "sets")
        real = self.sets.where("doc_id IS NOT NULL AND n_shingles > 0")
        self.classes = stored(real.groupBy("high", "low").agg(F.min("doc_id").alias("node")), "classes")
        #: doc_ids that are the smallest of several classes; None where there are none, which is usual.
        again = self.classes.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("high", "low")).alias("own")).where("c > 1").select(F.col("node").alias("first"), "own")
        again = stored(again, "repeated-ids")
        self.twins = None
        if not again.isEmpty():
            known = self.classes.join(again, F.col("node") == F.col("first"), "left")
            mine = F.col("first").isNull() | (F.struct("high", "low") == F.col("own"))
            node = F.when(mine, F.col("node")).otherwise(F.xxhash64("high", "low", "node"))
            classes = stored(known.select("high", "low", node.alias("node"), F.col("node").alias("doc")), "classes")
            self.twins = stored(classes.where("node <> doc").select("high", "low", "node", "doc"), "twins")
            drop_stored(self.classes)
            self.classes = classes
        first = F.col("doc") if self.twins is not None else F.col("node")
        mine = real.join(self.classes.withColumnsRenamed({"high": "h", "low": "l"}), (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("doc_id") == first))
        self.nodes = stored(mine.select("node", F.col("n_shingles").alias("n"), "registers", "bands").dropDuplicates(["node"]), "nodes")
        rows = self.nodes.select("node", F.explode("bands").alias("band"))
        buckets = rows.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
        #: A join that reads an aggregate where it was made can't be split for a hot key; one that reads a table can.
        buckets = stored(buckets, "buckets")
        self.members = stored(rows.join(buckets, "band"), "members")
        #: Compressed texts (node, z) of all that share a bucket.
        shared = self.members.select("node").distinct()
        if self.twins is None:
            texts = self.docs.mapInArrow(_compressed(), "doc_id bigint, z binary").withColumnRenamed("doc_id", "node")
        else:  # one doc_id may have several texts: those are told apart by their sets
            several = self.twins.select(F.col("doc").alias("doc_id")).distinct()
            texts = self.docs.join(several, "doc_id", "left_anti").mapInArrow(_compressed(), "doc_id bigint, z binary").withColumnRenamed("doc_id", "node")
            odd = self.docs.join(several, "doc_id", "left_semi").mapInArrow(_compressed(k), "high bigint, low bigint, z binary")
            texts = texts.unionByName(odd.join(self.classes.select("high", "low", "node"), ["high", "low"]).select("node", "z"))
        self.texts = stored(texts.join(shared, "node", "left_semi"), "texts")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), whose estimate leaves a link possible."""
        of = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r{x}"))
        wide = pairs.join(of("b"), "b").join(of("a"), "a").where(_sizes_allow("n_a", "n_b"))
        return stored(wide.select("a", "b", "n_a", "n_b", "ra", "rb").mapInArrow(_estimated, "a bigint, b bigint, estimate double"), "estimates")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among the pairs."""
        of = lambda x: self.texts.select(F.col("node").alias(x), F.col("z").alias(f"z{x}"))
        rows = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "za", "zb")
        return stored(rows.mapInArrow(_verified(self.k), "a bigint, b bigint"), "links")

    def labelled(self, df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
        """``df`` with the label of its column ``node``: the node itself where it has no link."""
        known = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        return df.join(known, F.col(node) == F.col("_n"), "left").withColumn(label, F.coalesce("_l", node)).drop("_n", "_l")

    def linkable(self, nodes: DataFrame) -> DataFrame:
        """Those of ``nodes`` (node) with enough shingles that others of them have too."""
        texts = self.texts.join(nodes, "node", "left_semi")
        rows = stored(texts.mapInArrow(_exploded(self.k), "node bigint, shingle bigint"), "shingles")
        several = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("shingle")
        shared = rows.join(several, "shingle", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
        out = stored(shared.join(self.nodes.select("node", "n"), "node").where(f"100 * shared >= {NEED} * n").select("node"), "linkable")
        drop_stored(rows)
        release(self.docs.sparkSession)
        return out

    def across_components(self, labels: DataFrame) -> DataFrame:
        """Links (a, b) between components (node, label) that share a bucket."""
        members = self.labelled(self.members.select("band", "node"), labels, "node", "label")
        mixed = members.groupBy("band").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x <> _y").select("band")
        mixed = stored(mixed, "mixed")
        open_ = stored(members.join(mixed, "band"), "open")
        left = stored(open_.join(self.linkable(open_.select("node").distinct()), "node", "left_semi"), "left")
        first = stored(left.groupBy("band").agg(F.min("node").alias("a")), "first")
        families = components(left.join(first, "band").select("a", F.col("node").alias("b")).distinct()).withColumnRenamed("label", "family")
        rows = stored(left.select("node", "label").distinct().join(families, "node"), "families")
        parts = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("_c")).groupBy("family").agg(F.sum("_c").alias("size"), F.max_by("label", F.struct("_c", "label")).alias("largest"), F.count(F.lit(1)).alias("_k"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = rows.join(parts.where("_k > 1").withColumn("blocks", blocks), "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(self.texts, "node")
        every = F.explode(F.expr("sequence(0, blocks - 1)"))
        minor = rows.where("label <> largest").select("family", "node", "label", "z", F.col("own").alias("i"), every.alias("j"))
        whole = rows.select(*[F.col(c).alias(c) for c in ("family", "node", "label", "z")], F.col("own").alias("j"), every.alias("i"))
        key = ("family", "i", "j")
        return stored(minor.groupBy(*key).cogroup(whole.groupBy(*key)).applyInArrow(_family_links(self.k), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    work, spark = _Links(docs, k), docs.sparkSession
    release(spark)
    stars = work.members.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    likely = work.estimated(stars)
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", F.bitwise_not("a"))).alias("a")).select("a", "b")
    links = work.verified(best)
    release(spark)
    labels = components(links)
    links = links.union(work.across_components(labels))
    release(spark)
    classes = work.classes.select("high", "low", "node")
    place = work.sets.join(classes, ["high", "low"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    #: Rows that share a doc_id, and lie in several classes, link these.
    several = place.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    twice = place.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    labels = components(links.union(twice))
    if work.twins is not None:  # a label may be a hash: the smallest doc_id of the component, instead
        named = work.classes.join(labels, "node").groupBy("label").agg(F.min("doc").alias("least"))
        labels = stored(labels.join(named, "label").select("node", F.col("least").alias("label")), "labels")
    final = work.labelled(place, labels, "node", "component_id")
    component = F.coalesce("component_id", "doc_id")
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), 4)
