"""Mixing sources to target weights: block quotas split among output shards by a hypergeometric tree.

1. Every source gets a target (:func:`targets`): shares by weight, no source above ``most`` times its size, the
   excess reshared by weight (water filling, in closed form over the table of sources).
2. A source's documents are permuted by a seeded digest and dealt into about sqrt(documents) equal digest ranges,
   its blocks. Both the blocks of a source and the documents of a block therefore stay about sqrt(n), however many
   rows one source holds: prefix sums run over blocks, then inside a block, never over a whole source. The digest is of doc_id and text, so that
   rows without a doc_id, or with the same, are dealt out as others are.
3. A target is so many whole passes over the blocks and one partial pass, whose last document is cut, so that each
   source gives exactly round(target) words. The draws of a source are its (pass, block) pairs.
4. :func:`shard_quotas` splits the exact number of draws of each source among the shards: at each node of a binary
   tree the left half gets an exact number of draws, and how many of each source is a multivariate hypergeometric
   draw (source by source, each by inverting its conditional distribution at a hashed uniform number). There are ``SHARDS`` shards, and more where
   one would hold over ``SHARD_WORDS`` words.
5. Shards take disjoint runs of each source's permuted draws, and order their rows by another digest. :func:`mixed_documents` deals its rows out by shard,
   in that order, so that what reads them next reads each shard mixed.

Everything is DataFrame expressions. Null sources form a source of their own, after the others; null texts have
size 0 and are taken 0 times. Sources of size 0 have target 0. Repeated rows are separate documents. All results are functions of
the rows and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored, table

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
SHARDS, SHARD_WORDS = 64, 1 << 22


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, n_docs, source_size, target. ``sizes`` has source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * most
    level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    done = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    #: Once the lower caps are taken, each further source would get left * weight / open.
    steps = per.withColumn("weight", weight).withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(done), F.lit(0)),
        "open": F.sum("weight").over(rest),
    })
    free = F.col("left") * F.col("weight") <= cap * F.col("open")
    first = F.min_by(F.struct("left", "open"), F.when(free, F.struct(cap / F.col("weight"), F.col("source").isNull(), F.col("source")))).over(whole)
    share = F.col("first.left") * F.col("weight") / F.col("first.open")
    return steps.withColumn("first", first).select("source", "n_docs", "source_size", F.when(F.col("first").isNull() | (share > cap), cap.cast("double")).otherwise(share).alias("target"))


def _drawn(u: str, big: str, good: str, n: str) -> str:
    """Hypergeometric draw: of ``n`` from ``big`` with ``good`` good ones, the quantile at ``u``. The support is
    cut 12 standard deviations from the mean, where less than 1e-30 of it lies."""
    mean = f"({n} * CAST({good} AS DOUBLE) / greatest({big}, 1))"
    sd = f"sqrt({mean} * (1 - {good} / greatest({big}, 1)) * ({big} - {n}) / greatest({big} - 1, 1))"
    low = f"greatest(0, {n} - ({big} - {good}), CAST(floor({mean} - 12 * {sd}) AS BIGINT) - 12)"
    high = f"least({good}, {n}, CAST(ceil({mean} + 12 * {sd}) AS BIGINT) + 12)"
    step = f"CAST(({good} - k) AS DOUBLE) * ({n} - k) / ((k + 1D) * ({big} - {good} - {n} + k + 1))"
    total = f"aggregate(sequence({low}, {high}), named_struct('p', 1D, 's', 0D), (a, k) -> named_struct('p', a.p * ({step}), 's', a.s + a.p), a -> a.s)"
    return (
        f"aggregate(sequence({low}, {high}), named_struct('p', 1D, 's', 0D, 'k', CAST({low} AS BIGINT), 'goal', {u} * {total}), "
        f"(a, k) -> named_struct('p', a.p * ({step}), 's', a.s + a.p, 'k', if(a.s < a.goal, CAST(k AS BIGINT), a.k), 'goal', a.goal), a -> a.k)"
    )


def shard_quotas(draws: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``draws`` (source_no, n_draws), one row per source: (source_no, shard, first, n): shard gets the source's draws first to
    first + n - 1. The table of sources, not of documents, is folded in one row per tree node."""
    tree = draws.agg(F.sort_array(F.collect_list(F.struct("source_no", F.col("n_draws").cast("long").alias("k")))).alias("ks")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "ks")
    for _ in range(max(0, (shards - 1).bit_length())):
        split = tree.withColumn("mid", F.expr("(low + high) div 2")).withColumn("n", F.expr("aggregate(ks, 0L, (s, x) -> s + x.k)"))
        u = f"((CAST(conv(substring(md5(concat('{seed}:', low, ':', high, ':', x.source_no)), 1, 8), 16, 10) AS BIGINT) + 0.5D) / 4294967296)"
        left = _drawn(u, "acc.big", "x.k", "acc.n")
        fold = (
            f"aggregate(ks, named_struct('big', n, 'n', n * (mid - low) div (high - low), 'out', CAST(array() AS ARRAY<BIGINT>)), "
            f"(acc, x) -> aggregate(array({left}), acc, (b, l) -> named_struct('big', b.big - x.k, 'n', b.n - l, 'out', array_append(b.out, l))), acc -> acc.out)"
        )
        halves = split.withColumn("l", F.expr(f"if(high - low > 1, {fold}, transform(ks, x -> 0L))"))
        tree = halves.select(F.explode(F.expr(
            "if(high - low > 1, array("
            "named_struct('low', low, 'high', mid, 'ks', zip_with(ks, l, (x, y) -> named_struct('source_no', x.source_no, 'k', y))),"
            "named_struct('low', mid, 'high', high, 'ks', zip_with(ks, l, (x, y) -> named_struct('source_no', x.source_no, 'k', x.k - y)))),"
            "array(named_struct('low', low, 'high', high, 'ks', ks)))"
        )).alias("t")).select("t.*")
    flat = tree.select(F.col("low").alias("shard"), F.inline("ks"))
    before = F.sum("k").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("k")
    return flat.select("source_no", "shard", before.alias("first"), F.col("k").alias("n")).where("n > 0")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, shards: int | None = None, seed: str = SEED, text: str = "text", carry: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, draws: array of (pass, shard, words, place); and row, a struct of the columns to ``carry``. A
    document lies in ``shard`` once for each of its draws, with its first ``words`` words, ordered there by ``place``."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), key.alias("key"), *[F.struct(*carry).alias("row")] * bool(carry))
    sizes = stored(rows.drop("row"), "mix-sizes")
    rows = rows if carry else sizes
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    whole = F.round("target").cast("long")
    per = stored(
        targets(sizes, weights, most)
        .withColumns({"source_no": number, "blocks": F.greatest(F.lit(1), F.ceil(F.sqrt("n_docs"))).cast("long")})
        .withColumns({"passes": F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")})
        .withColumn("rest", whole - F.col("passes") * F.col("source_size")),
        "mix-sources",
    )
    if shards is None:
        words = per.agg(F.sum("source_size")).first()[0] or 0
        shards = max(SHARDS, -(-words // SHARD_WORDS))
    block = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("blocks") / F.lit(2**32)).cast("long")
    known = per.select(F.col("source").alias("s"), "source_no", "blocks")
    dealt = lambda df: df.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block).select("doc_id", "source_no", "block", "size", "key", *["row"] * ("row" in df.columns))
    totals = dealt(sizes).groupBy("source_no", "block").agg(F.sum("size").alias("block_size"))
    order = Window.partitionBy("source_no").orderBy("block")
    placed = stored(
        totals.join(per.select("source_no", "passes", "rest"), "source_no")
        .withColumns({"block_start": F.sum("block_size").over(order) - F.col("block_size"), "block_no": F.row_number().over(order) - 1, "n_blocks": F.count(F.lit(1)).over(Window.partitionBy("source_no"))})
        .withColumn("touched", (F.col("block_start") < F.col("rest")).cast("long")),
        "mix-blocks",
    )
    per_source = placed.groupBy("source_no").agg((F.max("passes") * F.max("n_blocks") + F.sum("touched")).alias("n_draws"))
    quotas = shard_quotas(per_source, shards, seed)
    passes = placed.select("source_no", "block", "n_blocks", "block_no", F.explode(F.expr("if(passes + touched > 0, sequence(0L, passes + touched - 1), CAST(array() AS ARRAY<BIGINT>))")).alias("pass"))
    draws = passes.withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("block_no"))
    runs = quotas.select("source_no", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("draw"))
    located = draws.join(runs, ["source_no", "draw"]).groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("at"))
    blocks = placed.join(located, ["source_no", "block"], "left").select("source_no", "block", "block_start", "passes", "rest", "at")
    inside = Window.partitionBy("source_no", "block").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(rows).withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(blocks, ["source_no", "block"])
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("block_start") - F.col("inside")))
    rows = rows.withColumn("part", part).withColumn("draws", F.expr(
        f"filter(transform(coalesce(at, array()), x -> named_struct('pass', x.pass, 'shard', x.shard, 'words', if(x.pass < passes, size, part), 'place', md5(concat('{seed}', x.shard, ':', x.pass, ':', key)))), x -> x.words > 0)"
    ))
    return rows.join(per.select("source_no", "source", "source_size", "target"), "source_no").select("doc_id", "source", "size", "source_size", "target", "draws", *["row"] * bool(carry))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each draw, its text cut to the words drawn and n_chars, where
    there is one and the text is cut, following it. Rows lie by shard, each shard's in the order of the mix."""
    one = mix(docs, carry=tuple(docs.columns), **how).select("size", "row", F.explode("draws").alias("draw")).select("draw.shard", "draw.place", "draw.words", "size", "row")
    words = r"split(row.text, '(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])')"
    part = F.col("words") < F.col("size")
    rows = one.withColumn("text", F.when(part, F.expr(f"array_join(slice({words}, 1, CAST(words AS INT)), '')")).otherwise(F.col("row.text")))
    changed = {"text": F.col("text"), "n_chars": F.when(part, F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place")
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draws tells each draw as pass:shard:words, comma-joined."""
    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    taken = F.expr("aggregate(draws, 0L, (s, x) -> s + x.words)")
    told = F.expr("array_join(transform(draws, x -> concat(x.pass, ':', x.shard, ':', x.words)), ',')")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), told.alias("draws"))


def _drawn_sql(u: str, big: str, good: str, n: str) -> str:
    """As :func:`_drawn`, for DuckDB."""
    mean = f"({n} * {good}::DOUBLE / greatest({big}, 1))"
    sd = f"sqrt({mean} * (1 - {good} / greatest({big}, 1)) * ({big} - {n}) / greatest({big} - 1, 1))"
    low = f"greatest(0, {n} - ({big} - {good}), floor({mean} - 12 * {sd})::BIGINT - 12)"
    support = f"range({low}, least({good}, {n}, ceil({mean} + 12 * {sd})::BIGINT + 12) + 1)"
    step = f"({good} - k)::DOUBLE * ({n} - k) / ((k + 1.0::DOUBLE) * ({big} - {good} - {n} + k + 1))"
    total = f"list_reduce({support}, lambda a, k: {{'p': a.p * ({step}), 's': a.s + a.p}}, {{'p': 1::DOUBLE, 's': 0::DOUBLE}}).s"
    return f"list_reduce({support}, lambda a, k: {{'p': a.p * ({step}), 's': a.s + a.p, 'k': CASE WHEN a.s < a.goal THEN k ELSE a.k END, 'goal': a.goal}}, {{'p': 1::DOUBLE, 's': 0::DOUBLE, 'k': ({low})::BIGINT, 'goal': {u} * {total}}}).k"


_LEFT_SQL = _drawn_sql("((('0x' || substr(md5('mix-1:' || low || ':' || high || ':' || x.source_no), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)", "acc.big", "x.k", "acc.n")

OP5_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM per),
steps AS (
  SELECT *, 3 * source_size AS cap,
         (SELECT sum(source_size) FROM per)::BIGINT
           - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_size,
         (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM weighed),
first AS (SELECT rest_size AS f_left, open AS f_open FROM steps WHERE rest_size * weight <= cap * open ORDER BY cap / weight, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_no, source_size, n_docs,
         CASE WHEN f_left IS NULL OR f_left * weight / f_open > cap THEN cap::DOUBLE ELSE f_left * weight / f_open END AS target
  FROM steps LEFT JOIN first ON true),
quota AS (
  SELECT *, greatest(1, ceil(sqrt(n_docs)))::BIGINT AS blocks,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes,
         round(target)::BIGINT - CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END * source_size AS rest FROM goals),
dealt AS (
  SELECT s.doc_id, s.size, s.key, q.*, floor(('0x' || substr(key, 1, 8))::BIGINT * blocks / 4294967296)::BIGINT AS block
  FROM sizes s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source),
totals AS (SELECT source_no, block, sum(size)::BIGINT AS block_size, any_value(passes) AS passes, any_value(rest) AS rest FROM dealt GROUP BY ALL),
placed AS (
  SELECT *, (sum(block_size) OVER w)::BIGINT - block_size AS block_start, row_number() OVER w - 1 AS block_no, count(*) OVER (PARTITION BY source_no) AS n_blocks
  FROM totals WINDOW w AS (PARTITION BY source_no ORDER BY block)),
draw_counts AS (SELECT source_no, (max(passes) * max(n_blocks) + count(*) FILTER (block_start < rest))::BIGINT AS k FROM placed GROUP BY source_no),
tree AS (
  SELECT 0::BIGINT AS low, greatest(64, ceil((SELECT sum(source_size) FROM per) / 4194304))::BIGINT AS high, list({'source_no': source_no, 'k': k} ORDER BY source_no) AS ks FROM draw_counts
  UNION ALL
  SELECT unnest([low, mid]), unnest([mid, high]), unnest([list_transform(ks, lambda x, i: {'source_no': x.source_no, 'k': l[i]}), list_transform(ks, lambda x, i: {'source_no': x.source_no, 'k': x.k - l[i]})])
  FROM (
    SELECT *, list_reduce(ks, lambda acc, x: list_reduce([@LEFT@], lambda b, y: {'big': b.big - x.k, 'n': b.n - y, 'out': list_append(b.out, y)}, acc),
      {'big': n, 'n': n * (mid - low) // (high - low), 'out': []::BIGINT[]}).out AS l
    FROM (SELECT low, high, ks, (low + high) // 2 AS mid, list_sum(list_transform(ks, lambda x: x.k))::BIGINT AS n FROM tree WHERE high - low > 1))),
flat AS (SELECT low AS shard, unnest(ks, recursive := true) FROM tree WHERE high - low = 1),
runs AS (SELECT *, (sum(k) OVER (PARTITION BY source_no ORDER BY shard))::BIGINT - k AS first FROM flat),
draws AS (SELECT source_no, block, n_blocks, block_no, unnest(range(passes + CASE WHEN block_start < rest THEN 1 ELSE 0 END)) AS pass FROM placed),
located AS (
  SELECT d.source_no, block, list({'pass': pass, 'shard': shard} ORDER BY pass, shard) AS spots
  FROM draws d JOIN runs r ON d.source_no = r.source_no AND pass * n_blocks + block_no >= first AND pass * n_blocks + block_no < first + k GROUP BY ALL),
cut AS (
  SELECT d.*, p.block_start, coalesce(l.spots, []) AS spots,
         (sum(d.size) OVER (PARTITION BY d.source_no, d.block ORDER BY d.key, d.size, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS inside
  FROM dealt d JOIN placed p USING (source_no, block) LEFT JOIN located l USING (source_no, block)),
told AS (
  SELECT *, list_filter(list_transform(spots, lambda x: {'pass': x.pass, 'shard': x.shard, 'words': CASE WHEN x.pass < passes THEN size ELSE greatest(0, least(size, rest - block_start - inside)) END}), lambda x: x.words > 0) AS d FROM cut)
SELECT doc_id, size, source_size, target, coalesce(list_sum(list_transform(d, lambda x: x.words)), 0)::BIGINT AS taken,
       array_to_string(list_transform(d, lambda x: x.pass || ':' || x.shard || ':' || x.words), ',') AS draws
FROM told
""".replace("@LEFT@", _LEFT_SQL)
