"""Line matching: the reference line with the largest trigram Jaccard.

``index`` and ``query`` frames have one row a line, with its words and distinct trigrams. All trigrams count, however many reference lines hold
them. With a ``cap``, those that more than ``cap`` reference lines hold are left out of the query side; they still count in the size of a reference line.

Lines meet the reference in Arrow batches (:mod:`inkweave.functions.overlap`), where pairs are counted by products of matrices and never become rows; only
pairs that reach the threshold do. A reference of up to ``BLOCK`` lines is sent to each worker once, and the query isn't shuffled. A larger one is parted
into blocks, and each block meets each part of the query in a task of its own. Ties go to the smaller poem, then to the smaller verse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.overlap import Reference, joined
from ..functions.text import trigrams

#: Reference lines that one task counts at a time: their product has 1,024 numbers a line.
BLOCK = 16_384
#: The cap of the reference project, for results that are to equal its own.
CAP = 3000


def with_trigrams(lines: DataFrame, words: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Adds words and trigrams, for lines that have any. Words are made once for a line: a plain filter on them would be pushed
    down, and make them again. Trigrams are made where they are used."""
    made = F.array(F.struct(words(F.col(text)).alias("words")))
    return lines.select("*", F.inline(F.filter(made, lambda x: F.length(F.array_join(x["words"], "_")) >= 3))).withColumn("grams", trigrams(F.col("words")))


def frequencies(index: DataFrame) -> DataFrame:
    """gram, df: in how many lines each trigram stands. At most the cube of the alphabet's size."""
    return index.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def hot_grams(index: DataFrame, cap: int = CAP) -> DataFrame:
    return frequencies(index).where(F.col("df") > cap).select("gram")


def _scored(query: DataFrame, index: DataFrame, keys: tuple[str, ...], threshold: float, cap: int | None, best: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, carry, poem_id, verse, score of the pairs that share a trigram and reach the threshold; with ``best`` the best one of each row of the query, or of
    each row and block. The hot trigrams are at most the reference's trigrams by the cap."""
    at, kept = ("poem_id", "verse"), [*keys, *(c for c in carry if c not in keys)]
    schema = StructType([*(query.schema[c] for c in kept), *(index.schema[c] for c in at), StructField("score", DoubleType())])
    hot = frozenset() if cap is None else frozenset(r.gram for r in hot_grams(index, cap).toLocalIterator())
    index = index.select(*at, "words")

    def pairs(lines, reference):
        import pyarrow as pa

        line, row, score = reference.pairs(joined(lines["words"]), threshold, best)
        left, right = lines.select(kept).take(pa.array(line)), reference.rows.select(at).take(pa.array(row))
        return pa.table([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (*left.columns, *right.columns)), pa.array(score)], names=schema.names)

    some = index.limit(BLOCK + 1).toArrow()
    if len(some) <= BLOCK:
        held = query.sparkSession.sparkContext.broadcast(Reference(some, hot))

        def each(batches):
            for batch in batches:
                yield from pairs(batch, held.value).to_batches()

        return query.select(*kept, *(() if "words" in kept else ("words",))).mapInArrow(each, schema)

    parts, blocks = 4 * int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * index.count() // BLOCK)
    dealt = lambda df, by, own, other, n, m: df.withColumns({own: F.pmod(F.xxhash64(*by), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))})
    lines = dealt(query.select(*kept, *(() if "words" in kept else ("words",))), keys, "_part", "_block", parts, blocks)
    verses = dealt(index, at, "_block", "_part", blocks, parts)
    return lines.groupBy("_part", "_block").cogroup(verses.groupBy("_part", "_block")).applyInArrow(lambda x, y: pairs(x, Reference(y.select([*at, "words"]), hot)), schema)


def overlaps(query: DataFrame, index: DataFrame, keys: tuple[str, ...], threshold: float = 0.0, cap: int | None = None) -> DataFrame:
    """keys, poem_id, verse, score for the pairs of lines that share a trigram and reach the threshold."""
    return _scored(query, index, keys, threshold, cap, best=False)


def _best(scored: DataFrame, keys: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    more = [c for c in carry if c not in keys]
    best = F.min_by(F.struct(*more, "poem_id", "verse", "score"), F.struct(-F.col("score"), "poem_id", "verse"))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def best_matches(query: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("page", "line"), threshold: float = 0.3, cap: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, carry (columns of the query), poem_id, verse, score: each line's best reference line, if it reaches the threshold."""
    return _best(_scored(query, index, keys, threshold, cap, True, carry), keys, carry)


def withheld_matches(query: DataFrame, index: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("page", "line"), threshold: float = 0.3, cap: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`best_matches`, where ``truth`` (page, poem_id) isn't the page's candidate. Withheld before the best is taken; hot
    trigrams are those of the whole index."""
    scored = _scored(query, index, keys, threshold, cap, False, carry).join(truth.select("page", "poem_id").distinct(), ["page", "poem_id"], "left_anti")
    return _best(scored, keys, carry)


def line_votes(query: DataFrame, index: DataFrame, allowed: DataFrame | None = None, keys: tuple[str, ...] = ("page", "line"), least: float = 0.3, cap: int | None = None) -> DataFrame:
    """page, poem_id, votes: the sum of the lines' best scores. ``allowed`` (page, poem_id) restricts the candidates before the best is taken."""
    if allowed is None:
        best = best_matches(query, index, keys, least, cap)
    else:
        best = _best(overlaps(query, index, keys, least, cap).join(allowed.select("page", "poem_id").distinct(), ["page", "poem_id"], "left_semi"), keys)
    return best.groupBy("page", "poem_id").agg(F.sum("score").alias("votes"))


def document_frequencies(words: DataFrame, key: str = "poem_id") -> DataFrame:
    """token, df over the rows' distinct words by key."""
    return words.select(key, F.explode("words").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _rare(index: DataFrame, most: int, least_length: int) -> tuple[DataFrame, DataFrame]:
    df = document_frequencies(index)
    keys = index.select("poem_id", F.explode("words").alias("token")).distinct()
    return df, keys.join(df.where((F.length("token") >= least_length) & (F.col("df") <= most)), "token")


def shared_rare_words(query: DataFrame, index: DataFrame, most: int = 25, least_length: int = 3) -> DataFrame:
    """page, poem_id, shared: how many distinct rare words both have."""
    _, rare = _rare(index, most, least_length)
    return query.select("page", F.explode("words").alias("token")).distinct().join(rare, "token").groupBy("page", "poem_id").agg(F.count(F.lit(1)).alias("shared"))


def idf_overlap(query: DataFrame, index: DataFrame, most: int = 25, least_length: int = 3) -> DataFrame:
    """page, poem_id, weight: the same overlap, each word weighing log(poems / its poems)."""
    _, rare = _rare(index, most, least_length)
    n = index.agg(F.countDistinct("poem_id").alias("_all"))
    shared = query.select("page", F.explode("words").alias("token")).distinct().join(rare, "token").crossJoin(F.broadcast(n))
    return shared.groupBy("page", "poem_id").agg(F.sum(F.log(F.col("_all") / F.col("df"))).alias("weight"))


def ranked(scores: DataFrame, score: str, top: int = 5, page: str = "page") -> DataFrame:
    """The ``top`` candidates of each page; equal scores go by poem."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc(score), "poem_id"))).where(F.col("rank") <= top)
