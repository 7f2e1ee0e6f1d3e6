"""Scoring of readings against references: verse by offset, prose by whole text, pairs line by line.

``hyp`` and ``ref`` frames have (key, line, words); words are normalised tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.text import edit_distance
from . import order
from .lineage import cut


def _spaced(words: str):
    return F.array_join(words, " ")


def _cer(hyp, ref):
    """As ``cer``, of texts of any length."""
    longest = F.greatest(F.length(hyp), F.length(ref))
    return F.when(longest == 0, F.lit(0.0)).otherwise(edit_distance(hyp, ref) / longest)


def best_offset(hyp: DataFrame, ref: DataFrame, key: str = "page") -> DataFrame:
    """key, offset, mean_cer: where in the reading the whole reference fits best, by the mean error of its lines; the first of equal
    ones. No row where the reading is shorter. A key is a unit that one task holds."""
    side = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("line").cast("long").alias("line"), _spaced("words").alias("text")))).alias(name))
    both = side(hyp, "_h").join(side(ref, "_r"), key).where(F.size("_h") >= F.size("_r"))

    def place(batches):
        import pyarrow as pa

        from inkweave.functions.edits import best_place

        for batch in batches:
            sides = [(x.offsets.to_numpy(), x.values.field("line").to_numpy(), x.values.field("text")) for x in (batch["_h"], batch["_r"])]
            found = [best_place(*[(line[at[i] : at[i + 1]], text[int(at[i]) : int(at[i + 1])].to_pylist()) for at, line, text in sides]) for i in range(len(batch))]
            rows = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(rows, pa.int64())), pa.array([found[i][1] for i in rows], pa.int32()), pa.array([found[i][0] for i in rows], pa.float64())], names=[key, "offset", "mean_cer"])

    return both.mapInArrow(place, StructType([hyp.schema[key], StructField("offset", IntegerType()), StructField("mean_cer", DoubleType())]))


def paired(hyp: DataFrame, ref: DataFrame, key: str = "page") -> DataFrame:
    """key, line, hyp, ref words of the lines that both have: the longer side's rest is cut."""
    return hyp.select(key, "line", F.col("words").alias("hyp")).join(ref.select(key, "line", F.col("words").alias("ref")), [key, "line"])


def pair_rates(pairs: DataFrame, key: str = "page") -> DataFrame:
    """Of each key: lines, exact lines, word error rate (edits by reference words) and character error without spaces."""
    rows = pairs.withColumn("_d", edit_distance(F.col("hyp"), F.col("ref"))).groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("hyp") == F.col("ref"), 1)).alias("exact_lines"),
        F.sum("_d").alias("word_edits"), F.sum(F.size("ref")).alias("ref_words"),
        F.array_sort(F.collect_list(F.struct("line", F.array_join("hyp", "").alias("h"), F.array_join("ref", "").alias("r")))).alias("_p"),
    )
    side = lambda x: F.array_join(F.transform("_p", lambda p: p[x]), "")
    return rows.select(key, "lines", "exact_lines", "word_edits", "ref_words", (F.col("word_edits") / F.greatest(F.lit(1), F.col("ref_words"))).alias("wer"), _cer(side("h"), side("r")).alias("spaceless_cer"))


def prose_rates(hyp: DataFrame, ref: DataFrame, key: str = "page") -> DataFrame:
    """Of each key's whole text: edit distances of words and of characters, by the reference's length. The frames have words (folded)
    and strict (not folded)."""
    def whole(df, side):
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "words", "strict"))).alias("_l"))
        flat = lambda c: F.flatten(F.transform("_l", lambda x: x[c]))
        return rows.select(key, F.size("_l").alias(f"{side}_lines"), flat("words").alias(f"{side}_words"), F.array_join(flat("strict"), "").alias(f"{side}_strict"))

    rows = whole(hyp, "hyp").join(whole(ref, "ref"), key)
    folded = [F.array_join(f"{s}_words", "") for s in ("hyp", "ref")]
    distances = {
        "token": (edit_distance(F.col("hyp_words"), F.col("ref_words")), F.size("ref_words")),
        "folded_character": (edit_distance(*folded), F.length(folded[1])),
        "strict_character": (edit_distance(F.col("hyp_strict"), F.col("ref_strict")), F.length("ref_strict")),
    }
    out = [key, "hyp_lines", "ref_lines", F.size("hyp_words").alias("hyp_tokens"), F.size("ref_words").alias("ref_tokens")]
    for name, (distance, size) in distances.items():
        out += [distance.alias(f"{name}_distance"), (distance / F.greatest(F.lit(1), size)).alias(f"{name}_error_rate")]
    return rows.select(*out)


def compare_sources(left: DataFrame, right: DataFrame, key: str = "slug") -> DataFrame:
    """key, line counts and character error of texts that two sources have: (key, lines, words)."""
    other = right.select(key, F.col("lines").alias("other_lines"), F.col("words").alias("_w"))
    return left.join(other, key).select(key, "lines", "other_lines", _cer(_spaced("words"), _spaced("_w")).alias("cer"))


def comparison_totals(rows: DataFrame) -> DataFrame:
    """n, identical, median_cer, max_cer, line_mismatches of :func:`compare_sources`."""
    rows = cut(rows.select("cer", (F.col("lines") != F.col("other_lines")).alias("differ")))
    sums = rows.agg(F.count(F.when(F.col("cer") == 0, 1)).alias("identical"), F.max("cer").alias("max_cer"), F.count(F.when(F.col("differ"), 1)).alias("line_mismatches"))
    return order.quantiles(rows, "cer", {"median_cer": 0.5}).crossJoin(sums).select("n", "identical", "median_cer", "max_cer", "line_mismatches")
