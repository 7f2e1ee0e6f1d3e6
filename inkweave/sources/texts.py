"""Text scans: files of lines, with the line rules of each kind of file.

A scan of files reads each as a whole, so line numbers follow the file whatever its size or place; the same
functions take any frame that has a path and a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalise import BLANKS
from ..functions.text import base_name, stem

#: Everything that ends a line for Python's splitlines().
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HEADING = "##"
# --- fixed values: running heads of the dictionary's pages, and what a corrupt page holds ---
RUNNING_HEAD = r"(?U)^\s*(?:فر[ہه]نگ[ِ ]*ادبیات|\d+)\s*$"
CORRUPT_PAGE = r'(?U)(?:"(?:name|description)"\s*:|(?:\b\S+\s+){0,1}Steve(?:\s+\S+){20,})'
POET_SLUG = r"^.+?-([a-z]+-[a-z]+)-ghazals(?:-\d+)?$"
# --- end of fixed values ---


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _lines(texts: DataFrame, key: str, ends: str, keep, *more: Column) -> DataFrame:
    """key, line (from 0, after filtering), number (from 1, before), text, and ``more`` columns of the whole text. The array of a text's lines is
    filtered and numbered in place, so nothing is shuffled."""
    raw = F.split(F.col("text"), ends)
    marked = F.transform(raw, lambda x, i: F.struct((i + 1).alias("number"), x.alias("raw"), strip(x).alias("text")))
    kept = F.filter(marked, lambda x: (x["text"] != "") & keep(x))
    found = texts.select(F.col(key), F.struct(F.lit(0), *more).alias("_m"), F.posexplode(kept).alias("line", "_x"))
    return found.select(key, "line", F.col("_x.number").alias("number"), F.col("_x.text").alias("text"), *["_m.*"] * bool(more)).drop("col1")


def verse_lines(texts: DataFrame, key: str = "path", headings: bool = False) -> DataFrame:
    """Stripped, non-blank lines; without headings (lines that begin with ## once stripped) unless they are wanted."""
    return _lines(texts, key, r"\r\n|[\n\r]", lambda x: F.lit(True) if headings else ~x["text"].startswith(HEADING))


def prose_lines(texts: DataFrame, key: str = "path") -> DataFrame:
    """As verse, but a heading is told before stripping: an indented one stays."""
    return _lines(texts, key, r"\r\n|[\n\r]", lambda x: ~x["raw"].startswith(HEADING))


def dictionary_lines(texts: DataFrame, key: str = "path", head: str = RUNNING_HEAD) -> DataFrame:
    """Lines by every line end, with numbers as they stand in the file; without running heads and page numbers. ``corrupt``
    marks the lines of corrupt pages."""
    corrupt = F.coalesce(F.col("text").rlike(CORRUPT_PAGE), F.lit(False))
    return _lines(texts, key, LINE_ENDS, lambda x: ~x["text"].rlike(head), corrupt.alias("corrupt"))


def poems(texts: DataFrame, poet: str | None = None, least: int = 4, key: str = "path") -> DataFrame:
    """gid, poet, lines of each file with ``least`` lines or more; ``poet`` keeps those whose poet's name contains it."""
    name = stem(F.col(key).cast("string"))
    found = F.regexp_extract(name, POET_SLUG, 1)
    lines = F.filter(F.transform(F.split("text", r"\r\n|[\n\r]"), strip), lambda x: x != "")
    out = texts.select(name.alias("gid"), F.when(found != "", found).otherwise("unknown").alias("poet"), lines.alias("lines")).where(F.size("lines") >= least)
    return out.where(F.col("poet").contains(poet)) if poet else out


def images_of(paths: DataFrame) -> DataFrame:
    """path, image: the page's image beside its text, .jpg before .jpeg before .png; null if there is none."""
    page = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    rank = F.array_position(F.array(*map(F.lit, (".jpg", ".jpeg", ".png"))), F.regexp_extract("path", r"(\.[^./]*)$", 1))
    images = paths.where(rank > 0).groupBy(page(F.col("path")).alias("_page")).agg(F.min_by("path", rank).alias("image"))
    pages = paths.where(F.col("path").endswith(".txt") & ~F.col("path").endswith(".partial.txt"))
    return pages.join(images, page(F.col("path")) == F.col("_page"), "left").select("path", "image")


def usable_files(texts: DataFrame, least: int = 2, key: str = "path") -> DataFrame:
    """usable, bad: files with ``least`` non-blank lines or more, and the others."""
    n = F.size(F.filter(F.split("text", r"\r\n|[\n\r]"), lambda x: strip(x) != ""))
    return texts.agg(F.count(F.when(n >= least, 1)).alias("usable"), F.count(F.when(n < least, 1)).alias("bad"))


def page_of(path: str = "path") -> Column:
    return base_name(F.col(path))
