"""The reference side: catalogues and poems as JSON, checked before they are indexed, and the fetching that fills them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import strip

CATALOGUE = "id bigint, title string"
POEM = "id bigint, title string, fullTitle string, verses array<string>"


def read_catalogues(spark: SparkSession, *paths: str) -> DataFrame:
    """cat_id, id, title from cat_<id>.json files, each a list."""
    rows = spark.read.schema(CATALOGUE).option("multiLine", True).json(list(paths))
    return rows.select(F.regexp_extract(F.input_file_name(), r"cat_([0-9]+)\.json$", 1).cast("long").alias("cat_id"), "id", "title")


def read_poems(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(POEM).option("multiLine", True).json(list(paths))


def by_priority(*frames: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the first frame that has a key, then of the next."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other.join(out.select(key).distinct(), key, "left_anti"))
    return out


def reference_problems(catalogue: DataFrame, poems: DataFrame) -> DataFrame:
    """cat_id, id, problem: poems that a catalogue lists and that are missing, or have no verse with text."""
    has_text = F.exists(F.coalesce("verses", F.array().cast("array<string>")), lambda v: strip(F.coalesce(v, F.lit(""))) != "")
    known = poems.groupBy(F.col("id").alias("_id")).agg(F.max(has_text.cast("int")).alias("_ok"))
    joined = catalogue.join(known, F.col("id") == F.col("_id"), "left")
    problem = F.when(F.col("_id").isNull(), "missing").when(F.col("_ok") == 0, "empty")
    return joined.select("cat_id", "id", problem.alias("problem")).where("problem IS NOT NULL")


def load_reference(catalogue: DataFrame, poems: DataFrame, partial: bool = False, told: int = 20) -> DataFrame:
    """The verses to index: poem_id, verse, text. Raises if the reference is incomplete, unless ``partial``; only counts
    and the first ``told`` problems come to the driver. A poem that two catalogues list is indexed once."""
    problems = reference_problems(catalogue, poems)
    if not partial and (n := problems.count()):
        first = [f"cat {r.cat_id}: {r.problem} poem {r.id}" for r in problems.orderBy("cat_id", "id").limit(told).collect()]
        raise RuntimeError("the reference is incomplete:\n  " + "\n  ".join(first) + (f"\n  and {n - told} more" if n > told else ""))
    wanted = poems.join(catalogue.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    return wanted.select(F.col("id").alias("poem_id"), F.posexplode("verses").alias("verse", "text"))


def cache_totals(catalogue: DataFrame, poems: DataFrame, poet: str = "poet") -> DataFrame:
    """Listed, present and empty poems and verses by category, by poet and in all: one rollup."""
    sizes = poems.groupBy(F.col("id").alias("_id")).agg(F.max(F.size("verses")).alias("verses"))
    rows = catalogue.join(sizes, F.col("id") == F.col("_id"), "left")
    return rows.rollup(poet, "cat_id").agg(
        F.count(F.lit(1)).alias("listed"), F.count("_id").alias("files"), F.coalesce(F.sum("verses"), F.lit(0)).alias("verses"), F.count(F.when(F.col("_id").isNull(), 1)).alias("missing")
    )


def to_fetch(listing: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What a restarted fetch has left to do: the listing without what is there, and not empty."""
    return listing.join(present.select(key).distinct(), key, "left_anti")


def fetch_json(url: str, tries: int = 6, wait: Callable[[float], None] = time.sleep, opened: Callable = urllib.request.urlopen):
    """JSON from a URL. 404, 429 and server errors are throttling, and waited out with doubling pauses of 30 seconds at
    most; other codes are raised."""
    for k in range(tries):
        try:
            with opened(url, timeout=60) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in (404, 429) and e.code < 500:
                raise
        except urllib.error.URLError:
            pass
        wait(min(2**k, 30))
    raise RuntimeError(f"no answer from {url} in {tries} tries")


def cached(path: Path, fetch: Callable[[], object]):
    """What the file holds if it is there; else what is fetched, written first."""
    if path.is_file() and path.stat().st_size:
        return json.loads(path.read_text(encoding="utf-8"))
    value = fetch()
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(path.suffix + ".new")
    new.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    new.replace(path)
    return value


def move_flat_files(root: Path, work_of: dict[str, str]) -> list[str]:
    """Moves files that lie flat in ``root`` to the folder of their work, and returns their names. Running it again moves nothing."""
    moved = []
    for name, work in sorted(work_of.items()):
        old, new = root / name, root / work / name
        if old.is_file() and not new.exists():
            new.parent.mkdir(parents=True, exist_ok=True)
            old.rename(new)
            moved.append(name)
    return moved


def follow_pages(page: Callable[[int], str | None], links: Callable[[str], Iterable[str]], most: int = 60) -> list[str]:
    """Links of a paged listing in first-seen order; ends at a page without a new one."""
    seen: dict[str, None] = {}
    for number in range(1, most + 1):
        html = page(number)
        fresh = [x for x in dict.fromkeys(links(html)) if x not in seen] if html else []
        if not fresh:
            break
        seen |= dict.fromkeys(fresh)
    return list(seen)
