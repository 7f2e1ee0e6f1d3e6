"""Sinks. Spark's committer makes a job's output appear as a whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_name

MANIFEST = "page-manifest-v1"
STATUSES = ("candidate", "aligned", "reviewed", "gold")
NEEDED = ("id", "image", "text", "image_sha256", "text_sha256", "status")


def write_json(df: DataFrame, path: str, once: bool = False) -> None:
    """JSON lines; ``once`` refuses a path that is there."""
    df.write.mode("errorifexists" if once else "overwrite").json(path)


def write_with_meta(df: DataFrame, path: str, meta: Mapping[str, object]) -> None:
    """The rows, and a summary row beside them at ``path``.meta."""
    write_json(df, path)
    row = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()])
    write_json(row.coalesce(1), f"{path}.meta")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows; raises if there are none, or one lacks the schema tag or a needed field."""
    rows = spark.read.json(path)
    lacking = [c for c in ("schema", *NEEDED) if c not in rows.columns]
    if lacking:
        raise ValueError(f"the manifest has no {', '.join(lacking)}")
    wrong = F.coalesce(F.col("schema") != MANIFEST, F.lit(True))
    missing = F.exists(F.array(*NEEDED), lambda x: F.coalesce(x, F.lit("")) == "")
    n, bad = rows.agg(F.count(F.lit(1)), F.count(F.when(wrong | missing, 1))).first()
    if not n:
        raise ValueError("the manifest has no rows")
    if bad:
        raise ValueError(f"{bad} manifest rows have another schema or lack a field")
    return rows


def exportable(manifest: DataFrame, candidates: bool = False) -> DataFrame:
    """The manifest, if every row's status may be exported."""
    allowed = STATUSES if candidates else STATUSES[2:]
    if rejected := manifest.where(~F.coalesce(F.col("status").isin(*allowed), F.lit(False))).count():
        raise ValueError(f"{rejected} rows are neither {' nor '.join(allowed)}")
    return manifest


def hash_mismatches(rows: DataFrame, content: str = "content", recorded: str = "text_sha256") -> DataFrame:
    """Rows whose content has another SHA-256 than the recorded one."""
    return rows.where(~F.coalesce(F.sha2(F.col(content), 256) == F.col(recorded), F.lit(False)))


def export_pages(manifest: DataFrame, files: DataFrame, path: str, seed: int = 42, validation: float = 0.1, test: float = 0.1) -> None:
    """The pages themselves, written once: ``path``/pages (Parquet by split: id, export_image, image, export_text, text and the manifest's other columns),
    ``path``/manifest (JSON lines) and ``path``/<split>.lst (the images' names, sorted). ``files`` (path, content) hold the images and texts; each
    has to be there, with the recorded SHA-256, before anything is written."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    of = lambda kind: files.select(name.alias(kind), F.col("content").alias(f"_{kind}")).dropDuplicates([kind])
    rows = manifest.join(of("image"), "image", "left").join(of("text"), "text", "left")
    wrong = rows.where(F.greatest(*[~F.coalesce(F.sha2(f"_{k}", 256) == F.col(f"{k}_sha256"), F.lit(False)) for k in ("image", "text")]))
    if bad := wrong.select("id").orderBy("id").limit(5).collect():
        raise ValueError("content differs from the manifest: " + ", ".join(r.id for r in bad))
    end = F.lower(F.regexp_extract("image", r"(\.[^.]*)$", 1))
    named = {"split": split_name(F.col("id"), seed, validation, test), "export_image": F.concat("id", end), "export_text": F.concat("id", F.lit(".txt"))}
    clean = manifest.withColumns(named)
    rows.withColumns(named).withColumn("image", F.col("_image")).withColumn("text", F.decode("_text", "UTF-8")).drop("_image", "_text").write.mode("errorifexists").partitionBy("split").parquet(f"{path}/pages")
    write_json(clean, f"{path}/manifest", once=True)
    for split in ("train", "validation", "test"):
        clean.where(F.col("split") == split).select("export_image").orderBy("export_image").write.mode("errorifexists").text(f"{path}/{split}.lst")
