"""Commands: ``python -m inkweave.cli ocr|states|reference|align|score|export|dictionary ...``.

Whatever asks a model is given as ``--reader module:function``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.normalise import MATCH, SCORE, tokens
from .operators import alignment, dictionary, manifest, matching, scoring
from .sources import attempts, config, models, references, sinks, texts


def _reference(spark, args):
    catalogue, poems = references.read_catalogues(spark, *args.catalogue), references.read_poems(spark, *args.poems)
    return catalogue, poems


def align(spark, args):
    given = {k: getattr(args, k) for k in config.DEFAULTS}
    settings = config.load(args.project, given, os.environ)
    verses = references.load_reference(*_reference(spark, args), partial=args.partial)
    index = matching.with_trigrams(verses, tokens)
    lines = texts.verse_lines(texts.read_files(spark, *args.pages).withColumn("page", texts.page_of()), "page")
    query = matching.with_trigrams(lines.select("page", "line", "text"), tokens)
    rows = alignment.align(query, index, settings["min_jaccard"], settings["min_lines"], settings["min_monotone"], settings["review_lines"])
    sinks.write_json(rows, args.output)
    rows = spark.read.schema(rows.schema).json(args.output)
    alignment.ordered(rows).drop("pairs").show(50, truncate=False)
    alignment.totals(rows).show()


def score(spark, args):
    read = lambda paths: texts.prose_lines(texts.read_files(spark, *paths).withColumn("page", F.lit("all"))).select(F.lit("all").alias("page"), F.monotonically_increasing_id().alias("line"), tokens(F.col("text"), MATCH).alias("words"), tokens(F.col("text"), SCORE).alias("strict"))
    scoring.prose_rates(read(args.pages), read([args.reference])).show(truncate=False)


def _files(spark, folder):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def _states(spark, folder):
    content = F.when(F.col("path").rlike(r"\.(txt|json)$"), F.decode("content", "UTF-8")).otherwise("")
    return manifest.page_states(_files(spark, folder).select("path", content.alias("content")))


def states(spark, args):
    """The states of a folder's pages, and whether the references are whole; 1 if anything is left to do."""
    found = manifest.state_counts(_states(spark, args.folder)).collect()
    print("pages: " + ", ".join(f"{r.state}={r.pages}" for r in found))
    left = sum(r.pages for r in found if r.state not in manifest.DONE)
    if args.catalogue:
        listed, poems = references.read_catalogues(spark, *args.catalogue), references.read_poems(spark, *args.poems)
        problems = references.reference_problems(listed, poems).groupBy("cat_id").pivot("problem", ["missing", "empty"]).count()
        for r in listed.groupBy("cat_id").count().join(problems, "cat_id", "left").na.fill(0).orderBy("cat_id").collect():
            print(f"{'incomplete' if r.missing + r.empty else 'ready':10} category {r.cat_id}: {r['count']} poems, {r.missing} missing, {r.empty} empty")
            left += r.missing + r.empty
    if args.directory:
        left += _directory(spark, args.directory)
    return 1 if left else 0


def _directory(spark, folder):
    r = texts.usable_files(texts.read_files(spark, f"{folder}/*.txt")).first()
    print(f"{'ready' if r.usable and not r.bad else 'incomplete':10} directory {folder}: {r.usable} usable, {r.bad} invalid")
    return r.bad + (not r.usable)


def directory(spark, args):
    return 1 if _directory(spark, args.directory) else 0


def ocr(spark, args):
    """Asks the reader for each page that has neither text nor an attempt, one after the other: it is the reader that takes the time."""
    known = {}
    for folder in sorted({str(Path(x).resolve().parent) for x in args.images}):
        known |= {r.page: r.state for r in _states(spark, folder).collect()}
    state = lambda image: next((s for page, s in known.items() if page.endswith(str(Path(image).resolve().with_suffix("")))), "pending")
    request = {"mode": args.mode, "reader": args.reader}
    done = models.read_pages(args.images, state, models.reader(args.reader), lambda image, response: attempts.record(image, response, request), args.mode, args.force)
    for image, outcome in done.items():
        print(f"{outcome:10} {image}")
    return 0 if all(x in ("complete", *manifest.DONE) for x in done.values()) else 1


def fetch(spark, args):
    """A category's listing and poems, each asked for once: the URLs have {id} where the number goes."""
    folder = Path(args.directory)
    for category in args.category:
        listing = references.cached(folder / f"cat_{category}.json", lambda: references.fetch_json(args.listing.format(id=category)))
        for poem in listing:
            references.cached(folder / f"poem_{poem['id']}.json", lambda: references.fetch_json(args.poem.format(id=poem["id"])))
        print(f"category {category}: {len(listing)} poems")


def verify(spark, args):
    problems = references.reference_problems(*_reference(spark, args))
    problems.groupBy("cat_id", "problem").count().orderBy("cat_id", "problem").show()
    return 1 if not problems.isEmpty() else 0


def make_manifest(spark, args):
    """A manifest of a folder's images, each with its text and response beside it."""
    files = _files(spark, args.folder).withColumn("page", F.regexp_replace("path", r"(\.response\.json|\.[^./]*)$", ""))
    files = files.where(~F.col("path").contains(".attempts/") & ~F.col("path").endswith(".partial.txt"))
    of = lambda end, value: F.max(F.when(F.col("path").rlike(end), value))
    content, record = F.decode("content", "UTF-8"), F.from_json(F.decode("content", "UTF-8"), "finish string, model string, request struct<mode: string>")
    rows = files.groupBy("page").agg(
        of(r"\.(jpg|jpeg|png)$", F.col("path")).alias("image"), of(r"\.(jpg|jpeg|png)$", F.sha2("content", 256)).alias("image_sha256"), of(r"\.txt$", content).alias("text"),
        F.count(F.when(F.col("path").endswith(".response.json"), 1)).alias("n"), *[of(r"\.response\.json$", record[c]).alias(c) for c in ("finish", "model")], of(r"\.response\.json$", record["request"]["mode"]).alias("mode"),
    ).where("image IS NOT NULL").withColumn("has_response", F.col("n") > 0)
    sinks.write_json(manifest.build_manifest(rows, args.dataset, args.status, args.mode, args.model), args.output, once=True)


def export(spark, args):
    rows = sinks.exportable(sinks.read_manifest(spark, args.manifest), args.allow_candidate)
    sinks.export_pages(rows, _files(spark, args.files).select("path", "content"), args.output, args.seed, args.validation, args.test)


def segment(spark, args):
    files = texts.read_files(spark, *args.pages).withColumn("page", F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1))
    lines = texts.dictionary_lines(files, "page").withColumns({"book": F.lit(args.dataset), "page_no": F.regexp_extract("page", "([0-9]+)", 1).cast("long")})
    found = dictionary.spans(lines)
    records, blocks = dictionary.entries(found), dictionary.unresolved(found)
    for name, rows in (("entries", records), ("unresolved", blocks), ("retained", dictionary.retained(records)), ("recovered", dictionary.recovered(records, blocks))):
        sinks.write_json(rows, f"{args.output}/{name}")


def extract(spark, args):
    """Entries that a model reads from page images: asked for once, checked, and written if none is wrong."""
    path = Path(args.response)
    answer = json.loads(path.read_text(encoding="utf-8")) if args.reuse_response else models.extract_once(args.images, path, models.reader(args.reader))
    allowed = [Path(x).stem for x in args.images]
    rows = dictionary.validated(spark.createDataFrame([(str(path), json.dumps(models.coerce_json(answer.get("text") or "")), allowed)], "response string, text string, allowed array<string>"), args.dataset)
    if bad := rows.where("problem IS NOT NULL").orderBy("sequence").limit(5).collect():
        raise ValueError("; ".join(f"entry {r.sequence}: {r.problem}" for r in bad))
    sinks.write_json(rows.drop("problem", "allowed"), args.output)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="inkweave", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        p = commands.add_parser(name)
        for flags, how in options:
            p.add_argument(*flags, **how)
        p.set_defaults(run=run)

    many, reference = {"nargs": "+"}, ((("--catalogue",), {"nargs": "+", "required": True}), (("--poems",), {"nargs": "+", "required": True}))
    levels = [((f"--{k.replace('_', '-')}",), {"type": type(v)}) for k, v in config.DEFAULTS.items()]
    command("align", align, (("pages",), many), *reference, (("--output",), {"required": True}), (("--project",), {}), (("--partial",), {"action": "store_true"}), *levels)
    mode, read = (("--mode",), {"choices": models.MODES}), (("--reader",), {})
    shares = ((("--seed",), {"type": int, "default": 42}), (("--validation",), {"type": float, "default": 0.1}), (("--test",), {"type": float, "default": 0.1}))
    images, output = (("images",), many), (("--output",), {"required": True})
    command("score", score, (("pages",), many), (("--reference",), {"required": True}))
    command("states", states, (("folder",), {}), (("--catalogue",), {"nargs": "+"}), (("--poems",), {"nargs": "+"}), (("--directory",), {}))
    command("ocr", ocr, images, (("--reader",), {"required": True}), (("--mode",), {"choices": models.MODES, "default": "verse"}), (("--force",), {"action": "store_true"}))
    command("verify", verify, *reference)
    command("fetch", fetch, (("category",), {"nargs": "+", "type": int}), (("--directory",), {"required": True}), (("--listing",), {"required": True}), (("--poem",), {"required": True}))
    command("directory", directory, (("directory",), {}))
    command("manifest", make_manifest, (("folder",), {}), output, (("--dataset",), {"required": True}), (("--status",), {"choices": sinks.STATUSES, "default": "candidate"}), mode, (("--model",), {}))
    command("export", export, (("manifest",), {}), (("output",), {}), (("--files",), {"required": True}), (("--allow-candidate",), {"action": "store_true"}), *shares)
    command("dictionary", segment, (("pages",), many), output, (("--dataset",), {"default": "dictionary"}))
    command("extract", extract, images, output, (("--response",), {"required": True}), read, (("--dataset",), {"default": "dictionary"}), (("--reuse-response",), {"action": "store_true"}))
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(SparkSession.builder.getOrCreate(), args) or 0
    except (ValueError, RuntimeError, FileNotFoundError, FileExistsError) as e:
        print(f"inkweave: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
