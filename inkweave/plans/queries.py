"""The engine's queries over the driver tables, and the same in SQL.

``documents`` are the pages and ``benchmark`` the poems, both in Latin letters; lines end at full stops and line feeds. Queries whose
rules are Urdu run on small inline tables.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import APPARATUS, APPARATUS_2, LATIN, RETRIEVAL, agreement, retrieval_merges, spaceless, tokens
from ..functions.text import PROSE, VERSE, base_name, corrupt, first_number, increasing_length, keep_line, script_share, slug, split_name, stem, trigrams
from ..operators import alignment, dictionary, discovery, evaluation, html, manifest, matching, scoring
from ..operators.lineage import cut
from ..sources import references as refs
from ..sources import texts
from .cases import CASES

#: A trigram of more reference lines than this counts as hot in ``gram_frequencies``. Matching has the operator's own cap.
HOT = 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    return tokens(text, LATIN)


def _sentences(df: DataFrame, key: str, name: str, line: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", r"[.\n]+"), texts.strip), lambda x: x != "")
    return df.where("text IS NOT NULL").select(F.col(key).alias(name), F.posexplode(parts).alias(line, "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, line, text, words, grams of all documents' sentences. One large Parquet file is few tasks, so documents are dealt out first."""
    return matching.with_trigrams(_sentences(_dealt(spark, sf_dir), "doc_id", "page", "line"), words)


def _dealt(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_trigrams(_sentences(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "poem_id", "verse"), words)


def both(spark, sf_dir):
    return pages(spark, sf_dir), poems(spark, sf_dir)


def records(spark, sf_dir):
    query, index = both(spark, sf_dir)
    return alignment.align(query, index), query, index


def kept_records(spark, sf_dir):
    """Records that several later steps read: few rows, written to the checkpoint folder."""
    found, query, index = records(spark, sf_dir)
    return cut(found), query, index


def _headed(spark, sf_dir):
    """doc_id, text: every third with a heading and an indented one, every tenth with a line that makes a page corrupt."""
    head = F.when(F.col("doc_id") % 3 == 0, "## head\n ## inner\n").otherwise("")
    end = F.when(F.col("doc_id") % 10 == 0, '\n"name": "x"').otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text", end).alias("text"))


def scan_verse(spark, sf_dir):
    return texts.verse_lines(_headed(spark, sf_dir), "doc_id").select("doc_id", "line", "text")


def scan_pairs(spark, sf_dir):
    return texts.verse_lines(_headed(spark, sf_dir), "doc_id", headings=True).select("doc_id", "line", "text")


def scan_prose(spark, sf_dir):
    return texts.prose_lines(_headed(spark, sf_dir), "doc_id").select("doc_id", "line", "text")


def scan_dictionary(spark, sf_dir):
    return texts.dictionary_lines(_headed(spark, sf_dir), "doc_id", r"^\s*\d+\s*$").select("doc_id", "line", "number", "text", "corrupt")


def page_images(spark, sf_dir):
    """Each page's image by the kind that comes first; every fourth has none."""
    k, page = F.col("doc_id") % 4, F.concat(F.lit("/scans/p"), "doc_id")
    ends = F.when(k == 0, F.array(F.lit(".png"), F.lit(".jpg"))).when(k == 1, F.array(F.lit(".jpeg"), F.lit(".png"))).when(k == 2, F.array(F.lit(".partial.txt"), F.lit(".png"))).otherwise(F.array(F.lit(".gif")))
    paths = read(spark, sf_dir, "documents").select(F.explode(F.transform(F.concat(ends, F.array(F.lit(".txt"))), lambda x: F.concat(page, x))).alias("path"))
    return texts.images_of(paths)


def first_sources(spark, sf_dir):
    """Of three sources the first that has a document."""
    of = lambda n, name: read(spark, sf_dir, "documents").where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("id"), F.lit(name).alias("source"))
    return refs.by_priority(of(3, "a"), of(2, "b"), of(1, "c"))


def held_out(spark, sf_dir):
    """Each page's best score by its lines, with all poems there, and with the one that scored best gone."""
    query, index = both(spark, sf_dir)
    votes = cut(matching.line_votes(query, index, cap=matching.CAP).withColumn("votes", F.round("votes", 6)))
    truth = matching.ranked(votes, "votes", 1).select("page", "poem_id")
    gone = matching.withheld_matches(query, index, truth, cap=matching.CAP).groupBy("page", "poem_id").agg(F.round(F.sum("score"), 6).alias("votes"))
    sizes = query.groupBy("page").agg(F.count(F.lit(1)).alias("size"))
    of = lambda scores, name: evaluation.best_normalised(scores, sizes).select("page", F.round("score", 9).alias(name))
    return of(votes, "present").join(of(gone, "absent"), "page")


def _files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("/corpus/w"), "doc_id", F.lit("-"), "lang", F.lit("-poet-ghazals-"), F.col("doc_id") % 3, F.lit(".txt")).alias("path"), "text", "lang")


def poem_files(spark, sf_dir):
    return texts.poems(_files(spark, sf_dir)).select("gid", "poet", F.size("lines").alias("n_lines"))


def file_status(spark, sf_dir):
    return texts.usable_files(_files(spark, sf_dir))


def normalised(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.array_join(words(F.col("text")), " ").alias("folded"), spaceless(F.col("text"), LATIN).alias("spaceless"), F.size(trigrams(words(F.col("text")))).alias("n_grams"))


def line_lengths(spark, sf_dir):
    n, share = script_share(F.col("text"), "a-zA-Z")
    rows = texts.verse_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "line", n.alias("n_letters"), share.alias("share"), keep_line(F.col("text"), *VERSE, "a-zA-Z").alias("is_verse"), keep_line(F.col("text"), *PROSE, "a-zA-Z").alias("is_prose"))


def word_frequencies(spark, sf_dir):
    return matching.document_frequencies(poems(spark, sf_dir))


def gram_frequencies(spark, sf_dir):
    return matching.frequencies(poems(spark, sf_dir)).withColumn("is_hot", F.col("df") > HOT)


def match_lines(spark, sf_dir):
    query, index = both(spark, sf_dir)
    return matching.best_matches(query, index)


def align(spark, sf_dir):
    return records(spark, sf_dir)[0].drop("pairs")


def align_totals(spark, sf_dir):
    return alignment.totals(records(spark, sf_dir)[0])


def align_quantiles(spark, sf_dir):
    return alignment.quantiles(records(spark, sf_dir)[0], "mean_jaccard")


def align_pages(spark, sf_dir):
    rows = alignment.page_summary(records(spark, sf_dir)[0])
    return rows.select("page", F.coalesce(F.try_element_at("tiers", F.lit("gold")), F.lit(0)).alias("gold"), F.coalesce(F.try_element_at("tiers", F.lit("review")), F.lit(0)).alias("review"), "matched_lines", "aligned_lines", "hypothesis_span_precision", "reference_span_recall")


def negative_control(spark, sf_dir):
    found, query, index = kept_records(spark, sf_dir)
    truth = found.where("tier = 'gold'").select("page", "poem_id")
    return alignment.control_rates(alignment.control(query, index, truth), truth)


def discover_gaps(spark, sf_dir):
    """Of pages whose every third line has faded, so that plain matching leaves it out."""
    docs = _dealt(spark, sf_dir)
    faded = F.when(F.col("line") % 3 == 1, F.regexp_replace("text", "([a-z]{2})[a-z]", "$1")).otherwise(F.col("text"))
    query = matching.with_trigrams(_sentences(docs, "doc_id", "page", "line").withColumn("text", faded), words)
    index = poems(spark, sf_dir)
    found = cut(alignment.align(query, index))
    return discovery.discover(found, query, index).select("page", "poem_id", "line", "verse", "jaccard", "is_global_top", "exclusion")


def line_votes(spark, sf_dir):
    query, index = both(spark, sf_dir)
    return matching.ranked(matching.line_votes(query, index), "votes").select("page", "poem_id", F.round("votes", 6).alias("votes"), "rank")


def restricted_votes(spark, sf_dir):
    query, index = both(spark, sf_dir)
    allowed = matching.shared_rare_words(query, index)
    return matching.line_votes(query, index, allowed).select("page", "poem_id", F.round("votes", 6).alias("votes"))


def rare_words(spark, sf_dir):
    query, index = both(spark, sf_dir)
    return matching.ranked(matching.shared_rare_words(query, index), "shared")


def idf_overlap(spark, sf_dir):
    query, index = both(spark, sf_dir)
    return matching.idf_overlap(query, index).select("page", "poem_id", F.round("weight", 6).alias("weight"))


def _lines(spark, sf_dir):
    """page, line, text, words of all sentences that have a word, numbered without gaps."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL").repartition("doc_id")
    parts = F.transform(F.transform(F.split("text", r"[.\n]+"), texts.strip), lambda x: F.struct(x.alias("text"), words(x).alias("words")))
    kept = docs.select(F.col("doc_id").alias("page"), F.posexplode(F.filter(parts, lambda x: F.size(x["words"]) > 0)).alias("line", "_l"))
    return kept.select("page", "line", "_l.*")


def _damage():
    return F.regexp_replace("text", "([a-z]{5})[a-z]", "$1")


def _damaged(lines):
    return lines.withColumn("words", words(_damage()))


def best_offset(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    ref = _damaged(lines.where("line >= 2")).withColumn("line", F.col("line") - 2)
    return scoring.best_offset(lines, ref).select("page", "offset", F.round("mean_cer", 9).alias("mean_cer"))


def pair_rates(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    rates = scoring.pair_rates(scoring.paired(lines, _damaged(lines)))
    return rates.select("page", "lines", "exact_lines", "word_edits", "ref_words", F.round("wer", 9).alias("wer"), F.round("spaceless_cer", 9).alias("spaceless_cer"))


def prose_rates(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    strict = lambda text: F.filter(F.split(text, " "), lambda x: x != "")
    rates = scoring.prose_rates(lines.withColumn("strict", strict(F.col("text"))), _damaged(lines).withColumn("strict", strict(_damage())))
    return rates.select("page", "hyp_lines", "ref_lines", "hyp_tokens", "ref_tokens", "folded_character_distance", F.round("folded_character_error_rate", 9).alias("folded_character_error_rate"), "strict_character_distance")


def compare_sources(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    whole = lambda df: df.groupBy(F.col("page").alias("slug")).agg(F.count(F.lit(1)).alias("lines"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda x: x["words"])).alias("words"))
    return scoring.comparison_totals(scoring.compare_sources(whole(lines), whole(_damaged(lines))))


def _rhymes(spark, sf_dir):
    lines = _sentences(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "gid", "line")
    tail = F.when(F.col("line") % 2 == 1, F.concat(F.col("text"), F.lit(" of "), F.when(F.col("gid") % 5 == 0, F.lit("the ")).otherwise(F.lit("")), F.col("gid") % 7)).otherwise(F.col("text"))
    rows = lines.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", tail.alias("t")))), lambda x: x["t"]).alias("t"))
    return evaluation.with_refrain(rows.select("gid", (F.col("gid") % 11).alias("poet"), F.transform("t", lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")).alias("lines")))


def refrains(spark, sf_dir):
    return _rhymes(spark, sf_dir).select("gid", F.array_join("radif", " ").alias("radif"))


def refrain_families(spark, sf_dir):
    return evaluation.families(_rhymes(spark, sf_dir)).select(F.array_join("radif", " ").alias("radif"), "members", "poets")


def family_sizes(spark, sf_dir):
    return evaluation.family_sizes(_rhymes(spark, sf_dir))


def refrain_share(spark, sf_dir):
    return evaluation.refrain_share(_rhymes(spark, sf_dir))


def trial_pool(spark, sf_dir):
    return evaluation.trial_pool(_rhymes(spark, sf_dir)).select("gid")


def threshold_sweep(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    score = F.length(F.regexp_replace("text", "[^#*$%&|<>!]", "")) / F.greatest(F.lit(1), F.length("text"))
    return evaluation.sweep(docs.join(labels, "doc_id").select(F.round(-score, 3).alias("score"), (F.col("quality") == 1).alias("present")))


def rising_steps(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page_no"), F.when(F.col("doc_id") % 4 != 1, F.col("n_chars") % 97).alias("number"))
    return evaluation.rising_steps(rows)


def retrieval_report(spark, sf_dir):
    query, index = both(spark, sf_dir)
    scores = cut(matching.line_votes(query, index, cap=matching.CAP).withColumn("votes", F.round("votes", 6)))
    truth = scores.groupBy("page").agg(F.min("poem_id").alias("poem_id"))
    refrains = index.select("poem_id", F.array((F.col("poem_id") % 3).cast("string")).alias("radif")).distinct()
    report = evaluation.retrieval_report(scores, truth, refrains)
    return report.withColumn("margin_median", F.round("margin_median", 6))


def increasing_runs(spark, sf_dir):
    """Of each text's line lengths, as alignment takes it of a page's verses; no array is longer than a text."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", r"\n"), lambda x: F.length(x).cast("long")).alias("v")).where("v IS NOT NULL")
    return rows.select("doc_id", increasing_length(F.col("v")).alias("longest"), F.size("v").alias("n"))


def split_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(split_name(F.concat(F.lit("page-"), F.col("doc_id").cast("string"))).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("pages"))


def _images(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("/scans/book_"), "doc_id", F.lit(".jpg")).alias("image"), F.sha2("source", 256).alias("image_sha256"), F.when(F.col("text") == "", None).otherwise(F.col("text")).alias("text"),
        F.lit(True).alias("has_response"), F.lit("STOP").alias("finish"), F.lit("verse").alias("mode"), F.lit("reader").alias("model"),
    )


def build_manifest(spark, sf_dir):
    return manifest.build_manifest(_images(spark, sf_dir).where("text IS NOT NULL"), "My book!", model="m1").select("id", "page", "image", "text", "image_sha256", "text_sha256", "status", "mode")


def hash_mismatches(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    from ..sources.sinks import hash_mismatches as mismatches

    return mismatches(rows).select("doc_id")


def page_alignment(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("text_name"))
    rows = read(spark, sf_dir, "labels").select(F.concat("doc_id", F.lit(".txt")).alias("page"), F.col("quality").cast("string").alias("summary"))
    return manifest.with_alignment(docs, rows.union(spark.range(1).select(F.lit("*"), F.lit("whole book"))))


def _listing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    k, page = F.col("doc_id") % 10, F.concat(F.lit("p"), "doc_id")
    record = lambda finish, t: F.to_json(F.struct(F.lit(finish).alias("finish"), t.alias("text")))
    some = lambda when, end, content: F.when(when, F.struct(F.concat(page, F.lit(end)).alias("path"), content.alias("content")))
    files = F.array_compact(F.array(
        some(F.lit(True), ".jpg", F.lit("")), some(k.isin(0, 1, 2, 6, 7), ".txt", F.col("t")), some(k.isin(0, 7), ".response.json", record("STOP", F.col("t"))), some(k == 1, ".response.json", record("STOP", F.lit("other"))),
        some(k == 3, ".partial.txt", F.lit("begun")), some(k == 4, ".attempts/2024.response.json", record("MAX", F.lit(""))), some(k == 6, ".response.json", F.lit("[1, 2]")), some(k == 7, ".attempts/2025.response.json", F.lit("{broken")),
    ))
    return docs.select(F.explode(files).alias("f")).select("f.*")


def page_states(spark, sf_dir):
    return manifest.page_states(_listing(spark, sf_dir), empty=True)


def state_counts(spark, sf_dir):
    return manifest.state_counts(page_states(spark, sf_dir))


def last_attempts(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations")
    rows = talks.select(F.col("conv_id").alias("page"), F.col("turn").alias("id"), F.when(F.col("turn") % 5 == 4, "lost").alias("error"), "text", F.when(F.col("role") == "assistant", "STOP").otherwise("MAX").alias("finish"))
    last = manifest.last_attempts(rows).select("page", F.col("id").alias("last_id"))
    return last.join(manifest.published(rows).select("page", F.col("id").alias("published_id")), "page", "left")


def html_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(html.visible_lines(F.col("html"))).alias("line", "text"))
    return rows


def kept_html_lines(spark, sf_dir):
    kept = html.kept_lines(F.col("html"), chrome=(), rule=(6, 0.5, 200), script="a-zA-Z", bars=False)
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(kept).alias("line", "text"))


def page_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"), "^/[A-Za-z]+$")).alias("link"))


def links_to_fetch(spark, sf_dir):
    rows = read(spark, sf_dir, "pages")
    listing = rows.select(F.explode(html.links(F.col("html"), "^/[A-Za-z]+$")).alias("link")).distinct()
    present = listing.where(F.length("link") % 2 == 0)
    return refs.to_fetch(listing, present, "link")


def url_parts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", slug(F.col("url")).alias("slug"), base_name(F.col("url")).alias("base_name"), stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"))


def _catalogue(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    listed = docs.select(F.pmod("doc_id", F.lit(6)).alias("cat_id"), F.col("doc_id").alias("id"), "source", "lang")
    files = docs.where("doc_id % 9 <> 2").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.lit("").alias("fullTitle"), F.when(F.col("doc_id") % 9 == 4, F.array(F.lit(" "))).otherwise(F.split("text", "\n")).alias("verses"))
    return listed, files


def reference_problems(spark, sf_dir):
    return refs.reference_problems(*_catalogue(spark, sf_dir))


def cache_totals(spark, sf_dir):
    listed, files = _catalogue(spark, sf_dir)
    return refs.cache_totals(listed.withColumn("poet", F.col("lang")), files)


def reference_verses(spark, sf_dir):
    listed, files = _catalogue(spark, sf_dir)
    return refs.load_reference(listed, files, partial=True).select("poem_id", "verse", F.length("text").alias("n_chars"))


def persian_numbers(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES (1, 'غزل ۱۲۳'), (2, '٤٥ and 6'), (3, 'none'), (4, CAST(NULL AS STRING)) AS t(id, title)")
    return rows.select("id", first_number(F.col("title")).alias("number"))


def reading_noise(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").withColumn("words", words(F.col("text")))
    return rows.select("item_id", F.size("words").alias("before"), F.size(corrupt(F.col("words"), 0.3, F.col("item_id"))).alias("after"))


def agreement_levels(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES ('كتاب', 'کتاب'), ('دیدۂ', 'دیدہ'), ('دِل', 'دل'), ('در خور', 'درخور'), ('گل', 'گل'), ('گل', 'دل') AS t(a, b)")
    return rows.withColumn("level", agreement(F.col("a"), F.col("b"), APPARATUS))


def normalisation_cases(spark, sf_dir):
    """Whether each pair merges under its profile, and no later than it should."""
    rows = spark.createDataFrame([(k, *case) for k, case in enumerate(CASES)], "id int, a string, b string, profile string, expected boolean, latest string")
    a, b, names = F.col("a"), F.col("b"), F.array(*map(F.lit, ("identical", *[x["name"] for x in APPARATUS["levels"]])))
    at = F.when(F.col("profile") == "apparatus", agreement(a, b, APPARATUS)).when(F.col("profile") == "apparatus2", agreement(a, b, APPARATUS_2))
    same = F.when(F.col("profile") == "retrieval", retrieval_merges(a, b)).when(F.col("profile") == "retrieval-spaceless", spaceless(a, RETRIEVAL) == spaceless(b, RETRIEVAL)).otherwise(at.isNotNull())
    return rows.select("id", same.alias("merged"), (F.array_position(names, at) <= F.array_position(names, F.col("latest"))).alias("early_enough"))


#: Pages of small books: a reference between entries, a head in order between two others, a line under no head, a page that isn't text.
_BOOKS = {
    ("a", "017"): ("آپ آرٹ (op art) دیکھیے آپٹک آرٹ۔", "آپٹک آرٹ (optic art) بصری فن۔"),
    ("b", "275"): ("ترکیب (composition) تعریف۔", "ترکیب بند نظم کے بند کی ایک ہیئت۔", "ترکیبی زبانیں (organic languages) تعریف۔"),
    ("c", "017"): ("آزاد روپ دیکھیے آزاد صرفیہ۔", "ناقابل شناخت اگلا اندراج"),
    ("d", "817"): ("نیاناول دیکھیے جدید ناول۔", '"name": "نیچری", "description": "خراب"'),
}


def _book_spans(spark):
    rows = [(book, page, int(page), n, text, book == "d") for (book, page), lines in _BOOKS.items() for n, text in enumerate(lines, 1)]
    return dictionary.spans(spark.createDataFrame(rows, "book string, page string, page_no bigint, line bigint, text string, corrupt boolean"))


def dictionary_books(spark, sf_dir):
    rows = dictionary.entries(_book_spans(spark))
    return rows.select("id", "headword", F.array_join("english_terms", "|").alias("terms"), F.array_join("cross_references", "|").alias("targets"), "entry_type", F.col("source.rule").alias("rule"), F.col("source.start.line").alias("line"))


def dictionary_unresolved(spark, sf_dir):
    return dictionary.unresolved(_book_spans(spark)).select("book", "rule", F.instr("raw_text", "ناقابل").alias("found_at"))


def dictionary_recovery(spark, sf_dir):
    """Of three blocks between two records: the one in order comes back; not the one behind an open line, nor the one out of order."""
    place = "struct<start: struct<page: string, line: bigint>>"
    records = spark.createDataFrame([("f", "اباحی", (("029", 1),)), ("f", "ابتدا و ضرب", (("029", 10),))], f"book string, headword string, source {place}")
    known = "پچھلا اندراج مکمل۔"
    blocks = [("f", "029", ["029"], 5, known, "اَبَتَث", "heuristic", "اَبَتَث مفرد حروف کا مجموعہ۔"), ("f", "029", ["029"], 6, "پچھلا اندراج", "اَبَتَج", "heuristic", "اَبَتَج مفرد حروف کا مجموعہ۔"), ("f", "029", ["029"], 7, known, "نثر", "heuristic", "نثر مفرد حروف کا مجموعہ۔")]
    rows = dictionary.recovered(records, spark.createDataFrame(blocks, "book string, page string, pages array<string>, line bigint, previous_text string, candidate_headword string, rule string, raw_text string"))
    return rows.select("id", "headword", "definition", "rule", F.array_contains("flags", "needs_review").alias("needs_review"))


def dictionary_validation(spark, sf_dir):
    """A model's entries of two pages: ordinals by page, an empty definition for a reference alone, pages that weren't asked."""
    entry = lambda head, page, definition="تعریف", kind="definition", score=1.0: {"headword": head, "english_terms": None, "definition": definition, "examples": [], "cross_references": [], "raw_text": f"{head} x", "pages": [page], "entry_type": kind, "quality": {"score": score, "flags": []}}
    found = [entry("اول", "017"), entry("دوم", "017"), entry("سوم", "018"), entry("آتم کتھا", "018", "", "cross_reference"), entry("چار", "018", ""), entry("پانچ", "019"), entry(" ", "017"), entry("چھ", "017", score=1.5)]
    rows = spark.createDataFrame([("r", json.dumps({"entries": found}), ["017", "018"])], "response string, text string, allowed array<string>")
    return dictionary.validated(rows, "farhang").select("sequence", "id", "headword", "problem")


def dictionary_entries(spark, sf_dir):
    lines = ["اتب   وہ لفظ جو پہلے آئے۔", "دوسری سطر۔", "اجب (Term) ایک لفظ ہے۔", "اخر دیکھیے اتب۔", "بےحد", "کوئی سطر نہیں"]
    rows = spark.sql("SELECT " + "inline(array(" + ", ".join(f"named_struct('book', 'b', 'page', '1', 'page_no', 1L, 'line', {i}L, 'text', '{t}', 'corrupt', false)" for i, t in enumerate(lines, 1)) + "))")
    return dictionary.entries(dictionary.spans(rows)).select("id", "headword", "definition", "entry_type", F.col("quality.score").alias("score"), F.col("source.rule").alias("rule"))


QUERIES = {f.__name__: f for f in (
    scan_verse, scan_pairs, scan_prose, scan_dictionary, page_images, first_sources, held_out, poem_files, file_status, normalised, line_lengths, word_frequencies, gram_frequencies, match_lines, align, align_totals, align_quantiles, align_pages, negative_control,
    discover_gaps, line_votes, restricted_votes, rare_words, idf_overlap, best_offset, pair_rates, prose_rates, compare_sources, refrains, refrain_families, family_sizes, refrain_share, trial_pool, threshold_sweep,
    rising_steps, retrieval_report, increasing_runs, split_counts, build_manifest, hash_mismatches, page_alignment, page_states, state_counts, last_attempts, html_lines, kept_html_lines, page_links, links_to_fetch, url_parts,
    reference_problems, cache_totals, reference_verses, persian_numbers, reading_noise, agreement_levels, normalisation_cases,
    dictionary_entries, dictionary_books, dictionary_unresolved, dictionary_recovery, dictionary_validation,
)}
