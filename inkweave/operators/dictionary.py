"""Dictionary segmentation: entries out of page lines, by explicit heads, by layout and by alphabetical order.

``lines`` frames have (book, page, line, text, corrupt), in the order of (page_no, line). A book is one ordered run, as an
entry may go on over the page: windows are partitioned by book, and nothing else joins its lines. A collection is any number of books.

A line is a boundary if it begins an entry. Layout, English-term and reference heads are anchors; a heuristic
split or a lone head before a numbered definition is one only if it stands in order between its neighbouring anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import BLANK, BLANKS
from ..functions.text import let

SCHEMA = "local-dictionary-entry-v1"
# --- fixed values: heads, cues and the order of letters ---
ENGLISH = r"^([^()\[\]،۔:؛]{1,60}?)\s*\(([A-Za-z][A-Za-z0-9 ./,'&+-]{0,60})\)(\s+.*|\s*)$"
DIRECT = r"^([^()\[\]،۔:؛]{1,60}?)\s+دیکھیے\s+(.+)$"
LAYOUT = r"^(\S(?:.*?\S)?)\s*(?:\t+| {3,})(\S.*)$"
REFERENCE_TAIL = r"[۔.]?\s*\(?دیکھیے\s+(.+?)\)?[۔.]?\s*$"
SEE = "دیکھیے "
CLOSED = r"[۔.)]\s*$"
BAD_HEAD = r"[()\[\].،۔:؛!?؟\"“”؎=]"
BAD_START = ("اور", "اس", "ان", "اگر", "جس", "جو", "کہ", "کے", "کی", "کا", "کو", "میں", "نے", "پر", "سے", "وہ", "یہ", "یا")
BAD_END = (
    "اور", "اگر", "جس", "جو", "کہ", "کے", "کی", "کا", "کو", "میں", "پر", "سے", "یا", "کسی", "چند", "ایک", "وغیرہ", "ہے", "ہیں", "تھا", "تھی",
    "تھے", "والا", "والی", "والے",
)
CUES = (
    r"\(\d+\)", "دیکھیے", "بمعنی", "لغوی", "لفظی", "مرادی", "اصطلاحاً?", r"وہ\s", r"جو\s", r"جس\s", r"کسی\s", r"کوئی\s", r"ایسا\s", r"ایسی\s", r"ایسے\s",
    r"ایک\s", r"دو\s", r"تین\s", r"چار\s", r"عربی\s", r"فارسی\s", r"اردو\s", r"انگریزی\s", r"سنسکرت\s", r"یونانی\s", r"ہندی\s", r"شعر\s", r"شاعر\s",
    r"شاعری\s", r"نظم\s", r"نثر\s", r"ادب\s", r"فن\s", r"فنی\s", r"زبان\s", r"مخصوص\s", r"مترادف\s", r"مخفف\s", r"صفت\s", r"زحاف\s", r"بیان\s", r"یعنی\s",
    r"اگر\s", r"اسے\s", r"تشبیب\s", r"تشبیہ\s", r"شرح\s", r"شاہی\s", r"شمالی\s", r"لفظی\s", r"جملے\s", r"تکلف\s", r"مولوی\s", r"موسیقانہ\s", r"مشبہ\s", r"بحر\s",
    r"مظاہر\s",
)
PREFERRED = ("شاعر", "فنی", "شمالی", "اسے", "اگر", "یعنی", "تشبیب", "تشبیہ", "جملے", "تکلف", "مولوی", "موسیقانہ", "مشبہ", "بحر", "مظاہر", "صفت")
STRONG = (r"\(\d+\)", "وہ", "جو", "جس", "کسی", "کوئی", "ایسا", "ایسی", "ایسے", "ایک", "دو", "تین", "چار", "دیکھیے")
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
LETTERS = "اآبپتٹثجچحخدڈذرڑزژسشصضطظعغفقکگلمنںوہھءیے"
SCORES = {"layout": 0.92, "english_term": 0.85, "direct_reference": 0.85, "ordered_heuristic": 0.72}
REFERENCE_SCORE, RECOVERED_SCORE, RETAINED = 0.98, 0.55, 0.85
# --- end of fixed values ---


def _order():
    return Window.partitionBy("book").orderBy("page_no", "page", "line")


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda x: x != "")


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def valid_head(value: Column) -> Column:
    """2 to 60 characters, 7 words at most, no sign of running text, first letter of the Arabic block."""
    head = _trim(value)
    words = _words(head)
    return F.coalesce(
        F.length(head).between(2, 60) & (F.size(words) <= 7) & ~head.rlike(BAD_HEAD) & ~head.startswith("ع ")
        & ~F.get(words, F.lit(0)).isin(*BAD_START) & ~F.element_at(words, -1).isin(*BAD_END) & head.rlike("^[؀-ۿ]"),
        F.lit(False),
    )


def _boundary(head: Column, body: Column, term: Column, rule: str, publish: bool) -> Column:
    return F.struct(head.alias("headword"), body.alias("body"), term.alias("english_terms"), F.lit(rule).alias("rule"), F.lit(publish).alias("publish"))


def split_heuristically(line: Column) -> Column:
    """(headword, body) or null: a doubled word first; else the shortest valid head before a strong or preferred cue, or before any."""
    cue, strong, preferred = (_u(f"^(?:{'|'.join(x)}){end}") for x, end in ((CUES, ""), (STRONG, r"\s"), (PREFERRED, r"\s")))
    counts = lambda high: F.when(high >= 1, F.sequence(F.lit(1), high)).otherwise(F.array().cast("array<int>"))
    good = lambda x: valid_head(x["headword"]) & x["body"].rlike(cue)

    def of(words):
        n = F.size(words)
        part = lambda k: F.struct(F.array_join(F.slice(words, F.lit(1), k), " ").alias("headword"), F.array_join(F.slice(words, k + 1, n), " ").alias("body"))
        doubled = F.filter(counts(F.least(F.lit(6), n - 2)), lambda k: F.get(words, k - 1) == F.get(words, k))
        first = F.get(F.filter(F.transform(doubled, part), good), F.lit(0))
        found = F.filter(F.transform(counts(F.least(F.lit(6), n - 1)), part), good)
        early = F.get(F.filter(found, lambda x: x["body"].rlike(strong) | x["body"].rlike(preferred)), F.lit(0))
        return F.coalesce(first, early, F.get(found, F.lit(0)))

    return let(_words(line), of)


def classify(line: Column) -> Column:
    """The boundary that a line is, or null."""
    none = F.array().cast("array<string>")
    part = lambda p, k: F.regexp_extract(line, _u(p), k)
    rule = lambda p, b: F.when(line.rlike(_u(p)) & valid_head(part(p, 1)), b)
    layout = rule(LAYOUT, _boundary(_trim(part(LAYOUT, 1)), _trim(part(LAYOUT, 2)), none, "layout", True))
    english = rule(ENGLISH, _boundary(_trim(part(ENGLISH, 1)), _trim(part(ENGLISH, 3)), F.array(_trim(part(ENGLISH, 2))), "english_term", True))
    direct = rule(DIRECT, _boundary(_trim(part(DIRECT, 1)), F.concat(F.lit(SEE), _trim(part(DIRECT, 2))), none, "direct_reference", True))
    split = split_heuristically(line)
    return F.coalesce(layout, english, direct, F.when(split.isNotNull(), _boundary(split["headword"], split["body"], none, "heuristic", False)))


def sort_key(value: Column) -> Column:
    """The value's letters as weights in dictionary order; spaces weigh 0, strangers 1000 and their code."""
    plain = F.translate(F.regexp_replace(value, DIACRITICS, ""), "ؤئ", "وی")
    known = F.array(*map(F.lit, LETTERS))
    weight = lambda c: F.when(c.rlike(f"^{BLANK}$"), F.lit(0)).when(F.array_contains(known, c), F.array_position(known, c).cast("int")).otherwise(1000 + F.ascii(c))
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), weight)


def same_initial(a: Column, b: Column) -> Column:
    return F.coalesce(F.get(sort_key(a), F.lit(0)) == F.get(sort_key(b), F.lit(0)), F.lit(False))


def prefix(value: Column, length: int = 2) -> Column:
    return F.slice(F.filter(sort_key(value), lambda x: x > 0), 1, length)


def references(body: Column) -> Column:
    """The targets of a cross-reference at the end."""
    return F.filter(F.transform(F.split(F.regexp_extract(body, _u(REFERENCE_TAIL), 1), "[,،/]"), _trim), lambda x: x != "")


def boundaries(lines: DataFrame) -> DataFrame:
    """lines with idx (place in the book), previous_text and boundary (null where a line begins nothing)."""
    rows = lines.withColumn("idx", F.row_number().over(_order()) - 1).withColumn("previous_text", F.lag("text").over(_order()))
    numbered = valid_head(F.col("text")) & F.coalesce(F.lead("text").over(_order()).rlike(_u(r"^\(1\)")), F.lit(False))
    lone = F.when(numbered, _boundary(F.col("text"), F.lit(""), F.array().cast("array<string>"), "numbered_definition", False))
    return rows.withColumn("own", classify(F.col("text"))).withColumn("boundary", F.coalesce("own", lone))


def promoted(marked: DataFrame) -> DataFrame:
    """Boundaries alone, with ``promoted`` set on those that aren't anchors and stand in order between the nearest ones: same initial as
    both, and between their keys. Of equal keys on a page the first."""
    rows = marked.where("boundary IS NOT NULL").withColumn("key", sort_key(F.col("boundary.headword")))
    anchor = F.when(F.col("boundary.publish"), F.struct(F.col("boundary.headword").alias("head"), "key"))
    before = F.last(anchor, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(anchor, ignorenulls=True).over(_order().rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"_b": before, "_a": after})
    initial = lambda side: F.coalesce(F.get(F.col("key"), F.lit(0)) == F.get(F.col(f"{side}.key"), F.lit(0)), F.lit(False))
    fits = (F.col("_b").isNull() | (initial("_b") & (F.col("key") >= F.col("_b.key")))) & (F.col("_a").isNull() | (initial("_a") & (F.col("key") <= F.col("_a.key"))))
    rows = rows.withColumn("_f", ~F.col("boundary.publish") & (F.col("_b").isNotNull() | F.col("_a").isNotNull()) & fits)
    first = F.row_number().over(Window.partitionBy("book", "page", "key", "_f").orderBy("idx")) == 1
    return rows.withColumn("promoted", F.col("_f") & first).drop("_b", "_a", "_f")


def spans(lines: DataFrame) -> DataFrame:
    """A row for each boundary and for each run of lines under none: start and stop (idx), the lines between as an array, kind
    (entry, unresolved or no_boundary) and rule."""
    marked = boundaries(lines)
    heads = promoted(marked)
    total = F.count(F.lit(1)).over(Window.partitionBy("book"))
    ends = marked.select("book", "idx", total.alias("_n"))
    following = F.lead("idx").over(Window.partitionBy("book").orderBy("idx"))
    heads = heads.join(ends, ["book", "idx"]).withColumn("_next", F.coalesce(following, F.col("_n")))
    single = (F.col("boundary.rule") == "direct_reference") & F.col("text").rlike(_u(CLOSED))
    heads = heads.withColumn("stop", F.when(single, F.col("idx") + 1).otherwise(F.col("_next")).cast("long"))
    #: Each line's last boundary at or before it tells whether the line is covered: nothing is joined by range.
    owner = F.last(F.when(F.col("stop").isNotNull(), F.struct(F.col("idx").alias("at"), "stop")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    owned = marked.join(heads.select("book", "idx", "stop"), ["book", "idx"], "left").withColumn("owner", owner)
    owned = owned.withColumn("covered", F.coalesce(F.col("owner.stop") > F.col("idx"), F.lit(False)))
    piece = F.struct("idx", "page", "line", "text", F.col("own").isNull().alias("plain"))
    taken = owned.where("covered").groupBy("book", F.col("owner.at").alias("idx")).agg(F.array_sort(F.collect_list(piece)).alias("span"))
    rule = F.when(F.col("promoted"), "ordered_heuristic").otherwise(F.col("boundary.rule"))
    lost = ~F.col("boundary.publish") & ~F.col("promoted")
    kind = F.when(lost | F.col("corrupt"), "unresolved").otherwise("entry")
    entries = heads.join(taken, ["book", "idx"]).select("book", "idx", "stop", "_n", "page", "line", "previous_text", "boundary", kind.alias("kind"), F.when(~lost & F.col("corrupt"), "page_corruption").otherwise(rule).alias("rule"), "span")
    #: Gaps and islands over the lines that no boundary covers.
    free = owned.where("NOT covered").withColumn("_g", F.col("idx") - F.row_number().over(Window.partitionBy("book").orderBy("idx")))
    gaps = free.groupBy("book", "_g").agg(F.array_sort(F.collect_list(piece)).alias("span"), F.min_by("previous_text", "idx").alias("previous_text"), F.min("idx").alias("idx"), (F.max("idx") + 1).cast("long").alias("stop"))
    gaps = gaps.select("book", "idx", "stop", F.lit(None).cast("long").alias("_n"), F.col("span")[0]["page"].alias("page"), F.col("span")[0]["line"].alias("line"), "previous_text", F.lit(None).cast(entries.schema["boundary"].dataType).alias("boundary"), F.lit("no_boundary").alias("kind"), F.lit("no_boundary").alias("rule"), "span")
    return entries.unionByName(gaps)


def _texts(first: int = 1) -> Column:
    return F.transform(F.expr(f"slice(span, {first}, size(span))") if first > 1 else F.col("span"), lambda x: x["text"])


def _pages() -> Column:
    return F.array_distinct(F.transform("span", lambda x: x["page"]))


def entries(found: DataFrame) -> DataFrame:
    """The records of :func:`spans`."""
    rows = found.where("kind = 'entry'").withColumn("raw_text", F.array_join(_texts(), "\n"))
    body = F.filter(F.concat(F.array("boundary.body"), _texts(2)), lambda x: x != "")
    rows = rows.withColumn("definition", _trim(F.array_join(body, "\n")))
    reference = F.col("definition").startswith(SEE) & (F.size("span") == 1)
    number = F.row_number().over(Window.partitionBy("book", "page").orderBy("idx"))
    score = F.coalesce(*[F.when(F.col("rule") == k, F.lit(v)) for k, v in SCORES.items()])
    flags = F.array_compact(F.array(
        F.lit("text_only"), F.when((F.col("stop") == F.col("_n")) & ~F.col("raw_text").rlike(_u(CLOSED)), "continues_after_range"),
        F.when(F.exists(F.expr("slice(span, 2, size(span))"), lambda x: x["plain"]), "boundary_inferred"),
    ))
    last = F.element_at("span", -1)
    return rows.select(
        "book", F.lit(SCHEMA).alias("schema"), F.concat_ws("-", "book", "page", F.lpad(number.cast("string"), 3, "0")).alias("id"), F.col("boundary.headword").alias("headword"), F.col("boundary.english_terms").alias("english_terms"),
        F.when(reference, "").otherwise(F.col("definition")).alias("definition"), references(F.col("definition")).alias("cross_references"), "raw_text", _pages().alias("pages"),
        F.struct(F.struct("page", "line").alias("start"), F.struct(last["page"].alias("page"), last["line"].alias("line")).alias("end"), "rule").alias("source"),
        F.when(reference, "cross_reference").otherwise("definition").alias("entry_type"),
        F.struct(F.lit("candidate").alias("status"), F.when(reference, F.lit(REFERENCE_SCORE)).otherwise(score).alias("score"), flags.alias("flags")).alias("quality"),
    )


def unresolved(found: DataFrame) -> DataFrame:
    return found.where("kind <> 'entry'").select("book", "page", _pages().alias("pages"), "line", "previous_text", F.col("boundary.headword").alias("candidate_headword"), "rule", F.array_join(_texts(), "\n").alias("raw_text"))


def retained(records: DataFrame, least: float = RETAINED) -> DataFrame:
    return records.where((F.col("quality.score") >= least) & ~F.array_contains("quality.flags", "continues_after_range"))


def recovered(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries of lower confidence from unresolved blocks: after a closed line, with a new short head, in order between the nearest
    records or sharing two letters with one. Of equal heads the first that passes."""
    head = F.col("candidate_headword")
    first = F.get(F.split("raw_text", "\n"), F.lit(0))
    head = F.when(valid_head(head), head).otherwise(split_heuristically(first)["headword"])
    rows = blocks.where((F.col("rule") != "page_corruption") & F.coalesce(F.col("previous_text").rlike(_u(CLOSED)), F.lit(False))).withColumn("headword", head)
    rows = rows.where(valid_head(F.col("headword")) & (F.length("headword") <= 35) & (F.size(_words(F.col("headword"))) <= 5)).withColumn("key", sort_key(F.col("headword")))
    rows = rows.join(records.select("book", sort_key(F.col("headword")).alias("key")).distinct(), ["book", "key"], "left_anti")
    #: The nearest record on either side, as-of the place: one ordered pass over records and blocks together.
    place = F.struct(F.col("page").cast("long").alias("page_no"), "line")
    known = records.select("book", F.struct(F.col("source.start.page").cast("long").alias("page_no"), F.col("source.start.line").alias("line")).alias("place"), F.struct("headword", sort_key(F.col("headword")).alias("key")).alias("record"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("block"))
    asked = rows.select("book", place.alias("place"), F.lit(None).cast(known.schema["record"].dataType).alias("record"), F.struct("*").alias("block"))
    order = Window.partitionBy("book").orderBy("place")
    near = known.unionByName(asked).withColumns({"before": F.last("record", True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "after": F.first("record", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    near = near.where("block IS NOT NULL AND before IS NOT NULL AND after IS NOT NULL").select("before", "after", "block.*")
    initial = lambda side: F.get(F.col(f"{side}.key"), F.lit(0)) == F.get(F.col("key"), F.lit(0))
    two = lambda x: F.slice(F.filter(x, lambda w: w > 0), 1, 2)
    between = initial("before") & initial("after") & (F.col("before.key") < F.col("key")) & (F.col("key") < F.col("after.key"))
    support = (two(F.col("key")) == two(F.col("before.key"))) | (two(F.col("key")) == two(F.col("after.key")))
    rest = F.split("raw_text", "\n")
    body = _trim(F.concat_ws("\n", _trim(F.substr(F.get(rest, F.lit(0)), F.length("headword") + 1)), *[F.array_join(F.slice(rest, F.lit(2), F.size(rest)), "\n")]))
    near = near.where((between | support) & F.get(rest, F.lit(0)).startswith(F.col("headword"))).withColumn("definition", body).where("definition <> ''")
    once = F.row_number().over(Window.partitionBy("book", "key").orderBy(F.col("page").cast("long"), "line")) == 1
    number = F.row_number().over(Window.partitionBy("book", "page").orderBy("line"))
    return near.withColumn("_o", once).where("_o").select("book", F.concat(F.concat_ws("-", "book", "page"), F.lit("-r"), F.lpad(number.cast("string"), 3, "0")).alias("id"), "headword", "definition", references(F.col("definition")).alias("cross_references"), "raw_text", "pages", "page", "line", F.lit("ordered_recovery").alias("rule"), F.lit(RECOVERED_SCORE).alias("score"), F.array(*map(F.lit, ("text_only", "recovered", "needs_review"))).alias("flags"))


ENTRY = (
    "headword string, definition string, raw_text string, entry_type string, english_terms array<string>, cross_references array<string>, pages array<string>, "
    "examples array<struct<type: string, lines: array<string>, attribution: string>>, quality struct<score: double, flags: array<string>>"
)


def entry_problem(allowed: Column) -> Column:
    """What is wrong with a model's entry, or null; ``allowed`` has the pages it may cite."""
    blank = lambda c: _trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return (
        F.when(blank("headword"), "invalid headword").when(blank("raw_text"), "invalid raw_text").when(F.col("definition").isNull(), "invalid definition")
        .when(blank("definition") & ~F.coalesce(F.col("entry_type") == "cross_reference", F.lit(False)), "empty definition")
        .when(F.coalesce(F.size("pages"), F.lit(0)) <= 0, "invalid pages").when(F.size(F.array_except("pages", allowed)) > 0, "invalid pages")
        .when(F.exists(F.coalesce("english_terms", F.array().cast("array<string>")), lambda x: _trim(F.coalesce(x, F.lit(""))) == ""), "invalid english_terms")
        .when(F.col("examples").isNull(), "invalid examples").when(F.col("cross_references").isNull(), "invalid cross_references")
        .when(F.col("quality.flags").isNull(), "invalid quality").when(~F.coalesce(F.col("quality.score").between(0, 1), F.lit(False)), "invalid quality score")
    )


def validated(answers: DataFrame, dataset: str) -> DataFrame:
    """answers (response, text, allowed) to sequence, entry, problem and id: each entry of the JSON object's array ``entries``."""
    rows = answers.select("response", "allowed", F.posexplode(F.from_json("text", f"entries array<struct<{ENTRY.replace(' string', ': string').replace(' array', ': array').replace('quality struct', 'quality: struct').replace('::', ':')}>>")["entries"]).alias("k", "entry"))
    rows = rows.select("response", "allowed", (F.col("k") + 1).alias("sequence"), "entry.*").withColumn("problem", entry_problem(F.col("allowed")))
    page = F.get("pages", F.lit(0))
    number = F.row_number().over(Window.partitionBy("response", page).orderBy("sequence"))
    return rows.withColumn("id", F.concat_ws("-", F.lit(dataset), page, F.lpad(number.cast("string"), 3, "0")))
