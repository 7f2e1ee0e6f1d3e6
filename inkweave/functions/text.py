"""String and sequence expressions, all JVM side."""

from __future__ import annotations

import operator
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: Catalyst puts an expression that a lambda refers to into the lambda, where
    it would run for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(value: Column, places: int) -> Column:
    """To so many places by the double's exact value, ties to even. A decimal place is rarely a double, so whether a value is above or below a
    tie shows in the error of a product, which two halves of the value give exactly."""
    scale = float(10**places)

    def of(x):
        twice, high = x * (2 * scale), x * 134217729.0 - (x * 134217729.0 - x)
        error = (high * (2 * scale) - twice) + (x - high) * (2 * scale)
        whole = F.rint(twice)
        off = (twice - whole) + error
        even = 2 * F.rint(whole / 4)
        tied = F.when(off > 0, (whole + 1) / 2).when(off < 0, (whole - 1) / 2).otherwise(even)
        return F.when((whole % 2 != 0) & (F.abs(off) < 0.001), tied).otherwise(F.rint(x * scale)) / scale

    return let(value.cast("double"), of)


def trigrams(words: Column) -> Column:
    """Distinct three-character strings of the words joined by ``_``; none under three characters. From an array of single
    characters, so that no string function reads the whole line for each position."""

    def of(characters):
        indices = F.when(F.size(characters) >= 3, F.sequence(F.lit(1), F.size(characters) - 2)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(indices, lambda i: F.concat(F.get(characters, i - 1), F.get(characters, i), F.get(characters, i + 1))))

    return let(F.split(F.array_join(words, "_"), ""), of)


def jaccard(overlap: Column, left: Column, right: Column) -> Column:
    return overlap / (left + right - overlap)


def cer(hyp: Column, ref: Column) -> Column:
    """Character error rate by the longer string; 0 for two empty ones."""
    longest = F.greatest(F.length(hyp), F.length(ref))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(hyp, ref) / longest)


def _coded(words: Column, known: Column) -> Column:
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex((F.lit(983040) + F.array_position(known, w)).cast("long")), 8, "0")), "UTF-32")
    return F.array_join(F.transform(words, code), "")


def sequence_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes one private-use character (the private
    planes hold 131,000 of them)."""
    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known")), lambda x: F.levenshtein(_coded(x["a"], x["known"]), _coded(x["b"], x["known"])))


def levenshtein(a, b) -> int:
    """Edit distance of two strings or lists, exact. What both begin or end with goes first. Where the shorter one is left after deletions alone, it is the
    lengths' difference. Else a column of the table as the bits of one integer (Myers, Hyyrö), so that whole texts take a pass over the shorter one."""
    if a == b:
        return 0
    pattern, text = (a, b) if len(a) >= len(b) else (b, a)
    more, rest = len(pattern) - len(text), iter(pattern)
    if all(x in rest for x in text):
        return more
    if not more and sum(map(operator.ne, pattern, text)) == len(pattern) - (Counter(pattern) & Counter(text)).total():
        return sum(map(operator.ne, pattern, text))
    start = next(i for i, x in enumerate(text) if x != pattern[i])
    end = next(i for i in range(len(text) - start + 1) if i == len(text) - start or text[-1 - i] != pattern[-1 - i])
    pattern, text = pattern[start : len(pattern) - end], text[start : len(text) - end]
    if not text:
        return more
    at, score = {}, len(pattern)
    for i, x in enumerate(pattern):
        at.setdefault(x, []).append(i)
    masks, every, last = {}, (1 << score) - 1, 1 << (score - 1)
    for x in set(text) & at.keys():
        bits = bytearray(score // 8 + 1)
        for i in at[x]:
            bits[i >> 3] |= 1 << (i & 7)
        masks[x] = int.from_bytes(bits, "little")
    up, down = every, 0
    for x in text:
        equal = masks.get(x, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(across | up)) & every, up & across
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, equal = (more << 1) | 1, equal | down
        up, down = ((less << 1) | ~(equal | more)) & every, more & equal & every
    return score


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two columns of strings or of arrays, of any length: the JVM's fills a whole table for each pair."""

    @F.arrow_udf("int")
    def of(x, y):
        from inkweave.functions.edits import distances

        return distances(x, y)

    return of(a, b)


def increasing_length(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence: tails[k] is the least end of one of length k + 1."""
    start = F.array().cast("array<bigint>")

    def place(tails, x):
        x = x.cast("bigint")
        at = F.size(F.filter(tails, lambda t: t < x))
        return F.concat(F.slice(tails, F.lit(1), at), F.array(x), F.slice(tails, at + 2, F.greatest(F.size(tails) - at - 1, F.lit(0))))

    return F.size(F.aggregate(values, start, place))


def upper_quantile(values: Column, share: float = 0.5) -> Column:
    """The value at index ``floor(share * n)`` of the sorted array: the upper one of two medians, never between two."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) * F.lit(share)).cast("int"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def script_share(text: Column, script: str = r"\p{IsLatin}") -> tuple[Column, Column]:
    """How many characters of ``text`` are in the class, and their share."""
    n = F.length(F.regexp_replace(text, f"[^{script}]", ""))
    return n, n / F.greatest(F.lit(1), F.length(text))


def keep_line(text: Column, least: int, share: float, longest: int | None = None, script: str = r"\p{IsLatin}") -> Column:
    """Mostly in the script, with ``least`` characters of it, and no concatenated blob."""
    n, part = script_share(text, script)
    kept = (n >= least) & (part >= share)
    return kept if longest is None else kept & (F.length(text) <= longest)


#: (least, share, longest) for verse, for prose and for listings.
VERSE, PROSE, LISTING = (4, 0.5, 200), (8, 0.45, None), (6, 0.5, 200)

# --- fixed values: letters that a reader mistakes for one another ---
CONFUSED = {
    "ب": "پ", "پ": "ب", "ت": "ٹ", "ٹ": "ت", "ج": "چ", "چ": "ج", "د": "ڈ", "ڈ": "د", "ر": "ز", "ز": "ر", "ڑ": "ر", "س": "ش", "ش": "س",
    "ع": "غ", "غ": "ع", "ف": "ق", "ق": "ف", "ک": "گ", "گ": "ک", "ن": "ں", "ں": "ن", "ی": "ے", "ے": "ی", "ہ": "ھ", "ھ": "ہ",
    "ح": "خ", "خ": "ح", "ط": "ظ", "ظ": "ط", "ص": "ض", "ض": "ص",
}
# --- end of fixed values ---


def _chance(seed: str, channel: str, key: Column, place: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{channel}:"), key.cast("string"), F.lit(":"), place.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def corrupt(words: Column, rate: float, key: Column, seed: str = "0", confused: dict[str, str] = CONFUSED) -> Column:
    """Reading noise at one rate in three channels: words dropped, last letters clipped, letters confused. A hash of the
    row's key and the word's place decides, so reruns agree."""

    def noisy(w, i):
        clipped = F.when((F.length(w) > 2) & (_chance(seed, "clip", key, i) < rate), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        at = F.floor(_chance(seed, "at", key, i) * F.length(clipped)).cast("int")
        letter = F.translate(F.substr(clipped, at + 1, F.lit(1)), "".join(confused), "".join(confused.values()))
        mistaken = F.concat(F.substr(clipped, F.lit(1), at), letter, F.substr(clipped, at + 2, F.length(clipped)))
        return F.when(_chance(seed, "drop", key, i) <= rate, F.lit(None)).otherwise(F.when(_chance(seed, "confuse", key, i) < rate, mistaken).otherwise(clipped))

    return F.array_compact(F.transform(words, noisy))


def western_digits(text: Column) -> Column:
    """Persian and Arabic digits as 0 to 9."""
    blocks = "".join(chr(b + i) for b in (0x06F0, 0x0660) for i in range(10))
    return F.translate(text, blocks, "0123456789" * 2)


def first_number(text: Column) -> Column:
    """The first run of digits of either block, as a number; null without one."""
    run = F.regexp_extract(western_digits(F.coalesce(text, F.lit(""))), "([0-9]+)", 1)
    return F.when(run != "", run.cast("long"))


def page_number(path: Column) -> Column:
    run = F.regexp_extract(path, r"_([0-9]+)\.txt$", 1)
    return F.when(run != "", run.cast("long"))


def slug(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.element_at(F.split(F.rtrim(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "^[a-z]+://[^/]*", ""), F.lit("/")), "/"), -1)


def with_parameter(url: Column, parameter: str) -> Column:
    return F.concat(url, F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?")), F.lit(parameter))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def identifier(value: Column) -> Column:
    """Letters, digits and ``._-`` only; null if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(out != "", out)


def split_name(record_id: Column, seed: int = 42, validation: float = 0.1, test: float = 0.1) -> Column:
    """train, validation or test by the first 32 bits of a seeded SHA-256."""
    if validation < 0 or test < 0 or validation + test >= 1:
        raise ValueError("shares must not be negative, and total less than 1")
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), record_id), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(bucket < test, "test").when(bucket < test + validation, "validation").otherwise("train")
