"""Quality rules: counts of whole texts, and lines labelled content or boilerplate by a linear-chain CRF.

The base rules count words, symbols, repeated lines and repeated three-word windows, and fail texts of under 50 words or
with over half of their words in repeated windows. For the others a CRF labels the sequence of lines that have a word
(Viterbi decoding), from each line's shape: symbols, bars, capitals, digits, word repeats, whether an earlier line is
equal, how many words it has. A text is kept if lines labelled content hold at least ``SHARE`` of its words.

The CRF learns from document labels in two passes, on a bounded sample: ``SAMPLE`` documents of either quality at most, none
over ``LONGEST`` characters, those with the smallest hashes of their ids. First every line takes its document's label; then lines of bad documents
that the first model finds clean become content, and the model is trained again.

Null and empty texts have no words and fail. Without labels, or with one alone, every line is content. Rows never meet,
so ties and repeated rows can't matter.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table
from .tokens import slices

SAMPLE, LONGEST, SHARE = 700, 20_000, 0.5
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEATED = 50, 50
RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, content_share double"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def repeated_words(words: list) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def lines_of(raw: bytes) -> list[tuple[bytes, list[bytes]]]:
    """The lines that have a word, with their words. Splitting bytes splits at the six ASCII spaces and at nothing else."""
    return [(line, words) for line in raw.split(b"\n") if (words := line.split())]


def line_features(lines) -> list[tuple[float, ...]]:
    """A row of numbers from 0 to 1 for each line."""
    out, seen = [], set()
    for line, words in lines:
        n, text = len(words), line.decode("utf-8", "replace")
        size = max(1, len(text))
        signs = sum(text.count(c) for c in SYMBOLS)
        bars = text.count("|")
        capitals = 0 if text.islower() else sum(map(str.isupper, text))
        out.append((
            1.0,
            min(1.0, 8 * (signs - bars) / size),
            min(1.0, 20 * bars / size),
            min(1.0, 10 * text.count("!") / size),
            capitals / size if capitals > n else 0.0,
            max(0.0, 1 - 2 * len(set(words)) / n),
            float(line in seen),
            float(n <= 3),
            float(3 < n <= 8),
            min(1.0, 4 * sum(map(str.isdigit, text)) / size) if not text.isalpha() and any(c in text for c in "0123456789") else 0.0,
        ))
        seen.add(line)
    return out


N_FEATURES = 10


def labelled_lines(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, int]]:
    """At most ``most`` texts of either quality."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.where(F.length("text").between(1, longest)).select("doc_id", "text")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    drawn = known.where("quality = 0").orderBy(*order).limit(2 * most).unionByName(known.where("quality = 1").orderBy(*order).limit(2 * most))
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    kept = rows.where("quality = 0").orderBy(*order).limit(most).unionByName(rows.where("quality = 1").orderBy(*order).limit(most))
    return [(r.text, int(r.quality)) for r in kept.select("text", "quality").collect()]


def fit_lines(sample: list[tuple[str, int]]):
    """Weights and transitions of the line CRF, label 1 being boilerplate; None if the sample has one label alone."""
    import numpy as np

    from .crf import Sequences, marginals, train

    if len({q for _, q in sample}) < 2:
        return None
    x, y, lengths = [], [], []
    for text, quality in sample:
        rows = line_features(lines_of(text.encode()))
        x += rows
        y += [1 - quality] * len(rows)
        lengths.append(len(rows))
    x, y, seq = np.array(x), np.array(y, dtype=float), Sequences(lengths)
    for _ in range(2):
        w, trans = train(lambda w: x @ w, lambda g: x.T @ g, N_FEATURES, y, seq, steps=120)
        y = y * (marginals(x @ w, trans, seq)[0] >= 0.5)
    return w, trans


def content_share(raw: bytes, model) -> tuple[int, float]:
    """Lines with a word, and the share of words on lines that Viterbi decoding labels content."""
    import numpy as np

    from .crf import viterbi

    lines = lines_of(raw)
    sizes = [len(w) for _, w in lines]
    if not lines or model is None:
        return len(lines), 1.0
    labels = viterbi(np.array(line_features(lines)) @ model[0], model[1])
    return len(lines), sum(n for n, k in zip(sizes, labels) if not k) / sum(sizes)


def judge(doc, text: str | None, model, share: float = SHARE) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > REPEATED * n
    n_lines, content = content_share(raw, model)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return doc, n, chars, sum(text.count(c) for c in SYMBOLS), again, repeats, failed, not failed and content >= share, n_lines, content


def judge_quality(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """The counts, verdicts and content share of each row of ``docs`` (doc_id, text)."""
    model = fit_lines(labelled_lines(docs, labels))

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]
        for batch in batches:
            for part in slices(batch):
                rows = [judge(d, t, model, share) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return batched(docs).select("doc_id", "text").mapInArrow(run, RESULT)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return judge_quality(docs, labels)
