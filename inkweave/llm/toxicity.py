"""Toxicity: a linear-chain CRF marks toxic spans; its marginals make a document's score.

Features of a token (a piece between white space, lower-cased) are its runs of letters and their first 4, 5 and 6
letters, of those that the labelled sample shows in toxic documents far more often than in others. Labels are a
document's only, so tokens are labelled first: a token of a toxic document counts as toxic if it has such a feature. The CRF
learns the features' weights and the transitions from these, and forward-backward gives each token's probability of
being toxic. A logistic function of the expected number of toxic tokens and of the largest probability, fitted on
the sample's labels, is the score.

The sample is bounded: ``SAMPLE`` toxic documents and ``CLEAN`` others at most, none over ``LONGEST`` characters, those with the smallest
hashes of their ids; rows whose crc32(doc_id) mod 4 is 2 are never in it. Scores cover every token of every whole text, and take no input
but the text. Tokens without features are stretches of known effect, so they cost one matrix power a stretch.

Null and empty texts have no tokens and get the score of none. Without labels, or with one label alone, every score is
the share of label 1 (0 without labels). Rows never meet, so ties and repeated rows can't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table
from .tokens import slices, unload

SAMPLE, CLEAN, LONGEST = 700, 1400, 20_000
HELD_OUT, BAR = 2, 0.3
LEAST_DOCS, LEAST_ODDS, PLAIN = 3, 25.0, 8
CACHED = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
SCORES = "doc_id bigint, held_out boolean, score double, predicted int, spans string"


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def features(token: str) -> set[str]:
    found = set()
    for run in _LETTERS.findall(token):
        found.add("w" + run)
        found.update(f"{n}{run[:n]}" for n in (4, 5, 6) if len(run) > n)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, clean: int = CLEAN, longest: int = LONGEST) -> list[tuple[str, int]]:
    """At most ``most`` toxic texts and ``clean`` others, none held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold("doc_id") != HELD_OUT)
    texts = docs.where(F.length("text").between(1, longest)).select("doc_id", "text")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    #: Twice as many as are wanted are drawn, as long texts fall out; the ids are few enough to broadcast.
    drawn = known.where("toxic = 1").orderBy(*order).limit(2 * most).unionByName(known.where("toxic = 0").orderBy(*order).limit(2 * clean))
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    kept = rows.where("toxic = 1").orderBy(*order).limit(most).unionByName(rows.where("toxic = 0").orderBy(*order).limit(clean))
    return [(r.text, int(r.toxic)) for r in kept.select("text", "toxic").collect()]


def _distinct(sample):
    """One of the sample's near copies each, else a copied document's rare words look like signs of its label."""
    seen, out = set(), []
    for text, label in sample:
        words = text.lower().split()
        key = min((hash_(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append((words, label))
    return out


def hash_(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


class Model:
    """What scoring needs, small enough to travel with a task."""

    def __init__(self, weights: dict[str, float], trans, bias: float, logistic: tuple[float, float, float]):
        self.weights, self.trans, self.bias, self.logistic = weights, trans, bias, logistic

    def __getstate__(self):
        return (self.weights, self.trans, self.bias, self.logistic)

    def __setstate__(self, state):
        self.__init__(*state)

    def potential(self, token: str) -> float:
        """The score of label 1 beyond that of a token without features; 0 for such a token."""
        get = self.weights.get
        return max((sum(get(x, 0.0) for x in features(run)) for run in _LETTERS.findall(token)), key=abs, default=0.0)

    def prepare(self):
        from .crf import Steps

        self.steps, self.cache = Steps(self.trans, self.bias), {}
        return self

    def marginals(self, words: list[str]):
        """Positions of the tokens with features, and the probability that each is toxic."""
        import numpy as np

        from .crf import sparse_marginals

        cache = self.cache
        missing = set(words).difference(cache)
        if missing:
            if len(cache) + len(missing) > CACHED:
                cache.clear()
                missing = set(words)
            for w in missing:
                cache[w] = self.potential(w)
        u = np.fromiter(map(cache.__getitem__, words), dtype=float, count=len(words))
        at = np.flatnonzero(u)
        return at, sparse_marginals(len(words), at, u[at], self.steps) if len(at) else np.empty(0)

    def score(self, p) -> float:
        a, b, c = self.logistic
        x = a + b * math.log1p(float(p.sum())) + c * float(p.max()) if len(p) else a
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def fit(sample: list[tuple[str, int]]) -> Model:
    import numpy as np

    from .crf import Sequences, train

    docs = _distinct(sample)
    toxic, clean = sum(y for _, y in docs), sum(1 - y for _, y in docs)
    share = toxic / max(1, len(docs))
    if not toxic or not clean:
        return Model({}, [[0.0, 0.0], [0.0, 0.0]], 0.0, (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    with_, without = Counter(), Counter()
    per_word: dict[str, set[str]] = {}
    for words, y in docs:
        found = set()
        for w in set(words):
            if w not in per_word:
                per_word[w] = features(w)
            found |= per_word[w]
        (with_ if y else without).update(found)
    odds = {x: (n + 0.5) / (toxic + 1) / ((without[x] + 0.5) / (clean + 1)) for x, n in with_.items() if n >= LEAST_DOCS}
    chosen = sorted(x for x, r in odds.items() if r >= LEAST_ODDS or (without[x] == 0 and with_[x] >= 2 * LEAST_DOCS and r >= LEAST_ODDS / 3))
    number = {x: k for k, x in enumerate(chosen)}
    rows, columns, y, lengths, n = [], [], [], [], 0
    numbers = {w: [number[x] for x in f if x in number] for w, f in per_word.items()}
    plain = 0
    for words, label in docs:
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            if not any(map(numbers.__getitem__, part)):
                plain += 1
                if plain % PLAIN:  # stretches without features are all alike: some of them tell as much
                    continue
            for w in part:
                found = numbers[w]
                rows += [n] * len(found)
                columns += found
                y.append(1 if label and found else 0)
                n += 1
            lengths.append(len(part))
    rows, columns, size = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), len(chosen) + 1

    def scores(w):
        return np.bincount(rows, weights=w[columns], minlength=n) + w[-1]

    def pull(g):
        return np.concatenate([np.bincount(columns, weights=g[rows], minlength=size - 1)[: size - 1], [g.sum()]])

    w, trans = train(scores, pull, size, y, Sequences(lengths), steps=80)
    model = Model({x: float(w[k]) for x, k in number.items()}, trans.tolist(), float(w[-1]), (0.0, 0.0, 0.0)).prepare()
    inputs = [(lambda p: (1.0, math.log1p(float(p.sum())) if len(p) else 0.0, float(p.max()) if len(p) else 0.0))(model.marginals(words)[1]) for words, _ in docs]
    x, label, c = np.array(inputs), np.array([v for _, v in docs], dtype=float), np.zeros(3)
    for _ in range(50):  # Newton's steps
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c = c + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (label - q) - 0.05 * c)
    return Model(model.weights, model.trans, model.bias, tuple(map(float, c)))


def _spans(text: str, at, p, bar: float) -> str:
    """start:end of the tokens that are toxic with a probability of ``bar`` or more, neighbours joined; code points."""
    hits = set(at[p >= bar].tolist())
    if not hits:
        return ""
    out, k = [], 0
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k in hits:
            if out and out[-1][2] == k - 1:
                out[-1][1:] = [m.end(), k]
            else:
                out.append([m.start(), m.end(), k])
    return ",".join(f"{s}:{e}" for s, e, _ in out)


def scorer(model: Model, bar: float = BAR):
    """The function for mapInArrow over (doc_id, text, held_out)."""

    def run(batches):
        import pyarrow as pa

        own = model.prepare()
        for batch in batches:
            for part in slices(batch):
                scores, spans = [], []
                for text in part.column("text").to_pylist():
                    words = (text or "").lower().split()
                    at, p = own.marginals(words)
                    scores.append(own.score(p))
                    spans.append(_spans(text, at, p, 0.5) if len(p) else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= bar) for s in scores], pa.int32()), pa.array(spans, pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "spans"],
                )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans (start:end in code points) of each row."""
    model = fit(labelled_sample(docs, labels))
    held = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False))
    return batched(docs).select("doc_id", "text", held.alias("held_out")).mapInArrow(scorer(model, bar), SCORES)


def drop_toxic(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """``docs`` without the rows whose score reaches ``bar``."""
    model = fit(labelled_sample(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        unload()
        own = model.prepare()
        for part in (x for batch in batches for x in slices(batch, at)):
            keep = [own.score(own.marginals((t or "").lower().split())[1]) < bar for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(keep, pa.bool_()))

    return batched(docs).mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return score_toxicity(docs, labels)
