"""Secret scan: three patterns, and a token-efficiency test for random strings.

Base kinds, leftmost and without overlap per kind, in code points:

* ``assign``: a name such as password or api_key, a separator and a value of 6 characters or more;
* ``access``: ``AKIA`` and capitals or digits, 20 characters or more;
* ``hex``: 24 lower-case hexadecimal digits or more.

The method adds ``random``: a run of 20 characters or more from ``[A-Za-z0-9+/_-]``, with the ``=`` that pad it, that gives fewer than ``RATIO``
characters a token under a byte-level BPE vocabulary, or fewer than ``ONE_CASE`` if its letters are of one case. A
vocabulary learnt from ordinary text spells words and names in long tokens; random strings break up. Known digests
(hexadecimal runs of any case, UUIDs, base64 of digests behind ``sha256-`` and the like) and identifiers (words joined by ``_ - /`` or
case changes, with or without a number at their ends, unless one is itself long and random) are left out, as are runs without a letter (numbers, dates,
rules) and URLs up to their query or fragment. Letters of one case without a joint may be anything, so their tokens decide. Of a run that meets
URLs or spans of a base kind, the parts outside these are tested, each by itself.

Null and empty texts have no spans. Every text is scanned as a whole; rows never meet, so ties and repeated rows can't matter.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .common import batched, table
from .tokens import slices, unload, vocabulary

KINDS = ("assign", "access", "hex", "random")
LEAST, RATIO, ONE_CASE = 20, 2.0, 1.9
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: The least length stands in the patterns: a greedy run that is too short here has no longer one inside it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:sha|md)\d+[-_=:][A-Za-z0-9+/=]+)")
#: A part of an identifier, between joints. All repeats are possessive, so that no run can make it backtrack.
_PART = re.compile(r"(?:[A-Z]*+[a-z]{2,}+)++\d{0,4}+|[A-Z]{2,}+\d{0,4}+|[A-Za-z]{0,2}+\d{0,8}+[TZ]?+\d{0,8}+")
_JOINT = re.compile(r"[_/+=-]+")
_CAMEL = re.compile(r"[A-Z]*+[a-z]{2,}+(?:[A-Z]++[a-z]{2,}+)++\d{0,8}+")
#: A URL up to its query: a part of it is an identifier, whatever it looks like.
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*+://[^\s?#\"'<>]*+")
SPANS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
_ENCODING: dict[str, object] = {}


def _encoding(path: str, pattern: str):
    """tiktoken's encoding of a vocabulary of ranks, once a worker."""
    if path not in _ENCODING:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODING[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[path]


def characters_per_token(text: str, encoding) -> float:
    return len(text) / max(1, len(encoding.encode_ordinary(text)))


def _identifier(run: str) -> bool:
    """Words joined by ``_ - /``, or by changes of case alone."""
    parts = [x for x in _JOINT.split(run) if x]
    return all(map(_PART.fullmatch, parts)) if len(parts) > 1 else bool(parts and _CAMEL.fullmatch(parts[0]))


def looks_random(run: str, encoding, ratio: float = RATIO) -> bool:
    lower, upper = any("a" <= c <= "z" for c in run), any("A" <= c <= "Z" for c in run)
    if not (lower or upper) or _DIGEST.fullmatch(run):
        return False
    if _identifier(run):  # but for a part that is long enough to be a secret by itself
        return any(looks_random(x, encoding, ratio) for x in _JOINT.split(run) if LEAST <= len(x) < len(run))
    return characters_per_token(run, encoding) < (ratio if lower and upper else min(ratio, ONE_CASE))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of the three patterns."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _outside(start: int, end: int, base) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers."""
    parts = []
    for s, e in sorted((s, e) for s, _, e in base if s < end and start < e):
        if start < s:
            parts.append((start, s))
        start = max(start, e)
    return [*parts, (start, end)] if start < end else parts


def random_spans(text: str, encoding, base, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    found = []
    urls = [(m.start(), 4, m.end()) for m in _URL.finditer(text)] if "://" in text else []
    for m in _RUN.finditer(text):
        start, end = m.span()
        if _DIGEST.fullmatch(m.group()):
            continue
        for s, e in _outside(start, end, base + urls):
            if e - s >= LEAST and looks_random(text[s:e], encoding, ratio):
                found.append((s, 3, e))
    return found


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scanner(path: str, pattern: str, ratio: float = RATIO):
    """The function for mapInArrow over (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        encoding, names = _encoding(path, pattern), [x.split()[0] for x in SPANS.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    base = base_spans(text or "")
                    more = random_spans(text, encoding, base, ratio) if text else []
                    counts = [sum(k == n for _, k, _ in base) for n in range(3)]
                    rows.append((doc, *counts, len(more), hashlib.sha256(_said(base).encode()).hexdigest(), _said(base + more)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def find_secrets(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans and all spans, of each row of ``docs`` (doc_id, text)."""
    import public_tokenizers

    how = scanner(ranks or vocabulary("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, ratio)
    return batched(docs).select("doc_id", "text").mapInArrow(how, SPANS)


def redacted(docs: DataFrame, mask: str = "[secret]", ratio: float = RATIO) -> DataFrame:
    """``docs`` with each span of its texts replaced, overlapping spans together. n_chars, if there is one, follows the
    text; a null stays null."""
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    at, counted = docs.columns.index("text"), "n_chars" in docs.columns

    def clean(text: str, encoding) -> str:
        base = base_spans(text)
        out, end = [], 0
        for start, _, stop in sorted(base + random_spans(text, encoding, base, ratio)):
            if start >= end:
                out += [text[end:start], mask]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def run(batches):
        import pyarrow as pa

        unload()
        encoding = _encoding(ranks, pattern)
        for part in (x for batch in batches for x in slices(batch, at)):
            columns, texts = list(part.columns), part.column(at).to_pylist()
            after = [clean(t, encoding) if t else t for t in texts]
            columns[at] = pa.array(after, part.schema.field(at).type)
            if counted:
                k = part.schema.get_field_index("n_chars")
                lengths = [n if n is None or a == b else len(b) for n, a, b in zip(part.column(k).to_pylist(), texts, after)]
                columns[k] = pa.array(lengths, part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return batched(docs).mapInArrow(run, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
