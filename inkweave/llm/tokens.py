"""Token ids of whole texts, through the tokenizers library and a bounded cache of words.

Both vocabularies split a text at white space before any merge, and between letters and the stops behind them, so
a text's ids are its pieces' ids one after the other. :class:`ByteIds` relies on that only between single spaces
and line feeds that stand between other characters, :class:`WordIds` wherever white space as the tokenizer defines
it stands; any other text is encoded as a whole. So is a text that holds the string of a special token, which gives that
token's id as the library does, unless ``plain`` makes such strings ordinary text. Ids are little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
from array import array



def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _classes() -> bytes:
    """Latin-1 bytes by what the tokenizers' patterns make of them: s space and line feed, w other white space, 0 NUL,
    a letters and digits, "." full stop and comma, p what joins these in one run."""
    import unicodedata

    def kind(c: str) -> str:
        if c in " \n\0.,":
            return {" ": "s", "\n": "s", "\0": "0"}.get(c, ".")
        return "w" if c.isspace() else "a" if unicodedata.category(c)[0] in "LN" else "p"

    return "".join(kind(chr(i)) for i in range(256)).encode()


_CLASS, _SPACE, _BLANK = _classes(), ord("s"), ord(" ")
#: White space other than spaces and line feeds, and these two where they don't stand alone between other characters.
_ODD_SPACE = re.compile(r"[^\S \n]|[ \n]{2}|\A[ \n]|[ \n]\Z|\0")


def _kinds(text: str) -> bytes | None:
    """The class of each character; None unless all are Latin-1."""
    try:
        return text.encode("latin-1").translate(_CLASS)
    except UnicodeEncodeError:
        return None


def _stops_stand_alone(kinds: bytes) -> bool:
    """No full stop or comma follows another sign, so that the tokenizers cut before each."""
    return b"p." not in kinds and b".." not in kinds and b"0." not in kinds


#: Words encoded in one call's text; their ids are told apart by the tokens that start or end a word.
TOGETHER = 64


def _parts(ids: list[int], starts, ends) -> list[bytes]:
    raw = packed(ids)
    return [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]


class _Ids:
    #: Words kept by each worker, about 200 bytes each.
    cached = 800_000

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        #: Strings that are one token wherever they stand. Pieces may be lower-cased, so texts are searched in lower case.
        self.special = [] if plain else [str(t.content).lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hints = {t[:2] for t in self.special}
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.mark = bytearray(max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.mark[i] = self._marks(token)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [packed(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set) -> None:
        """Puts ``words`` into the cache. A full cache becomes the one before, out of which what is still in use comes back."""
        if len(self.cache) > self.cached // 2:
            self.cache, self.before = {}, self.cache
        missing = words.difference(self.cache)
        if known := {w for w in missing if w in self.before}:  # intersection() would walk the whole cache before
            self.cache.update(zip(known, map(self.before.__getitem__, known)))
            missing -= known
        simple, rest = self._sorted_out(missing)
        for i in range(0, len(simple), 64 * TOGETHER):
            groups = [simple[k : k + TOGETHER] for k in range(i, min(i + 64 * TOGETHER, len(simple)), TOGETHER)]
            for g, x in zip(groups, self.tokenizer.encode_batch_fast([self.lead + " ".join(g) for g in groups], add_special_tokens=False)):
                self.cache.update(zip(g, self._apart(x.ids, len(g))))
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            self.cache.update(zip(part, self._encode([self._alone(w) for w in part])))

    @staticmethod
    def _sorted_out(words) -> tuple[list[str], list[str]]:
        """Words that can be encoded together, divided by spaces, and the others."""
        raise NotImplementedError

    def _apart(self, ids: list[int], n: int) -> list[bytes]:
        raise NotImplementedError

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Lists of words make the cyclic garbage collector run over the whole cache, and hold no cycles."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _has_special(self, text: str) -> bool:
        return any(t in text for t in self.hints) and any(t in text.lower() for t in self.special)

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        words, odd, seen = {}, [], set()
        for i, text in enumerate(texts):
            if self._has_special(text) or (pieces := self._pieces(text)) is None:
                odd.append(i)
            else:
                words[i] = pieces
                seen.update(pieces)
        self._learn(seen)
        get = self.cache.__getitem__
        for i, pieces in words.items():
            out[i] = b"".join(map(get, pieces))
        for i, ids in zip(odd, self._encode([texts[i] for i in odd])):
            out[i] = ids
        return out


class ByteIds(_Ids):
    """Byte-level BPE: a piece's ids depend on the space before it, and on nothing else. Pieces that stand behind no space
    begin with a NUL."""

    cached = 1_200_000

    @staticmethod
    def _marks(token: str) -> bool:
        return token.startswith("\u0120")  # how a space is written

    lead = " "

    @staticmethod
    def _sorted_out(words):
        return [w for w in words if w[0] != "\0"], [w for w in words if w[0] == "\0"]

    @staticmethod
    def _alone(word: str) -> str:
        return word[1:] if word[0] == "\0" else " " + word

    def _apart(self, ids, n):
        mark = self.mark
        starts = [k for k, i in enumerate(ids) if mark[i]]
        if len(starts) != n:
            raise ValueError("words can't be told apart")
        return _parts(ids, starts, [*starts[1:], len(ids)])

    @staticmethod
    def _spaced(text: str) -> str | None:
        """The pieces of a text that isn't empty, divided by single spaces. None unless white space is single spaces and line
        feeds between other characters only."""
        if (kinds := _kinds(text)) is None:
            if _ODD_SPACE.search(text):
                return None
        elif kinds[0] == _SPACE or kinds[-1] == _SPACE or b"ss" in kinds or b"w" in kinds or b"0" in kinds:
            return None
        elif _stops_stand_alone(kinds) and " ." not in text and " ," not in text:
            text = text.replace(".", " \0.").replace(",", " \0,")
        return "\0" + text.replace("\n", " \0\n \0")

    def _ids(self, texts):
        """All texts' pieces go through one Arrow dictionary, so that Python meets each different piece of a call once."""
        out: list[bytes] = [b""] * len(texts)
        spaced, odd = {}, []
        for i, text in enumerate(texts):
            if self._has_special(text) or text and (pieces := self._spaced(text)) is None:
                odd.append(i)
            elif text:
                spaced[i] = pieces
        if spaced:
            ends, ids = self._joined(" ".join(spaced.values()))
            start = last = 0
            for i, pieces in spaced.items():
                last += pieces.count(" ") + 1
                out[i] = ids[start : (start := ends[last])]
        for i, ids in zip(odd, self._encode([texts[i] for i in odd])):
            out[i] = ids
        return out

    def _joined(self, spaced: str):
        """Where the bytes of each piece's ids end, from a 0 on, and the ids of all pieces one after the other."""
        import numpy as np
        import pyarrow as pa

        raw = f"{spaced} ".encode()
        at = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == _BLANK)
        starts = np.concatenate([[0], at + 1]).astype(np.int64, copy=False)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
        words = pieces.dictionary.buffers()[2].to_pybytes().decode().split(" ")  # each ends with its space
        words.pop()
        ids = list(map(self.cache.get, words))
        if missing := [k for k, x in enumerate(ids) if x is None]:
            self._learn({words[k] for k in missing})
            for k in missing:
                ids[k] = self.cache[words[k]]
        _, ends, data = pa.array(ids, pa.large_binary()).take(pieces.indices).buffers()
        return np.frombuffer(ends, dtype=np.int64), data.to_pybytes()


class WordIds(_Ids):
    """BPE with word ends, which lower-cases and drops white space."""

    @staticmethod
    def _marks(token: str) -> bool:
        return token.endswith("</w>")

    lead = ""

    @staticmethod
    def _sorted_out(words):
        simple = [w for w in words if w.isascii() and w.isalpha()]
        return simple, list(words.difference(simple))

    @staticmethod
    def _alone(word: str) -> str:
        return word

    def _apart(self, ids, n):
        mark = self.mark
        ends = [k + 1 for k, i in enumerate(ids) if mark[i]]
        if len(ends) != n:
            raise ValueError("words can't be told apart")
        return _parts(ids, [0, *ends], ends)

    @staticmethod
    def _pieces(text: str):
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), not to the tokenizer
            return None
        if (kinds := _kinds(text)) is not None and _stops_stand_alone(kinds):
            text = text.lower().replace(".", " .").replace(",", " ,")
        return text.split()


_LOADED: dict[tuple, _Ids] = {}


def encoder(kind: type, path: str, plain: bool = False) -> _Ids:
    """One per worker process, kept between tasks."""
    if (kind, path, plain) not in _LOADED:
        _LOADED[kind, path, plain] = kind(path, plain)
    return _LOADED[kind, path, plain]


def give_back() -> None:
    """Hands memory that is free back to the system. Arrow and malloc keep it otherwise, as long as the worker lives."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # the C library isn't glibc
        pass


def unload() -> None:
    """Drops the encoders of this worker with their caches. Spark keeps workers for the stages that follow, which may need the memory
    and no encoder; one that does loads it again."""
    _LOADED.clear()
    give_back()


def slices(batch, text="text", size: int = 4_000_000, rows: int = 1024):
    """Arrow batches cut so that each holds about ``size`` characters of its column ``text`` (name or place) at most, or one row."""
    import pyarrow.compute as pc

    texts = batch.column(text)
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)
