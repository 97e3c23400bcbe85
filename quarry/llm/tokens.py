"""Sub-word encoding through the parts of a ``tokenizers`` file, with caches.

Most of the time of the whole pipeline of a tokenizer goes into bookkeeping that ids do not
need.  So texts are cut into chunks, and chunks into the pieces of the file's pre-tokenizer;
ids of chunks and of pieces are cached.  Pieces that are not in the cache are gathered, over
texts, and encoded by the file's model in one call of the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import regex

#: Chunks and pieces whose ids a worker keeps in each of two generations, unless told otherwise; about 200 MB in all.
CACHE = 500_000
#: Characters that are split into chunks or wait for ids at once, so a very long text needs no more memory than this.
SEGMENT_CHARS = 1_000_000
#: Chunks not in the cache after which they are encoded: enough for one call, and few enough for a processor's own cache.
TOGETHER = 4_096

# White space of both pre-tokenizers (Unicode White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A chunk is a run of white space with the run of other characters after it.  Both
# supported pre-tokenizers cut between such chunks whatever stands around them, so the
# ids of a text are the ids of its chunks in order.
_CHUNKS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_WORDS = re.compile(f"[^{_SPACE}]+")
# Python's white space that is none to the pre-tokenizers.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
# Stands between chunks or pieces that are handled together; it is beyond Latin letters, so none of these holds it.
_BETWEEN = "\uffff"
# The pre-tokenizers' patterns, fixed by the files; no piece holds what stands between chunks.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = {
    "bytes": regex.compile(_CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"\s", _SPACE + _BETWEEN, 1).replace(r"\S", f"[^{_SPACE}{_BETWEEN}]").replace(r"\s", f"[{_SPACE}]")),
    # White space never gets here in this one.
    "words": regex.compile(_CONTRACTIONS + rf"|\p{{L}}+|\p{{N}}|[^{_SPACE}{_BETWEEN}\p{{L}}\p{{N}}]+"),
}
# The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTE_CHARS = np.array([b if b in _PRINTED else 256 + _OTHERS.index(b) for b in range(256)], dtype="<u2")
# No UTF-8 text holds this byte.  Here it ends a piece, and becomes the space at which the library cuts.
_END = 0xFF
_BYTE_CHARS[_END] = ord(" ")

#: The last Latin letter that is handled here.
_LATIN = "\u024f"

_encoders: dict[int, "Encoder"] = {}


def _sums(parts: list[str] | list[bytes]) -> np.ndarray:
    return np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))


def _slices(data: bytes, ends: np.ndarray) -> list[bytes]:
    at = ends.tolist()
    return [data[a:b] for a, b in zip([0, *at], at, strict=False)]


class Cache:
    """Values by key, made together when asked for.  A full cache becomes the old generation of the next."""

    def __init__(self, size: int):
        self._size, self._new, self._old = size, {}, {}

    def turn(self) -> None:
        if len(self._new) >= self._size:
            self._old, self._new = self._new, {}

    def look(self, keys: list[str]) -> list[bytes | None]:
        return list(map(self._new.get, keys))

    def values(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Values of all ``keys``; ``make`` is asked once for those that are not there, and may ask for values itself."""
        found = self.look(keys)
        missing = [k for k, v in zip(keys, found, strict=True) if v is None]
        if not missing:
            return found
        unknown = []
        for key in set(missing):
            value = self._old.get(key)
            if value is None:
                unknown.append(key)
            else:
                self._new[key] = value
        if unknown:
            self._new.update(zip(unknown, make(unknown), strict=True))
        rest = map(self._new.__getitem__, missing)
        return [next(rest) if v is None else v for v in found]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers; none is added at the ends.

    ``tokenizer_json`` is the content of a ``tokenizers`` file with a BPE model and a
    byte-level pre-tokenizer that cuts at white space.  A special token's string in a text
    is that token, as the library has it by default; the text around it is encoded part by
    part.  Files whose added tokens take in white space or need normalized text are refused.
    """

    def __init__(self, tokenizer_json: bytes, cache: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_str(tokenizer_json.decode("utf-8"))
        spec = json.loads(tokenizer_json)
        self._model, self._normalizer, self._pre = tok.model, tok.normalizer, tok.pre_tokenizer
        # The model alone, for pieces with a space after each.
        self._joined = Tokenizer(self._model)
        self._joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # Bytes of text that each id stands for.
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self._bytes = np.zeros(1 + max(spec["model"]["vocab"].values(), default=0), dtype=np.int64)
        for token, i in spec["model"]["vocab"].items():
            self._bytes[i] = len(token.removesuffix(suffix))
        self._split = _PIECES["words" if spec["normalizer"] else "bytes"].findall
        self._cache = Cache(cache or CACHE)
        self._chunks = self._cut_words if spec["normalizer"] else _CHUNKS.findall
        added = spec["added_tokens"]
        if any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must be plain strings")
        self._special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest_first = sorted(self._special, key=len, reverse=True)
        self._cut_special = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None

    def _encode_other(self, chunk: str) -> bytes:
        # Beyond Latin letters versions of Unicode differ; there the file's own parts split.
        folded = self._normalizer.normalize_str(chunk) if self._normalizer else chunk
        return array("I", [t.id for p, _ in self._pre.pre_tokenize_str(folded) for t in self._model.tokenize(p)]).tobytes()

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces go through the model at once; the bytes that ids stand for tell where the ids of a piece end."""
        data = np.frombuffer((_BETWEEN.join(pieces) + _BETWEEN).encode().replace(_BETWEEN.encode(), bytes([_END])), dtype=np.uint8)
        text = _BYTE_CHARS[data].tobytes().decode("utf-16-le")
        ids = np.array(self._joined.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        bounds = np.flatnonzero(data == _END) - np.arange(len(pieces))
        reached = np.concatenate([[0], np.cumsum(self._bytes[ids])])
        ends = np.searchsorted(reached, bounds)
        if reached[-1] != bounds[-1] or (reached[ends] != bounds).any():  # the model has no token for some byte
            return list(map(self._encode_other, pieces))
        return _slices(ids.tobytes(), 4 * ends)

    def _encode_latin(self, chunks: list[str]) -> list[bytes]:
        text = _BETWEEN.join(chunks)
        if self._normalizer:
            text = text.lower()  # all that the normalizer does to Latin letters
            chunks = text.split(_BETWEEN)
        pieces = self._split(text)
        parts = self._cache.values(pieces, self._encode_pieces)
        # Pieces hold all characters of their chunks, so these tell how many belong to each.
        counts = np.searchsorted(_sums(pieces), _sums(chunks), "right")
        return _slices(b"".join(parts), np.concatenate([[0], _sums(parts)])[counts])

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        latin = [c for c in chunks if c.isascii() or max(c) <= _LATIN]
        found = dict(zip(latin, self._encode_latin(latin), strict=True)) if latin else {}
        return [found[c] if c in found else self._encode_other(c) for c in chunks]

    def _cut_words(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        return _WORDS.findall(text) if any(c in text for c in _SEPARATORS) else text.split()

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT_CHARS:
            cut = _CUT.search(text, at + SEGMENT_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _parts(self, text: str) -> Iterator[str | bytes]:
        """Ids of special tokens, and segments of what stands between them."""
        if not any(x in text for x in self._special):
            yield from self._segments(text)
            return
        for part in self._cut_special.split(text):
            if part in self._special:
                yield self._special[part]
            else:
                yield from self._segments(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[list[bytes], int, list[bytes | None], list[str]]] = []
        missed = chars = 0

        def flush() -> None:
            nonlocal missed, chars
            self._cache.turn()
            made = iter(self._cache.values([c for *_, missing in waiting for c in missing], self._encode_chunks))
            for parts, at, found, _ in waiting:
                parts[at] = b"".join([next(made) if x is None else x for x in found])
            waiting.clear()
            missed = chars = 0

        for text, parts in zip(texts, out, strict=True):
            for part in self._parts(text):
                if isinstance(part, bytes):
                    parts.append(part)
                    continue
                chunks = self._chunks(part)
                found = self._cache.look(chunks)
                missing = [c for c, x in zip(chunks, found, strict=True) if x is None]
                if not missing:
                    parts.append(b"".join(found))
                    continue
                waiting.append((parts, len(parts), found, missing))
                parts.append(b"")
                missed, chars = missed + len(missing), chars + len(part)
                if missed >= TOGETHER or chars >= SEGMENT_CHARS:
                    flush()
        if waiting:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def encoder(tokenizer_json: bytes, cache: int | None = None) -> Encoder:
    """One encoder per worker, kept over batches and tasks of one file and bound."""
    key = hash((tokenizer_json, cache))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json, cache)
    return _encoders[key]
