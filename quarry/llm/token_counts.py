"""Word-piece counts by linear longest-match.

Greedy word-piece cuts the longest piece of the vocabulary off the front of a word, again
and again.  The automaton is a trie of the pieces; a node that cannot go on with the next
character pops the pieces that its string begins with and goes on at the node of the rest
(its failure link).  Links and the numbers of pieces they pop are computed once, so a word
is read once, character by character, and no piece is ever built.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import prepare

#: Stands before a word; pieces that begin a word begin with it.
MARKER = "▁"
#: Words whose counts a worker keeps in each of two generations.
CACHE = 400_000
_WORDS = re.compile(r"\w+|[^\w\s]")
_BLANK = re.compile(r"\s")
#: Characters of a text whose words are listed at once.
PIECE = 1 << 20


class Automaton:
    def __init__(self, pieces: Iterable[str]):
        self._next: list[dict[str, int]] = [{}]
        self._fail: list[int] = [-1]  # -1: no way on, the word is unknown
        self._pops: list[int] = [0]
        ends: set[int] = set()
        for piece in pieces:
            node = 0
            for c in piece:
                node = self._next[node].setdefault(c, len(self._next))
                if node == len(self._next):
                    self._next.append({})
            if node:
                ends.add(node)
        self._fail = [-1] * len(self._next)
        self._pops = [0] * len(self._next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self._next[u].items():
                queue.append(v)
                if v in ends:
                    self._fail[v], self._pops[v] = 0, 1
                    continue
                z, popped = self._fail[u], self._pops[u]
                while z >= 0 and c not in self._next[z]:
                    popped += self._pops[z]
                    z = self._fail[z]
                if z >= 0:
                    self._fail[v], self._pops[v] = self._next[z][c], popped

    def count(self, marked: str) -> int:
        """Pieces of a marked word; -1 if it cannot be cut into pieces."""
        node, n = 0, 0
        following, fail, pops = self._next, self._fail, self._pops
        for c in marked:
            while (to := following[node].get(c)) is None:
                if fail[node] < 0:
                    return -1
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return -1
            n += pops[node]
            node = fail[node]
        return n


class Counts(dict):
    """Pieces of words; an unknown word is one token and adds 2^40."""

    def __init__(self, automaton: Automaton):
        self._automaton, self._old = automaton, {}

    def __missing__(self, word: str) -> int:
        value = self._old.get(word)
        if value is None:
            n = self._automaton.count(MARKER + word)
            value = n if n >= 0 else 1 + (1 << 40)
        if len(self) >= CACHE:
            self._old = dict(self)
            self.clear()
        self[word] = value
        return value


_made: dict[bytes, Counts] = {}


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters that end where white space begins; a run without any is one piece."""
    at = 0
    while len(text) - at > PIECE:
        found = _BLANK.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


COUNTED = "struct<n_words: bigint, n_tokens: bigint, n_unknown: bigint>"


def token_counts(text: Column, pieces: list[str]) -> Column:
    """Words, word-piece tokens and unknown words of a text column.

    Words are runs of word characters and single other characters that are no white space.
    An unknown word is one token.  Null and empty texts have none.  The pieces (a
    vocabulary file, a few hundred kB) travel with the tasks.
    """
    key = blake2b("\n".join(pieces).encode("utf-8", "surrogatepass")).digest()

    @F.arrow_udf(COUNTED)
    def count(texts: pa.Array) -> pa.Array:
        if key not in _made:
            _made.clear()
            _made[key] = Counts(Automaton(pieces))
        of = _made[key].__getitem__
        numbers, sums = [], []
        for t in texts.to_pylist():  # the words of one piece of a text at a time
            n = total = 0
            for part in _pieces(t or ""):
                words = _WORDS.findall(part)
                n, total = n + len(words), total + sum(map(of, words))
            numbers.append(n)
            sums.append(total)
        columns = [numbers, [s & ((1 << 40) - 1) for s in sums], [s >> 40 for s in sums]]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_tokens", "n_unknown"])

    return count(text.cast("string"))


def count_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row; ids may be null or repeat."""
    prepare(docs.sparkSession)
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), token_counts(F.col(f"`{text_col}`"), read_pieces(vocabulary_path)).alias("_c"))
    return out.select("doc_id", "_c.n_words", "_c.n_tokens", "_c.n_unknown")


def op1_token_counts(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return count_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
