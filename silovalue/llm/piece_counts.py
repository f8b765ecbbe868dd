"""Token counts by a linear longest-match automaton: greedy word-piece lengths without building the pieces.

The vocabulary is a trie over the bytes of lower-cased words and a mark for the end of a word. When a node has no edge
for the next symbol, its failure link leads to the node of what is left after the longest pieces were taken off the
front; how many pieces that takes is computed beforehand. So each symbol is read once, whatever the vocabulary.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

END = 256
END_MARK = "</w>"
MAX_CACHED = 500_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces of a tokenizers file as symbols; letters that are no bytes (special tokens) are left out."""
    letters, pieces = byte_letters(), []
    for piece in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        bare = piece.removesuffix(END_MARK)
        if bare and all(c in letters for c in bare):
            pieces.append(tuple(letters[c] for c in bare) + ((END,) if bare != piece else ()))
    return pieces


class Automaton:
    """``next[node]`` maps symbols to nodes; ``fail[node]`` and ``popped[node]`` say where to go and how many pieces end."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][symbol]
            final[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque((0, symbol, child) for symbol, child in self.next[0].items())
        while queue:
            parent, symbol, node = queue.popleft()
            if final[node]:
                self.fail[node], self.popped[node] = 0, 1
            elif parent:
                back, count = self.fail[parent], self.popped[parent]
                while back > 0 and symbol not in self.next[back]:
                    back, count = self.fail[back], count + self.popped[back]
                if back >= 0 and symbol in self.next[back]:
                    self.fail[node], self.popped[node] = self.next[back][symbol], count
            queue.extend((node, s, c) for s, c in self.next[node].items())

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match of a word; a word that can't be cut to its end is one unknown piece."""
        node, pieces = 0, 0
        for symbol in (*word, END):
            while symbol not in self.next[node]:
                if self.fail[node] < 0:
                    return 1
                pieces += self.popped[node]
                if node == 0:
                    return 1
                node = self.fail[node]
            node = self.next[node][symbol]
        while node:
            if self.fail[node] < 0:
                return 1
            pieces, node = pieces + self.popped[node], self.fail[node]
        return pieces


_READY: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text; A-Z are lower-cased, words are runs without space and 0x09-0x0D.

    Null and empty texts have none. Rows with equal or null ids keep their own counts. Nothing is shuffled; the
    vocabulary's file is a parameter and is read where the tasks run.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _READY:
            _READY[vocabulary] = (Automaton(load_pieces(vocabulary)), {})
        automaton, known = _READY[vocabulary]
        words_of, tokens_of = [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            for word in set(words).difference(known):
                known[word] = automaton.count(word)
            words_of.append(len(words))
            tokens_of.append(sum(map(known.__getitem__, words)))
            if len(known) > MAX_CACHED:
                known.clear()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return common.map_batches(rows, one, "doc_id bigint, n_words bigint, n_tokens bigint")
