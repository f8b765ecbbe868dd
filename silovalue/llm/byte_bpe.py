"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

A sequence of tokens is what the merges give for a text exactly if each two neighbours are what the merges give for their
joined bytes. So a nondeterministic machine that spells tokens byte by byte, and starts a next token only after one that it
may follow, has one complete path for each text. Its sets of paths become numbered states when a text first reaches them;
a token is certain as soon as all live paths agree on it, after a lookahead bounded by the longest tokens: short pieces give
their tokens out at the end, long ones as they become certain.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

MOST_STATES = 250_000  # determined states kept at once
MOST_PAIRS = 400_000  # remembered answers of "may follow"
MOST_PIECES = 400_000  # encoded pieces kept at once
LONGEST_KEPT = 64  # characters of a piece that is kept
NONE = -1
NO_RANK = 1 << 62  # after any rank: ranks may be larger than their number
NODE_BITS = 24
NODE_MASK = (1 << NODE_BITS) - 1
SETTLE = 4096  # bytes of a piece after which certain tokens are given out


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(ranks: dict[bytes, int], data: bytes, least: int = 1) -> list[bytes]:
    """The merges by definition: the pair of lowest rank, the leftmost of equals, until none is a token (or ``least`` are left)."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NO_RANK), i) for i in range(len(parts) - 1))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Neighbours:
    """Whether one token may follow another: the merges of their joined bytes leave the border between them.

    While a token grows out of its bytes, the parts at its right and left edge grow too. A part lasts until its merge's turn,
    which is its rank where ranks rise from parts to wholes. The border falls if two parts that meet there while both last
    make a token whose turn comes first; of equal ranks the left one goes first. Where ranks don't rise, the merges are run.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {rank: data for data, rank in ranks.items()}
        self.last = max(ranks.values()) + 1
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[int, bool] = {}

    def stands(self, token: int) -> bool:
        """Whether the merges make the token out of its own bytes."""
        if token not in self.whole:
            self.whole[token] = merge_bytes(self.ranks, self.token[token]) == [self.token[token]]
        return self.whole[token]

    def _edges(self, token: int) -> tuple[list, list] | None:
        """(part, the turn it lasts until) at the left and the right edge, from single bytes on; None if ranks don't rise."""
        if token not in self.edges:
            self.edges[token] = self._grown(token)
        return self.edges[token]

    def _grown(self, token: int) -> tuple[list, list] | None:
        data = self.token[token]
        if len(data) == 1:
            return [(data, self.last)], [(data, self.last)]
        parts = merge_bytes(self.ranks, data, least=2)
        if len(parts) != 2:
            return None
        halves = [self.ranks[p] for p in parts]
        left, right = self._edges(halves[0]), self._edges(halves[1])
        if left is None or right is None or max(halves) >= token:
            return None
        whole = [(data, self.last)]
        return [*left[0][:-1], (parts[0], token), *whole], [*right[1][:-1], (parts[1], token), *whole]

    def may_follow(self, before: int, token: int) -> bool:
        found = self.known.get(before << 24 | token)
        if found is None:
            if len(self.known) >= MOST_PAIRS:
                self.known.clear()
            found = self.known[before << 24 | token] = self.stands(before) and self.stands(token) and self._border(before, token)
        return found

    def _border(self, before: int, token: int) -> bool:
        one, other = self._edges(before), self._edges(token)
        if one is None or other is None:
            parts = [self.token[before], self.token[token]]
            return merge_bytes(self.ranks, b"".join(parts)) == parts
        ranks, rights, lefts = self.ranks, one[1], other[0]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = rights[i], lefts[j]
            turn = ranks.get(x + y)
            if turn is not None and turn < x_until and turn <= y_until:
                return False
            if x_until <= y_until:
                if x_until == self.last:
                    return True
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes of one piece to ids. States and moves are made when first met, and forgotten when there are too many.

    A path is the token before its open one (0: none) and the trie node of the open one, as one number; a state is its paths,
    the longest open token first. The last path has none open: its token is the last one of what the bytes so far give.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks, self.most_states, self.neighbours = ranks, most_states, Neighbours(ranks)
        self.length = {rank: len(data) for data, rank in ranks.items()}
        self.below: dict[int, int] = {}  # node * 256 + byte -> node of the trie
        self.ends: list[int] = [NONE]  # the token that ends in a node
        self.depth: list[int] = [0]
        self.inner = bytearray(1)
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                self.inner[node] = 1
                found = self.below.get(node << 8 | byte)
                if found is None:
                    found = self.below[node << 8 | byte] = len(self.ends)
                    self.ends.append(NONE)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(0)
                node = found
            self.ends[node] = rank
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, int] = {}
        self.lasts: list[int] = []
        self._number((0,))

    def _number(self, state: tuple[int, ...]) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            self.lasts.append((state[-1] >> NODE_BITS) - 1)
        return number

    def _determine(self, at: int, byte: int) -> int:
        """The state after a byte: every path goes on, and the one path that ends a token here also starts the next."""
        state = self.states[at]
        below, inner, ends, after, ended = self.below, self.inner, self.ends, [], 0
        for path in state:
            before = path >> NODE_BITS
            node = below.get((path & NODE_MASK) << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                after.append(before << NODE_BITS | node)
            token = ends[node]
            if token != NONE and not ended:
                if self.neighbours.may_follow(before - 1, token) if before else self.neighbours.stands(token):
                    ended = (token + 1) << NODE_BITS
        after.append(ended)
        if len(self.states) >= self.most_states:
            self._forget()
            at = self._number(state)
        to = self.moves[at << 8 | byte] = self._number(tuple(after))
        return to

    def _back(self, trail: list[int], end: int, begin: int) -> list[int]:
        """The tokens that end at ``end`` and start at ``begin``, last first; ``trail`` has the last token of each prefix."""
        out = []
        while end > begin:
            out.append(trail[end - 1])
            end -= self.length[out[-1]]
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece; one that is a token itself is that token, whatever the merges say."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        at, trail, moves, lasts = 0, [], self.moves, self.lasts
        for byte in piece:
            to = moves.get(at << 8 | byte)
            if to is None:
                to = self._determine(at, byte)
                moves, lasts = self.moves, self.lasts
            at = to
            trail.append(lasts[at])
            if len(trail) >= SETTLE:
                done = self._agreed(trail, self.states[at])
                out += self._back(trail, done, 0)[::-1]
                del trail[:done]
        return out + self._back(trail, len(trail), 0)[::-1]

    def _agreed(self, trail: list[int], state: tuple[int, ...]) -> int:
        """The place up to which all live paths share their tokens: no further back than a few longest tokens."""
        places = {len(trail) - self.depth[path & NODE_MASK] for path in state}
        while len(places) > 1:
            furthest = max(places)
            places.discard(furthest)
            places.add(furthest - self.length[trail[furthest - 1]])
        return places.pop()


class _Pieces(dict):
    """Ids of pieces as bytes of 32-bit numbers; a new piece goes through the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids: each match of the pattern is a piece of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.pieces = regex.compile(pattern), _Pieces(Transducer(ranks))

    def encode(self, text: str) -> np.ndarray:
        found = self.pattern.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.pattern.finditer(text))
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), dtype=np.int32)


def follows(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """The next state of the UTF-8 machine: bytes still wanted, and the least and greatest next byte; None: not allowed."""
    wanted, least, greatest = state
    if wanted:
        return (wanted - 1, 0x80, 0xBF) if least <= byte <= greatest else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:  # no overlong form, no surrogate
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:  # no overlong form, nothing above U+10FFFF
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


BETWEEN = (0, 0, 0)


class StreamDecoder:
    """Ids to text as they come: only whole characters are given out, an unfinished one is held until its bytes arrive.

    Bytes that are no UTF-8 become U+FFFD, one for each longest start of a character.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.moves: dict[tuple, tuple] = {}
        self.clean: list[str | None] = []
        for data in tokens:  # text of the tokens that start and end between characters
            text, state, held = self._run(BETWEEN, b"", data)
            self.clean.append(text if state == BETWEEN and "�" not in text else None)
        self.state, self.held = BETWEEN, b""

    @staticmethod
    def _run(state: tuple[int, int, int], held: bytes, data: bytes) -> tuple[str, tuple[int, int, int], bytes]:
        out = []
        for byte in data:
            after = follows(state, byte)
            if after is None and held:
                out.append("�")
                held, after = b"", follows(BETWEEN, byte)
            if after is None:
                out.append("�")
                state, held = BETWEEN, b""
                continue
            state, held = after, held + bytes([byte])
            if state[0] == 0:
                out.append(held.decode())
                state, held = BETWEEN, b""
        return "".join(out), state, held

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        texts = list(map(self.clean.__getitem__, ids))
        if not self.held and None not in texts:
            return "".join(texts)
        for i, token in enumerate(ids):
            if self.held or texts[i] is None:
                key = (self.held, token)
                if key not in self.moves:
                    if len(self.moves) >= MOST_PAIRS:
                        self.moves.clear()
                    self.moves[key] = self._run(self.state, self.held, self.tokens[token])
                texts[i], self.state, self.held = self.moves[key]
        return "".join(texts)

    def finish(self) -> str:
        """What an unfinished character at the end becomes; the decoder is ready for the next text."""
        rest, self.state, self.held = "�" if self.held else "", BETWEEN, b""
        return rest


_LOADED: dict[tuple[str, str], tuple[Encoder, StreamDecoder]] = {}
BLOCK = 1 << 16  # ids decoded at once


def coders(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """One pair for each worker process."""
    if (path, pattern) not in _LOADED:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for data, rank in ranks.items():
            tokens[rank] = data
        _LOADED[path, pattern] = Encoder(ranks, pattern), StreamDecoder(tokens)
    return _LOADED[path, pattern]


def _decoded(decoder: StreamDecoder, ids: np.ndarray) -> str:
    return "".join([decoder.feed(ids[a : a + BLOCK].tolist()) for a in range(0, len(ids), BLOCK)]) + decoder.finish()


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))


def round_trip(docs: DataFrame, path: str, pattern: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of the whole text, and the text that they decode to.

    A null text counts as empty and gives no ids; rows with a null or repeated doc_id keep their own results. Other columns
    are not read. Without ``decode`` the last column is null.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(path, pattern)
        for part in common.slices(batch):
            found = [encoder.encode(text or "") for text in part.column("text").to_pylist()]
            texts = [_decoded(decoder, ids) if decode else None for ids in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(found), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return common.map_batches(rows, one, "doc_id bigint, ids array<int>, decoded string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    return round_trip(docs, path, pattern, decode=False).drop("decoded")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of rows with ids; null ids decode to an empty text."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decoder = coders(path, pattern)[1]
        for i, ids in enumerate(batch.column("ids")):
            text = _decoded(decoder, ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([text], pa.string())], ["doc_id", "decoded"])

    return common.map_batches(rows.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")), one, "doc_id bigint, decoded string")


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): counts and hashes of ``round_trip``'s rows."""
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
