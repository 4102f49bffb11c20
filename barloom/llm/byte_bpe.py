"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A token sequence is the BPE encoding of its bytes exactly if every token
encodes as itself and no two neighbours would have merged across their border.
So the encoder is a transducer over bytes whose state is a set of hypotheses:
the last whole token, the vocabulary prefix read since, and the tokens not yet
emitted. Every prefix of a text has one encoding, so each byte adds at most one
hypothesis; those that no vocabulary entry continues die. What all living
hypotheses agree on is emitted: at most the longest token's bytes are ever held
back. States and transitions are made when a byte first needs them and are
kept in a table of bounded size; the table only saves work, never decides.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from barloom.llm.common import arrow_map, batch_of, narrowed, once_per_worker, text_slices

CACHED_CHARS = 256  # longer pieces are encoded each time they come
DECODE_IDS = 4096  # ids that the decoder takes in one step


@dataclass(frozen=True)
class BpeParameters:
    """``ranks`` is a rank file of one base64 token and rank per line; ``pattern`` cuts the text into pieces.

    ``spaced`` promises that a space after anything but white space always starts a piece; whole words with their
    space are then looked up before they are cut into pieces.
    ``max_states`` and ``max_pieces`` bound the memory of a task: a full table is emptied and filled anew.
    """

    ranks: str
    pattern: str
    spaced: bool = False
    max_states: int = 250_000
    max_pieces: int = 500_000


def encode_documents(docs: DataFrame, parameters: BpeParameters, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (little-endian unsigned 32-bit) if asked for.

    Null text is empty and has no tokens. Repeated rows each get their row;
    other columns are not read. Decoding starts from the ids.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(parameters.ranks)
    name = parameters.ranks.rpartition("/")[2]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return arrow_map(narrowed(docs, "doc_id", "text"), _encode, schema, keeps=True, p=parameters, name=name, with_ids=with_ids)


def decode_documents(encoded: DataFrame, parameters: BpeParameters) -> DataFrame:
    """doc_id and text of rows with ids; bytes that are no UTF-8 become replacement characters, null ids null text."""
    encoded.sparkSession.sparkContext.addFile(parameters.ranks)
    name = parameters.ranks.rpartition("/")[2]
    return arrow_map(narrowed(encoded, "doc_id", "ids"), _decode, "doc_id long, text string", keeps=True, p=parameters, name=name)


class Vocabulary:
    """Tokens, a byte trie over them, and for each token the pieces at its edges while it was merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            self.tokens[rank] = token
            node = 0
            for byte in token:
                child = self.children[node].get(byte)
                if child is None:
                    child = len(self.children)
                    self.children[node][byte] = child
                    self.children.append({})
                    self.token_at.append(-1)
                node = child
            self.token_at[node] = rank
        self._edges: dict[int, tuple | None] = {}
        self._borders: dict[tuple[int, int], bool] = {}

    def edges(self, token: int) -> tuple | None:
        """(left pieces, right pieces), each with the rank that consumed it; None if the token doesn't encode as itself."""
        if token not in self._edges:
            self._edges[token] = self._merge_history(self.tokens[token])
        return self._edges[token]

    def _merge_history(self, token: bytes) -> tuple | None:
        parts = [token[i : i + 1] for i in range(len(token))]
        never = len(self.tokens)
        left, right = [], []
        while len(parts) > 1:
            ranked = [(self.rank.get(a + b, never), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(ranked)
            if best == never:
                return None
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*left, (token, never)], [*right, (token, never)]

    def may_meet(self, a: int, b: int) -> bool:
        """Whether b may follow a: no piece at a's end merges with one at b's start before either is consumed.

        A piece of b consumed by a merge of the same rank loses, as the leftmost of equal merges goes first.
        """
        known = self._borders.get((a, b))
        if known is None:
            if len(self._borders) > 4_000_000:
                self._borders.clear()
            known = not any(
                (rank := self.rank.get(x + y)) is not None and rank < x_end and rank <= y_end
                for x, x_end in self.edges(a)[1]
                for y, y_end in self.edges(b)[0]
            )
            self._borders[a, b] = known
        return known


class Transducer:
    """The lazily determinised encoder. A state is a tuple of hypotheses (last token, trie node, held tokens)."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = 200_000):
        self.vocabulary, self.max_states = vocabulary, max_states
        self._reset()

    def _reset(self) -> None:
        self.states = [((-1, 0, ()),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def encode(self, piece: bytes) -> list[int]:
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > self.max_states:
                    # within a piece too: the table goes, the state it is in stays
                    state = self._begin_anew(self.states[state])
                    moves = self.moves
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        for _, node, held in self.states[state]:
            if node == 0:
                out += held
        return out

    def _begin_anew(self, hypotheses: tuple) -> int:
        self._reset()
        if hypotheses not in self.number:
            self.number[hypotheses] = len(self.states)
            self.states.append(hypotheses)
        return self.number[hypotheses]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        v = self.vocabulary
        children, token_at = v.children, v.token_at
        alive, whole = [], None
        for last, node, held in self.states[state]:
            child = children[node].get(byte)
            if child is None:
                continue
            if children[child]:
                alive.append((last, child, held))
            token = token_at[child]
            if whole is None and token >= 0 and v.edges(token) is not None and (last < 0 or v.may_meet(last, token)):
                whole = (token, 0, (*held, token))
        if whole is None:
            raise ValueError("the vocabulary lacks a single byte")
        alive.append(whole)
        first = alive[0][2]
        common = next((i for i, token in enumerate(first) if any(len(h) <= i or h[i] != token for _, _, h in alive)), len(first))
        reached = tuple((last, node, held[common:]) for last, node, held in alive)
        number = self.number.get(reached)
        if number is None:
            number = self.number[reached] = len(self.states)
            self.states.append(reached)
        self.moves[state << 8 | byte] = move = (number, first[:common])
        return move


class Utf8Stream:
    """Decodes UTF-8 by parts. The state is the bytes of a character that a part cut off."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.pending + data
        cut = len(data) if final else len(data) - self._open(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end that may still become a whole character."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                needs = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
                return back if needs > back else 0
        return 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def _codec(name: str, p: BpeParameters) -> "Encoder":
    make = lambda: Encoder(Vocabulary(read_ranks(SparkFiles.get(name))), p)
    return once_per_worker(("bpe", name, p.pattern, p.spaced, p.max_states, p.max_pieces), make)


class Encoder:
    """Texts to little-endian 32-bit ids: every match of the pattern by itself, through the transducer."""

    def __init__(self, vocabulary: Vocabulary, p: BpeParameters):
        self.vocabulary, self.p = vocabulary, p
        self.transducer = Transducer(vocabulary, p.max_states)
        self.pattern = regex.compile(p.pattern)
        self.unevenly_spaced = regex.compile(r"^ |\s ")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not self.p.spaced or self.unevenly_spaced.search(text):
            return self._by_pieces(text)
        first, *words = text.split(" ")
        known = self.words
        if len(known) > self.p.max_pieces:
            known.clear()
        try:
            return self._by_pieces(first) + b"".join([known[word] for word in words])
        except KeyError:
            for word in words:
                if word not in known and len(word) <= CACHED_CHARS:
                    known[word] = self._by_pieces(" " + word)
            return self._by_pieces(first) + b"".join([known.get(word) or self._by_pieces(" " + word) for word in words])

    def _by_pieces(self, text: str) -> bytes:
        known = self.pieces
        if len(known) > self.p.max_pieces:
            known.clear()
        out = []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
                if len(piece) <= CACHED_CHARS:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)


def decode_ids(ids: bytes, tokens: list[bytes]) -> Iterator[bytes]:
    """The text's UTF-8 by parts, through the incremental decoder."""
    stream = Utf8Stream()
    numbers = np.frombuffer(ids, "<u4")
    for i in range(0, len(numbers), DECODE_IDS):
        yield stream.feed(b"".join([tokens[n] for n in numbers[i : i + DECODE_IDS].tolist()])).encode()
    yield stream.feed(b"", final=True).encode()


ENCODED = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def _encode(batches: Iterator[pa.RecordBatch], p: BpeParameters, name: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _codec(name, p)
    tokens = encoder.vocabulary.tokens
    schema = pa.schema(ENCODED + [("ids", pa.binary())] * with_ids)
    for batch, texts in text_slices(batches):
        rows = []
        for raw in texts:
            ids = encoder.encode(raw.decode("utf-8", "replace"))
            decoded = hashlib.sha256()
            for part in decode_ids(ids, tokens):
                decoded.update(part)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()) + (ids,) * with_ids)
        yield batch_of(schema, batch.column("doc_id").cast(pa.int64()), *zip(*rows))


def _decode(batches: Iterator[pa.RecordBatch], p: BpeParameters, name: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _codec(name, p).vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    for batch in batches:
        texts = [None if ids is None else b"".join(decode_ids(ids, vocabulary.tokens)).decode() for ids in batch.column("ids").to_pylist()]
        yield batch_of(schema, batch.column("doc_id").cast(pa.int64()), texts)
