"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text's symbols lie in one flat array. It is cut wherever two neighbours stand
side by side in no piece of the model, since no merge can reach over such a
place; what lies between two cuts is a word here. In a round every word takes
the best rank among its pairs and merges all pairs of that rank, leftmost
first; then the array is compacted, and words without a pair are done. The
library merges one pair at a time, the best score first and the leftmost of
equals. A round does the same as long as a merge makes no pair that is as good
as the merge itself; behind a merge that does, the rest of the word waits for
the next round.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from barloom.llm.common import arrow_map, batch_of, narrowed, once_per_worker, text_slices

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "  # what the library decodes the unknown piece to
# Fixed values of the model format: kinds of pieces, the BPE model type.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2
CODE_BITS = 21
NEVER = np.int32(2**31 - 1)
PART_CHARS = 1 << 20  # characters that a text is taken by
TOGETHER_CHARS = 4 << 20  # characters whose new words are merged together
DECODE_IDS = 1 << 16
CACHED_CHARS = 64


@dataclass(frozen=True)
class PieceParameters:
    """``model`` is a SentencePiece model file; ``max_words`` bounds a task's table of encoded words, which only saves work."""

    model: str
    max_words: int = 200_000


def encode_pieces(docs: DataFrame, parameters: PieceParameters, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (little-endian unsigned 32-bit) if asked for.

    Ids are those of the library without begin and end ids and without
    sampling; ids_sha256 is over the decimal ids joined by commas, and the
    decoded text is rebuilt from the ids. Null text is empty and has no
    tokens; an empty table gives an empty table; repeated rows each get their
    row; other columns, of any name, are not read. Long texts are taken by
    parts that end between words, so memory is bound by a text and its longest
    word, not by its number of words.
    """
    docs.sparkSession.sparkContext.addFile(parameters.model)
    name = parameters.model.rpartition("/")[2]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return arrow_map(narrowed(docs, "doc_id", "text"), _encode, schema, keeps=True, p=parameters, name=name, with_ids=with_ids)


def decode_pieces(encoded: DataFrame, parameters: PieceParameters) -> DataFrame:
    """doc_id and text of rows with ids; null ids give null text, bytes that are no UTF-8 one replacement character each."""
    encoded.sparkSession.sparkContext.addFile(parameters.model)
    name = parameters.model.rpartition("/")[2]
    return arrow_map(narrowed(encoded, "doc_id", "ids"), _decode, "doc_id long, text string", keeps=True, p=parameters, name=name)


# --- the model file -------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message; fixed-width values stay bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """The pieces of a model file, and the tables that encoding and decoding need.

    Refuses what it would not encode as the library does: other model types
    than BPE, text normalisation, user-defined or unused pieces, and models
    without byte pieces for unknown characters.
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        plain = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24)
        if trainer.get(3) != BPE_MODEL or not plain or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without normalisation, user-defined and unused pieces")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.byte_id = np.full(256, -1, np.int64)
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("only models with a piece for every byte")
        self._surfaces(kinds)
        self._merges(np.array(scores), [i for i, kind in enumerate(kinds) if kind == NORMAL])

    def _surfaces(self, kinds: list[int]) -> None:
        """What each id decodes to."""
        self.surface = []
        self.spaced = {i for i, (piece, kind) in enumerate(zip(self.pieces, kinds)) if kind == NORMAL and piece.startswith(SPACE)}
        for piece, kind in zip(self.pieces, kinds):
            if kind == BYTE:
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif kind == NORMAL:
                self.surface.append(piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(UNKNOWN_TEXT.encode() if kind == UNKNOWN else b"")
        self.silent = np.array([not text for text in self.surface])

    def _merges(self, scores: np.ndarray, normal: list[int]) -> None:
        """The pairs of symbols that make a piece, with its id and rank, and the characters that stand side by side in one.

        A symbol is a piece's id or, for a character that is no piece, its code point behind all ids.
        """
        n = len(self.pieces)
        ids = {self.pieces[i]: i for i in normal}
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        symbol = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else None)
        merges, beside = {}, set()
        for piece, i in ids.items():
            beside.update(ord(a) << CODE_BITS | ord(b) for a, b in zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    merges[left << CODE_BITS | right] = i
        self.pair_keys = np.array([*sorted(merges), 1 << 62], np.int64)
        self.pair_ids = np.array([merges[k] for k in sorted(merges)] + [0], np.int64)
        self.pair_ranks = np.append(rank[self.pair_ids[:-1]], NEVER).astype(np.int32)
        self.beside = np.array([*sorted(beside), 1 << 62], np.int64)
        self.symbol_of = np.arange(n, n + 0x110000, dtype=np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.space_run = self._space_run(ids, rank)

    def _space_run(self, ids: dict[str, int], rank: np.ndarray) -> int:
        """The length of the rows that a long run of spaces is cut into from the left, or 0 if it may come out otherwise.

        Where all runs of spaces are pieces of one rank and no other piece
        holds two spaces side by side, the leftmost pair always goes first. If
        a run as long as the longest of them becomes one piece, so does each
        such stretch of a longer run, one after the other.
        """
        runs = {p: rank[i] for p, i in ids.items() if SPACE * 2 in p}
        if not runs or any(p.strip(SPACE) for p in runs) or len(set(runs.values())) > 1:
            return 0
        longest = max(runs, key=len)
        return len(longest) if self.segment([longest])[0].tolist() == [ids[longest]] else 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; NEVER for those that make none."""
        keys = left << CODE_BITS | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER), self.pair_ids[at]

    # --- merge rounds ---------------------------------------------------------

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and where each word's begin, with the end; all are merged together."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.zeros(len(codes), bool)
        starts = np.cumsum(sizes) - sizes
        first[starts[sizes > 0]] = True
        if len(codes) > 1:
            pairs = codes[:-1] << CODE_BITS | codes[1:]
            first[1:] |= self.beside[np.searchsorted(self.beside, pairs)] != pairs
        symbols = self._merged(self.symbol_of[codes], first)
        ids, places = self._numbered(symbols)
        return ids, np.searchsorted(places, np.append(starts, len(codes)))

    def _merged(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols after all merges, each at its first character's place and -1 at the others; ``first`` marks the words' starts."""
        out = symbols.copy()
        place = np.arange(len(symbols))
        rank, made = self._pair_table(symbols, first)
        while len(symbols):
            starts = np.flatnonzero(first)
            best = np.minimum.reduceat(rank, starts)
            word = np.cumsum(first) - 1
            open_word = best < NEVER
            if not open_word.all():
                # words without a pair are done
                keep = open_word[word]
                symbols, first, place, rank, made = (x[keep] for x in (symbols, first, place, rank, made))
                continue
            taken = self._taken(symbols, first, rank, made, rank == best[word], word, best)
            merged = made[taken]
            symbols[taken] = merged
            out[place[taken]] = merged
            out[place[taken + 1]] = -1
            keep = np.ones(len(symbols), bool)
            keep[taken + 1] = False
            # pairs that a merge touched are looked up anew: at the merged symbol and before it
            at = taken - np.arange(len(taken))
            symbols, first, place, rank, made = (x[keep] for x in (symbols, first, place, rank, made))
            self._refresh(symbols, first, rank, made, np.concatenate([at, at[~first[at]] - 1]))
        return out

    def _pair_table(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int64)
        self._refresh(symbols, first, rank, made, np.arange(len(symbols)))
        return rank, made

    def _refresh(self, symbols: np.ndarray, first: np.ndarray, rank: np.ndarray, made: np.ndarray, at: np.ndarray) -> None:
        last = len(symbols) - 1
        inner = at[at < last]
        inner = inner[~first[inner + 1]]
        rank[at] = NEVER
        rank[inner], made[inner] = self.ranks(symbols[inner], symbols[inner + 1])

    def _taken(self, symbols, first, rank, made, best_pair, word, best) -> np.ndarray:
        """Places of the pairs to merge now: of the pairs of a word's best rank every other one of a row of neighbours,
        up to the first whose merge makes a pair of that rank or a better one."""
        pairs = np.flatnonzero(best_pair)
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = (pairs[1:] != pairs[:-1] + 1) | first[pairs[1:]]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(pairs)), 0))
        pairs = pairs[(np.arange(len(pairs)) - run) % 2 == 0]
        merged, own = made[pairs], best[word[pairs]]
        # the symbol before is already merged where the pair before it is taken too
        has_left = ~first[pairs]
        left = symbols[pairs - has_left]
        follows = np.zeros(len(pairs), bool)
        follows[1:] = has_left[1:] & (pairs[1:] == pairs[:-1] + 2)
        left[follows] = merged[np.flatnonzero(follows) - 1]
        after = np.minimum(pairs + 2, len(symbols) - 1)
        has_right = (pairs + 2 < len(symbols)) & ~first[after]
        upset = has_left & (self.ranks(left, merged)[0] <= own)
        upset |= has_right & (self.ranks(merged, symbols[after])[0] <= own)
        if not upset.any():
            return pairs
        seen = np.cumsum(upset) - upset
        head = np.ones(len(pairs), bool)
        head[1:] = word[pairs[1:]] != word[pairs[:-1]]
        base = np.maximum.accumulate(np.where(head, seen, 0))
        return pairs[seen == base]

    def _numbered(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols left and their places; a character that is no piece becomes the pieces of its UTF-8 bytes."""
        places = np.flatnonzero(symbols >= 0)
        ids, n = symbols[places], len(self.pieces)
        code = ids - n
        size = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        if (code < 0).all():
            return ids, places
        ends = np.cumsum(size)
        ids, code, places, whole = (np.repeat(x, size) for x in (ids, code, places, size))
        behind = np.repeat(ends, size) - 1 - np.arange(len(ids))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[whole]
        byte = np.where(behind == whole - 1, lead | code >> 6 * behind, 0x80 | code >> 6 * behind & 0x3F)
        return np.where(code < 0, ids, self.byte_id[byte & 0xFF]), places


# --- texts ------------------------------------------------------------------------


class PieceCodec:
    """Texts to ids and back, with a table of words met before."""

    def __init__(self, model: PieceModel, max_words: int):
        self.model, self.max_words = model, max_words
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.decimals = [str(i).encode() for i in range(len(model.pieces))]
        run = model.space_run
        # spaces at the start of a word; long rows of them in whole runs, of which the last may belong to a word
        whole = f"{SPACE}{{{run}}}(?={SPACE})|" if run else ""
        apart = not any(SPACE in p.lstrip(SPACE) for p in model.pieces)
        self.words = re.compile(f"{whole}{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s:.+)")
        self.border = re.compile(f"[^{SPACE} ][{SPACE} ]") if apart else None

    def _parts(self, text: str) -> Iterator[str]:
        start, prefix = 0, self.model.prefix
        while start < len(text):
            found = self.border.search(text, start + PART_CHARS) if self.border else None
            end = found.start() + 1 if found else len(text)
            yield prefix + text[start:end].replace(" ", SPACE)
            start, prefix = end, ""

    def encode(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
        """(text's number, (ids as little-endian 32-bit, ids in decimal joined by commas) of its words), in order.

        A long text comes in several parts. New words of many parts are merged together.
        """
        waiting, held = [], 0
        for number, text in enumerate(texts):
            for part in self._parts(text):
                waiting.append((number, self.words.findall(part)))
                held += len(part)
                if held >= TOGETHER_CHARS:
                    yield from self._found(waiting)
                    waiting, held = [], 0
        yield from self._found(waiting)

    def _found(self, parts: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
        known = self.known
        new = list({word for _, words in parts for word in words if word not in known})
        ids, bounds = self.model.segment(new)
        data, decimal, bounds = ids.astype("<u4").tobytes(), [self.decimals[i] for i in ids.tolist()], bounds.tolist()
        for word, a, b in zip(new, bounds, bounds[1:]):
            known[word] = data[4 * a : 4 * b], b",".join(decimal[a:b])
        for number, words in parts:
            yield number, [known[word] for word in words]
        if len(known) > self.max_words:
            known.clear()
        for word in new:
            if len(word) > CACHED_CHARS:
                known.pop(word, None)

    def decoder(self) -> PieceDecoder:
        return PieceDecoder(self.model)


class PieceDecoder:
    """Ids to text by parts; the space that encoding put before the text goes."""

    def __init__(self, model: PieceModel):
        codecs.register_error("each_byte", _each_byte)
        self.surface, self.spaced, self.silent, self.begun = model.surface, model.spaced, model.silent, not model.prefix
        self.stream = codecs.getincrementaldecoder("utf-8")("each_byte")

    def feed(self, ids: bytes, final: bool = False) -> str:
        surface, numbers, out, start = self.surface, np.frombuffer(ids, "<u4"), [], 0
        # a control piece says nothing, but parts the bytes around it
        for control in [*np.flatnonzero(self.silent[numbers]).tolist(), None]:
            end = len(numbers) if control is None else control
            for i in range(start, end, DECODE_IDS):
                part = numbers[i : min(i + DECODE_IDS, end)].tolist()
                data = b"".join([surface[n] for n in part])
                if not self.begun:
                    self.begun, data = True, data[1:] if part[0] in self.spaced else data
                out.append(self.stream.decode(data))
            out.append(self.stream.decode(b"", final or control is not None))
            start = end + 1
        return "".join(out)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _codec(name: str, p: PieceParameters) -> PieceCodec:
    def make() -> PieceCodec:
        with open(SparkFiles.get(name), "rb") as file:
            return PieceCodec(PieceModel(file.read()), p.max_words)

    return once_per_worker(("pieces", name, p.max_words), make)


ENCODED = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def _encode(batches: Iterator[pa.RecordBatch], p: PieceParameters, name: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(name, p)
    schema = pa.schema(ENCODED + [("ids", pa.binary())] * with_ids)
    for batch, texts in text_slices(batches):
        rows = [Encoded(codec, with_ids) for _ in texts]
        for number, found in codec.encode([raw.decode("utf-8", "replace") for raw in texts]):
            rows[number].add(found)
        yield batch_of(schema, batch.column("doc_id").cast(pa.int64()), *zip(*[row.columns() for row in rows]))


class Encoded:
    """A row's digests while its parts come in."""

    def __init__(self, codec: PieceCodec, with_ids: bool):
        self.decoder, self.with_ids = codec.decoder(), with_ids
        self.n, self.ids = 0, []
        self.decimal, self.decoded = hashlib.sha256(), hashlib.sha256()

    def add(self, found: list[tuple[bytes, bytes]]) -> None:
        if self.n:
            self.decimal.update(b",")
        self.decimal.update(b",".join([word[1] for word in found]))
        ids = b"".join([word[0] for word in found])
        self.n += len(ids) // 4
        self.decoded.update(self.decoder.feed(ids).encode())
        if self.with_ids:
            self.ids.append(ids)

    def columns(self) -> tuple:
        self.decoded.update(self.decoder.feed(b"", final=True).encode())
        row = (self.n, self.decimal.hexdigest(), self.decoded.hexdigest())
        return (*row, b"".join(self.ids)) if self.with_ids else row


def _decode(batches: Iterator[pa.RecordBatch], p: PieceParameters, name: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(name, p)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    for batch in batches:
        texts = [None if ids is None else codec.decoder().feed(ids, final=True) for ids in batch.column("ids").to_pylist()]
        yield batch_of(schema, batch.column("doc_id").cast(pa.int64()), texts)
