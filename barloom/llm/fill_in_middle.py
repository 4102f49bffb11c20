"""Fill-in-middle transformation: documents cut into prefix, middle and suffix, and put into another order.

A text is laid out in blocks of fixed size. A Fenwick tree over its blocks
holds the number of units and of code points that begin in them; a cut after k
units descends the tree by halving steps to the block that holds the boundary,
with the code points passed on the way, and only that block is then looked at.
The trees of all texts of a batch lie in one flat array and all cuts descend
together. Nothing but block counts is ever held for a whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SLICE_BYTES, arrow_map, batch_of, narrowed, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINTS, WORDS = "code points", "words"
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class FimParameters:
    """``rate`` percent of the texts are transformed, ``spm_rate`` percent of these in suffix-first order; ``seed`` goes before the id.

    ``unit`` is what cuts fall between: code points, or words, each with the
    ASCII white space behind it (white space that begins a text is a unit).
    """

    seed: str = "1:"
    rate: int = 90
    spm_rate: int = 20
    unit: str = CODE_POINTS
    block_bytes: int = 4096


def fill_in_middle(docs: DataFrame, parameters: FimParameters = FimParameters()) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output.

    A document's draws come from a hash of its id alone, so repeated ids draw
    alike; a null id counts as an empty one. Null text is empty. Empty texts
    and texts that hold a marker stay plain. An empty table gives an empty
    table; other columns, of any name, are not read. Of a very long text only
    a slice of marks and the counts of its blocks are held beside the text.
    """
    if parameters.unit not in (CODE_POINTS, WORDS):
        raise ValueError(f"unit is {CODE_POINTS!r} or {WORDS!r}")
    return arrow_map(narrowed(docs, "doc_id", "text"), _transform, TRANSFORMED, p=parameters)


def restored(form: Column, output: Column) -> Column:
    """The text that became ``output``; it has no marker of its own unless the form is plain, so the first ones are ours."""

    def around(text: Column, marker: str) -> tuple[Column, Column]:
        before = F.substring_index(text, marker, 1)
        return before, F.substring(text, F.length(before) + len(marker) + 1, F.length(text))

    def after(text: Column, marker: str) -> Column:
        return F.substring(text, F.lit(len(marker) + 1), F.length(text))

    prefix, rest = around(after(output, PREFIX), SUFFIX)
    suffix, middle = around(rest, MIDDLE)
    spm_suffix, spm_rest = around(after(output, SUFFIX), PREFIX)
    spm_prefix, spm_middle = around(spm_rest, MIDDLE)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix))
        .otherwise(output)
    )


class BlockTrees:
    """Fenwick trees of unit and code-point counts over the blocks of some texts."""

    def __init__(self, texts: list[bytes], unit: str, block: int):
        self.unit, self.block = unit, block
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n_blocks = -(-sizes // block)
        self.first = np.cumsum(self.n_blocks) - self.n_blocks
        counts = [self._counts(text) for text in texts if text]
        self.units = self._tree(np.concatenate([c[0] for c in counts]) if counts else np.zeros(0, np.int64))
        self.chars = self._tree(np.concatenate([c[1] for c in counts]) if counts else np.zeros(0, np.int64))

    def _counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Units and code points that begin in each block, a slice of whole blocks at a time."""
        step = max(1, SLICE_BYTES // self.block) * self.block
        units, chars = [], []
        for start in range(0, len(text), step):
            end = min(start + step, len(text))
            blocks = np.arange(0, end - start, self.block)
            units.append(np.add.reduceat(unit_starts(text, start, end, self.unit), blocks, dtype=np.int64))
            chars.append(np.add.reduceat(unit_starts(text, start, end, CODE_POINTS), blocks, dtype=np.int64))
        return np.concatenate(units), np.concatenate(chars)

    def _tree(self, counts: np.ndarray) -> np.ndarray:
        """Node i of a text holds the sum of the blocks above i without its lowest bit, up to i."""
        total = np.concatenate([[0], np.cumsum(counts)])
        base = np.repeat(self.first, self.n_blocks)
        node = np.arange(len(counts)) - base + 1
        return total[base + node] - total[base + (node & (node - 1))]

    def totals(self) -> np.ndarray:
        """Units of each text: the sum of the nodes on the way from its last block."""
        left, out = self.n_blocks.copy(), np.zeros(len(self.first), np.int64)
        while (open_ := np.flatnonzero(left)).size:
            out[open_] += self.units[self.first[open_] + left[open_] - 1]
            left[open_] &= left[open_] - 1
        return out

    def descend(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For cuts after ``k`` units of texts: whole blocks before the boundary, units still to pass, code points passed."""
        passed, rest, chars = np.zeros(len(k), np.int64), k.copy(), np.zeros(len(k), np.int64)
        top = int(self.n_blocks[text].max(initial=0)).bit_length()
        for step in (1 << bit for bit in reversed(range(top))):
            ahead = passed + step
            inside = np.flatnonzero(ahead <= self.n_blocks[text])
            node = self.first[text[inside]] + ahead[inside] - 1
            fits = self.units[node] <= rest[inside]
            go, node = inside[fits], node[fits]
            passed[go] = ahead[go]
            rest[go] -= self.units[node]
            chars[go] += self.chars[node]
        return passed, rest, chars


def unit_starts(text: bytes, start: int, end: int, unit: str) -> np.ndarray:
    """Marks of the bytes of a range at which a unit begins."""
    data = np.frombuffer(text, np.uint8, end - start, start)
    if unit == CODE_POINTS:
        return (data & 0xC0) != 0x80
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[0] = start > 0 and text[start - 1 : start].isspace()
    marks = before & ~space
    marks[0] |= start == 0
    return marks


def _boundaries(texts: list[bytes], trees: BlockTrees, text: np.ndarray, k: np.ndarray) -> tuple[list[int], list[int]]:
    """Byte offset and code points before it, of each cut."""
    offsets, chars = [], []
    for i, passed, rest, before in zip(text.tolist(), *(x.tolist() for x in trees.descend(text, k))):
        start = passed * trees.block
        end = min(start + trees.block, len(texts[i]))
        if start < end:
            # the block's own unit starts; all of its units are before the boundary only at the text's end
            marks = np.flatnonzero(unit_starts(texts[i], start, end, trees.unit))
            cut = start + int(marks[rest]) if rest < len(marks) else end
            before += int(np.count_nonzero(unit_starts(texts[i], start, cut, CODE_POINTS))) if cut > start else 0
            start = cut
        offsets.append(start)
        chars.append(before)
    return offsets, chars


def _transform(batches: Iterator[pa.RecordBatch], p: FimParameters) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    )
    for batch, texts in text_slices(batches):
        ids = batch.column("doc_id").cast(pa.int64())
        trees = BlockTrees(texts, p.unit, p.block_bytes)
        n = trees.totals()
        draws = np.array([_draws(p.seed, i) for i in ids.to_pylist()], np.int64).reshape(-1, 4)
        plain = np.array([not t or any(m.encode() in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]) | (draws[:, 2] % 100 >= p.rate)
        spm = draws[:, 3] % 100 < p.spm_rate
        cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
        changed = np.flatnonzero(~plain)
        offsets, chars = _boundaries(texts, trees, np.repeat(changed, 2), cuts[changed].ravel())
        output: list[bytes] = list(texts)
        prefix_chars: list[int | None] = [None] * len(texts)
        middle_chars: list[int | None] = [None] * len(texts)
        for at, i in enumerate(changed.tolist()):
            a, b = offsets[2 * at : 2 * at + 2]
            prefix, middle, suffix = texts[i][:a], texts[i][a:b], texts[i][b:]
            order = [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)] if spm[i] else [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)]
            output[i] = b"".join([x for marker, part in order for x in (marker.encode(), part)])
            prefix_chars[i], middle_chars[i] = chars[2 * at], chars[2 * at + 1] - chars[2 * at]
        form = np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist()
        yield batch_of(schema, ids, n, form, prefix_chars, middle_chars, pa.array(output, pa.binary()).cast(pa.string()))


def _draws(seed: str, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
