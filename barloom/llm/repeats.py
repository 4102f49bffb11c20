"""Removal of long byte strings that occur more than once, by suffix arrays of shards.

Every string of ``length`` bytes has an anchor: of its grams, the one with the
least hash. Equal strings have equal anchors at equal places, so only strings
under the same anchor gram need comparing. Each occurrence of a gram that
occurs more than once brings the stretch of text that its strings cover. A
shard is some megabytes of such stretches, whole gram groups together; its
suffix array, by induced sorting, and its permuted common prefixes show which
strings start elsewhere too. Groups too large for a task are settled by counts
of string digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, batch_of, by_key, discard, mixed, pack, release_shuffles, sorted_groups, text_slices, unpacked
from barloom.llm.suffix_array import permuted_common_prefixes, suffix_array
from barloom.session import staged

SLICE = 1 << 20
INDEX_BITS = 24  # positions within a slice
PIECE = 1 << 22  # starts of a longer text that are judged together
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepeatParameters:
    """``length`` bytes make a repeat; anchors are grams of ``gram`` bytes.

    ``group`` occurrences of a gram at most share a shard of about ``shard`` bytes.
    """

    length: int = 200
    gram: int = 48
    group: int = 1000
    shard: int = 1 << 19


def remove_repeats(docs: DataFrame, parameters: RepeatParameters = RepeatParameters(), with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for.

    Null text is empty. Rows that repeat a text repeat every string in it, so
    of texts of ``length`` bytes or more nothing is left; shorter ones stay.
    Nulls in doc_id pass through; other columns are not read. An empty table
    gives none.
    """
    p = parameters
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # two hashes from different seeds name a text
    named = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))})
    long = named.where(F.octet_length("text") >= p.length).select("k1", "k2", "text")
    copied = long.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("k1", "k2", F.lit(True).alias("copied"))
    starts, stretches = repeated_starts(long, p)
    spans = starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    known = staged(spans.join(copied, ["k1", "k2"], "full"))
    discard(stretches)
    release_shuffles(docs.sparkSession)
    packed = arrow_map(named.select("doc_id", "k1", "k2", "text"), pack, "doc_id long, k1 long, k2 long, text binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return arrow_map(packed.join(known, ["k1", "k2"], "left"), _cut, schema, p=p, with_text=with_text)


def repeated_starts(texts: DataFrame, p: RepeatParameters) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, first, last): ranges of starts of strings that start elsewhere too, per different text.

    Strings of a copied text may be missing, as it is known to be repeated whole. Also
    returns the written table behind them.
    """
    anchors = arrow_map(texts, _anchors, "gram long, k1 long, k2 long, place long", p=p)
    shared = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # copies of a text collapse here; one of them brings its stretches
    held = anchors.join(shared, "gram").groupBy("k1", "k2", "gram", "size", "place").agg(F.count(F.lit(1)).alias("copies"))
    lists = held.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "size", "place")).alias("anchors"))
    packed = arrow_map(texts.select("k1", "k2", "text"), pack, "k1 long, k2 long, text binary")
    stretches = arrow_map(
        packed.join(lists, ["k1", "k2"]), _stretches, "gram long, size long, k1 long, k2 long, first int, stretch binary", p=p
    )
    stretches = staged(stretches.dropDuplicates(["gram", "k1", "k2", "first"]))
    small = by_key(stretches.where(F.col("size") <= p.group), "gram")
    found = arrow_map(small, _by_suffix_array, "k1 long, k2 long, first int, last int", p=p)
    large = stretches.where(F.col("size") > p.group)
    return (found if large.isEmpty() else found.unionByName(_by_digest(large, p))), stretches


def _by_digest(stretches: DataFrame, p: RepeatParameters) -> DataFrame:
    """The same for groups of any size: a digest of every string of the different stretches, counted.

    All strings of a stretch that stands in several places are repeated; only
    stretches of one place need to know which of their strings others hold.
    """
    named = stretches.withColumns({"c1": F.xxhash64("gram", "stretch"), "c2": F.xxhash64(F.lit(1), F.col("stretch"))})
    one = F.struct("k1", "k2", "first", "stretch")
    places = named.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("places"), F.any_value(one).alias("one"))
    distinct = staged(places.select("c1", "c2", "places", "one.*"))
    last = F.col("first") + F.octet_length("stretch") - p.length
    several = named.join(distinct.where("places > 1").select("c1", "c2"), ["c1", "c2"]).select("k1", "k2", "first", last.alias("last"))
    strings = arrow_map(distinct, _digests, "d1 long, d2 long, alone boolean, k1 long, k2 long, first int", p=p)
    counted = strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("wanted")).where("n > 1 and wanted")
    found = strings.where("alone").join(counted.select("d1", "d2"), ["d1", "d2"])
    return several.unionByName(found.select("k1", "k2", "first", F.col("first").alias("last")))


# --- anchors ------------------------------------------------------------------


def _constants() -> tuple[np.ndarray, np.uint64]:
    values = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
    return values, np.uint64(pow(int(BASE), -1, 2**64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each position, from running sums."""
    values, inverse = _constants()
    n = len(data)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * powers)])
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - gram, inverse)]))
    return mixed((sums[gram:] - sums[: n + 1 - gram]) * back)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima within blocks from both sides."""
    n = len(keys) - width + 1
    blocks = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors_of(texts: list[bytes], p: RepeatParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, gram hash): the starts whose string has its anchor at one place, of all texts, each long enough."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    offsets = np.cumsum(lengths) - lengths
    hashes = gram_hashes(data, p.gram)
    low = np.uint64((1 << INDEX_BITS) - 1)
    index = np.arange(len(hashes), dtype=np.uint64)
    least = window_minima(hashes & ~low | index, p.length - p.gram + 1) & low
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    inside = np.arange(len(least)) + p.length <= (offsets + lengths)[owner]
    begins = np.flatnonzero(inside & np.concatenate([[True], (least[1:] != least[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])]))
    stops = np.flatnonzero(inside & np.concatenate([(least[1:] != least[:-1]) | ~inside[1:] | (owner[1:] != owner[:-1]), [True]]))
    own = owner[begins]
    return own, begins - offsets[own], stops - offsets[own], hashes[least[begins].astype(np.int64)]


ANCHORS = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int64())])  # first start and, in the low half, the last


def _anchors(batches: Iterator[pa.RecordBatch], p: RepeatParameters) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches, limit=SLICE):
        for lo, hi, skipped, parts in _bounded(texts, p):
            own, first, last, gram = anchors_of(parts, p)
            k1, k2 = (batch.column(c).to_numpy()[lo:hi][own] for c in ("k1", "k2"))
            yield batch_of(ANCHORS, gram.view(np.int64), k1, k2, first + skipped << 32 | last + skipped)


def _bounded(texts: list[bytes], p: RepeatParameters) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(from, to, offset, texts) within the position bits: all together, or each alone, a longer one in pieces.

    Pieces overlap by ``length`` - 1 bytes, so each start belongs to one of them. Anchors do not depend on where a
    piece begins, as equal hashes are told apart by their order only; a range of starts may be cut at its end.
    """
    if sum(map(len, texts)) < 1 << INDEX_BITS:
        yield 0, len(texts), 0, texts
        return
    for i, text in enumerate(texts):
        size = PIECE if len(text) >= 1 << INDEX_BITS else len(text)
        for at in range(0, len(text) - p.length + 1, size):
            yield i, i + 1, at, [text[at : at + size + p.length - 1]]


STRETCHES = pa.schema(
    [("gram", pa.int64()), ("size", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("stretch", pa.binary())]
)


def _stretches(batches: Iterator[pa.RecordBatch], p: RepeatParameters) -> Iterator[pa.RecordBatch]:
    for batch in unpacked(batches):
        k1, k2, anchors = (batch.column(c).to_pylist() for c in ("k1", "k2", "anchors"))
        rows, held = [], 0
        for a, b, own, text in zip(k1, k2, anchors, batch.column("text").to_pylist()):
            for x in own:
                first, last = x["place"] >> 32, x["place"] & 0xFFFFFFFF
                stretch = text[first : last + p.length]
                rows.append((x["gram"], x["size"], a, b, first, stretch))
                held += len(stretch)
            if held > SLICE:
                yield batch_of(STRETCHES, *zip(*rows))
                rows, held = [], 0
        if rows:
            yield batch_of(STRETCHES, *zip(*rows))


# --- shards -------------------------------------------------------------------

STARTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def repeated_in(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For each of different stretches, which starts of its strings of ``length`` bytes also start in another place of any."""
    # UTF-8 bytes are below 0xF8, so two symbols are free for the end and the borders
    data = np.frombuffer(b"\x00".join(stretches) + b"\x00", np.uint8) + np.uint8(2)
    lengths = np.array([len(x) for x in stretches])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    data[starts + lengths] = 1
    s = np.concatenate([data, np.zeros(1, np.uint8)])
    sa = suffix_array(s, 256)
    shared = permuted_common_prefixes(s, sa, starts, int(lengths.max()) + length)
    with_next = np.zeros(len(s), np.int64)
    with_next[sa[:-1]] = shared[sa[1:]]
    repeated = np.maximum(shared, with_next) >= length
    return [repeated[a : a + n - length + 1] for a, n in zip(starts, lengths)]


def ranges(marked: np.ndarray) -> list[tuple[int, int]]:
    steps = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(steps == 1).tolist(), (np.flatnonzero(steps == -1) - 1).tolist()))


def _by_suffix_array(batches: Iterator[pa.RecordBatch], p: RepeatParameters) -> Iterator[pa.RecordBatch]:
    shard: dict[bytes, list[tuple[int, int, int]]] = {}
    held = 0

    def settled() -> pa.RecordBatch:
        repeated = repeated_in(list(shard), p.length)
        rows = []
        for (stretch, places), marked in zip(shard.items(), repeated):
            found = ranges(np.ones_like(marked) if len(places) > 1 else marked)
            rows += [(a, b, first + lo, first + hi) for a, b, first in places for lo, hi in found]
        return batch_of(STARTS, *(zip(*rows) if rows else [[]] * 4))

    for table, bounds in sorted_groups(batches, "gram"):
        k1, k2, first, stretches = (table.column(c).to_pylist() for c in ("k1", "k2", "first", "stretch"))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo == 1:  # the gram's other occurrence was in a copy of the same text
                continue
            for i in range(lo, hi):
                places = shard.setdefault(stretches[i], [])
                held += 0 if places else len(stretches[i])
                places.append((k1[i], k2[i], first[i]))
            if held >= p.shard:
                yield settled()
                shard, held = {}, 0
    if shard:
        yield settled()


DIGESTS = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("alone", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32())])


def _digests(batches: Iterator[pa.RecordBatch], p: RepeatParameters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2, first, places = (batch.column(c).to_pylist() for c in ("k1", "k2", "first", "places"))
        for i, stretch in enumerate(batch.column("stretch").to_pylist()):
            n = len(stretch) - p.length + 1
            both = b"".join([xxhash.xxh3_128_digest(stretch[j : j + p.length]) for j in range(n)])
            digests = np.frombuffer(both, np.int64).reshape(n, 2)
            yield batch_of(DIGESTS, digests[:, 0], digests[:, 1], [places[i] == 1] * n, [k1[i]] * n, [k2[i]] * n, np.arange(first[i], first[i] + n, dtype=np.int32))


# --- results ------------------------------------------------------------------

CUT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _cut(batches: Iterator[pa.RecordBatch], p: RepeatParameters, with_text: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(CUT + [("kept", pa.binary())] * with_text)
    for batch in unpacked(batches):
        rows = []
        copied, starts = batch.column("copied").to_pylist(), batch.column("starts").to_pylist()
        for whole, own, text in zip(copied, starts, batch.column("text").to_pylist()):
            steps = np.zeros(len(text) + 1, np.int32)
            if whole:
                own = [{"first": 0, "last": len(text) - p.length}]
            if own:
                np.add.at(steps, [x["first"] for x in own], 1)
                np.add.at(steps, [x["last"] + p.length for x in own], -1)
            removed = np.cumsum(steps[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
            rows.append((len(text), int(removed.sum()), len(ranges(removed)), hashlib.sha256(kept).hexdigest()) + (kept,) * with_text)
        if rows:
            yield batch_of(schema, batch.column("doc_id"), *zip(*rows))
