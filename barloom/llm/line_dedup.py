"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. A line goes if an earlier line, in
the order of (doc_id, line number), has a Jaccard similarity of 0.8 or more.

Lines with equal sets are one class, which stands at its first occurrence.
Tokens are ordered by rarity; a class is listed under the tokens of its prefix,
one of which any similar class must share. Within a token's list the length,
the positional and a parity bound leave few pairs; those connect classes to
candidate families. Families are verified on full sets, in which each class is
moved once: small families whole, large ones first in blocks of lines of like
length, then what is still kept there against all blocks whose lengths allow a
similar line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_map, batch_of, by_key, discard, mixed, pack, release_shuffles, sorted_groups, text_slices, unpacked, word_hashes
from barloom.llm.graph import connected_components
from barloom.session import staged

BUCKET_BITS = 20
PIECE_BITS = 14
RANK_BITS, HASH_BITS = 12, 32  # a token is known by its rank and hash together
SLICE = 1 << 20
PAIRS = 1 << 18  # pairs compared in one step
WIDE = 128  # lines of more tokens have twice the parity bits
BAND = 1.05  # lengths of one band differ by at most this factor


@dataclass(frozen=True)
class LineParameters:
    """Lines are similar at a Jaccard similarity of percent / 100; ``small`` bounds what a task compares at once.

    Rows that must ask every block of their family are taken in ``passes`` turns, so that a turn's copies of them
    are gone from the disks before the next one's are written.

    The rarity table has 2**20 counters whatever the corpus: words that share a counter only rank as less rare.
    """

    percent: int = 80
    small: int = 256
    passes: int = 4


def dedup_lines(docs: DataFrame, parameters: LineParameters = LineParameters()) -> DataFrame:
    """``docs`` with the text of kept lines and two more columns, n_lines (with words) and n_removed.

    Null text stays null; lines without words always stay. Null ids come last.
    Rows with the same doc_id and text are one document and get the same
    result. Other columns pass through, but for those named like the two
    new ones, which take their place; names that start with ``_line`` are taken.
    """
    p = parameters
    docs = docs.drop("n_lines", "n_removed")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("digest"))
    rarity = docs.sparkSession.sparkContext.broadcast(rarity_table(texts))
    classes = _classes(texts, rarity, p)
    release_shuffles(docs.sparkSession)
    places = staged(classes.select("id", "nameless", "doc_id", "digest", "line_no"))
    edges = staged(near_edges(classes, p))
    discard(classes)
    release_shuffles(docs.sparkSession)
    dropped = similar_to_earlier(texts, places, edges, rarity, p)
    release_shuffles(docs.sparkSession)
    kept = places.join(dropped, "id", "left_anti").groupBy("doc_id", "digest")
    kept = kept.agg(F.sort_array(F.collect_list("line_no")).alias("_line_kept"))
    kept = kept.select(F.col("doc_id").alias("_line_doc"), F.col("digest").alias("_line_digest"), "_line_kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_line_doc")) & (F.col("_line_hash") == F.col("_line_digest"))
    hashed = docs.withColumns({"_line_hash": F.xxhash64("text"), "_line_null": F.col("text").isNull()})
    packed_schema = hashed.withColumn("text", F.lit(b"")).select(*hashed.columns).schema
    joined = arrow_map(hashed, pack, packed_schema).join(kept, same, "left").drop("_line_doc", "_line_digest", "_line_hash")
    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema
    return arrow_map(joined, _rebuilt, schema)


# --- tokens and their rarity --------------------------------------------------


def rarity_table(texts: DataFrame) -> np.ndarray:
    """Rank 0 (rarest) to 4095 of each of 2**20 word buckets, from the word counts of all texts.

    Counted per task first; what comes to the driver is the table of fixed size, two bytes a bucket, in pieces.
    """
    counts = arrow_map(texts.select("text"), _bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("piece", F.expr(f"cast(shiftright(bucket, {PIECE_BITS}) as long)"))
    table = np.zeros(1 << BUCKET_BITS, np.uint16)
    for row in arrow_map(by_key(counts, "piece"), _rank_pieces, "piece long, ranks binary").collect():
        at = row["piece"] << PIECE_BITS
        table[at : at + (1 << PIECE_BITS)] = np.frombuffer(row["ranks"], np.uint16)
    return table


def _rank_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in sorted_groups(batches, "piece"):
        pieces, buckets, n = (table.column(c).to_numpy() for c in ("piece", "bucket", "n"))
        ranks = np.minimum(np.ceil(100 * np.log2(n)), (1 << RANK_BITS) - 1).astype(np.uint16)
        rows = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = np.zeros(1 << PIECE_BITS, np.uint16)
            own[buckets[lo:hi] & ((1 << PIECE_BITS) - 1)] = ranks[lo:hi]
            rows.append(own.tobytes())
        yield batch_of(pa.schema([("piece", pa.int64()), ("ranks", pa.binary())]), pieces[bounds[:-1]], rows)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(1 << BUCKET_BITS, np.int64)
    for _, texts in text_slices(batches):
        hashes = word_hashes([w for text in texts for w in text.lower().split()])
        totals += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
    held = np.flatnonzero(totals)
    yield batch_of(pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), held.astype(np.int32), totals[held])


def token_sets(lines: list[list[bytes]], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of all lines, each line's by rarity, and the bounds of the lines; in runs that the line bits can number."""
    most = 1 << (64 - RANK_BITS - HASH_BITS)
    if len(lines) > most:
        runs = [token_sets(lines[at : at + most], ranks) for at in range(0, len(lines), most)]
        sizes = np.concatenate([np.diff(bounds) for _, bounds in runs])
        return np.concatenate([tokens for tokens, _ in runs]), np.concatenate([[0], np.cumsum(sizes)])
    hashes = word_hashes([w for words in lines for w in words])
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), [len(words) for words in lines])
    token = ranks[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS) | hashes & np.uint64((1 << HASH_BITS) - 1)
    keys = np.unique(line << np.uint64(RANK_BITS + HASH_BITS) | token)
    owner = (keys >> np.uint64(RANK_BITS + HASH_BITS)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(lines) + 1))
    return keys & np.uint64((1 << (RANK_BITS + HASH_BITS)) - 1), bounds


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Shared tokens that sets of a and b tokens need: the least o with 100 o >= percent (a + b - o)."""
    return -(-(percent * (a + b)) // (100 + percent))


# --- classes of equal lines ---------------------------------------------------

LINES = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.int64()), ("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32())]
    + [("b1", pa.int64()), ("b2", pa.int64()), ("b3", pa.int64()), ("b4", pa.int64()), ("prefix", pa.list_(pa.int64()))]
)


def _classes(texts: DataFrame, rarity: Broadcast, p: LineParameters) -> DataFrame:
    """One row per distinct token set, at its first occurrence: id, nameless, doc_id, digest, line_no, n, b1 to b4, prefix.

    ``prefix`` packs token and position; tokens that occur once in the corpus are left out, as nothing shares them.
    """
    schema = "doc_id long, digest long, line_no int, h1 long, h2 long, n int, b1 long, b2 long, b3 long, b4 long, prefix array<long>"
    lines = arrow_map(texts, _line_rows, schema, rarity=rarity, p=p)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest", "line_no")
    about = F.struct("n", "b1", "b2", "b3", "b4", "prefix")
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first(about).alias("about"))
    return staged(firsts.select(F.monotonically_increasing_id().alias("id"), "place.*", "about.*"))


def _split(text: bytes) -> list[tuple[int, list[bytes]]]:
    lines = enumerate(text.lower().split(b"\n"))
    return [(i, words) for i, line in lines if (words := line.split())]


def _line_rows(batches: Iterator[pa.RecordBatch], rarity: Broadcast, p: LineParameters) -> Iterator[pa.RecordBatch]:
    ranks = rarity.value
    for batch, texts in text_slices(batches, limit=SLICE):
        found = [(row, i, words) for row, text in enumerate(texts) for i, words in _split(text)]
        if not found:
            continue
        tokens, bounds = token_sets([words for _, _, words in found], ranks)
        starts, n = bounds[:-1], np.diff(bounds)
        mixed_tokens = mixed(tokens)
        h1, h2 = np.add.reduceat(mixed_tokens, starts), np.add.reduceat(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), starts)
        parities = token_parities(mixed_tokens, starts, n)
        position = np.arange(len(tokens)) - np.repeat(starts, n)
        length = n - least_prefix(n, p.percent) + 1
        listed = (position < np.repeat(length, n)) & (tokens >> np.uint64(HASH_BITS) > 0)
        packed = (tokens[listed] << np.uint64(8) | np.minimum(position[listed], 255).astype(np.uint64)).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(listed.astype(np.int64), starts))]).astype(np.int32)
        rows = pa.array([row for row, _, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows), batch.column("digest").take(rows), pa.array([i for _, i, _ in found], pa.int32()),
                pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n.astype(np.int32)),
                *[pa.array(x.view(np.int64)) for x in parities], pa.ListArray.from_arrays(pa.array(ends), pa.array(packed)),
            ],
            schema=LINES,
        )


def least_prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any similar set, which is that with a subset: ceil(percent n / 100)."""
    return -(-(percent * n) // 100)


def token_parities(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Four words of bits a line: whether an even or odd number of its tokens falls on each bit.

    Shared tokens cancel out however many there are, so two lines differ in no more bits than in tokens. The first
    two words are folded from four; the last two are zero up to ``WIDE`` tokens, which keeps most postings short.
    """
    bit, word = np.uint64(1) << (hashes & np.uint64(63)), (hashes >> np.uint64(6)) & np.uint64(3)
    w1, w2, w3, w4 = (np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts) for k in range(4))
    wide = n > WIDE
    return [w1 ^ w3, w2 ^ w4, np.where(wide, w3, np.uint64(0)), np.where(wide, w4, np.uint64(0))]


def least_apart(bits: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound on the tokens that only one of two lines has."""
    d1, d2, d3, d4 = (b[i] ^ b[j] for b in bits)
    both = (n[i] > WIDE) & (n[j] > WIDE)
    folded = np.bitwise_count(d1).astype(np.int64) + np.bitwise_count(d2)
    unfolded = sum(np.bitwise_count(x).astype(np.int64) for x in (d1 ^ d3, d2 ^ d4, d3, d4))
    return np.where(both, unfolded, folded)


# --- similar classes ----------------------------------------------------------


def near_edges(classes: DataFrame, p: LineParameters) -> DataFrame:
    """Edges (a, b) whose components hold every pair that passes the bounds under a token of both prefixes."""
    listed = classes.select("id", "n", "b1", "b2", "b3", "b4", F.explode("prefix").alias("packed"))
    postings = listed.select(F.expr("shiftright(packed, 8)").alias("token"), "id", "n", F.expr("cast(packed & 255 as int)").alias("at"), "b1", "b2", "b3", "b4")
    return arrow_map(by_key(postings, "token", "n"), _near_pairs, "a long, b long", p=p)


def similar_to_earlier(texts: DataFrame, places: DataFrame, edges: DataFrame, rarity: Broadcast, p: LineParameters) -> DataFrame:
    """Ids of the classes that have a similar class with an earlier first occurrence."""
    families = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("family"))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    members = places.join(families.join(sizes, "family"), "id")
    members = staged(_with_tokens(texts, members, rarity))
    release_shuffles(texts.sparkSession)
    small = members.where(F.col("size") <= p.small).withColumn("part", F.col("family"))
    found = _verified(_roles(small, asks=True, answers=True), p)
    band = F.floor(F.log(F.octet_length("tokens") / 8) / math.log(BAND))
    large = members.where(F.col("size") > p.small).withColumn("band", band)
    if large.isEmpty():
        return found
    bands = large.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / p.small).alias("blocks"))
    # one row per large family, with a few bands each: the logarithm of its longest line
    spans = bands.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    large = large.join(spans, "family")
    block = F.pmod(F.xxhash64("id"), F.element_at("blocks", F.col("band")))
    rows = large.withColumn("part", F.xxhash64("family", "band", block))
    first = staged(_verified(_roles(rows, asks=True, answers=True), p))
    release_shuffles(texts.sparkSession)
    left = staged(large.join(first, "id", "left_anti"))
    release_shuffles(texts.sparkSession)
    reach = math.ceil(math.log(100 / p.percent) / math.log(BAND) + 1e-9)
    near = F.filter(F.map_keys("blocks"), lambda k: F.abs(k - F.col("band")) <= reach)
    numbers = F.flatten(
        F.transform(
            near,
            lambda k: F.transform(
                F.sequence(F.lit(0).cast("long"), F.element_at("blocks", k) - 1), lambda b: F.xxhash64("family", k, b)
            ),
        )
    )
    # every row answers in its own block only, so those that ask need not answer each other in all of them
    answering = _roles(rows.join(left.select("family").distinct(), "family", "left_semi"), asks=False, answers=True)
    for turn in range(p.passes):
        asks = left.where(F.pmod(F.xxhash64(F.lit("turn"), F.col("id")), F.lit(p.passes)) == turn)
        asking = _roles(asks.withColumn("part", F.explode(numbers)), asks=True, answers=False)
        first = first.unionByName(staged(_verified(answering.unionByName(asking), p)))
        release_shuffles(texts.sparkSession)
    return found.unionByName(first).distinct()


def _near_pairs(batches: Iterator[pa.RecordBatch], p: LineParameters) -> Iterator[pa.RecordBatch]:
    """A spanning star of each component of pairs that pass the length, positional and parity bounds under a token."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for table, bounds in sorted_groups(batches, "token"):
        names, n, at = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "at"))
        bits = [table.column(c).to_numpy().view(np.uint64) for c in ("b1", "b2", "b3", "b4")]
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        # rows are sorted by token and n: those near enough in length above a row are the next ones
        span = int(n.max()) * 100 // p.percent + 2
        key = group * span + n
        reach = np.searchsorted(key, group * span + n * 100 // p.percent, side="right") - np.arange(len(n)) - 1
        roots = np.arange(len(n))
        done = 0
        totals = np.cumsum(reach)
        while done < len(n):
            before = totals[done - 1] if done else 0
            until = max(done + 1, int(np.searchsorted(totals, before + PAIRS, side="right")))
            counts = reach[done:until]
            i = np.repeat(np.arange(done, until), counts)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            done = until
            # a list of like lines has many more pairs than lines: those of one component are dropped, the others joined at once
            apart = np.flatnonzero(roots[i] != roots[j])
            i, j = i[apart], j[apart]
            need = least_overlap(n[i], n[j], p.percent)
            # most pairs fall to the positional bound, which reads less
            few = np.flatnonzero(np.minimum(n[i] - at[i], n[j] - at[j]) >= need)
            i, j, need = i[few], j[few], need[few]
            near = (n[i] + n[j] - least_apart(bits, n, i, j)) // 2 >= need
            roots = _joined(roots, i[near], j[near])
        moved = roots != np.arange(len(n))
        if moved.any():
            yield batch_of(schema, names[moved], names[roots[moved]])


def _joined(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``roots``, the smallest member of each row's set, after the sets of i and j were joined, pair by pair; in place."""
    while len(apart := np.flatnonzero(roots[i] != roots[j])):
        i, j = i[apart], j[apart]
        a, b = roots[i], roots[j]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while np.any((further := roots[roots]) != roots):
            roots = further
    return roots


def _with_tokens(texts: DataFrame, members: DataFrame, rarity: Broadcast) -> DataFrame:
    """``members`` (id, family, size and place) with their tokens, cut again from the documents that hold them."""
    about = F.struct("id", "family", "size", "line_no")
    wanted = members.groupBy("doc_id", "digest").agg(F.collect_list(about).alias("wanted")).withColumnRenamed("doc_id", "_id").withColumnRenamed("digest", "_digest")
    # rows that repeat id and text would give their lines twice
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    packed = arrow_map(texts, pack, "doc_id long, text binary, digest long")
    holding = packed.join(wanted, same).select("doc_id", "digest", "text", "wanted")
    schema = "id long, family long, size long, nameless boolean, doc_id long, digest long, line_no int, tokens binary"
    return arrow_map(holding, _tokens_of, schema, rarity=rarity).dropDuplicates(["id"])


TOKENS = pa.schema(
    [("id", pa.int64()), ("family", pa.int64()), ("size", pa.int64()), ("nameless", pa.bool_())]
    + [("doc_id", pa.int64()), ("digest", pa.int64()), ("line_no", pa.int32()), ("tokens", pa.binary())]
)


def _tokens_of(batches: Iterator[pa.RecordBatch], rarity: Broadcast) -> Iterator[pa.RecordBatch]:
    ranks = rarity.value
    for batch, texts in text_slices(unpacked(batches), limit=SLICE):
        ids, digests, wanted = (batch.column(c).to_pylist() for c in ("doc_id", "digest", "wanted"))
        found = []
        for row, text in enumerate(texts):
            lines = text.lower().split(b"\n")
            found += [(row, w, lines[w["line_no"]].split()) for w in wanted[row]]
        tokens, bounds = token_sets([words for _, _, words in found], ranks)
        rows = [
            (w["id"], w["family"], w["size"], ids[r] is None, ids[r], digests[r], w["line_no"], tokens[lo:hi].tobytes())
            for (r, w, _), lo, hi in zip(found, bounds[:-1], bounds[1:])
        ]
        yield batch_of(TOKENS, *zip(*rows))


def _roles(rows: DataFrame, *, asks: bool, answers: bool) -> DataFrame:
    return rows.withColumns({"asks": F.lit(asks), "answers": F.lit(answers)})


def _verified(rows: DataFrame, p: LineParameters) -> DataFrame:
    # a row that only asks stands before its own copy that answers
    rows = rows.select("part", "asks", "answers", "id", "nameless", "doc_id", "digest", "line_no", "tokens")
    return arrow_map(by_key(rows, "part", "nameless", "doc_id", "digest", "line_no", "answers"), _later_ones, "id long", p=p)


def _later_ones(batches: Iterator[pa.RecordBatch], p: LineParameters) -> Iterator[pa.RecordBatch]:
    """Asking rows of a part with a similar answering row before them; rows come in the order of their places."""
    schema = pa.schema([("id", pa.int64())])
    part, earlier, lengths = None, [], []
    for batch in batches:
        # open lines of a large family ask in each of its blocks: a part may be long, but few of its rows answer
        parts, names, asks, answers = (batch.column(c).to_pylist() for c in ("part", "id", "asks", "answers"))
        tokens = batch.column("tokens")
        found = []
        for i in range(batch.num_rows):
            if parts[i] != part:
                part, earlier, lengths = parts[i], [], []
            own = np.frombuffer(tokens[i].as_py(), np.uint64)
            if asks[i] and earlier and _similar_one(own, earlier, lengths, p.percent):
                found.append(names[i])
            if answers[i]:
                earlier.append(own)
                lengths.append(len(own))
        yield batch_of(schema, found)


def _similar_one(own: np.ndarray, others: list[np.ndarray], lengths: list[int], percent: int) -> bool:
    n = np.array(lengths)
    fits = np.flatnonzero((100 * n >= percent * len(own)) & (100 * len(own) >= percent * n))
    for at in range(0, len(fits), 64):
        some = fits[at : at + 64]
        held = np.concatenate([others[k] for k in some])
        place = np.minimum(np.searchsorted(own, held), len(own) - 1)
        starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        both = np.add.reduceat((own[place] == held).astype(np.int64), starts)
        if (both >= least_overlap(n[some], len(own), percent)).any():
            return True
    return False


# --- texts --------------------------------------------------------------------


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(unpacked(batches)):
        kept = batch.column("_line_kept").to_pylist()
        valid = [not null for null in batch.column("_line_null").to_pylist()]
        out, totals, removed = [], [], []
        for text, stays, there in zip(texts, kept, valid):
            stay = set(stays or ())
            lines = text.split(b"\n")
            worded = [bool(line.split()) for line in lines]
            rest = [line for i, line in enumerate(lines) if i in stay or not worded[i]]
            out.append(b"\n".join(rest) if there else None)
            totals.append(sum(worded))
            removed.append(len(lines) - len(rest))
        batch = batch.drop_columns(["_line_kept", "_line_null"])
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, pa.field("text", pa.string()), pa.array(out, pa.binary()).cast(pa.string()))
        yield batch.append_column("n_lines", pa.array(totals, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
