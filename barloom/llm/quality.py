"""Quality rules: word statistics of a text, and cross-document line frequency per host.

Normalised lines are hashed. Per host, a line counts the documents that hold
it, copies of one text counting once. A line is frequent if they are more than ``min_documents`` and more than
``max_share`` of the host's documents. Frequent lines are removed, and a
document that keeps too few of its words is depleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import arrow_map, batch_of, hidden, shingle_windows, text_slices, unpacked, word_hashes
from barloom.session import staged

SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]  # fixed values


@dataclass(frozen=True)
class QualityParameters:
    """``min_words`` and ``max_repeat_percent`` are the base rules; the others bound line frequency and depletion.

    Documents without a host form a host of their own.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    min_documents: int = 100
    max_share: float = 0.1
    min_kept_share: float = 0.2
    min_kept_words: int = 5


def quality(docs: DataFrame, parameters: QualityParameters = QualityParameters(), host: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_cut_words, kept.

    Null text has no words and fails. Lines without words never count. Repeated rows each get their row. Other columns
    are not read. An empty table gives none.
    """
    p = parameters
    rated = _rated(docs, p, host)
    judged = rated.join(_frequent_lines(rated, p), "host", "left")
    cut = "aggregate(lines, 0L, (n, x) -> n + if(array_contains(frequent, x.line), x.words, 0L))"
    judged = judged.withColumn("n_cut_words", F.when(F.col("frequent").isNull(), F.lit(0)).otherwise(F.expr(cut)).cast("long"))
    left = F.col("n_words") - F.col("n_cut_words")
    depleted = (F.col("n_cut_words") > 0) & ((left < p.min_kept_words) | (left < F.col("n_words") * p.min_kept_share))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_cut_words"]
    return judged.select(*columns, (~F.col("base_failed") & ~depleted).alias("kept"))


def filter_documents(docs: DataFrame, parameters: QualityParameters = QualityParameters(), host: str = "source") -> DataFrame:
    """The documents that ``quality`` keeps, all columns, the text without its frequent lines.

    Columns of any name pass through. Null text has no words and goes; an
    empty table gives an empty table; repeated rows are judged alike. Texts
    that fail by themselves go first, the others travel compressed to the
    lines that are cut from them, and are unpacked a few at a time.
    """
    p = parameters
    keys = hidden(docs, "_host", "_k1", "_k2")
    frequent, packed = hidden(docs, "_frequent", "_packed")
    # two hashes from different seeds name a text
    named = dict(zip(keys, [_host(docs, host), F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))]))
    texts = docs.select(*[x.alias(k) for k, x in zip(("_host", "_k1", "_k2"), named.values())], "text")
    cut = _cut_lines(texts, p).toDF(*keys, frequent)
    rest = [c for c in docs.columns if c != "text"]
    fields = [docs.schema[c] for c in rest]
    carried = T.StructType([*fields, *[T.StructField(k, kind) for k, kind in zip(keys, (T.StringType(), T.LongType(), T.LongType()))], T.StructField(packed, T.BinaryType())])
    sound = docs.withColumns(named).select(*[F.col(f"`{c}`") for c in rest], *keys, "text")
    small = arrow_map(sound, _sound, carried, p=p, packed=packed)
    joined = small.join(cut, keys, "left").select(*[F.col(f"`{c}`") for c in rest], packed, frequent)
    out = T.StructType([*fields, docs.schema["text"]])
    filtered = arrow_map(joined, _filtered, out, p=p, packed=packed, frequent=frequent)
    return filtered.select(*[F.col(f"`{c}`") for c in docs.columns])


def _host(docs: DataFrame, host: str):
    # a prefix keeps the host of rows without one apart from every name
    return F.coalesce(F.concat(F.lit("h:"), docs[host].cast("string")), F.lit("none"))


def _rated(docs: DataFrame, p: QualityParameters, host: str) -> DataFrame:
    """Word statistics and the distinct lines (hash, words) of each document: a narrow table that later steps scan."""
    schema = "doc_id long, host string, digest binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    schema += "base_failed boolean, lines array<struct<line: bigint, words: bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(docs, host).alias("host"), "text")
    return staged(arrow_map(rows, _rate, schema, p=p))


def _cut_lines(texts: DataFrame, p: QualityParameters) -> DataFrame:
    """(_host, _k1, _k2, _frequent): of each different text that holds frequent lines, those lines.

    Joined by (host, line), so neither the lines of a host nor their number need a bound.
    """
    keys = ["_host", "_k1", "_k2"]
    lines = arrow_map(texts, _line_hashes, "_host string, _k1 long, _k2 long, lines array<bigint>")
    lines = staged(lines.dropDuplicates(keys))
    each = lines.select(*keys, F.explode("lines").alias("line"))
    frequent = each.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.min_documents)
    if p.max_share > 0:
        hosts = lines.groupBy("_host").agg(F.count(F.lit(1)).alias("n_documents"))
        frequent = frequent.join(hosts, "_host").where(F.col("n") > F.col("n_documents") * p.max_share)
    frequent = staged(frequent.select("_host", "line"))
    return staged(each.join(frequent, ["_host", "line"]).groupBy(*keys).agg(F.collect_list("line").alias("_frequent")))


def _frequent_lines(rated: DataFrame, p: QualityParameters) -> DataFrame:
    """(host, frequent): per host the lines above both limits.

    A host has at most (mean distinct lines of its documents) / max_share of
    them, so the array does not grow with the host. The table is written, so
    that Spark knows its size before it chooses how to join it.
    """
    rated = rated.select("host", "digest", "lines").dropDuplicates(["host", "digest"])
    counted = rated.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("n_documents"))
    above = counted.where(F.col("n") > p.min_documents).join(hosts, "host").where(F.col("n") > F.col("n_documents") * p.max_share)
    return staged(above.groupBy("host").agg(F.collect_set("line").alias("frequent")))


RATED = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), ("digest", pa.binary())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))]
)


def line_hash(words: list[bytes]) -> int:
    """Signed hash of a line: lower-cased words joined by single spaces."""
    value = xxhash.xxh3_64_intdigest(b" ".join(words).lower())
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = shingle_windows(word_hashes(words), width)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return int((np.cumsum(steps) > 0).sum())


def _rate(batches: Iterator[pa.RecordBatch], p: QualityParameters) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        rows = []
        for text in texts:
            words = text.split()
            repeated = repeated_words(words)
            seen: set[bytes] = set()
            lines: dict[int, int] = {}
            duplicates = 0
            for line in text.split(b"\n"):
                if own := line.split():
                    duplicates += line in seen
                    seen.add(line)
                    lines.setdefault(line_hash(own), len(own))
            failed = len(words) < p.min_words or 100 * repeated > p.max_repeat_percent * len(words)
            chars = len(b"".join(words).decode("utf-8", "replace"))
            symbols = sum(text.count(s) for s in SYMBOLS)
            rows.append((xxhash.xxh3_128_digest(text), len(words), chars, symbols, duplicates, repeated, failed, [{"line": h, "words": n} for h, n in lines.items()]))
        yield batch_of(RATED, batch.column("doc_id"), batch.column("host"), *zip(*rows))


LINES = pa.schema([("_host", pa.string()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("lines", pa.list_(pa.int64()))])


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        lines = [list({line_hash(own) for line in text.split(b"\n") if (own := line.split())}) for text in texts]
        yield batch_of(LINES, batch.column("_host"), batch.column("_k1"), batch.column("_k2"), lines)


def _sound(batches: Iterator[pa.RecordBatch], p: QualityParameters, packed: str) -> Iterator[pa.RecordBatch]:
    """Rows whose text does not fail by itself, with the text compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for batch, texts in text_slices(batches):
        stays = [i for i, text in enumerate(texts) if not _fails(text.split(), p)]
        yield _with(batch, stays, ["text"], packed, pa.array([press.compress(texts[i]) for i in stays], pa.binary()))


def _with(batch: pa.RecordBatch, rows: list[int], less: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    """Some rows, without the columns ``less``, and one more column."""
    at = pa.array(rows, pa.int64())
    names = [c for c in batch.schema.names if c not in less]
    return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], column], names=[*names, name])


def _fails(words: list[bytes], p: QualityParameters) -> bool:
    return len(words) < p.min_words or 100 * repeated_words(words) > p.max_repeat_percent * len(words)


def _filtered(batches: Iterator[pa.RecordBatch], p: QualityParameters, packed: str, frequent: str) -> Iterator[pa.RecordBatch]:
    """Rows with their unpacked texts, less the frequent lines; depleted ones go."""
    for part in unpacked(batches, packed):
        for batch, texts in text_slices(iter([part]), packed):
            lines = batch.column(frequent)
            stays, kept = [], []
            for i, text in enumerate(texts):
                text = _without_lines(text, set(lines[i].as_py() or ()), p)
                if text is not None:
                    stays.append(i)
                    kept.append(text)
            yield _with(batch, stays, [packed, frequent], "text", pa.array(kept, pa.binary()).cast(pa.string()))


def _without_lines(text: bytes, cut: set[int], p: QualityParameters) -> bytes | None:
    """The text without the lines to cut; None if that leaves too little."""
    if not cut:
        return text
    lines = text.split(b"\n")
    rest = [x for x in lines if not (own := x.split()) or line_hash(own) not in cut]
    if len(rest) == len(lines):
        return text
    shorter = b"\n".join(rest)
    left = len(shorter.split())
    return None if left < p.min_kept_words or left < len(text.split()) * p.min_kept_share else shorter
