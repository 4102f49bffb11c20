"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, in powers of two. In each
partition an item is represented by its ``minima`` smallest shingle hashes: a
document that holds a share c of an item's shingles holds each of them with
that chance, whatever the document's own size, so a long document is not
sketched at all (its similarity to a short item is a few thousandths, which no
sketch of it could show). Documents probe with all their shingles. A document
with fewer shingles than a partition's least containment asks for is not probed
there. Candidates are verified by exact containment of shingles.

Everything is DataFrame functions; shingles are 64-bit hashes of word hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import hidden
from barloom.session import staged

WORD_BREAK = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class ContainmentParameters:
    """A document is contaminated by an item if it holds at least percent / 100 of the item's distinct shingles.

    With 12 minima, an item at 0.8 is missed with a chance of 0.2**12 = 4e-9.
    """

    words: int = 5
    percent: int = 80
    minima: int = 12


def contaminated(docs: DataFrame, items: DataFrame, parameters: ContainmentParameters = ContainmentParameters()) -> DataFrame:
    """One row per pair: doc_id, item_id, n_item_shingles, n_shared.

    Words are runs of letters and digits, lower-cased. Null or empty texts and
    texts with fewer words than a shingle hold nothing and are held by nothing.
    Rows with a null id are left out, since a pair cannot name them (see
    ``without_contaminated`` for filtering). Rows of one doc_id or item_id count
    as one text: their shingles together. Other columns are not read.
    """
    p = parameters
    item_sets = staged(_shingle_sets(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), p, "item_id"))
    probes, wanted = _item_index(item_sets, "item_id", p)
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    pairs = staged(_candidates(documents, probes, p, "doc_id", "item_id"))
    hit = pairs.select("doc_id").distinct()
    return _verified(documents.join(hit, "doc_id", "left_semi"), pairs, wanted, p, "doc_id", "item_id")


def without_contaminated(docs: DataFrame, items: DataFrame, parameters: ContainmentParameters = ContainmentParameters()) -> DataFrame:
    """``docs`` without the rows that hold an item; a row without doc_id is judged by its text.

    Items are told apart by their texts, so items without an id, or of one id
    with different texts, count each. Columns of any name pass through.
    """
    (taken,) = hidden(docs, "_bad")
    items = items.select(F.xxhash64("text").alias("item_id"), "text")
    found = contaminated(docs, items, parameters).select(F.col("doc_id").alias(taken)).distinct()
    clean = docs.where("doc_id is not null").join(found, F.col("doc_id") == F.col(taken), "left_anti")
    nameless = docs.where("doc_id is null")
    # a stand-in id from the text, so that rows without id can be judged and told apart
    stand_in = F.xxhash64(F.coalesce("text", F.lit("")))
    bad = contaminated(nameless.select(stand_in.alias("doc_id"), "text"), items, parameters).select(F.col("doc_id").alias(taken)).distinct()
    return clean.unionByName(nameless.join(bad, stand_in == F.col(taken), "left_anti"))


def shingles(text: str, words: int) -> Column:
    """Hashes of the distinct runs of ``words`` words; empty for shorter texts."""
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_BREAK), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))
    # let() by a one-element array: the hashes are computed once and then read by position
    windows = F.transform(
        F.array(hashed),
        lambda h: F.when(
            F.size(h) >= words,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))),
                lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(words)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return F.element_at(windows, 1)


def _shingle_sets(rows: DataFrame, p: ContainmentParameters, key: str) -> DataFrame:
    """(key, shingle): distinct."""
    exploded = rows.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(shingles("text", p.words))).alias("shingle"))
    return exploded.distinct()


def _item_index(item_sets: DataFrame, key: str, p: ContainmentParameters) -> tuple[DataFrame, DataFrame]:
    """(shingle, key, least) of each item's minima, and (key, shingle, n_item_shingles) of whole items.

    ``least`` is the fewest shingles that a document must have for any item of the size partition.
    """
    sized = item_sets.groupBy(key).agg(F.count(F.lit(1)).alias("n_item_shingles"), F.sort_array(F.collect_list("shingle")).alias("all"))
    partition = F.floor(F.log2("n_item_shingles"))
    least = F.ceil(F.pow(F.lit(2.0), partition) * p.percent / 100).cast("long")
    sized = staged(sized.withColumn("least", least))
    probes = sized.select(F.explode(F.slice("all", 1, p.minima)).alias("shingle"), key, "least")
    return probes, sized.select(key, "n_item_shingles", F.explode("all").alias("shingle"))


def _candidates(documents: DataFrame, probes: DataFrame, p: ContainmentParameters, doc: str, item: str) -> DataFrame:
    held = documents.select(doc, shingles("text", p.words).alias("held")).select(doc, F.size("held").alias("n"), F.explode("held").alias("shingle"))
    return held.join(probes, (held["shingle"] == probes["shingle"]) & (F.col("n") >= F.col("least"))).select(doc, item).distinct()


def _verified(documents: DataFrame, pairs: DataFrame, wanted: DataFrame, p: ContainmentParameters, doc: str, item: str) -> DataFrame:
    held = documents.select(doc, F.explode(F.array_distinct(shingles("text", p.words))).alias("shingle"))
    shared = held.join(wanted, "shingle").join(pairs, [doc, item], "left_semi")
    counted = shared.groupBy(doc, item, "n_item_shingles").agg(F.countDistinct("shingle").alias("n_shared"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * p.percent).select(doc, item, "n_item_shingles", "n_shared")
