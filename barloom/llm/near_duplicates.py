"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with the same shingle set form one class. Every class gets a vector
of minwise tokens. Independent trees branch the classes by selected tokens:
a node's children are the classes that agree on some tokens the node selects.
Small nodes are compared exhaustively on the token vectors; large ones are compared
in random blocks, then branch again by further tokens. A node whose classes are
already in one candidate family has nothing left to find. What is still large
after the last level is compared block against block, so no case is left out.

Candidate families are then settled on full shingle sets, each set being moved
once. Large families are settled in random blocks, and whatever is outside the
family's largest component afterwards is compared with all of the family.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Forest, arrow_map, batch_of, by_key, hidden, narrowed, pack, release_shuffles, shingle_sets, sorted_groups, text_slices, unpacked
from barloom.llm.graph import connected_components
from barloom.session import staged


@dataclass(frozen=True)
class NearParameters:
    """``words`` per shingle; documents are linked at a Jaccard similarity of percent / 100 or more.

    ``tokens`` minwise tokens estimate a similarity s with a deviation of sqrt(s (1-s) / tokens): 0.05 at 0.8 of 64.
    ``slack`` is what an estimate may lie below the threshold, four deviations.
    ``trees`` root tokens are selected; a pair at 0.8 misses all 8 with a chance of 0.2**8 = 3e-6.
    ``branches`` children per class are selected at each inner node, each by ``joint`` tokens together, so that
    classes which only share a frequent passage part quickly. At 0.8 a pair survives one level of branching with a
    chance of 1 - (1 - 0.8**3)**4 = 0.94, two with 0.93, and misses all trees with a chance of 2e-5.
    Candidates need 39 of 64 equal minima, which a pair at exactly 0.8 lacks with a chance of 1.3e-4.
    """

    words: int = 5
    percent: int = 80
    tokens: int = 64
    slack: float = 0.2
    trees: int = 8
    branches: int = 4
    joint: int = 3
    levels: int = 3
    small: int = 256
    settle_rounds: int = 3


def near_duplicates(docs: DataFrame, parameters: NearParameters = NearParameters()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null or empty text, or text without words: no shingles, linked with
    nothing. Repeated rows and equal texts share a class. component_id is the
    smallest doc_id of the group; kept says that the row has that doc_id. A
    null doc_id takes part in links; its row is kept only if the whole group
    has no doc_id (component_id is then null). An empty table gives none.
    """
    base, of_class = _grouped(narrowed(docs, "doc_id", "text"), parameters)
    return (
        base.select("doc_id", "n_shingles", "cls")
        .join(of_class.select("cls", "component_id"), "cls", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def _grouped(docs: DataFrame, p: NearParameters, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n_shingles, tokens and the ``carried`` long columns) of each row, and (cls, component_id, root) of each class."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, cls binary, n_shingles long, tokens array<int>" + "".join(f", {c} long" for c in carried)
    base = staged(arrow_map(docs, _sketches, schema, p=p, carried=carried))
    docs = docs.select("doc_id", "text")
    classes = staged(base.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.max("tokens").alias("tokens")))
    families = connected_components(candidate_edges(classes, p))
    release_shuffles(docs.sparkSession)
    labels = settle(docs, classes, families, p)
    named = classes.select("cls", "first_id").join(labels, "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return base, staged(named.join(least, "root").select("cls", "component_id", "root"))


def keep_one_of_each(docs: DataFrame, parameters: NearParameters = NearParameters()) -> DataFrame:
    """One row of ``docs`` per group, all columns: the smallest doc_id, then the smallest text hash; rows without an id come last.

    Rows that repeat both id and text stay once, whichever of them. Rows without words are linked with nothing: all stay.
    Columns of any name pass through; an empty table gives an empty table.
    """
    ident, k1, k2, w_id, w1, w2, as_is = hidden(docs, "_id", "_k1", "_k2", "_w_id", "_w1", "_w2", "_as_is")
    # two hashes from different seeds name a text
    keyed = docs.withColumns({ident: F.col("doc_id").cast("long"), k1: F.xxhash64("text"), k2: F.xxhash64(F.lit(1), F.col("text"))})
    keys = ["_k1", "_k2"]
    texts = keyed.select(F.col(ident).alias("doc_id"), "text", F.col(k1).alias("_k1"), F.col(k2).alias("_k2"))
    base, of_class = _grouped(texts, parameters, *keys)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *keys)
    worded = base.where("cls is not null").select("cls", place.alias("place")).join(of_class.select("cls", "root"), "cls")
    winners = worded.groupBy("root").agg(F.min("place").alias("place")).select("place.*", F.lit(False).alias("wordless"))
    wordless = base.where("cls is null").select(F.col("doc_id").isNull().alias("nameless"), "doc_id", *keys).distinct()
    wanted = winners.unionByName(wordless.withColumn("wordless", F.lit(True)))
    # places whose id and text several rows repeat; only those rows are brought together
    counts = base.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("_w_id").eqNullSafe(counts["doc_id"]) & (F.col("_w1") == counts["_k1"]) & (F.col("_w2") == counts["_k2"])
    wanted = wanted.select(F.col("doc_id").alias("_w_id"), F.col("_k1").alias("_w1"), F.col("_k2").alias("_w2"), "wordless")
    wanted = staged(wanted.join(counts, same).select("_w_id", "_w1", "_w2", (F.col("wordless") | (F.col("n") == 1)).alias("_as_is")))
    wanted = wanted.toDF(w_id, w1, w2, as_is)
    found = keyed.join(wanted, F.col(ident).eqNullSafe(F.col(w_id)) & (F.col(k1) == F.col(w1)) & (F.col(k2) == F.col(w2)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = found.where(~F.col(as_is)).dropDuplicates([ident, k1, k2])
    return found.where(F.col(as_is)).select(*columns).unionByName(once.select(*columns))


# --- token vectors ------------------------------------------------------------


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = None
    for i in range(0, len(shingles), 4096):
        part = ((shingles[i : i + 4096, None] * multipliers[None, :]) >> np.uint64(32)).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint32).view(np.int32)


SKETCH = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("n_shingles", pa.int64()), ("tokens", pa.list_(pa.int32()))])
SETS = pa.schema([("cls", pa.binary()), ("tokens", pa.binary()), ("shingles", pa.binary())])
EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketches(batches: Iterator[pa.RecordBatch], p: NearParameters, carried: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*SKETCH, *[(c, pa.int64()) for c in carried]])
    multipliers = _multipliers(p.tokens)
    for batch, texts in text_slices(batches):
        sets = shingle_sets(texts, p.words)
        yield batch_of(
            schema,
            batch.column("doc_id"),
            [_class_of(s) if len(s) else None for s in sets],
            [len(s) for s in sets],
            [minwise(s, multipliers) if len(s) else None for s in sets],
            *[batch.column(c) for c in carried],
        )


def _full_sets(batches: Iterator[pa.RecordBatch], p: NearParameters) -> Iterator[pa.RecordBatch]:
    multipliers = _multipliers(p.tokens)
    for _, texts in text_slices(unpacked(batches)):
        sets = [s for s in shingle_sets(texts, p.words) if len(s)]
        yield batch_of(SETS, [_class_of(s) for s in sets], [minwise(s, multipliers).tobytes() for s in sets], [s.tobytes() for s in sets])


# --- candidate families -------------------------------------------------------


def candidate_edges(classes: DataFrame, p: NearParameters) -> DataFrame:
    """Edges (a, b) whose components hold every pair the trees bring together with a near enough estimate."""
    tokens = classes.select("cls", "tokens")
    picked = F.posexplode(F.slice("tokens", 1, p.trees)).alias("tree", "token")
    nodes = tokens.select("cls", picked).select(F.xxhash64("tree", "token").alias("node"), "cls")
    edges = None
    for level in range(p.levels):
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = staged(nodes.join(sizes, "node"))
        small = sized.where(F.col("size") <= p.small)
        large = sized.where(F.col("size") > p.small)
        found = _compared(small.withColumn("part", F.col("node")), tokens, p)
        edges = found if edges is None else edges.unionByName(found)
        if large.isEmpty():
            return edges
        components = connected_components(edges.unionByName(_compared(_random_blocks(large, "node", level, p.small), tokens, p)))
        # later levels only need what is connected, not by which edges
        edges = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
        open_nodes = _without_settled(large.select("node", "cls"), components)
        if level == p.levels - 1:
            return edges.unionByName(_compared(_block_pairs(open_nodes, "node", p.small), tokens, p))
        # a rest of one block meets all of its node in rows linear in the node, so such a node needs no children
        few = F.col("n_rest") <= p.small // 2
        edges = edges.unionByName(_compared(_block_pairs(open_nodes.where(few), "node", p.small), tokens, p))
        nodes = _children(open_nodes.where(~few), tokens, level, p)
    return edges


def _children(nodes: DataFrame, tokens: DataFrame, level: int, p: NearParameters) -> DataFrame:
    """Every class under each of the node's ``branches`` choices of ``joint`` tokens, from those that no level before could take."""
    per_level = (p.tokens - p.trees) // (p.levels - 1)
    share = per_level // p.branches
    children = []
    for branch in range(p.branches):
        start = p.trees + level * per_level + branch * share
        turn = F.pmod(F.xxhash64("node", F.lit(branch)), F.lit(share)).cast("int")
        chosen = [F.element_at("tokens", start + (turn + F.lit(i)) % share + 1) for i in range(p.joint)]
        children.append(F.xxhash64("node", F.lit(branch), turn, *chosen))
    return nodes.select("node", "cls").join(tokens, "cls").select(F.explode(F.array(*children)).alias("node"), "cls")


def _without_settled(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(node, cls, component, main, n_main, n_rest) of nodes with two components or more; main is the most frequent one."""
    held = rows.join(components.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    held = staged(held)
    counts = held.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = counts.groupBy("node").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")
    )
    mains = mains.where("kinds > 1").select(
        "node", F.col("top.component").alias("main"), F.col("top.n").alias("n_main"), (F.col("total") - F.col("top.n")).alias("n_rest")
    )
    return held.join(mains, "node")


def _random_blocks(rows: DataFrame, node: str, seed: int, small: int) -> DataFrame:
    blocks = F.ceil(F.col("size") / (small // 2))
    salt = F.pmod(F.xxhash64("cls", F.lit(seed)), blocks)
    return rows.withColumn("part", F.xxhash64(node, salt, F.lit(seed)))


def _block_pairs(rows: DataFrame, node: str, small: int) -> DataFrame:
    """Blocks of the main component against blocks of the rest, and of the rest among themselves.

    Rows of the main component are never compared with each other: ``asks`` is false for them.
    """
    half = small // 2
    n_main, n_rest = F.ceil(F.col("n_main") / half), F.ceil(F.col("n_rest") / half)
    asks = F.col("component") != F.col("main")
    own = F.pmod(F.xxhash64("cls"), F.when(asks, n_rest).otherwise(n_main))
    others = F.sequence(F.lit(0).cast("long"), n_rest - 1)
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), n_main - 1), lambda m: F.concat_ws("m", m, own))
    among = F.transform(others, lambda o: F.concat_ws("r", F.least(own, o), F.greatest(own, o)))
    parts = F.when(asks, F.concat(with_main, among)).otherwise(F.transform(others, lambda o: F.concat_ws("m", own, o)))
    return rows.select(node, "cls", asks.alias("asks"), F.explode(parts).alias("pair")).withColumn("part", F.xxhash64(node, "pair"))


def _compared(rows: DataFrame, tokens: DataFrame, p: NearParameters) -> DataFrame:
    if "asks" not in rows.columns:
        rows = rows.withColumn("asks", F.lit(True))
    rows = rows.select("part", "cls", "asks").join(tokens, "cls")
    return arrow_map(by_key(rows.select("part", "cls", "asks", "tokens"), "part"), _near_estimates, "a binary, b binary", p=p)


def _least(p: NearParameters) -> int:
    return int(np.ceil(p.tokens * max(0.0, p.percent / 100 - p.slack)))


def _near_estimates(batches: Iterator[pa.RecordBatch], p: NearParameters) -> Iterator[pa.RecordBatch]:
    """A spanning star of each component of near estimates within a part."""
    least = _least(p)
    for table, bounds in sorted_groups(batches, "part"):
        names = table.column("cls").to_pylist()
        asks = table.column("asks").to_numpy()
        vectors = table.column("tokens").combine_chunks().flatten().to_numpy().reshape(len(names), p.tokens)
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            forest = Forest(hi - lo)
            for i in np.flatnonzero(asks[lo:hi]):
                near = (vectors[lo:hi] == vectors[lo + i]).sum(axis=1) >= least
                for j in np.flatnonzero(near):
                    forest.join(int(i), int(j))
            for i in range(hi - lo):
                if (root := forest.root(i)) != i:
                    a.append(names[lo + i])
                    b.append(names[lo + root])
        yield batch_of(EDGES, a, b)


# --- exact components ---------------------------------------------------------


def settle(docs: DataFrame, classes: DataFrame, families: DataFrame, p: NearParameters) -> DataFrame:
    """(cls, component) of the classes that are linked on full shingle sets."""
    families = staged(families.select(F.col("node").alias("cls"), F.col("component").alias("family")))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    ids = classes.join(families, "cls", "left_semi").where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct()
    packed = arrow_map(docs, pack, "doc_id long, text binary")
    wanted = packed.join(ids, "doc_id", "left_semi").unionByName(packed.where("doc_id is null")).select("text")
    sets = arrow_map(wanted, _full_sets, "cls binary, tokens binary, shingles binary", p=p).dropDuplicates(["cls"])
    members = staged(sets.join(families, "cls").join(sizes, "family"))
    small = members.where(F.col("size") <= p.small).withColumn("part", F.xxhash64("family"))
    large = members.where(F.col("size") > p.small)
    edges = _verified(small, p)
    if large.isEmpty():
        return _labels(connected_components(edges))
    for round_ in range(p.settle_rounds):
        edges = edges.unionByName(_verified(_random_blocks(large, "family", round_, p.small), p))
    components = connected_components(edges)
    rows = large.select(F.col("family").alias("node"), "cls")
    pairs = _block_pairs(_without_settled(rows, components), "node", p.small)
    rest = _verified(pairs.join(members.select("cls", "tokens", "shingles"), "cls"), p)
    known = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return _labels(connected_components(known.unionByName(rest)))


def _labels(components: DataFrame) -> DataFrame:
    return components.withColumnRenamed("node", "cls")


def _verified(rows: DataFrame, p: NearParameters) -> DataFrame:
    if "asks" not in rows.columns:
        rows = rows.withColumn("asks", F.lit(True))
    return arrow_map(by_key(rows.select("part", "cls", "asks", "tokens", "shingles"), "part"), _exact_links, "a binary, b binary", p=p)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|, for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _exact_links(batches: Iterator[pa.RecordBatch], p: NearParameters) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the true links within a part; pairs already joined are not compared again."""
    least = _least(p)
    for table, bounds in sorted_groups(batches, "part"):
        names, asks = table.column("cls").to_pylist(), table.column("asks").to_numpy()
        vectors = np.stack([np.frombuffer(x, np.int32) for x in table.column("tokens").to_pylist()])
        sets = table.column("shingles")
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = [np.frombuffer(sets[i].as_py(), np.uint64) for i in range(lo, hi)]
            forest = Forest(hi - lo)
            pairs = []
            for i in np.flatnonzero(asks[lo:hi]):
                agree = (vectors[lo:hi] == vectors[lo + i]).sum(axis=1)
                pairs += [(-int(agree[j]), int(i), int(j)) for j in np.flatnonzero(agree >= least) if j < i or not asks[lo + j]]
            for _, i, j in sorted(pairs):  # likely links first: most of the others are then joined already
                if forest.root(i) != forest.root(j) and similar(own[i], own[j], p.percent):
                    forest.join(i, j)
                    a.append(names[lo + i])
                    b.append(names[lo + j])
        yield batch_of(EDGES, a, b)
