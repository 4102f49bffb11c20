"""SentencePiece against its library, fill-in-middle and centroid clustering against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark import SparkFiles

from barloom.llm import centroids as clustering
from barloom.llm.centroids import ClusterParameters, Move, cluster_vectors
from barloom.llm.fill_in_middle import CODE_POINTS, WORDS, BlockTrees, FimParameters, fill_in_middle, restored, unit_starts
from barloom.llm.queries import op12_fill_in_middle, op13_centroids
from barloom.llm.sentence_pieces import PieceCodec, PieceModel, PieceParameters, decode_pieces, encode_pieces
from pyspark.sql import functions as F
from test_text_operators import awkward, by_id, documents, nothing, prose  # noqa: F401

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = "text string, doc_id long, n_tokens string, ids string, form string, output int, n long, vec_id int, cluster string"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# --- SentencePiece ----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec(spark):
    with open(MODEL, "rb") as file:
        return PieceCodec(PieceModel(file.read()), 50_000)


def ids_of(codec, texts):
    out = [[] for _ in texts]
    for number, found in codec.encode(texts):
        out[number] += np.frombuffer(b"".join([ids for ids, _ in found]), "<u4").tolist()
    return out


def test_ids_are_those_of_the_library(codec, library):
    draw = random.Random(3)
    texts = ["", " ", "  ", " a ", "▁x▁▁y", "a\x00b\n\n\tc", "日本語ሀ🙂é ﬁ�", "</s><s><unk><0x0A>", prose(9, 3000)]
    texts += [" " * n + "w" * (n % 3) + "\n" * (n % 2) for n in range(70)] + ["a" * n for n in range(80)]
    texts += ["".join(draw.choices("abehinorst  ▁\n.é日🙂", k=draw.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(draw.choices(codec.model.pieces[259:4000] + [" "], k=draw.randrange(1, 40))) for _ in range(1000)]
    assert ids_of(codec, texts) == library.encode(texts)


def test_merges_of_one_rank_and_merges_that_make_better_pairs():
    """Vocabularies in which a merge makes a pair as good as itself or better, against one merge at a time."""
    draw = random.Random(4)
    for seed in range(60):
        pieces = ["<unk>"] + list("abc") + sorted({"".join(draw.choices("abc", k=draw.randrange(2, 6))) for _ in range(25)})
        scores = [0.0] + [-100.0] * 3 + [-float(draw.randrange(1, 12)) for _ in pieces[4:]]
        model = object.__new__(PieceModel)
        model.pieces = pieces
        model._merges(np.array(scores, np.float32), list(range(1, len(pieces))))
        ids = {p: i for i, p in enumerate(pieces)}
        words = ["".join(draw.choices("abc", k=draw.randrange(1, 30))) for _ in range(40)]
        got, bounds = model.segment(words)
        for word, a, b in zip(words, bounds, bounds[1:]):
            symbols = list(word)
            while True:
                pairs = [(-scores[ids[x + y]], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in ids]
                if not pairs:
                    break
                at = min(pairs)[1]
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            assert [pieces[i] for i in got[a:b]] == symbols


def test_hostile_long_words_are_not_slow(codec, library):
    draw = random.Random(5)
    words = [" " * 300_000, "a" * 300_000, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), prose(8, 30_000).replace(" ", "")]
    assert ids_of(codec, words) == library.encode(words)


def test_long_texts_are_taken_by_parts(codec, library, monkeypatch):
    monkeypatch.setattr("barloom.llm.sentence_pieces.PART_CHARS", 50)
    texts = [prose(6, 400) + "  two  spaces\n\n" + prose(7, 50), " ▁ " * 200, "x" * 500]
    assert ids_of(codec, texts) == library.encode(texts)


def test_any_ids_decode_as_in_the_library(codec, library):
    draw = random.Random(6)
    for _ in range(300):
        ids = draw.choices(range(300), k=20) + draw.choices(range(32000), k=20)
        assert codec.decoder().feed(np.array(ids, "<u4").tobytes(), final=True) == library.decode(ids)


def test_pieces_of_documents(spark, awkward, nothing, library):  # noqa: F811
    parameters = PieceParameters(MODEL, max_words=100)
    encoded = encode_pieces(awkward, parameters, with_ids=True)
    rows = sorted(encoded.collect(), key=lambda r: (r["ids_sha256"], r["doc_id"] or -1))
    want = []
    for r in awkward.collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), np.array(ids, "<u4").tobytes()))
    assert [tuple(r) for r in rows] == sorted(want, key=lambda r: (r[2], r[0] or -1))
    back = {(r["doc_id"], r["text"]) for r in decode_pieces(encoded, parameters).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in awkward.collect()}
    assert encode_pieces(nothing, parameters).count() == 0 and decode_pieces(encode_pieces(nothing, parameters, True), parameters).count() == 0
    clash = spark.createDataFrame([("one two", 1) + (None,) * 7], CLASHING)
    assert encode_pieces(clash, parameters).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert encode_pieces(clash, parameters).first()["n_tokens"] == len(library.encode("one two"))
    assert SparkFiles.get("piece_bpe_32k.model")


def test_other_models_are_refused():
    with open(MODEL, "rb") as file:
        data = file.read()
    with pytest.raises(ValueError):
        PieceModel(data.replace(b"identity\x12\x00\x18\x01\x20\x00", b"identity\x12\x00\x18\x01\x20\x01"))  # drops white space


# --- fill-in-middle ---------------------------------------------------------------


def fim_plain(doc_id, text):
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_matches_a_plain_version(spark, awkward, nothing):  # noqa: F811
    draw = random.Random(7)
    texts = ["".join(draw.choices("aé漢🙂 <P>SM\n", k=draw.randrange(1, 40))) for _ in range(400)]
    texts += ["<<P>x", "a<S>", "<", "<S", ">M>", prose(4, 5000) + "漢🙂" * 3000]
    for docs in (documents(spark, texts), awkward):
        for block in (1, 7, 4096):
            got = fill_in_middle(docs, FimParameters(block_bytes=block)).withColumn("back", restored(F.col("form"), F.col("output")))
            rows = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got.collect()]
            want = [(r["doc_id"], *fim_plain(r["doc_id"], r["text"] or ""), r["text"] or "") for r in docs.collect()]
            assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in fill_in_middle(documents(spark, texts)).collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle(nothing).count() == 0
    clash = spark.createDataFrame([("one two", 1) + (None,) * 7], CLASHING)
    assert fill_in_middle(clash).first()["output"] == fim_plain(1, "one two")[-1]


def test_cuts_between_words(spark):
    text = "  " + prose(5, 300).replace(" ", " \n")
    starts = np.flatnonzero(unit_starts(text.encode(), 0, len(text.encode()), WORDS)).tolist()
    assert len(starts) == 301 and starts[:2] == [0, 2]
    for r in fill_in_middle(documents(spark, [text] * 50), FimParameters(unit=WORDS, block_bytes=64, rate=100)).collect():
        assert r["n"] == 301 and r["prefix_chars"] in [*starts, len(text)] and r["prefix_chars"] + r["middle_chars"] in [*starts, len(text)]
    with pytest.raises(ValueError):
        fill_in_middle(documents(spark, [text]), FimParameters(unit="bytes"))


def test_trees_hold_the_sums_of_their_blocks():
    draw = random.Random(8)
    texts = ["".join(draw.choices("aé漢🙂 ", k=n)).encode() for n in (0, 1, 50, 1000, 3333)]
    trees = BlockTrees(texts, CODE_POINTS, 16)
    assert trees.totals().tolist() == [len(t.decode()) for t in texts]
    for i, text in enumerate(texts):
        for k in range(0, len(text.decode()) + 1, 7):
            passed, rest, chars = (int(x[0]) for x in trees.descend(np.array([i]), np.array([k])))
            counted = [int(unit_starts(text, a, min(a + 16, len(text)), CODE_POINTS).sum()) for a in range(0, len(text), 16)]
            assert chars == sum(counted[:passed]) and rest == k - chars and (passed == len(counted) or rest < counted[passed])


# --- centroids --------------------------------------------------------------------


def lloyd(rows, p):
    kept = [(i, [int(np.floor(p.scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == p.dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"{p.seed}{r[0]}"), np.array(r[1], "<i4").tobytes()))
    centroids = np.array([v for _, v in order[: p.clusters]], np.int64)
    v = np.array([v for _, v in kept], np.int64)
    for i in range(p.rounds + 1):
        squares = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
        own = squares.argmin(axis=1)
        if i < p.rounds:
            for c in range(len(centroids)):
                if (own == c).any():
                    centroids[c] = v[own == c].sum(axis=0) // (own == c).sum()
    distance = squares[np.arange(len(v)), own]
    digest = [sha(",".join(map(str, c.tolist()))) for c in centroids]
    sums = np.bincount(own, distance, len(centroids)).astype(int)
    return [(i, int(c), int(d), int(sums[c]), int(distance.sum()), digest[c]) for (i, _), c, d in zip(kept, own, distance)]


def vectors(spark, rows, extra=""):
    return spark.createDataFrame([(*r, *["x"] * extra.count(",")) for r in rows], "vec_id long, embedding array<float>" + extra)


def planted(n, dimensions, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (12, dimensions))
    points = centres[draw.integers(0, 12, n)] + draw.normal(0, 0.25, (n, dimensions))
    return [(i, np.float32(x).tolist()) for i, x in enumerate(points)]


@pytest.mark.parametrize("rounds", [0, 3, 9])
def test_clusters_match_a_plain_version(spark, rounds, monkeypatch):
    monkeypatch.setattr(clustering, "ROWS", 100)
    p = ClusterParameters(rounds=rounds)
    rows = planted(1500, 64, rounds)
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1]), (1600, None), (1601, []), (1602, [1.0] * 63), (1603, [float("nan")] + [1.0] * 63)]
    rows += [(1604, [float("inf")] + [0.0] * 63), (1605, [None] + [1.0] * 63), (1606, [0.0] * 64), (1606, [-0.0] * 64)]
    got = cluster_vectors(vectors(spark, rows, ", cluster string, v string, distance string"), p)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, lloyd(rows, p)))


def test_ties_few_vectors_and_empty_tables(spark):
    p = ClusterParameters(dimensions=2, clusters=4)
    square = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0.5), (0.5, 0.5)] * 3)]
    for rows in (square, square[:3], [(i % 2, [1.0, 1.0]) for i in range(9)], [(None, [1.0, 2.0])] * 6):
        assert sorted(map(repr, map(tuple, cluster_vectors(vectors(spark, rows), p).collect()))) == sorted(map(repr, lloyd(rows, p)))
    for rows in ([], [(1, None)], [(1, [1.0])]):
        empty = cluster_vectors(vectors(spark, rows), p)
        assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="after scaling"):
        cluster_vectors(vectors(spark, [(1, [1e30, 0.0])]), p).count()


def test_bounds_hold_and_loosen_less_than_the_drift():
    draw = np.random.default_rng(1)
    less = 0
    for _ in range(200):
        before, after = (draw.integers(-500, 500, (5, 8)) for _ in range(2))
        after = before + (after - before) // 8
        radius = draw.uniform(0, 400, 5)
        move = Move(before, after, radius)
        for i in range(5):
            direction = draw.normal(size=(300, 8))
            points = before[i] + direction / np.linalg.norm(direction, axis=1)[:, None] * radius[i] * draw.uniform(0, 1, 300)[:, None]
            nearer = [np.linalg.norm(points - before[j], axis=1) - np.linalg.norm(points - after[j], axis=1) for j in range(5) if j != i]
            assert np.max(nearer) <= move.loosening[i] + 1e-9
            less += move.loosening[i] < 0.9 * max(move.drift[j] for j in range(5) if j != i)
    assert less > 200


def test_most_vectors_need_no_full_scan(spark, monkeypatch):
    """In one process, so that comparisons with all centroids can be counted."""
    rows = planted(3000, 64, 2)
    p, scanned = ClusterParameters(), []
    v = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64)
    centroids = v[:16]
    full = clustering.nearest
    monkeypatch.setattr(clustering, "nearest", lambda x, c: (scanned.append(len(x)), full(x, c))[1])
    import pyarrow as pa

    state = pa.record_batch(
        {"vec_id": pa.array(range(3000)), "v": pa.array([x.astype("<i4").tobytes() for x in v]), "cluster": pa.nulls(3000, pa.int32()), "upper": pa.nulls(3000, pa.float64()), "lower": pa.nulls(3000, pa.float64())}
    )
    before, radius = centroids, np.zeros(16)
    for i in range(8):
        scanned.append(0)
        (state,) = [pa.Table.from_batches(clustering._assign(iter([state]), Move(before, centroids, radius), False)).combine_chunks().to_batches()[0]]
        own = state.column("cluster").to_numpy()
        assert (own == ((v[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        before = centroids
        centroids = np.array([v[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else centroids[c] for c in range(16)])
        radius = np.array([state.column("upper").to_numpy()[own == c].max(initial=0) for c in range(16)])
    assert sum(scanned) < 0.5 * 8 * 3000


def test_queries_run_over_whole_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert op12_fill_in_middle(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert op13_centroids(spark, sf_dir).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
