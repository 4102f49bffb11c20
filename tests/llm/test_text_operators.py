"""Each operator against a plain version of itself on small tables, and on awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from barloom.llm.byte_bpe import BpeParameters, Encoder, Utf8Stream, Vocabulary, decode_documents, encode_documents, read_ranks
from barloom.llm.decontamination import contaminated, without_contaminated
from barloom.llm.graph import connected_components
from barloom.llm.line_dedup import LineParameters, dedup_lines
from barloom.llm.main_text import extract_main_text
from barloom.llm.near_duplicates import NearParameters, keep_one_of_each, near_duplicates
from barloom.llm.quality import QualityParameters, filter_documents, quality
from barloom.llm.queries import byte_bpe_50k
from barloom.llm.repeats import RepeatParameters, remove_repeats
from barloom.llm.secret_scan import find_secrets, is_key, is_signed_token
from barloom.llm.suffix_array import permuted_common_prefixes, suffix_array
from barloom.llm.toxicity import CnnParameters, score_documents
from barloom.llm.warc import read_archives, round_trip, write_archives

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, family long, digest string, host string"
VOCABULARY = [f"{a}{b}" for a in "kat mor sil ven dor fal rin tos".split() for b in "a en is or um ith".split()]


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src", None if t is None else len(t), "x", 1, "y", None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) + str(draw.randrange(40)) for _ in range(n))


def edited(text, seed, changes):
    draw, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


AWKWARD = [None, "", "   \n\t ", "one", "one", prose(1, 40), prose(1, 40), prose(2, 30000), "é漢字🙂 \x00 # | <b>", prose(3, 12) + "\n" + prose(3, 12)]
AWKWARD_IDS = [0, 1, 2, 3, 3, 5, None, 7, 8, None]


@pytest.fixture
def awkward(spark):
    return documents(spark, AWKWARD, AWKWARD_IDS)


@pytest.fixture
def nothing(spark):
    return documents(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- secrets ------------------------------------------------------------------


def test_secret_spans(spark, awkward, nothing):
    number = b"\x02\x20" + b"\x11" * 32
    body = b"\x02\x01\x00" + number * 8
    der = b"\x30\x82" + len(body).to_bytes(2, "big") + body
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":1}', b"s" * 32))
    texts = [
        'é Token = "abc12345" and secret: short',
        "AKIA" + "A1" * 8 + " AKIAshort",
        "deadbeef" * 3 + " " + "0" * 23,
        f"key {base64.b64encode(der).decode()} end",
        f"bearer {jwt}",
        base64.b64encode(b"just some ordinary text that is long enough to be seen").decode(),
        der.hex(),
    ]
    got = by_id(find_secrets(documents(spark, texts)))
    assert got[0]["spans"] == "assign:2:19" and got[0]["n_assign"] == 1
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:2:19").hexdigest()
    assert got[1]["spans"] == "access:0:20"
    assert got[2]["spans"] == "hex:0:24"
    assert got[3]["spans"].startswith("key:4:") and got[3]["n_confirmed"] == 1
    assert got[4]["spans"].startswith("jwt:7:")
    assert got[5]["spans"] == ""
    assert got[6]["n_hex"] == 1 and got[6]["n_confirmed"] == 1
    assert is_key(der) and not is_key(der[:-1]) and not is_signed_token(jwt.replace(".", ".e30.", 1)[:20] + "..")
    assert find_secrets(awkward).count() == len(AWKWARD) and find_secrets(nothing).count() == 0


# --- main text ----------------------------------------------------------------


def test_main_text(spark):
    article = "<article><h1>Head &amp; tail</h1><p>" + prose(4, 30) + "<br>after</p><aside>" + prose(5, 9) + "</aside><p>" + prose(6, 25) + "</p></article>"
    page = (
        "<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body class='has-sidebar'><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<div class='cookie-notice'>{prose(7, 20)}</div>{article}<section id='comments'><p>{prose(8, 30)}</p></section><footer>&copy; x</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", page[: page.index("</article>") - 4]), (4, "u", "<p>" + prose(9, 40)), (None, "u", "<<>< &")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract_main_text(pages).collect()
    want = "\n\n".join(["Head & tail", prose(4, 30) + " after", prose(6, 25)])
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and texts[1] == want and texts[2] == "" and texts[3] == ""
    assert [r["text"] for r in got if r["page_id"] == 4][1] == prose(9, 40)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_main_text(pages.limit(0)).count() == 0


# --- quality ------------------------------------------------------------------


def test_quality(spark, awkward, nothing):
    common = "This line stands on every page of the host"
    texts = [f"{common}\n{prose(20 + i, 15)}" for i in range(6)] + [common + " today\n" + common] + [" ".join(["a b c d e f"] * 4)]
    docs = documents(spark, texts)
    p = QualityParameters(min_documents=3, max_share=0.5)
    got = by_id(quality(docs, p))
    assert all(got[i]["kept"] and got[i]["n_cut_words"] == 9 for i in range(6))
    assert got[6]["n_cut_words"] == 9 and got[6]["base_failed"] and not got[6]["kept"]
    assert got[7]["base_failed"] and got[7]["n_repeat_words"] == 24
    left = {r["doc_id"]: r["text"] for r in filter_documents(docs, p).collect()}
    assert left == {i: prose(20 + i, 15) for i in range(6)}
    copies = documents(spark, [texts[0]] * 6)
    assert all(r["n_cut_words"] == 0 for r in quality(copies, p).collect())
    depleted = documents(spark, texts[:6] + [common + "\nfew words"])
    assert not by_id(quality(depleted, p))[6]["kept"]
    assert quality(awkward).count() == len(AWKWARD) and quality(nothing).count() == 0
    assert filter_documents(awkward).columns == awkward.columns and filter_documents(nothing).count() == 0


# --- lines --------------------------------------------------------------------


def plain_lines(texts):
    seen, out = [], []
    for text in texts:
        gone = 0
        for line in (text or "").split("\n"):
            words = set(line.lower().split())
            if words:
                gone += any(100 * len(words & s) >= 80 * len(words | s) for s in seen)
                seen.append(words)
        out.append(gone)
    return out


@pytest.mark.parametrize("small", [4, 256])
def test_line_dedup(spark, small):
    stem = prose(30, 20)
    texts = [prose(31, 5) + "\n" + edited(stem, i, i % 4) + "\n\n" + prose(40 + i % 5, 1 + i % 6) for i in range(30)]
    got = by_id(dedup_lines(documents(spark, texts), LineParameters(small=small)))
    assert [got[i]["n_removed"] for i in range(30)] == plain_lines(texts)
    assert got[0]["text"] == texts[0]


def test_line_dedup_awkward(spark, awkward, nothing):
    got = dedup_lines(awkward)
    assert got.columns == [*awkward.columns, "n_lines", "n_removed"] and got.count() == len(AWKWARD)
    rows = got.collect()
    assert [r["text"] for r in rows if r["doc_id"] == 0] == [None]
    assert [r["text"] for r in rows if r["doc_id"] == 3] == ["one", "one"]  # one document, twice
    assert sorted(r["n_removed"] for r in rows if r["doc_id"] is None) == [1, 1]
    assert dedup_lines(nothing).count() == 0


# --- near duplicates ----------------------------------------------------------


def plain_components(texts, k):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("small", [8, 256])
def test_near_duplicates(spark, small):
    stem, other = prose(50, 150), prose(51, 80)
    texts = [edited(stem, i, i % 6) for i in range(60)] + [edited(other, i, i % 3) for i in range(12)] + [stem, stem, None, "", "a b", "A  b", "a b c"]
    texts += [prose(60 + i, 30) for i in range(20)]
    got = by_id(near_duplicates(documents(spark, texts), NearParameters(words=4, small=small)))
    want = plain_components(texts, 4)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    assert got[0]["n_shingles"] == 147


def test_near_duplicates_awkward(spark, awkward, nothing):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    nameless = [r for r in rows if r["doc_id"] is None]
    assert {(r["component_id"], r["kept"]) for r in nameless} == {(5, False), (None, True)}
    kept = keep_one_of_each(awkward)
    assert kept.columns == awkward.columns and {0, 1, 2, 3, 5, 7, 8} <= {r["doc_id"] for r in kept.collect()}
    assert near_duplicates(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- archives -----------------------------------------------------------------


def test_archives(spark, tmp_path):
    long = "é" * 100_000
    rows = [(1, "u", "x" * 200), (2, "u v", "x" * 200), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", long), (None, "u", "x" * 200), (2, "u", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in round_trip(pages).collect()), key=repr)
    want = [(1, 200, "response", None), (2, 200, "revisit", 1), (2, 200, "revisit", 1), (3, 0, "response", None)]
    want += [(4, 5, "response", None), (5, 5, "response", None), (6, 200_000, "response", None), (None, 200, "revisit", 1)]
    assert got == want
    chunks = read_archives(write_archives(pages.where("page_id = 6"), f"file://{tmp_path}/w")).orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in chunks] == list(range(len(chunks))) and len(chunks) > 1
    assert b"".join(r["data"] for r in chunks).decode() == long
    assert chunks[-1]["digest"] == hashlib.sha256(long.encode()).hexdigest() == chunks[0]["declared"]
    assert round_trip(pages.limit(0)).count() == 0


# --- repeats ------------------------------------------------------------------


def test_suffix_array():
    draw = random.Random(5)
    for _ in range(200):
        t = [draw.randint(1, draw.choice([2, 3, 9])) for _ in range(draw.randint(1, 50))] + [0]
        s = np.array(t)
        for k in (10, 5000):  # by bucket, and one by one
            sa = suffix_array(s, k)
            assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = permuted_common_prefixes(s.astype(np.uint8), sa, np.array([0]), 200)
        for a, b in zip(sa[:-1], sa[1:]):
            n = next(i for i in range(len(t)) if t[a + i : a + i + 1] != t[b + i : b + i + 1])
            assert shared[b] == n


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = {}
    for d in data:
        for i in range(len(d) - length + 1):
            counts[d[i : i + length]] = counts.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall("1+", "".join("01"[g] for g in gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2, 1000])
def test_repeats(spark, group):
    passage = prose(70, 60)
    texts = [prose(71, 20) + passage + prose(72 + i, 10 + i) for i in range(6)]
    texts += [passage[3:230] + "é", "a" * 450, "ab" * 150, None, "", "x" * 199, "x" * 199, prose(90, 50), prose(90, 50), passage + passage]
    got = by_id(remove_repeats(documents(spark, texts), RepeatParameters(group=group)))
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == plain_repeats(texts, 200)


def test_repeats_awkward(awkward, nothing):
    assert remove_repeats(awkward).count() == len(AWKWARD) and remove_repeats(nothing).count() == 0


# --- decontamination ----------------------------------------------------------


def test_containment(spark, awkward, nothing):
    items = [prose(100 + i, 12 + 7 * i) for i in range(5)] + [None, "too short"]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)] + [(None, items[0], 0)], "item_id long, text string, doc_id int")
    texts = [prose(110, 400) + " " + items[0].upper() + "! " + prose(111, 300), edited(items[4], 1, 1), edited(items[1], 2, 4), None, "", items[2] + " " + items[3]]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(documents(spark, texts), benchmark).collect()}

    def sets(t):
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(d, i) for d, t in enumerate(texts) for i, s in enumerate(items) if sets(s) and 100 * len(sets(t) & sets(s)) >= 80 * len(sets(s))}
    assert got == want and (0, 0) in got and (5, 2) in got and (5, 3) in got
    clean = without_contaminated(documents(spark, [*texts, items[0], "clean text"], [0, 1, 2, 3, 4, 5, None, None]), benchmark)
    assert sorted(str(r["text"])[:10] for r in clean.where("doc_id is null").collect()) == ["clean text"]
    assert contaminated(nothing, benchmark).count() == 0 and contaminated(awkward, benchmark.limit(0)).count() == 0
    assert without_contaminated(awkward, benchmark).columns == awkward.columns


# --- toxicity -----------------------------------------------------------------


def test_toxicity(spark, awkward, nothing):
    draw = random.Random(8)
    texts, toxic = [], []
    for i in range(3000):
        words = prose(200 + i, draw.randint(5, 40)).split(" ")
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            words.insert(draw.randrange(len(words)), draw.choice(["vilest", "nasty"]))
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int")
    rows = score_documents(documents(spark, texts), labels, CnnParameters(bits=14, epochs=10)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in held)
    assert len(held) > 50 and right >= 0.9 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    flipped = labels.withColumn("toxic", labels["toxic"])
    assert score_documents(awkward, flipped, CnnParameters(bits=10, epochs=1)).count() == len(AWKWARD)
    assert {r["score"] for r in score_documents(awkward, labels.limit(0)).collect()} == {0.5}
    assert score_documents(nothing, labels, CnnParameters(bits=10, epochs=1)).count() == 0


# --- byte-level BPE -----------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = read_ranks(byte_bpe_50k().ranks)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder(reference):
    ranks, known = reference
    vocabulary = Vocabulary(ranks)
    draw = random.Random(9)
    texts = ["".join(draw.choice("aaab bcdeéthin ge\n  \t漢字🙂$$##01'st") for _ in range(draw.randint(0, 50))) for _ in range(2000)]
    texts += ["a" * 300, " lots   of \n\n space ", "<|endoftext|>", "don't we'll", "\x1c \x85 　x", prose(10, 300)]
    for spaced, states, pieces in ((True, 250_000, 500_000), (False, 40, 50)):
        encoder = Encoder(vocabulary, BpeParameters("", public_tokenizers.PATTERN, spaced, states, pieces))
        for text in texts:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == known.encode_ordinary(text), text


def test_incremental_decoder():
    data = "aé漢🙂".encode() * 3
    for step in (1, 2, 3, 5):
        stream = Utf8Stream()
        parts = [stream.feed(data[i : i + step]) for i in range(0, len(data), step)]
        assert "".join(parts) + stream.feed(b"", final=True) == data.decode()
    stream = Utf8Stream()
    assert stream.feed(b"x\xe6\xbc") + stream.feed(b"", final=True) == b"x\xe6\xbc".decode("utf-8", "replace")


def test_encoded_documents(spark, reference, awkward, nothing):
    p = byte_bpe_50k()
    encoded = encode_documents(awkward, p, with_ids=True)
    rows = encoded.collect()
    want = {}
    for text in AWKWARD:
        ids = np.array(reference[1].encode_ordinary(text or ""), "<u4").tobytes()
        want[hashlib.sha256(ids).hexdigest()] = (len(ids) // 4, hashlib.sha256((text or "").encode()).hexdigest())
    assert {r["ids_sha256"]: (r["n_tokens"], r["decoded_sha256"]) for r in rows} == want and len(rows) == len(AWKWARD)
    assert sorted(r["text"] for r in decode_documents(encoded, p).collect()) == sorted(t or "" for t in AWKWARD)
    assert encode_documents(nothing, p).count() == 0
