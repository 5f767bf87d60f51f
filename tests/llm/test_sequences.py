"""Operators 11 to 13 against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import centroid_clustering, merge_encoding, periodic_runs
from glyphmill.llm import queries as llm_queries
from glyphmill.llm.common import Words

MODEL = public_tokenizers.path("piece_bpe_32k.model")

# ---------------------------------------------------------------- 11


def slow_runs(w, least=6, power=4):
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fast_runs(rows):
    words = Words(pa.array([" ".join(r) for r in rows]), lower=False)
    a, n, q = periodic_runs.runs_of(words)
    row = np.searchsorted(words.first, a, "right") - 1
    out = [[] for _ in rows]
    for r, x, y, z in zip(row, a - words.first[row], n, q, strict=True):
        out[r].append((int(x), int(y), int(z)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=40), max_size=5), st.integers(0, 2**32))
def test_runs_equal_brute_force(rows, seed):
    r = random.Random(seed)
    for _ in range(2):  # periodic stretches, broken here and there
        base = [r.choice("abc") for _ in range(r.randint(1, 7))]
        row = [r.choice("xyz") for _ in range(r.randint(0, 9))] + base * r.randint(3, 9) + base[: r.randint(0, len(base))] + [r.choice("abc") for _ in range(r.randint(0, 9))]
        if r.random() < 0.3:
            row[r.randrange(len(row))] = "q"
        rows = [*rows, row * r.randint(1, 4)]
    assert fast_runs(rows) == [slow_runs(x) for x in rows]


def test_one_word_a_thousand_times_and_words_of_thue_and_morse():
    morse = [str(bin(i).count("1") % 2) for i in range(2048)]
    rows = [["a"] * 1000, morse * 5, ["a", "A"] * 3, ["é"] * 6 + ["e"]]
    assert fast_runs(rows) == [slow_runs(x) for x in rows]
    assert fast_runs(rows[:2]) == [[(0, 1000, 1)], [(0, 10240, 2048)]]


def test_least_overlap():
    assert periodic_runs.least_overlap() == 5 and periodic_runs.least_overlap(3, 2) == 2


def test_runs_query_by_brute_force(spark, docs, tmp_path, clashing, empty):
    extra = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(i % 120)), "en", "s", 0) for i in range(40, 240)], docs.schema)
    both = docs.unionByName(extra)
    both.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, llm_queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    want = []
    for r in both.collect():
        w = words_of(r.text)
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = slow_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{x},{y},{z}\n" for x, y, z in runs)), digest(collapsed(w, runs))))
    from pyspark.sql import Row

    row = Row("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == sorted(str(row(*w)) for w in want) and sum(w[1] > 0 for w in want) > 5
    plain = periodic_runs.collapse_runs(docs)
    assert sorted(map(str, plain.collect())) == sorted(map(str, periodic_runs.collapse_runs(clashing).collect()))
    assert {r.collapsed for r in plain.where("doc_id = 14").collect()} == {" ".join(words_of(next(x.text for x in docs.collect() if x.doc_id == 14)))}
    assert periodic_runs.collapse_runs(empty).count() == 0


def test_a_text_longer_than_a_slice(spark):
    text = " ".join(["lead", *(["one", "two", "three"] * 200_000), "end"])
    got = periodic_runs.collapse_runs(spark.createDataFrame([(1, text), (2, "a"), (3, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.collapsed) for r in got} == {(1, 600_002, "lead one two three end"), (2, 1, "a"), (3, 0, "")}
    assert [tuple(x) for r in got for x in r.runs] == [(1, 600_000, 3)]


# ---------------------------------------------------------------- 12


@pytest.fixture(scope="module")
def encoder():
    return merge_encoding.MergeEncoder(MODEL)


def ids_of(encoder, texts):
    ids, size = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


TEXTS = ["", " ", "  a  b ", "hello world", "Hello,\nworld\t!", "  \n \n", "日本語のテキスト、𝕏 😀😀", "▁▁a▁", "<s></s><unk><0x41>", "x" * 5000, "ab" * 3000 + " " * 40, "\x00\x7f​", "é" * 100, "aaaa aaaaa aaaaaa"]


def test_ids_equal_the_library(encoder, rows):
    texts = TEXTS + [r[1] or "" for r in rows]
    assert ids_of(encoder, texts) == encoder.processor.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdeinorst ▁.,\n日é😀"))) | st.text(st.characters(exclude_categories=["Cs"])), max_size=6))
def test_any_texts_encode_as_the_library_does(texts):
    assert ids_of(merge_encoding.encoder(MODEL), texts) == merge_encoding.encoder(MODEL).processor.encode(texts) if texts else True


def test_heap_and_matrix_agree(encoder):
    v = encoder.vocabulary
    r = random.Random(5)
    words = ["".join(r.choice("theandsionr") for _ in range(r.randint(2, 30))) for _ in range(400)]
    for w in words:
        s = [v.symbol[c] for c in w]
        (_, got), *_ = v.merge_rows(np.array([s], np.int32))
        assert got[0].tolist() == v.merge_long(list(s))


def test_forgotten_words_are_learned_again(monkeypatch):
    enc = merge_encoding.MergeEncoder(MODEL)
    monkeypatch.setattr(merge_encoding, "WORDS", 40)
    r = random.Random(1)
    for k in range(60):
        texts = [" ".join(f"common{r.randint(0, 9)} rare{k}x{r.randint(0, 99)}" for _ in range(8)), "no words are lost"]
        assert ids_of(enc, texts) == enc.processor.encode(texts)
        assert len(enc.known) < 70


def test_a_wrong_id_is_an_error():
    enc = merge_encoding.MergeEncoder(MODEL)
    enc.vocabulary.rank[:-1] = 32_000 - enc.vocabulary.rank[:-1]
    with pytest.raises(ValueError, match="otherwise"):
        enc.encode(["some considerably longer words that are merged in the wrong order"])


def test_piece_query(spark, docs, clashing, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sp = merge_encoding.encoder(MODEL).processor
    want = []
    for r in docs.collect():
        ids = [*sp.encode(r.text or ""), sp.eos_id()]
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in llm_queries.op12_piece_encoding(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    out = merge_encoding.encode_pieces(clashing, MODEL)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == docs.count()
    assert merge_encoding.encode_pieces(empty, MODEL).count() == 0


def test_a_text_over_several_slices_encodes_whole(spark):
    text = "some words and more words " * 100_000
    got = merge_encoding.encode_pieces(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), MODEL).collect()
    assert {r.doc_id: r.decoded for r in got} == {1: text, 2: ""}
    assert next(r.ids for r in got if r.doc_id == 1) == [*merge_encoding.encoder(MODEL).processor.encode(text), 2]


# ---------------------------------------------------------------- 13


def slow_clusters(rows, k=16, rounds=3):
    kept = []
    for i, x in rows:
        if x is None or len(x) != 64 or any(e is None or not np.isfinite(e) for e in x):
            continue
        kept.append((i, [int(np.floor(64 * float(e))) for e in x]))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        cents = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), t in zip(kept, to, strict=True) if t == j]) else c for j, c in enumerate(cents)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    each = {j: sum(d for _, c, d in got if c == j) for _, j, _ in got}
    return sorted(((i, c, d, each[c], sum(each.values()), [str(e) for e in cents[c]]) for i, c, d in got), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def made(n, seed, spread=0.2):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(5, 64))
    return [(i, [float(e) for e in np.float32(mid[i % 5] * (i % 3) + r.normal(size=64) * spread)]) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        made(300, 1),
        [(i, [float(i % 3)] * 64) for i in range(60)] + [(7, [0.5] * 64), (None, [0.25] * 64), (None, [-0.26] * 64)],  # ties, empty clusters, repeated ids
        [*made(40, 2), (100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, []), (104, [float("nan")] + [1.0] * 63), (105, [float("inf")] * 64), (106, [None] + [1.0] * 63)],
        made(5, 3),
        [*made(20, 4), (90, [1e9] * 64), (91, [-3e7] * 64)],
    ],
)
def test_clusters_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS).repartition(3).withColumnsRenamed({"label": "cluster"})
    want = slow_clusters(rows)
    got = sorted((tuple(r) for r in centroid_clustering.cluster_vectors(df).collect()), key=str)
    assert got == [(*w[:2], *(min(x, 2**63 - 1) for x in w[2:5]), w[5]) for w in want]


def test_no_vectors_no_clusters(spark):
    assert centroid_clustering.cluster_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroid_clustering.cluster_vectors(spark.createDataFrame([(1, None, 0)], VECTORS)).count() == 0


def test_bounds_screen_centroids_and_never_the_nearest():
    r = np.random.default_rng(6)
    mid = r.integers(-400, 400, size=(16, 64))
    v = mid[r.integers(0, 16, 3000)] + r.integers(-9, 9, size=(3000, 64))
    cluster, best, taken = centroid_clustering.nearest_centroid(v, centroid_clustering.compressed(v).astype(np.float32).astype(float), mid, centroid_clustering.compressed(mid))
    d = ((v[:, None] - mid[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert taken < 1.1 * len(v)
