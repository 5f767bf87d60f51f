import hashlib
import random

import numpy as np
import pytest

from glyphmill.llm import nn_descent, warc
from glyphmill.llm.components import connected_components
from glyphmill.llm.run_length_index import RunLengthIndex


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_matching_statistics_by_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(60):
        parts = [rng.integers(0, 3, rng.integers(0, 12)) for _ in range(rng.integers(1, 5))]
        parts = parts + parts[:2] if trial % 2 else parts
        text = np.array([x for i, p in enumerate(parts) for x in [*p.tolist(), 10 + i]], np.int64)
        want = []
        for i in range(len(text)):
            best = 0
            for j in range(len(text)):
                n = 0
                while i != j and i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
                    n += 1
                best = max(best, n)
            want.append(best)
        assert RunLengthIndex(text).matching_statistics().tolist() == want


def test_runs_follow_the_distinct_text():
    base = np.random.default_rng(1).integers(97, 120, 300)
    text = np.concatenate([np.append(base, 300 + k) for k in range(40)])
    assert len(RunLengthIndex(text).starts) < len(text) / 10


# ---------------------------------------------------------------- 1


def vectors(n, seed=0, dim=16):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return [(i, [float(v) for v in np.float32(x[i])], 0) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k):
    rows = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s)) if i != q][:k]
    return out


def test_nearest_neighbours(spark):
    rows = vectors(1500) + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] + [1.0] * 15, 0), (2080, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = exact(rows, 20)
    got = {}
    for r in nn_descent.nearest(df, lambda v: v % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    recall = np.mean([len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    scores = {q: dict(w) for q, w in exact(rows, 10**6).items()}
    for q, g in got.items():
        assert all(abs(scores[q][v] - s) < 1e-12 for v, s in g.values())
        assert [g[k][1] for k in range(1, 21)] == sorted((s for _, s in g.values()), reverse=True)


def test_equal_vectors_tie_to_smaller_ids_and_few_vectors_give_few(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(60)] + [(i, [2.0, 1.0], 0) for i in range(60, 64)]
    got = [(r.query_id, r["rank"], r.vec_id) for r in nn_descent.nearest(spark.createDataFrame(rows, SCHEMA), lambda v: v == 40).collect()]
    assert sorted(got) == [(40, k + 1, v) for k, v in enumerate(range(20))]
    got = nn_descent.nearest(spark.createDataFrame(rows[58:62], SCHEMA), lambda v: v == 60).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 61), (2, 58), (3, 59)]
    assert nn_descent.nearest(spark.createDataFrame([], SCHEMA), lambda v: v == 0).count() == 0
    assert nn_descent.nearest(spark.createDataFrame(rows[:1], SCHEMA), lambda v: v == 0).count() == 0


# ---------------------------------------------------------------- 4


@pytest.fixture
def pages(spark):
    big = "<p>" + "é" * 900 + "</p>"
    rows = [
        (1, "http://b.example.com/x?q=1#frag", big), (2, "https://a.example.com:8080/", big), (3, "http://b.example.com/x?q=1", big), (4, "nonsense url\twith tab", "small"), (5, None, None), (6, "http://b.example.com/x?q=1", "small"),
        (7, "http://user@Example.org", ""), (None, "http://b.example.com/nobody", big), (9, "http://b.example.com/nul", "a\r\n\r\nb"),
    ]
    return spark.createDataFrame(rows + [(100 + i, f"http://hot.example.com/{i % 7}", f"page {i}") for i in range(300)], "page_id long, url string, html string")


def test_archives_read_back(pages):
    got = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        payload = (r.html or "").encode()
        g = got[r.page_id]
        revisit = len(payload) >= 1000 and r.page_id != 3
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
        assert revisit or g.payload == payload
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_look_up_by_url(spark, pages):
    archives, index = (warc.shared_path(spark, n) for n in ("warc", "index"))
    directory = warc.write_index(warc.write_archives(pages, archives), index, lines=8)
    wanted = spark.createDataFrame([("http://hot.example.com/3", None), ("http://hot.example.com/4", 104), ("http://none.example.com/", None)], "url string, page_id long")
    got = warc.look_up(wanted, directory, archives, index).collect()
    assert sorted(r.page_id for r in got) == sorted([i for i in range(100, 400) if (i - 100) % 7 == 3] + [104])


def test_keys_reverse_hosts():
    assert warc.reversed_host_key("http://WWW.a.Example.com:80/P?q#f") == "com,example,a,www)/P?q"
    assert warc.reversed_host_key("https://a.b:8080") == "b,a:8080)/" and warc.reversed_host_key(None) == ""


def test_captures_that_share_an_id_and_a_key(spark):
    rows = [(1, "http://a.example.com/x", "one"), (1, "https://a.example.com/x#f", "two"), (2, None, "three"), (None, "http://a.example.com/x", "four"), (None, "https://a.example.com/x", "five")]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.payload.decode()) for r in got) == sorted((i or 0, u or "", h) for i, u, h in rows)


def test_sources_of_any_characters(spark):
    from glyphmill.llm import mixing

    rows = [(1, "a b", "x\x1fy"), (2, "a", "\x00"), (3, "a b c", None), (4, "a", ""), (5, "a", "~")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.source_size for r in got} == {1: 2, 2: 1, 3: 3, 4: 1, 5: 1}


def test_rows_that_share_an_id_meet_the_target(spark):
    from glyphmill.llm import mixing

    rows = [(None, f"word{i} a b c d", "a") for i in range(300)] + [(7, "one two three four five", "b")] * 300 + [(i, "x y z", "c") for i in range(1000)] + [(None, None, "a"), (7, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    taken, target, size = {}, {}, {}
    for r in got:
        key = r.source_size, r.target
        taken[key] = taken.get(key, 0) + r.taken
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert len(got) == len(rows) and len(taken) == 3
    assert all(abs(n - t) <= 3 for (_, t), n in taken.items())
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert words(mixing.take_mix(df).collect()) == sum(r.taken for r in got)


def test_extra_columns_don_t_clash(spark, pages, docs):
    from pyspark.sql import functions as F

    from glyphmill.llm import quality

    names = ("node", "other", "score", "rank", "q", "start", "f", "v", "near", "path", "digest", "key", "record_type", "payload", "size", "held_out", "predicted", "label", "features")
    more = {c: F.lit(c) for c in names}
    v = spark.createDataFrame(vectors(200), SCHEMA)
    plain = sorted(map(str, nn_descent.nearest(v, lambda i: i % 20 == 0).collect()))
    assert sorted(map(str, nn_descent.nearest(v.withColumns(more), lambda i: i % 20 == 0).collect())) == plain
    assert warc.archive_and_read(pages.withColumns(more)).count() == pages.count()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(18)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    a, b = quality.score(docs, model), quality.score(docs.withColumns(more), quality.train(docs.withColumns(more), labels.withColumns({"text": F.lit("x"), "fold": F.lit("x")})))
    assert sorted(map(str, b.collect())) == sorted(map(str, a.collect())) and a.count() == docs.count()
    assert quality.score(docs.limit(0), model).count() == 0


def test_repeated_pages(spark):
    rows = [(1, "http://a.example.com/x", "small"), (1, "http://a.example.com/x", "small"), (2, "http://a.example.com/x", "é" * 900), (2, "http://a.example.com/x", "é" * 900)]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and {r.record_type for r in got if r.page_id == 1} == {"response"}
