import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import common, compact_windows, decontaminate, jaccard_join, mixing, ppm, quality, rans, repeat_removal, token_output
from glyphmill.llm.queries import tokenizer_path

from .conftest import passage


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def key(row):
    return tuple((v is None, v) for v in row)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def shingles(text, width=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if x]
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else []


# ---------------------------------------------------------------- kernels


def test_words_follow_the_pattern_and_stay_in_their_row():
    texts = ["Ab  cD\x0bé", None, "", " x", "y", "z q"]
    w = common.Words(pa.array(texts))
    want = [[x for x in re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))] for t in texts]
    assert w.strings(np.arange(len(w))).to_pylist() == [x for r in want for x in r]
    assert w.counts().tolist() == [len(r) for r in want]
    a = common.Words(pa.array(["a1 É-b", "b", "b"]), common.ALNUM_WORDS)
    assert a.strings(np.arange(len(a))).to_pylist() == ["a1", "É", "b", "b", "b"] and a.hash[2] == a.hash[3] == a.hash[4]


def test_minimizers_are_the_leftmost_minima_of_all_windows():
    rng = np.random.default_rng(3)
    for n, w in ((1, 1), (5, 9), (50, 7), (300, 16), (64, 64)):
        v = mixv = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(40)
        want = sorted({s + int(np.argmin(v[s : s + w])) for s in range(n - w + 1)})
        assert common.minimizers(mixv, w).tolist() == want


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, wide = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        h = rng.integers(0, 40, n).astype(np.uint64) << np.uint64(40)
        cut = int(rng.integers(0, n + 1))
        first = np.array([0, cut, n])
        want = []
        for a, b in ((0, cut), (cut, n)):
            for c in range(a, b):
                lo, hi = c, c
                while lo > a and h[lo - 1] > h[c]:
                    lo -= 1
                while hi + 1 < b and h[hi + 1] >= h[c]:
                    hi += 1
                if hi - lo + 1 >= wide:
                    want.append((lo, c, hi))
        got = compact_windows.compact_windows(h, first, wide)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


# ---------------------------------------------------------------- 2


def test_jaccard_join_finds_all_links(docs, rows):
    n = len(rows)
    sets = [set(shingles(r[1])) for r in rows]
    links, parent = [0] * n, list(range(n))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(n):
        group[find(i)].append(rows[i][0])
    want = sorted(((rows[i][0], min((x for x in group[find(i)] if x is not None), default=None), links[i]) for i in range(n)), key=key)
    got = jaccard_join.jaccard_join(docs, limit=2, depth=3).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=key) == want


def test_near_duplicates_of_a_large_group(spark):
    base = passage(77, 150).split()
    texts = [" ".join(base[:k] + [f"v{k}"] + base[k + 1 :]) for k in range(120)] + [passage(5000 + k, 60) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(df, limit=8, depth=2).collect()}
    sets = [set(shingles(t)) for t in texts]
    for i in range(160):
        want = sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in enumerate(sets) if j != i)
        assert got[i].n_links == want and got[i].class_id == (0 if i < 120 else i)


def test_one_of_each_class_stays_whatever_its_ids(spark):
    near = lambda seed, at: edited(seed, [(at, "x")]) + " " + passage(seed + 1, 100)
    rows = [(1, passage(8000, 60)), (2, near(8100, 4)), (2, passage(8200, 70)), (2, passage(8000, 60)), (3, near(8300, 4)), (3, near(8300, 40)), (4, near(8400, 4)), (4, near(8100, 9))]
    rows += [(None, near(8500, 4)), (None, near(8500, 30)), (None, near(8400, 30)), (None, passage(8600, 60)), (None, passage(8600, 60)), (5, ""), (5, ""), (None, " "), (None, " "), (6, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long")
    sets, label = [set(shingles(t)) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    links = [sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in enumerate(sets) if i != j) if sets[i] else 0 for i in range(len(rows))]
    assert sorted((r.n_links, r.doc_id or 0) for r in jaccard_join.jaccard_join(df).collect()) == sorted((k, r[0] or 0) for k, r in zip(links, rows, strict=True))
    got = jaccard_join.one_of_each(df).collect()
    some = [r for r in got if sets[r.n]]
    assert Counter(label[r.n] for r in some) == Counter({label[i] for i in range(len(rows)) if sets[i]})
    order = lambda d: (d is None, d or 0)
    assert all(order(r.doc_id) == min(order(rows[i][0]) for i in range(len(rows)) if label[i] == label[r.n]) for r in some)
    assert sorted((r.doc_id or 0, r.text or "") for r in got if not sets[r.n]) == [(0, " "), (0, " "), (5, ""), (6, "")]


def test_blocks_of_a_group_give_the_same_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 12, 10)).astype(np.uint64) for _ in range(30)]
    whole, _ = jaccard_join.exact_links(sets, np.zeros(30), np.ones(30, int), 0.6)
    block, total = np.arange(30) % 3, np.zeros(30)
    for a in range(3):
        for b in range(a, 3):
            i = np.flatnonzero((block == a) | (block == b))
            got, _ = jaccard_join.exact_links([sets[k] for k in i], block[i], np.ones(len(i), int), 0.6)
            total[i] += got
    assert total.tolist() == whole.tolist()


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.999, 0.8, 1) < jaccard_join.runs_for(0.999, 0.8, 5) < 40


# ---------------------------------------------------------------- 3


def removed_by_brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                keep[i : i + length] = bytes(length)
        spans = sum(1 for i in range(len(b)) if not keep[i] and (i == 0 or keep[i - 1]))
        kept = bytes(c for c, k in zip(b, keep, strict=True) if k)
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 1000])
def test_repeats_go(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeat_removal, "HOT", hot)
    for length, gram in ((400, 100), (80, 20)):
        want = sorted(zip((r[0] for r in rows), removed_by_brute_force([r[1] for r in rows], length), strict=True), key=lambda r: (r[0] is None, r))
        got = repeat_removal.remove_repeats(docs, length, gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(((r[0], tuple(r[1:])) for r in got), key=lambda r: (r[0] is None, r)) == want


# ---------------------------------------------------------------- 5


def test_passages_in_several_documents(docs, rows):
    got = defaultdict(list)
    for r in compact_windows.near_duplicate_passages(docs).collect():
        got[r.doc_id].append(r)
    marks = [shingles(r[1]) for r in rows]
    seen = defaultdict(set)
    for r, s in zip(rows, marks, strict=True):
        for i in range(len(s) - 45):
            seen[tuple(s[i : i + 46])].add(r[0])
    want = {d for v in seen.values() if len(v) > 1 for d in v}
    assert want <= set(got) and not {11, 16, 17, 2, 3, 4, 5, 6} & set(got)
    assert {7, 8, 9, 10, 0, 1} <= set(got)
    assert got[9][0].class_id == got[10][0].class_id == 9
    assert any(r.start_word <= 60 and r.end_word >= 150 for r in got[9])


@pytest.mark.parametrize("piece", [3, 400])
def test_a_passage_that_very_many_share(spark, piece):
    shared = passage(55, 60)
    df = spark.createDataFrame([(i, f"{passage(100 + i, 40)} {shared} {passage(300 + i, 40)}" if i < 30 else passage(600 + i, 140)) for i in range(45)], "doc_id long, text string")
    got = compact_windows.near_duplicate_passages(df, piece=piece).collect()
    assert {r.doc_id for r in got} == set(range(30)) and {r.class_id for r in got} == {0}


def edited(seed, places):
    w = passage(seed, 50).split()
    for p, x in places:
        w[p] = f"edit{x}"
    return " ".join(w)


@pytest.mark.parametrize("piece", [3, 400])
def test_stars_and_chains_of_near_passages(spark, piece):
    texts = []
    for k in range(8):  # an original and copies with an edit each: like the original, unlike one another
        texts += [edited(7000 + k, [(p, f"{k}x{p}")] if p else []) for p in (0, 6, 14, 22, 30, 38)]
    for k in range(4):  # each like the one before only
        texts += [edited(7100 + k, [(6 + 7 * j, f"{k}y{j}") for j in range(m)]) for m in range(5)]
    check_against_brute_force(spark, texts, piece)


def test_a_large_group_of_near_passages(spark):
    check_against_brute_force(spark, [edited(7200, [(4 + i % 42, f"z{i}")] if i else []) for i in range(430)], 400)


def check_against_brute_force(spark, texts, piece):
    """Texts of one passage each."""
    sets, root = [set(shingles(t)) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    size = Counter(map(find, range(len(texts))))
    want = {i: find(i) for i in range(len(texts)) if size[find(i)] > 1}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = compact_windows.near_duplicate_passages(df, piece=piece).collect()
    assert {r.doc_id: r.class_id for r in got} == want


# ---------------------------------------------------------------- 6


def contamination_by_brute_force(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


@pytest.mark.parametrize("most", [200_000, 20])
def test_contamination(docs, rows, bench, most):
    want = contamination_by_brute_force(rows, [(r.item_id, r.text) for r in bench.collect()])
    got = decontaminate.contamination(docs, bench, max_item_words=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=key) == want and any(r[5] for r in want)


def test_contamination_goes_and_clean_documents_stay(docs, rows, bench):
    got = {r.doc_id: r for r in decontaminate.remove_contamination(docs, bench).collect() if r.doc_id != 0}
    clean = {r[0]: r for r in rows}
    assert passage(900, 12) not in got[13].text and got[13].n_chars == len(got[13].text)
    assert 14 not in got and all(got[d].text == clean[d][1] for d in clean if d not in (0, 13, 14))
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_one_word_items():
    m = decontaminate.Matcher(["a"], ["b"])
    hit, found = m.find(common.Words(pa.array(["a b c b", "b"]), common.ALNUM_WORDS))
    assert hit.tolist() == [False, True, False, True, True] and dict(found) == {0: {0}, 1: {0}}


# ---------------------------------------------------------------- 7


def test_mix_meets_targets(docs, rows):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r["size"]) for r in got), key=key) == sorted(((r[0], size(r[1])) for r in rows), key=key)
    by = Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    assert math.isclose(sum({r.source_size: r.target for r in got}.values()), sum(by.values()))
    taken = Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    largest = max(size(r[1]) for r in rows)
    for r in got:
        assert abs(taken[source[r.doc_id]] - r.target) <= 2 * largest
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=key) == sorted(map(tuple, got), key=key)
    assert sum(r["n"] for r in mixing.take_mix(docs).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()) > 0


def test_targets_stop_at_three_times_the_size():
    t = mixing.water_fill([("a", 100), ("b", 1), ("c", 10), (None, 5)])
    assert t["b"] == 3 and t["c"] == 30 and math.isclose(sum(t.values()), 116) and all(t[s] <= 3 * n for s, n in (("a", 100), ("b", 1), ("c", 10), (None, 5)))
    assert mixing.water_fill([]) == {} and mixing.water_fill([("a", 0)]) == {"a": 0}


def test_overlapping_patterns_share_by_cost():
    flow = mixing.min_cost_flow({"a": (100, ("a",)), "a+b": (100, ("a", "b")), "b": (50, ("b",))}, {"a": 150, "b": 100})
    assert sum(flow.values()) == 250 and flow == {"a": 100, "a+b": 100, "b": 50}  # nothing needs repeating
    assert mixing.min_cost_flow({"a": (10, ("a",))}, {"a": 99}) == {"a": 30}


# ---------------------------------------------------------------- 8


def test_token_files_round_trip(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    got = token_output.encode_documents(docs, tokenizer_path(), tokens_per_file=3000, block=1024).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, g in zip(order, got, strict=True):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_give_the_librarys_ids():
    e = token_output.PieceEncoder(tokenizer_path())
    r = random.Random(5)
    signs = [*"ab Z9.,!'’\n\r\t\x0b é ñß日", "'s", "'ll", "  ", "\n\n", "12", "ə"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    texts += ["", None, " a  b", "a b\n c   d e　f g", "x\t y z ", "é à b", "don't  stop 123 4", "<|endoftext|> hi", "日 本 語 a b", "a'b, c.d!!  e\r\n\nf", " x  y", "Á b"]
    ids, n = e.encode(pa.array(texts))
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    e, t = token_output.PieceEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    end = "<|endoftext|>"
    texts = [end, f"a b{end}", f"{end} c d", f"Ab, {end}{end}\n{end}x.", "<|endof", "text|>", f"<|{end}|>", f"end of{end[:-1]} >", f"é{end}é 日{end} 1", "endoftext", None, f" {end}", f"{end}\n"] * 2
    ids, n = e.encode(pa.array(texts))
    want = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w] and 50256 in ids


@pytest.mark.parametrize("kind", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_other_added_tokens(tmp_path, kind):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.add_tokens([AddedToken(x, normalized=False, **kind) for x in ("PAD", "PADS", "a b")])
    t.save(str(tmp_path / "t.json"))
    e, t = token_output.PieceEncoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["PAD", " PAD  x", "x PADSy PAD, z", "a b  a b", "PADDING a bc", "hi a", " b PAD\n"]
    ids, n = e.encode(pa.array(texts))
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_rans_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint32)
    data = rans.encode_file(ids, [7, None], np.array([n, 0]), 1024)
    got, doc_ids, sizes = rans.decode_file(data)
    assert got.tolist() == ids.tolist() and doc_ids == [7, None] and sizes.tolist() == [n, 0]
    if n > 2048:
        assert rans.decode_file(data, range(1, 2))[0].tolist() == ids[1024:2048].tolist()
        with pytest.raises(ValueError):
            rans.decode_file(data[:-1] + bytes([data[-1] ^ 1]))


# ---------------------------------------------------------------- 9


def test_classifier_learns_and_ignores_labels_of_the_held_out(spark, docs):
    good = [(i, passage(i, 60), 1) for i in range(150)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in passage(i, 60).split()), 0) for i in range(100)]
    d = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2] if fold(r[0], 5) else 1 - r[2], 0) for r in good + bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(d, labels)
    got = {r.doc_id: r for r in quality.score(d, forest).collect()}
    assert all(got[i].predicted == y and 0 <= got[i].score <= 1 and got[i].held_out == (fold(i, 5) == 0) for i, _, y in good + bad)
    assert quality.score(docs, forest).count() == docs.count()
    assert quality.keep_good(d, forest).count() == 150
    assert quality.train(d, labels) == forest
    assert quality.score(docs, quality.train(d.limit(0), labels.limit(0))).select("score").distinct().count() == 1


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    f = quality.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=10)
    f = quality.Forest.load(f.dump())

    def walk(row):
        total = f.base
        for r in f.roots:
            while f.feature[r] >= 0:
                r = f.left[r] + (row[f.feature[r]] > f.limit[r])
            total += f.value[r]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(f.score(x), [walk(r) for r in x])
    assert ((f.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.8


def test_idle_workers_hold_little(monkeypatch):
    """Known pieces are a few arrays, and tables of powers go as a task ends."""
    import tracemalloc

    import public_tokenizers

    common.prefix_hash(np.ones(1 << 20, np.uint8))
    common.release()
    assert not common._POWERS
    enc = token_output.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{(i * 7919 + j) % 60000}" for j in range(2000)) for i in range(60)]
    want = [enc.encode(pa.array([t])) for t in texts[:3]]
    common.release()
    tracemalloc.start()
    try:
        for t in texts:
            enc.encode(pa.array([t]))
        common.release()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(enc.names) > 40_000 and held < 60 * len(enc.names)
    monkeypatch.setattr(token_output, "PIECES", 1000)
    for t, (ids, size) in zip(texts[:3], want, strict=True):
        got = enc.encode(pa.array([t]))
        assert np.array_equal(got[0], ids) and np.array_equal(got[1], size) and np.array_equal(ids, enc.tokenizer.encode(t, add_special_tokens=False).ids)


# ---------------------------------------------------------------- 10


def test_base_score_and_counts(docs, rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    c = Counter()
    for r in rows:
        if fold(r[0], 7) != 2:
            c.update([*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = [*words(r[1]), None]
        want.append((r[0], fold(r[0], 7) == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = ppm.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert ppm.score(docs, folds=1, fold=0).filter("train_tokens = 0 and n_known = 0").count() == len(rows)


def test_whole_texts_score_as_ppm_by_the_book(docs, rows):
    order = ppm.ORDER
    streams = []  # doc_id, class, its tokens as symbols after a start mark, whether it is in training
    for i, text, lang, *_ in rows:
        tokens = [[*w.encode(), ppm.WORD_END] for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w] + [[ppm.DOC_END]]
        streams.append((i, lang or "", tokens, fold(i, 7) != 2))
    table = defaultdict(Counter)
    for _, lang, tokens, training in streams:
        for t in tokens if training else []:
            s = [("start", lang), *t]
            for j in range(1, len(s)):
                for k in range(min(order, j) + 1):
                    table[tuple(s[j - k : j])][s[j]] += 1

    def cost(s, j):
        out, p = set(), 1.0
        for k in range(min(order, j), -1, -1):
            left = {a: n for a, n in table.get(tuple(s[j - k : j]), {}).items() if a not in out}
            if not left:
                continue
            total, kinds = sum(left.values()), len(left)
            if s[j] in left:
                return math.log10(p * (2 * left[s[j]] - 1) / (2 * total))
            p *= kinds / (2 * total)
            out |= set(left)
        return math.log10(p / (ppm.ALPHABET - len(out)))

    texts = Counter(lang for _, lang, _, training in streams if training)
    want = []
    for i, lang, tokens, _ in streams:
        score = math.log10((texts[lang] + 1) / (sum(texts.values()) + ppm.MAX_CLASSES))
        want.append((i, round(score + sum(cost([("start", lang), *t], j) for t in tokens for j in range(1, len(t) + 1)), 6)))
    for most in (ppm.MAX_PAIRS, 0):  # in every task, and by a join
        assert sorted(((r.doc_id, round(r.score, 6)) for r in ppm.score(docs, most=most).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_contexts_across_words_score_as_ppm_by_the_book(docs, rows, monkeypatch, piece):
    monkeypatch.setattr(ppm.in_pieces, "__defaults__", (piece,))
    order, table, texts, streams = ppm.ORDER, defaultdict(Counter), Counter(), []
    for i, text, lang, *_ in rows:
        s = [("start", lang or "")]
        for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text or "")):
            s += [*w.encode(), ppm.WORD_END]
        streams.append((i, lang or "", [*s, ppm.DOC_END]))
        if fold(i, 7) != 2:
            texts[lang or ""] += 1
            s = streams[-1][2]
            for j in range(1, len(s)):
                for k in range(min(order, j) + 1):
                    table[tuple(s[j - k : j])][s[j]] += 1

    def cost(s, j):
        out, p = set(), 1.0
        for k in range(min(order, j), -1, -1):
            left = {a: n for a, n in table.get(tuple(s[j - k : j]), {}).items() if a not in out}
            if not left:
                continue
            if s[j] in left:
                return math.log10(p * (2 * left[s[j]] - 1) / (2 * sum(left.values())))
            p *= len(left) / (2 * sum(left.values()))
            out |= set(left)
        return math.log10(p / (ppm.ALPHABET - len(out)))

    prior = lambda lang: math.log10((texts[lang] + 1) / (sum(texts.values()) + ppm.MAX_CLASSES))
    want = [(i, round(prior(lang) + sum(cost(s, j) for j in range(1, len(s))), 6)) for i, lang, s in streams]
    figures = lambda r: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
    plain = sorted((str(r.doc_id), *figures(r)) for r in ppm.score(docs).collect())
    for most in (ppm.MAX_PAIRS, 0):  # in every task, and by a join
        got = ppm.score(docs, most=most, across=True).collect()
        assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=key) == sorted(want, key=key)
        assert sorted((str(r.doc_id), *figures(r)) for r in got) == plain


def test_symbols_after_a_context_add_up_to_one():
    rng = np.random.default_rng(1)
    words = pa.array(["".join(rng.choice(list("abcé"), rng.integers(1, 7))) for _ in range(60)])
    pair, _, n = ppm.pairs_of(words, rng.integers(1, 9, 60), np.zeros(60, np.int64), 3)
    u, where = np.unique(pair, return_inverse=True)
    n = np.bincount(where, n)
    for context in np.unique(u >> 9)[:20]:
        every = np.union1d(u, (context << 9) | np.arange(1, ppm.ALPHABET + 1))
        c = np.zeros(len(every), np.int64)
        c[np.searchsorted(every, u)] = n
        p = ppm.log_probability(every, c, ppm.dense(u, n), 3)
        assert abs((10 ** p[every >> 9 == context]).sum() - 1) < 1e-9


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
@pytest.mark.parametrize("n", [0, 1, 96, 97, 1500])
def test_marks_held_by_another_context(kind, n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 150, (n, 91)).astype(kind), rng.integers(0, 150, (n, 46)).astype(kind)
    want = [[a > 0 and a in set(q.tolist()) for a in p.tolist()] for p, q in zip(x, y, strict=True)]
    assert compact_windows.within(x, y).tolist() == want and compact_windows.within(y, x).shape == y.shape


@pytest.mark.parametrize("piece", [3, 400])
def test_edited_passages_against_brute_force(spark, piece):
    rng, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for _ in range(6):
        core = some(70)
        for _ in range(10):
            edited = list(core)
            for at in rng.sample(range(70), 2):
                edited[at] = rng.choice(vocabulary)
            rows.append(some(rng.randrange(40)) + edited + some(rng.randrange(40)))
    phrase = some(14)  # many share it, but no passage
    rows += [some(60) + phrase + some(60) for _ in range(20)]
    windows = []
    for words in rows:
        s = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        windows.append([frozenset(s[i : i + 46]) for i in range(len(s) - 45)])
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if a // 10 == b // 10 and any(len(x & y) >= 0.8 * len(x | y) for x in windows[a] for y in windows[b])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    classes = defaultdict(set)
    for r in compact_windows.near_duplicate_passages(docs, piece=piece).collect():
        classes[r.class_id].add(r.doc_id)
    assert set().union(*classes.values()) <= {x for p in pairs for x in p}
    assert sum(any({a, b} <= c for c in classes.values()) for a, b in pairs) >= 0.95 * len(pairs)


# ---------------------------------------------------------------- all


def test_empty_tables(empty, bench):
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert repeat_removal.remove_repeats(empty).count() == 0
    assert compact_windows.near_duplicate_passages(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert mixing.mix(empty).count() == 0
    assert token_output.encode_documents(empty, tokenizer_path()).count() == 0
    assert ppm.score(empty).count() == 0


def test_extra_columns_with_clashing_names(clashing, docs, bench):
    n = docs.count()
    assert jaccard_join.jaccard_join(clashing).count() == n
    assert repeat_removal.remove_repeats(clashing).count() == n
    assert compact_windows.near_duplicate_passages(clashing).count() == compact_windows.near_duplicate_passages(docs).count()
    assert decontaminate.contamination(clashing, bench).count() == decontaminate.contamination(docs, bench).count()
    assert mixing.mix(clashing).count() == n and mixing.take_mix(clashing).columns == clashing.columns
    assert token_output.encode_documents(clashing, tokenizer_path()).count() == n
    assert ppm.score(clashing).count() == n
    assert jaccard_join.one_of_each(clashing).count() == jaccard_join.one_of_each(docs).count()


def test_contexts_that_different_drawn_ones_reach_meet(spark, monkeypatch):
    """a and b are alike; the drawn ones, p and q, reach one each and aren't alike themselves."""
    import numpy as np
    from pyspark.sql import functions as F

    from glyphmill.llm import compact_windows as CW

    wide, other = 10, np.random.default_rng(2).permutation(np.arange(1, 60_000)).astype(np.uint32)
    a = other[:19].copy()
    b = a.copy()
    b[9] = other[20]  # every passage holds this place, and one of the next two
    p, q = a.copy(), b.copy()
    p[[8, 10]], q[[8, 10]] = other[30:32], other[40:42]
    like = lambda x, y: bool(CW.alike(x[None], y[None], wide, 0.8)[0][0])
    assert like(a, b) and like(a, p) and like(b, q) and not (like(p, q) or like(p, b) or like(q, a))
    monkeypatch.setattr(CW, "PIVOTS", 1)
    drawn = spark.range(200).select("id", (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(4)) < 1).alias("drawn")).collect()
    yes, no = [r.id for r in drawn if r.drawn], [r.id for r in drawn if not r.drawn]
    rows = [(5, e, 4, 10 + i, 9, bytearray(m.tobytes())) for i, (e, m) in enumerate([(no[0], a), (no[1], b), (yes[0], p), (yes[1], q)])]
    contexts = CW.written(spark.createDataFrame(rows, "v long, e long, n long, t long, pos int, marks binary"), "contexts-of-test")
    found = {frozenset((r.e, r.lead_e)) for r in CW.links_of_many(contexts, wide, 0.8, 3).collect()}
    assert frozenset((no[0], no[1])) in found and {frozenset((no[0], yes[0])), frozenset((no[1], yes[1]))} <= found


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_marks_that_share_a_place(kind):
    rng = np.random.default_rng(4)
    step = compact_windows.PLACES
    marks = np.concatenate([np.zeros(3, kind), step * np.arange(1, 60), step * np.arange(60) + 7, rng.integers(1, 65_000, 60)]).astype(kind)
    x, y = rng.choice(marks, (300, 91)), rng.choice(marks, (300, 91))
    y[:50, 0] = 0
    want = [[a > 0 and a in set(q.tolist()) for a in p.tolist()] for p, q in zip(x, y, strict=True)]
    assert compact_windows.within(x, y).tolist() == want


@pytest.mark.parametrize("run", [4, 1 << 20])
def test_windows_that_meet_are_told_in_one_pass(monkeypatch, run):
    """Against a plain grouping, with runs of one min-hash over several batches, copies, whole texts, and runs too long to hold."""
    monkeypatch.setattr(compact_windows, "RUN", run)
    rng, piece = np.random.default_rng(run), 3
    for trial in range(30):
        n = int(rng.integers(0, 120))
        v = rng.integers(-4, 5, n) * rng.integers(0, 2, n)
        rows = sorted(zip(v.tolist(), rng.integers(0, 1 + trial // 4, n).tolist(), rng.integers(0, 4, n).tolist(), rng.integers(0, 3, n).tolist(), strict=True))
        rows += [(50 + t, 50 + t, 50 + t, -1) for t in range(4) for _ in range(t)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 7]], pa.int32() if k == 3 else pa.int64()) for k in (2, 3, 0, 1)] + [pa.array([0] * len(rows[i : i + 7]), pa.int32())], names=["t", "pos", "v", "e", "known"]) for i in range(0, len(rows), 7)]
        got = [tuple(r.values()) for b in compact_windows.classed(iter(batches), piece, 5) for r in b.to_pylist()]
        places = sorted(set(rows))
        own, classes = {}, {}
        for p in places:
            own.setdefault(p[:2], []).append(p)
            classes.setdefault(p[0], set()).add(p[1])
        want, leads = set(), {}
        for p in places:
            if p[3] >= 0 and sum(q[0] == p[0] for q in places) > 1:
                want.add((p[2], p[3], p[0], p[1], len(own[p[:2]]) > 1))
                if own[p[:2]][0] == p:
                    leads[p] = 1 if len(classes[p[0]]) == 1 else 2 if len(classes[p[0]]) <= piece else 3
        texts = [g for g in got if g[1] < 0]
        assert {g[0] for g in texts} == {52, 53} and all(g[5] for g in texts)
        got = [g for g in got if g[1] >= 0]
        assert len(got) == len(want) and {(*g[:4], g[5]) for g in got} == want
        told = {(g[2], g[3], g[0], g[1]): g[4] for g in got if g[4]}
        if run > len(rows):
            assert told == leads
        else:
            assert told.keys() == leads.keys() and all(x == leads[p] or x == 3 for p, x in told.items())


def test_a_lead_is_told_with_one_of_its_links():
    wide, first = 10, np.arange(1, 20, dtype=np.uint16)
    rows = np.stack([first, *[np.where(np.arange(19) == k, 900 + k, first) for k in (2, 3, 16)]]).astype(np.uint16)
    t = pa.table({"key": pa.array([7] * 4), "e": pa.array(range(4)), "t": pa.array(range(10, 14)), "pos": pa.array([30] * 4, pa.int32()), "marks": pa.array([r.tobytes() for r in rows], pa.binary()), "v": pa.array([7] * 4), "side": pa.array([0] * 4)})
    links = compact_windows.links_in(t, wide, 0.8).to_pylist()
    _, _, ends_a, ends_b = compact_windows.spanning(np.full(4, 7), np.zeros(4, int), rows, wide, 0.8)
    assert len(links) == 3 and [x["lead_e"] for x in links] == [0] * 3 and [[x["s"], x["z"]] for x in links] == ends_a.tolist()
    told = [(x["lead_t"], x["lead_pos"], x["lead_s"], x["lead_z"]) for x in links if x["lead_t"] is not None]
    assert told == [(10, 30, ends_b[:, 0].min(), ends_b[:, 1].max())]


def test_a_class_that_many_share_is_not_dealt_to_one_task():
    """Windows of several batches, with copies of texts among them: a batch sends one of a class to its min-hash, and all are told as without that."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        texts = {t: sorted({(int(p), int(rng.integers(0, 3)), int(rng.integers(0, 2))) for p in rng.integers(0, 9, rng.integers(1, 8))}) for t in range(5)}
        texts = {t: list({p: (p, v, e) for p, v, e in w}.values()) for t, w in texts.items()}
        parts, plain = [], set()
        for _ in range(4):
            rows = sorted((t, *w) for t in rng.permutation(5)[: rng.integers(0, 4)].tolist() for w in texts[t])
            plain |= set(rows)
            t, pos, v, e = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            parts.append(compact_windows.dealt(t, pos, v, e))
            sent = [(r["v"], r["e"]) for r in parts[-1].to_pylist() if r["known"] < 2]
            assert len(sent) == len(set(sent)) and all(r["deal"] == (r["t"] if r["known"] == 2 else r["v"]) for r in parts[-1].to_pylist())
        every = sorted((r for b in parts for r in b.to_pylist()), key=lambda r: (r["v"], r["e"], r["t"], r["pos"], -r["known"]))
        batch = pa.Table.from_pylist(every, parts[0].schema).select(["t", "pos", "v", "e", "known"]).combine_chunks().to_batches()
        got = [r for b in compact_windows.classed(iter(batch), 2) for r in b.to_pylist()]
        size = lambda *k: len({r for r in plain if all(r[i] == x for i, x in k)})
        assert {(r["t"], r["pos"], r["v"], r["e"]) for r in got if r["again"]} == {r for r in plain if size((2, r[2]), (3, r[3])) > 1}
        leads = [(r["v"], r["e"], r["t"], r["pos"], r["lead"]) for r in got if r["lead"]]
        want = {(r[2], r[3], *min(q[:2] for q in plain if q[2:] == r[2:]), min(2, len({q[3] for q in plain if q[2] == r[2]}) if size((2, r[2]), (3, r[3])) < size((2, r[2])) else 1)) for r in plain if size((2, r[2])) > 1}
        assert len(leads) == len(set(leads)) and set(leads) == want
