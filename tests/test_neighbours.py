"""Gaps by sweep and groups of like images, against loops over all pairs."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.operators import asset_rules as R
from glyphmill.operators import near_duplicates as ND
from glyphmill.operators.sweep import gaps_ahead


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(1, 12), st.integers(0, 40), st.integers(1, 12)), min_size=1, max_size=40))
def test_gaps_equal_all_pairs(rects):
    rects = sorted(rects)
    names = sorted({r[0] for r in rects})
    sheet, at, size, low, tall = (np.array(c) for c in zip(*[(names.index(r[0]), *r[1:]) for r in rects], strict=True))
    got = gaps_ahead(sheet, at, size, low, low + tall)
    for i, a in enumerate(rects):
        near = [b[1] - a[1] - a[2] for b in rects if b[0] == a[0] and b[1] >= a[1] + a[2] and b[3] < a[3] + a[4] and a[3] < b[3] + b[4]]
        assert got[i] == min(near, default=-1)


def test_a_sheet_of_very_many_sprites(spark):
    r = np.random.default_rng(1)
    n = 100_000
    x, y = r.integers(0, 16000, n), r.integers(0, 16000, n)
    began = time.time()
    gaps = gaps_ahead(np.zeros(n, np.int64), x, np.full(n, 9), y, y + 9)
    assert time.time() - began < 20 and (gaps >= 0).mean() > 0.9
    some = r.integers(0, n, 200)
    for i in some.tolist():
        ok = (x >= x[i] + 9) & (y < y[i] + 9) & (y[i] < y + 9)
        assert gaps[i] == (x[ok].min() - x[i] - 9 if ok.any() else -1)
    df = spark.range(3000).selectExpr("1L as asset_ref", "id as sprite_idx", "(id % 60) * 20 as x", "(id div 60) * 30 as y", "12L as w", "14L as h", "id % 2 = 0 as rotated")
    got = R.excessive_gutter(df).first()
    assert (got.median, got.gaps) == (8, 2999)


FEATURES = "asset_ref string, ord long, content_hash string, d_hash string, mean_r double, mean_g double, mean_b double"


def greedy(rows, bits=6, color=24):
    near = lambda a, b: (int(a[3], 16) ^ int(b[3], 16)).bit_count() <= bits and (None in a[4:] or None in b[4:] or max(abs(x - y) for x, y in zip(a[4:], b[4:], strict=True)) <= color)
    rows, used, out = sorted(rows, key=lambda r: (r[1], r[0])), set(), []
    for i, a in enumerate(rows):
        if i in used or a[3] is None:
            continue
        group = [i]
        for j in range(i + 1, len(rows)):
            if j not in used and rows[j][3] is not None and all(near(rows[k], rows[j]) for k in group):
                group.append(j)
        if len(group) > 1:
            used |= set(group)
            if len({rows[k][2] for k in group}) > 1:
                out += [(a[0], rows[k][0]) for k in group]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_groups_equal_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(150):
        h = r.choice(base)
        for _ in range(r.randint(0, 5)):
            h ^= 1 << r.randrange(64)
        mean = tuple(float(r.choice([10, 30, 50, 70])) for _ in range(3)) if r.random() < 0.8 else (None, 1.0, 2.0)
        rows.append((f"a{i:03d}", i if seed else i // 2, f"c{r.randint(0, 4)}", f"{h:016x}" if r.random() < 0.95 else None, *mean))
    rows += [(f"z{i}", 900 + i, "same", f"{7:016x}", 1.0, 1.0, 1.0) for i in range(3)] + [(f"y{i}", 950 + i, f"d{i}", f"{1 << 40:016x}", 1.0, 1.0, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, FEATURES)
    want = greedy(rows)
    assert want and sorted(map(tuple, ND.duplicate_similar(df.repartition(5)).collect())) == want


@pytest.mark.parametrize("few", [True, False])
def test_no_near_pair_is_missed(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(ND, "FEW", 0)
    r = random.Random(9)
    hashes = []
    for _ in range(40):
        a = r.getrandbits(64)
        hashes.append(a)
        for k in (1, 3, 5, 6, 6, 7):
            hashes.append(a ^ sum(1 << b for b in r.sample(range(64), k)))
    got = {(x.d_hash, x.other): x.distance for x in ND.similar_candidates(spark.createDataFrame([(f"{h:016x}",) for h in hashes], "d_hash string")).collect()}
    want = {}
    for i, a in enumerate(hashes):
        for b in hashes[i + 1 :]:
            if a != b and (d := (a ^ b).bit_count()) <= 6:
                want[tuple(sorted((f"{a:016x}", f"{b:016x}")))] = d
    assert got == want


@pytest.mark.parametrize("size", [2, 3, 4])
def test_near_pairs_by_sets_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(ND, "FEW", {2: 1 << 18, 3: 32, 4: 1}[size])
    r = random.Random(size)
    hashes = {0, 2**64 - 1, 2**63, 7}
    for _ in range(20):
        hashes.add(a := r.getrandbits(64))
        hashes |= {a ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 4, 5, 6, 6, 6, 7, 8)}
    rows = [(f"{h:016x}",) for h in hashes] + [("ABCDEF0123456789",), ("abcdef0123456789",), ("",), (None,)]
    got = sorted(map(tuple, ND.similar_candidates(spark.createDataFrame(rows, "d_hash string")).collect()))
    names = sorted(x for (x,) in rows if x)
    assert got == [(a, b, d) for i, a in enumerate(names) for b in names[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 6]


def test_meetings_by_chance_follow_the_number_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(ND, "FEW", 1 << 10)
    values = spark.range(8000).select(F.xxhash64("id").alias("value"))
    met, masks = ND.meetings(values, 8000, 6)
    assert len(masks) == 9 and met.count() < 8000 * 2


def test_no_images_no_groups(spark):
    assert ND.duplicate_similar(spark.createDataFrame([], FEATURES)).count() == 0
    assert ND.duplicate_similar(spark.createDataFrame([("a", 1, "c", None, None, None, None)], FEATURES)).count() == 0
