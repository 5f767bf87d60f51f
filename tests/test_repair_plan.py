"""The repair plan against a plain loop over findings, with competing merges."""

import random

import pytest

from glyphmill.operators.repair_plan import PlanOptions, merges, plan

FOUND = "report long, ord long, rule string, folder boolean, ref string, w long, h long, best_mime string, content_class string"
RULES = ["occupancy", "wasted-regions", "dimensions-oversize", "format", "wasted-alpha", "strippable-metadata", "frame-redundancy", "trim-margin", "duplicate-similar", "duplicate-exact", "atlas-merge", "bleeding"]


def made(seed):
    r = random.Random(seed)
    found, related, owners, packs = [], [], [], []
    for report in range(6):
        refs = [f"a{i}" for i in range(14)]
        for ord_ in range(30):
            rule = r.choice(RULES)
            found.append((report, ord_, rule, rule in ("atlas-merge", "duplicate-similar", "duplicate-exact") or r.random() < 0.1, r.choice(refs), r.randint(100, 5000), r.randint(100, 5000), r.choice(["image/avif", "nonsense", None]), r.choice(["flat", "photographic", None])))
            if rule in ("atlas-merge", "duplicate-similar", "duplicate-exact"):
                related += [(report, ord_, k, ref) for k, ref in enumerate(r.sample(refs, r.randint(1, 4)))]
        owner, *consumers = r.sample(refs, 4)
        owners += [(report, 1, owner, c) for c in consumers[:2]] + [(report, 2, consumers[2], None)]
        packs += [(report, k % 2, ref) for k, ref in enumerate(r.sample(refs, 5))]
    return found, related, owners, packs


def by_loop(found, related, owners, packs, o, tierable=None):
    """Ops of one report in order: (pass, ord, op, ref)."""
    out, repacked, dropped, resized, packed, done = [], set(), set(), set(), set(), set()
    members = lambda ord_: [x[3] for x in sorted(related) if x[1] == ord_]
    owns = {x[2] for x in owners} if o.aggressive and owners else set()
    if o.aggressive and owners:
        for _, grp, _, c in sorted(x for x in owners if x[3]):
            if c not in owns and c not in dropped:
                dropped.add(c)
                out.append((1, grp, "drop", c))
    for _, pack, ref in sorted(packs or []):
        if ref not in dropped:
            packed.add(ref)
            out.append((2, pack, "pack", ref))
    if o.aggressive:
        for f in found:
            fresh = [x for x in members(f[1]) if f[2] == "atlas-merge" and x not in repacked | owns | dropped]
            if len(fresh) >= 2:
                repacked |= set(fresh)
                out += [(3, f[1], "repack", x) for x in fresh]
    again = ["occupancy", "wasted-regions", *(["frame-redundancy"] if o.frame_redundancy else []), *(["trim-margin"] if o.trim_margin else [])]
    is_again = lambda f: f[2] in ("occupancy", "wasted-regions") or (f[2] in again and not f[3])
    later = {f[4] for f in found if is_again(f)} - owns
    tiered = {f[4] for f in found if o.tiers and not f[3] and f[4] not in dropped | repacked | packed | owns | later and (tierable is None or f[4] in tierable)}
    for f in found:
        ref = f[4]
        if is_again(f):
            if ref not in owns | repacked:
                repacked.add(ref)
                out.append((4, f[1], "repack", ref))
        elif f[2] == "dimensions-oversize" and not f[3] and max(f[5], f[6]) > o.max_edge and ref not in owns | resized | repacked | tiered:
            resized.add(ref)
            out.append((4, f[1], "resize", ref))
        elif o.aggressive and (f[2] == "duplicate-similar" or (f[2] == "duplicate-exact" and not owners)):
            for x in members(f[1])[1:]:
                if x not in owns | dropped | repacked:
                    dropped.add(x)
                    out.append((4, f[1], "drop", x))
    taken = resized | dropped | packed | tiered
    for f in found:
        if f[2] == "format" and not f[3] and f[4] not in repacked | taken | done:
            done.add(f[4])
            out.append((5, f[1], "transcode", f[4]))
    for f in found:
        if o.opaque and f[2] == "wasted-alpha" and not f[3] and f[4] not in done | taken:
            done.add(f[4])
            out.append((6, f[1], "transcode", f[4]))
    for f in found:
        if o.strip and f[2] == "strippable-metadata" and not f[3] and f[4] not in done | taken | repacked | owns:
            done.add(f[4])
            out.append((7, f[1], "strip", f[4]))
    return sorted(out)


@pytest.mark.parametrize("seed,o", [(1, PlanOptions(aggressive=True, opaque=True, strip=True)), (2, PlanOptions(opaque=True, strip=True, trim_margin=False)), (3, PlanOptions(aggressive=True, tiers=True, strip=True)), (4, PlanOptions(aggressive=True, frame_redundancy=False, opaque=True))])
def test_plan_equals_a_loop(spark, seed, o):
    found, related, owners, packs = made(seed)
    owners = owners if seed != 4 else []
    f, r = spark.createDataFrame(found, FOUND), spark.createDataFrame(related, "report long, ord long, place long, ref string")
    w = spark.createDataFrame(owners, "report long, grp long, owner string, consumer string") if owners else None
    p = spark.createDataFrame(packs, "report long, pack long, ref string")
    may = spark.createDataFrame([(k, f"a{i}") for k in range(6) for i in range(0, 14, 2)], "report long, ref string")
    got = plan(f.repartition(4), r.repartition(3), w, p, tierable=may, o=o).collect()
    for report in range(6):
        one = lambda rows: [x for x in rows if x[0] == report]
        want = by_loop(one(found), one(related), one(owners), one(packs), o, {f"a{i}" for i in range(0, 14, 2)})
        mine = sorted((x["pass"], x.ord, x.op, x.ref) for x in got if x.report == report)
        assert mine == want
        for passes in ((1,), (2,), (3,), (5, 6, 7)):
            refs = [x[3] for x in mine if x[0] in passes]
            assert len(refs) == len(set(refs))  # no ref is claimed twice


def test_details_of_operations(spark):
    found = [(1, 1, "dimensions-oversize", False, "big", 4096, 1000, None, None), (1, 2, "format", False, "pic", 1, 1, "image/avif", "flat"), (1, 3, "wasted-alpha", False, "pic", 1, 1, None, None), (1, 4, "occupancy", False, "sheet", 1, 1, None, None)]
    f = spark.createDataFrame(found, FOUND)
    r = spark.createDataFrame([], "report long, ord long, place long, ref string")
    w = spark.createDataFrame([(1, 5, "own", "sheet2")], "report long, grp long, owner string, consumer string")
    a = spark.createDataFrame([(1, "sheet2")], "report long, ref string")
    got = {x.ref: x for x in plan(f, r, w, None, a, o=PlanOptions(aggressive=True, opaque=True, best_format=True, extrude=3)).collect()}
    assert (got["big"].to_w, got["big"].to_h) == (2048, 500) and (got["pic"].target_mime, got["pic"].lossless, got["pic"].opaque) == ("image/avif", True, True)
    assert got["sheet"].extrude == 3 and (got["sheet2"].owner, got["sheet2"].repoint, got["sheet2"].keep_consumer) == ("own", True, False)
    kept = plan(f, r, w, None, a, o=PlanOptions(aggressive=True, tiers=True)).filter("ref = 'sheet2'").first()
    assert (kept.repoint, kept.keep_consumer) == (False, True)  # tiers rename owners


def test_competing_merges_settle_in_order(spark):
    claims = [(1, 1, "a"), (1, 1, "b"), (1, 2, "b"), (1, 2, "c"), (1, 3, "c"), (1, 3, "d"), (1, 3, "e"), (2, 9, "a"), (2, 9, "b"), (3, 1, "x"), (3, 2, "x"), (3, 2, "y")]
    got = sorted(map(tuple, merges(spark.createDataFrame(claims, "report long, ord long, ref string")).collect()))
    assert got == [(1, 1, "a"), (1, 1, "b"), (1, 3, "c"), (1, 3, "d"), (1, 3, "e"), (2, 9, "a"), (2, 9, "b"), (3, 2, "x"), (3, 2, "y")]
