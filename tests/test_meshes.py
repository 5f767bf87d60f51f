"""Outlines hold every visible pixel, triangles fill them, and nested masks stay apart."""

import numpy as np
import pytest

from glyphmill.sources import meshes as M
from tests.test_sources import png


def blob(seed):
    r = np.random.default_rng(seed)
    h, w = r.integers(12, 90, 2)
    y, x = np.mgrid[:h, :w]
    alpha = np.zeros((h, w), bool)
    cx, cy = w / 2, h / 2
    for _ in range(r.integers(1, 5)):
        a, b = r.uniform(3, w / 2), r.uniform(3, h / 2)
        alpha |= ((x - cx) / a) ** 2 + ((y - cy) / b) ** 2 <= 1
        cx, cy = cx + r.uniform(-a / 2, a / 2), cy + r.uniform(-b / 2, b / 2)
    if r.random() < 0.5:
        alpha[: h // 3, : w // 3] = False
    return alpha.astype(np.uint8) * r.integers(1, 256)


def inside(tri, px, py):
    """Whether points lie in a triangle, its edges included."""
    (ax, ay), (bx, by), (cx, cy) = tri
    s = lambda x0, y0, x1, y1: (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
    return (s(ax, ay, bx, by) >= 0) & (s(bx, by, cx, cy) >= 0) & (s(cx, cy, ax, ay) >= 0)


@pytest.mark.parametrize("seed", range(40))
def test_triangles_cover_every_visible_pixel(seed):
    alpha = blob(seed)
    mask = M.mask_of(alpha, 1)
    got = M.mesh_of(alpha)
    if M.island_count(mask) != 1:
        assert got is None
        return
    loop = M.outline(mask)
    assert M.area2(loop) // 2 >= mask.sum()
    poly = M.grown(loop)
    assert len(poly) <= 12 and M.area2(poly) >= M.area2(loop)
    parts = M.triangles_of(poly)
    assert len(parts) == len(poly) - 2
    assert sum(M.cross(*(poly[i] for i in t)) for t in parts) == M.area2(poly)  # they fill it and don't overlap
    y, x = np.nonzero(mask)
    px, py = 2 * x + 1, 2 * y + 1  # centres, doubled
    covered = np.zeros(len(px), bool)
    for t in parts:
        covered |= inside([(2 * poly[i][0], 2 * poly[i][1]) for i in t], px, py)
    assert covered.all()
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):  # and the corners of each pixel
        corner = np.zeros(len(px), bool)
        for t in parts:
            corner |= inside([poly[i] for i in t], x + dx, y + dy)
        assert corner.all()


def test_sprites_that_a_rectangle_serves():
    assert M.mesh_of(np.zeros((9, 9), np.uint8)) is None and M.mesh_of(np.full((9, 9), 255, np.uint8)) is None
    two = np.zeros((20, 20), np.uint8)
    two[2:5, 2:5] = two[12:18, 12:18] = 255
    assert M.mesh_of(two) is None and M.island_count(two > 0) == 2
    touch = np.zeros((4, 4), bool)
    touch[0, 0] = touch[1, 1] = True
    assert M.island_count(touch) == 2  # a shared corner doesn't join
    ring = np.full((30, 30), 255, np.uint8)
    ring[1:-1, 1:-1] = 0
    assert M.mesh_of(ring) is None  # far larger than what is visible


def test_a_triangle_and_a_large_one():
    y, x = np.mgrid[:40, :40]
    vertices, parts = M.mesh_of(np.where(x <= y, 255, 0).astype(np.uint8))
    assert len(vertices) <= 5 and len(parts) == len(vertices) - 2
    y, x = np.mgrid[:700, :900]
    alpha = np.where(x * 7 <= y * 9, 255, 0).astype(np.uint8)
    vertices, parts = M.mesh_of(alpha)
    ys, xs = np.nonzero(alpha)
    covered = np.zeros(len(xs), bool)
    for t in parts:
        covered |= inside([(2 * vertices[i][0], 2 * vertices[i][1]) for i in t], 2 * xs + 1, 2 * ys + 1)
    assert covered.all() and max(v[0] for v in vertices) <= 900 and max(v[1] for v in vertices) <= 700


def test_meshes_of_files(spark):
    px = np.zeros((40, 80, 4), np.uint8)
    y, x = np.mgrid[:40, :40]
    px[:, :40, 3] = np.where(x <= y, 200, 0)
    px[5:35, 45:75, 3] = 255
    f = spark.createDataFrame([("a.png", png(px)), ("b.png", b"nothing")], "path string, content binary")
    s = spark.createDataFrame([("a.png", 0, 0, 0, 40, 40), ("a.png", 1, 45, 5, 30, 30), ("a.png", 2, 70, 0, 20, 20), ("b.png", 0, 0, 0, 1, 1)], "path string, sprite_idx long, x int, y int, w int, h int")
    got = {(r.path, r.sprite_idx): r for r in M.sprite_meshes(f, s).collect()}
    assert set(got) == {("a.png", 0), ("a.png", 1)} and got["a.png", 1].vertices is None
    assert len(got["a.png", 0].triangles) == len(got["a.png", 0].vertices) - 2


def corner(n, thick):
    m = np.zeros((n, n), bool)
    m[:thick, :] = m[:, :thick] = True
    return m


@pytest.mark.parametrize("seed", range(6))
def test_nested_masks_keep_their_distance(seed):
    r = np.random.default_rng(seed)
    masks = []
    for _ in range(12):
        m = np.zeros(r.integers(2, 14, 2), bool)
        m[r.integers(0, m.shape[0]), :] = m[:, r.integers(0, m.shape[1])] = True
        masks.append(m)
    padding = int(r.integers(0, 6))
    for w, h, at in M.nest_items(masks, 128, padding):
        seen = np.zeros((h // 4, w // 4), np.int64)
        gap = -(-padding // 4)
        for i, (x, y) in at.items():
            m = masks[i]
            assert x >= 0 and y >= 0 and x + m.shape[1] * 4 <= w and y + m.shape[0] * 4 <= h
            for dy, dx in np.argwhere(m):
                near = seen[max(0, y // 4 + dy - gap) : y // 4 + dy + gap + 1, max(0, x // 4 + dx - gap) : x // 4 + dx + gap + 1]
                assert not ((near != 0) & (near != i + 1)).any()
            seen[y // 4 : y // 4 + m.shape[0], x // 4 : x // 4 + m.shape[1]][m] = i + 1


def test_corners_nest_into_fewer_bytes(spark):
    shapes = [corner(16, 3), corner(16, 3)[::-1, ::-1], *[np.ones((2, 2), bool)] * 4]
    rows = [("g", i, m.shape[1] * 4, m.shape[0] * 4, ["".join("1" if c else "0" for c in r) for r in m]) for i, m in enumerate(shapes)]
    rows += [("full", i, 32, 32, ["1" * 8] * 8) for i in range(4)]
    got = {r.group: r for r in M.nest_groups(spark.createDataFrame(rows, "group string, item long, w long, h long, rows array<string>"), padding=0).collect()}
    assert got["g"].wins and got["g"].bytes_nested < got["g"].bytes_rect
    assert not got["full"].wins and got["full"].bytes_nested == got["full"].bytes_rect == 64 * 64 * 4


def test_a_full_box_is_a_mesh_without_a_walk(monkeypatch):
    def fails(mask):
        raise AssertionError("walked")

    monkeypatch.setattr(M, "outline", fails)
    a = np.zeros((40, 50), np.uint8)
    a[3:7, 5:12] = 255
    assert M.mesh_of(a) == ([[5, 3], [12, 3], [12, 7], [5, 7]], [[3, 0, 1], [1, 2, 3]])
    assert M.mesh_of(np.full((4, 4), 9, np.uint8)) is None
