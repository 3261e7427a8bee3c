import math

import numpy as np
import pytest

from scrivane.functions import image as im
from scrivane.operators import images
from scrivane.sources import files


def named(rgb):
    return dict(zip(im.names(), im.extract(rgb), strict=True))


def solid(v, h, w):
    return np.full((h, w, 3), v, np.uint8)


def test_solid_images():
    red = np.zeros((2, 2, 3), np.uint8)
    red[..., 0] = 255
    f = named(red)
    assert f["f0"] == 255 and f["f1"] == f["f16"] == 0 and f["f17"] > 0.99
    g = named(solid(128, 40, 40))
    assert g["f12"] == pytest.approx(128) and g["f15"] == 0 and g["f19"] < 1e-3 and g["f34"] > 0.8 and g["f43"] > 0.9 and g["f45"] == pytest.approx(0, abs=1e-9) and g["f48"] == pytest.approx(1)
    assert all(abs(g[f"f{k}"]) < 1e-9 for k in (50, 51, 52, 54, 55, 56, 57, 58, 69)) and g["f70"] == 1 and g["f71"] < 0.1


def test_small_pictures():
    edge = np.zeros((8, 8, 3), np.uint8)
    edge[:, 4:] = 255
    f = named(edge)
    assert f["f19"] > 0 and f["f20"] > 0 and f["f23"] > 0 and sum(f[f"f{k}"] for k in range(24, 32)) == pytest.approx(1)
    dark = solid(255, 80, 80)
    dark[20:60, 20:60] = 0
    d = named(dark)
    assert d["f54"] > 0 or d["f55"] > 0
    text = solid(240, 32, 32)
    text[8, 4:28] = text[16, 4:28] = 0
    t = named(text)
    assert t["f72"] == 2 and t["f75"] == 1 and t["f76"] == 24 and t["f77"] == 0
    for h, w in ((1, 1), (1, 7), (2, 2), (3, 3), (15, 17)):
        assert len(im.extract(solid(7, h, w))) == im.N_FEATURES == 81


# Plain re-computations of the less obvious kernels


def loops(rgb):
    g = 0.299 * rgb[..., 0].astype(float) + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]
    h, w = g.shape
    at = lambda p, y, x: p[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    out = {}
    mean, m2, m3, m4 = 0.0, 0.0, 0.0, 0.0
    for i, x in enumerate(rgb[..., 0].ravel().astype(float)):
        d = x - mean
        dn = d / (i + 1)
        t = d * dn * i
        mean += dn
        m4 += t * dn * dn * (i * i - 3 * i + 3) + 6 * dn * dn * m2 - 4 * dn * m3
        m3 += t * dn * (i - 2) - 3 * dn * m2
        m2 += d * (x - mean)
    n = h * w
    var = m2 / n
    out["f2"], out["f3"] = m3 / n / (var * math.sqrt(var)), m4 / n / var**2 - 3
    med = np.array([[sorted(at(g, y + a, x + b) for a in range(-2, 3) for b in range(-2, 3))[12] for x in range(w)] for y in range(h)])
    out["f50"] = float((g - med).var())
    r = 10 if min(h, w) >= 21 else max(1, int(min(h, w) * 0.1))
    disk = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    up = np.array([[max(at(g, y + a, x + b) for a, b in disk) for x in range(w)] for y in range(h)])
    light = np.array([[min(at(up, y + a, x + b) for a, b in disk) for x in range(w)] for y in range(h)])
    out["f54"], out["f55"] = float((g < 0.7 * light).mean()), float(light.var())
    hist = [0] * 10
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            ring = [g[y - 1, x], g[y - 1, x + 1], g[y, x + 1], g[y + 1, x + 1], g[y + 1, x], g[y + 1, x - 1], g[y, x - 1], g[y - 1, x - 1]]
            bits = [int(v >= g[y, x]) for v in ring]
            changes = sum(bits[k] != bits[k - 1] for k in range(8))
            hist[sum(bits) if changes <= 2 else 9] += 1
    out |= {f"f{35 + k}": v / ((h - 2) * (w - 2)) for k, v in enumerate(hist)}
    ink = g <= im.otsu_256(g)
    seen, count = np.zeros_like(ink), 0
    for y in range(h):
        for x in range(w):
            if ink[y, x] and not seen[y, x]:
                count += 1
                stack = [(y, x)]
                seen[y, x] = True
                while stack:
                    a, b = stack.pop()
                    for p, q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= p < h and 0 <= q < w and ink[p, q] and not seen[p, q]:
                            seen[p, q] = True
                            stack.append((p, q))
    out["f72"] = count
    best, threshold = 0.0, 128.0
    values = np.clip(g, 0, 255).astype(int)
    for k in range(255):
        a, b = values[values <= k], values[values > k]
        if len(a) and len(b):
            v = len(a) * len(b) * (a.mean() - b.mean()) ** 2
            if v > best * (1 + 1e-12):
                best, threshold = v, k
    out["otsu"] = threshold
    return out


@pytest.mark.parametrize(("h", "w", "seed"), [(12, 17, 0), (23, 24, 1), (9, 9, 2)])
def test_kernels_against_loops(h, w, seed):
    rgb = np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)
    f, want = named(rgb), loops(rgb)
    assert im.otsu_256(im.Image(rgb).gray) == want.pop("otsu")
    for k, v in want.items():
        assert f[k] == pytest.approx(v, rel=1e-8, abs=1e-9), k


def test_resize_keeps_small_images_and_flat_color():
    assert im.fit_within(solid(9, 5, 5)).shape == (5, 5, 3)
    big = im.fit_within(solid(77, 700, 1024))
    assert big.shape == (350, 512, 3) and (big == 77).all()


def test_groups_are_slices_of_the_whole(spark):
    df = images.pattern_images(spark.range(3), 24)
    whole = {r.id: r for r in images.features(df).collect()}
    for r in images.features(df, ("noise", "document")).collect():
        assert all(r[c] == whole[r.id][c] for c in im.names(("noise", "document")))
    images.register_functions(spark)
    df.createOrReplaceTempView("t_pictures")
    assert spark.sql("SELECT size(extract_features(rgb, width, height)) AS n FROM t_pictures").first().n == 81


def test_a_stack_is_its_images():
    """Images of one size are worked on together, over several slices, as each alone; flat and odd ones among them."""
    rng = np.random.default_rng(4)
    for h, w in ((1, 7), (3, 3), (16, 24), (40, 33)):
        stack = np.concatenate([rng.integers(0, 256, (3, h, w, 3)), np.full((1, h, w, 3), 9), np.zeros((1, h, w, 3)), (rng.random((3, h, w, 1)) < 0.5) * np.full(3, 255)]).astype(np.uint8)
        step, im.STACK_PIXELS = im.STACK_PIXELS, 3 * h * w
        try:
            got = im.extract_all(stack)
        finally:
            im.STACK_PIXELS = step
        assert np.allclose(got, [im.extract(x) for x in stack], rtol=1e-9, atol=1e-9)


def test_small_rows_of_much_work_are_spread(spark):
    """A small table of numbers is one split of its file: its pictures still go to as many tasks as there are cores, and to more as rows grow."""
    from scrivane.operators.parts import spread

    assert images.pattern_images(spark.range(0, 40, 1, 1), 8).rdd.getNumPartitions() == 4
    assert [spread(spark.range(0, n, 1, 1), 10).rdd.getNumPartitions() for n in (0, 2, 40, 95)] == [1, 2, 4, 10]
    assert spread(spark.range(0, 95, 1, 1), 10).count() == 95


def test_images_of_several_sizes_in_a_batch(spark):
    sizes = [(5, 9), (20, 18), (5, 9), (9, 5), (20, 18)]
    pics = [np.random.default_rng(k).integers(0, 256, (h, w, 3)).astype(np.uint8) for k, (h, w) in enumerate(sizes)]
    df = spark.createDataFrame([(k, x.shape[1], x.shape[0], bytearray(x.tobytes())) for k, x in enumerate(pics)], "id int, width int, height int, rgb binary").coalesce(1)
    for longest in (None, 10):
        for r in images.features(df, longest=longest).collect():
            x = pics[r.id]
            assert [r[c] for c in im.names()] == pytest.approx(im.extract(im.fit_within(x, longest) if longest else x), rel=1e-9, abs=1e-9)


def test_png_is_read_back_and_redacted(spark, tmp_path):
    rgb = np.random.default_rng(3).integers(1, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(im.png(rgb))
    (tmp_path / "in/b.png").write_bytes(b"\x00\x01\x02\x03")
    rows = files.read_images(spark, str(tmp_path / "in"))
    r = rows.collect()
    assert len(r) == 1 and np.array_equal(np.frombuffer(r[0].rgb, np.uint8).reshape(20, 30, 3), rgb)
    from pyspark.sql import functions as F

    box = F.array(F.struct(F.lit(2.0).alias("x0"), F.lit(3.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(9.0).alias("y1")))
    out = images.redacted_png(rows.withColumn("boxes", box)).first().png
    (tmp_path / "out").mkdir()
    (tmp_path / "out/c.png").write_bytes(out)
    back = np.frombuffer(files.read_images(spark, str(tmp_path / "out")).first().rgb, np.uint8).reshape(20, 30, 3)
    assert (back[3:9, 2:10] == 0).all() and np.array_equal(back[10:], rgb[10:])
    assert files.read_bytes(spark, str(tmp_path / "in")).count() == 2
