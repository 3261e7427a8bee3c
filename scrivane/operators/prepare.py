"""Data preparation: labels from dataset names and tags, generated and augmented images, alignment of recognised words to the truth, noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crf

LABELS = tuple(f"is_{x}" for x in "document digital paper crumpled shadow".split())
#: Labels of whole datasets, by the name of their directory.
DATASETS = {k: tuple(map(int, bits)) for k, bits in {"fatura2": "11000", "cord-v2": "10100", "srd": "10100", "coco": "00000", "negatives": "00000"}.items()}
TAGS = "O TABLE LOGO DATE NUMBER SELLER_ADDRESS TOTAL TITLE SELLER_NAME SUB_TOTAL BUYER DUE_DATE NOTE PAYMENT_DETAILS".split()
SELLER, PAYMENT = 5, 13
_KINDS = (("EMAIL", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}"), ("PHONE", r"^[+]\([0-9]{3}\)[0-9]{3}-[0-9]{4}"), ("ZIP", r"^[0-9]{5}(-[0-9]{4})?$"))


def dataset_labels(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Files (filename as dataset/name) with the five labels of their dataset; a fixed table of a few rows is broadcast."""
    table = spark.createDataFrame([(k, *v) for k, v in DATASETS.items()], "dataset string, " + ", ".join(f"{x} int" for x in LABELS))
    return files.withColumn("dataset", F.element_at(F.split("filename", "/"), 1)).join(F.broadcast(table), "dataset").select("filename", *LABELS)


def variants(files: DataFrame, per_kind: int, seed: int = 42) -> DataFrame:
    """The first `per_kind` files of a fixed shuffle, once for a shadow and once for a crumple variant."""
    order = files.select("filename").orderBy(F.xxhash64("filename", F.lit(seed)), "filename").limit(per_kind)
    kinds = F.explode(F.array(F.lit("shadow"), F.lit("crumple"))).alias("kind")
    bit = lambda k: (F.col("kind") == k).cast("int")
    return order.select("filename", kinds).select("filename", "kind", F.lit(1).alias("is_document"), F.lit(0).alias("is_digital"), F.lit(1).alias("is_paper"), bit("crumple").alias("is_crumpled"), bit("shadow").alias("is_shadow"))


def shadowed(rgb: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A shadow from a corner, from the sides or around the middle."""
    y, x = np.mgrid[0 : 1 : rgb.shape[0] * 1j, 0 : 1 : rgb.shape[1] * 1j]
    mask = ((x + y) / 2, np.minimum(x, 1 - x), np.clip(1 - np.hypot(x - 0.5, y - 0.5) / np.sqrt(2), 0, 1))[rng.integers(3)]
    return np.clip(rgb * (1 - rng.uniform(0.3, 0.7) * mask[..., None]), 0, 255).astype(np.uint8)


def _stroke(shape: tuple[int, int], a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """Pixels within width / 2 of a segment (points as x, y)."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    d = b - a
    t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(float(d @ d), 1e-9), 0, 1)
    return np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) <= width / 2


def _blur(plane: np.ndarray, sigma: float) -> np.ndarray:
    r = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        plane = np.apply_along_axis(np.convolve, axis, np.pad(plane, pad, mode="edge"), k, "valid")
    return plane


def crumpled(rgb: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Blurred dark creases from the borders to the middle, some of them with a second leg."""
    h, w = rgb.shape[:2]
    mask = np.zeros((h, w), bool)
    for _ in range(int(rng.integers(5, 13))):
        side = rng.integers(4)
        a = np.array([(rng.uniform(0, w), 0), (rng.uniform(0, w), h - 1), (0, rng.uniform(0, h)), (w - 1, rng.uniform(0, h))][side], float)
        b = np.array([rng.uniform(0.2, 0.8) * w, rng.uniform(0.2, 0.8) * h])
        width = rng.uniform(15, 35)
        mask |= _stroke((h, w), a, b, width)
        if rng.random() < 0.5:
            mask |= _stroke((h, w), b, np.array([rng.uniform(0, w), rng.uniform(0, h)]), max(8.0, width - rng.uniform(5, 20)))
    dark = _blur(mask * (128 / 255), 8.0) * rng.uniform(0.4, 0.75)
    return np.clip(rgb * (1 - dark[..., None]), 0, 255).astype(np.uint8)


def _page(rng: np.random.Generator, size: int, paper: bool) -> np.ndarray:
    base = rng.integers(230, 256, 3).astype(float) * ([1.0, 0.95, 0.88] if paper else 1.0)
    rgb = np.tile(base, (size, size, 1))
    if paper:
        rgb += rng.integers(-8, 9, rgb.shape)
    ink = rng.integers(0, 60, 3)
    rows = int(rng.integers(8, 18))
    for k in range(1, rows + 1):
        y, x = k * size // (rows + 1), size // 60
        while x < size - 4:
            length = int(rng.integers(max(size // 100, 1), max(size // 25, 2) + 1))
            rgb[y : y + int(rng.integers(1, 4)), x : x + length] = ink
            x += length + int(rng.integers(1, max(size // 50, 1) + 1))
    return np.clip(rgb, 0, 255).astype(np.uint8)


def generated(kind: str, rng: np.random.Generator, size: int) -> np.ndarray:
    """An image of a kind: digital, paper, crumpled, shadow, solid, gradient, noise or natural."""
    if kind in ("digital", "paper"):
        return _page(rng, size, kind == "paper")
    if kind in ("crumpled", "shadow"):
        return (crumpled if kind == "crumpled" else shadowed)(_page(rng, size, True), rng)
    if kind == "solid":
        return np.tile(rng.integers(0, 256, 3).astype(np.uint8), (size, size, 1))
    noise = rng.integers(0, 256, (size, size, 3))
    if kind == "noise":
        return noise.astype(np.uint8)
    t = np.linspace(0, 1, size)[:, None, None]
    a, b = rng.integers(0, 256, 3), rng.integers(0, 256, 3)
    ramp = np.broadcast_to(a * (1 - t) + b * t, (size, size, 3))
    if kind == "gradient":
        return ramp.astype(np.uint8)
    soft = np.stack([_blur(noise[..., c].astype(float), 3.0) for c in range(3)], 2)
    return np.clip(0.5 * ramp + 2 * (soft - 127) + 64, 0, 255).astype(np.uint8)


SETS = {"digital": (60, (1, 1, 0, 0, 0)), "paper": (60, (1, 0, 1, 0, 0)), "crumpled": (30, (1, 0, 1, 1, 0)), "shadow": (30, (1, 0, 1, 0, 1)), "natural": (80, (0,) * 5)}
NEGATIVES = {k: (1, (0,) * 5) for k in ("solid", "gradient", "noise")}


def synthetic_images(spark: SparkSession, sets: dict[str, tuple[int, tuple[int, ...]]] | None = None, size: int = 128, seed: int = 42) -> DataFrame:
    """(id, width, height, rgb, labels): generated in parallel, each image from its own seed."""
    sets = sets or SETS
    plan = [(f"{k}_{i:04d}", k, i, *y) for k, (n, y) in sets.items() for i in range(n)]
    df = spark.createDataFrame(plan, "id string, kind string, i int, " + ", ".join(f"{x} int" for x in LABELS))
    order = list(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [generated(k, np.random.default_rng([seed, order.index(k), i]), size).tobytes() for k, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([size] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array(raw, pa.binary()), *(batch.column(k) for k in range(3, 8))], ["id", "width", "height", "rgb", *LABELS])

    return df.repartition(8).mapInArrow(run, "id string, width int, height int, rgb binary, " + ", ".join(f"{x} int" for x in LABELS))


def refined_labels(tokens: DataFrame, key: str) -> DataFrame:
    """Token tags as sequence labels. tokens: (key, i, token, tag); adds `label`.

    Runs of the seller's address and of payment details are numbered by the changes of tag before them, in the order in which they then are windows. A run is cut at its first street number (or after
    its first street suffix, in seller runs): words before are a name. Payment runs without any sign of an address get only
    plain kinds.
    """
    core = F.lower(F.rtrim("token", F.lit(",.")))
    w = Window.partitionBy(key).orderBy("i")
    changed = (~F.col("tag").eqNullSafe(F.lag("tag").over(w))).cast("int")
    df = tokens.withColumn("_change", changed).withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_core", core)
    run = Window.partitionBy(key, "_run")
    number = F.substring("_core", 1, 1).rlike("[0-9]") & F.length("_core").between(1, 5)
    bare_number = F.substring("token", 1, 1).rlike("[0-9]") & F.length("token").between(1, 5)
    suffix = F.col("_core").isin(sorted(crf.SUFFIXES))
    cut = F.when(F.col("tag") == SELLER, F.when(number, F.col("i")).when(suffix, F.col("i") + 1)).otherwise(F.when(bare_number, F.col("i")))
    # The first cutting token decides, not the least cut.
    df = df.withColumn("_cut", F.min_by(cut, F.when(cut.isNotNull(), F.col("i"))).over(run))
    sign = suffix | (F.upper("_core").isin(sorted(crf.STATES)) & (F.length("_core") == 2)) | F.col("_core").isin(sorted(crf.DIRECTIONS)) | (F.col("_core").rlike(r"^[0-9]{5}(-[0-9]{4})?$") & (F.count("*").over(run) == 1))
    df = df.withColumn("_signed", F.max(sign.cast("int")).over(run) == 1)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(_KINDS):
        kind = F.when(F.col("token").rlike(pattern), name).otherwise(kind)
    digits = F.col("token").rlike("^[0-9]+$")
    account = F.when(digits & F.length("token").between(6, 20), "ACCOUNT")
    short_account = F.when(digits & F.length("token").between(4, 20), "ACCOUNT")
    word = F.col("token").rlike(r"^\p{L}{2,}$")
    before = F.col("_cut").isNull() | (F.col("i") < F.col("_cut"))
    seller = F.when(before, F.when(word, "NAME").otherwise("ADDRESS")).otherwise(F.coalesce(kind, F.lit("ADDRESS")))
    plain = F.coalesce(kind, account)
    payment = F.when(~F.col("_signed"), plain).when(before, F.coalesce(plain, F.when(word, "NAME"))).otherwise(F.coalesce(plain, F.lit("ADDRESS")))
    label = F.when(F.col("tag") == SELLER, seller).when(F.col("tag") == PAYMENT, F.coalesce(payment, short_account))
    return df.withColumn("label", F.coalesce(label, F.lit("O"))).drop("_change", "_run", "_core", "_cut", "_signed")


def drop_unlabelled(tokens: DataFrame, key: str) -> DataFrame:
    """Sequences with at least one label other than O."""
    some = tokens.where("label <> 'O'").select(key).distinct()
    return tokens.join(some, key, "left_semi")


def line_positions(words: DataFrame, key: str) -> DataFrame:
    """Words (key, i, y0) with their place in the line: first, mid, last or single, and its length. Lines are bands of 20 pixels."""
    band = F.floor(F.col("y0") / 20)
    w = Window.partitionBy(key, "_band").orderBy("i")
    n, k = F.count("*").over(Window.partitionBy(key, "_band")), F.row_number().over(w)
    pos = F.when(n == 1, "single").when(k == 1, "first").when(k == n, "last").otherwise("mid")
    return words.withColumn("_band", band).withColumn("line_pos", pos).withColumn("line_len", n).drop("_band")


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    cost = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        corner, cost[0] = cost[0], i
        for j, y in enumerate(b, 1):
            corner, cost[j] = cost[j], min(cost[j] + 1, cost[j - 1] + 1, corner + (x != y))
    return cost[-1]


def align(found: list[str], truth: list[str], ahead: int = 5) -> list[tuple[int, int]]:
    """(place in truth, place in found): each true token takes the nearest of the next words, if it is near enough."""
    out, at = [], 0
    for k, token in enumerate(truth):
        near = [(levenshtein(token.lower(), found[j].lower()), j) for j in range(at, min(at + ahead, len(found)))]
        if near and min(near)[0] <= max(3, len(token) // 2):
            at = min(near)[1]
            out.append((k, at))
            at += 1
    return out


def aligned(pairs: DataFrame, key: str) -> DataFrame:
    """(key, found: array, truth: array) as rows (key, truth_i, found_i, word). One document is one row, so nothing is grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, t, f, word = [], [], [], []
            for k, (found, truth) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b in align(found or [], truth or []):
                    at.append(k)
                    t.append(a)
                    f.append(b)
                    word.append(found[b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(t, pa.int32()), pa.array(f, pa.int32()), pa.array(word, pa.string())], [key, "truth_i", "found_i", "word"])

    return pairs.select(key, "found", "truth").mapInArrow(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, truth_i int, found_i int, word string")


_SWAPS = dict(p for a, b in ("Il", "O0", "S5", "B8") for p in ((a, b), (b, a))) | {"1": "l"}


def noisy(tokens: DataFrame, key: str, copies: int = 2, seed: int = 42, drop: float = 0.10, error: float = 0.15) -> DataFrame:
    """Variants of token rows (key, i, token, label): some tokens dropped, some with one wrong character. Draws are hashes of the row (the first 32
    bits of an MD5 sum), so they repeat in any run and any engine."""
    df = tokens.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("i").cast("string"), F.col("variant").cast("string"), F.lit(str(seed)), F.lit(str(k)))), 1, 8), 16, 10).cast("double") / 2.0**32
    at = (F.floor(draw(2) * F.length("token")) + 1).cast("int")
    old = F.substr("token", at, F.lit(1))
    swap = F.create_map(*[F.lit(x) for p in _SWAPS.items() for x in p])
    other = F.substr(F.lit("aeiouAEIOU809"), (F.floor(draw(3) * 13) + 1).cast("int"), F.lit(1))
    new = F.coalesce(F.try_element_at(swap, old), F.when(old.rlike(r"\p{L}"), other).otherwise(old))
    wrong = (draw(1) < error) & (F.length("token") >= 3)
    broken = F.concat(F.substr("token", F.lit(1), at - 1), new, F.substr("token", at + 1, F.length("token")))
    return df.where(draw(0) >= drop).withColumn("token", F.when(wrong, broken).otherwise(F.col("token")))

