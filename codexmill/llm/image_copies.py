"""Cropped and edited copies of images by local descriptors.

Corners are Harris maxima, at scales a quarter of an octave apart down to the size
of a patch, whose patch is more than a smooth surface: of its contrast at least
``STRUCTURE`` is left when the best quadratic surface is taken out (slopes and bowls
look alike in all images). Each is turned upright by the direction from its centre to
the patch's centre of mass, and described by 256 binary tests between smoothed points
of the patch less its slope, so brightness, contrast and rotation leave it alone.

Descriptors join through Hamming tables: each table takes ``KEY_BITS`` of the bits,
drawn once for all, and descriptors that agree in them meet in a list. Matches of a
list that are near vote for the rotation, scale and shift that they imply; two images
with ``HINTS`` coherent matches are a candidate. A candidate is judged by all corners of
both images, whatever lists they are in: it links if ``AGREEING`` corners match and
agree on one transform. The tables are an index: a copy is missed where fewer than
``HINTS`` of its corners keep the bits of a table (README gives the measured recall).

Images of equal pixels are one class first. As in the n-gram join, each list is
tried against its least image, and every image judged with the leader that it shares
most with; only images that this leaves in different components are joined inside a
list, in a second round. So a cluster of copies costs as many pairs as members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written
from .components import components

#: Scales an octave, corners described at a time, and half the width of a patch.
STEPS, AT_ONCE, RADIUS = 4, 2000, 8
#: Least share of a patch's contrast that no quadratic surface explains.
STRUCTURE = 0.3
#: Hamming tables, and the bits that each takes.
TABLES, KEY_BITS = 8, 112
#: Bits in which descriptors differ at most: matches of a list, and matches of two images that are judged.
NEAR, MOST_BITS = 16, 20
#: Coherent matches of a candidate, and corners that must agree.
HINTS, AGREEING = 2, 6
#: The bin of shifts in pixels and of rotations in degrees.
SHIFT_BIN, TURN_BIN = 8, 30

_rng = np.random.default_rng(20)
#: Ends of the 256 tests inside the patch.
TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (256, 4)), -RADIUS + 1, RADIUS - 1)
#: Bits of each table.
CHOSEN = [np.sort(_rng.permutation(256)[:KEY_BITS]) for _ in range(TABLES)]
_spot = np.arange(-RADIUS, RADIUS + 1)
DISC = (_spot[:, None] ** 2 + _spot[None, :] ** 2) <= RADIUS**2
#: Places of the disc, and the powers of a quadratic surface there.
_dy, _dx = (g[DISC].astype(float) for g in np.meshgrid(_spot, _spot, indexing="ij"))
SURFACE = np.linalg.qr(np.stack([np.ones_like(_dx), _dx, _dy, _dx * _dx, _dx * _dy, _dy * _dy], 1))[0]
#: A corner: descriptor, place, scale and angle in degrees.
CORNER = np.dtype([("d", "<u8", 4), ("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4")])


def _box(images: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r+1, edges repeated."""
    p = np.pad(images, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge")
    c = p.cumsum(1).cumsum(2)
    w = 2 * r + 1
    return (c[:, w:, w:] - c[:, :-w, w:] - c[:, w:, :-w] + c[:, :-w, :-w]) / w**2


def _shrunk(images: np.ndarray, scale: float) -> np.ndarray:
    """Images at ``1 / scale`` of their size: each pixel the mean of four points between the old ones."""
    h, w = images.shape[1:]

    def along(stack: np.ndarray, n: int, axis: int) -> np.ndarray:
        centre = (np.arange(int(n / scale)) + 0.5) * scale - 0.5
        total = 0
        for at in (centre - scale / 4, centre + scale / 4):
            first = np.clip(np.floor(at).astype(int), 0, n - 2)
            part = np.clip(at - first, 0, 1)
            part = part[:, None] if axis == 1 else part
            total = total + stack.take(first, axis) * (1 - part) + stack.take(first + 1, axis) * part
        return total / 2

    return along(along(images, h, 1), w, 2)


def _at_scale(images: np.ndarray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All corners of a stack of equally large images, some at a time: number of the image, corner."""
    h, w = images.shape[1:]
    base = _box(images, 1)
    gy, gx = np.gradient(base, axis=(1, 2))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    power = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = np.zeros_like(power, bool)
    inner[:, RADIUS:-RADIUS, RADIUS:-RADIUS] = True
    p = np.pad(power, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    peak = inner & (power > 1e-6)
    for dy in range(3):
        for dx in range(3):
            if (dy, dx) != (1, 1):
                peak &= power > p[:, dy : dy + h, dx : dx + w]
    i, y, x = np.nonzero(peak)
    smooth = _box(base, 1)
    for at in range(0, len(i), AT_ONCE):
        yield _described(base, smooth, scale, *(a[at : at + AT_ONCE] for a in (i, y, x)))


def _described(base: np.ndarray, smooth: np.ndarray, scale: float, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    patch = base[i[:, None], y[:, None] + _dy.astype(int), x[:, None] + _dx.astype(int)]
    apart = patch - patch.mean(1, keepdims=True)
    whole = (apart**2).sum(1)
    keep = whole - ((apart @ SURFACE) ** 2).sum(1) >= STRUCTURE * whole
    i, y, x, patch, apart = i[keep], y[keep], x[keep], patch[keep], apart[keep]
    angle = np.arctan2(patch @ _dy, patch @ _dx)
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    slope_x, slope_y = ((apart @ d / (d @ d))[:, None] for d in (_dx, _dy))

    def sample(tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
        """Values between pixels at turned points of the patch, less its slope."""
        dx, dy = cos * tx - sin * ty, sin * tx + cos * ty
        px, py = (np.clip(c[:, None] + d, 0, n - 1.001) for c, d, n in ((x, dx, smooth.shape[2]), (y, dy, smooth.shape[1])))
        x0, y0, n = px.astype(int), py.astype(int), i[:, None]
        fx, fy = px - x0, py - y0
        top = smooth[n, y0, x0] * (1 - fx) + smooth[n, y0, x0 + 1] * fx
        low = smooth[n, y0 + 1, x0] * (1 - fx) + smooth[n, y0 + 1, x0 + 1] * fx
        return top * (1 - fy) + low * fy - slope_x * dx - slope_y * dy

    out = np.empty(len(i), CORNER)
    bits = sample(TESTS[:, 0], TESTS[:, 1]) < sample(TESTS[:, 2], TESTS[:, 3])
    out["d"] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(i), 4)
    out["x"], out["y"], out["scale"], out["angle"] = (x + 0.5) * scale - 0.5, (y + 0.5) * scale - 0.5, scale, np.degrees(angle)
    return i, out


def corners_of(stack: np.ndarray) -> list[np.ndarray]:
    """The corners of each of a stack of equally large grey images."""
    found, level, now = [], 0, stack
    # An octave starts from the one before, so that no pixel is passed over.
    while min(now.shape[1:]) > 2 * RADIUS + 1:
        found += _at_scale(now, 2 ** (level / STEPS))
        level += 1
        if level % STEPS == 0:
            stack = now = _shrunk(stack, 2)
        else:
            now = _shrunk(stack, 2 ** (level % STEPS / STEPS))
    if not found:
        return [np.empty(0, CORNER)] * len(stack)
    image, corner = (np.concatenate([f[k] for f in found]) for k in range(2))
    order = np.argsort(image, kind="stable")
    return np.split(corner[order], np.searchsorted(image[order], np.arange(1, len(stack))))


def table_keys(corners: np.ndarray) -> np.ndarray:
    """A key of each corner for each table: a hash of the table's bits."""
    bits = np.unpackbits(np.ascontiguousarray(corners["d"]).view(np.uint8).reshape(len(corners), 32), axis=1, bitorder="little")
    rows = [np.packbits(bits[:, chosen], axis=1) for chosen in CHOSEN]
    return np.array([[xxhash.xxh64_intdigest(r.tobytes(), seed=t) for r in table] for t, table in enumerate(rows)], np.uint64).reshape(TABLES, len(corners)).T


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The most corners of ``a`` whose matches in ``b`` imply one similarity transform.

    A match turns b by the difference of angles and scales it by the ratio of scales;
    what is left is the shift. Votes go to bins that overlap by half, so that equal
    transforms meet in one; a bin counts each corner of ``a`` once.
    """
    ia, ib = [], []
    step = max(1, 4_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        d = np.zeros((len(a[at : at + step]), len(b)), np.uint16)
        for k in range(4):
            d += np.bitwise_count(a["d"][at : at + step, None, k] ^ b["d"][None, :, k])
        i, j = np.nonzero(d <= MOST_BITS)
        ia.append(i + at)
        ib.append(j)
    i, j = np.concatenate(ia or [np.empty(0, int)]), np.concatenate(ib or [np.empty(0, int)])
    if len(np.unique(i)) < AGREEING:
        return 0
    a, b = a[i], b[j]
    turn = (a["angle"].astype(float) - b["angle"]) % 360
    steps = np.round(STEPS * np.log2(a["scale"] / b["scale"])).astype(int)
    size, rad = 2.0 ** (steps / STEPS), np.radians(turn)
    sx = a["x"] - size * (np.cos(rad) * b["x"] - np.sin(rad) * b["y"])
    sy = a["y"] - size * (np.sin(rad) * b["x"] + np.cos(rad) * b["y"])
    half = [np.floor(v / w * 2).astype(int) for v, w in ((sx, SHIFT_BIN), (sy, SHIFT_BIN), (turn, TURN_BIN))]
    most = 0
    for dx in (0, 1):
        for dy in (0, 1):
            for dt in (0, 1):
                bins = np.stack([steps, half[0] - dx, half[1] - dy, (half[2] - dt) % (720 // TURN_BIN), i], 1)
                once = np.unique(bins, axis=0)[:, :4]
                most = max(most, np.unique(once, axis=0, return_counts=True)[1].max())
    return int(most)


def described(images: DataFrame, id_col: str, pixels: str, width: str, height: str) -> DataFrame:
    """``(img, n, corners)`` of images of grey bytes, row by row: number of corners, and they as bytes.

    Images that are null, of other size than they say, or smaller than a patch have no corner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            by_shape: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
            for name, raw, w, h in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if raw is not None and w and h and w > 0 and len(raw) == w * h:
                    by_shape.setdefault((h, w), []).append((name, raw))
            for (h, w), some in by_shape.items():
                step = max(1, 2_000_000 // (h * w))
                for at in range(0, len(some), step):
                    part = some[at : at + step]
                    stack = np.frombuffer(b"".join(r for _, r in part), np.uint8).reshape(-1, h, w).astype(float)
                    found = corners_of(stack)
                    cols = [pa.array([n for n, _ in part], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["img", "n", "corners"])

    rows = images.select(F.col(id_col).cast("long"), F.col(pixels).cast("binary"), F.col(width).cast("int"), F.col(height).cast("int"))
    return rows.mapInArrow(run, "img long, n long, corners binary")


def _entries(found: DataFrame) -> DataFrame:
    """``(key, img, corner)``: the entries of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
            own = [np.frombuffer(c, CORNER) for c in batch.column(1).to_pylist()]
            n = np.array([len(c) for c in own], int)
            keys = table_keys(np.concatenate(own))
            img = np.repeat(batch.column(0).to_numpy(), n)
            corner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cols = [keys.ravel().astype(np.int64), np.repeat(img, TABLES), np.repeat(corner, TABLES).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "img", "corner"])

    return found.where("n > 0").select("img", "corners").mapInArrow(run, "key long, img long, corner int")


def _single(found: DataFrame) -> DataFrame:
    """``(img, corner, d0..d3, x, y, scale, angle)``: one row a corner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
            own = [np.frombuffer(c, CORNER) for c in batch.column(1).to_pylist()]
            n = np.array([len(c) for c in own], int)
            whole = np.concatenate(own)
            cols = [np.repeat(batch.column(0).to_numpy(), n), (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)]
            cols += [np.ascontiguousarray(whole["d"][:, k]).astype(np.int64) for k in range(4)] + [np.ascontiguousarray(whole[c]) for c in ("x", "y", "scale", "angle")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["img", "corner", "d0", "d1", "d2", "d3", "x", "y", "scale", "angle"])

    return found.where("n > 0").select("img", "corners").mapInArrow(run, "img long, corner int, d0 long, d1 long, d2 long, d3 long, x float, y float, scale float, angle float")


def _hints(left: DataFrame, right: DataFrame, other) -> DataFrame:
    """``(a, b, n)``: images with ``HINTS`` coherent matches in the lists that they share, and the most of them."""
    end = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "key"])
    apart = sum((F.bit_count(F.col(f"d{i}_a").bitwiseXOR(F.col(f"d{i}_b"))) for i in range(1, 4)), F.bit_count(F.col("d0_a").bitwiseXOR(F.col("d0_b"))))
    a, b = end(left, "a"), end(right, "b")
    both = a.join(b, (a["key"] == b["key"]) & other & (apart <= NEAR))
    turn = F.pmod(F.col("angle_a").cast("double") - F.col("angle_b"), F.lit(360.0))
    steps = F.round(STEPS * F.log2(F.col("scale_a") / F.col("scale_b"))).cast("int")
    size, rad = F.pow(F.lit(2.0), F.col("size") / STEPS), F.radians("turn")
    halves = lambda v, w: F.array(F.floor(v / w * 2), F.floor(v / w * 2) - 1)
    votes = both.select(F.col("img_a").alias("a"), F.col("img_b").alias("b"), F.col("corner_a").alias("ca"), turn.alias("turn"), steps.alias("size"), *[F.col(f"{c}_{s}").alias(f"{c}{s}") for c in "xy" for s in "ab"])
    votes = votes.select("a", "b", "ca", "size", F.col("turn").alias("t"), (F.col("xa") - size * (F.cos(rad) * F.col("xb") - F.sin(rad) * F.col("yb"))).alias("sx"), (F.col("ya") - size * (F.sin(rad) * F.col("xb") + F.cos(rad) * F.col("yb"))).alias("sy"))
    # Matches of one pair of images meet, once each; most pairs have a single one and go before votes are made.
    met = votes.groupBy("a", "b").agg(F.collect_set(F.struct("ca", "size", "t", "sx", "sy")).alias("m")).where(F.size("m") >= HINTS)
    votes = met.select("a", "b", F.explode("m").alias("m")).select("a", "b", "m.*")
    for c, w in (("sx", SHIFT_BIN), ("sy", SHIFT_BIN), ("t", TURN_BIN)):
        votes = votes.withColumn(c, F.explode(halves(F.col(c), w)))
    binned = votes.groupBy("a", "b", "size", "sx", "sy", F.pmod("t", F.lit(720 // TURN_BIN)).alias("t")).agg(F.countDistinct("ca").alias("n"))
    return binned.where(F.col("n") >= HINTS).groupBy("a", "b").agg(F.max("n").alias("n"))


def _judged(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of which enough corners agree, by all their corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(*(batch.column(c).to_pylist() for c in ("ca", "cb")), strict=True)
            keep = pa.array([agreeing(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) >= AGREEING for x, y in ends], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    end = lambda s: found.select(F.col("img").alias(s), F.col("corners").alias(f"c{s}"))
    return pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long")


def copy_links(found: DataFrame) -> DataFrame:
    """``(node, component)`` of the described images that hang together; images without links are not in it."""
    entries = _entries(found)
    lists = entries.groupBy("key").agg(F.min("img").alias("lo"), F.max("img").alias("hi")).where("lo <> hi").select("key", "lo")
    shared = written(entries.join(lists, "key"), "image-lists")
    placed = written(shared.join(_single(found), ["img", "corner"]), "image-entries")
    removed(shared)

    leaders, others = placed.where("img = lo").drop("lo"), placed.where("img <> lo").drop("lo")
    tried = written(_hints(leaders, others, F.lit(True)), "image-hints")
    # Each image with the leader that it shares most with.
    best = tried.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    links = written(_judged(best, found), "image-links")

    known = components(links)
    comps = placed.drop("lo").join(known.withColumnRenamed("node", "img"), "img", "left").withColumn("comp", F.coalesce("component", "img")).drop("component")
    open_ = comps.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("key")
    still = written(comps.join(open_, "key", "left_semi"), "image-open")
    pairs = _hints(still, still, (F.col("img_a") < F.col("img_b")) & (F.col("comp_a") != F.col("comp_b")))
    more = written(_judged(pairs.join(best, ["a", "b"], "left_anti"), found), "image-links2")
    removed(still, placed, tried)
    if not more.isEmpty():
        removed(known)
        known = components(links.unionByName(more))
    removed(links, more)
    return known


def copy_groups(images: DataFrame, id_col: str = "id", pixels: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """Per row: id, ``n_corners`` and ``group_id``, the least id of the images it hangs together with.

    Images of equal pixels and size are copies; others link when ``AGREEING``
    corners agree on one transform. A null image is a group by itself, as is one
    without corners unless it has equals; null ids belong to a group but do not name
    one, and a class of equal images whose ids are all null links with its equals
    only. An empty table gives no rows.
    """
    shape = [F.col(c).cast("int") for c in (width, height)]
    key = [F.xxhash64(F.col(pixels), *shape).alias("c1"), F.xxhash64(F.lit(1), F.col(pixels), *shape).alias("c2")]
    rows = written(images.select(F.col(id_col).cast("long").alias("id"), *key, F.col(pixels).isNull().alias("none")), "image-rows")
    classes = written(rows.where("not none").groupBy("c1", "c2").agg(F.min("id").alias("img")), "image-classes")
    one = images.select(F.col(id_col).cast("long").alias("img"), *key, F.col(pixels).alias("pixels"), shape[0].alias("w"), shape[1].alias("h"))
    keyed = one.join(classes.where("img is not null"), ["c1", "c2", "img"]).dropDuplicates(["img", "c1", "c2"])
    found = written(described(keyed, "img", "pixels", "w", "h"), "corners")
    known = copy_links(found)

    named = classes.join(known.withColumnRenamed("node", "img"), "img", "left").join(found.select("img", "n"), "img", "left")
    named = named.select("c1", "c2", F.coalesce("component", "img").alias("group_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_corners"))
    out = rows.join(named, (rows["c1"] == named["c1"]) & (rows["c2"] == named["c2"]) & ~rows["none"], "left")
    out = written(out.select(F.col("id").alias(id_col), F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"), F.coalesce("group_id", "id").alias("group_id")), "image-groups")
    removed(rows, classes, found, known)
    return out


def rendered(vectors: DataFrame, id_col: str, vector: str, side: int = 64) -> DataFrame:
    """``(id, pixels, width, height)``: a grey image from each vector of 64 numbers, as 8 by 8 cosine coefficients.

    Tables of the driver hold no images; this makes textured ones, equal or near
    where the vectors are. A null vector, or one of other length, gives a null image.
    """
    at = (np.arange(side) + 0.5) / side
    wave = np.cos(np.pi * np.outer(np.arange(1, 9), at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            out = []
            for v in batch.column(1).to_pylist():
                if v is None or len(v) != 64 or any(x is None for x in v):
                    out.append(None)
                    continue
                field = wave.T @ np.array(v, float).reshape(8, 8) @ wave
                spread = np.abs(field).max()
                out.append(np.rint(127.5 + 127 * field / (spread if spread > 0 else 1)).astype(np.uint8).tobytes())
            size = pa.array(np.full(len(out), side, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), size, size], names=["id", "pixels", "width", "height"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector)).mapInArrow(run, "id long, pixels binary, width int, height int")
