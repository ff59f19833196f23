"""Near-copies of images by local descriptors.

Images are binary PGM or PPM.  On every level of a pyramid, corners are found by the smaller eigenvalue of the gradient's
structure matrix; each corner's patch is turned by the direction of its intensity centroid and compared at fixed pairs
of points, which gives 128 bits.  The tables are keyed by two neighbouring corners of a level: the same 36 bits of both
descriptors, other ones in each table, the way from one corner to the other and the turn between them, the latter two in
eighths and relative to the first corner, so that moved, turned and cropped copies keep the key.
Two images that meet are compared: all descriptors within ``NEAR`` bits are matched, matches vote for a turn, a scale
and a shift, and enough votes for one place them as copies, cropped or edited.

Images with equal pixels are one vertex.  An image is first held against one other, of the smallest fingerprints of its
keys the one that it shares most keys with; then all pairs that share a key and are not linked yet are compared, the
members of a frequent key in blocks.  So the classes are those of comparing every pair that shares a key.  Copies that
share none, as strongly edited ones may, are found with ``exhaustive``: all pairs that are not linked yet are compared,
so the classes are those of comparing every pair; the work grows with the square of the images.

Defined results: null or unreadable images have no corners and are a class of their own; images without corners match
equal pixels only; a class is named by its smallest id; rows without an id are left out; repeated rows, and rows of one id with several
images, are each described by their own pixels; images of any size are compared in blocks of corners; an empty table
gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.components import connected_components
from wordloom.llm.shared import map_batches, map_in_arrow, materialise

LEVELS, RADIUS = 3, 6
#: A corner's response as a share of the image's strongest.
RESPONSE = 0.02
BITS, WORDS = 128, 4
#: Nearest corners of a level that a corner is paired with, and sectors of ways and turns.
NEIGHBOURS, SECTORS = 4, 8
#: Tables of keys, and bits of a descriptor in the keys of each.
TABLES, KEY_BITS = 12, 36
#: Hamming distance of a match, and matches that must agree on a place.
NEAR, VOTES = 16, 6
#: Members of a key that meet in one block; corners that are compared at once; placements that are tried at once.
BLOCK, CORNERS, TRIES = 256, 512, 32
#: Pairs of corners that are looked at together over several images.
CELLS = 1 << 18
SHIFT_BIN, TURNS, SCALE_BIN = 4.0, 16, 0.25
TURN_BIN = 2 * np.pi / TURNS

#: Kind, width, height and largest sample, with white space or comments between, and one white space after.
HEADER = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)++(\d{1,9})(?:\s|#[^\n]*\n)++(\d{1,9})(?:\s|#[^\n]*\n)++(\d{1,9})\s")

_PAIRS = np.random.default_rng(20240101).normal(0, RADIUS / 2.2, (BITS, 4)).clip(-RADIUS + 1, RADIUS - 1)
#: A table's bits of a descriptor, as two 64-bit words; tables of one dealing have no bit in common.
_DEALT = [x[at : at + KEY_BITS] for x in (np.random.default_rng((20240102, k)).permutation(BITS) for k in range(TABLES)) for at in range(0, BITS - KEY_BITS + 1, KEY_BITS)]
_MASKS = [np.packbits(np.isin(np.arange(BITS), x)).view("<u8") for x in _DEALT[:TABLES]]
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID[0] ** 2 + _GRID[1] ** 2 <= RADIUS**2).astype(np.float64)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values 0..1 of a binary PGM or PPM with 8 bits a sample."""
    if not (head := HEADER.match(raw or b"")):
        return None
    channels = {b"P5": 1, b"P6": 3}[head[1]]
    w, h, top = map(int, head.groups()[1:])
    if not (w and h and 0 < top < 256 and len(raw) - head.end() >= w * h * channels):
        return None
    return np.frombuffer(raw, np.uint8, w * h * channels, head.end()).reshape(h, w, channels).mean(2) / top


def encode(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5 %d %d 255\n" % (w, h) + (grey.clip(0, 1) * 255).round().astype(np.uint8).tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sector(x: np.ndarray) -> np.ndarray:
    return np.floor(x % (2 * np.pi) / (2 * np.pi) * SECTORS).astype(np.uint64) % np.uint64(SECTORS)


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(x, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        x = (np.take(p, range(x.shape[axis]), axis) + 2 * x + np.take(p, range(2, x.shape[axis] + 2), axis)) / 4
    return x


def corners(grey: np.ndarray) -> np.ndarray:
    """(row, column) of local maxima of the smaller eigenvalue, away from the edge."""
    if min(grey.shape) < 2 * RADIUS + 3:
        return np.zeros((0, 2), np.int64)
    gy, gx = np.gradient(grey)
    a, b, c = _blur(gx * gx), _blur(gx * gy), _blur(gy * gy)
    r = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    around = np.max([np.roll(r, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1)], 0)
    hit = (r >= around) & (r > max(RESPONSE * r.max(), 1e-9))
    edge = RADIUS + 1
    hit[:edge] = hit[-edge:] = False
    hit[:, :edge] = hit[:, -edge:] = False
    return np.argwhere(hit)


def describe(grey: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y, log2 scale, turn) in the full image and descriptors as four 32-bit words."""
    places, codes, level = [], [], 0
    while grey is not None and level < LEVELS:
        smooth, at = _blur(grey), corners(grey)
        if len(at):
            patch = smooth[at[:, 0, None, None] + _GRID[0], at[:, 1, None, None] + _GRID[1]] * _DISC
            turn = np.arctan2((patch * _GRID[0]).sum((1, 2)), (patch * _GRID[1]).sum((1, 2)))
            cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]

            def sample(x, y, cos=cos, sin=sin, at=at, smooth=smooth):
                return smooth[at[:, :1] + np.rint(sin * x + cos * y).astype(int).clip(-RADIUS, RADIUS), at[:, 1:] + np.rint(cos * x - sin * y).astype(int).clip(-RADIUS, RADIUS)]

            bits = sample(_PAIRS[:, 0], _PAIRS[:, 1]) < sample(_PAIRS[:, 2], _PAIRS[:, 3])
            codes.append(np.packbits(bits, axis=1).view("<u4"))
            places.append(np.stack([at[:, 1] * 2.0**level, at[:, 0] * 2.0**level, np.full(len(at), float(level)), turn], 1))
        h, w = grey.shape[0] // 2 * 2, grey.shape[1] // 2 * 2
        grey = smooth[:h, :w].reshape(h // 2, 2, w // 2, 2).mean((1, 3)) if min(h, w) >= 4 else None
        level += 1
    if not places:
        return np.zeros((0, 4)), np.zeros((0, WORDS), np.uint32)
    return np.concatenate(places), np.concatenate(codes)


def matches(a: np.ndarray, b: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes ``a`` and ``b`` that are within ``NEAR`` bits, and as near as any row of ``b`` is to that of ``a``.

    ``sizes``: the rows of ``b`` are of several images, one after another, each for itself.
    """
    out = []
    a, b = (np.ascontiguousarray(x).view("<u8") for x in (a, b))
    sizes = np.array([len(b)]) if sizes is None else sizes
    firsts = np.cumsum(sizes) - sizes
    for start in range(0, len(a), CORNERS):
        # 128 at most: a byte holds it
        apart = sum(np.bitwise_count(a[start : start + CORNERS, k, None] ^ b[None, :, k]) for k in range(WORDS // 2))
        least = np.minimum.reduceat(apart, firsts, axis=1)
        i, j = np.nonzero(apart == np.repeat(np.where(least <= NEAR, least, BITS + 1), sizes, axis=1))
        out.append((i + start, j))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def screen(a: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of the other images can have ``VOTES`` matches with ``a`` of one scale and of turns within ``TURN_BIN`` of one.

    Such turns are in three bins next to one another.  Several images are looked at together; the others are no copies.
    """
    (places, codes), can = a, np.zeros(len(others), bool)
    todo = [k for k, (p, _) in enumerate(others) if len(p) >= VOTES] if len(places) >= VOTES else []
    while todo:
        some, cells = [], 0
        while todo and (not some or cells + len(codes) * len(others[todo[-1]][0]) <= CELLS):
            some.append(todo.pop())
            cells += len(codes) * len(others[some[-1]][0])
        sizes = np.array([len(others[k][0]) for k in some])
        found = list(matches(codes, np.concatenate([others[k][1] for k in some]), sizes))
        if not len(found[0]):
            continue
        i, j = found
        theirs = np.concatenate([others[k][0][:, 2:] for k in some])[j]
        level = np.rint(4 * (theirs[:, 0] - places[i, 2])).astype(np.int64)
        level -= level.min()
        turn = np.floor((theirs[:, 1] - places[i, 3]) % (2 * np.pi) / TURN_BIN).astype(np.int64) % TURNS
        levels = int(level.max()) + 1
        owner = np.repeat(np.arange(len(some)), sizes)[j]
        count = np.bincount((owner * levels + level) * TURNS + turn, minlength=len(some) * levels * TURNS).reshape(len(some), levels, TURNS)
        can[some] = (count + np.roll(count, 1, 2) + np.roll(count, -1, 2)).max((1, 2)) >= VOTES
    return can


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Matches that agree on one turn, scale and shift from image a to image b; under ``VOTES`` they are no copies."""
    (pa_, ca), (pb, cb) = a, b
    if len(pa_) < VOTES or len(pb) < VOTES:
        return 0
    i, j = matches(ca, cb)
    if len(i) < VOTES:
        return 0
    scale, turn = pb[j, 2] - pa_[i, 2], (pb[j, 3] - pa_[i, 3] + np.pi) % (2 * np.pi) - np.pi
    if len(set(i.tolist())) < VOTES or len(set(j.tolist())) < VOTES:
        return 0
    best, (x, y), (u, v) = 0, pa_[i, :2].T, pb[j, :2].T
    # matches vote in bins of turn, scale and shift; a match of each bin, the fullest first, proposes a placement
    s0, c0, n0 = 2.0**scale, np.cos(turn), np.sin(turn)
    shift = np.stack([u - s0 * (c0 * x - n0 * y), v - s0 * (n0 * x + c0 * y)])
    bins = np.concatenate([np.rint([turn / TURN_BIN, scale / SCALE_BIN]), np.rint(shift / (4 * SHIFT_BIN))])
    _, first, count = np.unique(bins, axis=1, return_index=True, return_counts=True)
    order = first[np.argsort(-count, kind="stable")]
    for start in range(0, len(order), TRIES):
        k = order[start : start + TRIES]
        s, cos, sin = s0[k, None], c0[k, None], n0[k, None]
        dx, dy = x - x[k, None], y - y[k, None]
        off = np.hypot(u - u[k, None] - s * (cos * dx - sin * dy), v - v[k, None] - s * (sin * dx + cos * dy))
        fit = (off <= SHIFT_BIN) & (np.abs(scale - scale[k, None]) <= SCALE_BIN) & (np.abs((turn - turn[k, None] + np.pi) % (2 * np.pi) - np.pi) <= TURN_BIN)
        for most in fit[fit.sum(1) >= VOTES]:
            best = max(best, min(len(set(i[most].tolist())), len(set(j[most].tolist()))))
        if best >= VOTES:
            break
    return best


def pair_keys(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distinct keys of an image: a table's bits of both descriptors of two neighbours, their way and their turn, mixed to 64 bits."""
    out = [np.zeros(0, np.uint64)]
    for level in np.unique(places[:, 2]):
        here = np.flatnonzero(places[:, 2] == level)
        near = min(NEIGHBOURS, len(here) - 1)
        if not near:
            continue
        p, w, pairs = places[here], np.ascontiguousarray(codes[here]).view("<u8"), []
        for start in range(0, len(here), CORNERS):
            apart = np.hypot(p[start : start + CORNERS, None, 0] - p[None, :, 0], p[start : start + CORNERS, None, 1] - p[None, :, 1])
            own = np.arange(len(apart))
            apart[own, own + start] = np.inf
            pairs.append(np.stack([np.repeat(own + start, near), np.argsort(apart, 1, kind="stable")[:, :near].ravel()]))
        a, b = np.unique(np.sort(np.concatenate(pairs, 1), 0), axis=1)
        turned = [_sector(np.arctan2(p[j, 1] - p[i, 1], p[j, 0] - p[i, 0]) - p[i, 3]) * np.uint64(SECTORS) + _sector(p[j, 3] - p[i, 3]) for i, j in ((a, b), (b, a))]
        for table, (one, two) in enumerate(_MASKS):
            some = _mixed(_mixed(w[:, 0] & one) ^ (w[:, 1] & two))
            # the corner with the smaller bits comes first, in a copy too
            swap = some[a] > some[b]
            i, j = np.where(swap, b, a), np.where(swap, a, b)
            out.append(_mixed(_mixed(_mixed(some[i]) ^ some[j]) ^ (np.where(swap, *turned[::-1]) * np.uint64(TABLES) + np.uint64(table))))
    return np.unique(np.concatenate(out)).view(np.int64)


def unpacked(places: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, "<f4").reshape(-1, 4).astype(float), np.frombuffer(codes, "<u4").reshape(-1, WORDS)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of ``(fp, key)`` whose key has another row: rows go by in the order of their keys, and none is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, key, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether it has its key's from the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key = (np.concatenate([a, batch.column(k).to_numpy()]) for k, a in enumerate((fp, key)))
            same = key[1:] == key[:-1]
            keep = np.concatenate([[before], same[:-1]]) | same if len(key) > 1 else np.zeros(0, bool)
            yield pa.record_batch([pa.array(fp[:-1][keep]), pa.array(key[:-1][keep])], ["fp", "key"])
            before = bool(same[-1]) if len(same) else before
            fp, key = fp[-1:], key[-1:]
        if before:
            yield pa.record_batch([pa.array(fp), pa.array(key)], ["fp", "key"])

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_in_arrow(keyed.repartition(parts, "key").sortWithinPartitions("key", "fp"), run, "fp long, key long")


def with_first(shared: DataFrame) -> DataFrame:
    """``(fp, key, u)``: rows in the order of their keys and fps, with the smallest fp of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, u = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key = (batch.column(k).to_numpy() for k in range(2))
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(at < 0, u, fp[at])
            last, u = key[-1], first[-1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(first)], ["fp", "key", "u"])

    return map_in_arrow(shared, run, "fp long, key long, u long")


def unlinked_pairs(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct ``(u, v)``, u < v, that share a key of ``(fp, key)`` and have different labels of ``(v, c)``."""
    rows = materialise(keyed.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "key", F.coalesce("c", "fp").alias("c")), "images-labelled")
    mixed = rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("a <> z").select("key", "blocks")
    # a member goes to every pair of blocks that holds its own, so that two members meet in one of them
    placed = rows.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp", "c")
    one, two = (placed.select("key", "x", "y", *(F.col(k).alias(f"{k}{n}") for k in ("own", "fp", "c"))) for n in (1, 2))
    met = one.join(two, ["key", "x", "y"]).where("fp1 < fp2 and c1 <> c2 and (x = y or own1 <> own2)")
    return met.select(F.col("fp1").alias("u"), F.col("fp2").alias("v")).distinct()


def copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", exhaustive: bool = False) -> DataFrame:
    """``(image_id, n_corners, class_id)``; ``exhaustive`` also compares all pairs of different classes that share no key."""
    rows = images.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(image_col).cast("binary").alias("image"))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [describe(decode(x)) for x in batch.column(1).to_pylist()]
            return pa.record_batch(
                [*batch.columns, pa.array([x.astype("<f4").tobytes() for x, _ in out], pa.binary()), pa.array([c.tobytes() for _, c in out], pa.binary()), pa.array([len(x) for x, _ in out], pa.int64())],
                ["id", "image", "places", "codes", "n"],
            )

        return run

    prints = materialise(rows.select("id", F.xxhash64("image").alias("fp"), (F.col("image").isNull()).alias("blank")), "images-prints")
    first = prints.where("not blank").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    # one image a fingerprint is described; the fingerprint is carried along by a join of ids
    chosen = rows.join(first.select(F.col("rep").alias("id"), "fp"), "id").where(F.xxhash64("image") == F.col("fp")).dropDuplicates(["fp"]).select("fp", "image")
    seen = materialise(map_batches(chosen.withColumnRenamed("fp", "id"), "image", "id long, image binary, places binary, codes binary, n long", make).select(F.col("id").alias("fp"), "places", "codes", "n"), "images-seen")

    def words():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [pair_keys(*unpacked(p, c)) for p, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            fps = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            return pa.record_batch([pa.array(fps, pa.int64()), pa.array(np.concatenate(keys), pa.int64())], ["fp", "key"])

        return run

    keyed = materialise(with_first(shared_keys(map_batches(seen.select("fp", "places", "codes"), "codes", "fp long, key long", words))), "images-keys")
    shared = keyed.where("fp <> u").groupBy("u", F.col("fp").alias("v")).agg(F.count("*").alias("n"))
    pairs = materialise(shared.groupBy("v").agg(F.max(F.struct("n", "u")).alias("most")).select("most.u", "v"), "images-pairs")
    side = lambda x: seen.select(F.col("fp").alias(x), F.col("places").alias(f"p{x}"), F.col("codes").alias(f"c{x}"))

    def compare():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = np.zeros(batch.num_rows, bool)
            u = batch.column(0).to_numpy()
            pu, cu, pv, cv = (batch.column(k).to_pylist() for k in range(2, 6))
            order = np.argsort(u, kind="stable")
            for rows in np.split(order, np.flatnonzero(u[order][1:] != u[order][:-1]) + 1) if len(u) else ():
                one, others = unpacked(pu[rows[0]], cu[rows[0]]), [unpacked(pv[k], cv[k]) for k in rows]
                for k in np.flatnonzero(screen(one, others)):
                    keep[rows[k]] = consensus(one, others[k]) >= VOTES
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return run

    def verified(found: DataFrame) -> DataFrame:
        both = found.join(side("v"), "v").join(side("u"), "u").select("u", "v", "pu", "cu", "pv", "cv")
        return materialise(map_batches(both, "pu", "u long, v long", compare), "images-links")

    links = verified(pairs)
    more = unlinked_pairs(keyed.select("fp", "key"), connected_components(links)).join(pairs, ["u", "v"], "left_anti")
    if exhaustive:
        more = materialise(more, "images-pairs")
    links = links.union(verified(more))
    if exhaustive:
        every = unlinked_pairs(seen.where(F.col("n") >= VOTES).select("fp", F.lit(0).cast("long").alias("key")), connected_components(links))
        links = links.union(verified(every.join(pairs.union(more), ["u", "v"], "left_anti")))
    labels = connected_components(links)
    named = first.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", "m", F.coalesce("c", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    facts = named.join(smallest, "label").join(seen.select("fp", "n"), "fp", "left").select("fp", "m", "class_id", "n")
    facts = materialise(facts, "images-facts")
    # pixels that a thousandth of all images share: a thousand of them at most
    many = prints.count() / 1000
    heavy = F.broadcast(facts.where(F.col("m") > many).drop("m"))
    real = prints.where("not blank").select("id", "fp")
    light = real.join(heavy.select("fp"), "fp", "left_anti").join(facts.where(F.col("m") <= many).drop("m"), "fp")
    known = real.join(heavy, "fp").unionByName(light).select(F.col("id").alias("image_id"), F.col("n").alias("n_corners"), "class_id")
    blank = prints.where("blank").select(F.col("id").alias("image_id"), F.lit(0).cast("long").alias("n_corners"), F.col("id").alias("class_id"))
    return known.unionByName(blank)


def render_vectors(vectors: DataFrame, id_col: str, vector_col: str, zoom: int = 5) -> DataFrame:
    """Vectors as square grey images, filled up with zeros and enlarged by linear interpolation: the test tables have no pictures of their own."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([y if y is not None and np.isfinite(y) else 0.0 for y in v or ()])
                side = math.isqrt(max(0, len(x) - 1)) + 1 if len(x) else 0
                if not side:
                    out.append(None)
                    continue
                x = np.pad(x, (0, side * side - len(x))).reshape(side, side)
                span = float(np.abs(x).max()) or 1.0
                at = (np.arange(side * zoom) + 0.5) / zoom - 0.5
                weight = np.maximum(0, 1 - np.abs(at.clip(0, side - 1)[:, None] - np.arange(side)))
                out.append(encode(0.5 + weight @ x @ weight.T / (2 * span)))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["image_id", "image"])

    return vectors.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "image_id long, image binary")
