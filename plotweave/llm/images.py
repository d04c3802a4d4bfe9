"""Local image descriptors: which images are cropped or edited copies of which others.

Corners are found at several scales (Harris measure, the strongest of each scale, their number in proportion to the area), get an orientation
from their patch's intensity centroid, and are described by binary tests between blurred places of the patch, turned by the orientation.
Large images are worked on in tiles with margins, so that memory is bounded and no corner is lost at a tile's edge.

Descriptors that differ in DISTANCE bits at most match. They have BANDS = DISTANCE + 1 bands of 64 bits, so two that match are equal in one
band at least: tables on the bands lose no match, and bands that long seldom meet by chance. Queries and images that meet with AGREE corners or more are compared as a whole: all
Hamming distances between their corners, then the largest number of matches that agree on one similarity transform. Pairs with
AGREE such matches or more are copies.

An image is read once: the pass gives its digest and its corners in one value, and only digests, bands and the corners of pairs that met
are shuffled. Images with equal bytes form a class; the result has pairs between queries and classes' smallest ids, and each row's
membership. Band rows are written only for bands that some query has, as far as a bit table of fixed size can tell; the join then compares
the bands themselves, so nothing is lost.

Defined cases: a null, empty or unreadable image has no corners and no copies (equal ones still share a class); plain images and images smaller
than a patch have none either; a null id can't be in a class or a query; repeated rows are in one class, equal queries are searched once and reported for
each id; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm import bytewords
from plotweave.llm.common import bit_table, discard, perhaps_in, store

#: Pixels (of the scaled image) a corner, corners of a scale at least, the scales, patch radius, binary tests, bands of their bits.
SPARSE, FEW, SCALES, RADIUS, TESTS, BANDS = 200, 12, (1.0, 0.7, 0.5), 12, 256, 4
#: Bits in which matching descriptors may differ: fewer than there are bands.
DISTANCE = BANDS - 1
#: Matches that must agree on a transform; how far they may lie from it: pixels, radians, powers of two.
AGREE, PIXELS, ANGLE, POWER = 6, 6.0, 0.3, 0.3
#: Tiles of a scaled image, and their margin: patch, smoothing and gradient.
TILE, MARGIN = 1_024, RADIUS + 6
#: A corner as bytes: x, y (in the whole image), scale, angle, bits.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "<u4", TESTS // 32)])
#: Digests that a task remembers, so as to describe copies once; images and corner lists that it works on at once.
SEEN, SLICE = 200_000, 256


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM, or of an 8-bit grey, RGB or RGBA PNG without interlace; None if it is none of these."""
    try:
        if raw[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                if raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at)
                    continue
                end = at
                while end < len(raw) and not raw[end : end + 1].isspace():
                    end += 1
                fields.append(int(raw[at:end]))
                at = end
            w, h, _ = fields
            planes = 3 if raw[:2] == b"P6" else 1
            return np.frombuffer(raw, np.uint8, w * h * planes, at + 1).reshape(h, w, planes).mean(axis=2)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            at, data = 8, b""
            while at < len(raw):
                size, kind = struct.unpack(">I4s", raw[at : at + 8])
                body = raw[at + 8 : at + 8 + size]
                if kind == b"IHDR":
                    w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
                data += body if kind == b"IDAT" else b""
                at += size + 12
            planes = {0: 1, 2: 3, 6: 4}[colour]
            if depth != 8 or laced:
                return None
            flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * planes)
            out = np.zeros((h, w * planes), np.uint8)
            for y in range(h):
                out[y] = _unfilter(int(flat[y, 0]), flat[y, 1:], out[y - 1] if y else np.zeros(w * planes, np.uint8), planes)
            return out.reshape(h, w, planes)[:, :, : min(planes, 3)].mean(axis=2)
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        pass
    return None


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    out = np.zeros(len(row), np.int64)
    for i in range(len(row)):
        left, up, corner = (out[i - step] if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
        guess = left + up - corner
        paeth = min((abs(guess - v), k, v) for k, v in enumerate((left, up, corner)))[2]
        out[i] = (int(row[i]) + {1: left, 3: (left + up) // 2, 4: paeth}[kind]) & 255
    return out.astype(np.uint8)


def encode(grey: np.ndarray) -> bytes:
    """A binary PGM."""
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def blur(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1 places, edges repeated."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge")
    p = p.cumsum(axis=0).cumsum(axis=1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def window(a: np.ndarray, scale: float, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """Rows y0 to y1 and columns x0 to x1 of the image at a scale, by linear interpolation."""
    if scale == 1.0:
        return a[y0:y1, x0:x1]
    y, x = (np.minimum((np.arange(i, j) + 0.5) / scale - 0.5, m - 1).clip(0) for i, j, m in ((y0, y1, a.shape[0]), (x0, x1, a.shape[1])))
    top, left = y.astype(int), x.astype(int)
    bottom, right, fy, fx = np.minimum(top + 1, a.shape[0] - 1), np.minimum(left + 1, a.shape[1] - 1), (y - top)[:, None], x - left
    return (a[top][:, left] * (1 - fx) + a[top][:, right] * fx) * (1 - fy) + (a[bottom][:, left] * (1 - fx) + a[bottom][:, right] * fx) * fy


def _tests() -> np.ndarray:
    """The places of the binary tests, from a fixed seed: two points in the patch each."""
    r = np.random.default_rng(20_000)
    return np.clip(r.normal(0, RADIUS / 2, (TESTS, 2, 2)), -RADIUS + 1, RADIUS - 1)


_PLACES = _tests()
_DISC = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1), indexing="ij"), -1).reshape(-1, 2)
_DISC = _DISC[(_DISC**2).sum(axis=1) <= RADIUS**2]


def _corners(a: np.ndarray, own: tuple[int, int, int, int], most: int) -> tuple[np.ndarray, ...]:
    """strength, y, x, angle and bits of the strongest corners whose place is in own (y0, y1, x0, x1) of a window."""
    gy, gx = np.gradient(blur(a, 1))
    xx, yy, xy = blur(gx * gx, 2), blur(gy * gy, 2), blur(gx * gy, 2)
    measure = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    y0, y1, x0, x1 = own
    inner = measure[y0:y1, x0:x1]
    around = np.max([measure[y0 + i : y1 + i, x0 + j : x1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    y, x = np.nonzero((inner == around) & (inner > 1.0))
    strongest = np.argsort(-inner[y, x], kind="stable")[:most]
    strength, y, x = inner[y, x][strongest], y[strongest] + y0, x[strongest] + x0
    patch = a[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
    angle = np.arctan2((patch * _DISC[:, 0]).sum(axis=1), (patch * _DISC[:, 1]).sum(axis=1))
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    dy, dx = _PLACES[None, :, :, 0], _PLACES[None, :, :, 1]
    ty = np.rint(s * dx + c * dy).astype(int).clip(-RADIUS, RADIUS) + y[:, None, None]
    tx = np.rint(c * dx - s * dy).astype(int).clip(-RADIUS, RADIUS) + x[:, None, None]
    smooth = blur(a, 2)
    bits = np.packbits(smooth[ty[:, :, 0], tx[:, :, 0]] < smooth[ty[:, :, 1], tx[:, :, 1]], axis=1)
    return strength, y, x, angle, bits


def describe(grey: np.ndarray | None) -> np.ndarray:
    """The corners of an image (CORNER)."""
    out = [np.zeros(0, CORNER)]
    for scale in SCALES if grey is not None else ():
        h, w = (n if scale == 1.0 else max(int(n * scale), 1) for n in grey.shape)
        edge = RADIUS + 1
        if min(h, w) < 2 * edge + 2:
            continue
        most, found = max(h * w // SPARSE, FEW), []
        for top in range(edge, h - edge, TILE):
            for left in range(edge, w - edge, TILE):
                bottom, right = min(top + TILE, h - edge), min(left + TILE, w - edge)
                y0, x0 = max(top - MARGIN, 0), max(left - MARGIN, 0)
                a = window(grey, scale, y0, min(bottom + MARGIN, h), x0, min(right + MARGIN, w))
                strength, y, x, angle, bits = _corners(a, (top - y0, bottom - y0, left - x0, right - x0), most)
                found.append((strength, y + y0, x + x0, angle, bits))
        strength, y, x, angle, bits = (np.concatenate(v) for v in zip(*found, strict=True))
        strongest = np.argsort(-strength, kind="stable")[:most]
        rows = np.zeros(len(strongest), CORNER)
        rows["x"], rows["y"], rows["scale"], rows["angle"] = x[strongest] / scale, y[strongest] / scale, scale, angle[strongest]
        rows["bits"] = np.ascontiguousarray(bits[strongest]).view("<u4")
        out.append(rows)
    return np.concatenate(out)


def agreeing(q: np.ndarray, i: np.ndarray) -> int:
    """The most corners of a query that match corners of an image under one similarity transform (CORNER both)."""
    close = np.bitwise_count(q["bits"][:, None, :] ^ i["bits"][None, :, :]).sum(axis=2, dtype=np.int64) <= DISTANCE
    a, b = np.nonzero(close)
    if len(a) < AGREE:
        return 0
    q, i = q[a], i[b]
    turn = i["angle"].astype(np.float64) - q["angle"]
    grow = q["scale"].astype(np.float64) / i["scale"]
    c, s = np.cos(turn) * grow, np.sin(turn) * grow
    # each match is a transform; column k: where it puts match k's corner, and how far that is from the image's
    dx, dy = q["x"][None, :].astype(np.float64) - q["x"][:, None], q["y"][None, :].astype(np.float64) - q["y"][:, None]
    px = i["x"][:, None] + c[:, None] * dx - s[:, None] * dy
    py = i["y"][:, None] + s[:, None] * dx + c[:, None] * dy
    off = np.hypot(px - i["x"][None, :], py - i["y"][None, :])
    bend = np.abs((turn[None, :] - turn[:, None] + np.pi) % (2 * np.pi) - np.pi)
    ok = (off <= PIXELS * np.maximum(grow, 1)[:, None]) & (bend <= ANGLE) & (np.abs(np.log2(grow[None, :] / grow[:, None])) <= POWER)
    best = 0
    for k in np.argsort(-ok.sum(axis=1), kind="stable").tolist():
        if ok[k].sum() <= best:
            break
        places = np.unique(np.stack([q["x"][ok[k]], q["y"][ok[k]]]), axis=1).shape[1], np.unique(np.stack([i["x"][ok[k]], i["y"][ok[k]]]), axis=1).shape[1]
        best = max(best, min(places))
    return best


def described(images: DataFrame, load=None) -> DataFrame:
    """id, one, two (the digest of the bytes), corners (of the first rows of a digest that a task sees, else null).

    images: id, image. load makes an image's bytes of its id and the value in image, where that isn't the bytes themselves.
    """

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):  # so that a task holds few images at once
                batch = whole.slice(begin, SLICE)
                names, corners = [], []
                for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = raw.as_py() if load is None else load(row, raw.as_py())
                    name = hashlib.blake2b(raw or b"", digest_size=16).digest()
                    names.append(name)
                    corners.append(None if name in seen else describe(decode(raw)).tobytes())
                    if len(seen) < SEEN:
                        seen.add(name)
                key = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(corners, pa.binary())], ["id", "one", "two", "corners"])

    return store(images.select("id", "image").mapInArrow(run, "id long, one long, two long, corners binary"), "images")


def banded(found: DataFrame) -> DataFrame:
    """one, number (of the corner), band (its 64 bits and place, mixed to one number) of each image with corners."""

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                rows = [np.frombuffer(x, CORNER)["bits"] for x in batch.column(1).to_pylist()]
                sizes = np.array([len(x) for x in rows], dtype=np.int64)
                words = np.ascontiguousarray(np.concatenate([np.zeros((0, TESTS // 32), "<u4"), *rows])).view("<u8").astype(np.uint64)
                band = bytewords.mix(words + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).reshape(-1)
                number = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes * BANDS)), pa.array(np.repeat(number, BANDS).astype(np.int32)), pa.array(band)], ["one", "number", "band"])

    return found.filter("length(corners) > 0").select("one", "corners").mapInArrow(run, "one long, number int, band long")


def copies(images: DataFrame, queries: DataFrame, load=None, load_query=None) -> tuple[DataFrame, DataFrame]:
    """(query, match, pairs): each query id, the smallest ids of the classes it is a copy of, and the corners that agree; and id, rep of all images.

    images and queries: id, image; load and load_query as in described(). Equal images are no copies of one another here: they are one class.
    """
    index, asked = described(images.filter("id is not null"), load), described(queries.filter("id is not null"), load_query)
    probes = store(banded(asked).distinct(), "probes")
    kept, flag = perhaps_in(banded(index), F.xxhash64("band"), bit_table(probes.select(F.xxhash64("band").alias("id"))))
    rows = kept.filter(flag).select("band", F.col("one").alias("i")).distinct()
    met = probes.select("band", "number", F.col("one").alias("q")).join(rows, "band").select("q", "i", "number").distinct()
    pairs = store(met.groupBy("q", "i").count().filter(F.col("count") >= AGREE).select("q", "i"), "pairs")
    # one value for each digest; two digests that share their first half are kept apart by the second
    one_of = lambda rows, x: rows.filter("corners is not null").join(pairs.select(F.col(x).alias("one")).distinct(), "one", "left_semi").groupBy(F.col("one").alias(x), F.col("two").alias(f"{x}2")).agg(F.first("corners").alias(f"{x}_corners"))
    both = pairs.join(one_of(asked, "q"), "q").join(one_of(index, "i"), "i").filter("not (q = i and q2 = i2)")

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                n = [agreeing(np.frombuffer(a, CORNER), np.frombuffer(b, CORNER)) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                ok = pa.array([x >= AGREE for x in n])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(ok) for k in range(4)), pa.array(n, pa.int64()).filter(ok)], ["q", "q2", "i", "i2", "pairs"])

    discard(probes)
    matched = store(both.select("q", "q2", "i", "i2", "q_corners", "i_corners").mapInArrow(run, "q long, q2 long, i long, i2 long, pairs long"), "matched")
    discard(pairs)
    members = index.groupBy("one", "two").agg(F.min("id").alias("rep")).join(index.select("one", "two", "id").distinct(), ["one", "two"])
    reps = members.filter("id = rep").select(F.col("one").alias("i"), F.col("two").alias("i2"), F.col("rep").alias("match"))
    found = matched.join(reps, ["i", "i2"]).join(asked.select(F.col("one").alias("q"), F.col("two").alias("q2"), F.col("id").alias("query")).distinct(), ["q", "q2"])
    return found.select("query", "match", "pairs"), members.select("id", "rep")


def rendered(vector, size: int = 96, waves: int = 24) -> np.ndarray:
    """An image of a vector, for tables that have no images: waves whose directions, lengths and phases the vector gives."""
    v = np.asarray(vector, dtype=np.float64)
    if not len(v) or not np.isfinite(v).all() or not np.abs(v).max():
        return np.full((size, size), 128.0)
    u = (np.sin(v / np.abs(v).max() * 37.0) + 1) / 2  # spreads near values apart
    pick = lambda o: u[(5 * np.arange(waves) + o) % len(u)]
    turn, often, phase = 2 * np.pi * pick(0), 0.03 + 0.1 * pick(17), 2 * np.pi * pick(41)
    at = 2 * np.pi * np.arange(size)[:, None]
    across, down = at * (often * np.cos(turn)), at * (often * np.sin(turn)) + phase
    field = np.cos(down) @ np.cos(across).T - np.sin(down) @ np.sin(across).T  # the sum of the waves' cosines
    return 128 + 100 * field / np.abs(field).max()


def edited(grey: np.ndarray, number: int) -> np.ndarray:
    """A copy as an editor might make it: cropped (each fourth one to two thirds of the sides), with other contrast, and for odd numbers turned by a quarter."""
    h, w = grey.shape
    if number % 4 == 3:
        top, left = h * (number % 5) // 12, w * (number % 3) // 6
        cut = grey[top : top + 2 * h // 3, left : left + 2 * w // 3]
    else:
        cut = grey[h // 12 + number % 5 : h - h // 14, w // 14 : w - w // 12 - number % 4]
    cut = cut * 0.85 + 18
    return np.rot90(cut) if number % 2 else cut


def image_of(name: int, vector: list | None) -> bytes | None:
    return None if vector is None else encode(rendered([0.0 if x is None else x for x in vector]))


def edited_image_of(name: int, vector: list | None) -> bytes | None:
    return None if vector is None else encode(edited(rendered([0.0 if x is None else x for x in vector]), name // 20))


def digest(vectors: DataFrame) -> DataFrame:
    """kind, a, b, pairs: 'match' rows with a query's id and the smallest id of a class it is a copy of; 'member' rows with an id and its class's smallest id.

    Queries are the edited copies of all rows whose id is divisible by 20. The images are rendered where they are described.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("image"))
    found, reps = copies(rows, rows.filter("id % 20 = 0"), image_of, edited_image_of)
    return (
        found.select(F.lit("match").alias("kind"), F.col("query").alias("a"), F.col("match").alias("b"), "pairs")
        .union(reps.select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("rep").alias("b"), F.lit(None).cast("long").alias("pairs")))
    )
