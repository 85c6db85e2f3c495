"""Rotations, poses, cameras and points as column expressions; matrices are row-major arrays of 9, poses structs (r, t)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def dot(a: Column, b: Column, n: int = 3) -> Column:
    total = at(a, 0) * at(b, 0)
    for i in range(1, n):
        total = total + at(a, i) * at(b, i)
    return total


def unit(a: Column) -> Column:
    return let(F.greatest(F.sqrt(dot(a, a)), F.lit(FLOOR)), lambda n: F.transform(a, lambda x: x / n))


def cross(a: Column, b: Column) -> Column:
    pairs = ((1, 2), (2, 0), (0, 1))
    return F.array(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in pairs])


def rot6d_to_matrix(r: Column) -> Column:
    """First two rows of a rotation, made orthonormal by Gram-Schmidt; the third is their cross product."""

    def second(b1):
        raw = F.slice(r, 4, 3)
        rest = let(dot(b1, raw), lambda d: F.zip_with(raw, b1, lambda x, y: x - d * y))
        return let(unit(rest), lambda b2: F.concat(b1, b2, cross(b1, b2)))

    return let(unit(F.slice(r, 1, 3)), second)


def matrix_to_rot6d(m: Column) -> Column:
    return F.slice(m, 1, 6)


def transpose(m: Column) -> Column:
    return F.array(*[at(m, 3 * j + i) for i in range(3) for j in range(3)])


def matmul(a: Column, b: Column) -> Column:
    return F.array(*[
        at(a, 3 * i) * at(b, j) + at(a, 3 * i + 1) * at(b, 3 + j) + at(a, 3 * i + 2) * at(b, 6 + j) for i in range(3) for j in range(3)
    ])


def matvec(m: Column, v: Column) -> Column:
    return F.array(*[at(m, 3 * i) * at(v, 0) + at(m, 3 * i + 1) * at(v, 1) + at(m, 3 * i + 2) * at(v, 2) for i in range(3)])


def pose(xyz: Column, rot6d: Column) -> Column:
    return F.struct(rot6d_to_matrix(rot6d).alias("r"), xyz.alias("t"))


def pose_split(p: Column) -> Column:
    return F.struct(p["t"].alias("xyz"), matrix_to_rot6d(p["r"]).alias("rot6d"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def invert(p: Column) -> Column:
    """Rigid inverse: transposed rotation, and minus it times the translation."""
    return let(p, lambda q: let(transpose(q["r"]), lambda rt: F.struct(rt.alias("r"), F.transform(matvec(rt, q["t"]), lambda x: -x).alias("t"))))


def from_matrix16(m: Column) -> Column:
    """A 4x4 row-major transform; its bottom row must be 0 0 0 1."""
    fine = (F.abs(at(m, 12)) < 1e-6) & (F.abs(at(m, 13)) < 1e-6) & (F.abs(at(m, 14)) < 1e-6) & (F.abs(at(m, 15) - 1) < 1e-6)
    r = F.array(*[at(m, 4 * i + j) for i in range(3) for j in range(3)])
    t = F.array(*[at(m, 4 * i + 3) for i in range(3)])
    return F.when(fine, F.struct(r.alias("r"), t.alias("t"))).otherwise(F.raise_error(F.lit("not a rigid transform")))


def compose(a: Column, b: Column) -> Column:
    return F.struct(matmul(a["r"], b["r"]).alias("r"), add(matvec(a["r"], b["t"]), a["t"]).alias("t"))


def relative_pose(p: Column, ref: Column) -> Column:
    """The pose seen from the reference pose."""
    return let(invert(ref), lambda q: compose(q, p))


def absolute_pose(rel: Column, ref: Column) -> Column:
    return compose(ref, rel)


def rpy_to_matrix(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rz(yaw) Ry(pitch) Rx(roll), radians."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    )


def xyzrpy_to_pose(v: Column) -> Column:
    bad = F.raise_error(F.lit("six numbers are needed"))
    p = F.struct(rpy_to_matrix(at(v, 3), at(v, 4), at(v, 5)).alias("r"), F.slice(v, 1, 3).alias("t"))
    return F.when(F.size(v) == 6, p).otherwise(bad)


def wrap_to_pi(d: Column) -> Column:
    return F.pmod(d + F.pi(), 2 * F.pi()) - F.pi()


def tool_offset(xyz: Column, rot6d: Column, offset: float = 0.22) -> Column:
    """The point `offset` along the hand's z axis."""
    m = rot6d_to_matrix(rot6d)
    return let(m, lambda r: F.array(*[at(xyz, i) + at(r, 3 * i + 2) * offset for i in range(3)]))


def scale_intrinsics(k: Column, source: tuple[int, int], target: tuple[int, int], how: str = "center_crop") -> Column:
    """(fx, fy, cx, cy) after resizing from source to target (width, height): center_crop, stretch or fit."""
    (w0, h0), (w, h) = source, target
    if how == "stretch":
        sx, sy, ox, oy = w / w0, h / h0, 0.0, 0.0
    elif how in ("center_crop", "fit"):
        sx = sy = (max if how == "center_crop" else min)(w / w0, h / h0)
        ox, oy = (w - w0 * sx) / 2, (h - h0 * sy) / 2
    else:
        raise ValueError(f"resize {how}")
    return F.array(at(k, 0) * sx, at(k, 1) * sy, at(k, 2) * sx + ox, at(k, 3) * sy + oy)


def project_points(points: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """points(x, y, z, ...) in front of the camera -> u, v and the marker radius in pixels, 3 to 7."""
    radius = F.greatest(F.lit(3.0), F.least(F.lit(7.0), F.lit(0.5 * (fx + fy) * 0.01) / F.col("z")))
    return (
        points.where("z > 0")
        .withColumn("u", fx * F.col("x") / F.col("z") + cx)
        .withColumn("v", fy * F.col("y") / F.col("z") + cy)
        .withColumn("radius", radius)
    )


def backproject_depth(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, camera: Column, low: float, high: float,
                      ground: float | None = None, every: int = 1) -> DataFrame:
    """pixels(u, v, depth, ...) in the depth range -> world points (wx, wy, wz); optionally above a ground height only
    and of every n-th pixel row and column."""
    rows = pixels.where((F.col("depth") > low) & (F.col("depth") < high) & (F.col("u") % every == 0) & (F.col("v") % every == 0))
    p = F.array((F.col("u") - cx) * F.col("depth") / fx, (F.col("v") - cy) * F.col("depth") / fy, F.col("depth"))
    rows = rows.withColumn("_w", add(matvec(camera["r"], p), camera["t"]))
    rows = rows.withColumn("wx", at(F.col("_w"), 0)).withColumn("wy", at(F.col("_w"), 1)).withColumn("wz", at(F.col("_w"), 2)).drop("_w")
    return rows if ground is None else rows.where(F.col("wz") > ground)


def undistort_fisheye(x: Column, y: Column, d: tuple[float, float, float, float], most: float | None = None) -> Column:
    """Normalized fisheye coordinates -> pinhole ones, struct (x, y); beyond radius `most` unchanged."""
    r = F.sqrt(x * x + y * y + 1e-8)
    poly = 1 + d[0] * F.pow(r, 2) + d[1] * F.pow(r, 4) + d[2] * F.pow(r, 6) + d[3] * F.pow(r, 8)
    scale = F.when(r > 1e-8, F.tan(r / poly) / r).otherwise(1.0)
    if most is not None:
        scale = F.when(r <= most, scale).otherwise(1.0)
    return let(scale, lambda s: F.struct((x * s).alias("x"), (y * s).alias("y")))


#: Fixed values of the point-map format: offset of signed millimetres in 16 bits.
MAP_OFFSET, MAP_MM = 32768, 1000.0


def encode_point_map(metres: Column, depth: Column, low: float, high: float) -> Column:
    mm = F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), metres * MAP_MM)) + MAP_OFFSET
    return F.when((depth > low) & (depth < high), mm).otherwise(F.lit(float(MAP_OFFSET))).cast("int")


def decode_point_map(code: Column) -> Column:
    return (code - MAP_OFFSET) / MAP_MM


def farthest_points(n: int, width: int = 6):
    """Column function: an array of points, x, y, z first and `width` numbers each -> exactly n of them by farthest-point
    sampling on xyz from the first one on (ties to the earlier point), zeros where there are fewer; null for null.

    Each choice depends on those before it; a row is the cloud of one image, and a batch of rows is one call."""

    @F.pandas_udf("array<array<double>>")
    def sample(clouds: pd.Series) -> pd.Series:
        out = []
        for cloud in clouds:
            if cloud is None:
                out.append(None)
                continue
            points = np.array([np.asarray(p, float) for p in cloud], float).reshape(-1, width)
            xyz, got = points[:, :3], np.zeros((n, width))
            gap, pick = np.full(len(xyz), np.inf), 0
            for k in range(min(n, len(xyz))):
                got[k] = points[pick]
                gap = np.minimum(gap, ((xyz - xyz[pick]) ** 2).sum(axis=1))
                gap[pick] = -1
                pick = int(gap.argmax())
            out.append(got.tolist())
        return pd.Series(out)

    return sample


def farthest_point_sample(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """points(keys, i, x, y, z, r, g, b) -> exactly n rows of each key, as farthest_points takes them in the order of i.
    A key is one image, whose points are few."""
    columns = ["x", "y", "z", "r", "g", "b"]
    one = F.struct("i", F.array(*[F.col(c).cast("double") for c in columns]).alias("p"))
    clouds = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["p"]).alias("cloud"))
    rows = clouds.select(*keys, F.posexplode(farthest_points(n)("cloud")).alias("i", "p"))
    return rows.select(*keys, "i", *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(columns)])
