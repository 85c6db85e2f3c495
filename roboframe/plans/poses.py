"""Queries over vectors, poses, cameras and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V
from ..registry import query
from ..sources.views import EV, VE, messages, vectors


def r6(a):
    return F.transform(a, lambda x: F.round(x, 6) + 0.0)


def SR(a):  # noqa: N802  rounding in SQL
    return f"list_transform({a}, lambda x: round(x, 6) + 0.0)"


def rot(name: str, source: str, off: int) -> str:
    """SQL steps: m{name} = the rotation of v[off .. off + 5]."""
    return f"""a_{name} AS (SELECT *, v[{off}:{off + 2}] AS p_{name}, v[{off + 3}:{off + 5}] AS q_{name} FROM {source}),
b_{name} AS (SELECT *, list_transform(p_{name}, lambda x: x / greatest(sqrt(list_dot_product(p_{name}, p_{name})), 1e-12)) AS u_{name} FROM a_{name}),
c_{name} AS (SELECT *, list_dot_product(u_{name}, q_{name}) AS d_{name} FROM b_{name}),
e_{name} AS (SELECT *, [q_{name}[1] - d_{name} * u_{name}[1], q_{name}[2] - d_{name} * u_{name}[2], q_{name}[3] - d_{name} * u_{name}[3]] AS k_{name} FROM c_{name}),
f_{name} AS (SELECT *, list_transform(k_{name}, lambda x: x / greatest(sqrt(list_dot_product(k_{name}, k_{name})), 1e-12)) AS w_{name} FROM e_{name}),
m_{name} AS (SELECT * , [u_{name}[1], u_{name}[2], u_{name}[3], w_{name}[1], w_{name}[2], w_{name}[3], u_{name}[2] * w_{name}[3] - u_{name}[3] * w_{name}[2],
  u_{name}[3] * w_{name}[1] - u_{name}[1] * w_{name}[3], u_{name}[1] * w_{name}[2] - u_{name}[2] * w_{name}[1]] AS m{name} FROM f_{name})"""


def sql_mm(a, b):
    return "[" + ", ".join(f"{a}[{3 * i + 1}] * {b}[{j + 1}] + {a}[{3 * i + 2}] * {b}[{j + 4}] + {a}[{3 * i + 3}] * {b}[{j + 7}]" for i in range(3) for j in range(3)) + "]"


def sql_mv(a, v):
    return "[" + ", ".join(f"{a}[{3 * i + 1}] * {v}[1] + {a}[{3 * i + 2}] * {v}[2] + {a}[{3 * i + 3}] * {v}[3]" for i in range(3)) + "]"


def sql_t(a):
    return "[" + ", ".join(f"{a}[{3 * j + i + 1}]" for i in range(3) for j in range(3)) + "]"


A = f"WITH {VE}, {rot('a', 've', 4)}"
B = f"{A}, {rot('b', 'm_a', 13)}, z AS (SELECT *, v[1:3] AS ta, v[10:12] AS tb FROM m_b)"


def poses(spark, sf):
    v = vectors(spark, sf)
    return v.select(
        "vec_id",
        G.pose(F.slice("v", 1, 3), F.slice("v", 4, 6)).alias("a"),
        G.pose(F.slice("v", 10, 3), F.slice("v", 13, 6)).alias("b"),
        F.slice("v", 4, 6).alias("r6"),
        "v",
    )


@query("H01_rot6d_to_matrix", f"{A} SELECT vec_id, {SR('ma')} AS m FROM m_a")
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(G.rot6d_to_matrix(F.slice("v", 4, 6))).alias("m"))


@query("H02_matrix_to_rot6d", f"WITH {VE} SELECT vec_id, {SR('v[1:6]')} AS r FROM ve")
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(G.matrix_to_rot6d(F.slice("v", 1, 9))).alias("r"))


@query("H03_pose_compose_split", f"{A} SELECT vec_id, {SR('v[1:3]')} AS xyz, {SR('ma[1:6]')} AS rot6d FROM m_a")
def _(spark, sf):
    s = G.pose_split(F.col("a"))
    return poses(spark, sf).select("vec_id", r6(s["xyz"]).alias("xyz"), r6(s["rot6d"]).alias("rot6d"))


@query("H04_invert_transform", f"{B} SELECT vec_id, {SR(sql_t('ma'))} AS r, {SR(f'list_transform({sql_mv(sql_t(chr(109) + chr(97)), chr(116) + chr(97))}, lambda y: -y)')} AS t FROM z")
def _(spark, sf):
    i = G.invert(F.col("a"))
    return poses(spark, sf).select("vec_id", r6(i["r"]).alias("r"), r6(i["t"]).alias("t"))


@query("H05_relative_pose", f"""{B}, y AS (SELECT *, {sql_t('ma')} AS mt, [tb[1] - ta[1], tb[2] - ta[2], tb[3] - ta[3]] AS dt FROM z)
SELECT vec_id, {SR(sql_mm('mt', 'mb'))} AS r, {SR(sql_mv('mt', 'dt'))} AS t FROM y""")
def _(spark, sf):
    p = poses(spark, sf).withColumn("p", G.relative_pose(F.col("b"), F.col("a")))
    return p.select("vec_id", r6(F.col("p.r")).alias("r"), r6(F.col("p.t")).alias("t"))


@query("H06_absolute_pose", f"{B} SELECT vec_id, {SR('mb')} AS r, {SR('tb')} AS t, {SR(sql_mm('ma', 'mb'))} AS cr FROM z")
def _(spark, sf):
    p = poses(spark, sf).withColumn("rel", G.relative_pose(F.col("b"), F.col("a")))
    p = p.withColumn("p", G.absolute_pose(F.col("rel"), F.col("a"))).withColumn("c", G.absolute_pose(F.col("b"), F.col("a")))
    return p.select("vec_id", r6(F.col("p.r")).alias("r"), r6(F.col("p.t")).alias("t"), r6(F.col("c.r")).alias("cr"))


@query("H07_rpy_to_matrix", f"""WITH {VE}, a AS (SELECT vec_id, v[4] AS r, v[5] AS p, v[6] AS y FROM ve) SELECT vec_id, {SR('''[cos(y) * cos(p), cos(y) * sin(p) * sin(r) - sin(y) * cos(r), cos(y) * sin(p) * cos(r) + sin(y) * sin(r),
 sin(y) * cos(p), sin(y) * sin(p) * sin(r) + cos(y) * cos(r), sin(y) * sin(p) * cos(r) - cos(y) * sin(r), -sin(p), cos(p) * sin(r), cos(p) * cos(r)]''')} AS m FROM a""")
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(G.xyzrpy_to_pose(F.slice("v", 1, 6))["r"]).alias("m"))


@query("H08_wrap_to_pi", f"WITH {EV} SELECT event_id, round((value + pi()) - 2 * pi() * floor((value + pi()) / (2 * pi())) - pi(), 6) AS w FROM ev")
def _(spark, sf):
    return messages(spark, sf).select("event_id", F.round(G.wrap_to_pi(F.col("value")), 6).alias("w"))


@query("H09_tool_offset", f"{A} SELECT vec_id, {SR('[v[1] + ma[3] * 0.22, v[2] + ma[6] * 0.22, v[3] + ma[9] * 0.22]')} AS xyz FROM m_a")
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(G.tool_offset(F.slice("v", 1, 3), F.slice("v", 4, 6))).alias("xyz"))


@query("H13_scale_intrinsics", f"""WITH {VE} SELECT vec_id, {SR('[v[1] * 0.5, v[2] * 0.5, v[3] * 0.5 - 48.0, v[4] * 0.5]')} AS crop, {SR('[v[1] * 0.35, v[2] * 0.5, v[3] * 0.35, v[4] * 0.5]')} AS stretch,
{SR('[v[1] * 0.35, v[2] * 0.35, v[3] * 0.35, v[4] * 0.35 + 36.0]')} AS fit FROM ve""")
def _(spark, sf):
    k = F.slice("v", 1, 4)
    return vectors(spark, sf).select("vec_id", *[r6(G.scale_intrinsics(k, (640, 480), (224, 240), h)).alias(n) for n, h in (("crop", "center_crop"), ("stretch", "stretch"), ("fit", "fit"))])


@query("H14_project_points", f"""WITH {VE} SELECT vec_id, round(300 * v[1] / v[3] + 112, 4) AS u, round(310 * v[2] / v[3] + 96, 4) AS v, round(greatest(3.0, least(7.0, 3.05 / v[3])), 6) AS radius FROM ve WHERE v[3] > 0""")
def _(spark, sf):
    pts = vectors(spark, sf).select("vec_id", *[G.at(F.col("v"), i).alias(c) for i, c in enumerate("xyz")])
    p = G.project_points(pts, 300.0, 310.0, 112.0, 96.0)
    return p.select("vec_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round("radius", 6).alias("radius"))


PIX = "px AS (SELECT vec_id, v, CAST(i % 8 AS INTEGER) AS pu, CAST(i // 8 AS INTEGER) AS pv, abs(v[i + 1]) * 10 AS depth FROM ve, (SELECT unnest(range(0, 64)) AS i))"


def pixels(spark, sf):
    rows = vectors(spark, sf).select("vec_id", "v", F.posexplode("v").alias("i", "d"))
    return rows.select("vec_id", F.col("v").alias("vec"), (F.col("i") % 8).alias("u"), F.floor(F.col("i") / 8).cast("int").alias("v"), (F.abs("d") * 10).alias("depth"))


@query("H15_backproject_depth", f"""WITH {VE}, {rot('a', 've', 4)}, px AS (SELECT vec_id, ma, v[1:3] AS t, CAST(i % 8 AS INTEGER) AS u, CAST(i // 8 AS INTEGER) AS w, abs(v[i + 1]) * 10 AS depth FROM m_a, (SELECT unnest(range(0, 64)) AS i)),
q AS (SELECT *, [(u - 4) * depth / 6, (w - 4) * depth / 6, depth] AS p FROM px WHERE depth > 0.2 AND depth < 2 AND u % 2 = 0 AND w % 2 = 0),
r AS (SELECT vec_id, u, w, {sql_mv('ma', 'p')} AS p, t FROM q)
SELECT vec_id, u, w AS v, round(p[1] + t[1], 5) AS wx, round(p[2] + t[2], 5) AS wy, round(p[3] + t[3], 5) AS wz FROM r WHERE p[3] + t[3] > -0.5""")
def _(spark, sf):
    rows = pixels(spark, sf)
    vec = F.col("vec")
    rows = rows.withColumn("cam", G.pose(F.slice(vec, 1, 3), F.slice(vec, 4, 6)))
    p = G.backproject_depth(rows, 6.0, 6.0, 4.0, 4.0, F.col("cam"), 0.2, 2.0, -0.5, 2)
    return p.select("vec_id", "u", "v", *[F.round(c, 5).alias(c) for c in ("wx", "wy", "wz")])


@query("H16_undistort_fisheye", f"""WITH {VE}, r AS (SELECT vec_id, v[1] AS x, v[2] AS y, sqrt(v[1] * v[1] + v[2] * v[2] + 1e-8) AS r FROM ve),
s AS (SELECT *, CASE WHEN r <= 0.2 THEN tan(r / (1 + 0.1 * pow(r, 2) - 0.02 * pow(r, 4) + 0.003 * pow(r, 6) - 0.0001 * pow(r, 8))) / r ELSE 1.0 END AS s FROM r)
SELECT vec_id, round(x * s, 6) AS x, round(y * s, 6) AS y FROM s""")
def _(spark, sf):
    p = G.undistort_fisheye(G.at(F.col("v"), 0), G.at(F.col("v"), 1), (0.1, -0.02, 0.003, -0.0001), 0.2)
    return vectors(spark, sf).select("vec_id", p.alias("p")).select("vec_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("H17_farthest_point_sample", f"""WITH RECURSIVE {VE}, pt AS (SELECT vec_id, list_transform(range(0, 10), lambda p: v[p * 6 + 1:p * 6 + 6]) AS c FROM ve),
s AS (SELECT vec_id, c, [CAST(1 AS BIGINT)] AS picks FROM pt UNION ALL SELECT vec_id, c, list_append(picks, CAST(list_position(gap, list_max(gap)) AS BIGINT)) FROM (SELECT *,
  list_transform(range(1, 11), lambda i: CASE WHEN list_contains(picks, i) THEN -1.0 ELSE list_min(list_transform(picks, lambda p: {' + '.join(f'(c[i][{k}] - c[p][{k}]) * (c[i][{k}] - c[p][{k}])' for k in (1, 2, 3))})) END) AS gap
  FROM s WHERE len(picks) < 10))
SELECT vec_id, CAST(i AS INTEGER) AS i, {', '.join(f'round(coalesce(c[picks[i + 1]][{k + 1}], 0), 6) + 0.0 AS {n}' for k, n in enumerate('xyzrgb'))} FROM s, (SELECT unnest(range(0, 12)) AS i) WHERE len(picks) = 10""")
def _(spark, sf):
    # ten points of six channels each per vector, two more are asked for
    cloud = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda p: F.slice("v", p * 6 + 1, F.lit(6)))
    rows = vectors(spark, sf).select("vec_id", F.posexplode(G.farthest_points(12)(cloud)).alias("i", "p"))
    return rows.select("vec_id", "i", *[(F.round(F.get("p", F.lit(k)), 6) + 0.0).alias(c) for k, c in enumerate("xyzrgb")])


@query("H18_encode_point_map", f"""WITH {VE}, e AS (SELECT vec_id, CASE WHEN abs(v[2]) * 10 > 0.2 AND abs(v[2]) * 10 < 2 THEN CAST(floor(greatest(-32768.0, least(32767.0, v[1] * 1000)) + 32768) AS INTEGER) ELSE 32768 END AS code FROM ve)
SELECT vec_id, code, round((code - 32768) / 1000.0, 6) AS metres FROM e""")
def _(spark, sf):
    v = F.col("v")
    rows = vectors(spark, sf).select("vec_id", G.encode_point_map(G.at(v, 0), F.abs(G.at(v, 1)) * 10, 0.2, 2.0).alias("code"))
    return rows.select("vec_id", "code", F.round(G.decode_point_map(F.col("code")), 6).alias("metres"))


@query("B02_slice_action_vector", f"WITH {VE} SELECT vec_id, {SR('v[1:3]')} AS xyz, {SR('v[4:9]')} AS rot, {SR('v[10:10]')} AS gripper FROM ve")
def _(spark, sf):
    f = V.slice_action_vector(F.col("v"), {"xyz": 3, "rot": 9, "gripper": 10})
    return vectors(spark, sf).select("vec_id", *[r6(c).alias(n) for n, c in f.items()])


@query("B03_concat_action_vector", f"WITH {VE} SELECT vec_id, {SR('list_concat(v[10:10], v[1:3])')} AS action FROM ve")
def _(spark, sf):
    f = V.slice_action_vector(F.col("v"), {"xyz": 3, "rot": 9, "gripper": 10})
    return vectors(spark, sf).select("vec_id", r6(V.concat_action_vector(f, ["gripper", "xyz"])).alias("action"))


@query("B04_remap_indices", f"WITH {VE} SELECT vec_id, {SR('[v[8], v[2]]')} AS picked, {SR('[v[1], v[3], v[5], v[11], v[12]]')} AS ranged FROM ve")
def _(spark, sf):
    f = V.remap_indices(F.col("v"), {"picked": [7, 1], "ranged": [(0, 6, 2), (10, 12, 1)]})
    return vectors(spark, sf).select("vec_id", *[r6(c).alias(n) for n, c in f.items()])
