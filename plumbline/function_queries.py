"""Queries of the library's functions and smaller operators, each with DuckDB SQL that says the same in its own way.

Laws (a round trip, an inverse, an adjoint) have their inputs as the expected result. Results of
floating point are rounded in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import camera, superquadric
from plumbline.functions import linalg as L
from plumbline.functions import rotation as R
from plumbline.operators import aggregates, cluster, mesh, pixels, sampling, sequence, spatial
from plumbline.queries import _GRID, _events, _grid, query, r6, table
from plumbline.sources import tables
from plumbline.storage import shared_folder, stored
from plumbline.streaming import messages

# parts as angles a, b, c and points x, y, z


def _parts(spark, sf_dir) -> DataFrame:
    """Small files of rows that take long to work on: they are dealt over all cores."""
    size, price, rest = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey") % 17
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").repartition(spark.sparkContext.defaultParallelism)
    return part.select(F.col("p_partkey").alias("id"), (size / 10).alias("a"), (price / 1000).alias("b"), (rest / 5).alias("c"), size.cast("double").alias("x"), rest.cast("double").alias("y"), (price / 100).alias("z"))


_PARTS = "WITH p AS (SELECT p_partkey AS id, p_size / 10e0 AS a, p_retailprice / 1000 AS b, (p_partkey % 17) / 5e0 AS c, cast(p_size AS double) AS x, cast(p_partkey % 17 AS double) AS y, p_retailprice / 100 AS z FROM part)"


def _xyz() -> list:
    return [F.col("x"), F.col("y"), F.col("z")]


def _out(df: DataFrame, digits: int = 5, **columns) -> DataFrame:
    """id and rounded numbers; an array becomes a column for each name in its tuple, and is computed once."""
    arrays = {f"_{name}": value for name, (value, n) in columns.items() if n}
    df = df.select("*", *(L.col(value).alias(name) for name, value in arrays.items()))
    columns = {name: (F.col(f"_{name}") if n else value, n) for name, (value, n) in columns.items()}
    out = []
    for name, (value, n) in columns.items():
        out += [(F.round(value, digits) + 0.0).alias(name)] if n == 0 else [(F.round(F.get(value, F.lit(i)), digits) + 0.0).alias(f"{name}{i}") for i in range(n)]
    return df.select("id", *out)


def _sql(columns: dict[str, str | list[str]], digits: int = 5) -> str:
    """SELECT over p of rounded numbers, named as in ``_out``."""
    out = []
    for name, value in columns.items():
        out += [f"round({v}, {digits}) + 0e0 AS {name}{i}" for i, v in enumerate(value)] if isinstance(value, list) else [f"round({value}, {digits}) + 0e0 AS {name}"]
    return f"{_PARTS} SELECT id, {', '.join(out)} FROM p"


@query(_sql({"f": "1 / (2 * tan(a / 20))", "back": "a / 10", "k": ["800e0", "600e0", "320e0", "240e0"], "fx": "2 * atan(0.5 / 0.8)"}))
def focal_and_fov(spark, sf_dir):
    fov = F.col("a") / 10
    f = camera.fov_to_focal(fov)
    k = L.entries(camera.intrinsics_from_focal_center(800.0, 600.0, 320.0, 240.0), 9)
    x, _ = camera.intrinsics_to_fov(camera.intrinsics_from_focal_center(0.8, 0.6, 0.5, 0.5))
    return _out(_parts(spark, sf_dir), f=(f, 0), back=(camera.focal_to_fov(f), 0), k=(F.array(k[0], k[4], k[2], k[5]), 4), fx=(x, 0))


@query(_sql({"p": ["1 / (tan(a / 20) * 1.5)", "1 / tan(a / 20)", "(100 + 0.1) / (0.1 - 100)", "2 * 0.1 * 100 / (0.1 - 100)", "-1e0"], "near": "0.1e0", "far": "100e0"}, 4))
def perspective_matrix(spark, sf_dir):
    m = camera.perspective(F.col("a") / 10, F.lit(1.5), F.lit(0.1), F.lit(100.0))
    e = L.entries(m, 16)
    near, far = camera.perspective_to_near_far(m)
    return _out(_parts(spark, sf_dir), 4, p=(F.array(e[0], e[5], e[10], e[11], e[14]), 5), near=(near, 0), far=(far, 0))


@query(_sql({"uv": ["(x + 0.5) / 640", "(y + 0.5) / 480"], "px": ["x", "y"], "depth": "z"}))
def pixels_and_depths(spark, sf_dir):
    uv = camera.pixel_to_uv(F.col("x"), F.col("y"), 640, 480)
    back = camera.uv_to_pixel(F.get(uv, F.lit(0)), F.get(uv, F.lit(1)), 640, 480)
    depth = camera.depth_buffer_to_linear(camera.project_depth(F.col("z"), F.lit(0.1), F.lit(1000.0)), F.lit(0.1), F.lit(1000.0))
    return _out(_parts(spark, sf_dir), uv=(uv, 2), px=(back, 2), depth=(depth, 0))


@query(_sql({"eye": ["0e0", "0e0", "0e0"], "ahead": ["0e0", "0e0", "sqrt((x - 60) ** 2 + (y - 30) ** 2 + (z - 50) ** 2)"], "det": "1e0"}))
def look_at_camera(spark, sf_dir):
    """The eye is at the origin, what is looked at straight ahead, and the matrix a rotation."""
    df = _parts(spark, sf_dir).withColumn("m", camera.extrinsics_look_at(L.pack(_xyz()), L.pack([60.0, 30.0, 50.0]), L.pack([0.0, 0.0, 1.0])))
    m = F.col("m")
    return _out(df, eye=(L.apply_transform(m, L.pack(_xyz())), 3), ahead=(L.apply_transform(m, L.pack([60.0, 30.0, 50.0])), 3), det=(L.det(L.rotation_of(m)), 0))


@query(_sql({"w": ["(x + 0.5 - 320) / 800 * z + 1", "(y + 0.5 - 240) / 800 * z + 2", "z + 3"]}, 10))
def back_projection(spark, sf_dir):
    k, c2w = L.pack([800, 0, 320, 0, 800, 240, 0, 0, 1]), L.pack([1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1])
    px = _parts(spark, sf_dir).select("id", F.lit(0).alias("t"), "x", "y", F.col("z").alias("depth"))
    cameras = spark.range(1).select(F.lit(0).alias("t"), k.alias("k"), c2w.alias("c2w"))
    found = pixels.back_projected(px, cameras)
    return found.select("id", *((F.round(f"w{c}", 10) + 0.0).alias(f"w{i}") for i, c in enumerate("xyz")))


@query(_sql({"d": "20 / z", "clamped": "least(20 / z, 0.9)"}))
def plane_depths(spark, sf_dir):
    plane, ray = L.pack([0.0, 0.0, 1.0, -20.0]), L.pack([F.col("x"), F.col("y"), F.col("z")])
    return _out(_parts(spark, sf_dir), d=(F.abs(camera.plane_depth(plane, ray)), 0), clamped=(F.abs(camera.plane_depth(plane, ray, 0.9)), 0))


@query(_sql({"s": ["0e0", "-z", "y", "z", "0e0", "-x", "-y", "x", "0e0"], "cross": ["y * 3 - z * 2", "z * 1 - x * 3", "x * 2 - y * 1"], "rot": ["cos(a) * x - sin(a) * y", "sin(a) * x + cos(a) * y"], "tr": ["x + a", "y + b"]}))
def skew_and_planar(spark, sf_dir):
    p2 = L.pack([F.col("x"), F.col("y")])
    return _out(_parts(spark, sf_dir), s=(L.skew(_xyz()), 9), cross=(L.matvec(L.skew(_xyz()), [F.lit(1.0), F.lit(2.0), F.lit(3.0)], 3), 3), rot=(camera.apply_2d(camera.rotate_2d(F.col("a")), p2), 2), tr=(camera.apply_2d(camera.translate_2d(L.pack([F.col("a"), F.col("b")])), p2), 2))


@query(_sql({"q": ["x", "y", "z"], "det": "1e0", "inv": ["1e0", "0e0", "0e0", "0e0"]}))
def quaternion_laws(spark, sf_dir):
    """Turned there and back, determinant 1, q times its conjugate."""
    q = R.quat_normalize(L.pack([F.col("a") + 0.3, F.col("b"), F.col("c"), F.lit(0.7)]))
    m = R.quaternion_to_matrix(q)
    back = L.matvec(L.transpose(m, 3), R.quat_rotate(q, L.pack(_xyz())), 3)
    return _out(_parts(spark, sf_dir), q=(back, 3), det=(L.det(m), 0), inv=(R.quat_multiply(q, R.quat_conjugate(q)), 4))


@query(f"""{_PARTS}, s AS (SELECT id, sqrt((a + 0.3) ** 2 + b * b + c * c + 0.49) AS n, a, b, c FROM p), q AS (SELECT id, (a + 0.3) / n AS w, b / n AS i, c / n AS j, 0.7 / n AS k FROM s)
    SELECT id, round(1 - 2 * (j * j + k * k), 6) + 0e0 AS m0, round(2 * (i * j - k * w), 6) + 0e0 AS m1, round(2 * (i * k + j * w), 6) + 0e0 AS m2, round(2 * (i * j + k * w), 6) + 0e0 AS m3, round(1 - 2 * (i * i + k * k), 6) + 0e0 AS m4, round(2 * (j * k - i * w), 6) + 0e0 AS m5, round(2 * (i * k - j * w), 6) + 0e0 AS m6, round(2 * (j * k + i * w), 6) + 0e0 AS m7, round(1 - 2 * (i * i + j * j), 6) + 0e0 AS m8,
        round(w, 6) + 0e0 AS q0, round(i, 6) + 0e0 AS q1, round(j, 6) + 0e0 AS q2, round(k, 6) + 0e0 AS q3 FROM q""")
def quaternion_matrix(spark, sf_dir):
    q = R.quat_normalize(L.pack([F.col("a") + 0.3, F.col("b"), F.col("c"), F.lit(0.7)]))
    df = _parts(spark, sf_dir).withColumn("m", R.quaternion_to_matrix(q)).withColumn("back", R.matrix_to_quaternion("m"))
    m, back = F.col("m"), F.col("back")
    sign = F.signum(F.get(back, F.lit(0)))
    return _out(df, 6, m=(m, 9), q=(L.scale(back, sign, 4), 4))


@query(f"""{_PARTS}, t AS (SELECT id, x, y, z, a / 10 AS u, b / 10 AS v, c / 10 + 0.1 AS w FROM p), r AS (SELECT *, sqrt(u * u + v * v + w * w) AS n FROM t), k AS (SELECT *, u / n AS i, v / n AS j, w / n AS k, cos(n) AS co, sin(n) AS si, (u * x + v * y + w * z) / n AS d FROM r)
    SELECT id, round(x * co + (j * z - k * y) * si + i * d * (1 - co), 5) + 0e0 AS p0, round(y * co + (k * x - i * z) * si + j * d * (1 - co), 5) + 0e0 AS p1, round(z * co + (i * y - j * x) * si + k * d * (1 - co), 5) + 0e0 AS p2,
        round(u, 5) + 0e0 AS v0, round(v, 5) + 0e0 AS v1, round(w, 5) + 0e0 AS v2, round(u, 5) + 0e0 AS w0, round(v, 5) + 0e0 AS w1, round(w, 5) + 0e0 AS w2 FROM k""")
def axis_angles(spark, sf_dir):
    """Rodrigues' formula, and back through a matrix and a quaternion."""
    v = L.pack([F.col("a") / 10, F.col("b") / 10, F.col("c") / 10 + 0.1])
    df, m = _parts(spark, sf_dir).withColumn("m", R.axis_angle_to_matrix(v)), F.col("m")
    return _out(df, p=(L.matvec(m, _xyz(), 3), 3), v=(R.matrix_to_axis_angle(m), 3), w=(R.quaternion_to_axis_angle(R.axis_angle_to_quaternion(v)), 3))


@query(_sql({"t": ["a / 10", "b / 10 - 0.1", "c / 10"], "r": ["a / 10", "b / 10 - 0.1", "c / 10"]}))
def euler_round_trips(spark, sf_dir):
    roll, pitch, yaw = F.col("a") / 10, F.col("b") / 10 - 0.1, F.col("c") / 10
    q = R.rpy_to_quaternion(roll, pitch, yaw)
    return _out(_parts(spark, sf_dir), t=(R.quaternion_to_rpy(q), 3), r=(F.array(R.roll(q), R.pitch(q), R.yaw(q)), 3))


@query(_sql({"l": ["x + 0.25 * (a - x)", "y + 0.25 * (b - y)", "z + 0.25 * (c - z)"], "v": ["cos(c / 8)", "sin(c / 8)", "0e0"]}, 8))
def interpolations(spark, sf_dir):
    """Between two directions of a plane, a quarter of the way is a turn by a quarter of the angle."""
    ahead = L.pack([F.cos(F.col("c") / 2), F.sin(F.col("c") / 2), F.lit(0.0)])
    return _out(_parts(spark, sf_dir), 8, l=(R.lerp(L.pack(_xyz()), L.pack([F.col("a"), F.col("b"), F.col("c")]), F.lit(0.25)), 3), v=(R.slerp_vector(L.pack([1.0, 0.0, 0.0]), ahead, F.lit(0.25)), 3))


@query(_sql({"m": ["cos(c)", "-sin(c)", "sin(c)", "cos(c)"], "log": "atan2(sin(c), cos(c))", "at": ["cos(c) * x - sin(c) * y", "sin(c) * x + cos(c) * y"], "back": ["x", "y"]}))
def planar_rotations(spark, sf_dir):
    r, p = R.so2_exp(F.col("c")), L.pack([F.col("x"), F.col("y")])
    at = R.so2_apply(r, p)
    return _out(_parts(spark, sf_dir), m=(R.so2_matrix(R.so2_from_matrix(R.so2_matrix(r))), 4), log=(R.so2_log(r), 0), at=(at, 2), back=(R.so2_apply(R.so2_inverse(r), at), 2))


@query(_sql({"tan": ["a", "b", "c / 2"], "one": ["0e0", "0e0", "0e0"], "back": ["x", "y"], "m": ["x", "y"]}))
def planar_motions(spark, sf_dir):
    """SE(2): log after exp, an element times its inverse, a point there and back, and through the matrix."""
    g = R.se2_exp(L.pack([F.col("a"), F.col("b"), F.col("c") / 2]))
    p = L.pack([F.col("x"), F.col("y")])
    through = R.se2_apply(R.se2_from_matrix(R.se2_matrix(g)), p)
    return _out(_parts(spark, sf_dir), tan=(R.se2_log(g), 3), one=(R.se2_log(R.se2_multiply(g, R.se2_inverse(g))), 3), back=(R.se2_apply(R.se2_inverse(g), R.se2_apply(g, p)), 2), m=(R.se2_apply(R.se2_inverse(g), through), 2))


@query(_sql({"back": ["x", "y", "z"], "m": ["x", "y", "z"]}))
def rigid_motions(spark, sf_dir):
    """SE(3): a point there and back, and through the matrix."""
    tangent = L.pack([F.col("a"), F.col("b"), F.col("c"), F.col("a") / 10, F.col("b") / 10, F.col("c") / 10])
    moved = stored(_parts(spark, sf_dir).select("*", R.se3_exp(tangent).alias("g")), shared_folder(spark), "moved")
    there = stored(moved.select("*", R.se3_apply("g", _xyz()).alias("p"), L.apply_transform(R.se3_as_matrix("g"), L.pack(_xyz())).alias("q")), shared_folder(spark), "there")
    return _out(there, back=(R.se3_apply(R.se3_inverse("g"), "p"), 3), m=(R.se3_apply(R.se3_inverse("g"), "q"), 3))


@query(_sql({"d": "0e0", "body": ["x", "y", "z"]}))
def moved_planes(spark, sf_dir):
    """A plane through a point, moved, passes through the moved point."""
    df = _parts(spark, sf_dir).withColumn("turn", R.axis_angle_to_matrix(L.pack([F.col("a") / 10, F.col("b") / 10, F.col("c") / 10 + 0.1])))
    turn, shift = F.col("turn"), L.pack([F.col("a"), F.col("b"), F.col("c")])
    t = L.to_4x4(turn, shift)
    plane = L.pack([0.0, 0.6, 0.8, -(F.col("y") * 0.6 + F.col("z") * 0.8)])
    df = df.withColumn("moved", R.transform_plane(plane, t)).withColumn("p", L.apply_transform(t, L.pack(_xyz())))
    df = df.withColumn("there", R.points_to_world(L.pack(_xyz()), turn, shift))
    e, p, there = L.entries("moved", 4), F.col("p"), F.col("there")
    return _out(df, 4, d=(L.dot(e[:3], p) + e[3], 0), body=(R.points_to_body(there, turn, shift), 3))


@query(_sql({"p": ["2 * pow(abs(cos(c)), 0.5) * sign(cos(c)) * pow(abs(cos(a)), 0.8) * sign(cos(a))", "3 * pow(abs(cos(c)), 0.5) * sign(cos(c)) * pow(abs(sin(a)), 0.8) * sign(sin(a))", "pow(abs(sin(c)), 0.5) * sign(sin(c))"]}))
def superquadric_points(spark, sf_dir):
    return _out(_parts(spark, sf_dir), p=(superquadric.parametric(F.col("c"), F.col("a"), 0.5, 0.8, (2.0, 3.0, 1.0)), 3))


# pixels


@query(f"{_GRID} SELECT y, x, depth FROM g WHERE y % 4 = 0 AND x % 4 = 0")
def strided_pixels(spark, sf_dir):
    return pixels.strided(_grid(spark, sf_dir), 4).select("y", "x", "depth")


@query(f"""{_GRID}, e AS (SELECT g.y, g.x, any_value(g.depth) AS depth, (max(n.depth) - min(n.depth)) / any_value(g.depth) > 0.5 AS edge FROM g JOIN g n ON abs(g.y - n.y) <= 1 AND abs(g.x - n.x) <= 1 GROUP BY 1, 2),
    q AS (SELECT quantile_cont(depth, 0.8) AS top FROM g)
    SELECT y, x, CASE WHEN depth < 3 THEN 'foreground' WHEN edge OR depth > (SELECT top FROM q) OR EXISTS (SELECT 1 FROM g n WHERE n.depth < 3 AND (n.y - e.y) ** 2 + (n.x - e.x) ** 2 <= 4) THEN 'dropped' ELSE 'background' END AS kind FROM e""")
def pixel_kinds(spark, sf_dir):
    return pixels.classified(_grid(spark, sf_dir), radius=2, rtol=0.5).select("y", "x", "kind")


@query(f"{_GRID} SELECT min(y) FILTER (depth < 3) AS y0, min(x) FILTER (depth < 3) AS x0, max(y) FILTER (depth < 3) AS y1, max(x) FILTER (depth < 3) AS x1, min(depth) FILTER (depth < 3) AS least, max(depth) FILTER (depth < 3) AS greatest FROM g")
def masked_bounds(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return pixels.bounding_rect(g, ["t"]).join(pixels.masked_extremes(g, "depth", "mask", ["t"]), "t").drop("t")


@query(f"""WITH RECURSIVE {_GRID.removeprefix('WITH ')}, m AS (SELECT y * 100 + x AS id, y, x FROM g WHERE depth < 1.5), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach AS (SELECT id AS node, id AS other FROM m UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a), c AS (SELECT node, min(other) AS least FROM reach GROUP BY node)
    SELECT m.y, m.x, least AS component FROM m JOIN c ON c.node = m.id""")
def mask_components(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("mask", F.col("depth") < 1.5)
    found = pixels.components_of_mask(g, shared_folder(spark))
    return found.select("y", "x", (F.col("component.y") * 100 + F.col("component.x")).alias("component"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS y, l_suppkey % 40 AS x, l_quantity AS q FROM lineitem), m AS (SELECT y, x, avg(q) FILTER (q > 25) AS mean FROM l GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, round(mean, 6) AS depth FROM l JOIN m USING (y, x)")
def static_depths(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("y"), (F.col("l_suppkey") % 40).alias("x"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(F.lit(-1.0)).alias("depth"))
    return pixels.static_depth(seen).select("l_orderkey", "l_linenumber", r6("depth").alias("depth"))


@query(f"{_PARTS} SELECT id FROM p WHERE x > 10 AND x < 30 AND y > 3 AND y < 12")
def rectangle_selection(spark, sf_dir):
    return pixels.in_rectangle(_parts(spark, sf_dir), "x", "y", (30.0, 3.0), (10.0, 12.0)).select("id")


@query(f"{_PARTS}, v AS (SELECT id, cos(a) AS x, sin(a) * (1 + (id % 5) / 200e0) AS y, (id % 3) / 30e0 AS z FROM p) SELECT id FROM v WHERE abs(sqrt(x * x + y * y + z * z) - 1) < 0.01")
def unit_vectors(spark, sf_dir):
    v = _parts(spark, sf_dir).select("id", F.cos("a").alias("x"), (F.sin("a") * (1 + (F.col("id") % 5) / 200)).alias("y"), ((F.col("id") % 3) / 30).alias("z"))
    return pixels.valid_unit_vectors(v, ["x", "y", "z"]).select("id")


@query(f"{_PARTS}, c AS (SELECT id, cast(round_even(x / 5, 0) AS bigint) AS i, cast(round_even(y / 5, 0) AS bigint) AS j, cast(round_even(z / 5, 0) AS bigint) AS k, x, y, z FROM p), m AS (SELECT DISTINCT s_nationkey % 11 AS i FROM supplier) SELECT id FROM c WHERE x - z > 0 AND i IN (SELECT i FROM m) AND j = 1 AND k = 2")
def observed_points(spark, sf_dir):
    mask = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 11).cast("long").alias("i"), F.lit(1).cast("long").alias("j"), F.lit(2).cast("long").alias("k"))
    return pixels.observed(_parts(spark, sf_dir), mask, (0.0, 0.0, 0.0), 5.0, (1.0, 0.0, -1.0, 0.0)).select("id")


@query(f"""{_GRID}, h AS (SELECT DISTINCT cast(floor(20 * p_size / (p_retailprice / 100) + 20) AS integer) AS x, cast(floor(20 * (p_partkey % 17) / (p_retailprice / 100) + 20) AS integer) AS y FROM part WHERE p_retailprice / 100 > 0.1)
    SELECT g.y, g.x FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.x BETWEEN 0 AND 39 AND h.y BETWEEN 0 AND 39 AND (h.y - g.y) ** 2 + (h.x - g.x) ** 2 <= 9)""")
def unprojected_pixels(spark, sf_dir):
    k, still = L.pack([20, 0, 20, 0, 20, 20, 0, 0, 1]), L.identity(4)
    return pixels.unmasked_by_projection(_grid(spark, sf_dir), _parts(spark, sf_dir), k, still, 40, 40).select("y", "x")


# aggregates


@query("""WITH s AS (SELECT l_suppkey AS seg, avg(l_quantity) AS x, avg(l_discount) AS y, avg(l_tax) AS z, avg(l_quantity / 50) AS nx, avg(l_discount * 10) AS ny, avg(l_tax * 10) AS nz, count(*) AS n, count(*) FILTER (l_quantity - 2 > 0) AS v FROM lineitem GROUP BY 1)
    SELECT seg, n, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) AS n0, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) AS n1, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) AS n2, round(x, 6) AS c0, round(y, 6) AS c1, round(z, 6) AS c2 FROM s WHERE n >= 10 AND v >= 10""")
def segment_normals(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seg"), q.alias("x"), d.alias("y"), t.alias("z"), (q / 50).alias("nx"), (d * 10).alias("ny"), (t * 10).alias("nz"), (q - 2).alias("depth"))
    found = aggregates.segment_properties(p, ["seg"])
    return found.select("seg", "n", *(r6(F.get("avg_normal", F.lit(i))).alias(f"n{i}") for i in range(3)), *(r6(F.get("centroid", F.lit(i))).alias(f"c{i}") for i in range(3)))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS count FROM customer GROUP BY 1, 2 HAVING count(*) >= 3")
def label_counts(spark, sf_dir):
    return aggregates.label_histogram(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 3)


@query("SELECT event_type AS metric, round(avg(value), 6) AS mean, count(value) AS scenes FROM events WHERE event_type LIKE '%e%' GROUP BY 1")
def metric_means(spark, sf_dir):
    m = _events(spark, sf_dir).select(F.col("user_id").alias("scene"), F.col("event_type").alias("metric"), "value")
    return aggregates.mean_metrics(aggregates.named_metrics(m, F.col("metric").contains("e"))).select("metric", r6("mean").alias("mean"), "scenes")


@query("""WITH f AS (SELECT user_id AS t, avg(CASE WHEN value > 50 THEN 100e0 ELSE 0 END) AS percent_vertices, max(value) > 50 AS touched FROM events GROUP BY 1)
    SELECT t, round(percent_vertices, 6) AS percent_vertices, round((SELECT avg(CASE WHEN touched THEN 100e0 ELSE 0 END) FROM f), 6) AS percent_frames FROM f""")
def contact_percentages(spark, sf_dir):
    c = _events(spark, sf_dir).select(F.col("user_id").alias("t"), F.col("event_id").alias("v"), F.col("value").alias("score"))
    flagged = tables.contact_sequence(c, -(2**31), 2**31 - 1, 50.0)
    return aggregates.contact_report(flagged).select("t", r6("percent_vertices").alias("percent_vertices"), r6("percent_frames").alias("percent_frames"))


@query("WITH m AS (SELECT avg(p_size) AS x, avg(p_partkey % 17) AS y, avg(p_retailprice / 100) AS z FROM part) SELECT round(x / sqrt(x * x + y * y + z * z), 6) AS d0, round(y / sqrt(x * x + y * y + z * z), 6) AS d1, round(z / sqrt(x * x + y * y + z * z), 6) AS d2 FROM m")
def up_vector(spark, sf_dir):
    d = aggregates.mean_direction(_parts(spark, sf_dir))
    return d.select(*(r6(F.get("direction", F.lit(i))).alias(f"d{i}") for i in range(3)))


@query("WITH r AS (SELECT l_suppkey, median(l_extendedprice / l_quantity) AS s FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1) SELECT l_orderkey, l_linenumber, round(l_quantity * s, 3) AS depth FROM lineitem JOIN r USING (l_suppkey)")
def aligned_depths(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("depth"), "l_extendedprice")
    return aggregates.median_scale(lines, "depth", "l_extendedprice", ["l_suppkey"]).select("l_orderkey", "l_linenumber", F.round("depth", 3).alias("depth"))


@query("""WITH n AS (SELECT l_partkey AS s, l_returnflag = 'N' AS v, l_discount FROM lineitem), c AS (SELECT s, cast(v AS integer) AS v, count(*) AS k FROM n GROUP BY 1, 2), t AS (SELECT s, arg_max(v, (k, -v)) AS v, max(k) AS k, sum(k) AS total FROM c GROUP BY 1), d AS (SELECT s, coalesce(var_samp(l_discount), 0) AS variance FROM n GROUP BY 1)
    SELECT s AS seg, v AS proto, round(variance, 9) AS variance FROM t JOIN d USING (s) WHERE k > 0.5 * total AND variance < 1e-3""")
def segment_prototypes(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seg"), (F.col("l_returnflag") == "N").cast("int").alias("proto"), "l_discount")
    return aggregates.segment_modes(p, ["seg"], "proto", "l_discount").select("seg", "proto", F.round("variance", 9).alias("variance"))


@query("SELECT s_suppkey AS image, s_nationkey AS seg, round(CASE WHEN s_acctbal / 1000 > 0.1 AND s_acctbal / 1000 < 5 THEN s_acctbal / 1000 ELSE coalesce(m, s_acctbal / 1000) END, 6) AS \"offset\" FROM supplier LEFT JOIN (SELECT l_suppkey, avg(-l_quantity * l_discount) AS m FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def offsets_again(spark, sf_dir):
    planes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), F.col("s_nationkey").alias("seg"), (F.col("s_acctbal") / 1000).alias("offset"))
    samples = table(spark, sf_dir, "lineitem").join(planes.select("image", "seg"), F.col("l_suppkey") == F.col("image")).select("image", "seg", F.col("l_quantity").alias("depth"), F.col("l_discount").alias("cos"))
    return aggregates.reestimated_offsets(planes, samples, 5.0).select("image", "seg", r6("offset").alias("offset"))


@query(f"{_PARTS} SELECT id, round((x + y) / 2 - greatest(y - x, z - a) / 2, 6) + 0e0 AS b0, round((a + z) / 2 - greatest(y - x, z - a) / 2, 6) + 0e0 AS b1, round((x + y) / 2 + greatest(y - x, z - a) / 2, 6) + 0e0 AS b2, round((a + z) / 2 + greatest(y - x, z - a) / 2, 6) + 0e0 AS b3 FROM p")
def square_boxes(spark, sf_dir):
    return _out(_parts(spark, sf_dir), 6, b=(aggregates.square_box(F.col("x"), F.col("a"), F.col("y"), F.col("z")), 4))


@query("""WITH s AS (SELECT l_returnflag AS f, sum(x * x) AS xx, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * y) AS yy, sum(y * z) AS yz, sum(z * z) AS zz, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM (SELECT l_returnflag, l_quantity / 10 AS x, l_discount * 10 AS y, l_tax * 10 AS z FROM lineitem) GROUP BY 1),
    d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM s)
    SELECT f AS l_returnflag, round((sx * (yy * zz - yz * yz) - xy * (sy * zz - yz * sz) + xz * (sy * yz - yy * sz)) / det, 5) AS p0, round((xx * (sy * zz - yz * sz) - sx * (xy * zz - yz * xz) + xz * (xy * sz - sy * xz)) / det, 5) AS p1, round((xx * (yy * sz - sy * yz) - xy * (xy * sz - sy * xz) + sx * (xy * yz - yy * xz)) / det, 5) AS p2 FROM d""")
def plane_least_squares(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10).alias("z"))
    return aggregates.plane_by_least_squares(p, ["l_returnflag"]).select("l_returnflag", *(F.round(F.get("p", F.lit(i)), 5).alias(f"p{i}") for i in range(3)))


# sampling


@query("WITH m AS (SELECT max(p_retailprice) AS top FROM part WHERE p_size <= 40) SELECT p_partkey AS id, p_retailprice AS score FROM part, m WHERE p_size <= 40 AND p_retailprice >= 0.5 * top ORDER BY p_retailprice DESC, id LIMIT 15")
def largest_planes(spark, sf_dir):
    planes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("area"), F.col("p_size").cast("double").alias("error"), F.lit(1).alias("n"))
    return sampling.select_planes(planes, 15, trim=40.0, least_ratio=0.5).select("id", "score")


@query("SELECT l_orderkey AS prompt, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS mask_id, min(l_quantity) AS area FROM lineitem WHERE l_discount * 10 >= 0.3 AND l_tax * 10 >= 0.2 GROUP BY 1")
def smallest_good_masks(spark, sf_dir):
    masks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").alias("mask_id"), F.col("l_quantity").alias("area"), (F.col("l_discount") * 10).alias("iou"), (F.col("l_tax") * 10).alias("stability"))
    return sampling.smallest_good(masks, ["prompt"], iou=0.3, stability=0.2)


@query(f"{_GRID} SELECT y, x, CASE WHEN depth >= 3 THEN round(avg(CASE WHEN depth < 3 THEN 0e0 ELSE 1 END) OVER (PARTITION BY y // 16, x // 16), 6) ELSE 0 END AS weight FROM g")
def sampling_density(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumnRenamed("mask", "covered")
    return sampling.active_density(g, ["t"]).select("y", "x", r6("weight").alias("weight"))


@query("SELECT s_suppkey AS ray, b AS bin, round(1 + s_nationkey * (b + 0.5) / 8, 6) AS z FROM supplier, range(8) t(b)")
def bins_of_rays(spark, sf_dir):
    rays = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ray"), "s_nationkey")
    found = sampling.bin_samples(rays, F.lit(1.0), 1.0 + F.col("s_nationkey"), 8)
    return found.select("ray", F.col("bin").cast("long").alias("bin"), r6("z").alias("z"))


# sequences


@query("WITH m AS (SELECT user_id, ts::date AS d, avg(value) AS x, avg(event_id) AS y FROM events GROUP BY 1, 2), s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS speed FROM m WINDOW w AS (PARTITION BY user_id ORDER BY d)) SELECT user_id, d AS day, round(speed, 4) AS speed, round(coalesce(abs(speed - lag(speed) OVER (PARTITION BY user_id ORDER BY d)), 0), 4) AS change FROM s")
def centroid_speeds(spark, sf_dir):
    p = _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"))
    return sequence.centroid_motion(p, ["user_id"], "day", ["x", "y"]).select("user_id", "day", F.round("speed", 4).alias("speed"), F.round("change", 4).alias("change"))


@query("SELECT user_id, event_id, avg(CASE WHEN value < 60 AND value % 10 < 8 THEN 1e0 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) > 0.7 AS static FROM events")
def resting_frames(spark, sf_dir):
    m = _events(spark, sf_dir).select("user_id", "event_id", F.col("value").alias("speed"), (F.col("value") % 10).alias("change"))
    return sequence.static_flags(m, ["user_id"], "event_id", speed=60.0, change=8.0).select("user_id", "event_id", "static")


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), o AS (SELECT s AS d, exp(-0.5 * (s / 1e0) ** 2) AS w FROM range(-4, 5) t(s)), k AS (SELECT d, w / (SELECT sum(w) FROM o) AS w FROM o),
    a AS (SELECT user_id, event_id, w, n, ((i + d) % (2 * n) + 2 * n) % (2 * n) AS j FROM r, k), b AS (SELECT user_id, event_id, w, CASE WHEN j < n THEN j ELSE 2 * n - 1 - j END AS j FROM a)
    SELECT b.event_id, round(sum(w * r.value), 5) AS smooth FROM b JOIN r ON r.user_id = b.user_id AND r.i = b.j GROUP BY 1""")
def gaussian_path(spark, sf_dir):
    return sequence.gaussian_smooth(_events(spark, sf_dir), "value", ["user_id"], ["event_id"], sigma=1.0).select("event_id", F.round("smooth", 5).alias("smooth"))


@query("WITH d AS (SELECT event_id, user_id, value / 1000 * 2 AS d FROM events) SELECT event_id, round(exp(-coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * (1 - exp(-d)), 6) AS weight FROM d")
def rendering_weights(spark, sf_dir):
    e = _events(spark, sf_dir).withColumns({"density": F.col("value") / 1000, "step": F.lit(2.0)})
    return sequence.composite_weights(e, "density", "step", ["user_id"], ["event_id"]).select("event_id", r6("weight").alias("weight"))


@query("SELECT event_id AS t, 'stride' AS kind FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'custom' FROM events WHERE event_id IN (3, 7, (SELECT max(event_id) FROM events)) UNION ALL SELECT event_id, 'render' FROM events WHERE event_id < 40 AND event_id % 3 = 0")
def shown_frames(spark, sf_dir):
    t = _events(spark, sf_dir).select(F.col("event_id").alias("t"))
    kinds = {"stride": sequence.playback_frames(t, stride=5), "custom": sequence.playback_frames(t, custom=[3, 7, 2**30]), "render": sequence.render_frames(t, 50, 40, 60, 3)}
    return kinds["stride"].withColumn("kind", F.lit("stride")).unionByName(kinds["custom"].withColumn("kind", F.lit("custom"))).unionByName(kinds["render"].withColumn("kind", F.lit("render")))


# messages


def _messages(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("client"), kind.alias("type"), "value")


@query("SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'node|n' || user_id WHEN event_id % 3 = 1 THEN 'node|n' || user_id ELSE 'update|n' || user_id || '|a,b' END AS key FROM events")
def redundancy_keys(spark, sf_dir):
    m = _messages(spark, sf_dir)
    third = F.col("seq") % 3
    kind = F.when(third == 0, "create").when(third == 1, messages.REMOVE).otherwise("update")
    name = F.concat(F.lit("n"), F.col("client").cast("string"))
    return m.select("seq", messages.redundancy_key(kind, name, F.lit(None).cast("string"), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).alias("key"))


@query("SELECT event_id AS seq FROM events WHERE event_type != 'error' AND user_id != 3")
def delivered_messages(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("sender", F.col("client"))
    return messages.others_than(messages.without(m, F.col("type") == "error"), 3).select("seq")


@query("SELECT event_id AS seq FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def known_handles(spark, sf_dir):
    state = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("uuid"))
    return messages.merged_updates(state, _messages(spark, sf_dir).withColumnRenamed("client", "uuid")).select("seq")


@query("""WITH m AS (SELECT event_id AS seq, user_id AS client, CASE event_id % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS d FROM events), l AS (SELECT *, sum(d) OVER (PARTITION BY client ORDER BY seq) AS level FROM m), z AS (SELECT client, max(seq) AS last FROM l WHERE level = 0 GROUP BY 1)
    SELECT seq FROM l JOIN z USING (client) WHERE seq <= last AND d = 0""")
def ended_groups(spark, sf_dir):
    rest = F.col("seq") % 4
    m = _messages(spark, sf_dir).withColumn("type", F.when(rest == 0, "atomic_start").when(rest == 2, "atomic_end").otherwise("update"))
    return messages.closed_groups(m).select("seq")


@query("""WITH b AS (SELECT user_id, event_type, max(event_id) AS seq FROM events WHERE event_id < 300 GROUP BY 1, 2) SELECT seq FROM b UNION ALL SELECT event_id FROM events WHERE event_id >= 300""")
def late_joiner(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return messages.replay(m.limit(0), m, ["client", "type"], 300).select("seq")


@query("SELECT doc_id, part, cast(ceil(greatest(strlen(text), 1) / 4096e0) AS integer) AS parts, strlen(text) AS total, cast(least(4096, strlen(text) - part * 4096) AS integer) AS size, sum(least(4096, strlen(text) - part * 4096)) OVER (PARTITION BY doc_id ORDER BY part)::BIGINT AS received FROM (SELECT doc_id, text, unnest(range(0, greatest(1, cast(ceil(strlen(text) / 4096e0) AS integer)))) AS part FROM documents WHERE text IS NOT NULL)")
def transfer_parts(spark, sf_dir):
    files = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("uuid"), F.col("text").cast("binary").alias("content"))
    parts = messages.split_transfer(files, 4096).withColumn("seq", F.col("part"))
    return messages.acknowledged(parts).select(F.col("uuid").alias("doc_id"), F.col("part").cast("long").alias("part"), "parts", F.col("total").cast("long").alias("total"), F.octet_length("chunk").alias("size"), F.col("received").cast("long").alias("received"))


@query("WITH c AS (SELECT user_id AS client, event_id AS seq, event_id % 2 = 0 AS opens, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT client, seq AS connected, next AS disconnected FROM c WHERE opens")
def connections(spark, sf_dir):
    c = _messages(spark, sf_dir).select("client", "seq", F.when(F.col("seq") % 2 == 0, "connect").otherwise("disconnect").alias("event"))
    return messages.sessions(c)


@query("WITH m AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events) SELECT event_id AS seq, round(t, 4) AS time, cast(floor(round(t, 4) / 7) AS bigint) AS frame FROM m WHERE event_type NOT IN ('click', 'error')")
def recordings(spark, sf_dir):
    m = _messages(spark, sf_dir).select("seq", F.col("client").alias("recording"), F.when(F.col("type") == "click", "sleep").otherwise(F.col("type")).alias("type"), F.col("value").alias("seconds"))
    found = messages.recorded(m, F.col("type") != "error", 1 / 7)
    return found.select("seq", F.round("time", 4).alias("time"), F.floor(F.round("time", 4) / 7).cast("long").alias("frame"))


@query("SELECT event_id AS seq, cast(user_id AS double) AS x, event_type AS name FROM events")
def typed_payloads(spark, sf_dir):
    m = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.to_json(F.struct(F.col("user_id").alias("x"), F.col("event_type").alias("name"))).alias("payload"))
    return messages.typed(m, "payload", "x double, name string").select("seq", "payload.x", "payload.name")


# meshes over nation-like indices


_FACES = "WITH f AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS fid, l_partkey % 97 AS v0, l_suppkey % 89 + 100 AS v1, l_orderkey % 83 + 200 AS v2 FROM lineitem), v AS (SELECT i AS vid, cos(i * 0.7) * i AS x, sin(i * 1.3) * i AS y, i * 0.5 AS z FROM range(300) t(i))"


def _mesh(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    f = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fid"), (F.col("l_partkey") % 97).alias("v0"), (F.col("l_suppkey") % 89 + 100).alias("v1"), (F.col("l_orderkey") % 83 + 200).alias("v2")).distinct()
    i = F.col("id").cast("double")
    return f, spark.range(300).select(F.col("id").alias("vid"), (F.cos(i * 0.7) * i).alias("x"), (F.sin(i * 1.3) * i).alias("y"), (i * 0.5).alias("z"))


_CORNERS = f"""{_FACES}, c AS (SELECT fid, v0, v1, v2, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, d.x - a.x AS wx, d.y - a.y AS wy, d.z - a.z AS wz FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v d ON d.vid = v2),
    m AS (SELECT *, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM c), n AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM m)"""


@query(f"{_CORNERS} SELECT fid, round(nx / s, 5) + 0e0 AS n0, round(ny / s, 5) + 0e0 AS n1, round(nz / s, 5) + 0e0 AS n2 FROM n")
def face_normals(spark, sf_dir):
    return mesh.face_normals(*_mesh(spark, sf_dir)).select("fid", *((F.round(F.get("normal", F.lit(i)), 5) + 0.0).alias(f"n{i}") for i in range(3)))


@query(f"{_CORNERS} SELECT fid, round(acos(greatest(-1, least(1, (ux * wx + uy * wy + uz * wz) / sqrt(ux * ux + uy * uy + uz * uz) / sqrt(wx * wx + wy * wy + wz * wz)))), 5) AS a0, round(pi(), 5) AS total FROM n")
def face_angles(spark, sf_dir):
    a = mesh.face_angles(*_mesh(spark, sf_dir))
    return a.select("fid", F.round(F.get("angles", F.lit(0)), 5).alias("a0"), F.round(F.aggregate("angles", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"{_CORNERS}, k AS (SELECT v0 AS vid, nx / s AS x, ny / s AS y, nz / s AS z FROM n UNION ALL SELECT v1, nx / s, ny / s, nz / s FROM n UNION ALL SELECT v2, nx / s, ny / s, nz / s FROM n), t AS (SELECT vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM k GROUP BY 1) SELECT vid, round(x / sqrt(x * x + y * y + z * z), 5) + 0e0 AS n0, round(y / sqrt(x * x + y * y + z * z), 5) + 0e0 AS n1, round(z / sqrt(x * x + y * y + z * z), 5) + 0e0 AS n2 FROM t")
def vertex_normals(spark, sf_dir):
    return mesh.vertex_normals(*_mesh(spark, sf_dir)).select("vid", *((F.round(F.get("normal", F.lit(i)), 5) + 0.0).alias(f"n{i}") for i in range(3)))


@query("SELECT l_orderkey AS fid, cast(i - 1 AS integer) AS part, vs[1] AS v0, vs[i + 1] AS v1, vs[i + 2] AS v2 FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS vs FROM lineitem GROUP BY 1), range(1, 1000) t(i) WHERE i <= len(vs) - 2")
def fan_triangles(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return mesh.triangulate(lists.select(F.col("l_orderkey").alias("fid"), F.col("l.l_partkey").alias("vs")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 5 != l_suppkey % 5 AND l_suppkey % 5 != l_orderkey % 5 AND l_orderkey % 5 != l_partkey % 5")
def proper_faces(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("v0"), (F.col("l_suppkey") % 5).alias("v1"), (F.col("l_orderkey") % 5).alias("v2"))
    return mesh.drop_degenerate(f).select("l_orderkey", "l_linenumber")


@query(f"{_PARTS}, m AS (SELECT id, min(id) OVER (PARTITION BY round_even(x / 2, 0), round_even(y / 2, 0), round_even(z / 2, 0)) AS least FROM p) SELECT id AS vid FROM m WHERE id = least")
def merged_vertices(spark, sf_dir):
    v = _parts(spark, sf_dir).select(F.col("id").alias("vid"), "x", "y", "z")
    f = spark.range(0).select(F.col("id").alias("fid"), *(F.col("id").alias(f"v{i}") for i in range(3)))
    return mesh.merge_duplicates(v, f, 2.0)[0].select("vid")


@query(f"{_FACES}, u AS (SELECT v0 AS vid FROM f UNION SELECT v1 FROM f UNION SELECT v2 FROM f) SELECT row_number() OVER (ORDER BY vid) - 1 AS vid, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, round(z, 5) + 0e0 AS z FROM v JOIN u USING (vid)")
def referenced_vertices(spark, sf_dir):
    f, v = _mesh(spark, sf_dir)
    kept, _ = mesh.drop_unreferenced(v, f)
    return kept.select(F.col("vid").cast("long").alias("vid"), *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))


@query(f"{_PARTS} SELECT id AS plane_id, round(x, 5) + 0e0 AS x, round(y - 0.6 * (0.6 * y + 0.8 * z - a), 5) + 0e0 AS y, round(z - 0.8 * (0.6 * y + 0.8 * z - a), 5) + 0e0 AS z FROM p")
def flattened_points(spark, sf_dir):
    p = _parts(spark, sf_dir)
    planes = p.select(F.col("id").alias("plane_id"), L.pack([0.0, 0.6, 0.8, -F.col("a")]).alias("plane"))
    return mesh.planarize(p.select(F.col("id").alias("plane_id"), "x", "y", "z"), planes).select("plane_id", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))


@query(f"{_FACES} SELECT o.s AS sample, round(0.2 * a.x + 0.3 * b.x + 0.5 * d.x, 5) + 0e0 AS x FROM (SELECT fid AS s FROM f) o JOIN f ON f.fid = o.s JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v d ON d.vid = v2")
def inner_points(spark, sf_dir):
    f, v = _mesh(spark, sf_dir)
    samples = f.select(F.col("fid").alias("sample"), "fid", F.lit(0.2).alias("b0"), F.lit(0.3).alias("b1"), F.lit(0.5).alias("b2"))
    return mesh.barycentric(samples, f, v, "x").select("sample", (F.round("x", 5) + 0.0).alias("x"))


@query(f"{_FACES} SELECT l_suppkey AS vid, round(sum(l_discount * x), 4) + 0e0 AS x, round(sum(l_discount * y), 4) + 0e0 AS y, round(sum(l_discount * z), 4) + 0e0 AS z FROM lineitem JOIN v ON v.vid = l_partkey % 300 GROUP BY 1")
def mapped_vertices(spark, sf_dir):
    _, v = _mesh(spark, sf_dir)
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("to"), (F.col("l_partkey") % 300).alias("vid"), F.col("l_discount").alias("w"))
    return mesh.mapped_vertices(v, w).select("vid", *((F.round(c, 4) + 0.0).alias(c) for c in "xyz"))


@query(f"{_PARTS} SELECT DISTINCT cast(floor(x / 4) AS bigint) AS i, cast(floor(y / 4) AS bigint) AS j, cast(floor(z / 4) AS bigint) AS k FROM p")
def filled_voxels(spark, sf_dir):
    return mesh.voxelize(_parts(spark, sf_dir), 4.0)


# clusters and names


@query("""WITH j AS (SELECT a.l_orderkey, a.l_linenumber, a.l_returnflag, b.l_linestatus FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 10), n AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS k FROM j) SELECT l_orderkey AS y, l_linenumber AS x, l_returnflag AS cluster, l_linestatus AS mask FROM n WHERE k >= 20""")
def plane_instances(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    at = [F.lit(0).alias("t"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x")]
    return cluster.mask_instances(line.select(*at, F.col("l_returnflag").alias("cluster")), line.filter("l_quantity > 10").select(*at, F.col("l_linestatus").alias("mask")), 20).select("y", "x", "cluster", "mask")


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, cos(s_nationkey * 0.01) AS i, sin(s_nationkey * 0.01) AS j, abs(s_acctbal) / 1000 AS d FROM supplier), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.d - b.d) <= 0.05 AND abs(a.i * b.i + a.j * b.j) >= 0.9945),
    reach AS (SELECT id AS node, id AS other FROM p UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a) SELECT node, min(other) AS component FROM reach GROUP BY 1""")
def normal_pairs(spark, sf_dir):
    angle = F.col("s_nationkey") * 0.01
    planes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), L.pack([F.cos(angle), F.sin(angle), F.lit(0.0)]).alias("n"), (F.abs("s_acctbal") / 1000).alias("d"))
    return cluster.parallel_components(planes, shared_folder(spark))


@query("SELECT c_custkey, '2024' AS date, lower(trim(c_mktsegment)) AS scene, CASE WHEN c_custkey % 2 = 0 THEN 'm_trimesh' ELSE 'm' || c_nationkey END AS method, 's' || c_custkey AS sequence FROM customer")
def split_file_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("2024_"), F.lower(F.trim("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, "_m_trimesh").otherwise(F.concat(F.lit("_m"), F.col("c_nationkey").cast("string")))))
    date, scene, method = tables.split_name(F.col("name"))
    return c.select("c_custkey", date.alias("date"), scene.alias("scene"), method.alias("method"), tables.sequence_name(F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit("_sgd_x"))).alias("sequence"))


@query("SELECT s_suppkey AS fi, cast(s_nationkey AS bigint) AS fj FROM supplier WHERE s_suppkey % 3 != 0")
def frame_pair_files(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 3 == 0, F.lit("notes.txt")).otherwise(F.concat(F.lit("a/flow_"), tables.frame_name(F.col("s_suppkey")), F.lit("_"), tables.frame_name(F.col("s_nationkey")), F.lit(".npz")))
    return tables.frame_pairs(table(spark, sf_dir, "supplier").select(name.alias("path"))).select("fi", "fj")


@query("SELECT s_suppkey AS n, CASE WHEN s_suppkey % 4 = 0 THEN 0.0e0 ELSE greatest(-1e0, least(2e0, s_acctbal / 1000)) END AS value FROM supplier WHERE s_suppkey % 5 != 0")
def joint_values(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    joints = s.select(F.col("s_suppkey").alias("n"), F.col("s_suppkey").cast("string").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, "fixed").otherwise("revolute").alias("kind"), F.lit(-1.0).alias("lower"), F.lit(2.0).alias("upper"))
    values = s.filter("s_suppkey % 4 != 0").select(F.col("s_suppkey").cast("string").alias("name"), (F.col("s_acctbal") / 1000).alias("value"))
    return tables.joint_configuration(joints, values).select("n", "value")


# more of cameras and motions


def _turned(angle, x, y, z):
    """A turn about z by ``angle``, then a move."""
    return L.se3_matrix(L.entries(R.euler_axis_rotation("Z", angle), 9), [x, y, z])


@query(_sql({"n": ["(800 + a) / 640", "320.5e0 / 640", "(600 + b) / 480", "240.5e0 / 480"], "c": ["5.12e0", "3.2e0 - x / 100", "5.76e0", "4.8e0 - y / 50"], "v": "2 * atan(480 / (2 * (600 + b)))", "h": "2 * atan(640 / (2 * (800 + a)))", "w": "(1 / (640 * (800 + a)) + 1 / (480 * (600 + b))) / 2 * 1e6"}, 10))
def intrinsics_and_crops(spark, sf_dir):
    k = camera.intrinsics_of(F.struct((F.col("a") + 800).alias("fx"), (F.col("b") + 600).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy")))
    n = L.entries(camera.normalize_intrinsics(k, 640, 480), 9)
    c = L.entries(camera.crop_intrinsics(camera.intrinsics_from_focal_center(0.8, 0.6, 0.5, 0.5), 640, 480, F.col("x"), F.col("y"), 100, 50), 9)
    four = lambda e: F.array(e[0], e[2], e[4], e[5])
    return _out(_parts(spark, sf_dir), 10, n=(four(n), 4), c=(four(c), 4), v=(camera.vertical_fov(k, 480), 0), h=(camera.fov_x_of(F.col("a") + 800, 640), 0), w=(camera.pixel_width(k, 640, 480) * 1e6, 0))


@query(_sql({"ndc": ["(x + 0.5) / 1280 - 1", "1 - (y + 0.5) / 960"], "scr": ["(x + 0.5) / 640", "1 - (y + 0.5) / 480"], "u": "2 * x / 639 - 1", "back": "x", "p": ["1 / tan(a / 20)", "640 / (480 * tan(a / 20))"]}))
def screen_coordinates(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    u = camera.normalise_coordinates(x, 640)
    p = L.entries(camera.perspective_from_fov(F.col("a") / 10, 640, 480, F.lit(0.1), F.lit(100.0)), 16)
    return _out(_parts(spark, sf_dir), ndc=(camera.pixel_to_ndc(x, y, 640, 480), 2), scr=(camera.scr_coord(x, y, 640, 480), 2), u=(u, 0), back=(camera.denormalise_coordinates(u, 640), 0), p=(F.array(p[0], p[5]), 2))


@query(_sql({"e": ["-z * sin(a)", "-z * cos(a)", "y", "z * cos(a)", "-z * sin(a)", "-x", "x * sin(a) - y * cos(a)", "x * cos(a) + y * sin(a)", "0e0"], "q": ["cos(a / 20)", "0e0", "0e0", "sin(a / 20)"], "t": ["x", "y", "z"]}))
def essential_and_pose(spark, sf_dir):
    q, t = camera.pose_of(_turned(F.col("a") / 10, *_xyz()))
    return _out(_parts(spark, sf_dir), e=(camera.extrinsics_to_essential(_turned(F.col("a"), *_xyz())), 9), q=(L.scale(q, F.signum(F.get(q, F.lit(0))), 4), 4), t=(t, 3))


@query(f"""{_PARTS}, m AS (SELECT id, a + b / 2 AS m, b / 2 AS h, (x / 1000) * 2 / sqrt(12) AS r FROM p), s AS (SELECT *, 3 * m * m + h * h AS s FROM m)
    SELECT id, round(m + 2 * m * h * h / s, 6) AS mean, round(h * h / 3 - 4 * h ** 4 * (12 * m * m - h * h) / (15 * s * s), 6) + 0e0 AS along, round(r * r * (m * m / 4 + 5 * h * h / 12 - 4 * h ** 4 / (15 * s)), 6) + 0e0 AS across FROM s""")
def cone_parts(spark, sf_dir):
    mean, along, across = camera.cone_gaussian(F.col("a"), F.col("a") + F.col("b"), F.col("x") / 1000)
    return _out(_parts(spark, sf_dir), 6, mean=(mean, 0), along=(along, 0), across=(across, 0))


@query(_sql({"r": ["cos(a)", "-sin(a)", "sin(a)", "cos(a)"], "s": ["b", "0e0", "1 - b", "0e0", "b", "2 - 2 * b"], "ax": ["x", "cos(a) * y - sin(a) * z", "sin(a) * y + cos(a) * z"], "ay": ["cos(a) * x + sin(a) * z", "y", "cos(a) * z - sin(a) * x"], "az": ["cos(a) * x - sin(a) * y", "sin(a) * x + cos(a) * y", "z"], "qi": ["a", "z", "-y", "-x"]}))
def turns_about_axes(spark, sf_dir):
    about = {f"a{c.lower()}": (L.matvec(R.euler_axis_rotation(c, F.col("a")), _xyz(), 3), 3) for c in "XY"}
    z = R.quat_rotate_xyzw(L.pack([0, 0, F.sin(F.col("a") / 2), F.cos(F.col("a") / 2)]), L.pack(_xyz()))
    qi = R.quat_multiply_xyzw(L.pack([*_xyz(), F.col("a")]), L.pack([1, 0, 0, 0]))
    s = L.entries(camera.scale_2d(F.col("b"), (1.0, 2.0)), 9)
    return _out(_parts(spark, sf_dir), r=(camera.rotation_2d(F.col("a")), 4), s=(F.array(*s[:6]), 6), **about, az=(z, 3), qi=(qi, 4))


@query(_sql({"h": ["cos(a / 10)", "-sin(a / 10)", "0e0", "x / 2", "sin(a / 10)", "cos(a / 10)", "0e0", "y / 2", "0e0", "0e0", "1e0", "z / 2"], "back": ["a", "b", "c"]}))
def motions_between(spark, sf_dir):
    """Half of the way from rest, and there and back."""
    df = _parts(spark, sf_dir).withColumn("m", _turned(F.col("a") / 5, *_xyz()))
    df = df.withColumn("half", R.lerp_se3_matrix(L.identity(4), "m", F.lit(0.5))).withColumn("there", L.apply_transform("m", L.pack([F.col("a"), F.col("b"), F.col("c")])))
    return _out(df, h=(F.slice("half", 1, 12), 12), back=(L.apply_transform(R.pose_inverse("m"), "there"), 3))


@query(_sql({"so2": ["cos(a)", "sin(a)"], "se2": ["cos(a)", "sin(a)", "x", "y"], "se3": ["cos(a)", "0e0", "0e0", "sin(a)", "x", "y", "z"], "adjoint": "1e0", "n2": "1e0", "n3": "1e0", "inside": "1e0"}))
def group_elements(spark, sf_dir):
    """Normalised elements, and drawn ones: unit complex numbers and quaternions, moves within a cube."""
    c, s = F.cos("a"), F.sin("a")
    two, three = L.entries(R.se2_sample(F.col("id")), 4), L.entries(R.se3_sample(F.col("id")), 7)
    n2 = lambda e: F.sqrt(L.dot(e, e))
    inside = F.when(F.greatest(*(F.abs(v) for v in (*two[2:], *three[4:]))) <= 1, 1.0).otherwise(0.0)
    drawn = L.entries(R.so2_sample(F.col("id")), 2)
    return _out(
        _parts(spark, sf_dir), so2=(R.so2_normalize(L.pack([3 * c, 3 * s])), 2), se2=(R.se2_normalize(L.pack([3 * c, 3 * s, F.col("x"), F.col("y")])), 4),
        se3=(R.se3_normalize(L.pack([2 * c, 0, 0, 2 * s, *_xyz()])), 7), adjoint=(F.get(R.so2_adjoint(L.pack([c, s])), F.lit(0)), 0),
        n2=(F.sqrt(drawn[0] ** 2 + drawn[1] ** 2) * F.sqrt(two[0] ** 2 + two[1] ** 2), 0), n3=(F.sqrt(sum(v**2 for v in three[:4])), 0), inside=(inside, 0),
    )


@query(_sql({"signed": "sign(x - 25) * abs(x - 25) ** 0.7", "safe": "greatest(abs(x - 25), 1e-6) ** 0.7", "k": ["0.3e0", "0.7e0", "exp(a / 10)", "exp(b / 10)", "exp(c / 10)", "a / 10", "0e0", "0e0", "x", "y", "z"]}))
def superquadric_parameters(spark, sf_dir):
    k = superquadric.packed_parameters(L.pack([F.col("a") / 10, F.col("b") / 10, F.col("c") / 10]), R.euler_axis_rotation("Z", F.col("a") / 10), L.pack(_xyz()), L.pack([0.3, 0.7]))
    return _out(_parts(spark, sf_dir), signed=(superquadric.signed_pow(F.col("x") - 25, 0.7), 0), safe=(superquadric.safe_pow(F.col("x") - 25, 0.7), 0), k=(k, 11))


@query(f"{_PARTS} SELECT round(avg(greatest(x - 25, 0)), 6) AS loss FROM p")
def inside_losses(spark, sf_dir):
    return superquadric.inside_loss(_parts(spark, sf_dir), F.col("x") - 25).select(r6("loss").alias("loss"))


@query(_sql({"pos": ["x + cos(a)", "y + sin(a)", "z"], "quat": ["cos(a / 2)", "0e0", "0e0", "sin(a / 2)"], "frame": "greatest(0, least(x - 5, 20))"}))
def geom_poses(spark, sf_dir):
    turn = L.pack([F.cos(F.col("a") / 2), 0, 0, F.sin(F.col("a") / 2)])
    bodies = _parts(spark, sf_dir).select(F.struct("id", (F.col("x") - 5).alias("x")).alias("t"), F.lit(0).alias("body"), L.pack(_xyz()).alias("pos"), turn.alias("quat"))
    geoms = spark.range(1).select(F.lit(0).alias("body"), F.lit(7).alias("geom"), L.pack([1, 0, 0]).alias("local_pos"), L.pack([1, 0, 0, 0]).alias("local_quat"))
    found = sequence.body_pose(bodies, geoms).withColumn("id", F.col("t.id"))
    return _out(found, pos=("pos", 3), quat=("quat", 4), frame=(sequence.clamp_frame(F.col("t.x"), F.lit(20.0)), 0))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def rows_of_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return spatial.semi_by_key(table(spark, sf_dir, "lineitem"), keys, ["l_partkey"]).select("l_orderkey", "l_linenumber")


# more of pixels, meshes and rows


@query(f"{_PARTS} SELECT id, CASE WHEN id % 3 = 0 THEN 1e0 ELSE 0.5e0 END AS conf, id % 2 = 1 AS mask, least(greatest(x * 5000 - 10000, 1e-4), 99999e0) AS depth FROM p WHERE id % 4 < 3")
def cleaned_frames(spark, sf_dir):
    i = F.col("id")
    rows = _parts(spark, sf_dir).select("id", F.when(i % 4 < 3, 1).otherwise(0).alias("t"), F.when(i % 3 != 0, 0.5).alias("conf"), F.when(i % 2 == 1, True).alias("mask"), (F.col("x") * 5000 - 10000).alias("depth"))
    return pixels.clean_frames(rows, 1).select("id", "conf", "mask", "depth")


@query(_sql({"k": ["800 + a", "0e0", "320e0", "0e0", "800 + a", "240e0", "0e0", "0e0", "1e0"], "m": ["cos(a)", "-sin(a)", "0e0", "x * b", "sin(a)", "cos(a)", "0e0", "y * b", "0e0", "0e0", "1e0", "z * b"]}))
def scaled_bundles(spark, sf_dir):
    frames = _parts(spark, sf_dir).select("id", camera.intrinsics_from_focal_center(F.col("a") + 800, 600.0, 320.0, 240.0).alias("k"), _turned(F.col("a"), *_xyz()).alias("c2w"), F.col("b").alias("scale"))
    found = pixels.scaled_bundle(frames)
    return _out(found, k=("k", 9), m=("c2w", 12))


@query(f"{_GRID} SELECT g.y, g.x, max(n.depth) AS pooled FROM g JOIN g n ON abs(g.y - n.y) <= 1 AND abs(g.x - n.x) <= 1 GROUP BY 1, 2")
def max_pooled(spark, sf_dir):
    return pixels.max_pool_2d(_grid(spark, sf_dir), "depth").select("y", "x", "pooled")


@query(f"{_GRID} SELECT x, min(y) AS y0, max(y) AS y1, x AS x0, x AS x1 FROM g WHERE depth < 3 GROUP BY x")
def column_bounds(spark, sf_dir):
    return pixels.pixel_segments_of(_grid(spark, sf_dir).withColumn("mask", F.col("depth") < 3).withColumn("c", F.col("x")), ["c"]).select(F.col("c").alias("x"), "y0", "y1", "x0", "x1")


@query(f"{_GRID} SELECT y, x, x % 3 + 2e0 AS depth, round((x - 20) / 20e0 * (x % 3 + 2), 6) + 0e0 AS p0, round((y - 20) / 20e0 * (x % 3 + 2), 6) + 0e0 AS p1, x % 3 + 2e0 AS p2 FROM g")
def points_on_planes(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("seg", (F.col("x") % 3).cast("long"))
    planes = spark.range(3).select(F.col("id").alias("seg"), L.pack([0, 0, 1, -(F.col("id") + 2.0)]).alias("plane"))
    found = pixels.plane_points(g.select("y", "x", "seg"), planes, L.pack([20, 0, 20, 0, 20, 20, 0, 0, 1]))
    return found.select("y", "x", r6("plane_depth").alias("depth"), *((F.round(F.get("point", F.lit(i)), 6) + 0.0).alias(f"p{i}") for i in range(3)))


@query(f"""WITH o AS (SELECT l_suppkey % 5 AS fi, l_partkey % 3 AS seg1, l_linenumber % 4 AS fj, l_orderkey % 3 AS seg2, count(*) AS n, avg(l_quantity / 50) AS ratio FROM lineitem GROUP BY ALL), s AS (SELECT *, cos((fi + 5 * seg1 - fj - 5 * seg2) / 10e0) AS c FROM o)
    SELECT fi, seg1, fj, seg2, round(c * ratio * n / 100, 6) AS score FROM s WHERE n >= 50 AND ratio >= 0.3 AND c >= 0.9""")
def overlap_scores(spark, sf_dir):
    q = F.col("l_quantity")
    o = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fi"), (F.col("l_partkey") % 3).alias("seg1"), (F.col("l_linenumber") % 4).alias("fj"), (F.col("l_orderkey") % 3).alias("seg2")).agg(F.count("*").alias("n"), F.avg(q / 50).alias("ratio"))
    i = F.col("id")
    normals = spark.range(15).select((i % 5).alias("t"), F.floor(i / 5).alias("seg"), L.pack([F.cos(i / 10), F.sin(i / 10), 0]).alias("normal"))
    return pixels.scored_overlaps(o, normals).select("fi", "seg1", "fj", "seg2", r6("score").alias("score"))


@query(f"{_GRID} SELECT p_partkey AS id, depth FROM part JOIN g ON g.y = p_partkey % 17 AND g.x = p_size")
def gathered_pixels(spark, sf_dir):
    batch = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("image"), (F.col("p_partkey") % 17).alias("y"), F.col("p_size").alias("x"))
    return pixels.gather_pixels(batch, _grid(spark, sf_dir).select(F.lit(0).alias("image"), "y", "x", "depth")).select("id", "depth")


@query(f"{_FACES} SELECT fid, v0 AS a, v1 AS b, v2 AS across, 0 AS side FROM f UNION ALL SELECT fid, v1, v2, v0, 1 FROM f UNION ALL SELECT fid, v2, v0, v1, 2 FROM f")
def directed_edges(spark, sf_dir):
    return mesh.half_edges(_mesh(spark, sf_dir)[0])


@query("SELECT p_partkey AS n, p_name AS name, CASE WHEN p_size > 25 THEN p_size / 10e0 ELSE -pi() END AS lower, pi() AS upper FROM part WHERE p_partkey % 5 <> 0")
def limits_of_joints(spark, sf_dir):
    i, size = F.col("p_partkey"), F.col("p_size")
    joints = table(spark, sf_dir, "part").select(i.alias("n"), F.col("p_name").alias("name"), F.when(i % 5 == 0, "fixed").otherwise("hinge").alias("kind"), F.when(size > 25, size / 10).alias("lower"))
    return tables.joint_limits(tables.with_defaults(joints, {"upper": 3.141592653589793}))


# cameras and rotations by their formulas


def _about_z():
    """Extrinsics: a turn by c about z, then a shift."""
    c = F.col("c")
    return L.pack([F.cos(c), -F.sin(c), 0, 1, F.sin(c), F.cos(c), 0, 2, 0, 0, 1, 3, 0, 0, 0, 1])


@query(_sql({"o": ["-(cos(c) + 2 * sin(c))", "sin(c) - 2 * cos(c)", "-3e0"], "d": ["cos(c) * (a - 0.5) / 0.8 + sin(c) * (b - 0.5) / 0.6", "cos(c) * (b - 0.5) / 0.6 - sin(c) * (a - 0.5) / 0.8", "1e0"]}))
def camera_rays(spark, sf_dir):
    origin, direction = camera.rays(L.pack([F.col("a"), F.col("b")]), L.pack([0.8, 0, 0.5, 0, 0.6, 0.5, 0, 0, 1]), _about_z())
    return _out(_parts(spark, sf_dir), o=(origin, 3), d=(direction, 3))


@query(_sql({"v": ["cos(c) * x - sin(c) * y + 1", "-(sin(c) * x + cos(c) * y + 2)", "-(z + 3)"]}))
def views_of_extrinsics(spark, sf_dir):
    return _out(_parts(spark, sf_dir), v=(L.apply_transform(camera.extrinsics_to_view(_about_z()), L.pack(_xyz())), 3))


@query(f"""{_PARTS}, e AS (SELECT id, x, y, z, [(x - 60) / r, (y - 30) / r, (z - 50) / r] AS back, [1 - x, 2 - y, 3 - z] AS q FROM (SELECT *, sqrt((x - 60) ** 2 + (y - 30) ** 2 + (z - 50) ** 2) AS r FROM p)),
    f AS (SELECT *, [-back[2] / n, back[1] / n, 0e0] AS side FROM (SELECT *, sqrt(back[1] ** 2 + back[2] ** 2) AS n FROM e)),
    g AS (SELECT *, [back[2] * side[3] - back[3] * side[2], back[3] * side[1] - back[1] * side[3], back[1] * side[2] - back[2] * side[1]] AS top FROM f)
    SELECT id, round(list_dot_product(side, q), 5) + 0e0 AS v0, round(list_dot_product(top, q), 5) + 0e0 AS v1, round(list_dot_product(back, q), 5) + 0e0 AS v2 FROM g""")
def view_look_at(spark, sf_dir):
    m = camera.view_look_at(L.pack(_xyz()), L.pack([60.0, 30.0, 50.0]), L.pack([0.0, 0.0, 1.0]))
    return _out(_parts(spark, sf_dir), v=(L.apply_transform(m, L.pack([1.0, 2.0, 3.0])), 3))


@query(_sql({"k": ["a", "0e0", "c / 4", "0e0", "b", "0.25 + a / 10", "0e0", "0e0", "1e0"]}))
def intrinsics_of_perspective(spark, sf_dir):
    a, b, cx, cy = F.col("a"), F.col("b"), F.col("c") / 4, 0.25 + F.col("a") / 10
    p = L.pack([2 * a, 0, 1 - 2 * cx, 0, 0, 2 * b, 2 * cy - 1, 0, 0, 0, -1.002, -0.2, 0, 0, -1, 0])
    return _out(_parts(spark, sf_dir), k=(camera.perspective_to_intrinsics(p), 9))


_EULER_STEPS = "e AS (SELECT id, a, b, c, 2 * cos(a) - 3 * sin(a) AS y1, 2 * sin(a) + 3 * cos(a) AS z1, cos(c) - 2 * sin(c) AS xc, sin(c) + 2 * cos(c) AS yc FROM p)"


@query(f"""{_PARTS}, {_EULER_STEPS}, f AS (SELECT *, cos(b) + sin(b) * z1 AS x2, -sin(b) + cos(b) * z1 AS z2, cos(b) * xc + 3 * sin(b) AS xb, 3 * cos(b) - sin(b) * xc AS zb FROM e)
    SELECT id, round(cos(c) * x2 - sin(c) * y1, 5) + 0e0 AS xyz0, round(sin(c) * x2 + cos(c) * y1, 5) + 0e0 AS xyz1, round(z2, 5) + 0e0 AS xyz2,
        round(xb, 5) + 0e0 AS zyx0, round(cos(a) * yc - sin(a) * zb, 5) + 0e0 AS zyx1, round(sin(a) * yc + cos(a) * zb, 5) + 0e0 AS zyx2 FROM f""")
def euler_orders(spark, sf_dir):
    """The point (1, 2, 3) turned about X, Y, Z, and about Z, Y, X."""
    angles, point = L.pack([F.col("a"), F.col("b"), F.col("c")]), L.pack([1.0, 2.0, 3.0])
    return _out(_parts(spark, sf_dir), **{c.lower(): (L.matvec(R.euler_angles_to_matrix(angles, c), point, 3), 3) for c in ("XYZ", "ZYX")})


@query(_sql({"to": ["1 / sqrt(14e0)", "2 / sqrt(14e0)", "3 / sqrt(14e0)"], "axis": ["3 * (y + 1) - 2 * z", "z - 3 * x", "2 * x - y - 1"], "trace": "1 + 2 * (x + 2 * (y + 1) + 3 * z) / sqrt(14 * (x * x + (y + 1) ** 2 + z * z))"}))
def least_rotations(spark, sf_dir):
    """One vector goes to the other, the axis across both stays, and the trace tells the angle."""
    u = [F.col("x"), F.col("y") + 1, F.col("z")]
    df = _parts(spark, sf_dir).withColumn("m", R.rotation_from_vectors(L.pack(u), L.pack([1.0, 2.0, 3.0])))
    m, v = F.col("m"), [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    e = L.entries(m, 9)
    return _out(df, to=(L.matvec(m, L.normalize(L.pack(u)), 3), 3), axis=(L.matvec(m, L.cross(u, v), 3), 3), trace=(e[0] + e[4] + e[8], 0))


@query(_sql({"p": ["0e0", "(y + (y + a * z) / (1 + a * a)) / 2", "(z + a * (y + a * z) / (1 + a * a)) / 2"], "s": "-x", "t": "(y + a * z) / (1 + a * a)"}))
def points_between_rays(spark, sf_dir):
    point, s, t = camera.ray_intersection(L.pack(_xyz()), L.pack([1.0, 0.0, 0.0]), L.pack([0.0, 0.0, 0.0]), L.pack([F.lit(0.0), F.lit(1.0), F.col("a")]))
    return _out(_parts(spark, sf_dir), p=(point, 3), s=(s, 0), t=(t, 0))


# samples, meshes and matchings


@query(f"{_PARTS} SELECT id AS fid, cast(i AS integer) AS i, cast(j AS integer) AS j, round(x * (3 - i - j) / 3 + i / 3e0 * a + 5 * j / 3e0, 5) + 0e0 AS q0, round(y * (3 - i - j) / 3 + i / 3e0 * b, 5) + 0e0 AS q1, round(z * (3 - i - j) / 3 + i / 3e0 * c + j / 3e0, 5) + 0e0 AS q2 FROM p, range(4) s(i), range(4) t(j) WHERE i + j <= 3")
def points_on_triangles(spark, sf_dir):
    faces = _parts(spark, sf_dir).select(F.col("id").alias("fid"), L.pack(_xyz()).alias("p0"), L.pack([F.col("a"), F.col("b"), F.col("c")]).alias("p1"), L.pack([5.0, 0.0, 1.0]).alias("p2"))
    found = sampling.triangle_samples(faces, 3)
    return found.select("fid", "i", "j", *((F.round(F.get("point", F.lit(k)), 5) + 0.0).alias(f"q{k}") for k in range(3)))


@query("SELECT l_partkey AS ray, CAST(40 AS bigint) AS draws, true AS inside FROM lineitem GROUP BY l_partkey")
def depths_by_importance(spark, sf_dir):
    """Forty depths a ray, each inside of a bin of that ray with weight."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ray"), F.col("l_linenumber").cast("long").alias("bin"), "l_quantity").groupBy("ray", "bin").agg(F.sum("l_quantity").alias("weight"))
    bins = li.select("ray", "bin", (F.col("bin") * 2.0).alias("z0"), (F.col("bin") * 2.0 + 1).alias("z1"), "weight")
    drawn = sampling.importance_samples(bins, 40).withColumn("bin", F.floor(F.col("z") / 2).cast("long"))
    joined = drawn.join(bins, ["ray", "bin"], "left")
    return joined.groupBy("ray").agg(F.count("*").alias("draws"), F.bool_and(F.coalesce((F.col("z") >= F.col("z0")) & (F.col("z") <= F.col("z1")), F.lit(False))).alias("inside"))


@query("""WITH RECURSIVE f AS (SELECT DISTINCT l_partkey % 97 AS a, l_suppkey % 89 + 100 AS b, l_orderkey % 83 + 200 AS c FROM lineitem), e AS (SELECT a, b FROM f UNION SELECT b, a FROM f UNION SELECT b, c FROM f UNION SELECT c, b FROM f UNION SELECT c, a FROM f UNION SELECT a, c FROM f),
    v0 AS (SELECT range AS v, cast(range * range AS double) AS x FROM range(300)), v1 AS (SELECT v0.v, coalesce(v0.x + 0.5 * (m - v0.x), v0.x) AS x FROM v0 LEFT JOIN (SELECT e.a, avg(n.x) AS m FROM e JOIN v0 n ON n.v = e.b GROUP BY e.a) g ON g.a = v0.v),
    v2 AS (SELECT v1.v, coalesce(v1.x + 0.5 * (m - v1.x), v1.x) AS x FROM v1 LEFT JOIN (SELECT e.a, avg(n.x) AS m FROM e JOIN v1 n ON n.v = e.b GROUP BY e.a) g ON g.a = v1.v) SELECT v AS vid, round(x, 5) AS x FROM v2""")
def smoothed_vertices(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 97).alias("v0"), (F.col("l_suppkey") % 89 + 100).alias("v1"), (F.col("l_orderkey") % 83 + 200).alias("v2")).distinct().withColumn("fid", F.xxhash64("v0", "v1", "v2"))
    v = spark.range(300).select(F.col("id").alias("vid"), (F.col("id") * F.col("id")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return mesh.smooth_laplacian(f, v, shared_folder(spark), times=2, factor=0.5).select("vid", F.round("x", 5).alias("x"))


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 7 = 0 AS bad FROM part), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vid FROM v WHERE NOT bad)
    SELECT v.id AS fid, cast(a.vid AS bigint) AS v0, cast(b.vid AS bigint) AS v1, cast(c.vid AS bigint) AS v2 FROM v JOIN n a ON a.id = v.id JOIN n b ON b.id = v.id + 1 JOIN n c ON c.id = v.id + 2""")
def faces_of_finite_vertices(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    vertices = p.select(F.col("p_partkey").alias("vid"), F.when(F.col("p_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    faces = p.select(F.col("p_partkey").alias("fid"), *((F.col("p_partkey") + i).alias(f"v{i}") for i in range(3)))
    _, kept = mesh.drop_nonfinite(vertices, faces)
    return kept.select("fid", *(F.col(f"v{i}").cast("long").alias(f"v{i}") for i in range(3)))


@query("""WITH c AS (SELECT g, r, k, coalesce(c, 60) AS c FROM (SELECT DISTINCT l_suppkey AS g FROM lineitem), range(3) a(r), range(3) b(k) LEFT JOIN (SELECT l_suppkey, l_linenumber % 3 AS x, l_partkey % 3 AS y, min(l_quantity) AS c FROM lineitem GROUP BY ALL) m ON m.l_suppkey = g AND x = r AND y = k),
    t AS (SELECT g, list(c ORDER BY r, k) AS c FROM c GROUP BY g)
    SELECT g, round(least(c[1] + c[5] + c[9], c[1] + c[6] + c[8], c[2] + c[4] + c[9], c[2] + c[6] + c[7], c[3] + c[4] + c[8], c[3] + c[5] + c[7]), 4) AS cost, CAST(3 AS bigint) AS pairs FROM t""")
def least_cost_assignments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    own = li.groupBy(F.col("l_suppkey").alias("g"), (F.col("l_linenumber") % 3).cast("long").alias("row"), (F.col("l_partkey") % 3).alias("col")).agg(F.min("l_quantity").alias("cost"))
    three = F.array(*(F.lit(i).cast("long") for i in range(3)))
    every = li.select(F.col("l_suppkey").alias("g")).distinct().select("g", F.explode(three).alias("row")).select("g", "row", F.explode(three).alias("col"))
    costs = every.join(own, ["g", "row", "col"], "left").withColumn("cost", F.coalesce("cost", F.lit(60.0)))
    return spatial.hungarian(costs, "g").groupBy("g").agg(F.round(F.sum("cost"), 4).alias("cost"), F.count("*").alias("pairs"))
