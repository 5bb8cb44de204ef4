"""Tables of small files: metric logs, scores, contacts, body parts, frame pairs, recordings, configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Appends (iteration, epoch, batch, metric...) as tab-separated text."""
    metrics.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    schema = "iteration long, epoch long, batch long, " + ", ".join(f"`{m}` double" for m in metrics)
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_labels(labels: DataFrame, path: str, order: str, label: str) -> None:
    labels.orderBy(order).select(F.col(label).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def contact_sequence(scores: DataFrame, start: int, end: int, threshold: float) -> DataFrame:
    """Touch flags of frames from start to end, inclusive."""
    return scores.filter(F.col("t").between(start, end)).withColumn("touch", F.col("score") > threshold)


def read_body_parts(spark: SparkSession, path: str, mode: str = "specific", parts: Sequence[str] | None = None, most: int = 6889) -> DataFrame:
    """Vertices of body parts from JSON files {verts_ind, faces_ind}: (part, v).

    Modes: ``all`` (one part), ``specific`` (the files' names) and ``grouped`` (left and right in one).
    The index bound holds in the first two.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = spark.read.schema("verts_ind array<int>, faces_ind array<int>").option("multiLine", True).json(path).select(name.alias("part"), F.explode("verts_ind").alias("v"))
    if parts:
        rows = rows.filter(F.col("part").isin(*parts))
    if mode == "grouped":
        return rows.select(F.regexp_replace("part", "^[LR]_", "").alias("part"), "v").distinct()
    rows = rows.filter(F.col("v") <= most)
    return (rows.select(F.lit("all").alias("part"), "v") if mode == "all" else rows).distinct()


def read_contact_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1))).cast("int").alias("v")).distinct()


def frame_pairs(files: DataFrame) -> DataFrame:
    """Adds fi and fj of names like ``flow_00012_00019.npz``; other files go."""
    pair = lambda i: F.regexp_extract("path", r"(\d+)_(\d+)\.[^./]+$", i)
    return files.withColumns({"fi": pair(1), "fj": pair(2)}).filter("fi != ''").withColumns({"fi": F.col("fi").cast("long"), "fj": F.col("fj").cast("long")})


def paired_flow(flow: DataFrame, covis: DataFrame) -> DataFrame:
    """Flow and covisibility of pairs that have both."""
    return flow.join(covis, ["fi", "fj", "y", "x"])


def resized_flow(flow: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize that rescales the vectors too."""
    from plumbline.operators.pixels import resize_nearest

    (h, w), (high, wide) = shape, to
    out = resize_nearest(flow, shape, to, ("fi", "fj"))
    return out.withColumns({"dx": F.col("dx") * (wide / w), "dy": F.col("dy") * (high / h)})


def with_defaults(row: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fills absent or null columns, such as ``dt`` of a robot package."""
    return row.withColumns({k: F.coalesce(k, F.lit(v)) if k in row.columns else F.lit(v) for k, v in defaults.items()})


def first_file(files: DataFrame) -> DataFrame:
    return files.orderBy("path").limit(1)


def split_name(column) -> tuple:
    """Date, scene and method of ``<date>_<scene>_<method>``; a method ``trimesh`` is joined to the one before it."""
    pattern = r"^([^_]+)_(.+?)_([^_]+(?:_trimesh)?)$"
    return tuple(F.regexp_extract(column, pattern, i) for i in (1, 2, 3))


def sequence_name(column):
    """What precedes ``_sgd``."""
    return F.substring_index(column, "_sgd", 1)


def frame_name(column, width: int = 5):
    """Zero-padded to ``width`` digits; longer numbers keep all of theirs."""
    digits = column.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0")


def component_key(frame, segment):
    return F.concat_ws("_", frame.cast("string"), segment.cast("string"))


def merged_config(base: dict, other: dict) -> dict:
    """Recursive merge; the other's values win."""
    return {k: merged_config(base[k], other[k]) if isinstance(base.get(k), dict) and isinstance(other.get(k), dict) else other.get(k, base.get(k)) for k in {**base, **other}}


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML file (JSON where no YAML library is installed), read through Spark."""
    import json

    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def write_recording(messages: DataFrame, path: str) -> None:
    """Ordered messages with their virtual time, compressed."""
    messages.orderBy("seq").write.mode("overwrite").option("compression", "gzip").json(path)


def joint_limits(joints: DataFrame) -> DataFrame:
    """Actuated joints in order with their limits; absent limits are -pi and pi."""
    import math

    return joints.filter("kind != 'fixed'").select("n", "name", F.coalesce("lower", F.lit(-math.pi)).alias("lower"), F.coalesce("upper", F.lit(math.pi)).alias("upper")).orderBy("n")


def joint_configuration(joints: DataFrame, values: DataFrame) -> DataFrame:
    """Values by joint name clamped into the limits; joints without one are at 0."""
    limits = joint_limits(joints)
    return limits.join(values, "name", "left").select("n", "name", F.greatest("lower", F.least("upper", F.coalesce("value", F.lit(0.0)))).alias("value"))
