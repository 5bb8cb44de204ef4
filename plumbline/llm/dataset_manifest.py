"""Merkle manifest of a dataset: a tree for each source, and a tree over their roots.

Bottom-up, every ``WIDTH`` consecutive nodes become one; each level is written to the shared folder.
Top-down, the levels are joined again, children to parents: a child puts the siblings it has in its
parent's run before the proof that the parent inherited. Places come from ranges of sorted leaves,
numbered in parallel, so a source with a third of all rows is spread like any other, and no step
holds more than a run of ``WIDTH`` nodes together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, shuffle_partitions, stored

#: Consecutive nodes that become one.
WIDTH = 16

#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STEP = "struct<left:string,right:string>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """The digest of a row's values: ``-`` for null, else byte count, ``:`` and the value."""
    written = (v.cast("string") for v in values)
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written)))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``key``, ``source`` and ``leaf`` of each row, and ``seen``: its leaf, or that of a tampered row.

    Tampered are the rows where 5 divides the CRC-32 of the decimal key: text in lower case. A null
    key is never tampered.
    """
    of = {c: F.col(f"`{c}`") for c in columns}
    own = leaf_of(*of.values())
    if "text" not in of:
        return docs.select(of[key].alias("key"), of[source].cast("string").alias("source"), own.alias("leaf"), own.alias("seen"))
    changed = lowered(of["text"].cast("string"))
    hit = (F.crc32(of[key].cast("string").cast("binary")) % 5 == 0) & (changed != of["text"].cast("string"))
    return docs.select(of[key].alias("key"), of[source].cast("string").alias("source"), own.alias("leaf"), F.when(hit, leaf_of(*(of | {"text": changed}).values())).alias("other")).select("key", "source", "leaf", F.coalesce("other", "leaf").alias("seen"))


def placed(found: DataFrame, folder: str) -> tuple[DataFrame, int, int]:
    """Leaves as nodes: ``tree``, the source's number in order, ``place`` in it and ``size``, its leaves.

    Also the number of sources, and the leaves of the largest.
    """
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("key"), "leaf", "seen"]
    ranged = found.repartitionByRange(shuffle_partitions(found.sparkSession), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), folder, "sorted")
    parts = ranged.groupBy("range", "source").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("range")) - F.col("n")  # a row for each range that holds the source
    parts = parts.select("*", before.alias("start"), F.sum("n").over(W.partitionBy("source")).alias("size"))
    parts = parts.withColumn("begun", F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).over(W.partitionBy("range").orderBy(F.asc_nulls_first("source"))))
    parts = stored(parts, folder, "parts")
    begun = parts.groupBy("range").agg(F.max("begun").alias("b"))
    earlier = begun.select("range", (F.sum("b").over(W.orderBy("range")) - F.col("b")).alias("earlier"))  # a row a range
    trees = parts.join(F.broadcast(earlier), "range").select(F.col("range").alias("r"), F.col("source").alias("s"), "first", "start", "size", (F.col("earlier") + F.col("begun") - 1).alias("tree"))
    nodes = ranged.join(trees, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    nodes = nodes.select("tree", (F.col("at") - F.col("first") + F.col("start")).alias("place"), "size", F.col("leaf").alias("hash"), "key", "seen")
    most = parts.agg(F.max("size").alias("most"), F.sum(F.when(F.col("start") == 0, 1)).alias("trees")).first()
    return nodes, most["trees"] or 0, most["most"] or 0


def parent(place: Column | str) -> Column:
    return F.floor((F.col(place) if isinstance(place, str) else place) / WIDTH)


def build(nodes: DataFrame, most: int, folder: str, name: str) -> list[DataFrame]:
    """The levels of all trees, written one by one: ``tree``, ``place``, ``size`` (nodes of this tree on this level), ``hash`` and, above the leaves, ``run``: the children's hashes."""
    levels = [stored(nodes, folder, f"{name}-0")]
    while most > 1:
        run = F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
        grown = levels[-1].filter("size > 1").groupBy("tree", parent("place").alias("up")).agg(F.max("size").alias("n"), run.alias("run"))
        grown = grown.select("tree", F.col("up").alias("place"), F.ceil(F.col("n") / WIDTH).alias("size"), digest(F.concat_ws("", "run")).alias("hash"), "run")
        levels.append(stored(grown, folder, f"{name}-{len(levels)}"))
        most = -(-most // WIDTH)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree`` and the hash of its last node."""
    tops = [level.filter("size = 1").select("tree", "hash") for level in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def push(levels: list[DataFrame], inherited: DataFrame, folder: str, name: str) -> DataFrame:
    """The lowest level with ``proof``, an array of the siblings left and right of each node up the tree, and the other columns of ``inherited``.

    ``inherited``: ``tree``, ``proof`` that its top node starts from, and columns to hand down.
    """
    handed = [c for c in inherited.columns if c != "tree"]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        columns = [c for c in level.columns if c != "run" or k]
        out = level.filter("size = 1").join(inherited, "tree").select(*columns, *handed)
        if above is not None:
            over = above.select(F.col("tree").alias("t"), F.col("place").alias("up"), F.col("run").alias("brothers"), *handed)
            at = (F.col("place") % WIDTH).cast("int")
            step = F.struct(F.concat_ws("", F.slice("brothers", F.lit(1), at)).alias("left"), F.concat_ws("", F.slice("brothers", at + 2, F.lit(WIDTH))).alias("right"))
            joined = level.filter("size > 1").join(over, (F.col("tree") == F.col("t")) & (parent("place") == F.col("up")))
            joined = joined.select(*columns, *(F.concat(F.array(step), F.col("proof")).alias(c) if c == "proof" else F.col(c) for c in handed))
            out = joined.unionByName(out)
        above = stored(out, folder, f"{name}-proof-{k}") if k else out
    return above


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(proof, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proofs(found: DataFrame) -> DataFrame:
    """``key``, ``leaf``, ``seen``, ``proof``, ``subroot`` and ``root`` of rows as ``leaves`` gives them."""
    spark = found.sparkSession
    folder = shared_folder(spark)
    nodes, trees, most = placed(stored(found, folder, "leaves"), folder)
    levels = build(nodes, most, folder, "rows")
    subroots = stored(roots(levels), folder, "subroots")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("size"), "hash", F.col("hash").alias("subroot"))
    upper = build(top, trees, folder, "sources")
    root = roots(upper).select("tree", F.col("hash").alias("root"))
    over = push(upper, root.select("tree", F.array().cast(f"array<{_STEP}>").alias("proof"), "root"), folder, "sources")
    over = stored(over.select(F.col("place").alias("tree"), "proof", "subroot", "root"), folder, "inherited")
    return push(levels, over, folder, "rows").select("key", F.col("hash").alias("leaf"), "seen", "proof", "subroot", "root")


def audit(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Each row's leaf, roots and proof, and whether a rehearsal's tampered copy still leads to the root.

    A null in any of ``columns`` is a value of its own; a null source is the first tree, a null key
    the first leaf of its source, and never tampered. Rows of one key are ordered by their leaves,
    repeated rows are leaves each. A lone leaf is its source's root, a lone source's the dataset's.
    Texts of any length are hashed whole where they are read. An empty table gives no rows. Columns
    that aren't named are not read, so they may have any names.
    """
    found = proofs(leaves(docs, columns, key, source))
    back = found.withColumn("folded_root", folded(F.col("seen"), F.col("proof")))
    path = F.concat_ws("", F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"]))))
    return back.select(F.col("key").alias(key), "leaf", "subroot", "root", digest(path).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql(levels: int = 7) -> str:
    """The query's rows in DuckDB SQL; so many levels reach for 16**levels rows a source."""
    w = WIDTH
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("cast(doc_id AS varchar)", "source", "lang", "cast(n_chars AS varchar)", text)) + ")"
    bits = "list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c)::ubigint)), lambda crc, b: {bits}), 4294967295::ubigint)"
    low = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    ctes = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS seen FROM documents)",
        "a0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS place, count(*) OVER (PARTITION BY source) AS size, leaf AS hash FROM leaves)",
    ]
    for t in ("a", "b"):
        if t == "b":
            ctes.append(f"b0 AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS size, hash FROM a{levels})")
        for k in range(levels):
            ctes.append(f"{t}{k + 1} AS (SELECT tree, place // {w} AS place, (max(size) + {w - 1}) // {w} AS size, list(hash ORDER BY place) AS run, CASE WHEN max(size) > 1 THEN sha256(string_agg(hash, '' ORDER BY place)) ELSE max(hash) END AS hash FROM {t}{k} GROUP BY tree, place // {w})")
    # each level's siblings are strings beside the leaf; a tree that has ended adds none
    ctes.append("f0 AS (SELECT doc_id, leaf, tree, place, size, seen AS h, '' AS proof FROM a0)")
    n = 0
    for t in ("a", "b"):
        for k in range(levels):
            up = f"{t}{k + 1}"
            left, right = f"array_to_string(u.run[1:f.place % {w}], '')", f"array_to_string(u.run[f.place % {w} + 2:{w}], '')"
            own = "f.doc_id, f.leaf" + (", f.subroot" if t == "b" else "")
            ctes.append(f"f{n + 1} AS (SELECT {own}, f.tree, u.place, u.size, CASE WHEN f.size > 1 THEN sha256({left} || f.h || {right}) ELSE f.h END AS h, f.proof || CASE WHEN f.size > 1 THEN {left} || {right} ELSE '' END AS proof FROM f{n} f JOIN {up} u ON u.tree = f.tree AND u.place = f.place // {w})")
            n += 1
        if t == "a":
            ctes.append(f"f{n + 1} AS (SELECT f.doc_id, f.leaf, r.hash AS subroot, 0 AS tree, f.tree AS place, b0.size, f.h, f.proof FROM f{n} f JOIN a{levels} r ON r.tree = f.tree JOIN b0 ON b0.place = f.tree)")
            n += 1
    return f"WITH {', '.join(ctes)} SELECT f.doc_id, f.leaf, f.subroot, r.hash AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.hash AS verified FROM f{n} f, b{levels} r"
