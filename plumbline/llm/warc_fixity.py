"""Merkle fixity audit of WARC replicas.

A record's leaf covers its key, length, number of copies and the SHA-256 of its bytes. Records are
ordered by key and digest, which gives each its offset; a range of RANGE bytes of the primary's
offsets is a bottom node, FAN nodes make the next one up, and each node hashes its children in
order. A replica's records are dealt into the same ranges by the first record of each, so a missing
or an extra record changes one range and shifts none. Two replicas are compared from the roots down:
only children of nodes that differ are looked at, and at the bottom only their records.

A range's records are hashed in order in lists of RANGE bytes at most. The primary has one list a
range; a replica with far more records in a range has several, and their numbered hashes are added
up (four 60-bit parts), so no task holds a range of unbounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, shuffle_partitions, stored

#: Bytes of a bottom range, and children of a node.
RANGE, FAN = 1 << 16, 16


def warc_record(key: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.1 resource record, as a string; null parts are empty."""
    body, url = F.coalesce(body.cast("string"), F.lit("")), F.coalesce(url.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url)
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records_of(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to (key, length, digest, copies), equal records counted together.

    Records without an id are ordered by their digest, before all others with ids from 0 on.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), record.alias("record"))
    rows = rows.select("id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    key = F.coalesce("id", -1 - F.pmod(F.xxhash64("digest"), F.lit(2**40)))
    return rows.select(key.alias("key"), "length", "digest").groupBy("key", "length", "digest").agg(F.count("*").alias("copies"))


def placed(records: DataFrame, firsts: DataFrame | None, folder: str, name: str) -> DataFrame:
    """Adds each record's offset, and of the range that it is dealt into the number ``node`` and the ``start``.

    ``firsts(node, key, digest)`` are the first records of the ranges; without them ranges are cut at
    multiples of RANGE. Partitions of the order are summed in parallel, and one row a partition gives
    what lies before it.
    """
    rows = records.select("key", "digest", "length", "copies", F.lit(None).cast("long").alias("first"))
    if firsts is not None:
        rows = rows.unionByName(firsts.select("key", "digest", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("copies"), F.col("node").alias("first")))
    n = shuffle_partitions(records.sparkSession)
    ranged = stored(rows.repartitionByRange(n, "key", "digest").withColumn("part", F.spark_partition_id()), folder, f"{name}-ranged")
    own = W.partitionBy("part").orderBy("key", "digest", "copies")  # the mark of a range has no copies and so comes first
    before = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = ranged.withColumn("before", before)
    mark = F.when(F.col("first").isNotNull(), F.struct(F.col("first").alias("node"), F.col("before").alias("at")))
    local = local.withColumn("mark", F.last(mark, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = local.groupBy("part").agg(F.sum(F.col("length") * F.col("copies")).alias("bytes"), F.max(mark).alias("last"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    parts = parts.withColumn("base", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)))
    carried = F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("last.node").alias("node"), (F.col("last.at") + F.col("base")).alias("at"))), ignorenulls=True).over(ahead)
    parts = parts.select("part", "base", carried.alias("carried"))
    found = local.filter("copies > 0").join(F.broadcast(parts), "part").withColumn("offset", F.col("base") + F.col("before"))
    if firsts is None:
        node, start = F.floor(F.col("offset") / RANGE).cast("long"), F.floor(F.col("offset") / RANGE).cast("long") * RANGE
    else:
        node, start = F.coalesce("mark.node", "carried.node", F.lit(0)), F.coalesce(F.col("mark.at") + F.col("base"), F.col("carried.at"), F.lit(0))
    return stored(found.select("key", "digest", "length", "copies", "offset", node.cast("long").alias("node"), start.cast("long").alias("start")), folder, name)


def first_records(primary: DataFrame) -> DataFrame:
    """The first record of each range of the placed primary."""
    return primary.groupBy("node").agg(F.min(F.struct("key", "digest")).alias("f")).select("node", "f.key", "f.digest")


def _listed(rows: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda c: F.concat_ws(":", *(c[x].cast("string") for x in ("key", "digest", "length", "copies")))), "|"), 256)


def _bottom(records: DataFrame) -> DataFrame:
    """(node, hash) of the ranges."""
    first = records.groupBy("node").agg(F.min("offset").alias("least"))
    part = F.floor((F.col("offset") - F.col("least")) / RANGE).cast("long")
    lists = records.join(first, "node").groupBy("node", part.alias("part")).agg(_listed(F.struct("key", "digest", "length", "copies")).alias("hash"))
    numbered = F.sha2(F.concat_ws(":", F.col("part").cast("string"), "hash"), 256)
    parts = [F.sum(F.conv(F.substring(numbered, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    sums = lists.groupBy("node").agg(F.count("*").alias("n"), *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    return sums.select("node", F.sha2(F.concat_ws("|", "n", "p0", "p1", "p2", "p3"), 256).alias("hash"))


def _parents(nodes: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    listed = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), "|")
    return nodes.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sha2(listed, 256).alias("hash"))


def build_tree(records: DataFrame, folder: str, depth: int) -> list[DataFrame]:
    """Levels (node, hash) from the ranges up; ``depth`` levels stand above them."""
    levels = [stored(_bottom(records), folder, "level-0")]
    for k in range(1, depth + 1):
        levels.append(stored(_parents(levels[-1]), folder, f"level-{k}"))
    return levels


def _differing(ours: DataFrame, theirs: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Nodes of a level, below the given parents, whose hashes differ."""
    if parents is not None:
        above = parents.select(F.col("node").alias("up"))
        ours, theirs = (x.withColumn("up", F.floor(F.col("node") / FAN).cast("long")).join(above, "up", "left_semi") for x in (ours, theirs))
    both = ours.select("node", F.col("hash").alias("h1")).join(theirs.select("node", F.col("hash").alias("h2")), "node", "full")
    return both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select("node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Locates where two replicas of ``(page_id, url, html)`` records differ.

    Returns a row for each record that differs: key, fault (altered, missing or extra in the
    replica), offset and length in the primary (null for extra ones), and both digests. Equal
    replicas and two empty ones give no rows; against an empty one all records are missing or extra.
    Repeated records count: of one that is there in a different number, the fault is ``copies``.
    If a key has several records, those that differ are missing or extra, not altered. Null urls and
    bodies are empty ones; records without an id are known by their digest. A body of any length is
    hashed where it is read, and one longer than a range takes the range in which it starts. Other
    columns are not read.
    """
    folder = shared_folder(primary.sparkSession)
    ours = placed(records_of(primary), None, folder, "primary")
    firsts = stored(first_records(ours), folder, "firsts")
    theirs = placed(records_of(replica), firsts, folder, "replica")
    last = firsts.agg(F.max("node")).first()[0] or 0
    depth = 0
    while last // FAN**depth:
        depth += 1
    trees = [build_tree(x, f"{folder}/tree-{k}", depth) for k, x in enumerate((ours, theirs))]
    differing = None
    for level in range(depth, -1, -1):
        differing = stored(_differing(trees[0][level], trees[1][level], differing), folder, f"differing-{level}")
        if level and differing.isEmpty():
            break
    mine, other = (x.join(differing, "node", "left_semi") for x in (ours, theirs))
    if level:
        mine, other = mine.limit(0), other.limit(0)
    return _faults(mine, other)


def _faults(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Records of differing ranges that aren't the same on both sides. No step gathers the records of a key."""
    kind = ["key", "length", "digest"]
    same = mine.select(*kind, "offset", F.col("copies").alias("n1")).join(other.select(*kind, F.col("copies").alias("n2")), kind, "full")
    rest = same.filter(~F.col("n1").eqNullSafe(F.col("n2")))
    of = lambda c, side: F.max(F.when(F.col(side).isNotNull(), F.col(c))).alias(f"{c}_{side}")
    keys = rest.groupBy("key").agg(F.count("*").alias("n"), F.count("n1").alias("c1"), F.count("n2").alias("c2"), of("offset", "n1"), of("length", "n1"), of("digest", "n1"), of("digest", "n2"))
    altered = keys.filter("n = 2 AND c1 = 1 AND c2 = 1").select("key", F.lit("altered").alias("fault"), F.col("offset_n1").alias("offset"), F.col("length_n1").alias("length"), F.col("digest_n1").alias("primary_sha256"), F.col("digest_n2").alias("replica_sha256"))
    told = altered.select("key", F.explode(F.array("primary_sha256", "replica_sha256")).alias("digest"))
    lost = F.col("n1").isNotNull()
    fault = F.when(~lost, "extra").when(F.col("n2").isNull(), "missing").otherwise("copies")
    others = rest.join(told, ["key", "digest"], "left_anti").select("key", fault.alias("fault"), "offset", F.when(lost, F.col("length")).alias("length"), F.when(lost, F.col("digest")).alias("primary_sha256"), F.when(F.col("n2").isNotNull(), F.col("digest")).alias("replica_sha256"))
    return altered.unionByName(others)


#: A rehearsal's faults: the last digit of page_id's SHA-256, second to last digit 0.
ALTERED, MISSING, EXTRA = "3", "7", "b"


def rehearsal(pages: DataFrame) -> DataFrame:
    """A replica of ``pages(page_id, url, html)`` with faults, about one record in 85: altered, missing or doubled under a negative id."""
    mark = F.sha2(F.col("page_id").cast("string"), 256)
    fault = lambda digit: F.coalesce(F.endswith(mark, F.lit("0" + digit)), F.lit(False))
    kept = pages.filter(~fault(MISSING)).withColumn("html", F.when(fault(ALTERED), F.concat(F.col("html"), F.lit(" "))).otherwise(F.col("html")))
    extra = pages.filter(fault(EXTRA)).withColumn("page_id", -1 - F.col("page_id"))
    return kept.unionByName(extra)


def oracle_sql() -> str:
    """The audit of a rehearsal in DuckDB SQL, record by record."""
    record = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
    return f"""
    WITH marked AS (SELECT *, right(sha256(cast(page_id AS varchar)), 2) AS mark FROM pages),
    replica AS (
        SELECT page_id, url, CASE WHEN mark = '0{ALTERED}' THEN html || ' ' ELSE html END AS html FROM marked WHERE mark != '0{MISSING}'
        UNION ALL SELECT -1 - page_id, url, html FROM marked WHERE mark = '0{EXTRA}'),
    a AS (SELECT page_id AS key, strlen({record}) AS length, sha256({record}) AS digest FROM pages),
    b AS (SELECT page_id AS key, sha256({record}) AS digest FROM replica),
    placed AS (SELECT *, sum(length) OVER (ORDER BY key) - length AS "offset" FROM a)
    SELECT coalesce(p.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN p.key IS NULL THEN 'extra' ELSE 'altered' END AS fault,
        cast("offset" AS bigint) AS "offset", length, p.digest AS primary_sha256, b.digest AS replica_sha256
    FROM placed p FULL JOIN b ON p.key = b.key WHERE p.digest IS DISTINCT FROM b.digest"""
