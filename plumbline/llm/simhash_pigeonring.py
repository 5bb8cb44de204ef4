"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits in M segments on a ring. If two differ in at most T bits, then around the
ring there is a segment from which every chain of l segments differs in at most l * T / M bits. With
8 segments and 4 bits that gives chains with 3 equal segments among any 5, so candidates are
fingerprints that are equal in one of a few sets of three segments (24 bits). Candidates must pass
the chain test before the full Hamming check.

Distinct fingerprints only are compared. Within a candidate group a breadth-first search over the
members not yet reached yields one edge a member, not all pairs. Groups of more than CROWDED members
are split by the same principle once more: members that agree in some segments and differ in at most T
bits agree in at least one of T + 1 others, and in a task at least one of T + 1 parts of the bits in
which a group's members vary is equal. No link is lost, and no group is compared as a whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, join_counted, own_columns, shared_folder, shuffle_partitions, stored, text_of
from plumbline.operators.graph import connected_components

SEGMENTS, WIDTH = 8, 8
#: Members of a candidate group beyond which it is split by another segment, and of a part that is compared as it is.
CROWDED, TOGETHER = 32768, 4096
#: Distinct fingerprints beyond which keys have a segment more.
MANY = 10**8

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The unsigned SimHash of UTF-8 text; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch["_text"]], dtype=np.uint64).view(np.int64)
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(found)], [*kept, "fp"])

    return run


def key_sets(segments: int, most: int, exact: int) -> list[tuple[int, ...]]:
    """Sets of ``exact`` segments of which any two fingerprints within ``most`` bits agree in one at least.

    Each set is the first equal segments of a chain that the pigeonring bound allows; sets are taken
    greedily until every way of spreading errors over segments is met.
    """
    ring = [tuple(sorted((i + d) % segments for d in (0, *rest))) for i in range(segments) for rest in itertools.combinations(range(1, segments), exact - 1)]
    ring = sorted(set(ring), key=lambda s: (max((s[0] + segments - s[-1]), *(b - a for a, b in itertools.pairwise(s))) * -1, s))
    open_ = {frozenset(x) for x in itertools.combinations(range(segments), segments - min(most, segments))}
    chosen = []
    while open_:
        best = max(ring, key=lambda s: sum(x.issuperset(s) for x in open_))
        chosen.append(best)
        open_ = {x for x in open_ if not x.issuperset(best)}
    return chosen


def passes_chain(differences: np.ndarray, most: int) -> np.ndarray:
    """Whether, from some segment on, each chain stays within its proportional budget; last axis: segments."""
    m = differences.shape[-1]
    ok, total = np.ones(differences.shape, dtype=bool), np.zeros(differences.shape, dtype=np.uint8)
    for length in range(1, m + 1):
        total = total + np.roll(differences, 1 - length, axis=-1)
        ok &= total <= length * most // m
    return ok.any(axis=-1)


def linked(one: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """Boolean matrix: which pairs of fingerprints differ in at most ``most`` bits."""
    x = one[:, None] ^ others[None, :]
    b = _ONES[x.view(np.uint8).reshape(*x.shape, 8)]
    out = np.zeros(x.shape, dtype=bool)
    at = np.nonzero(passes_chain(b, most))
    out[at] = b[at].sum(axis=-1) <= most
    return out


def parts_of(members: np.ndarray, most: int, together: int) -> Iterator[np.ndarray]:
    """Parts of at most ``together`` members, or of members that vary in few bits: any two within ``most`` bits meet in one.

    The bits in which members vary are cut into most + 1 parts, of which two such members share one.
    """
    vary = int(np.bitwise_or.reduce(members ^ members[:1])) if len(members) else 0
    bits = [i for i in range(64) if vary >> i & 1]
    if len(members) <= together or len(bits) <= 2 * most:
        yield members
        return
    for chosen in np.array_split(np.array(bits, dtype=np.uint64), most + 1):
        value = members & np.uint64(sum(1 << int(i) for i in chosen))
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for part in np.split(members[order], cuts):
            if len(part) > 1:
                yield from parts_of(part, most, together)


def search_group(members: np.ndarray, most: int, tile: int = 1 << 18, together: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, seed) that join the members of a group as all its links do.

    Dense groups are soon reached whole. Once each member has been compared ``together`` times on
    average, those not yet reached are split into parts.
    """
    together = together or TOGETHER
    left, a, b, work, size = members, [], [], 0, len(members)
    while len(left) > 1:
        if work > together * size and len(left) > together:
            for part in parts_of(left, most, together):
                found = search_group(part, most, tile, len(part))
                a.append(found[0])
                b.append(found[1])
            break
        seed, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            step = max(1, tile // len(left))
            work += len(frontier[:step]) * len(left)
            found = linked(frontier[:step], left, most).any(axis=0)
            frontier = np.concatenate([frontier[step:], left[found]])
            a.append(left[found])
            b.append(np.full(int(found.sum()), seed))
            left = left[~found]
    return (np.concatenate(a), np.concatenate(b)) if a else (members[:0], members[:0])


def _compare(most: int):
    def edges(groups: list[np.ndarray]) -> pa.RecordBatch:
        found = [search_group(np.unique(g).view(np.uint64), most) for g in groups]
        a, b = (np.concatenate([x[i] for x in found] or [np.empty(0, np.uint64)]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            done = []
            for x, y in itertools.pairwise(cuts):
                if keys[x] != key and held:
                    done.append(np.concatenate(held))
                    held = []
                key = keys[x]
                held.append(fps[x:y])
            if done:
                yield edges(done)
        if held:
            yield edges([np.concatenate(held)])

    return run


def links(fps: DataFrame, *, bits: int = 4, exact: int = 3, most: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct ``fps(fp)`` that connect the same ones as all pairs within ``bits`` do.

    ``exact`` sets the key width, 8 bits a segment: 24 bits suit up to about 10**8 fingerprints, 32
    bits (70 keys in place of 22) more.
    """
    sets = key_sets(SEGMENTS, bits, exact)
    part = lambda i: F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for n, chosen in enumerate(sets):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, WIDTH).bitwiseOR(part(i))
        keys.append(F.struct(key.alias("key"), F.lit(n).alias("set")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.key", "k.set")
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(several.hint("merge"), "key").select("key", "set", "n", "fp")
    # a crowded group's members go by one of bits + 1 parts of the other bits too, of which two within the bound share one
    most, able = CROWDED if most is None else most, 64 - WIDTH * exact > bits
    if able:
        parts = F.array(*(F.array(*map(F.lit, split_masks(chosen, bits))) for chosen in sets))
        apart = F.transform(F.get(parts, F.col("set")), lambda m: F.xxhash64(F.col("key"), m, F.col("fp").bitwiseAND(m)))
        group = F.when(F.col("n") > most, apart).otherwise(F.array(F.xxhash64("key")))
    else:
        group = F.array(F.xxhash64("key"))
    n = shuffle_partitions(fps.sparkSession)
    found = members.select(F.explode(group).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key")
    return found.mapInArrow(_compare(bits), "a long, b long").distinct()


def split_masks(chosen: tuple[int, ...], bits: int) -> list[int]:
    """bits + 1 masks, as signed 64-bit numbers, that part the bits outside the chosen segments evenly."""
    rest = [WIDTH * i + b for i in range(SEGMENTS) if i not in chosen for b in range(WIDTH)]
    masks = [sum(1 << b for b in part.tolist()) for part in np.array_split(rest, bits + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grouped(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4, exact: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, text_hash (of the text as it is), fp (signed), group and component_id.

    Rows of one component have one group, a fingerprint, also where no id is known. ``exact`` is
    chosen by the number of distinct fingerprints if it isn't given; any choice gives the same links.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), text_of(docs, text).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    kind = dict(rows.dtypes)["id"]
    marked = rows.select("id", "text_hash", "_text").mapInArrow(_fingerprints(shingle), f"id {kind}, text_hash long, fp long")
    marked = stored(marked, folder, "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), folder, "distinct")
    exact = exact or (3 if fps.count() <= MANY else 4)
    found = connected_components(links(fps.select("fp"), bits=bits, exact=exact), folder)
    # tables of a row a fingerprint grow with the input: merge joins, nothing of them through the driver
    joined = fps.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp")
    parts = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked_fps = joined.select("fp", "root").join(parts.hint("merge"), "root").select("fp", "root", "component_id")
    of_fp = fps.join(linked_fps.hint("merge"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    return join_counted(marked, stored(of_fp, folder, "components"), "fp").select("id", "text_hash", "fp", "group", "component_id")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """A row for each row of ``docs``: its id, ``fp`` (signed) and ``component_id``.

    Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]+``; a text of fewer than ``shingle``
    words is one shingle; one without words, or null, has fingerprint 0 and is linked like any other.
    component_id is the smallest id reachable over links of at most ``bits`` bits; null ids don't
    count for it, and a component of null ids has none. Repeated rows stay. A text of any length is
    hashed as a whole. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    return grouped(docs, id_column=id_column, **options).select(F.col("id").alias(id_column), "fp", "component_id")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that of the smallest id, null ids last.

    Of several rows with that id the one of least text hash stays, and of equal rows one.
    """
    return chosen_rows(docs, grouped(docs, id_column=id_column, text=text, **options), id_column=id_column, text=text)


def chosen_rows(docs: DataFrame, own: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of ``own(id, text_hash, group)`` the row of ``docs`` that stays."""
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    id_name, hash_name, own_hash = (free_name(docs, n) for n in ("_kept_id", "_kept_hash", "_text_hash"))
    chosen = own.groupBy("group").agg(best.alias("b")).select(F.col("b.id").alias(id_name), F.col("b.text_hash").alias(hash_name))
    marked = docs.withColumn(own_hash, F.xxhash64(text_of(docs, text)))
    kept = marked.join(chosen, F.col(f"`{id_column}`").eqNullSafe(F.col(id_name)) & (F.col(own_hash) == F.col(hash_name)))
    return kept.dropDuplicates([id_column, own_hash]).select(*own_columns(docs))


def hexadecimal(fp):
    """16 lowercase hexadecimal digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
