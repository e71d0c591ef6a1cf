"""2. N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. A shingle's hash flips one bit of a wide sketch, so the Hamming distance
of two sketches is at most the size of the symmetric difference; with 100 * intersection >= p * union, that difference is
at most (100 - p) / (100 + p) of both sizes together (a seventh of it at 75).

Sketches are cut into parts, as many for all sets of a size band [L, 2L). Differences of up to D leave at least one of
any D + 1 parts equal. Each set puts its D + 1 parts that come first in one order, the same for all sets: parts that are
not empty before empty ones, parts that few sets share before those known to be frequent (of which there are at most
``MOST_FREQUENT``, found by counting; a different choice changes the work and not the result). By the pigeonhole
principle, two linked sets of a band have a part in common. A set just above a band is also put into that band, so that
links across its border are met. A part is sparse, wide enough for one bit of 2^64 / parts, and held as the XOR of its
shingles' hashes; a second, dense sketch of 4L bits is what distances are measured on.

Sets that share a part are compared with the least id among them, first by size and dense sketch, then exactly by
their texts. Where members of a part are in different components after that, they are compared with another leader,
drawn by a hash, ``ROUNDS`` times in all; what is in different components even then is compared pair by pair across
components, in blocks of at most ``BLOCK`` a side. Nothing is ever left out.

Cases: null and empty texts, or texts without words, have the empty set and stand alone; rows with equal sets are one
class; repeated rows are copies; rows that share an id are one document and have one component, linked with whatever any of
its texts is linked with; rows without an id link nothing and get a null component; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortlake.llm.common import mix64, release, slices, tidied, written
from cohortlake.llm.components import components
from cohortlake.llm.shingles import shingle_sets

WIDTH = 5
PERCENT = 75
MOST_FREQUENT = 1 << 20
#: A part counts as frequent from so many sets on; it is looked for where a task has an eighth of that.
FREQUENT = 64
#: Members of a frequent part that look for their leader in one task.
SPREAD = 4096
ROUNDS = 3
BLOCK = 256
#: Pairs that a task remembers, so as not to send them again; a bound on memory only.
SEEN = 1 << 18
#: Keys that a task holds before it counts them.
HELD = 1 << 21
EMPTY = np.uint64(0x9E3779B97F4A7C15)


# -- sketches --------------------------------------------------------------------------------------------------------

def parts_of(low: int) -> int:
    return max(64, low if low >= 256 else 2 * low)


def bits_of(low: int) -> int:
    return max(256, 4 * low)


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(L, D) for each band that a set of n shingles is put into: the least size of the band and the most bits that it
    can differ in from a linked set there."""
    low = 1 << (n.bit_length() - 1)
    most = lambda other: (n + other) * (100 - percent) // (100 + percent)
    out = [(low, most(100 * n // percent))]
    if low > 1 and 100 * (low - 1) >= percent * n:
        out.append((low >> 1, most(low - 1)))
    return out


def parts(h: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and keys of the parts that are not empty; h is ascending."""
    m = parts_of(low)
    place = (h >> np.uint64(64 - (m.bit_length() - 1))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[starts], part_keys(np.bitwise_xor.reduceat(h, starts), place[starts], low)


def part_keys(values: np.ndarray, places: np.ndarray, low: int) -> np.ndarray:
    return mix64(values ^ mix64(places.astype(np.uint64) + (np.uint64(low) << np.uint64(24))))


def dense(h: np.ndarray, low: int) -> bytes:
    d = bits_of(low)
    return np.packbits((np.bincount((h & np.uint64(d - 1)).astype(np.int64), minlength=d) & 1).astype(np.uint8)).tobytes()


def fold(sketch: bytes, bits: int) -> np.ndarray:
    """The sketch of fewer bits, as bytes: halves are XORed, which is what the shorter sketch would hold."""
    s = np.frombuffer(sketch, np.uint8)
    while s.size * 8 > bits:
        s = s[:s.size // 2] ^ s[s.size // 2:]
    return s


def first_parts(h: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The keys under which a set is put: D + 1 of them for each of its bands."""
    out = []
    for low, differ in bands(h.size, percent):
        places, keys = parts(h, low)
        if keys.size > differ + 1 and frequent.size:
            at = np.minimum(np.searchsorted(frequent, keys), frequent.size - 1)
            keys = keys[np.argsort(frequent[at] == keys, kind="stable")]
        if keys.size < differ + 1:
            free = np.setdiff1d(np.arange(parts_of(low)), places)[:differ + 1 - keys.size]
            keys = np.concatenate([keys, part_keys(np.full(free.size, EMPTY), free, low)])
        out.append(keys[:differ + 1])
    return np.concatenate(out)


# -- passes over the texts -------------------------------------------------------------------------------------------

def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, two hashes of the set, its dense sketch. Besides, with a null n, parts that many sets of one
    task have: part, found."""
    schema = "doc_id long, n long, k1 long, k2 long, sketch binary, part long, found long"

    def run(batches):
        seen, keys, held = set(), [], 0

        def counted():
            part, found = np.unique(np.concatenate(keys), return_counts=True)
            many = found >= FREQUENT // 8
            k = int(many.sum())
            none = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.binary()), pa.array(part[many].view(np.int64)), pa.array(found[many])], names)

        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column("text"), width)
                k1, k2, sketches = [], [], []
                for h in sets:
                    a = int(h.sum(dtype=np.uint64)) if h.size else 0
                    b = int(mix64(h ^ EMPTY).sum(dtype=np.uint64)) if h.size else 0
                    k1.append(a)
                    k2.append(b)
                    sketches.append(dense(h, 1 << (h.size.bit_length() - 1)) if h.size else None)
                    if h.size and (a, b) not in seen:
                        if len(seen) > SEEN:
                            seen.clear()  # a set that comes again then counts twice, which only makes its parts look more frequent
                        seen.add((a, b))
                        for low, _ in bands(h.size, percent):
                            keys.append(parts(h, low)[1])
                            held += keys[-1].size
                k = len(sets)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([h.size for h in sets], pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)),
                                                  pa.array(sketches, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
                if held > HELD:
                    yield counted()
                    keys, held = [], 0
        if keys:
            yield counted()
    return docs.mapInArrow(tidied(run), schema)


def put(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """(part, spread, doc) for the first set of its kind in each task. ``frequent``: a broadcast pair of arrays."""
    def run(batches):
        common, found = frequent.value
        seen = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                keys, ids = [], []
                for doc, h in zip(piece.column("doc_id").to_pylist(), shingle_sets(piece.column("text"), width)):
                    kind = (int(h.sum(dtype=np.uint64)), int(mix64(h ^ EMPTY).sum(dtype=np.uint64))) if h.size else None
                    if doc is None or kind is None or kind in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()  # a set that comes again is then put again
                    seen.add(kind)
                    keys.append(first_parts(h, percent, common))
                    ids.append(doc)
                if not keys:
                    continue
                key, doc = np.concatenate(keys), np.repeat(np.array(ids, np.int64), [k.size for k in keys])
                spread = np.zeros(key.size, np.int64)
                if common.size:
                    at = np.minimum(np.searchsorted(common, key), common.size - 1)
                    tasks = np.where(common[at] == key, 1 + found[at] // SPREAD, 1)
                    spread = np.where(tasks > 1, 1 + (mix64(doc.view(np.uint64)) % tasks.astype(np.uint64)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(spread.astype(np.int32)), pa.array(doc)], ["part", "spread", "doc"])
    return docs.mapInArrow(tidied(run), "part long, spread int, doc long")


# -- comparing -------------------------------------------------------------------------------------------------------

def close(na, nb, sa: bytes, sb: bytes, percent: int) -> bool:
    """Whether sizes and dense sketches leave it open that two sets are linked."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    bits = 8 * min(len(sa), len(sb))
    differ = int(np.bitwise_count(fold(sa, bits) ^ fold(sb, bits)).sum())
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sketches are close enough."""
    size = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}")).distinct()
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    # sizes alone rule out many pairs before sketches move
    pairs = pairs.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            keep = [close(*x, percent) for x in zip(rows["na"], rows["nb"], rows["sa"], rows["sb"])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"]).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def verified(pairs: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs, those that are linked, by exact comparison of the shingles of their texts, which ``held`` has. A
    document in very many pairs is copied once for each SPREAD of them."""
    pairs = written(pairs, "pairs")
    copies = pairs.groupBy("a").count().select(F.col("a").alias("doc_id"), (F.col("count") / SPREAD).cast("int").alias("more"))
    first = held.join(copies, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("more"))))
    spread = pairs.join(copies.withColumnRenamed("doc_id", "a"), "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int"))
    both = spread.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(first.select(F.col("doc_id").alias("a"), "copy", F.col("text").alias("ta")), ["a", "copy"]).select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "tb", 2 << 20):
                firsts = pc.dictionary_encode(piece.column("ta"))
                sa = shingle_sets(firsts.dictionary, width)
                keep = []
                for k, hb in zip(firsts.indices.to_pylist(), shingle_sets(piece.column("tb"), width)):
                    common = np.intersect1d(sa[k], hb, assume_unique=True).size
                    keep.append(100 * common >= percent * (sa[k].size + hb.size - common))
                yield piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return both.mapInArrow(tidied(run), "a long, b long").distinct()


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (top, part, i, j, block, rep, root, n, sketch) of one part, in different components, with close sketches.
    Parts with the same least member lie together, as they have many pairs in common, which then go on once."""
    rows = members.repartition("top", "i", "j").sortWithinPartitions("top", "part", "i", "j")

    def compare(g: dict[str, list], i: int, j: int) -> list[tuple[int, int]]:
        block, root, rep, n = (np.array(g[k], np.int64) for k in ("block", "root", "rep", "n"))
        order = np.argsort(n, kind="stable")
        block, root, rep, n = block[order], root[order], rep[order], n[order]
        bits = 8 * min(map(len, g["sketch"]))
        s = np.stack([fold(g["sketch"][k], bits) for k in order])
        out = []
        for k in range(n.size):  # one against all that are larger, but not by too much
            upto = np.searchsorted(n, 100 * n[k] // percent, "right")
            far = np.bitwise_count(s[k + 1:upto] ^ s[k]).sum(axis=1)
            ok = (root[k + 1:upto] != root[k]) & ((100 + percent) * far <= (100 - percent) * (n[k] + n[k + 1:upto]))
            if i != j:
                ok &= block[k + 1:upto] != block[k]
            out += [(min(rep[k], x), max(rep[k], x)) for x in rep[k + 1:upto][ok].tolist()]
        return out

    def run(batches):
        last, held = None, None
        names = ["block", "rep", "root", "n", "sketch"]
        seen = set()

        def new(found):
            """Pairs that this task has not sent lately: many parts have the same two members."""
            found = sorted(set(found) - seen)
            if len(seen) > SEEN:
                seen.clear()
            seen.update(found)
            return found

        for batch in batches:
            rows = batch.to_pydict()
            keys = list(zip(rows["part"], rows["i"], rows["j"]))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            found = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != last:
                    if held:
                        found += compare(held, *last[1:])
                    last, held = keys[a], {c: [] for c in names}
                for c in names:
                    held[c] += rows[c][a:b]
            found = new(found)
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held:
            found = new(compare(held, *last[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    return rows.mapInArrow(tidied(run), "a long, b long").distinct()


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(part, rep, root) for the parts whose members are in several components."""
    members = members.select("part", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    several = members.groupBy("part").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("part")
    return members.join(several, "part", "left_semi")


def joined(links: DataFrame, roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and roots with more links between components."""
    more = written(more, "links")
    if more.isEmpty():
        return links, roots
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    upper = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    upper = components(upper).select(F.col("node").alias("root"), F.col("root").alias("next"))
    # a node that had no link until now is its own root
    new = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    roots = roots.union(new).join(upper, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return links.union(more), written(roots, "roots")


# -- the join --------------------------------------------------------------------------------------------------------

def join(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal sets (a, b: the least ids of both classes), enough of them to connect whatever is
    linked, and the membership: doc_id, n_shingles, class_id, component_id per row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = written(describe(docs, width, percent), "sets")
    sets = described.where("n is not null").select("doc_id", "n", "k1", "k2", "sketch")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    reps = classes.select("rep", "n", "sketch")
    nodes = written(sets.drop("sketch").join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "rep"), "nodes")
    of_doc = nodes.where("rep is not null").select("doc_id", "rep").distinct()

    counted = described.where("part is not null").groupBy("part").agg(F.sum("found").alias("found")).where(F.col("found") >= FREQUENT)
    top = counted.orderBy(F.desc("found"), "part").limit(MOST_FREQUENT).toArrow()
    common = top.column("part").to_numpy().view(np.uint64)
    order = np.argsort(common)
    frequent = spark.sparkContext.broadcast((common[order], top.column("found").to_numpy()[order]))

    rows = put(docs, width, percent, frequent)
    together = W.partitionBy("part", "spread")
    rows = rows.withColumn("leader", F.min("doc").over(together)).withColumn("members", F.count(F.lit(1)).over(together))
    shared = written(rows.where("members > 1 or spread > 0").select("part", "spread", "doc", "leader", "members"), "shared")
    del rows
    release(spark)
    stars = shared.where("doc != leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    # the leaders of a part that was spread over tasks look up to the least of them
    heads = shared.where("spread > 0").groupBy("part", "spread").agg(F.min("leader").alias("b"))
    heads = heads.join(heads.groupBy("part").agg(F.min("b").alias("a")), "part").where("a != b").select("a", "b")
    pairs = stars.union(heads).distinct()
    as_rep = lambda x: of_doc.select(F.col("doc_id").alias(x), F.col("rep").alias(f"{x}_rep"))
    pairs = pairs.join(as_rep("a"), "a").join(as_rep("b"), "b").where("a_rep != b_rep")
    pairs = pairs.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct()
    # from here on, only documents that share a part with another one matter
    sharing = shared.select("doc").distinct().join(as_rep("doc"), "doc").select(F.col("doc_rep").alias("doc_id")).distinct()
    held = docs.join(sharing, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    held = written(held, "candidates")
    release(spark)
    # the classes of one id are one document's, and linked by it
    first = of_doc.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("doc_id", "a")
    same = of_doc.join(first, "doc_id").select("a", F.col("rep").alias("b")).where("a != b").distinct()
    links = written(verified(likely(pairs, reps, percent), held, width, percent).union(same), "links")
    roots = components(links)

    # two members have been compared; more may need other pairs than those with their leader
    members = shared.where("members > 2 or spread > 0").join(as_rep("doc"), "doc").select("part", F.col("doc_rep").alias("rep"))
    members = unsettled(members.distinct(), roots)
    kinds = members.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("f1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("f2"))
    kinds = kinds.where("size > 2").groupBy("size", "f1", "f2").agg(F.min("part").alias("part")).select("part")
    members = written(members.join(kinds, "part", "left_semi").select("part", "rep"), "unsettled")
    for k in range(1, ROUNDS):
        rooted = unsettled(members, roots)
        chief = F.min_by(F.struct("rep", "root"), F.xxhash64("rep", "part", F.lit(k)))
        tried = rooted.join(rooted.groupBy("part").agg(chief.alias("chief")), "part").where("chief.root != root")
        tried = tried.select(F.least("rep", "chief.rep").alias("a"), F.greatest("rep", "chief.rep").alias("b")).distinct()
        links, roots = joined(links, roots, verified(likely(tried, reps, percent), held, width, percent))

    rooted = unsettled(members, roots)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rooted = rooted.join(rooted.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("top")), "part").withColumn("blocks", blocks).join(reps, "rep")
    rooted = rooted.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    rooted = rooted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rooted = rooted.select("top", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "root", "n", "sketch")
    links, roots = joined(links, roots, verified(across(rooted, percent), held, width, percent))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = roots.join(least, "root").select(F.col("node").alias("rep"), "component_id")
    # a row without words has the component of its document's other rows, if there are any
    bare = nodes.where("rep is null").drop("rep").join(of_doc.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").withColumn("class_id", F.col("doc_id"))
    nodes = nodes.where("rep is not null").withColumn("class_id", F.col("rep")).unionByName(bare)
    out = nodes.join(named, "rep", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
                                                   F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id")).alias("component_id"))
    return links, out
