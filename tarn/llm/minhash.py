"""Near-dedup by b-bit MinHash: banded candidates, estimates from packed low bits, confirmation on full sets.

1. One pass makes each document's set of shingle hashes, a fingerprint of the set, the low ``BITS`` bits of HASHES minima
   packed as bit planes, and a hash of each band's minima; the threshold says how many rows and bands there are.
2. Documents with equal sets are one class; its smallest id stands for it.
3. Classes that share a band are linked to the smallest of the bucket: rows grow as the classes, never as their pairs.
   The connected components of these links are clusters, which hold every pair that shares a band.
4. A cluster is dealt into blocks of bounded size, each with a few hubs that all blocks of the cluster share: signatures
   are compared by bit counts, the similarity estimate corrected for chance collisions, and what may reach the
   threshold is confirmed on full sets, unless both are connected already. A block returns a spanning forest of
   confirmed links, and says which of its members are connected with the cluster's first hub.
5. In a cluster of several blocks, the members that aren't are compared in the same way to all others: pairs among those
   that are, of which there may be very many copies and which would grow with their square, are never made.
6. The components of all forests are the answer.

A pair at the threshold is missed with probability below 2e-6: by the bands at most MISSED, for which ``banding`` chooses
them (at 0.85, 44 bands of 8 rows: (1 - 0.85**8)**44 = 8e-7), by the estimate (4.75 standard deviations) 1e-6.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, held, materialise, partitions
from .words import scramble, word_hashes

SHINGLE = 5
HASHES, BITS = 352, 2
#: A band has so many rows at most, and the bands miss a pair at the threshold with so much probability at most.
MOST_ROWS, MISSED = 8, 1e-6
#: Standard deviations of the estimate below the threshold at which a pair is still confirmed.
MARGIN = 4.75
#: A block holds about so many members and shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20
#: Members of a large cluster, about, that are in each of its blocks.
HUBS = 16

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
MIX = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, 8, dtype=np.uint64)]


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles: ``size`` words, or all of them where there are fewer."""
    sets = []
    for h in word_hashes(texts):
        k = min(size, len(h))
        out = np.zeros(len(h) - k + 1 if k else 0, dtype=np.uint64)
        for i in range(k):
            out = scramble((out ^ h[i : i + len(out)]) * MIX[i % len(MIX)])
        sets.append(np.unique(out + np.uint64(k)))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The HASHES minima of each (non-empty) set."""
    flat = np.concatenate(sets)
    low = scramble(flat.copy()).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((HASHES, len(sets)), dtype=np.uint32)
    hashed = np.empty_like(low)
    for k in range(HASHES):
        np.multiply(low, FACTORS[k], out=hashed)
        hashed += OFFSETS[k]
        hashed ^= hashed >> np.uint32(15)
        out[k] = np.minimum.reduceat(hashed, starts)
    return out.T.copy()


def packed(minima: np.ndarray) -> np.ndarray:
    """Bit planes of the minima's low BITS bits: (documents, BITS, words of 64)."""
    planes = [np.packbits((minima >> np.uint32(7 + b)).astype(np.uint8) & 1, axis=1) for b in range(BITS)]
    planes = [np.pad(p, ((0, 0), (0, -p.shape[1] % 8))) for p in planes]
    return np.stack([np.ascontiguousarray(p).view(np.uint64) for p in planes], axis=1)


def banding(threshold: float) -> tuple[int, int]:
    """(rows, bands): the most rows, and the fewest bands of them, that miss a pair at the threshold with MISSED at most."""
    for rows in range(MOST_ROWS, 0, -1):
        for bands in range(1, HASHES // rows + 1):
            if (1 - threshold**rows) ** bands <= MISSED:
                return rows, bands
    raise ValueError(f"{HASHES} minima don't find all pairs at a similarity of {threshold}")


def band_hashes(minima: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit hash of each band's minima, with the band's number in it: (documents, bands)."""
    parts = minima[:, : rows * bands].reshape(len(minima), bands, rows).astype(np.uint64)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), 1))
    for r in range(rows):
        out = scramble((out ^ parts[:, :, r]) * MIX[r])
    return out


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many: equal low bits, less those that are equal by chance."""
    unequal = one[0] ^ many[:, 0]
    for b in range(1, BITS):
        unequal |= one[b] ^ many[:, b]
    equal = 1 - np.bitwise_count(unequal).sum(axis=1, dtype=np.int64) / HASHES
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """The estimate below which a pair at the threshold falls with probability 1e-6."""
    chance = 0.5**BITS
    p = threshold + (1 - threshold) * chance
    return threshold - MARGIN * float(np.sqrt(p * (1 - p) / HASHES)) / (1 - chance)


def digests(docs: DataFrame, size: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, fingerprint, sig, bands); the last three are null for empty sets."""
    import pyarrow as pa

    def digest(batches):
        for batch in bounded_batches(batches, 128):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            prints, sigs, banded = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                minima = signatures([sets[i] for i in full])
                planes, hashes = packed(minima), band_hashes(minima, rows, bands).view(np.int64)
                for row, i in enumerate(full):
                    prints[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    sigs[i] = planes[row].tobytes()
                    banded[i] = hashes[row]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["id", "n_shingles", "fingerprint", "sig", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(digest, "id long, n_shingles long, fingerprint binary, sig binary, bands array<long>")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges (a, b) but the smallest ones themselves.

    Alternating large and small stars, each round written to the shared folder: a node with very many neighbours is
    one row a task in the aggregates, and one row on the other side of a join that Spark splits.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name, small=True)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # held, so that the join reads it as a plain side and Spark can split a hot node's rows on the other
        mins = held(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")))
        large = held(both.join(mins, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = held(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name, small=True)
        for done in (least, large, mins):
            done.unpersist()
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark


def _forest(members: list[tuple], threshold: tuple[int, int], floor: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Confirmed links among the members (side, id, set, sig, label, ...) of one group; with two sides, only those across them.

    A spanning forest of them, on top of equal labels, which are connected already; and the tree that each member is in.
    """
    sides = np.array([m[0] for m in members])
    known: dict[int, int] = {}
    above = [known.setdefault(m[4], i) for i, m in enumerate(members)]
    labels = np.array(above)
    sizes = np.array([len(m[2]) for m in members])
    sigs = np.stack([m[3] for m in members])
    across = sides.min() != sides.max()
    first = np.flatnonzero(sides == sides.min()) if across else np.arange(len(members))
    pairs = [np.empty((0, 3))]
    for i in first:
        rest = np.flatnonzero(sides != sides[i]) if across else np.arange(i + 1, len(members))
        rest = rest[labels[rest] != labels[i]]
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[small * threshold[1] >= large * threshold[0]]
        if len(rest):
            e = estimate(sigs[i], sigs[rest])
            at = e >= floor
            pairs.append(np.column_stack([np.full(at.sum(), i), rest[at], -e[at]]))
    todo = np.concatenate(pairs)
    todo = todo[np.argsort(todo[:, 2], kind="stable")][:, :2].astype(np.int64)
    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    links = []
    for i, j in todo.tolist():
        a, b = top(i), top(j)
        if a == b:
            continue
        x, y = members[i][2], members[j][2]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int(np.count_nonzero(y[at] == x))
        if threshold[1] * both >= threshold[0] * (len(x) + len(y) - both):
            above[a] = b
            links.append((members[i][1], members[j][1]))
    return links, [top(i) for i in range(len(members))]


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (85, 100), size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Words are what ASCII white space separates, A-Z lower-cased; the set of a document is its distinct shingles of
    ``size`` words, or all of its words as one where it has fewer. Documents are linked where
    intersection / union >= threshold (a fraction, not so low that ``banding`` rejects it); component_id is the smallest id reachable, kept says whether that
    is the document itself. Null texts and texts without words have empty sets, are linked with nothing and kept. Rows
    of one id are one document, linked as any of them is, each returned; a row of null id is linked with nothing and
    kept. Empty tables give empty results; other columns of docs are not read.
    """
    spark = docs.sparkSession
    all_docs = materialise(digests(docs, size, *banding(threshold[0] / threshold[1]), id_col, text_col), "digests")
    sets = all_docs.where("fingerprint IS NOT NULL AND id IS NOT NULL")
    same = sets.groupBy("fingerprint").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    same = materialise(same, "classes", small=True)
    banded = same.select("rep", F.explode("bands").alias("band"))
    shared = materialise(banded.groupBy("band").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least"), "bands", small=True)
    stars = banded.join(shared, "band").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    clusters = components(stars, "clusters")
    members = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    members = members.join(same.select(F.col("rep").alias("node"), "fingerprint", "n", "sig"), "node")
    members = materialise(members, "members")
    links = _confirmed(spark, members, docs, threshold, size, id_col, text_col)
    found = components(materialise(links, "confirmed"), "near")
    # several classes of one id are one document
    ids = same.select("fingerprint", F.col("rep").alias("node"))
    joined = all_docs.select("id", "n_shingles", "fingerprint").join(ids, "fingerprint", "left").join(found, "node", "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "node", "id"))
    id_type = docs.schema[id_col].dataType
    return joined.select(F.col("id").cast(id_type).alias(id_col), "n_shingles", component.cast(id_type).alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, as they are."""
    gone = near_duplicates(docs, id_col=id_col, **how).where("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def _confirmed(spark: SparkSession, members: DataFrame, docs: DataFrame, threshold: tuple[int, int], size: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between members of one cluster, confirmed on their full sets: a spanning forest for each group of blocks."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    # all but the clusters of several blocks, of which there are at most rows / BLOCK_ROWS + shingles / BLOCK_SHINGLES
    large = members.groupBy("component").agg(blocks.alias("blocks"), F.greatest(F.floor(F.count(F.lit(1)) / HUBS), F.lit(1)).alias("to_hub")).where("blocks > 1")
    dealt = members.join(large, "component", "left").withColumn("own", F.pmod(F.xxhash64("node", "fingerprint"), F.coalesce("blocks", F.lit(1))).cast("int"))
    text = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("node IS NOT NULL")
    # all texts are shuffled once, and those of clusters written for both rounds
    dealt = materialise(dealt.join(text, "node"), "cluster-texts")
    hub = (F.col("node") == F.col("component")) | (F.pmod(F.xxhash64("node", "fingerprint", F.lit(1)), F.col("to_hub")) == 0)
    near = dealt.withColumn("others", F.when(F.col("blocks").isNotNull() & hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))
    near = near.select("*", F.col("node").alias("label"), F.col("blocks").isNotNull().alias("tell")).withColumn("one", F.explode("others")).withColumn("two", F.col("one"))
    found = materialise(_links(near, threshold, size), "links-in-blocks")
    links = found.where("mark IS NULL").select("a", "b")
    labels = found.where("mark IS NOT NULL").select(F.col("a").alias("node"), F.col("mark").alias("fingerprint"), F.col("b").alias("label"))
    outside = F.col("label") != F.col("component")
    if labels.isEmpty():
        return links

    labelled = members.join(labels, ["node", "fingerprint"])
    many = lambda those: F.greatest(F.ceil(F.count_if(those) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(those, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    # clusters with members that aren't connected with the first hub: blocks of these, and blocks of those that are
    plan = materialise(labelled.groupBy("component").agg(many(outside).alias("rest"), many(~outside).alias("mains")).where("rest > 0"), "rest")
    if plan.isEmpty():
        return links
    todo = labelled.join(plan, "component").withColumn("tell", F.lit(False))
    mark = F.xxhash64("node", "fingerprint", F.lit(2))
    todo = todo.withColumn("own", F.when(outside, F.pmod(mark, F.col("rest"))).otherwise(F.col("rest") + F.pmod(mark, F.col("mains"))).cast("int"))
    todo = todo.withColumn("others", F.sequence(F.lit(0), F.when(outside, F.col("rest") + F.col("mains")).otherwise(F.col("rest")) - 1))
    todo = todo.join(dealt.where("blocks IS NOT NULL").select("node", "fingerprint", "text"), ["node", "fingerprint"]).withColumn("other", F.explode("others")).withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    return links.unionByName(_links(todo, threshold, size).select("a", "b"))


def _links(work: DataFrame, threshold: tuple[int, int], size: int) -> DataFrame:
    """Links (a, b) within each group (component, one, two) of work: among all members where one = two, else between those whose own blocks differ.

    In groups with ``tell`` one row follows for each member of that block: its node as a, its fingerprint as mark, and as
    b the component's node where both are connected, else the smallest node of its tree.
    """
    import pyarrow as pa

    floor, group = least_estimate(threshold[0] / threshold[1]), ["component", "one", "two"]
    work = work.select(*group, "own", "node", "fingerprint", "sig", "text", "label", "tell")
    work = work.repartition(partitions(work.sparkSession), *group).sortWithinPartitions(*group, "own", "node")

    def confirm(batches):
        now, held, tell = None, {}, False

        def done():
            members = list(held.values())
            out, trees = _forest(members, threshold, floor)
            rows = [(a, b, None) for a, b in out]
            if tell:
                name: dict[int, int] = {}
                for m, t in zip(members, trees, strict=True):
                    name[t] = min(m[1], name.get(t, m[1]))  # no node is below the component's
                rows += [(m[1], name[t], m[5]) for m, t in zip(members, trees, strict=True) if m[6]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["a", "b", "mark"])

        for batch in bounded_batches(batches, 512):
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            columns[7] = shingle_sets(columns[7], size)
            for row in zip(*columns, strict=True):
                key, own, node, mark, sig, found, label, telling = row[:3], *row[3:]
                if key != now:
                    if held:
                        yield done()
                    now, held, tell = key, {}, telling
                # rows of one id with other texts have sets of their own
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == mark:
                    side = 0 if key[1] == key[2] else own
                    held[side, node, mark] = (side, node, found, np.frombuffer(sig, dtype=np.uint64).reshape(BITS, -1), label, mark, own == key[1])
        if held:
            yield done()

    return work.mapInArrow(confirm, "a long, b long, mark binary")
