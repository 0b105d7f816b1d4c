"""Jaccard join on word n-grams by chosen paths.

Each text is the set of hashes of its word n-grams. Texts with the same set form one class, of which one text stands
for all. A set is embedded as `coords` coordinates, each the smallest n-gram of one hash bin, so two sets agree on a
coordinate with a probability equal to their Jaccard similarity. Each run splits all sets recursively: a
bucket draws coordinates (1/threshold of them on average) and each value of a drawn coordinate makes a smaller bucket;
buckets of one die, small ones are compared by brute force on the coordinates, with a margin of four standard
deviations; a bucket still large at the last level is one star of candidates. The number of runs follows from the target recall. What was found is grouped, the whole n-gram sets of
each group are brought together, and every pair of a group is compared exactly. A large group is dealt out
as pairs of blocks of about `grams` n-grams, so no task holds more than two blocks. What leaves a task is one row per set: its number of
partners and one link of a spanning forest, never the pairs.

Defined results: texts without words (null and empty ones too) link to nothing; a text of fewer words than an n-gram
is one n-gram; repeated rows are copies of each other; rows that repeat an id with another text make one document;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common, textnum
from gridloom.llm.graph import components

COORDS = 128
_PROBE = np.stack([np.random.default_rng(1000 + k).permutation(COORDS) for k in range(COORDS)])
_EDGES = np.array([k << 57 for k in range(COORDS)] + [2**64 - 1], np.uint64)


def embed(unique: np.ndarray) -> np.ndarray:
    """COORDS 32-bit values of a sorted set of hashes: the least of each bin, an empty bin borrowing from a full one."""
    at = np.searchsorted(unique, _EDGES)
    value = (unique[np.minimum(at[:-1], len(unique) - 1)] >> np.uint64(20)).astype(np.uint32)
    full = at[1:] > at[:-1]
    if full.all():
        return value
    return value[_PROBE[np.arange(COORDS), np.argmax(full[_PROBE], axis=1)]]


def sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, sig): size, 128-bit key and coordinates of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, off in textnum.text_slices(b.column(1)):
                _, _, h, bounds = textnum.words(raw, off)
                s, at = textnum.shingles(h, bounds, words)
                out = []
                for k in range(j - i):
                    u = textnum.different(s[at[k] : at[k + 1]])
                    key = textnum.mix(u) if len(u) else u
                    out.append((len(u), int(key.sum(dtype=np.uint64).view(np.int64)), int(textnum.mix(key + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), embed(u).tobytes() if len(u) else None))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["id", "n", "k1", "k2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, k1 long, k2 long, sig binary")


def dealt(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows with lo and hi: one group a key of one block, else one for each pair of its blocks."""
    rows = rows.withColumn("block", F.when(F.col(blocks) > 1, F.pmod(F.xxhash64("node", F.col(key)), F.col(blocks))).otherwise(0).cast("int"))
    others = F.sequence(F.lit(0), F.col(blocks) - 1)
    return rows.withColumn("_o", F.explode(others)).withColumn("lo", F.least("block", "_o")).withColumn("hi", F.greatest("block", "_o")).drop("_o")


def coordinate_links(sig: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first row of its connected group, rows being linked if enough coordinates agree."""
    root = np.full(len(sig), -1)
    margin = 4 * math.sqrt(threshold * (1 - threshold))
    for lead in range(len(sig)):
        if root[lead] >= 0:
            continue
        root[lead] = lead
        queue = [lead]
        while queue:
            x = queue.pop()
            open_ = np.flatnonzero(root < 0)
            if not len(open_):
                break
            least = threshold - margin / np.sqrt(np.minimum(COORDS, np.minimum(n[x], n[open_])))
            near = open_[((sig[open_] == sig[x]).mean(axis=1) >= least) & (np.minimum(n[x], n[open_]) >= threshold * np.maximum(n[x], n[open_]))]
            root[near] = lead
            queue.extend(near.tolist())
    return root


def exact_links(hashes: list[np.ndarray], weight: np.ndarray, block: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(first row of the linked group, weight of all partners) by exact Jaccard similarity; with cross, only between different blocks."""
    m = len(hashes)
    size = np.array([len(h) for h in hashes])
    column = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), size)
    times = np.bincount(column)
    # n-grams of many rows are bits, so that a pair takes some words; those of a few are lists of rows; those of one row can't count
    many = times > max(1, m // 32)
    place = np.cumsum(many) - 1
    wide = (int(many.sum()) + 63) // 64 or 1  # at most 32 bits an n-gram of all rows
    bits = np.zeros((m, wide), np.uint64)
    dense = many[column]
    np.bitwise_or.at(bits, (owner[dense], place[column[dense]] // 64), np.uint64(1) << (place[column[dense]] % 64).astype(np.uint64))
    some = ~dense & (times[column] > 1)
    order = np.argsort(column[some], kind="stable")
    rows_of, first = owner[some][order], np.searchsorted(column[some][order], np.arange(len(times) + 1))
    own_first = np.searchsorted(owner[some], np.arange(m + 1))
    own_column = column[some]
    root, partners = np.arange(m), np.zeros(m, np.int64)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(m - 1):
        later = np.arange(i + 1, m)
        ok = np.minimum(size[i], size[later]) >= threshold * np.maximum(size[i], size[later]) - 1e-9
        if cross:
            ok &= block[later] != block[i]
        later = later[ok]
        if not len(later):
            continue
        mine = own_column[own_first[i] : own_first[i + 1]]
        shared = np.bincount(rows_of[textnum.ranges(first[mine], first[mine + 1] - first[mine])], minlength=m)
        step = max(1, (1 << 22) // wide)
        for at in range(0, len(later), step):
            part = later[at : at + step]
            both = np.bitwise_count(bits[part] & bits[i]).sum(axis=1, dtype=np.int64) + shared[part]
            hit = part[both >= threshold * (size[i] + size[part] - both) - 1e-9]
            partners[i] += weight[hit].sum()
            partners[hit] += weight[i]
            a = top(i)
            for b in {top(x) for x in hit.tolist()}:
                root[max(a, b)] = a = min(a, b)
    return np.array([top(x) for x in range(m)]), partners


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold is missed with a probability of at most 1 - recall.

    A pair survives a level in a critical branching process: q is its extinction by the given depth.
    """
    two = 1 / threshold - 1  # share of buckets that draw two coordinates
    q = 0.0
    for _ in range(depth):
        q = sum(w * (1 - threshold + threshold * q) ** k for w, k in ((1 - two, 1), (two, 2)))
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def jaccard_classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.999, leaf: int = 256, depth: int = 4, block: int = 2048, grams: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row: the smallest id it reaches over links, the number of other rows at or above the threshold, and of rows with its very set."""
    base = common.durable(sets(docs, words, id_col, text_col))
    keys = ["n", "k1", "k2"]
    whole = base.where("n > 0").groupBy(*keys).agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    runs, rows_in_all = runs_for(recall, threshold, depth), base.count()
    whole = common.durable(common.sized(whole, rows_in_all, 1 << 14))

    def drawn(path: str, salt: int) -> Column:
        """The coordinates that the bucket `path` draws: one, or two with probability 1/threshold - 1."""
        h = F.xxhash64(path, F.lit(salt))
        first = F.pmod(h, F.lit(COORDS))
        second = F.pmod(first + 1 + F.pmod(F.xxhash64(h, F.lit(1)), F.lit(COORDS - 1)), F.lit(COORDS))
        two = F.pmod(F.xxhash64(h, F.lit(2)), F.lit(1_000_000)) < int(1_000_000 * (1 / threshold - 1))
        return F.when(two, F.array(first, second)).otherwise(F.array(first))

    def child(rows: DataFrame, level: int) -> DataFrame:
        """(path, node): every row goes on into the buckets of the coordinates that its bucket draws."""
        rows = rows.withColumn("_c", F.explode(drawn("path", level)))
        value = F.expr("substring(sig, cast(_c as int) * 4 + 1, 4)")
        return rows.select(F.xxhash64("path", "_c", value).alias("path"), "node")

    found: DataFrame | None = None
    total, found_rows = rows_in_all * runs, 0
    rows = whole.select("node", "sig").withColumn("path", F.explode(F.array(*(F.lit(r).cast("long") for r in range(runs)))))
    for level in range(1, depth + 1):
        rows = common.durable(common.sized(child(rows, level), math.ceil(total / threshold)))
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.expr("sum(cast(pmod(xxhash64(node), 1099511627776) as long))").alias("who"), F.expr("bit_xor(xxhash64(node, 1))").alias("too"))
        total = rows.count()
        sizes = common.sized(sizes.where("size > 1"), total)
        found_rows += total
        done = sizes if level == depth else sizes.where(F.col("size") <= leaf)
        # buckets with the same members count once
        done = common.sized(done.groupBy("size", "who", "too").agg(F.min("path").alias("path")), total)
        leaves = common.sized(rows.join(done.where(F.col("size") <= block).select("path"), "path"), total)
        found = leaves if found is None else found.unionByName(leaves)
        if level == depth:
            # what shares the last level's coordinates are candidates; the exact comparison decides
            centre = done.where(F.col("size") > block).join(rows.groupBy("path").agg(F.min("node").alias("v")), "path").select("path", "v", F.col("size").alias("_n"))
            centre = common.sized(centre, total)
            stars = common.sized(common.hot_join(rows, centre, ["path"], "_n", total), total).where("node <> v").select(F.col("node").alias("u"), "v").distinct()
            break
        rows = common.sized(common.hot_join(rows, sizes.where(F.col("size") > leaf).select("path", "size"), ["path"], "size", total), total)
        rows = rows.join(whole.select("node", "sig"), "node").select("node", "sig", "path")
    found = common.sized(found.join(whole.select("node", "sig", "n"), "node"), found_rows, 1 << 14)

    def near(group: pa.Table) -> pa.Table:
        node, n = (group.column(c).to_numpy() for c in ("node", "n"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
        root = coordinate_links(sig, n, threshold)
        linked = root != np.arange(len(root))
        return pa.table({"u": node[linked], "v": node[root[linked]]})

    links = common.sized(found.groupBy("path").applyInArrow(near, "u long, v long"), found_rows, 1 << 14).distinct()
    links = common.durable(common.sized(links.unionByName(stars), found_rows))
    groups = common.durable(components(links))
    nodes = groups.count()
    size_of = common.sized(whole.groupBy("node").agg(F.sum("copies").alias("copies"), F.sum("n").alias("n")), rows_in_all)
    groups = common.sized(groups.join(size_of, F.col("u") == F.col("node")).select("node", "root", "copies", "n"), nodes)
    by_root = common.sized(groups.groupBy("root").agg(F.ceil(F.sum("n") / grams).cast("int").alias("blocks"), F.count("*").alias("_n")), nodes)
    groups = common.durable(common.sized(common.hot_join(groups.drop("n"), by_root, ["root"], "_n", nodes), nodes))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(groups, "node")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, off in textnum.text_slices(b.column(4)):
                _, _, h, bounds = textnum.words(raw, off)
                s, at = textnum.shingles(h, bounds, words)
                unique = [textnum.different(s[at[k] : at[k + 1]]).tobytes() for k in range(j - i)]
                yield pa.record_batch([*(b.column(k).slice(i, j - i) for k in range(4)), pa.array(unique, pa.binary())], names=["node", "root", "blocks", "copies", "grams"])

    hashes = texts.select("node", "root", "blocks", "copies", "text").mapInArrow(hashed, "node long, root long, blocks int, copies long, grams binary")

    def exact(key: tuple, group: pa.Table) -> pa.Table:
        node, weight, blk = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        grams = group.column("grams").to_pylist()
        order = np.array(sorted({(node[i], grams[i]): i for i in range(len(node))}.values(), key=lambda i: node[i]))  # repeated rows once
        node, weight, blk = node[order], weight[order], blk[order]
        hashes = [np.frombuffer(grams[i], np.uint64) for i in order]
        root, partners = exact_links(hashes, weight, blk, key[1].as_py() != key[2].as_py(), threshold)
        several = np.full(len(node), bool(group.column("blocks")[0].as_py() > 1))
        return pa.table({"node": node, "root": node[root], "links": partners, "several": several})

    checked = common.durable(dealt(hashes, "root", "blocks").groupBy("root", "lo", "hi").applyInArrow(exact, "node long, root long, links long, several boolean"))
    counts = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("several").alias("several"))
    counts = common.sized(counts, nodes)
    joined = components(checked.where("several").select(F.col("node").alias("u"), F.col("root").alias("v"))).select(F.col("u").alias("node"), F.col("root").alias("far"))
    counts = common.sized(counts.join(joined, "node", "left").select("node", "links", F.coalesce("far", "root").alias("root")), nodes)
    by_set = whole.select(*keys, "node", "copies").join(counts, "node", "left").select(*keys, F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    # read more than once below; stored, so that neither joins nor exchanges of the sets are planned and run anew
    by_set = common.durable(common.sized(by_set, rows_in_all)).withColumn("_n", F.col("copies"))
    some = common.hot_join(base.where("n > 0").select("id", *keys), by_set, keys, "_n", rows_in_all)
    alone = base.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).alias("n_links"), F.lit(1).alias("copies"))
    out = some.select("id", "class_id", "n_links", "copies").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"))
