"""URL rules in a sorted digest array.

The 64-bit xxhash keys of all rules stand sorted in Arrow files, the rules' strings beside them. The files are written to
the shared folder, sent to every executor once and memory-mapped by its workers, so they share one copy and a list may be
larger than memory; a long list is several files, each with a range of keys. A URL is probed with every (domain suffix,
path prefix of a length that some rule has): the keys of a batch are computed by Spark's own xxhash64, found by binary search,
and a hit counts only if the stored strings are the same.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and gets the default
verdict; repeated rows are judged alike; of the fitting rules the longest string wins (at equal length the longer
host, then the smaller string); of rules with the same host and path the verdict that sorts last wins; without rules all get
the default; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

_opened: dict[str, tuple[np.ndarray, pa.Table]] = {}


def parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """`urls` with host and path."""
    u = F.col(url_col)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return urls.withColumn("host", F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def key(host: Column, path: Column) -> Column:
    """The digest of a rule; the host is kept apart from the path by a NUL."""
    return F.xxhash64(F.concat(host, F.lit("\0"), path))


def write_digests(rules: DataFrame, rows_per_file: int = 5_000_000) -> list[tuple[str, int]]:
    """(path, first key) of the files that hold the rules (verdict, host, path) by ascending key, in the shared folder."""
    folder = common.shared_path(rules.sparkSession, "digests")
    keyed = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", key(F.col("host"), F.col("path")))
    keyed = common.durable(keyed)
    files = max(1, -(-keyed.count() // rows_per_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if table:
            first = table[0].column(0)[0].as_py()
            where, name = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
            where.create_dir(name, recursive=True)
            name = f"{name}/{name.rsplit("/", 1)[1]}-{first + 2**63:020d}.arrow"  # a task that runs again writes the same file
            whole = pa.Table.from_batches(table).combine_chunks()
            with where.open_output_stream(name) as out, pa.ipc.new_file(out, whole.schema) as f:
                f.write_table(whole, max_chunksize=max(whole.num_rows, 1))
            yield pa.record_batch([pa.array([name.rsplit("/", 1)[1]]), pa.array([first])], names=["name", "first"])

    placed = keyed.select("key", "verdict", "host", "path").repartitionByRange(files, "key").sortWithinPartitions("key", "host", "path")
    return sorted(((f"{folder}/{r[0]}", r[1]) for r in placed.mapInArrow(write, "name string, first long").collect()), key=lambda x: x[1])


def _mapped(name: str) -> tuple[np.ndarray, pa.Table]:
    """(keys, rules) of a digest file that was sent to this executor, memory-mapped once a worker."""
    if name not in _opened:
        table = pa.ipc.open_file(pa.memory_map(SparkFiles.get(name))).read_all()
        _opened[name] = table.column("key").combine_chunks().to_numpy(), table
    return _opened[name]


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_per_file: int = 5_000_000) -> DataFrame:
    """(id, host, path, rule, verdict). `rules` are (verdict, host, path), in a list or in a table with these columns."""
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    files = write_digests(rules, rows_per_file)
    for path, _ in files:
        spark.sparkContext.addFile(path)
    names, firsts = [os.path.basename(p) for p, _ in files], np.array([f for _, f in files], np.int64)
    lengths = sorted(r[0] for r in rules.where("host is not null and path is not null").select(F.length("path")).distinct().collect())  # as many as URLs are long
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    probes = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.xxhash64(F.concat(s, F.lit("\0"), F.substring(F.col("path"), F.lit(1), n))))))
    probes = F.when(F.col("host") == "", F.array().cast("array<long>")).otherwise(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(3)
            offset = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)[offset[0] : offset[-1]]
            bounds = offset - offset[0]
            rule: list[str | None] = [None] * b.num_rows
            verdict = [default] * b.num_rows
            best: dict[int, tuple] = {}
            part = np.searchsorted(firsts, flat, "right") - 1
            for f in np.unique(part[part >= 0]):
                keys, table = _mapped(names[f])
                mine = np.flatnonzero(part == f)
                at = np.searchsorted(keys, flat[mine])
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == flat[mine])
                owner = np.searchsorted(bounds, mine[hit], "right") - 1
                for i, x, p in zip(owner.tolist(), (mine[hit] - bounds[owner]).tolist(), at[hit].tolist(), strict=True):
                    host, path = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                    fit = [n for n in lengths if n <= len(path)]
                    suffix, prefix = ".".join(host.split(".")[x // len(fit) :]), path[: fit[x % len(fit)]]
                    while p < len(keys) and keys[p] == flat[bounds[i] + x]:
                        v, h, q = (table.column(c)[p].as_py() for c in ("verdict", "host", "path"))
                        if (h, q) == (suffix, prefix):
                            rank = len(h) + len(q), len(h), [-ord(c) for c in h + q], v
                            if i not in best or rank > best[i]:
                                best[i] = rank
                                rule[i], verdict[i] = h + q, v
                        p += 1
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    # the id goes along as it is; only id and url are read
    kind = dict(urls.dtypes)[id_col]
    slim = parts(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    return slim.select("id", "host", "path", probes.alias("probes")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
