"""Token counts of documents in flat, unindexed token files, by a separator scan.

A file is a plain run of little-endian ids of two or four bytes in which every document ends with the separator. Files
are cut into blocks by their length alone; each task reads the byte range of its blocks, searches each for separators by
one array comparison, and leaves the documents that lie within it and two fragments (ids before the first separator, ids
after the last). A prefix scan over the separators of the blocks numbers the documents of a file, and the fragments of
one number are added up. So one file of any length is read by many tasks, and what is sorted are a few numbers a block.

Files that end in .gz can't be cut: one task streams such a file block by block.

Marks are ids beyond any vocabulary. A document may begin with them; they hold its 64-bit number, and a document
without marks has no number. Defined results: a null doc_id is written without marks and comes back null, negative
ones come back as they are; an empty document counts 0; ids after the last separator of a file are reported as an unended
document (`ended` false); an empty file gives no rows; a null text is written as an empty document; repeated rows are
separate documents; bytes that make no whole id at the end of a file are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import common, textnum

#: By the bytes of an id: the first mark, and the bits that a mark holds.
MARKS = {2: (0xE000, 13), 4: (1 << 31, 31)}


def _marks(width: int) -> tuple[int, int, int]:
    """(first mark, bits a mark, marks a document)."""
    first, bits = MARKS[width]
    return first, bits, -(-64 // bits)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, eos: int = 50256, width: int = 2, rows_per_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write flat token files through Spark's own text writer, whose line separator is the separator id.

    Marks lead each document, so that the files alone say whose tokens follow, in whatever order tasks ran. The
    separator's string in a text is ordinary text, so no token equals the separator. Two bytes an id serve vocabularies of
    fewer than 57,344 ids; a larger id raises ValueError.
    """
    first, bits, n_marks = _marks(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = textnum.byte_bpe(tokenizer, special=False)
        for batch in batches:
            named = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            number = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, j, raw, off in textnum.text_slices(batch.column(1)):
                ids, bounds = bpe.encode(raw, off)
                if len(ids) and int(ids.max()) >= first:
                    raise ValueError(f"id {int(ids.max())} needs more than {width} bytes")
                lead = np.where(named[i:j], n_marks, 0)
                start = bounds + np.append(0, np.cumsum(lead))
                flat = np.empty(start[-1], f"<u{width}")
                rest = np.ones(len(flat), bool)
                at = start[:-1][named[i:j]]
                for k in range(n_marks):
                    flat[at + k] = first + ((number[i:j][named[i:j]] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    rest[at + k] = False
                flat[rest] = ids
                yield pa.record_batch([pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(start * width), pa.py_buffer(flat)])], names=["ids"])

    separator = np.array([eos], f"<u{width}").tobytes().decode("latin-1")
    tokens = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "ids binary")
    lines = tokens.select(F.col("ids").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", rows_per_file).text(path)


def _opened(path: str, at: int, size: int, step: int) -> Iterator[bytes]:
    """The bytes at..at+size of a file in pieces of `step`; a .gz file is read whole, in pieces of its content."""
    where, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    if path.endswith(".gz"):
        with where.open_input_stream(name) as f:  # decompressed by its name
            while data := f.read(step):
                yield data
    else:
        with where.open_input_file(name) as f:
            f.seek(at)
            while size > 0 and (data := f.read(min(step, size))):
                size -= len(data)
                yield data


def _scan(ids: np.ndarray, eos: int, first: int, bits: int, n_marks: int) -> tuple:
    """(separators, ids and marks before the first, ids and marks after the last, [ids, number] of the documents within)."""
    ends, marked = np.flatnonzero(ids == eos), ids >= first
    real = np.append(0, np.cumsum(~marked))
    n = len(ends)
    marks = lambda a, b: (ids[a:b][marked[a:b]].astype(np.int64) - first).tolist()
    if not n:
        return 0, int(real[-1]), marks(0, len(ids)), 0, [], [], []
    begin = ends[:-1] + 1
    number = np.zeros(n - 1, np.uint64)
    named = (ends[1:] - begin >= n_marks) & marked[np.minimum(begin, len(ids) - 1)]
    for k in range(n_marks):
        number[named] |= (ids[begin[named] + k].astype(np.uint64) - np.uint64(first)) << np.uint64(k * bits)
    numbers = pa.array(number.view(np.int64), mask=~named)
    return n, int(real[ends[0]]), marks(0, ends[0]), int(real[-1] - real[ends[-1]] - 1), marks(ends[-1], len(ids)), real[ends[1:]] - real[begin], numbers


def count_tokens(spark: SparkSession, path: str, eos: int = 50256, width: int = 2, block_ids: int = 1 << 20, blocks_per_task: int = 32) -> DataFrame:
    """(file, ordinal, doc_id, tokens, ended) of every document of every flat token file (plain or .gz) under path."""
    first, bits, n_marks = _marks(width)
    step, stride = block_ids * width, block_ids * width * blocks_per_task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                left = b""
                number = itertools.count(at // step)
                for data in _opened(file, at, size, step):
                    data = left + data
                    whole = len(data) // width * width
                    left = data[whole:]
                    n, head, head_marks, tail, tail_marks, inner, numbers = _scan(np.frombuffer(data, f"<u{width}", whole // width), eos, first, bits, n_marks)
                    one = [pa.array([x], pa.int64()) for x in (next(number), n, head, tail)]
                    lists = [pa.array([x], pa.list_(pa.int64())) for x in (head_marks, tail_marks)]
                    within = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (inner, numbers)]
                    yield pa.record_batch([pa.array([file]), *one, *lists, *within], names=["file", "block", "n", "head", "tail", "head_marks", "tail_marks", "inner", "numbers"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # names and lengths only
    starts = F.when(F.col("path").endswith(".gz"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(stride).cast("long")))
    ranges = files.where("length > 0").select("path", F.explode(starts).alias("at"), "length").select("path", "at", F.least(F.lit(stride), F.col("length") - F.col("at")).alias("size"))
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "at")
    schema = "file string, block long, n long, head long, tail long, head_marks array<long>, tail_marks array<long>, inner array<long>, numbers array<long>"
    blocks = common.durable(ranges.mapInArrow(scan, schema))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    done = blocks.select("file", "block", "n").withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = blocks.join(done, ["file", "block"])
    within = placed.select("file", "done", F.posexplode(F.arrays_zip("inner", "numbers")).alias("k", "x")).select("file", (F.col("done") + F.col("k") + 1).alias("ordinal"), F.col("x.numbers").alias("doc_id"), F.col("x.inner").alias("tokens"), F.lit(True).alias("ended"))
    piece = lambda ordinal, tokens, marks, ended: F.struct(ordinal.alias("ordinal"), tokens.alias("tokens"), marks.alias("marks"), ended.alias("ended"))
    head = piece(F.col("done"), F.col("head"), F.col("head_marks"), F.col("n") > 0)
    tail = piece(F.col("done") + F.col("n"), F.col("tail"), F.col("tail_marks"), F.lit(False))
    parts = placed.select("file", "block", F.explode(F.when(F.col("n") > 0, F.array(head, tail)).otherwise(F.array(head))).alias("p")).select("file", "block", "p.*")
    crossing = parts.groupBy("file", "ordinal").agg(
        F.sum("tokens").alias("tokens"), F.bool_or("ended").alias("ended"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("marks") > 0, F.struct("block", "marks")))), lambda x: x["marks"])).alias("marks"),
    )
    value = F.aggregate(F.transform("marks", lambda m, k: F.call_function("shiftleft", m, k * bits)), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))
    crossing = crossing.where(F.col("ended") | (F.col("tokens") > 0) | (F.size("marks") > 0)).select("file", "ordinal", F.when(F.size("marks") == n_marks, value).alias("doc_id"), "tokens", "ended")
    return within.unionByName(crossing).select("file", "ordinal", "doc_id", "tokens", "ended")
