"""Best-fit packing by the linear grouping scheme.

Only the histogram of lengths (at most `capacity` numbers) reaches the driver. There the large lengths are rounded up
within groups of equal cardinality, column generation optimises the configurations of those few sizes, and actual
lengths take the slots: the longest of its group each, and the last one the longest that still fits, so that the room won by rounding isn't lost.
Whatever is left or small goes best-fit into the gaps. The result is a table of ranges
(length, ranks, sequences, offset); each piece finds its place by its rank among the pieces of its length.

Defined results: a null or empty text still makes one piece, the separator; repeated rows are packed each for
itself; an empty table gives an empty result; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common, textnum


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, eos: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the separator follows each document; a longer one is cut from its end into full pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = textnum.byte_bpe(tokenizer)
        for batch in batches:
            for i, j, raw, off in textnum.text_slices(batch.column(1)):
                ids, bounds = bpe.encode(raw, off)
                n = j - i
                ends = bounds[1:] + np.arange(n)
                is_id = np.ones(len(ids) + n, bool)
                is_id[ends] = False
                flat = np.full(len(is_id), eos, "<u4")
                flat[is_id] = ids
                size = np.diff(bounds) + 1
                first = np.where(size > capacity, (size - 1) % capacity + 1, size)
                count = 1 + (size - first) // capacity
                piece = textnum.ranges(np.zeros(n, np.int64), count)
                doc = np.repeat(np.arange(n), count)
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                at = np.zeros(len(length) + 1, np.int64)
                np.cumsum(4 * length, out=at[1:])
                data = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(flat)])
                yield pa.record_batch([batch.column(0).take(pa.array(i + doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), data], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def _grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of (nearly) equal cardinality, largest lengths first: (rounded length, [[length, count], ...])."""
    each = max(1, -(-sum(counts.values()) // groups))
    out: list = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            take = min(left, room)
            out[-1][1].append([length, take])
            left -= take
            room -= take
    return out


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, int]]:
    """Column generation for the cutting-stock relaxation; the whole parts of its basis: (count of each size, times)."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            ok = sizes <= c
            gain = np.where(ok, price + best[np.where(ok, c - sizes, 0)], -1.0)
            k = int(np.argmax(gain))
            best[c], take[c] = best[c - 1], -1
            if gain[k] > best[c] + 1e-12:
                best[c], take[c] = gain[k], k
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= int(sizes[take[c]])
        x, turn = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(turn > 1e-9, x / np.where(turn > 1e-9, turn, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand)
    return [(basis[:, k].astype(int), int(np.floor(x[k] + 1e-9))) for k in range(n) if x[k] >= 1 - 1e-9]


def plan(counts: dict[int, int], capacity: int = 1024, groups: int = 64, rounds: int = 400) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, number of ranks, first sequence, offset) that place `counts[length]` pieces of each length."""
    return best_plan(counts, capacity, groups, rounds)[1]


def best_plan(counts: dict[int, int], capacity: int = 1024, groups: int = 64, rounds: int = 400) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(share, ranges): pieces above capacity / share count as large ones. A third, a quarter, an eighth and a half are tried, the fewest sequences win, of equal ones the first."""
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    best: tuple[int, list[tuple[int, int, int, int, int]]] | None = None
    used = lambda ranges: max((s + n for _, _, n, s, _ in ranges), default=0)
    for share in (3, 4, 8, 2):
        found = plan_from(counts, capacity, capacity // share + 1, groups, rounds)
        if best is None or used(found) < used(best[1]):
            best = share, found
        if used(best[1]) == least:
            break
    return best


def _filled(slots: list[int], lower: dict[int, int], left: dict[int, int], have: list[int], capacity: int) -> list[int]:
    """Actual lengths for the slots of a configuration: of each group the longest, in the last slot the longest that fits. Slots may stay free, but the first."""
    content, room = [], capacity
    for k, slot in enumerate(slots):
        last = k == len(slots) - 1
        at = bisect.bisect_right(have, room if last else min(slot, room)) - 1
        while at >= 0 and left[have[at]] <= content.count(have[at]):
            at -= 1
        if at >= 0 and (last or have[at] > lower[slot]):
            content.append(have[at])
            room -= have[at]
        elif not k:
            return []
    return content


def plan_from(counts: dict[int, int], capacity: int, large: int, groups: int, rounds: int) -> list[tuple[int, int, int, int, int]]:
    """The same with lengths from `large` on as large ones."""
    left = {k: v for k, v in counts.items() if k < capacity and v}
    bins: list[tuple[int, tuple[int, ...]]] = []  # times, lengths in order
    if counts.get(capacity):
        bins.append((counts[capacity], (capacity,)))
    grouped = _grouped({k: v for k, v in left.items() if k >= large}, groups)
    opened: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # free room: configurations of actual lengths
    if grouped:
        demanded: dict[int, int] = {}
        for size, members in grouped:
            demanded[size] = demanded.get(size, 0) + sum(c for _, c in members)
        sizes = np.array(sorted(demanded, reverse=True))
        lower = dict(zip(sizes.tolist(), [*sizes[1:].tolist(), large - 1], strict=True))
        have = sorted(left)
        for config, times in _configurations(sizes, np.array([demanded[s] for s in sizes.tolist()], float), capacity, rounds):
            slots = [int(s) for s, k in zip(sizes, config, strict=True) for _ in range(k)]
            while times and (content := _filled(slots, lower, left, have, capacity)):
                # so many bins alike
                part = min(times, *(left[x] // content.count(x) for x in content))
                for x in content:
                    left[x] -= part
                for x in set(content):
                    if not left[x]:
                        del left[x]
                        have.pop(bisect.bisect_left(have, x))
                opened.setdefault(capacity - sum(content), []).append((part, tuple(content)))
                times -= part
    room = sorted(opened)

    def put(free: int, item: tuple[int, tuple[int, ...]]) -> None:
        if free not in opened:
            opened[free] = []
            bisect.insort(room, free)
        opened[free].append(item)

    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(room, length)
            if at == len(room):
                each = capacity // length
                times = max(1, count // each)
                k = min(each, count)
                put(capacity - k * length, (times, (length,) * k))
                count -= times * k
                continue
            free = room[at]
            times, content = opened[free].pop()
            if not opened[free]:
                del opened[free]
                room.pop(at)
            k = min(free // length, count)
            part = min(times, count // k)
            if times > part:
                put(free, (times - part, content))
            put(free - k * length, (part, content + (length,) * k))
            count -= part * k
    for free in room:
        bins.extend(opened[free])
    out, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for times, content in bins:
        offset = 0
        for length in content:
            out.append((length, rank[length], times, sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = 1024, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`. Lengths lie between 1 and capacity.

    The pieces are written once to the checkpoint folder. Ranks come from hashed parts of each length (the parts
    grow in number with spark.sql.shuffle.partitions), so that no length, however frequent, meets in one task; where the
    ranks of a part begin is a running sum over the counts of the parts. To the driver go `capacity` counts.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = common.durable(pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")))
    names = [c for c in pieces.columns if c != "_part"]
    sizes = pieces.groupBy(F.col(length_col).alias("_length"), "_part").agg(F.count("*").alias("_count"))
    sizes = common.durable(common.sized(sizes, capacity * parts))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("_length").agg(F.sum("_count")).collect()}
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_length", F.col("_part").alias("_p"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    found = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    step = int(max(counts.values(), default=0)) + 1
    shared = spark.sparkContext.broadcast((found[:, 0] * step + found[:, 1], found))  # ranges: some a length, whatever the rows
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_part").orderBy(*order)) - 1)
    ranked = ranked.join(bases, (F.col(length_col) == F.col("_length")) & (F.col("_part") == F.col("_p"))).select(*names, (F.col("_rank") + F.col("_base")).alias("_rank"))
    ranked = common.sized(ranked, sum(counts.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, found = shared.value
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (names.index(length_col), len(names)))
            at = np.searchsorted(low, length * step + rank, "right") - 1
            cols = [b.column(k) for k in range(len(names))] + [pa.array(found[at, 3] + rank - found[at, 1]), pa.array(found[at, 4])]
            yield pa.record_batch(cols, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
