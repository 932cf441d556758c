"""Best-fit packing of token sequences by minimum bin slack.

Only the histogram of lengths decides how bins are filled, and it has at most ``capacity`` entries. Each
bin takes the longest piece left and then, by subset sums held as bits of one number, the fullest
combination of other lengths that are left. The combination is used for as many bins as the histogram
allows, which exhausts at least one length down to fewer copies than the combination needs; so
there are at most sum(capacity / length) combinations, about eight thousand for 1024.

Spark does the rest: each piece gets its number among the pieces of its length (a count per task and
length, added up over tasks), and that number finds its bin and place in the list of combinations.

Defined results: a null or empty text is one piece that holds the end mark alone. Repeated rows are
packed once each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.llm.common import stored
from tracegauge.llm.pretokens import WholeTexts


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum that is at most ``capacity``; long ones are tried first."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        copies, size, now = min(counts[length], capacity // length), 1, reach
        while copies:
            take = min(size, copies)
            now |= (now << (take * length)) & mask
            copies, size = copies - take, size * 2
        steps.append((length, reach))
        reach = now
        if reach >> capacity & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + 1
            target -= length
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths of each) until the histogram is used up."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(left[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            left[k] -= bins * m
            if not left[k]:
                del left[k]
        out.append((bins, chosen))
    return out


def _places(plan: list[tuple[int, dict[int, int]]]) -> list[np.ndarray]:
    """Per run of equal pieces: length, first number, first bin, copies in a bin, first offset; sorted."""
    rows, used, first = [], Counter(), 0
    for bins, chosen in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            copies = chosen[length]
            rows.append((length, used[length], first, copies, offset))
            used[length] += bins * copies
            offset += copies * length
        first += bins
    return [np.array(x, np.int64) for x in zip(*sorted(rows))] if rows else [np.zeros(0, np.int64)] * 5


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Every document's tokens and the end mark, cut into pieces of ``capacity`` if longer; then the first
    piece holds the rest. ``part`` and ``number`` are the task and the piece's number among those of its
    length there. ``with_ids`` adds the ids themselves."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WholeTexts(path)
        end, seen, part = np.array([end_id], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out, source = [[] for _ in names[1:]], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = (encoder.ids(text) if text else b"") + end
                total = len(ids) // 4
                first = total % capacity or min(total, capacity)
                for k, start in enumerate([0, *range(first, total, capacity)]):
                    own = ids[4 * start : 4 * (start + (capacity if start else first))]
                    length = len(own) // 4
                    source.append(row)
                    for to, x in zip(out, (k, start, length, zlib.crc32(own), part, seen[length])):
                        to.append(x)
                    if with_ids:
                        out[-1].append(np.frombuffer(own, "<u4").astype(np.int32))
                    seen[length] += 1
            kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *[pa.array(x, k) for x, k in zip(out, kinds)]], names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, number long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (as from ``pieces``)."""
    cut = stored(cut, "pieces")
    by_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = stored(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = cut.sparkSession.sparkContext.broadcast(_places(combinations(histogram, capacity)))
    numbered = cut.join(by_task.drop("n"), ["length", "part"]).withColumn("number", F.col("number") + F.col("before")).drop("part", "before")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, bins, copies, offsets = places.value
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "number"))
            run = np.empty(len(length), np.int64)
            for one in np.unique(length):  # at most `capacity` rounds
                rows = length == one
                a, b = starts[one], starts[one + 1]
                run[rows] = a + np.searchsorted(firsts[a:b], number[rows], "right") - 1
            k = number - firsts[run]
            new = [pa.array(bins[run] + k // copies[run]), pa.array(offsets[run] + k % copies[run] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(put, f"{kinds}, sequence_id long, offset long").drop("number")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``ids`` of each, pieces in order of offset. A group has at most the
    capacity in tokens. Needs pieces made ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
