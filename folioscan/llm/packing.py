"""Best-fit packing (best-two-fit) of token sequences into fixed-length sequences.

Packing needs only how many pieces there are of each length, and lengths run
from 1 to the capacity, so the plan is made on a histogram whose size the
corpus cannot change: identical bins are planned once, with a multiplicity.
Executors then turn (length, rank within the length) into a place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import encoded_texts

#: Rows of one length and salt that a sort on an executor should hold.
ROWS_PER_SALT = 2_000_000


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ``([(length, how many), ...], number of such bins)``.

    A bin is filled greedily, the longest piece that fits first. If a gap is
    left, its smallest piece is replaced by the two unpacked pieces that fill
    the gap so expanded best, if they fill more of it than the piece did. A
    bin found once is repeated as long as the counts last, which is what
    packing bins one by one would do.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity or n < 0:
            raise ValueError("lengths must be from 1 to the capacity and counts not negative")
        left[length] += n
    places = np.arange(capacity + 1)
    plan: list[tuple[list[tuple[int, int]], int]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        used: dict[int, int] = {}
        gap, at = capacity, top
        while at:
            n = min(int(left[at]), gap // at)
            if n:
                used[at] = n
                gap -= n * at
            at = min(at - 1, gap)
            if at:
                free = np.flatnonzero(left[1 : at + 1])
                at = int(free[-1]) + 1 if free.size else 0
        smallest = min(used)
        room = gap + smallest
        if gap and room >= 2:
            rest = left[: room + 1].copy()
            for length, n in used.items():
                if length <= room:
                    rest[length] -= n
            has = np.where(rest > 0, places[: room + 1], 0)
            upto = np.maximum.accumulate(has)  # the longest unpacked piece of at most this length
            first = np.flatnonzero(has)
            first = first[first < room]
            second = upto[room - first]
            same = (second == first) & (rest[first] < 2)
            below = upto[np.maximum(first - 1, 0)]
            second = np.where(same, below, second)
            total = np.where(second > 0, first + second, 0)
            if total.size and (best := int(total.argmax())) >= 0 and total[best] > smallest:
                used[smallest] -= 1
                if not used[smallest]:
                    del used[smallest]
                for length in (int(first[best]), int(second[best])):
                    used[length] = used.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        plan.append((sorted(used.items(), reverse=True), times))


class Layout:
    """The plan as ranges over the ranks of each length."""

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]], capacity: int):
        rows: list[tuple[int, int, int, int, int]] = []
        taken: dict[int, int] = {}
        bins = 0
        for pattern, times in plan:
            offset = 0
            for length, n in pattern:
                start = taken.get(length, 0)
                rows.append((length, start, bins, n, offset))
                taken[length] = start + n * times
                offset += length * n
            bins += times
        rows.sort()
        self.n_bins = bins
        self.table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.first = np.searchsorted(self.table[:, 0], np.arange(capacity + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset in it of the pieces that are number ``rank`` (from 0) of their length."""
        at = np.empty(len(length), dtype=np.int64)
        for value in np.unique(length):
            rows = slice(self.first[value], self.first[value + 1])
            own = length == value
            at[own] = self.first[value] + np.searchsorted(self.table[rows, 1], rank[own], side="right") - 1
        _, start, base, n, offset = self.table[at].T
        k = rank - start
        return base + k // n, offset + (k % n) * length


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(number, start, packed ids) of a document's pieces; only the first may be shorter than the capacity."""
    total = len(ids) // 4
    end = total % capacity or min(total, capacity)
    start = piece = 0
    while start < total:
        yield piece, start, ids[4 * start : 4 * end]
        start, end, piece = end, end + capacity, piece + 1


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            source = []
            for i, ids in enumerate(encoded_texts(tokenizer_path, batch.column(1))):
                for piece, start, part in pieces_of(ids + tail, capacity):
                    rows.append((piece, start, len(part) // 4, zlib.crc32(part)))
                    source.append(i)
            cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, k]) for k in (1, 2, 3))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's token ids, each ended by ``end_id``, into sequences of at most ``capacity`` ids.

    Only longer documents are cut, into pieces of ``capacity``; the first may
    be shorter. Returns a row for each piece: the id column, piece, start,
    length, ids_crc32, sequence_id, offset.

    Null and empty texts count as empty (the end id alone). A null id, equal
    ids and equal rows are packed like any other row. Other columns are not
    read, whatever their names. An empty table gives no rows. Memory on the
    driver is bounded by ``capacity`` times the number of salts.
    """
    if id_col in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        raise ValueError(f"the result has a column {id_col} of its own")
    made = materialise(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    n_rows = made.count()
    salts = int(min(4096, max(16, -(-n_rows // ROWS_PER_SALT))))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counts = np.zeros((capacity + 1, salts + 1), dtype=np.int64)
    for length, salt, n in salted.groupBy("length", "salt").count().toLocalIterator():
        counts[length, salt + 1] = n
    before = counts.cumsum(axis=1)
    totals = before[:, -1]
    layout = Layout(best_two_fit({int(k): int(totals[k]) for k in np.flatnonzero(totals)}, capacity), capacity)

    def run(batches):
        for batch in batches:
            length, salt, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
            sequence, offset = layout.place(length, before[length, salt] + rank - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32", "start")))
    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "salt", "rank").mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
