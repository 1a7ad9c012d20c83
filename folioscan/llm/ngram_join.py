"""Exact set-similarity join of documents on word n-grams, by PartEnum signatures.

Arasu, Ganti and Kaushik, Efficient Exact Set-Similarity Joins (VLDB 2006).
A document's set is its distinct word n-grams, as 64-bit hashes.

* Size bands. Sets that reach the similarity have sizes within a factor, so
  bands of sizes overlap in such a way that every such pair lies in one band.
  In a band the similarity bounds the symmetric difference by some k.
* PartEnum. The hash space is cut into n1 first-level parts of n2 second-level
  parts each. A difference of at most k leaves some first-level part with at
  most one differing element, hence n2 - 1 of its second-level parts without
  any: every subset of n2 - 1 parts gives a signature, and a pair that links
  shares one. Some more first-level parts than needed let nearly all sets do
  without signatures of empty subsets; the few others emit them.
* Equal sets are one node, which stands for all its documents.
* Among the nodes of a signature, pairs whose sizes or parity sketches rule a
  link out are left aside. A sketch has a bit for each hash bucket, the parity
  of the set's elements there; sketches differ in no more bits than sets in
  elements, so no link is lost.
* What is left joins nodes to clusters; a cluster's sets are compared exactly,
  in tasks of bounded size, for a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .words import _MIX, PLAIN_WORDS, gram_hashes, hashed, mixed

#: Elements of the sets that one comparing task takes.
TASK_ELEMENTS = 1 << 20
#: Sets that a task remembers having signed; beyond it, copies are signed again.
SEEN_NODES = 200_000
#: Nodes of one signature that one filtering task takes.
TASK_NODES = 50_000
#: Candidate documents up to which their ids (16 bytes each) are broadcast to the text scan; beyond, a shuffle join.
BROADCAST_ROWS = 500_000

_U = np.uint64


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text the ascending hashes of the distinct ``n``-grams of its words, A-Z lower-cased; with fewer words, of all as one."""
    for h, upto in hashed(texts, PLAIN_WORDS):
        grams = gram_hashes(h, n)
        bounds = upto.tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield np.unique(grams[a : b - n + 1] if b - a >= n else gram_hashes(h[a:b], b - a) if b > a else h[a:b])


def shingles(text: str | None, n: int) -> np.ndarray:
    """``sets_of`` one text."""
    return next(sets_of(pa.array([text], pa.string()), n))


def node_of(own: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes(), len(own)) - (1 << 63)


class Bands:
    """Overlapping size bands and the parts of each, for Jaccard similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int, stretch: int = 3):
        self.num, self.den, self.stretch = num, den, stretch
        self.edges: list[tuple[int, int]] = []
        self.part = cache(self._part)

    def of(self, size: int) -> list[int]:
        """Numbers of the bands that hold sets of this size."""
        while not self.edges or self.edges[-1][0] <= size:
            low = 1 if not self.edges else (self.edges[-1][1] * self.den + self.den - 1) // self.den
            if self.edges:
                last = self.edges[-1][1]
                # the smallest size whose largest partner lies beyond the last band
                low = last * self.num // self.den
                while low * self.den // self.num <= last:
                    low += 1
            high = low
            for _ in range(self.stretch):
                high = high * self.den // self.num
            self.edges.append((low, high))
        return [i for i, (low, high) in enumerate(self.edges) if low <= size <= high]

    def _part(self, band: int) -> tuple[int, int, int, np.ndarray] | None:
        """n1, n2, first-level parts to spare, and the inner bounds of the parts in the hash space; None where only equal sets link."""
        low, high = self.edges[band]
        k = (self.den - self.num) * 2 * high // (self.den + self.num)
        if not k:
            return None
        n2 = 3 if high <= 64 else 2
        need = k // 2 + 1
        empty = need * math.comb(n2, n2 - 1) * math.exp(-low * (n2 - 1) / (need * n2))
        spare = math.ceil(empty + 4 * math.sqrt(empty)) + 1 if need > 3 else 0
        n1 = need + spare
        step, parts = (1 << 64) / (n1 * n2), n1 * n2
        return n1, n2, spare, np.array([min(int(step * i), (1 << 64) - 1) for i in range(1, parts)], dtype=_U)

    def signatures(self, own: np.ndarray) -> np.ndarray:
        """Signatures of a set given as ascending hashes, as signed 64-bit integers."""
        out = []
        sums = np.zeros(len(own) + 1, dtype=_U)
        np.cumsum(mixed(own ^ _MIX[0]), out=sums[1:])
        for band in self.of(len(own)) if len(own) else []:
            if (shape := self.part(band)) is None:
                continue
            n1, n2, spare, bounds = shape
            at = np.concatenate(([0], np.searchsorted(own, bounds), [len(own)]))
            part = (sums[at[1:]] - sums[at[:-1]]).reshape(n1, n2)
            count = np.diff(at).reshape(n1, n2)
            found, sizes = [], []
            for j, kept in enumerate(combinations(range(n2), n2 - 1)):
                seed = mixed(np.arange(n1, dtype=_U) * _U(64) + _U(j) + _U((band + 1) << 40))
                value = seed
                for c in kept:
                    value = mixed(value + part[:, c])
                found.append(value)
                sizes.append(sum(count[:, c] for c in kept))
            bare = np.array(sizes) == 0
            found = np.array(found)
            # with at most ``spare`` bare first-level parts, more parts agree than are bare, so one with elements does
            out.append(found[~bare] if bare.any(axis=0).sum() <= spare else found.ravel())
        return np.concatenate(out).astype(np.int64, casting="unsafe") if out else np.zeros(0, dtype=np.int64)


def sketch(own: np.ndarray) -> bytes:
    """Parities of about as many hash buckets as there are elements (64 to 4,096), as bits."""
    n = 1 << min(12, max(6, int(len(own)).bit_length()))
    return np.packbits(np.bincount((own & _U(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, the shortest there is, as rows of 64-bit words: buckets that become one add up."""
    size = min(map(len, sketches))
    out = np.zeros((len(sketches), size // 8), dtype=_U)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, dtype=_U).reshape(-1, size // 8), axis=0)
    return out


def plausible(sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches leave possible, as (member, first member found)."""
    bits = folded(sketches)
    left = np.arange(len(sizes))
    edges = []
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        queue = [first]
        while queue and len(left):
            u = queue.pop()
            apart = np.bitwise_count(bits[left] ^ bits[u]).sum(axis=1, dtype=np.int64)
            near = (apart * (den + num) <= (den - num) * (sizes[left] + sizes[u])) & (den * np.minimum(sizes[left], sizes[u]) >= num * np.maximum(sizes[left], sizes[u]))
            if near.any():
                found = left[near].tolist()
                edges += [(v, first) for v in found]
                queue += found
                left = left[~near]
    return edges


def _dealt(rows: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """Deals the nodes of each group to tasks: one task for a group of one block, else one for each two blocks.

    ``blocks`` has each group's number of blocks. Returns node and task.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    partners = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")))
    # a second key has both sides exchanged for this join, so that Spark can split a large group's partition
    twice = lambda df: df.withColumn("h", F.xxhash64(group))
    every = twice(rows).join(twice(blocks), [group, "h"]).withColumn("block", block).select("node", group, "block", F.explode(partners).alias("other"))
    return every.select("node", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")).alias("task"))


def _by_task(batches, solve):
    """Edges of each task's rows (task, node, size, data), which come sorted by task."""
    task, held = None, []

    def done():
        pairs = solve([h[1] for h in held], [h[2] for h in held]) if len(held) > 1 else []
        return [held[a][0] for a, _ in pairs], [held[b][0] for _, b in pairs]

    for batch in batches:
        out = ([], [])
        for key, node, size, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != task:
                for x, y in zip(out, done(), strict=True):
                    x.extend(y)
                task, held = key, []
            held.append((node, size, data))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v"])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done()], names=["u", "v"])


def forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``: (member, first member found), by exact intersection sizes.

    A set that is known to be connected is not compared again as a target, so
    dense groups need few passes.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    _, local = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(local.max()) + 1 if len(local) else 1, dtype=bool)
    left = np.ones(len(sets), dtype=bool)
    rest_local, rest_owner = local, owner
    edges = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            if not left.any():
                break
            u = queue.pop()
            own = local[starts[u] : starts[u + 1]]
            mark[own] = True
            shared = np.bincount(rest_owner[mark[rest_local]], minlength=len(sets))
            mark[own] = False
            hit = np.flatnonzero(left & (shared > 0) & (den * shared >= num * (sizes + sizes[u] - shared)))
            if len(hit):
                left[hit] = False
                edges += [(int(v), first) for v in hit]
                queue += hit.tolist()
        keep = left[rest_owner]
        if keep.sum() < 0.7 * len(keep):
            rest_local, rest_owner = rest_local[keep], rest_owner[keep]
    return edges


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every document under links of Jaccard similarity of at least ``num / den`` on word ``n``-grams.

    Returns the id column, tie (hash of the text), n_shingles and
    component_id, the smallest id that can be reached by links (its own, with
    none). A document without words, or with a null text, has an empty set and
    links with nothing. A document with a null id takes part; where all ids of
    a class are null, so is its component_id. Repeated rows are returned each.
    Other columns aren't read. An empty table gives no rows.

    Sets are nodes by a 64-bit hash of all their elements and their size.
    """
    if id_col in ("tie", "n_shingles", "component_id"):
        raise ValueError(f"the result has a column {id_col} of its own")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sized(batches):
        for batch in batches:
            own = list(sets_of(batch.column(2), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in own], pa.int64()), pa.array([node_of(s) if len(s) else None for s in own], pa.int64()), pa.array([sketch(s) if len(s) else None for s in own], pa.binary())],
                names=["id", "tie", "n_shingles", "node", "sketch"],
            )

    def signed(batches):
        bands, seen = Bands(num, den), set()
        for batch in batches:
            nodes, found, total = [], [], 0
            for own in sets_of(batch.column(0), n):
                if not len(own) or (node := node_of(own)) in seen:
                    continue
                # copies in a task say nothing new, so a large group of them is a few rows a task
                if len(seen) >= SEEN_NODES:
                    seen.clear()
                seen.add(node)
                found.append(bands.signatures(own))
                nodes.append(np.full(len(found[-1]), node, dtype=np.int64))
                total += len(found[-1])
                if total > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(nodes))], names=["sig", "node"])
                    nodes, found, total = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    def with_sets(batches):
        for batch in batches:
            own = list(sets_of(batch.column(1), n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "elements"])

    def filtered(batches):
        return _by_task(batches, lambda sizes, data: plausible(np.array(sizes), data, num, den))

    def compared(batches):
        return _by_task(batches, lambda _, data: forest([np.frombuffer(d, dtype=_U) for d in data], num, den))

    members = materialise(source.select("id", F.xxhash64("text").alias("tie"), "text").mapInArrow(sized, f"id {kind}, tie long, n_shingles long, node long, sketch binary"), "sets")
    group = Window.partitionBy("sig")
    shared = source.select("text").mapInArrow(signed, "sig long, node long").select("sig", "node", F.min("node").over(group).alias("least"), F.max("node").over(group).alias("most"))
    candidates = materialise(shared.where("least < most").select("sig", "node").distinct(), "candidates")
    first = materialise(members.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.max("n_shingles").alias("size"), F.min(F.struct("id", "tie")).alias("copy"), F.min("sketch").alias("sketch")), "nodes")
    of_sig = candidates.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / F.lit(TASK_NODES)).cast("int").alias("blocks"))
    sketched = _dealt(candidates, "sig", of_sig).join(first.select("node", "size", "sketch"), "node").select("task", "node", "size", "sketch")
    possible = sketched.repartition("task").sortWithinPartitions("task", "node").mapInArrow(filtered, "u long, v long")
    chosen = materialise(components(possible).join(first, "node").select("node", "root", "size", F.col("copy.id").alias("c_id"), F.col("copy.tie").alias("c_tie")), "chosen")
    ids = chosen.select("node", "c_id", "c_tie")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = source.join(ids, source["id"].eqNullSafe(ids["c_id"]) & (F.xxhash64("text") == ids["c_tie"])).select("node", "text")
    sets = texts.mapInArrow(with_sets, "node long, elements binary").dropDuplicates(["node"])
    weights = chosen.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(TASK_ELEMENTS)).cast("int").alias("blocks"))
    dealt = _dealt(chosen.select("node", "root"), "root", weights).join(sets, "node").select("task", "node", F.lit(0).alias("size"), "elements")
    links = dealt.repartition("task").sortWithinPartitions("task", "node").mapInArrow(compared, "u long, v long")
    classes = components(links)
    reached = first.select("node", "first_id").join(classes, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    labels = reached.join(reached.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    out = members.join(labels, "node", "left")
    return out.select(F.col("id").alias(id_col), "tie", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
