"""Filling containers of fixed capacity with whole documents.

Method: linear grouping.  Documents above a threshold are grouped by length
into groups of equal cardinality, lengths are rounded up to their group's
largest, and the few-size problem is solved by configurations (column
generation over knapsack patterns, then rounding down and finishing greedily).
Actual documents replace the rounded ones, and the room left is filled with
small documents, best fit, largest first.

All of that is arithmetic on the histogram of lengths: at most `capacity`
counts, whatever the number of documents.  The plan says which ranks of which
length go to which containers; documents get their rank by ranges of (length,
document), so a length that holds a third of all pieces spreads over as many
tasks as its rows need, and neither the driver nor a task ever holds all of it.

Only a text longer than the capacity is cut, into full containers and a rest.

Defined results: a null text, like an empty one, has no tokens and is in no
container; repeated rows of a document id are packed as items of their own;
ties in length are broken by document id and piece; an empty table gives no
containers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import scan
from tidewell.session import small_batches, staged

CAPACITY = 4096
#: Lengths above this share of the capacity are grouped, the rest fill gaps.
LARGE = 1 / 3
GROUPS = 32
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern of the vocabulary file, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def _encoder(name: str, vocabulary: bytes):
    """One tokenizer per worker process."""
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[name] = tiktoken.Encoding(os.path.basename(name), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, tokens) of whole texts; run it within small_batches().  The vocabulary file, some hundred kB, is read by the driver only."""
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, vocabulary.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id bigint, tokens bigint")


def pieces(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens): documents longer than the capacity are cut into full pieces and a rest."""
    last = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    cut = counts.filter("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("tokens"))


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Multiplicities of the most valuable pattern (at most limit of each)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(-values / sizes)
    if limit is None:
        for j in range(1, capacity + 1):
            best[j], took[j] = best[j - 1], -1
            fit = sizes <= j
            if fit.any():
                gain = np.where(fit, values + best[np.maximum(j - sizes, 0)], -1.0)
                k = int(gain.argmax())
                if gain[k] > best[j] + 1e-12:
                    best[j], took[j] = gain[k], k
        out = np.zeros(len(sizes), np.int64)
        j = capacity
        while j > 0:
            if took[j] < 0:
                j -= 1
            else:
                out[took[j]] += 1
                j -= sizes[took[j]]
        return out
    keep: list[np.ndarray] = []
    for k in order:  # bounded: layers by size class
        s, v, m = int(sizes[k]), float(values[k]), int(min(limit[k], capacity // sizes[k]))
        use = np.zeros(capacity + 1, np.int64)
        base = best.copy()
        for n in range(1, m + 1):
            alt = np.full(capacity + 1, -1.0)
            alt[n * s :] = base[: capacity + 1 - n * s] + n * v
            better = alt > best + 1e-12
            best = np.where(better, alt, best)
            use[better] = n
        keep.append(use)
    out = np.zeros(len(sizes), np.int64)
    j = capacity
    for k, use in zip(reversed(order), reversed(keep), strict=True):
        n = int(use[j])
        out[k] = n
        j -= n * int(sizes[k])
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every demand is met exactly."""
    size = np.asarray(sizes, np.int64)
    want = np.asarray(demand, np.int64)
    k = len(size)
    if not k:
        return []
    # column generation: the basis starts with one pattern of each size alone
    basis = [np.where(np.arange(k) == i, capacity // size[i], 0) for i in range(k)]
    for _ in range(12 * k):
        a = np.array(basis, float).T
        x = np.linalg.solve(a, want.astype(float))
        duals = np.linalg.solve(a.T, np.ones(k))
        pattern = _knapsack(size, np.maximum(duals, 0), capacity)
        if duals @ pattern <= 1 + 1e-7:
            break
        step = np.linalg.solve(a, pattern.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[leave] = pattern
    a = np.array(basis, float).T
    x = np.floor(np.linalg.solve(a, want.astype(float)) + 1e-9).clip(min=0).astype(np.int64)
    used: list[tuple[np.ndarray, int]] = []
    left = want.copy()
    for p, n in zip(basis, x, strict=True):
        n = int(min([n, *[left[i] // p[i] for i in range(k) if p[i]]]))
        if n > 0:
            used.append((p, n))
            left = left - n * p
    while left.any():  # the rounded rest: fullest pattern of what is left, as often as it goes
        live = np.flatnonzero(left)
        p = np.zeros(k, np.int64)
        p[live] = _knapsack(size[live], size[live].astype(float), capacity, left[live])
        n = int(min(left[i] // p[i] for i in np.flatnonzero(p)))
        used.append((p, n))
        left = left - n * p
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Assignments (length, from_rank, to_rank, first_container, per_container) and the number of containers.

    Ranks lowest..highest of a length go to consecutive containers, per_container to each."""
    out: list[tuple[int, int, int, int, int]] = []
    lengths = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    big = [n for n in lengths if n > capacity * large]
    total = sum(histogram[n] for n in big)
    containers = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first container, count)

    def offer(room: int, first: int, count: int) -> None:
        if count > 0 and room > 0:
            gaps.setdefault(room, []).append((first, count))

    # groups of equal cardinality over the large ones; a group's members are ranked longest first
    members: list[list[tuple[int, int, int]]] = []  # per group: (length, from_rank, count)
    share = max(1, -(-total // groups)) if total else 1
    free = 0
    for n in big:
        done = 0
        while done < histogram[n]:
            if free == 0:
                members.append([])
                free = share
            take = min(free, histogram[n] - done)
            members[-1].append((n, done, take))
            done += take
            free -= take
    sizes = [g[0][0] for g in members]
    demand = [sum(c for *_, c in g) for g in members]
    # equal rounded sizes are one size to the configurations
    merged: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        merged.setdefault(s, []).append(i)
    few = sorted(merged, reverse=True)
    queues = [[m for i in merged[s] for m in members[i]] for s in few]
    patterns = configurations(few, [sum(demand[i] for i in merged[s]) for s in few], capacity)
    for pattern, times in patterns:
        first = containers
        containers += times
        # every slot of the pattern takes `times` documents, one per container
        slots: list[list[tuple[int, int, int]]] = []
        for g in np.flatnonzero(pattern):
            for _ in range(int(pattern[g])):
                need, runs = times, []
                while need:
                    n, start, c = queues[g].pop(0)
                    take = min(c, need)
                    if take < c:
                        queues[g].insert(0, (n, start + take, c - take))
                    runs.append((n, start, take))
                    need -= take
                slots.append(runs)
        edges = {0, times}
        for runs in slots:
            at = 0
            for n, start, c in runs:
                out.append((n, start, start + c, first + at, 1))
                at += c
                edges.add(at)
        cuts = sorted(edges)
        for a, b in zip(cuts, cuts[1:], strict=False):
            load = 0
            for runs in slots:
                at = 0
                for n, _, c in runs:
                    if at <= a < at + c:
                        load += n
                        break
                    at += c
            offer(capacity - load, first + a, b - a)
    # small ones fill the gaps, longest first, each into the least room that holds it
    for n in (x for x in lengths if x <= capacity * large):
        rank, left = 0, histogram[n]
        while left:
            room = min((r for r in gaps if r >= n), default=None)
            if room is None:
                fit = capacity // n
                full, rest = divmod(left, fit)
                if full:
                    out.append((n, rank, rank + full * fit, containers, fit))
                    offer(capacity - fit * n, containers, full)
                    containers += full
                    rank += full * fit
                if rest:
                    out.append((n, rank, rank + rest, containers, rest))
                    offer(capacity - rest * n, containers, 1)
                    containers += 1
                break
            first, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            take = min(count, left)
            out.append((n, rank, rank + take, first, 1))
            offer(room - n, first, take)
            offer(room, first + take, count - take)
            rank += take
            left -= take
    return out, containers


def ranked(items: DataFrame) -> DataFrame:
    """Adds rank: 0.. within each length, by document and piece."""
    return scan.running_count(items.select("doc_id", "piece", "tokens"), ["tokens"], ["doc_id", "piece"], "rank").select("doc_id", "piece", "tokens", F.col("rank").cast("bigint"))


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, large: float = LARGE, groups: int = GROUPS) -> DataFrame:
    """(container, doc_id, piece, tokens): every document with its container."""
    with small_batches(documents.sparkSession):
        items = staged(pieces(count_tokens(documents, tokenizer), capacity), "pieces")
    return pack_items(items, capacity, large, groups)


def pack_items(items: DataFrame, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> DataFrame:
    """items: (doc_id, piece, tokens), tokens from 1 to capacity."""
    spark = items.sparkSession
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    assignments, _ = plan(histogram, capacity, large, groups)
    # the plan's rows per length are looked up as arrays: bounded by the number of lengths and patterns
    table: dict[int, list[tuple]] = {}
    for n, a, b, first, per in sorted(assignments):
        table.setdefault(n, []).append((a, b, first, per))
    looked = {n: tuple(np.asarray(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in table.items()}
    shared = spark.sparkContext.broadcast(looked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        for b in batches:
            tokens, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            container = np.empty(len(tokens), np.int64)
            for n in np.unique(tokens):
                at = tokens == n
                begin, _, first, per = by_length[int(n)]
                i = np.searchsorted(begin, rank[at], "right") - 1
                container[at] = first[i] + (rank[at] - begin[i]) // per[i]
            yield pa.RecordBatch.from_arrays([pa.array(container), b.column(0), b.column(1), b.column(2)], ["container", "doc_id", "piece", "tokens"])

    return ranked(items).mapInArrow(run, "container bigint, doc_id bigint, piece int, tokens int")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, documents, tokens, room): what each container holds."""
    return packed.groupBy("container").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").cast("bigint").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).cast("bigint").alias("room")
    )


def waste(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pieces, tokens, containers, least): the containers used against the least that any packing of so many tokens needs."""
    each = fill(packed, capacity)
    return each.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).cast("bigint").alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("containers"),
        F.ceil(F.coalesce(F.sum("tokens"), F.lit(0)) / capacity).cast("bigint").alias("least"),
    )
