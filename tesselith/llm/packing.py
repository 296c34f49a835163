"""Texts into containers of fixed capacity, by linear grouping.

Texts are dealt by hash into shards of bounded size, and each shard is packed on its own. Within a shard, large sizes
are rounded up to the largest of their group, the groups having equal numbers of texts; the best mix of configurations
of these few sizes is found by column generation (a linear programme priced by a knapsack) and rounded down; actual
texts take the places of the rounded sizes, what is left over goes to the fullest container it fits, and the small
texts then fill the rest best-fit, largest first. Only a text larger than the capacity is split: into full containers
and a remainder, which is packed like a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm import tokens
from tesselith.session import cut

#: Texts of a shard, groups of large sizes, and the share of the capacity from which a size is large.
SHARD_ROWS, GROUPS, LARGE = 20_000, 24, 0.1
#: Containers of a shard are numbered below this.
_STRIDE = 10**9


class _Bins:
    """Free room of open containers; best fit by a bit mask of the amounts of free room that occur."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.by_free, self.mask = capacity, [], {}, 0

    def put_back(self, b: int) -> None:
        room = self.free[b]
        self.by_free.setdefault(room, []).append(b)
        self.mask |= 1 << room

    def open(self, used: int) -> int:
        self.free.append(self.capacity - used)
        self.put_back(len(self.free) - 1)
        return len(self.free) - 1

    def best_fit(self, size: int) -> int:
        """Takes the container with the least room for size, or a new one."""
        above = self.mask >> size
        if not above:
            return self.open(size)
        room = size + (above & -above).bit_length() - 1
        stack = self.by_free[room]
        b = stack.pop()
        if not stack:
            self.mask &= ~(1 << room)
        self.free[b] = room - size
        self.put_back(b)
        return b


def _knapsack(value: np.ndarray, size: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Numbers of each size, at most ``most`` in all, of the greatest value that fits."""
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1, dtype="int16")
        for j, s in enumerate(size):
            gain = best[: capacity + 1 - s] + value[j]
            better = gain > new[s:] + 1e-12
            new[s:][better] = gain[better]
            pick[s:][better] = j
        if not (pick >= 0).any():
            break
        picks.append(pick)
        best = new
    counts, room = np.zeros(len(size), dtype="int64"), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= size[pick[room]]
    return counts


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(numbers of each size in a container, how many such containers), in whole containers that need no more than the demand."""
    k = len(size)
    most = int(capacity // size.min())
    columns = np.diag(np.maximum(1, capacity // size)).astype(float)
    inverse = np.linalg.inv(columns)
    x = inverse @ demand
    best, stalled = np.inf, 0
    while stalled <= 50 + 2 * k:  # until no configuration is better; ties could go round for ever
        stalled = 0 if x.sum() < best - 1e-9 else stalled + 1
        best = min(best, x.sum())
        dual = np.maximum(np.ones(k) @ inverse, 0)
        new = _knapsack(dual, size, capacity, most)
        if dual @ new <= 1 + 1e-7:
            break
        way = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-9, x / way, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = new
        inverse = np.linalg.inv(columns)
        x = np.maximum(inverse @ demand, 0)
    found, left = [], demand.astype("int64").copy()
    for j in np.argsort(-x):
        pattern = columns[:, j].astype("int64")
        use = pattern > 0
        n = min(int(x[j] + 1e-9), int((left[use] // pattern[use]).min()))
        if n > 0:
            found.append((pattern, n))
            left -= pattern * n
    return found


def pack_sizes(sizes: np.ndarray, capacity: int, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """The container (from 0 on) of each size, 0 <= size <= capacity; sizes of 0 are spread over the containers in turn."""
    sizes = np.asarray(sizes, dtype="int64")
    to, bins = np.full(len(sizes), -1, dtype="int64"), _Bins(capacity)
    by_size = np.argsort(-sizes, kind="stable")
    big = by_size[sizes[by_size] > capacity * large]
    if len(big):
        parts = [p for p in np.array_split(big, min(groups, len(big))) if len(p)]
        tops: dict[int, list[int]] = {}
        for p in parts:  # groups with the same largest size are one
            tops.setdefault(int(sizes[p[0]]), []).extend(p.tolist())
        rounded = np.array(list(tops))
        queues = list(tops.values())
        for pattern, n in configurations(rounded, np.array([len(q) for q in queues], dtype=float), capacity):
            for _ in range(n):
                members = [queues[j].pop() for j in np.flatnonzero(pattern) for _ in range(pattern[j])]
                b = bins.open(int(sizes[members].sum()))
                to[members] = b
    for i in by_size.tolist():
        size = int(sizes[i])
        if size == 0:
            break
        if to[i] < 0:
            to[i] = bins.best_fit(size)
    rest = np.flatnonzero(to < 0)
    to[rest] = np.arange(len(rest)) % max(1, len(bins.free))
    return to


def pack(sizes: DataFrame, containers: DataFrame, shards: int, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, token_start, n_tokens) of texts (doc_id, n_tokens) for each container_kind.

    Every text with a size, 0 included, is placed once per kind: whole, or in pieces piece_no 0, 1, ... that start at
    token token_start. A null size (a null text) is no text and isn't placed; a null id is kept; repeated rows are
    placed each. A kind whose capacity is null or below 1 takes nothing. container_id is unique within a kind and
    counts from 0 within its shard.
    """
    kinds = containers.where("capacity_tokens >= 1 and container_kind is not null").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity"))
    texts = sizes.where("n_tokens is not null").select("doc_id", F.col("n_tokens").cast("bigint"))
    # By row, not by id: copies of a text go to all shards, too. Rows are sorted within their task first (equal ones can
    # take each other's places), so that a task that runs again deals the same rows to the same shards.
    dealt = texts.sortWithinPartitions("doc_id", "n_tokens").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    # Every text goes to every kind; kinds have numbers, dealt out in turn, and join by them.
    numbered = cut(kinds.distinct().withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("container_kind", "capacity")) - 1))  # a row a kind
    n_kinds = numbered.count()
    jobs = dealt.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n_kinds - 1)))) if n_kinds else dealt.withColumn("__k", F.lit(0))
    jobs = jobs.join(numbered, "__k").select("shard", "container_kind", "capacity", "doc_id", "n_tokens")

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, kind, capacity = int(key[0]), key[1], int(key[2])
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ignore_index=True)
        n = pdf["n_tokens"].to_numpy("int64")
        full = np.where(n > capacity, (n - (n % capacity == 0)) // capacity, 0)  # a remainder of at least 1
        to = pack_sizes(n - full * capacity, capacity, groups, large)
        first = int(to.max()) + 1 if len(to) else 0
        owner = np.repeat(np.arange(len(n)), full)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        row = np.concatenate([np.arange(len(n)), owner])
        piece = np.concatenate([full, number])
        return pd.DataFrame({
            "container_kind": kind,
            "container_id": shard * _STRIDE + np.concatenate([to, first + np.arange(len(owner))]),
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[row],
            "piece_no": piece,
            "token_start": piece * capacity,
            "n_tokens": np.concatenate([n - full * capacity, np.full(len(owner), capacity)]),
        })

    schema = "container_kind string, container_id bigint, doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint"
    return jobs.groupBy("shard", "container_kind", "capacity").applyInPandas(work, schema)


def texts_of(packed: DataFrame, docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, text): what the containers hold, for packed texts of docs (doc_id, text).

    doc_id tells the texts apart: a null one, or one that docs has several times, must not be used. A text in pieces is
    cut into tokens once; its pieces together are the text."""
    pieces = packed.groupBy("container_kind", "doc_id").agg(F.array_sort(F.collect_list(F.struct("token_start", "piece_no", "container_id"))).alias("p"))
    joined = pieces.join(docs.select("doc_id", "text"), "doc_id").select("container_kind", "doc_id", "p", "text")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, doc, own, text in pdf.itertuples(index=False):
                parts = tokens.pieces_of(text, [p["token_start"] for p in own], vocabulary)
                rows += [(kind, p["container_id"], doc, p["piece_no"], part) for p, part in zip(own, parts)]
            yield pd.DataFrame(rows, columns=["container_kind", "container_id", "doc_id", "piece_no", "text"])

    return joined.mapInPandas(cut_up, "container_kind string, container_id bigint, doc_id bigint, piece_no bigint, text string")


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_containers, n_pieces, n_tokens, fill): how full the containers are on average."""
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    total = per.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"))
    caps = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    return total.join(caps, "container_kind").select("container_kind", "n_containers", "n_pieces", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))
