"""A uniform sample of fixed size from records that arrive in batches, for samples too large for one machine.

The sample lives in slots, which are hashed into partitions of bounded size. For a batch of b records after s others,
the number that enter is drawn hypergeometrically; it is split over the partitions by their slots, each partition evicts
that many of its records uniformly, and a uniform sample of the batch takes their places. After every batch all
records seen so far are in the sample with the same probability. Nothing is known of later batches.

The sample is a log: a record that enters is written with its slot and the number of its batch, and the slot's latest
record is the one it holds. So a batch writes only what enters (k / s of it, once s records are seen), never the sample
again; when the log has grown to a multiple of the sample it is written anew without the evicted records.

A batch's random keys are materialised before they are used, so a task that runs again chooses the same.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.session import cut, shared_dir

#: Slots of a partition, entering records that a task places, and the size of the log in samples from which it is written anew.
SLOTS, RUN_ROWS, LOG_SAMPLES = 50_000, 50_000, 3
#: Populations from which numpy's own draws fail.
_HUGE = 10**9


def entering(rng: np.random.Generator, batch: int, before: int, size: int) -> int:
    """How many of ``size`` records drawn from before + batch without replacement are of the batch.

    Beyond numpy's range by inversion: the ratios of neighbouring probabilities are exact, and what lies more than twelve
    deviations from the middle (one in 10 ** 30) is left out. The memory is some deviations, not the size."""
    if batch + before < _HUGE:
        return int(rng.hypergeometric(batch, before, size))
    low, high, total = max(0, size - before), min(batch, size), batch + before
    mode = (size + 1) * (batch + 1) // (total + 2)
    wide = 12 * math.sqrt(size * (batch / total) * (before / total) * ((total - size) / max(1, total - 1))) + 50
    x = np.arange(max(low, mode - int(wide)), min(high, mode + int(wide)) + 1, dtype="int64")
    at = x[:-1].astype(float)
    steps = np.log((batch - at) * (size - at)) - np.log((at + 1) * (before - size + at + 1))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    up = np.cumsum(np.exp(log - log.max()))
    return int(x[np.searchsorted(up, rng.random() * up[-1], "right")])


def split(rng: np.random.Generator, of: np.ndarray, n: int) -> np.ndarray:
    """n draws without replacement from partitions that hold ``of`` records; more than numpy can take are halved first."""
    if not n:
        return np.zeros(len(of), dtype="int64")
    if len(of) == 1:
        return np.array([n], dtype="int64")
    if of.sum() < _HUGE:
        return rng.multivariate_hypergeometric(of, n, method="marginals")
    half = len(of) // 2
    left = entering(rng, int(of[:half].sum()), int(of[half:].sum()), n)
    return np.concatenate([split(rng, of[:half], left), split(rng, of[half:], n - left)])


@dataclass
class Step:
    """Of one batch: how many records enter, and per partition how many leave and how many enter."""

    enter: int
    evict: np.ndarray
    insert: np.ndarray


def capacities(k: int, slots: int = SLOTS) -> np.ndarray:
    parts = max(1, -(-k // slots))
    return k // parts + (np.arange(parts) < k % parts).astype("int64")


def make_step(size: int, k: int, seed: int, caps: np.ndarray, seen: int, held: np.ndarray) -> Step:
    """The step of a batch of ``size`` records after ``seen`` others, of which the partitions hold ``held``."""
    if not size:
        none = np.zeros(len(caps), dtype="int64")
        return Step(0, none, none)
    rng = np.random.default_rng([seed, seen])
    after = min(k, seen + size)
    enter = entering(rng, size, seen, after)
    evict = split(rng, held, int(held.sum() + enter - after))
    return Step(enter, evict, split(rng, caps - held + evict, enter))


def _placed(batch: DataFrame, size: int, step: Step, held: np.ndarray, slots: int, seed: Sequence[int]) -> DataFrame:
    """(__slot, columns...): a uniform sample of step.enter of the batch's ``size`` records, in slots that are free or whose
    records are evicted.

    Taken are the records with the least random keys. Only keys below a bound that surely leaves enough are kept and
    written; they are dealt to runs of about RUN_ROWS by the key, whose counts tell the ranks before each run. A run knows
    its ranks, ranks belong to partitions in turn, and a partition's slots are a function of seed and partition. Every record
    has a key of its own, so copies and rows without id are drawn one by one."""
    columns, enter, slack = batch.columns, step.enter, 6.0
    key = int(np.random.default_rng([*seed, 0]).integers(2**31))
    runs = max(1, -(-enter // RUN_ROWS))
    while True:
        bound = min(1.0, (enter + slack * math.sqrt(enter) + 20) / max(1, size))
        kept = batch.withColumn("__u", F.rand(key)).where(F.col("__u") < bound)
        kept = cut(kept.withColumn("__run", F.floor(F.col("__u") * (runs / bound)).cast("int")))
        counts = np.zeros(runs + 1, dtype="int64")
        for r in kept.groupBy("__run").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a run
            counts[r["__run"]] = r["n"]
        if counts.sum() >= enter:
            break
        slack *= 4
    before, ends = np.cumsum(counts) - counts, np.cumsum(step.insert)

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(before[key[0]])
        pdf = pdf.sort_values("__u", ignore_index=True).iloc[: max(0, enter - first)]
        rank = np.arange(first, first + len(pdf))
        part, slot = np.searchsorted(ends, rank, "right"), np.empty(len(pdf), dtype="int64")
        for p in np.unique(part).tolist():
            rng = np.random.default_rng([*seed, 1, p])
            gone = rng.choice(int(held[p]), int(step.evict[p]), replace=False)
            taken = np.concatenate([gone, np.arange(held[p], held[p] + step.insert[p] - step.evict[p])])
            own = part == p
            slot[own] = p * slots + taken[rank[own] - (ends[p] - step.insert[p])]
        out = pdf[columns].copy()
        out.insert(0, "__slot", slot)
        return out

    schema = T.StructType([T.StructField("__slot", T.LongType()), *batch.schema])
    return kept.groupBy("__run").applyInPandas(place, schema)


class Reservoir:
    """The sample of a stream, kept as a log below ``path``: call update with each batch, e.g. from foreachBatch.

    Log and state files are written under new names, the state last and by renaming, so a batch that failed halfway is
    simply repeated and a crash leaves the last state; a batch number already taken in is ignored. All batches have the
    same columns; nulls, copies and rows without id are records like others.
    """

    def __init__(self, spark: SparkSession, k: int, path: str | None = None, seed: int = 1, slots: int = SLOTS):
        if k < 0:
            raise ValueError("k must not be negative")
        self.spark, self.k, self.seed, self.slots = spark, k, seed, slots
        self.path = path or f"{shared_dir(spark)}/reservoir-{uuid.uuid4().hex}"
        self.caps = capacities(k, slots)

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _states(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("state-"))

    def state(self) -> dict:
        """batch, seen, held (per partition), rows (of the log), log (its folders); of the last complete update."""
        names = self._states()
        if not names:
            return {"batch": -1, "seen": 0, "held": [0] * len(self.caps), "rows": 0, "log": []}
        fs, path = self._fs(names[-1])
        data = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
        finally:
            data.close()

    def _log(self, state: dict) -> DataFrame:
        """The latest record of each slot, as (__slot, __batch, columns...)."""
        rows = self.spark.read.parquet(*[f"{self.path}/{name}" for name in state["log"]])
        names = [c for c in rows.columns if c not in ("__slot", "__batch")]
        last = rows.groupBy("__slot").agg(F.max_by(F.struct("__batch", *[F.col(f"`{c}`") for c in names]), "__batch").alias("r"))
        return last.select("__slot", "r.*")

    def sample(self) -> DataFrame:
        """The sample: the columns of the batches, and slot."""
        state = self.state()
        if not state["log"]:
            raise ValueError("no batch has arrived")
        return self._log(state).drop("__batch").withColumnRenamed("__slot", "slot")

    def update(self, batch: DataFrame, number: int) -> None:
        old = self.state()
        if number <= old["batch"]:
            return
        size, held = batch.count(), np.array(old["held"], dtype="int64")
        step = make_step(size, self.k, self.seed, self.caps, old["seen"], held)
        log, rows = list(old["log"]), old["rows"] + step.enter
        if step.enter or not log:
            placed = _placed(batch, size, step, held, self.slots, (self.seed, number))
            log.append(f"log-{number:012d}-{uuid.uuid4().hex[:8]}")
            placed.withColumn("__batch", F.lit(number).cast("bigint")).write.parquet(f"{self.path}/{log[-1]}")
        state = {"batch": number, "seen": old["seen"] + size, "held": (held - step.evict + step.insert).tolist(), "rows": rows, "log": log}
        if rows > LOG_SAMPLES * max(1, self.k):
            whole = f"log-{number:012d}-{uuid.uuid4().hex[:8]}"
            self._log(state).write.parquet(f"{self.path}/{whole}")
            state |= {"log": [whole], "rows": int(sum(state["held"]))}
        self._keep(state, old)

    def _keep(self, state: dict, old: dict) -> None:
        """The state's file, complete before it has its name; older ones and log folders of neither state are removed."""
        fs, temporary = self._fs(f"tmp-{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(temporary, self._fs(f"state-{state['batch']:012d}")[1]):
            raise OSError(f"state {state['batch']} exists already")
        for name in self._states()[:-2]:
            fs.delete(self._fs(name)[1], False)
        wanted = {*state["log"], *old["log"]}
        for s in fs.listStatus(self._fs()[1]):
            name = s.getPath().getName()
            if name.startswith("log-") and name not in wanted:
                fs.delete(s.getPath(), True)


def play(batches: Iterable[DataFrame], reservoir: Reservoir) -> DataFrame:
    """The sample after the batches have arrived one after another."""
    for number, batch in enumerate(batches):
        reservoir.update(batch, number)
    return reservoir.sample()


def arrivals(df: DataFrame, order: str, every: float) -> list[DataFrame]:
    """The batches in which the rows of a table arrived: by the timestamp ``order``, in windows of ``every`` seconds. Rows
    without it are of the first batch. Only the least and the greatest time are looked up, not how many rows there are."""
    at = F.col(f"`{order}`").cast("timestamp").cast("double")
    first, last = df.agg(F.min(at), F.max(at)).first()
    if first is None:
        return [df]
    edges = np.arange(math.floor(first / every) * every, last, every).tolist()[1:]
    stored = lambda v: F.timestamp_seconds(F.lit(v)).cast(df.schema[order].dataType)
    out = []
    for low, high in zip([None, *edges], [*edges, None]):
        inside = F.lit(True)
        if high is not None:
            inside &= F.col(f"`{order}`") < stored(high)
        if low is not None:
            inside &= F.col(f"`{order}`") >= stored(low)
        elif high is not None:
            inside |= F.col(f"`{order}`").isNull()
        out.append(df.where(inside))
    return out


def reservoir_sample(df: DataFrame, k: int, order: str, columns: Sequence[str], every: float, seed: int = 1, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(columns..., slot): k records of df, or all if it has no more, drawn as its rows arrive in windows of ``every`` seconds.

    Repeated rows and rows with nulls are records of their own; other columns play no part. k = 0 or an empty df gives no
    rows. The same seed and the same files give the same sample."""
    spark = df.sparkSession
    batches = (b.select(*[F.col(f"`{c}`") for c in columns]) for b in arrivals(df, order, every))
    return play(batches, Reservoir(spark, k, path, seed, slots))
