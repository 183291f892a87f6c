"""Velocity of a stream as state that merges: runs of bins are summed up once, and a cycle puts summaries together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from undertow.config import D
from undertow.functions.series import bin_start
from undertow.operators.parts import Parts

# What a run of bins does to the exponentially weighted mean that enters it. The state is (u, d, 1): the mean less the run's
# first value, and its last step; each bin maps it linearly, and its acceleration is a linear form of it. So a run is
# (first value, 3x3 map, sum of the forms, sum of their squares as a 3x3 matrix), and two runs in turn are one such thing.
# Means are held less the first value, so that a series that stays where it is has moments of exactly 0.


def run_of(x, alpha: float = D.alpha):
    """Summaries (rows, 22) of runs x (rows, bins): first value, map, sum, squares."""
    import numpy as np

    n = len(x)
    state, total, squares = np.tile(np.eye(3), (n, 1, 1)), np.zeros((n, 3)), np.zeros((n, 3, 3))
    for above in (x - x[:, :1]).T:
        step = -alpha * state[:, 0]
        step[:, 2] += alpha * above
        form = step - state[:, 1]
        total += form
        squares += form[:, :, None] * form[:, None, :]
        state[:, 0] += step
        state[:, 1] = step
    return np.concatenate([x[:, :1], state.reshape(n, 9), total, squares.reshape(n, 9)], axis=1)


def parts_of(run):
    return run[0], run[1:10].reshape(3, 3), run[10:13], run[13:22].reshape(3, 3)


def composed(one, two):
    """The summary of run one with run two behind it. Brackets do not matter."""
    import numpy as np

    (a, map_a, sum_a, squares_a), (b, map_b, sum_b, squares_b) = parts_of(one), parts_of(two)
    into = map_a.copy()
    into[0, 2] += a - b  # the state as run two holds it
    out = map_b @ into
    out[0, 2] += b - a
    return np.concatenate([[a], out.ravel(), sum_a + into.T @ sum_b, (squares_a + into.T @ squares_b @ into).ravel()])


def repeated(run, times: int):
    """A run that comes times times, put together by doubling; None for no time."""
    out = None
    while times:
        if times & 1:
            out = run if out is None else composed(out, run)
        run, times = composed(run, run), times >> 1
    return out


class Moments:
    """Sum and sum of squares of accelerations along a series that begins with two values."""

    def __init__(self, first: float, second: float, alpha: float = D.alpha):
        self.alpha = alpha
        self.mean, self.step = first + alpha * (second - first), alpha * (second - first)
        self.n, self.total, self.squares = 0, 0.0, 0.0

    def value(self, x: float) -> float:
        """Take one bin, and return its acceleration, which is not yet in the moments."""
        step = self.alpha * (x - self.mean)
        accel, self.step, self.mean = step - self.step, step, self.mean + step
        return accel

    def bin(self, x: float) -> None:
        accel = self.value(x)
        self.n, self.total, self.squares = self.n + 1, self.total + accel, self.squares + accel * accel

    def run(self, run, bins: int) -> None:
        import numpy as np

        first, mapped, total, squares = parts_of(run)
        state = np.array([self.mean - first, self.step, 1.0])
        self.n, self.total, self.squares = self.n + bins, self.total + float(total @ state), self.squares + float(state @ squares @ state)
        u, self.step, _ = mapped @ state
        self.mean = u + first

    def z(self, last: float) -> float:
        """The acceleration of a last bin against those before."""
        accel, mean = self.value(last), self.total / self.n
        deviation = max(0.0, self.squares / self.n - mean * mean) ** 0.5
        if deviation < D.eps:
            return 0.0 if abs(accel) < D.eps else D.flat_z
        return (accel - mean) / deviation


class VelocityState:
    """Bins of each entity's mentions and summaries of runs of size bins, both parts under one commit log.

    A batch adds its counts, and makes anew the summaries of the runs that it touches, late ones too, of those runs' bins
    alone. The window of a cycle moves on by leaving out summaries at its old end; of the run that it begins in and of the
    last one the bins are read: for an entity 2 * size bins and a summary for each run between, where a series has all bins.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: int = D.bin_s, size: int = 36, since: int | None = None, fan: int = 8):
        self.seconds, self.size = seconds, size
        old = F.lit(True) if since is None else F.col("bin") >= since // (seconds * size) * seconds * size
        bins = lambda rows: rows.where(old).groupBy("entity", "bin").agg(F.sum("n").alias("n"), F.sum("opening").alias("opening"))
        runs = lambda rows: rows.groupBy("entity", "run").agg(F.max_by("summary", "batch").alias("summary"), F.max("batch").alias("batch"))
        self.parts = Parts(spark, folder, {"bins": bins, "runs": runs}, fan)

    def run_number(self) -> F.Column:
        return F.floor(F.col("bin") / (self.seconds * self.size))

    def summaries(self, bins: DataFrame) -> DataFrame:
        """entity, run, summary of whole runs' bins (entity, bin, n); bins that are not there are 0."""
        size = self.size

        def summed(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                found = run_of(batch["counts"].flatten().to_numpy().reshape(-1, size))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * 22), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch["entity"], batch["run"], lists], ["entity", "run", "summary"])

        place = ((F.col("bin") / self.seconds).cast("long") % size).cast("int")
        known = bins.groupBy("entity", self.run_number().alias("run")).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("at"), F.col("n").cast("double").alias("n")))).alias("known"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0.0)))
        return known.select("entity", "run", counts.alias("counts")).mapInArrow(summed, "entity string, run long, summary array<double>")

    def add(self, batch: int, mentions: DataFrame) -> bool:
        """Commit a batch of mentions (entity, ts in seconds); False if it was committed before."""
        start = bin_start(F.col("ts"), self.seconds)
        new = mentions.where("ts IS NOT NULL AND entity IS NOT NULL").groupBy(F.lower("entity").alias("entity"), start.alias("bin"))
        new = new.agg(F.count("*").alias("n"), F.count_if(F.col("ts") < start + 60).alias("opening"))
        before = self.parts.merged("bins")
        whole = new.select("entity", "bin", "n")
        if before is not None:
            touched = new.select("entity", self.run_number().alias("run")).distinct()
            there = before.withColumn("run", self.run_number()).join(touched, ["entity", "run"], "left_semi").select("entity", "bin", "n")
            whole = whole.union(there).groupBy("entity", "bin").agg(F.sum("n").alias("n"))
        return self.parts.add(batch, {"bins": new, "runs": self.summaries(whole).withColumn("batch", F.lit(batch).cast("long"))})

    def z(self, since: int, until: int) -> DataFrame:
        """entity, velocity_z of the bins from since to until (starts of bins), for entities with a mention among them.

        As scoring.velocities has it: of the first bin the opening minute is out, and fewer than 12 bins make 0.
        """
        seconds, size = self.seconds, self.size
        width = seconds * size
        n = (until - since) // seconds + 1
        first = -(-(since + 2 * seconds) // width)  # the first whole run: two bins come before it
        last = max(first, until // width)  # the run that is read as bins
        count = F.when(F.col("bin") == since, F.col("n") - F.col("opening")).otherwise(F.col("n")).cast("double")
        apart = F.col("bin").between(since, until) & ((F.col("bin") < first * width) | (F.col("bin") >= last * width))
        bins = self.parts.merged("bins").where(apart).withColumn("n", count).where("n > 0")
        bins = bins.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
        runs = self.parts.merged("runs").where(F.col("run").between(first, last - 1))
        runs = runs.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("run", "summary"))).alias("runs"))

        def scored(batches):
            import numpy as np
            import pyarrow as pa

            silent = run_of(np.zeros((1, size)))[0]
            for batch in batches:
                out = []
                for bins, runs in zip(batch["bins"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                    bins, runs = dict(bins or ()), dict(runs or ())
                    if n < D.min_buckets:
                        out.append(0.0)
                        continue
                    moments = Moments(bins.get(since, 0.0), bins.get(since + seconds, 0.0))
                    for at in range(since + 2 * seconds, min(first * width, until), seconds):
                        moments.bin(bins.get(at, 0.0))
                    at = first
                    for run in [*sorted(runs), last]:
                        if run > at:
                            moments.run(repeated(silent, run - at), (run - at) * size)
                        if run < last:
                            moments.run(np.array(runs[run]), size)
                        at = run + 1
                    for at in range(last * width, until, seconds):
                        moments.bin(bins.get(at, 0.0))
                    out.append(moments.z(bins.get(until, 0.0)))
                yield pa.RecordBatch.from_arrays([batch["entity"], pa.array(out, pa.float64())], ["entity", "velocity_z"])

        return bins.join(runs, "entity", "full").select("entity", "bins", "runs").mapInArrow(scored, "entity string, velocity_z double")


def write_velocity(mentions: DataFrame, path: str, checkpoint: str, seconds: int = D.bin_s, size: int = 36) -> StreamingQuery:
    """Keep the state in path at a stream of mentions (entity, ts in seconds); a batch that is taken again counts once."""

    def save(batch: DataFrame, number: int) -> None:
        VelocityState(batch.sparkSession, path, seconds, size).add(number, batch)

    return mentions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
