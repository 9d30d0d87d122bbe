"""Reproducible sample that is stable as data grows: permanent random numbers.

Each identifier gets a uniform number when it is first seen, written to a register and never changed. The register grows by anti-join
insert: a batch adds only identifiers that the register does not hold. A sample is every identifier whose number is below the threshold of
its stratum, and thresholds never fall, so what was chosen stays chosen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTER = T.StructType([T.StructField("id", T.LongType()), T.StructField("stratum", T.StringType()), T.StructField("prn", T.DoubleType()), T.StructField("generation", T.IntegerType())])
THRESHOLDS = T.StructType([T.StructField("stratum", T.StringType()), T.StructField("threshold", T.DoubleType()), T.StructField("generation", T.IntegerType())])


def stratum_name(col: Column) -> Column:
    """One writing per stratum: trimmed lower case; null and empty are the stratum 'unknown'."""
    return F.coalesce(F.nullif(F.lower(F.trim(col)), F.lit("")), F.lit("unknown"))


def uniform(key: Column, seed: str) -> Column:
    """52 bits of a keyed digest as a number in [0, 1): the same for a key whatever the partitioning, run or machine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


class Register:
    """The persisted register at ``path`` (a folder all executors share), which any process may open again.

    Identifiers and thresholds are Parquet folders with names of their own, written once and never changed. What belongs to the register is
    told by the newest complete file in ``log``, which names the folders and the seed; an insert that was broken off leaves folders that no
    file names. A file of the log is created only where none is, so of two writers at a time the second gets an error and loses nothing.
    """

    def __init__(self, spark: SparkSession, path: str, seed: str = "maskwright-1") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.seed = self._state().get("seed", seed)  # the register's own seed, once it has one

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/log")
        if not self._fs().exists(folder):
            return []
        return sorted(int(n.removesuffix(".json")) for f in self._fs().listStatus(folder) if (n := f.getPath().getName()).removesuffix(".json").isdigit())

    def _state(self) -> dict:
        """The newest complete entry of the log: version, seed, numbers and thresholds (folders); {} for a new register."""
        for v in reversed(self._versions()):
            stream = self._fs().open(self._hadoop(f"{self.path}/log/{v:09d}.json"))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:  # not written to its end: the entry before it holds
                continue
            finally:
                stream.close()
        return {}

    def _commit(self, numbers: list[str], thresholds: list[str], version: int) -> None:
        stream = self._fs().create(self._hadoop(f"{self.path}/log/{version:09d}.json"), False)  # an error if it is there
        stream.write(bytearray(json.dumps({"version": version, "seed": self.seed, "numbers": numbers, "thresholds": thresholds}).encode()))
        stream.close()

    @property
    def generation(self) -> int:
        """Number of the next insert."""
        return max(self._versions(), default=-1) + 1

    def _read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def numbers(self) -> DataFrame:
        """All identifiers with stratum and number."""
        return self._read(self._state().get("numbers", []), REGISTER)

    def insert(self, batch: DataFrame, rates: dict[str, float], default: float) -> None:
        """Registers the batch's new identifiers (anti-join) and raises thresholds to ``rates``; a lower rate leaves the threshold.

        Null identifiers are left out. An identifier that comes in several strata at first sight belongs to the smallest named one (so a
        known stratum goes before 'unknown' only by name); later batches never change its stratum or number.
        """
        state, g = self._state(), self.generation
        numbers, thresholds = state.get("numbers", []), state.get("thresholds", [])
        s = stratum_name(F.col("stratum"))
        seen = batch.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), s.alias("stratum"))
        first = seen.groupBy("id").agg(F.min("stratum").alias("stratum"))
        if numbers:
            first = first.join(self._read(numbers, REGISTER).select("id"), "id", "left_anti")
        new = first.select("id", "stratum", uniform(F.col("id"), self.seed).alias("prn"), F.lit(g).alias("generation"))
        mine = f"{g:09d}-{uuid.uuid4().hex}"
        new.write.mode("errorifexists").parquet(f"{self.path}/numbers/{mine}")
        fresh = self._read([f"numbers/{mine}"], REGISTER)
        old = self._read(thresholds, THRESHOLDS)
        strata = fresh.select("stratum").union(old.select("stratum")).distinct()
        rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("stratum")) if rates else F.lit(None).cast("double"), F.lit(default))
        top = old.groupBy("stratum").agg(F.max("threshold").alias("old"))
        now = strata.join(top, "stratum", "left").select("stratum", F.greatest(rate, F.coalesce("old", F.lit(0.0))).alias("threshold"), F.lit(g).alias("generation"))
        now.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/thresholds/{mine}")
        # each insert writes the thresholds of all strata, so the newest folder is enough
        self._commit([*numbers, f"numbers/{mine}"], [f"thresholds/{mine}"], g)

    def compact(self) -> None:
        """Writes the identifiers of all inserts as one folder; the sample stays the same. Old folders stay for readers that still use them."""
        state, g = self._state(), self.generation
        if len(state.get("numbers", [])) > 1:
            mine = f"{g:09d}-{uuid.uuid4().hex}"
            self._read(state["numbers"], REGISTER).write.mode("errorifexists").parquet(f"{self.path}/numbers/{mine}")
            self._commit([f"numbers/{mine}"], state["thresholds"], g)

    def sample(self) -> DataFrame:
        """id, stratum, prn and threshold of every identifier with prn < threshold of its stratum."""
        state = self._state()
        top = self._read(state.get("thresholds", []), THRESHOLDS).groupBy("stratum").agg(F.max("threshold").alias("threshold"))
        return self._read(state.get("numbers", []), REGISTER).join(F.broadcast(top), "stratum").where("prn < threshold").select("id", "stratum", "prn", "threshold")
