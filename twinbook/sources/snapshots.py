"""Versioned snapshots on plain files: each write is a new folder, a pointer file names the current one."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_DEFAULTS = {"phrase_similarity": 0.0, "entity_similarity": 0.0, "taker_fee_coefficient": 0.05}
_EXCLUSIONS = "k_id string, p_id string, flagged_at timestamp, note string"


def stamp(at: datetime) -> str:
    """Name of a version: the instant in UTC to the microsecond."""
    return at.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


class SnapshotStore:
    """Pairs and exclusions under a folder that all executors reach. Readers see a whole version or the one before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.folder}/{name}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            version = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return f"{self.folder}/{name}/{version}"

    def _replace(self, new, old) -> None:
        """Renames a file over another in one step, so that a reader finds the old pointer or the new one."""
        context = self.spark.sparkContext
        fs = context._jvm.org.apache.hadoop.fs
        options = context._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(new.toUri(), context._jsc.hadoopConfiguration()).rename(new, old, options)

    def _publish(self, name: str, df: DataFrame, at: datetime) -> str:
        version = stamp(at)
        df.write.parquet(f"{self.folder}/{name}/{version}")
        fs, new = self._fs(f"{self.folder}/{name}/CURRENT.{version}")
        out = fs.create(new, True)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()
        self._replace(new, self._fs(f"{self.folder}/{name}/CURRENT")[1])
        return version

    def exclusions(self) -> DataFrame:
        """Excluded pairs by time and ids; empty where none were ever written."""
        path = self._current("exclusions")
        empty = self.spark.createDataFrame([], _EXCLUSIONS)
        return (self.spark.read.parquet(path) if path else empty).orderBy("flagged_at", "k_id", "p_id")

    def pairs(self) -> DataFrame:
        """The current pairs; columns that an older version lacks get their defaults, and no version gives no pairs."""
        path = self._current("pairs")
        at = self.spark.read.parquet(path) if path else self.spark.createDataFrame([], "k_id string, p_id string, confidence double")
        for c, default in PAIR_DEFAULTS.items():
            at = at.withColumn(c, F.coalesce(F.col(c), F.lit(default)) if c in at.columns else F.lit(default))
        return at

    def overwrite(self, matches: DataFrame, at: datetime) -> str:
        """A new version with the matches that aren't excluded, one row per pair (the most confident), all of one time."""
        kept = matches.join(self.exclusions().select("k_id", "p_id"), ["k_id", "p_id"], "left_anti")
        best = kept.groupBy("k_id", "p_id").agg(F.max_by(F.struct("*"), "confidence").alias("m")).select("m.*")
        return self._publish("pairs", best.withColumn("matched_at", F.lit(at)), at)

    def flag(self, k_id: str, p_id: str, at: datetime, note: str = "") -> bool:
        """Excludes a pair and drops it from the current pairs; says whether it was new."""
        known = self.exclusions()
        if not known.where((F.col("k_id") == k_id) & (F.col("p_id") == p_id)).isEmpty():
            return False
        self._publish("exclusions", known.unionByName(self.spark.createDataFrame([(k_id, p_id, at, " ".join(note.split()))], _EXCLUSIONS)), at)
        if self._current("pairs"):
            self._publish("pairs", self.pairs().where(~((F.col("k_id") == k_id) & (F.col("p_id") == p_id))), at)
        return True

    def unflag(self, k_id: str, p_id: str, at: datetime) -> bool:
        """Ends an exclusion; the pair comes back with the next overwrite. Says whether there was one."""
        known = self.exclusions()
        left = known.where(~((F.col("k_id") == k_id) & (F.col("p_id") == p_id)))
        if left.count() == known.count():
            return False
        self._publish("exclusions", left, at)
        return True

    def backup(self, folder: str, at: datetime) -> str | None:
        """A copy of the current pairs named by time, or None where there are none."""
        path = self._current("pairs")
        if path is None:
            return None
        target = f"{folder.rstrip('/')}/pairs_{stamp(at)}"
        self.spark.read.parquet(path).write.parquet(target)
        return target
