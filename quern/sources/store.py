"""An immutable store of scores, and a ledger of experiments, as Parquet and JSON lines."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.folds import digest
from quern.operators.metrics import auc
from quern.sources.scratch import exists

#: Stands for a fingerprint in rows that name a champion.
CROWN = "crown"
STATUSES = ("planned", "running", "done", "failed", "void")


class ScoreStore:
    """Scores by experiment below one folder: ``scores/exp_id=...`` and an index with digests. What is stored stays."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        return exists(self.spark, path)

    def index(self) -> DataFrame:
        """``exp_id, n, digest, duplicate_of`` of every experiment, sorted."""
        schema = "exp_id string, n bigint, digest string, duplicate_of string"
        if not self._exists(f"{self.path}/index"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/index").orderBy("exp_id")

    def save(self, exp_id: str, scores: DataFrame) -> str:
        """Store ``scores(id, score)``. The same content again is accepted, other content is refused. Returns the digest."""
        found = digest(scores.select("id", F.col("score").cast("double").alias("score")), ["id", "score"]).first()
        known = {r["exp_id"]: r for r in self.index().collect()}
        if exp_id in known:
            if known[exp_id]["digest"] != found["digest"]:
                raise ValueError(f"{exp_id} is stored with other content")
            return found["digest"]
        # The index is what counts: files without an entry are what an interrupted save left, and are written again.
        scores.select("id", "score").write.mode("overwrite").parquet(f"{self.path}/scores/exp_id={exp_id}")
        twin = min((k for k, r in known.items() if r["digest"] == found["digest"]), default=None)
        row = self.spark.createDataFrame([(exp_id, found["n"], found["digest"], twin)], "exp_id string, n bigint, digest string, duplicate_of string")
        row.coalesce(1).write.mode("append").json(f"{self.path}/index")
        return found["digest"]

    def load(self, exp_id: str) -> DataFrame:
        """The stored scores, after their digest has been checked."""
        entry = self.index().where(F.col("exp_id") == exp_id).first()
        if entry is None:
            raise KeyError(exp_id)
        scores = self.spark.read.parquet(f"{self.path}/scores/exp_id={exp_id}")
        found = digest(scores.select("id", F.col("score").cast("double").alias("score")), ["id", "score"]).first()
        if found["digest"] != entry["digest"]:
            raise ValueError(f"{exp_id} was changed after it was stored")
        return scores

    def pool(self) -> DataFrame:
        """All scores in long form, one copy of equal ones."""
        kept = self.index().where("duplicate_of is null").select("exp_id")
        long = self.spark.read.parquet(f"{self.path}/scores")
        return long.join(kept, "exp_id", "left_semi").select("id", F.col("exp_id").alias("model"), "score")


class Ledger:
    """JSON lines, appended only."""

    SCHEMA = "exp_id string, status string, fingerprint string, auc double, note string, utc string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self, exp_id: str, status: str, fingerprint: str = "", auc: float | None = None, note: str = "") -> None:
        if status not in STATUSES:
            raise ValueError(f"no such status: {status}")
        row = (exp_id, status, fingerprint, auc, note, datetime.now(UTC).isoformat())
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def extend(self, entries: DataFrame) -> None:
        """Append many entries at once; one of another status is an error, and then none is appended."""
        if not entries.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).isEmpty():
            raise ValueError("an entry has no such status")
        names = [f.split()[0] for f in self.SCHEMA.split(", ")]
        entries.select(*names).write.mode("append").json(self.path)

    def policy(self) -> DataFrame:
        """``(fingerprint, may_run)``: whether no experiment of it is done or under way."""
        return self.latest().groupBy("fingerprint").agg((~F.bool_or(F.col("status").isin("done", "running"))).alias("may_run"))

    def rows(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def latest(self) -> DataFrame:
        return latest_status(self.rows())

    def may_run(self, fingerprint: str) -> bool:
        """Whether no run of this fingerprint is done or under way."""
        same = self.latest().where((F.col("fingerprint") == fingerprint) & F.col("status").isin("done", "running"))
        return same.isEmpty()

    def log_scores(self, exp_id: str, store: ScoreStore, labels: DataFrame, note: str = "") -> None:
        """Log a finished experiment by its stored scores: its AUC, and in the note its gain over the champion and how their
        scores correlate."""
        own, leader = store.load(exp_id), self.champion()
        value = auc(labels.join(own, "id"), "score").first()["auc"]
        if leader and leader != exp_id:
            other = store.load(leader)
            base = auc(labels.join(other, "id"), "score").first()["auc"]
            r = own.join(other.withColumnRenamed("score", "other"), "id").agg(F.corr("score", "other")).first()[0]
            note = json.dumps({"note": note, "champion": leader, "delta": round(value - base, 9), "corr": None if r is None else round(r, 6)}, sort_keys=True)
        self.log(exp_id, "done", "", value, note)

    def crown(self, exp_id: str) -> None:
        """Make a finished experiment the champion, whatever its AUC, until another is crowned."""
        if self.latest().where((F.col("exp_id") == exp_id) & (F.col("status") == "done")).isEmpty():
            raise ValueError(f"{exp_id} is not finished")
        row = ("champion:" + exp_id, "done", CROWN, None, exp_id, datetime.now(UTC).isoformat())
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def champion(self) -> str | None:
        """The experiment that was crowned last; without one, the finished one of the highest AUC, the earliest on ties."""
        crowned = self.rows().where(F.col("fingerprint") == CROWN).orderBy(F.desc("utc")).first()
        if crowned:
            return crowned["note"]
        best = self.latest().where("status = 'done' and auc is not null").orderBy(F.desc("auc"), "utc", "exp_id").first()
        return best["exp_id"] if best else None


def latest_status(rows: DataFrame, key: str = "exp_id", at: str = "utc") -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def fingerprint(**parts: object) -> str:
    """SHA-256 of canonical JSON: the same inputs give the same run id whatever their order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class FoldRegistry:
    """Fold assignments by name below one folder, each with its digest. What is registered cannot be changed: the same
    assignment again is accepted, another is refused, and files that were changed are not read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.store = ScoreStore(spark, path)

    def register(self, name: str, folds: DataFrame) -> str:
        return self.store.save(name, folds.select("id", F.col("fold").cast("double").alias("score")))

    def load(self, name: str) -> DataFrame:
        return self.store.load(name).select("id", F.col("score").cast("int").alias("fold"))
