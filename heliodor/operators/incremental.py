"""Problem 7: take exactly the records whose current version has no valid output yet.

The target is the state. Each output row carries the key and the version of the record it was made from, so what is left to
do is an anti-join of the source against the target. Each publication adds a part under a name of its own and becomes
visible through one atomic rename of a pointer file; a run that dies before the rename leaves the old version in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.sources.tables import read

#: Fixed values of the record life cycle.
TAKEN = ("fetched", "normalized", "indexed")
DONE, UNDONE = "done", "rolled_back"


def strong_etag(etag: Column) -> Column:
    """The validator without its weak mark."""
    return F.regexp_replace(etag, r"^W/", "")


def same_version(etag_a: Column, hash_a: Column, etag_b: Column, hash_b: Column) -> Column:
    """Equal etags, weak marks aside; where either etag is null, equal content hashes. Never null."""
    by_etag = strong_etag(etag_a) == strong_etag(etag_b)
    return F.coalesce(F.when(etag_a.isNotNull() & etag_b.isNotNull(), by_etag).otherwise(hash_a == hash_b), F.lit(False))


def target_state(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, etag, content_hash) of the last valid output of each key.

    Rows of runs that were rolled back are no outputs. A row delivered twice or late changes nothing, as the greatest
    `logged_at` wins (ties: the greatest `log_id`). The maximum is combined before the shuffle, so a hub key that holds a
    third of the log sends one row per task. Rows without a key or a time are left out.
    """
    undone = runs.where(F.col("outcome") == UNDONE).select("run_id").distinct()
    done = log.where((F.col("outcome") == DONE) & F.col("id").isNotNull() & F.col("logged_at").isNotNull())
    # anti-join without a hint: Spark broadcasts `undone` only while its measured size is under the session's threshold
    valid = done.join(undone, "run_id", "left_anti")
    last = valid.groupBy("id").agg(F.max(F.struct("logged_at", "log_id", "etag", "content_hash")).alias("last"))
    return last.select("id", F.col("last.etag").alias("etag"), F.col("last.content_hash").alias("content_hash"))


def pending(source: DataFrame, state: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `source` whose version differs from that in `state`, or whose key isn't there.

    Both sides need `key`, `etag` and `content_hash`; other columns of `source` pass through, and columns of `state` can't
    clash with them. A null key is never pending. Keys are matched by one shuffle of each side; only the version travels.
    """
    s = state.select(F.col(key).alias("__key"), F.col("etag").alias("__etag"), F.col("content_hash").alias("__hash"))
    at = (F.col(key) == F.col("__key")) & same_version(F.col("etag"), F.col("content_hash"), F.col("__etag"), F.col("__hash"))
    return source.where(F.col(key).isNotNull()).join(s, at, "left_anti")


#: Parts of a target after which, or rows of the later parts as a share of the first's from which, they are merged.
MOST_PARTS, MERGE_SHARE = 12, 0.5


class Target:
    """A target table in `root`, as parts in folders that the file CURRENT lists in order.

    A part holds the rows of a publication, and the ids whose earlier rows they replace or that are gone. A publication writes its own
    rows alone; once the later parts together have grown large beside the first, all are merged into one. What no version
    since the last but one needs is removed, so a reader of the version before isn't disturbed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark._jsc.hadoopConfiguration())
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self) -> dict:
        """What CURRENT says: its version, the parts with their numbers of rows, and the parts of the version before."""
        pointer = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(pointer):
            return {"version": None, "parts": [], "before": []}
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0])

    def current(self) -> str | None:
        """The name of the version in force."""
        return self._listed()["version"]

    def read(self) -> DataFrame | None:
        """The rows in force; None before the first publication."""
        listed = self._listed()
        return self._merged([p["name"] for p in listed["parts"]]) if listed["version"] else None

    def _merged(self, parts: list[str]) -> DataFrame:
        rows, replaced = None, None
        for no, name in enumerate(parts):
            part = self.spark.read.parquet(f"{self.root}/{name}/rows").withColumn("__part", F.lit(no))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            if no:
                ids = self.spark.read.parquet(f"{self.root}/{name}/ids").select(F.col("id").alias("__id"), F.lit(no).alias("__since"))
                replaced = ids if replaced is None else replaced.unionByName(ids)
        if replaced is not None:
            last = replaced.groupBy("__id").agg(F.max("__since").alias("__since"))  # one row an id, so a hot id can't grow in the join
            rows = rows.join(last, F.col("id") == F.col("__id"), "left").where("__since IS NULL OR __part >= __since").drop("__id", "__since")
        return rows.drop("__part")

    def state(self) -> DataFrame | None:
        rows = self.read()
        return None if rows is None else rows.select("id", "etag", "content_hash")

    def publish(self, outputs: DataFrame, gone: DataFrame | None = None) -> int:
        """Replace the rows of the keys in `outputs`, drop those of the ids in `gone`, keep the rest, and switch in one step.

        The number of rows in `outputs`. Nothing is switched where there is nothing to publish.
        """
        listed, name = self._listed(), f"p-{uuid.uuid4().hex}"
        outputs.write.parquet(f"{self.root}/{name}/rows")
        written = self.spark.read.parquet(f"{self.root}/{name}/rows")
        ids = written.select("id") if gone is None else written.select("id").unionAll(gone.select("id"))
        ids.where("id IS NOT NULL").distinct().write.parquet(f"{self.root}/{name}/ids")
        count = written.count()  # from the files' footers
        if not count and self.spark.read.parquet(f"{self.root}/{name}/ids").isEmpty():
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            return 0
        parts = [*listed["parts"], {"name": name, "rows": count}]
        self._switch(parts, listed)
        if len(parts) > MOST_PARTS or sum(p["rows"] for p in parts[1:]) > MERGE_SHARE * max(parts[0]["rows"], 1):
            self.merge()
        return count

    def merge(self) -> None:
        """Write the rows in force as one part, and remove what no version since the last but one needs."""
        listed = self._listed()
        if len(listed["parts"]) < 2:
            return
        name = f"p-{uuid.uuid4().hex}"
        self._merged([p["name"] for p in listed["parts"]]).write.parquet(f"{self.root}/{name}/rows")
        self._switch([{"name": name, "rows": self.spark.read.parquet(f"{self.root}/{name}/rows").count()}], listed)

    def _switch(self, parts: list[dict], old: dict) -> None:
        version, before = f"v-{uuid.uuid4().hex}", [p["name"] for p in old["parts"]]
        staged = f"{self.root}/.CURRENT-{version}"
        stream = self._fs.create(self._path(staged))
        stream.write(bytearray(json.dumps({"version": version, "parts": parts, "before": before}).encode()))
        stream.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        self._context.rename(self._path(staged), self._path(f"{self.root}/CURRENT"), overwrite)
        needed = {p["name"] for p in parts} | set(before)
        for name in old["before"]:
            if name not in needed:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Ids of manifest rows the next run has to take."""
    source = read(spark, root, "manifest").where(F.col("status").isin(*TAKEN)).select("id", "etag", "content_hash")
    state = target_state(read(spark, root, "process_log"), read(spark, root, "sync_runs"))
    return pending(source, state).select("id").distinct()


P7_FOUND_SQL = """
WITH valid AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.id ORDER BY l.logged_at DESC, l.log_id DESC) AS rn
  FROM process_log l
  WHERE l.outcome = 'done' AND l.id IS NOT NULL AND l.logged_at IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM sync_runs r WHERE r.run_id = l.run_id AND r.outcome = 'rolled_back')
), last AS (SELECT * FROM valid WHERE rn = 1)
SELECT DISTINCT m.id
FROM manifest m LEFT JOIN last l ON l.id = m.id
WHERE m.status IN ('fetched', 'normalized', 'indexed') AND m.id IS NOT NULL
  AND (l.id IS NULL OR NOT coalesce(
    CASE WHEN m.etag IS NOT NULL AND l.etag IS NOT NULL
         THEN regexp_replace(m.etag, '^W/', '') = regexp_replace(l.etag, '^W/', '')
         ELSE m.content_hash = l.content_hash END, FALSE))
"""
