"""Tables that are changed by key and merged when they are read.

A table is a folder that all executors share.  A commit writes what it changes and no more: the rows that it
puts, the keys that it deletes, and the keys that it has only seen again.  ``log/v=N`` then names the folders
that make up version N; it is written last and whole, so a commit that breaks off leaves no trace but unread
files.  A reader takes the newest rows of each key; a key may have many rows, which a later put replaces all.

Folders are parted by a hash of the key and sorted by it.  ``compact`` folds the deltas into one, and into the
base when they have grown to a share of it, so that a row is written again a number of times that follows the
logarithm of the table, not the number of commits.

There is one writer at a time.  Each of its commits has a number, and a number that is already in is not
written again, whatever became of the task that asks.  Another writer counts on its own and changes the
same newest version; of two at once, the one that comes second finds its version taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.broadcasts import small

BUCKETS = 32
#: With more deltas than this, a commit folds them.
MOST_DELTAS = 8
#: Deltas with this share of the base's rows are folded into it.
SHARE = 0.3
#: Up to this many keys, their folders are named in the scan's filter.
NAMED = 2000
LOG = "kind string, folder string, seq long, n long, note string"


class DeltaTable:
    """kinds of folders: ``base`` and ``delta`` (rows with ``seq`` and ``gone``), ``touch`` (keys with ``seq`` and a value).

    With ``place``, an int column, folders are parted by it instead of a hash of the key, and ``read`` can be
    asked for some places; a put may move a key to another place."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, touched: str | None = None, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS, place: str | None = None):
        self.spark, self.root, self.key, self.touched, self.buckets, self.most_deltas, self.place = spark, root, key, touched, buckets, most_deltas, place
        self.schema = StructType.fromDDL(schema)
        self.columns = self.schema.fieldNames()
        self._kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)

    # ---------------------------------------------------------------- the log

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, -1 if there is none."""
        path, files = self._files()
        if not files.exists(path):
            return -1
        found = [s.getPath().getName() for s in files.listStatus(path)]
        whole = [int(n[2:]) for n in found if n.startswith("v=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/{n}/_SUCCESS"))]
        return max(whole, default=-1)

    def folders(self, version: int | None = None) -> list[dict]:
        """The log of a version: a row per folder and per writer."""
        version = self.version() if version is None else version
        if version < 0:
            return []
        return [r.asDict() for r in self.spark.read.schema(LOG).parquet(f"{self.root}/log/v={version:012d}").collect()]  # bounded by most_deltas

    def _log(self, rows: list[dict]) -> None:
        version = self.version() + 1
        made = self.spark.createDataFrame([tuple(r[c] for c in ("kind", "folder", "seq", "n", "note")) for r in rows], LOG)
        made.coalesce(1).write.mode("error").parquet(f"{self.root}/log/v={version:012d}")

    # ---------------------------------------------------------------- writing

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, seq: int) -> dict:
        """rows in a new folder; a folder that a hot key makes large is split over files by Spark."""
        folder, place = f"{kind}-{uuid.uuid4().hex}", "bucket"
        at = F.coalesce(self.place, F.lit(-1)) if self.place in rows.columns else self._bucket(F.col(self.key))
        dealt = rows.withColumn(place, at).hint("rebalance", place).sortWithinPartitions(place, self.key)
        dealt.write.partitionBy(place).parquet(f"{self.root}/{folder}")
        return {"kind": kind, "folder": folder, "seq": seq, "n": self._rows(folder, kind).count(), "note": None}

    def commit(self, writer: str, number: int, puts: DataFrame | None = None, deletes: DataFrame | None = None, touches: DataFrame | None = None, note: dict | None = None) -> dict | None:
        """Put rows, all of a key's at once, delete keys, and renew ``touched`` of keys; returns the note of the commit.

        puts has the table's columns, deletes the key, touches the key and ``touched``.  A key in both puts
        and deletes is put.  If the writer has committed this number or a later one, nothing is written and
        the note of its last commit is returned; so a batch that runs again changes nothing."""
        log = self.folders()
        mine = next((r for r in log if r["kind"] == "writer" and r["folder"] == writer), None)
        if mine and mine["seq"] >= number:
            return json.loads(mine["note"])
        seq = 1 + max((r["seq"] for r in log if r["kind"] in ("base", "delta", "touch")), default=-1)
        parts = []
        if puts is not None:
            parts.append(puts.select(*self.columns, F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("gone")))
        if deletes is not None:
            keys = deletes.select(self.key).distinct()
            if puts is not None:
                keys = keys.join(puts.select(self.key).distinct(), self.key, "left_anti")
            parts.append(keys.select(*[F.col(c) if c == self.key else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns], F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("gone")))
        added = []
        if parts:
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            added.append(self._write(rows, "delta", seq))
        if touches is not None:
            added.append(self._write(touches.select(self.key, self.touched, F.lit(seq).cast("long").alias("seq")), "touch", seq))
        done = {"kind": "writer", "folder": writer, "seq": number, "n": 0, "note": json.dumps(note)}
        self._log([r for r in log if r is not mine] + [r for r in added if r["n"]] + [done])
        if sum(r["kind"] in ("delta", "touch") for r in log) + len(added) > self.most_deltas:
            self.compact()
        return note

    def compact(self, whole: bool = False) -> None:
        """Fold the deltas into one; with the base if they have SHARE of its rows, or if ``whole`` is asked for."""
        log = self.folders()
        changes = [r for r in log if r["kind"] in ("delta", "touch")]
        if not changes:
            return
        base = sum(r["n"] for r in log if r["kind"] == "base")
        kept = [r for r in log if r["kind"] == "writer"]
        seq = max(r["seq"] for r in changes)
        if whole or sum(r["n"] for r in changes) >= SHARE * base:
            rows = self.read().select(*self.columns, F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("gone"))
            added = [self._write(rows, "base", seq)]
        else:
            kept += [r for r in log if r["kind"] == "base"]
            added = [self._write(self._newest(log), "delta", seq)]
            if touched := self._touched(log):
                added.append(self._write(touched.select(self.key, self.touched, F.lit(seq).cast("long").alias("seq")), "touch", seq))
        self._log(kept + added)

    # ---------------------------------------------------------------- reading

    def _rows(self, folder: str, kind: str) -> DataFrame:
        own = f"`{self.key}` {self.schema[self.key].dataType.simpleString()}, `{self.touched}` {self.schema[self.touched].dataType.simpleString()}, seq long" if kind == "touch" else f"{self._kinds}, seq long, gone boolean"
        return self.spark.read.schema(f"{own}, bucket int").parquet(f"{self.root}/{folder}")

    def _all(self, log: list[dict], kind: str, within: Column | None = None) -> DataFrame | None:
        out = None
        for r in log:
            if r["kind"] == kind:
                rows = self._rows(r["folder"], kind)
                rows = rows if within is None else rows.where(within)
                out = rows if out is None else out.unionByName(rows)
        return out

    def _newest(self, log: list[dict], within: Column | None = None) -> DataFrame | None:
        """The rows of the deltas that no later delta replaces or deletes, and the keys deleted last."""
        rows = self._all(log, "delta", within)
        if rows is None:
            return None
        last = rows.groupBy(F.col(self.key).alias("__key")).agg(F.max("seq").alias("__seq"))
        same = F.col(self.key).eqNullSafe(F.col("__key")) & (F.col("seq") == F.col("__seq"))
        return rows.join(last, same).select(*self.columns, "seq", "gone")

    def _touched(self, log: list[dict], within: Column | None = None) -> DataFrame | None:
        rows = self._all(log, "touch", within)
        return None if rows is None else rows.groupBy(self.key).agg(F.max(self.touched).alias(self.touched))

    def read(self, version: int | None = None, only: DataFrame | None = None, columns: list[str] | None = None, places: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of the keys of ``only``, whose folders alone are read if they are few;
        of the folders ``places``.

        The base is not shuffled for deltas of a checked size: their keys go to it."""
        log = self.folders(version)
        within = None
        if only is not None:
            only = only.select(self.key).distinct()
            if self.place is None:
                found = only.limit(NAMED + 1).select(self._bucket(F.col(self.key)).alias("b")).groupBy("b").count().collect()  # a row per bucket
                if sum(r["count"] for r in found) <= NAMED:
                    within = F.col("bucket").isin([r["b"] for r in found])
        base, newest = self._all(log, "base", within if places is None else F.col("bucket").isin(places)), self._newest(log, within)
        out = self.spark.createDataFrame([], self.schema) if base is None and newest is None else None
        if base is not None:
            out = base.select(*self.columns)
        if newest is not None:
            if out is not None:
                changed = newest.select(F.col(self.key).alias("__key")).distinct()
                out = out.join(small(changed), F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
            alive = newest.where(~F.col("gone")).select(*self.columns)
            alive = alive if places is None else alive.where(F.col(self.place).isin(places))
            out = alive if out is None else out.unionByName(alive)
        if only is not None:
            out = out.join(small(only), self.key, "left_semi")
        touched = self._touched(log, within) if columns is None or self.touched in columns else None
        if touched is not None:
            seen = touched.select(F.col(self.key).alias("__key"), F.col(self.touched).alias("__touched"))
            out = out.join(small(seen), F.col(self.key) == F.col("__key"), "left")
            out = out.select(*[F.greatest(c, "__touched").alias(c) if c == self.touched else F.col(c) for c in self.columns])
        return out.select(*(columns or self.columns))
