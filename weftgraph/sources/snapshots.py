"""Several stored tables that change together.

Tables are cut into buckets by a hash of the repository. A change writes the
buckets that it touches into new folders and then one small commit file, which
says for every table and bucket which folder counts. Readers take the commit
with the largest number, so they see all of a change or nothing of it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weftgraph.session import shuffles_freed

BUCKETS = 64


class Snapshot:
    """One state of the tables: ``batch`` is the last one applied, ``folders`` maps table and bucket to a folder's number."""

    def __init__(self, number: int = 0, batch: int | None = None, folders: dict[str, dict[str, int]] | None = None):
        self.number, self.batch, self.folders = number, batch, folders or {}


class SnapshotStore:
    """Tables under ``path``; the number of ``buckets`` is fixed by the first commit."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        folder, files = self._path("commits"), self._files()
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def at(self, number: int) -> Snapshot:
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/commits/{number:012d}.json").collect())
        found = json.loads(text)
        return Snapshot(number, found["batch"], found["folders"])

    def current(self) -> Snapshot:
        commits = self.commits()
        return self.at(commits[-1]) if commits else Snapshot()

    def bucket(self, repo: Column) -> Column:
        return F.pmod(F.xxhash64(repo), F.lit(self.buckets)).cast("int")

    def buckets_of(self, repos: DataFrame) -> list[int]:
        """The buckets of ``repos(repo)``: never more than the store has."""
        return sorted(r[0] for r in repos.select(self.bucket(F.col("repo"))).distinct().collect())

    def read(self, table: str, schema: T.StructType, snapshot: Snapshot | None = None, only: list[int] | None = None, but: list[int] | None = None) -> DataFrame:
        """A table of a snapshot (the current one), or some of its buckets."""
        folders = (snapshot or self.current()).folders.get(table, {})
        paths = [f"{self.path}/{table}/{number:012d}/bucket={b}" for b, number in sorted(folders.items(), key=lambda x: int(x[0]))
                 if (only is None or int(b) in only) and (but is None or int(b) not in but)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(*schema.names)

    def stage(self, snapshot: Snapshot, table: str, rows: DataFrame, repo: str, touched: list[int]) -> None:
        """Write the whole new content of the touched buckets for the next commit; ``snapshot`` then knows the folders.

        What an attempt that failed has left under the same number is overwritten.
        """
        folder = f"{self.path}/{table}/{snapshot.number:012d}"
        with shuffles_freed(self.spark):
            rows.withColumn("bucket", self.bucket(F.col(repo))).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        status = self._files().listStatus(self._path(f"{table}/{snapshot.number:012d}"))
        there = {int(n[7:]) for n in (f.getPath().getName() for f in status) if n.startswith("bucket=")}
        known = {b: n for b, n in snapshot.folders.get(table, {}).items() if int(b) not in touched}
        snapshot.folders[table] = known | {str(b): snapshot.number for b in touched if b in there}

    def following(self, snapshot: Snapshot, batch: int | None) -> Snapshot:
        """The next state, so far with the folders of this one."""
        return Snapshot(snapshot.number + 1, batch, {t: dict(f) for t, f in snapshot.folders.items()})

    def commit(self, snapshot: Snapshot) -> None:
        """Make a staged state the current one, by one rename of a finished file."""
        files, target = self._files(), self._path(f"commits/{snapshot.number:012d}.json")
        draft = self._path(f"commits/{snapshot.number:012d}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({"batch": snapshot.batch, "folders": snapshot.folders}).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"commit {snapshot.number} is already there: another writer changes {self.path}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete the commits before the last ``keep`` ones and the folders that only they use."""
        numbers, files = self.commits(), self._files()
        used = {(t, b, n) for c in numbers[-keep:] for t, f in self.at(c).folders.items() for b, n in f.items()}
        for number in numbers[:-keep]:
            for table, folders in self.at(number).folders.items():
                for b, n in folders.items():
                    if (table, b, n) not in used:
                        files.delete(self._path(f"{table}/{n:012d}/bucket={b}"), True)
            files.delete(self._path(f"commits/{number:012d}.json"), False)
