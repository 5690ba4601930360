"""An index of search documents in numbered versions: rebuilt beside the current one, compared with the truth, then made current in one step."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.tables import stored
from tracelode.operators import recall

REPORT = "version long, truth_count long, index_count long, truth_document_count long, index_document_count long, parity boolean, current boolean"


class IndexNotReady(RuntimeError):
    """Recall was asked over an index that isn't what the memories project to."""


def fingerprint(*tables: DataFrame) -> str:
    """One text for the contents of tables, in any order of rows: of each the number and the sum of its rows' hashes, of each repeat too.

    Two reads of a table that changed in between give different ones, so a result is void if it
    was computed between them (see ``read_unchanged``).
    """
    marks = []
    for rows in tables:
        plain = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes]
        n, a, b = rows.select(F.xxhash64(*plain).alias("a"), F.hash(*plain).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        marks.append(f"{n}:{a or 0}:{b or 0}")
    return "|".join(marks)


class IndexStore:
    """Versions under a folder that executors share, and a log of commits: the file of the greatest number names the current version.

    A commit is created only where its number is free, so of two rebuilds at a time one is refused and readers see a whole version, always.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        """{version, path} of the last commit, None before the first."""
        path, system = self._path("commits")
        if not system.exists(path):
            return None
        last = max((f.getPath().getName() for f in system.listStatus(path)), default=None)
        if last is None:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{last}", wholetext=True).first()[0])

    def _commit(self, version: int, path: str) -> None:
        at, system = self._path(f"commits/{version:012d}")
        if system.exists(at):
            raise RuntimeError(f"version_taken: {version}")
        out = system.create(at, False)
        out.write(bytearray(json.dumps({"version": version, "path": path}).encode()))
        out.close()

    def documents(self) -> DataFrame:
        """The current version's documents."""
        now = self.current()
        if now is None:
            raise IndexNotReady("index_not_ready: nothing was built")
        return self.spark.read.parquet(now["path"])

    def truth(self, memories: DataFrame) -> DataFrame:
        """The stored marks of what the memories project to (repo_key, n, h), for checks of several versions against one state of the memories: they are projected once for all."""
        return stored(recall.marks(recall.project(memories), ["repo_key"]), "truth")

    def rebuild(self, memories: DataFrame, truth: DataFrame | None = None) -> DataFrame:
        """Builds a version from the memories, compares it with what they project to, and makes it current if it is the same: one row, see REPORT."""
        now = self.current()
        version = 1 + (now["version"] if now else 0)
        path = f"{self.folder}/v{version}-{uuid.uuid4().hex}"
        recall.project(memories).write.partitionBy("repo_key").parquet(path)
        built = self.spark.read.parquet(path)
        truth, found = self.truth(memories) if truth is None else truth, stored(recall.marks(built, ["repo_key"]), "marks")
        same = not recall.same_marks(truth, found, ["repo_key"]).where("not ready").take(1)
        if same:
            self._commit(version, path)
        # Each memory has a document of its own, so memories are counted without their documents.
        (m, i), (n, k) = ([rows.agg(how).first()[0] for rows in two] for how, two in ((F.count_distinct("memory_id"), (memories, built)), (F.coalesce(F.sum("n"), F.lit(0)), (truth, found))))
        return self.spark.createDataFrame([(version, m, i, n, k, same, same)], REPORT)

    def stale(self, memories: DataFrame, repositories: DataFrame | None = None, truth: DataFrame | None = None) -> list[str]:
        """Repositories, of those asked, whose documents aren't those that their memories project to; in order, at most as many as there are."""
        rows = recall.same_marks(recall.marks(recall.project(memories), ["repo_key"]) if truth is None else truth, recall.marks(self.documents(), ["repo_key"]), ["repo_key"])
        if repositories is not None:
            rows = rows.join(repositories.select("repo_key").distinct(), "repo_key", "left_semi")
        return sorted(r.repo_key or "" for r in rows.where("not ready").select("repo_key").collect())

    def require(self, memories: DataFrame, repositories: DataFrame | None = None, truth: DataFrame | None = None) -> None:
        """Stops recall where the index is stale."""
        stale = self.stale(memories, repositories, truth)
        if stale:
            raise IndexNotReady(f"index_not_ready: {', '.join(stale)}")


def read_unchanged(opened: Callable[[], tuple[DataFrame, ...]], read: Callable[..., DataFrame]) -> DataFrame:
    """What read gives of the tables, stored, if none of them changed until it was there; else an error, as the result may mix two states.

    opened opens the tables; it is called before and after, so files that were replaced are seen.
    """
    tables = opened()
    before = fingerprint(*tables)
    found = stored(read(*tables), "read")
    if fingerprint(*opened()) != before:
        raise RuntimeError("snapshot_changed: a table was written while it was read")
    return found
