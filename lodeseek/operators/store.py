"""A vector store on Parquet: upsert, scoped search, get, count, purge (K1 to K4)."""

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.vectors import DISTANCES
from lodeseek.operators.nearest import all_distances, nearest_many
from lodeseek.session import materialise

__all__ = ["BUCKETS", "ROWS", "ParquetStore", "all_distances", "in_scope", "local_store", "nearest", "nearest_many"]

#: Parts of a namespace: a change rewrites those that it touches.
BUCKETS = 16
ROWS = "ns string, key string, vec array<double>, payload map<string,string>, scope string"


def in_scope(scope: str | None) -> Column:
    """Rows without a scope, or of this one."""
    free = F.col("scope").isNull()
    return free if scope is None else free | (F.col("scope") == scope)


def nearest(rows: DataFrame, vec: list[float], k: int = 6, max_distance: float = 1.0, scope: str | None = None, metric: str = "COSINE", tie: str = "key") -> DataFrame:
    """The k nearest rows in scope within max_distance (K2).

    Sorted and cut first, filtered by distance after: the same rows, but the distance is computed once and
    the plan is a top-k by partition.
    """
    target = F.array(*[F.lit(float(x)) for x in vec])
    near = rows.where(in_scope(scope)).withColumn("distance", DISTANCES[metric](F.col("vec"), target))
    return near.orderBy("distance", tie).limit(k).where(F.col("distance") <= max_distance)


class ParquetStore:
    """Rows of ROWS in a folder, in parts by namespace and hash of the key.

    A version is a list of parts in a file of its own number; the highest number counts. A write makes new
    files for the parts that it changes, and then the next list: until that is there, the version before it
    stays as it is, whatever fails. Parts that the last two versions do not name are removed.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, metric: str = "COSINE", buckets: int = BUCKETS):
        self.spark, self.path, self.dim, self.metric, self.buckets = spark, path.rstrip("/"), dim, metric, buckets

    # Files, through Spark's own file systems

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _listed(self, folder: str) -> list[str]:
        fs, place = self._fs(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []

    def _versions(self) -> list[int]:
        return sorted(int(x) for x in self._listed("versions") if x.isdigit())

    def _parts(self, version: int | None = None) -> dict[str, str]:
        """Folder by part of a version, the last one by default."""
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.path}/versions/{version}").collect()
        return dict(r["value"].split("\t") for r in lines if r["value"])

    def _commit(self, parts: dict[str, str], before: int) -> None:
        fs, place = self._fs(f"{self.path}/versions/{before + 1}")
        draft = self._fs(f"{self.path}/versions/_{uuid.uuid4().hex}")[1]
        out = fs.create(draft, True)
        out.write("".join(f"{k}\t{v}\n" for k, v in sorted(parts.items())).encode() or b"\n")
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise RuntimeError("another writer has changed the store: repeat the change")
        self._tidy()

    def _tidy(self) -> None:
        """Removes versions before the last two, and data that these do not name."""
        versions = self._versions()
        named = {v.rsplit("/", 1)[0] for n in versions[-2:] for v in self._parts(n).values()}
        for n in versions[:-2]:
            fs, place = self._fs(f"{self.path}/versions/{n}")
            fs.delete(place, False)
        for d in self._listed("data"):
            if f"data/{d}" not in named:
                fs, place = self._fs(f"{self.path}/data/{d}")
                fs.delete(place, True)

    # Rows

    def _part(self, ns: Column, key: Column) -> Column:
        """The part of a row: a digest of its namespace, and a bucket of its key."""
        return F.concat_ws("-", F.substring(F.md5(ns), 1, 16), F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("string"))

    def _read(self, folders) -> DataFrame:
        paths = [f"{self.path}/{x}" for x in folders]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def rows(self, ns: str | None = None) -> DataFrame:
        """All rows, or those of a namespace: only its parts are read."""
        parts = self._parts()
        if ns is None:
            return self._read(parts.values())
        begin = hashlib.md5(ns.encode()).hexdigest()[:16] + "-"
        return self._read(v for k, v in parts.items() if k.startswith(begin)).where(F.col("ns") == ns)

    def upsert(self, new: DataFrame) -> None:
        """Replaces rows by (ns, key) (K1). Of repeated keys in new, the last by scope, vector and payload counts. A wrong dimension raises.

        Only parts that have new rows are read and written anew.
        """
        if self.dim is not None and not new.where(F.size("vec") != self.dim).isEmpty():
            raise ValueError(f"vectors need {self.dim} dimensions")
        one = new.select("ns", "key", F.col("vec").cast("array<double>").alias("vec"), "payload", "scope")
        content = F.struct("scope", "vec", F.array_sort(F.map_entries("payload")).alias("entries"))
        one = one.groupBy("ns", "key").agg(F.max_by(F.struct("vec", "payload", "scope"), content).alias("r")).select("ns", "key", "r.*")
        part = self._part(F.col("ns"), F.col("key")).alias("part")
        one = materialise(one.select("*", part), "upsert")
        before = max(self._versions(), default=0)
        parts = self._parts(before)
        touched = [r["part"] for r in one.select("part").distinct().collect()]
        if not touched:
            return
        old = self._read(parts[t] for t in touched if t in parts).join(one.select("ns", "key"), ["ns", "key"], "left_anti")
        folder = f"data/{uuid.uuid4().hex}"
        old.select("ns", "key", "vec", "payload", "scope", part).unionByName(one).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        self._commit(parts | {t: f"{folder}/part={t}" for t in touched}, before)

    def search(self, ns: str, vec: list[float], k: int = 6, max_distance: float = 1.0, scope: str | None = None) -> DataFrame:
        return nearest(self.rows(ns), vec, k, max_distance, scope, self.metric)

    def get(self, ns: str, key: str, scope: str | None = None):
        return self.rows(ns).where(F.col("key") == key).where(in_scope(scope)).first()

    def count(self, ns: str, scope: str | None = None) -> int:
        return self.rows(ns).where(in_scope(scope)).count()

    def purge(self, ns: str) -> int:
        """Removes a namespace, whatever the scopes, and returns how many rows it had."""
        gone = self.rows(ns).count()
        if gone:
            before = max(self._versions(), default=0)
            begin = hashlib.md5(ns.encode()).hexdigest()[:16] + "-"
            self._commit({k: v for k, v in self._parts(before).items() if not k.startswith(begin)}, before)
        return gone

    def all(self, ns: str) -> DataFrame:
        return self.rows(ns)


def local_store(spark: SparkSession, folder: str) -> ParquetStore:
    return ParquetStore(spark, "file://" + os.path.abspath(folder))
