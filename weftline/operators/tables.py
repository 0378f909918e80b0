"""Tables on Parquet files that change by whole commits: snapshots of buckets, and keyed tables with upserts.

A table is a folder with data and manifests. A manifest names the files of every bucket; the one with the highest
number is the table. Writers put new files beside the old ones and then publish the next manifest under a name that
must not exist yet, which is the only step that readers can see: a crash before it changes nothing, and of two
writers of one version the second fails. Paths are Hadoop's, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Snapshots:
    """Buckets of rows at ``path``, replaced by commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def _manifest(self) -> dict:
        n = self.version()
        if not n:
            return {"buckets": {}, "schema": None, "note": {}}
        stream = self._fs.open(self._at(f"manifests/{n:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def note(self) -> dict:
        return self._manifest()["note"]

    def buckets(self) -> list[int]:
        return sorted(map(int, self._manifest()["buckets"]))

    def files(self) -> dict[int, list[str]]:
        """The folders of each bucket, relative to the table."""
        return {int(b): f for b, f in self._manifest()["buckets"].items()}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        m = self._manifest()
        if m["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        folders = [f"{self.path}/{f}" for b, fs in m["buckets"].items() if buckets is None or int(b) in buckets for f in fs]
        reader = self.spark.read.schema(m["schema"])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], m["schema"])

    def _publish(self, n: int, manifest: dict) -> None:
        draft = self._at(f"manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if self._fs.exists(self._at(f"manifests/{n:012d}.json")) or not self._fs.rename(draft, self._at(f"manifests/{n:012d}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {n} of {self.path} has another writer")

    def commit(self, buckets: dict[int, DataFrame], note: dict | None = None, append: bool = False) -> int:
        """Replace (or with ``append`` extend) buckets by these rows, one write each, and return the new version."""
        base, m = self.version(), self._manifest()
        written = {}
        for b, rows in buckets.items():
            folder = f"data/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            written[b] = [folder]
            m["schema"] = m["schema"] or rows._jdf.schema().toDDL()
        return self._swap(base, m, written, note, append)

    def commit_split(self, rows: DataFrame, bucket: str, note: dict | None = None, append: bool = False, replaces: list[int] | None = None, order: list[str] | None = None) -> int:
        """As ``commit``, for rows that tell their bucket: one write for all. ``replaces``: buckets that become empty if no row is theirs; ``order``: of the rows in a file."""
        base, m = self.version(), self._manifest()
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.repartition(bucket)
        (dealt.sortWithinPartitions(bucket, *order) if order else dealt).write.partitionBy(bucket).parquet(f"{self.path}/{folder}")
        m["schema"] = m["schema"] or rows.drop(bucket)._jdf.schema().toDDL()
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(folder))]
        written = {int(n.split("=")[1]): [f"{folder}/{n}"] for n in names if n.startswith(f"{bucket}=")}
        return self._swap(base, m, {b: [] for b in replaces or []} | written, note, append)

    def _swap(self, base: int, m: dict, written: dict[int, list[str]], note: dict | None, append: bool) -> int:
        for b, folders in written.items():
            m["buckets"][str(b)] = (m["buckets"].get(str(b), []) if append else []) + folders
        m["buckets"] = {b: f for b, f in m["buckets"].items() if f}
        m["note"] = m["note"] if note is None else note
        self._publish(base + 1, m)
        return base + 1

    def vacuum(self) -> int:
        """Delete data that the last version doesn't use, and older manifests; returns how many folders went. Not beside writers or readers of older versions."""
        used = {f for fs in self.files().values() for f in fs}
        inside = lambda folder: [f.getPath() for f in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []
        old = []
        for p in inside("data"):
            name = f"data/{p.getName()}"
            if name in used:
                continue
            rest = [c for c in inside(name) if "=" in c.getName() and f"{name}/{c.getName()}" not in used]  # a write's buckets may have been replaced one by one
            old += rest if any(u.startswith(f"{name}/") for u in used) else [p]
        keep = f"{self.version():012d}.json"
        for p in [*old, *(p for p in inside("manifests") if p.getName() != keep)]:
            self._fs.delete(p, True)
        return len(old)


class KeyedTable:
    """One row a key, in ``n`` buckets by the key's hash; an upsert rewrites the buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], n: int = 64):
        self.store, self.keys, self.n = Snapshots(spark, path), keys, n

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def read(self) -> DataFrame:
        return self.store.read()

    def get(self, **key) -> DataFrame:
        """The row of a key: one bucket is read."""
        one = self.store.spark.range(1).select(*[F.lit(key[k]).cast(self.store.read([]).schema[k].dataType).alias(k) for k in self.keys])
        bucket = one.select(self._bucket().alias("b")).first()["b"]
        return reduce(lambda d, k: d.where(F.col(k).eqNullSafe(F.lit(key[k]))), self.keys, self.store.read([bucket]))

    def upsert(self, rows: DataFrame, update: dict[str, str] | None = None) -> int:
        """Insert rows of new keys; of a key that is there, set the columns of ``update`` (SQL over ``old`` and ``new``), or all columns.

        ``rows`` have one row a key, as an upsert by SQL demands: a repeated key raises an error before anything is
        written. Keys may be null and are then keys like others. An empty table of rows changes nothing. Returns the version.
        """
        new = rows.withColumn("at_bucket", self._bucket())
        load = new.groupBy("at_bucket").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*self.keys)).alias("keys")).collect()  # a row a bucket
        if any(r["n"] != r["keys"] for r in load):
            raise ValueError(f"two rows of one key {self.keys}")
        touched = sorted(r["at_bucket"] for r in load)
        if not touched:
            return self.store.version()
        if not self.store.version():
            return self.store.commit_split(new, "at_bucket")
        old = self.store.read(touched)
        columns = old.columns
        same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys])
        o, n = old.select(F.struct(*columns).alias("old"), *[F.col(k) for k in self.keys]).alias("o"), new.select(F.struct(*columns).alias("new"), *self.keys).alias("n")
        both = o.join(n, same, "full_outer").select("old", "new")
        update = {c: f"new.{c}" for c in columns} if update is None else update
        value = lambda c: F.expr(update[c]) if c in update else F.col(f"old.{c}")
        merged = both.select(*[F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(value(c)).cast(old.schema[c].dataType).alias(c) for c in columns])
        return self.store.commit_split(merged.withColumn("at_bucket", self._bucket()), "at_bucket")


class LogTable:
    """Rows appended under a key (versions of a URL, decisions of a job), in ``n`` buckets by the key's hash, sorted by key inside a file.

    A key's rows lie in one bucket, so a read of one key opens that bucket's files alone, and their row groups'
    least and greatest keys skip the rest. Appends add files; ``compact`` rewrites buckets of many files.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], n: int = 64):
        self.store, self.key, self.order, self.n = Snapshots(spark, path), key, order, n

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def append(self, rows: DataFrame) -> int:
        """One commit: all rows or, after a crash, none."""
        return self.store.commit_split(rows.withColumn("at_bucket", self._bucket()), "at_bucket", append=True, order=[self.key, *self.order])

    def append_versions(self, rows: DataFrame, seq: str, version: str = "version") -> int:
        """``rows`` (key, ``seq``, ...) numbered on from each key's last version, without ``seq``; reads the versions of the buckets that they touch."""
        new = rows.withColumn(version, F.row_number().over(Window.partitionBy(self.key).orderBy(seq)).cast("long"))
        if self.store.version():
            touched = [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
            last = self.store.read(touched).groupBy(self.key).agg(F.max(version).alias("_last"))
            new = new.join(last, self.key, "left").withColumn(version, F.col(version) + F.coalesce("_last", F.lit(0))).drop("_last")
        return self.append(new.drop(seq))

    def read(self) -> DataFrame:
        return self.store.read()

    def of(self, *values) -> DataFrame:
        """The rows of some keys; only their buckets' files are read."""
        kind = self.store.read([]).schema[self.key].dataType
        wanted = self.store.spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(self.key))
        buckets = [r["b"] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]
        return self.store.read(buckets).where(F.col(self.key).isin(*values))

    def page(self, value, limit: int = 20, offset: int = 0) -> DataFrame:
        """A key's newest rows first."""
        return self.of(value).orderBy(*[F.desc(c) for c in self.order]).offset(offset).limit(limit)

    def compact(self, files: int = 8) -> int:
        """Rewrite the buckets of more than ``files`` folders as one sorted folder each."""
        many = [b for b, f in self.store.files().items() if len(f) > files]
        if not many:
            return self.store.version()
        return self.store.commit_split(self.store.read(many).withColumn("at_bucket", self._bucket()), "at_bucket", replaces=many, order=[self.key, *self.order])
