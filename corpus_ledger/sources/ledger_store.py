"""A keyed table kept as one base and the changes since: a batch writes its own rows and nothing else.

A version is a folder ``delta=<version>`` with the new state of the keys it changes, or ``base=<version>`` with
the state of all keys up to it. A reader takes the newest base and the changes after it: keys with changes leave
the base through an anti join against the changed keys (broadcast as long as they are few, so the base is not
shuffled), and the last change of each key is added. When the changes have grown to ``compact_at`` times the
base they are folded into a new one, so rewriting costs each changed row a constant number of writes. Versions
older than the last ``keep`` bases go.

A version is written in overwrite mode under its own number and counts once Spark has marked it complete: a
batch that is repeated after a failure replaces its own rows, and a reader never sees half of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_ledger.functions.joins import broadcast_bounded

# Changed keys up to this many are broadcast when a base is read; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
VERSION = "_version"


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "page_id",
                 compact_at: float = 0.5, keep: int = 2) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.compact_at, self.keep = compact_at, keep

    def _folder(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, kind: str) -> list[int]:
        """Complete versions of ``base`` or ``delta``, ascending."""
        jvm, root, fs = self._folder()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")
                      and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))

    def _parts(self, below: int | None) -> tuple[int | None, list[int]]:
        base = max((v for v in self.versions("base") if below is None or v < below), default=None)
        deltas = [v for v in self.versions("delta") if (base is None or v > base) and (below is None or v < below)]
        return base, deltas

    def _load(self, kind: str, versions: list[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType())])
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}={v}" for v in versions])

    def read(self, below: int | None = None) -> DataFrame:
        """The state of every key, as of all versions, or of those ``below`` a number."""
        base, deltas = self._parts(below)
        stored = self._load("base", [] if base is None else [base]).drop(VERSION)
        if not deltas:
            return stored
        changes = self._load("delta", deltas)
        if len(deltas) == 1:  # a version has one row a key
            last = changes.drop(VERSION)
        else:
            columns = [f.name for f in self.schema.fields if f.name != self.key]
            last = (changes.groupBy(self.key).agg(F.max_by(F.struct(*columns), VERSION).alias("_row"))
                    .select(self.key, "_row.*").select(*self.schema.fieldNames()))
        if base is None:
            return last
        changed = broadcast_bounded(changes.select(self.key).distinct(), BROADCAST_KEYS)
        return stored.join(changed, self.key, "left_anti").select(*self.schema.fieldNames()).unionByName(last)

    def lookup(self, keys: DataFrame, below: int | None = None) -> DataFrame:
        """The state of ``keys`` (one column, the key): few keys leave the stored rows unshuffled."""
        few = broadcast_bounded(keys.select(self.key).distinct(), BROADCAST_KEYS)
        return self.read(below).join(few, self.key, "left_semi").select(*self.schema.fieldNames())

    def commit(self, rows: DataFrame, version: int) -> None:
        """Write the new state of the keys that ``rows`` (one row a key) changes; compact and retire when due."""
        out = rows.select(*self.schema.fieldNames()).withColumn(VERSION, F.lit(version).cast("long"))
        out.write.mode("overwrite").parquet(f"{self.path}/delta={version}")
        base, deltas = self._parts(None)
        # Parquet answers both counts from its footers.
        changed = self._load("delta", deltas).count()
        held = self._load("base", [] if base is None else [base]).count()
        if base is None and len(deltas) > 1 or base is not None and changed > self.compact_at * held:
            self.compact(version)

    def compact(self, version: int) -> None:
        """Fold everything up to ``version`` into a new base, and drop what the last ``keep`` bases do not need."""
        state = self.read(version + 1).withColumn(VERSION, F.lit(version).cast("long"))
        state.write.mode("overwrite").parquet(f"{self.path}/base={version}")
        jvm, root, fs = self._folder()
        kept = self.versions("base")[-self.keep:]
        if len(kept) < self.keep:
            return
        for kind, oldest in (("base", kept[0] - 1), ("delta", kept[0])):
            for v in self.versions(kind):
                if v <= oldest:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"{kind}={v}"), True)
