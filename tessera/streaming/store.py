"""The entity graph as tables that grow by deltas.

A batch writes what it adds or changes, and nothing else, as a delta of each table; a manifest then names the files of the
version. Reading merges: of a key's rows the one of the latest delta counts, else that of the base. Tables are dealt into
buckets by key; after some deltas a batch merges them into the base, of which only the buckets with changes are written
again. Readers see the version of one manifest, whatever is written meanwhile.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import tables


@dataclass
class Manifest:
    """Of each table: bucket -> folder of its base rows, and the folders of deltas in order."""

    version: int = -1
    base: dict[str, dict[str, str]] = field(default_factory=lambda: {t: {} for t in GraphStore.SCHEMAS})
    deltas: dict[str, list[str]] = field(default_factory=lambda: {t: [] for t in GraphStore.SCHEMAS})


class GraphStore:
    """The graph's three tables in a shared folder, by versions. A version that is recorded already is left as it is."""

    SCHEMAS = {
        "entities": "entity_id string, canonical string, type string, first_seen timestamp, last_seen timestamp, document_count int",
        "occurrences": "entity_id string, document_id string, original string, alias string, confirmed boolean",
        "documents": "document_id string, label string, processed_at timestamp, entity_count int, fingerprint string",
    }
    KEYS = {"entities": ["entity_id"], "occurrences": ["entity_id", "document_id"], "documents": ["document_id"]}
    #: What rows are dealt by: what recording looks them up by.
    DEALT = {"entities": "canonical", "occurrences": "entity_id", "documents": "document_id"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most_deltas: int = 8):
        """buckets can't change later; most_deltas is how many a table gets before they are merged."""
        self.spark, self.path, self.buckets, self.most_deltas = spark, path, buckets, most_deltas

    # Files ------------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        """The versions that are complete: manifests are written last."""
        names = [n for n in self._names("manifests") if n[0] == "v" and n[1:].isdigit()]
        return sorted(int(n[1:]) for n in names if "_SUCCESS" in self._names(f"manifests/{n}"))

    def manifest(self, before: int | None = None) -> Manifest:
        """That of the latest version, or of the latest before one."""
        found = [v for v in self.versions() if before is None or v < before]
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/v{found[-1]}").first()[0])) if found else Manifest()

    def _commit(self, manifest: Manifest) -> None:
        rows = self.spark.createDataFrame([(json.dumps(manifest.__dict__),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/v{manifest.version}")

    # Reading ----------------------------------------------------------------------------------------------------------

    def bucket_of(self, name: str) -> Column:
        return F.pmod(F.xxhash64(self.DEALT[name]), F.lit(self.buckets)).cast("int")

    def table(self, name: str, manifest: Manifest, of: list[int] | None = None) -> DataFrame:
        """A table as of a manifest; `of` are the buckets to read, all if None."""
        schema, key = self.SCHEMAS[name], self.KEYS[name]
        folders = [at for b, at in manifest.base[name].items() if of is None or int(b) in of]
        empty = self.spark.createDataFrame([], schema)
        base = self.spark.read.schema(schema).parquet(*folders) if folders else empty
        if not manifest.deltas[name]:
            return base
        changed = self.spark.read.schema(f"{schema}, version long").parquet(*manifest.deltas[name])
        if of is not None:
            changed = changed.where(self.bucket_of(name).isin(of))
        columns = empty.columns
        rest = [c for c in columns if c not in key]
        newest = changed.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("row"))
        newest = newest.select(*[F.col(c) if c in key else F.col("row")[c].alias(c) for c in columns])
        return graph.upserted(base, newest, key) if folders else newest

    def read(self, before: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        manifest = self.manifest(before)
        return tuple(self.table(name, manifest) for name in self.SCHEMAS)

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that rows with its dealing column fall into."""
        return sorted(r[0] for r in rows.select(self.bucket_of(name).alias("bucket")).distinct().collect())

    def entities_named(self, texts: DataFrame) -> DataFrame:
        """The entities of canonical texts (column canonical), from the buckets that may hold them."""
        known = self.table("entities", self.manifest(), self.touched("entities", texts))
        return known.join(texts.select("canonical").distinct(), "canonical", "left_semi")

    # Writing ----------------------------------------------------------------------------------------------------------

    def record(self, version: int, new: DataFrame, found: DataFrame) -> None:
        """Records documents as a version. new and found are those of graph.recorded().

        Read are the buckets of entities and occurrences that the batch touches, all of entities if ids are given.
        """
        if version in self.versions():
            return
        manifest = self.manifest(before=version)
        given = "known_id" in found.columns
        named = tables.written(graph.with_canonical(found), "named")
        entities = self.table("entities", manifest, None if given else self.touched("entities", named))
        in_documents = tables.written(graph.resolved(entities, new, named), "found")
        occurrences = self.table("occurrences", manifest, self.touched("occurrences", in_documents))
        changes = graph.changes(entities, occurrences, new, in_documents)
        manifest.version = version
        for name, rows in zip(self.SCHEMAS, changes):
            folder = f"{self.path}/{name}/delta-{version}"
            rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("compression", "zstd").parquet(folder)
            manifest.deltas[name] = [*manifest.deltas[name], folder]
        for name in self.SCHEMAS:
            if len(manifest.deltas[name]) > self.most_deltas:
                self._merge(name, manifest)
        self._commit(manifest)
        tables.removed(named, in_documents)

    def _merge(self, name: str, manifest: Manifest) -> None:
        """Writes the buckets that deltas have changed anew; the others stay where they are."""
        changed = self.spark.read.schema(f"{self.SCHEMAS[name]}, version long").parquet(*manifest.deltas[name])
        touched = self.touched(name, changed)
        if touched:
            folder = f"{self.path}/{name}/base-{manifest.version}"
            rows = self.table(name, manifest, touched).withColumn("bucket", self.bucket_of(name))
            rows.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
            there = {n.partition("=")[2] for n in self._names(f"{name}/base-{manifest.version}") if n.startswith("bucket=")}
            manifest.base[name] = manifest.base[name] | {b: f"{folder}/bucket={b}" for b in there}
        manifest.deltas[name] = []

    def expire(self, keep: int = 2) -> int:
        """Removes all but the latest versions and the files that none of those needs; returns how many folders went.

        Must not run beside a batch, nor while older versions are read.
        """
        versions, gone = self.versions(), 0
        if not versions:
            return 0
        needed: set[str] = set()
        for v in versions[-keep:]:
            m = self.manifest(before=v + 1)
            for name in self.SCHEMAS:
                needed |= set(m.deltas[name]) | set(m.base[name].values())
        old = [f"{self.path}/manifests/v{v}" for v in versions[:-keep]]
        for name in self.SCHEMAS:
            for folder in self._names(name):
                at = f"{self.path}/{name}/{folder}"
                if folder.startswith("delta-"):
                    old += [] if at in needed else [at]
                else:
                    old += [f"{at}/{b}" for b in self._names(f"{name}/{folder}") if b.startswith("bucket=") and f"{at}/{b}" not in needed]
        for path in old:
            fs, at = self._fs(path)
            gone += bool(fs.delete(at, True))
        return gone
