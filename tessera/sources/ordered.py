"""Tables in order of a key, for searches by prefix and for pages: rows are range-partitioned and sorted, and an index holds
the least and the greatest key of each file, so that a search or a page opens the files that can hold it and no others.

A page begins after the last key of the one before, not at a number of rows: the hundredth costs as much as the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file.
ROWS = 1_000_000
#: After every string that begins with what it follows.
LAST = "\U0010ffff"


class OrderedTable:
    """A folder of rows ordered by `key`, columns that are unique together; ascending, and without nulls."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: list[str], rows_per_file: int = ROWS) -> OrderedTable:
        """Rows with a null in their key are left out. An empty table has an index without rows."""
        out = cls(rows.sparkSession, path, key)
        for c in key:
            rows = rows.where(F.col(c).isNotNull())
        files = max(1, -(-rows.count() // rows_per_file))
        rows.repartitionByRange(files, *key).sortWithinPartitions(*key).write.mode("overwrite").parquet(f"{path}/rows")
        of = F.struct(*key)
        index = out.rows().groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(of).alias("least"), F.max(of).alias("greatest"), F.count("*").alias("n"))
        index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
        return out

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _read(self, reached: Column, wanted: Column, limit: int) -> DataFrame:
        """The first rows that are wanted, from files whose greatest key has reached what is asked for.

        Each file but the first, which may begin before, counts with all its rows: at most limit + 1 files are looked up.
        """
        found = self.spark.read.parquet(f"{self.path}/index").where(reached).orderBy("least").limit(limit + 1).collect()
        taken, rows = [], 0
        for k, f in enumerate(found):
            if k > 1 and rows >= limit:
                break
            taken.append(f.file)
            rows += f.n if k else 0
        if not taken:
            return self.rows().limit(0)
        return self.spark.read.schema(self.rows().schema).parquet(*taken).where(wanted).orderBy(*self.key).limit(limit)

    def page(self, limit: int, after: tuple | None = None) -> DataFrame:
        """The first rows, or those after a key: that of the last row of the page before."""
        if after is None:
            return self._read(F.lit(True), F.lit(True), limit)
        last = F.struct(*[F.lit(v).alias(c) for c, v in zip(self.key, after)])
        return self._read(F.col("greatest") > last, F.struct(*self.key) > last, limit)

    def search(self, prefix: str, limit: int, after: tuple | None = None) -> DataFrame:
        """Rows whose first key column begins with prefix, in order; those after a key, if one is given."""
        first, greatest, least = F.col(self.key[0]), F.col("greatest")[self.key[0]], F.col("least")[self.key[0]]
        reached, wanted = (greatest >= prefix) & (least <= prefix + LAST), first.startswith(prefix)
        if after is not None:
            last = F.struct(*[F.lit(v).alias(c) for c, v in zip(self.key, after)])
            reached, wanted = reached & (F.col("greatest") > last), wanted & (F.struct(*self.key) > last)
        return self._read(reached, wanted, limit)
