"""Reading and writing tables: CSV and Parquet scans, metric files, history, loads."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.skew import join_on
from faultline.session import scratch_path

READERS = {"csv": {"header": "true"}, "json": {}, "parquet": {}, "orc": {}, "text": {}}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "csv") -> DataFrame:
    """Scan of a file or folder. A schema is required for CSV and JSON, so that no pass over
    the data is spent on guessing it."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"a schema is required to read {fmt}")
    reader = spark.read.format(fmt).options(**READERS[fmt])
    return (reader.schema(schema) if schema is not None else reader).load(path)


def sql_scan(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """SQL over the given DataFrames (named in braces) or directly over files."""
    return spark.sql(statement, **tables)


SERIES_SCHEMA = "timestamp long, value double, label int"


def read_series(spark: SparkSession, glob: str, min_len: int = 50) -> DataFrame:
    """One labelled series per CSV file: family from the folder, series id from the file
    name; incomplete rows and series with fewer than ``min_len`` rows drop."""
    raw = spark.read.schema(SERIES_SCHEMA).option("header", "true").csv(glob)
    path = F.col("_metadata.file_path")
    file = F.substring_index(path, "/", -1)
    named = raw.select(
        F.timestamp_millis("timestamp").alias("ts"),
        "value",
        "label",
        F.substring_index(F.substring_index(path, "/", -2), "/", 1).alias("family"),  # for every row, so no pattern that is tried at each character
        F.when(file.endswith(".csv"), F.substring(file, F.lit(1), F.length(file) - 4)).otherwise("").alias("series_id"),
    ).filter(F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("label").isNotNull())
    return long_enough(named, ["family", "series_id"], min_len)


def long_enough(df: DataFrame, keys: list[str], min_len: int) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_len)
    return join_on(df, sizes, keys, "left_semi")


def stitch_periods(df: DataFrame, name: str, ts: str, value: str) -> DataFrame:
    """Series of one metric over several period files, joined in period order; the first
    period wins on equal times. An aggregate per (metric, time), so no metric is gathered."""
    pattern = r"_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})"
    parts = df.withColumns(
        {"metric": F.regexp_replace(name, pattern, ""), "period": F.regexp_extract(name, pattern, 0)}
    )
    return parts.groupBy("metric", ts).agg(F.min_by(F.struct("period", value), F.struct("period", value)).alias("_first")).select(
        "metric", ts, "_first.period", F.col("_first")[value].alias(value)
    )


def missing_periods(df: DataFrame, metric: str, period: str) -> DataFrame:
    """(metric, period) pairs without data, out of the periods seen anywhere. Periods are
    file-name suffixes: a short list carried to each metric as one array."""
    have = df.select(metric, period).distinct()
    every = have.agg(F.array_sort(F.collect_set(period))).scalar()
    wanted = have.select(metric).distinct().withColumn(period, F.explode(every))
    return wanted.join(have, [metric, period], "left_anti")


def stitch_report(df: DataFrame, stitched: DataFrame, metric: str) -> DataFrame:
    """Rows of every metric before and after stitching."""
    before = df.groupBy(metric).agg(F.count(F.lit(1)).alias("rows_before"))
    after = stitched.groupBy(metric).agg(F.count(F.lit(1)).alias("rows_after"))
    return before.join(after, metric, "left")


def dedup_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of every key in the given order; combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*")


def union_labeled(tables: dict[str, DataFrame], label: str = "label") -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] = ()) -> None:
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


class VersionedTable:
    """A table that is replaced as a whole: every load is a new folder, and a pointer file names the one that readers see. The pointer moves only
    after the load was checked, by one rename; until then, and after a failed check, readers have the old rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def current(self) -> str | None:
        """The folder of the version that readers see."""
        at, files = self._fs("CURRENT")
        return self.spark.read.text(str(at)).first()[0] if files.exists(at) else None

    def rows(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise ValueError(f"{self.path}: nothing was loaded yet")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def load(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
        """Write a new version, compare the rows stored with the rows sent, run ``check`` on what is stored, then move the pointer. Returns the rows."""
        version = f"v-{uuid.uuid4().hex}"
        sent = Observation()
        df.observe(sent, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{version}")
        stored = self.spark.read.schema(df.schema).parquet(f"{self.path}/{version}")
        rows = stored.count()
        try:
            if rows != sent.get["rows"]:
                raise ValueError(f"{self.path}: sent {sent.get['rows']} rows, found {rows}")
            if check is not None:
                check(stored)
        except Exception:
            at, files = self._fs(version)
            files.delete(at, True)
            raise
        draft, files = self._fs(f"draft-{version}")
        out = files.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        modes = self.spark._sc._gateway.new_array(rename, 1)
        modes[0] = rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        context.rename(draft, self._fs("CURRENT")[0], modes)
        return rows

    def vacuum(self) -> None:
        """Delete the versions that are not current; run it when no reader holds an old one."""
        at, files = self._fs()
        current = self.current()
        for status in files.listStatus(at):
            name = status.getPath().getName()
            if name.startswith(("v-", "draft-")) and name != current:
                files.delete(status.getPath(), True)


def load_table(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> int:
    """Replace the versioned table at ``path`` and check that every row arrived."""
    return VersionedTable(df.sparkSession, path).load(df, check)


HISTORY_SCHEMA = (
    "id long, ticket_text string, ticket_type string, priority string, queue string, "
    "confidence double, recommendation string, created_at timestamp_ntz, source string"
)


class History:
    """Stored predictions: Parquet, partitioned by date, append only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, df: DataFrame) -> None:
        self._add(df.withColumn("batch", F.lit(None).cast("string")))

    def _add(self, df: DataFrame) -> None:
        dated = df.withColumn("date", F.to_date("created_at"))
        # One file per date and task: rows of a date are spread over tasks by the row hash.
        dated.write.mode("append").partitionBy("date").parquet(self.path)

    def append_once(self, df: DataFrame, stream: str, batch_id: int) -> bool:
        """Append a batch of a stream unless it is there. The ledger beside the history names the finished batches; a batch that was appended but not yet
        named (the writer was lost between the two) is found by the mark its rows carry. Returns whether rows were appended."""
        mark = f"{stream}/{batch_id}"
        if mark in self._finished(stream):
            return False
        there = self._exists(self.path) and not self._stored().filter(F.col("batch") == mark).isEmpty()
        if not there:
            self._add(df.withColumn("batch", F.lit(mark)))
        self.spark.createDataFrame([(mark,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}_batches/stream={stream}")
        return not there

    def _finished(self, stream: str) -> set[str]:
        """Names of a stream's finished batches: one short row for each."""
        ledger = f"{self.path}_batches/stream={stream}"
        return {r[0] for r in self.spark.read.schema("batch string").parquet(ledger).collect()} if self._exists(ledger) else set()

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(HISTORY_SCHEMA + ", batch string, date date").parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().drop("batch")

    def compact(self, date: str, files: int = 1) -> None:
        """Rewrite a date's many small files as few; the rows are staged first, then replace that date alone."""
        staged = scratch_path(self.spark, "compact")
        self._stored().filter(F.col("date") == F.lit(date).cast("date")).coalesce(files).write.parquet(staged)
        whole = self.spark.read.schema(HISTORY_SCHEMA + ", batch string, date date").parquet(staged)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(self.path)

    def recent(self, n: int = 20) -> DataFrame:
        return self.rows().orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)

    def by_id(self, ident: int) -> DataFrame:
        return self.rows().filter(F.col("id") == ident)

    def purge(self, keep_days: int, today: Column | None = None) -> None:
        """Drop rows older than the limit: expired date folders are removed, only the date
        at the limit is rewritten."""
        limit = self.spark.range(1).select(
            ((F.current_timestamp() if today is None else today).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(keep_days))).alias("t")
        ).first()["t"]
        edge = F.lit(limit.date())
        kept = self._stored().filter((F.col("date") == edge) & (F.col("created_at") >= F.lit(limit).cast("timestamp_ntz")))
        # The kept rows of the edge date are staged, then replace that partition alone.
        staged = scratch_path(self.spark, "history")
        kept.write.parquet(staged)
        stored = self.spark.read.schema(HISTORY_SCHEMA + ", batch string, date date").parquet(staged)
        if not stored.isEmpty():
            stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(self.path)
            edge = edge - F.expr("interval 1 day")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        expired = self.rows().filter(F.col("date") <= edge).select(F.col("date").cast("string")).distinct()
        for row in expired.collect():
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/date={row[0]}"), True)


def latest_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Last n rows of every key; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")

