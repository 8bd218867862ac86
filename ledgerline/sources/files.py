"""Files and records as tables: exports with a header somewhere, lineage read off writes, provenance against artifacts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.sources.panels import ALIASES, refuse, settled

# -- exports ------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the non-empty lines of every file, numbered from the top of their piece of the file."""
    at = F.struct(F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("row")).alias("line")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at, F.col("value").alias("text")).where("trim(text) != ''")


def _name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def read_exports(spark: SparkSession, path: str, delimiter: str = ",", dates: Sequence[str] = ALIASES["date"], search: int = 40) -> DataFrame:
    """(file, series_id, date, value) of wide exports whose header stands on different lines.

    In each file the header is the first of the first ``search`` lines that has two cells or more,
    one of them a spelling of the date; files without one are refused.  Lines after it are rows: a
    cell belongs to the header's cell in its place, names have single spaces, cells that are no
    number are null, and of equal dates the last line counts.  Cells hold no delimiter; the scan is
    split like any text, only a file's first lines are numbered.
    """
    lines = _lines(spark, path)
    top = Window.partitionBy("file").orderBy("line")
    first = lines.where("line.piece = 0").withColumn("n", F.row_number().over(top)).where(F.col("n") <= search)
    cells = F.transform(F.split("text", delimiter, -1), _name)
    is_date = lambda c: F.regexp_replace(F.lower(c), "[ _-]+", "_").isin(*dates)
    marked = first.withColumn("cells", cells).where((F.size("cells") > 1) & F.exists("cells", is_date))
    header = marked.groupBy("file").agg(F.min_by(F.struct("line", "cells"), "line").alias("h")).select("file", F.col("h.line").alias("at"), F.col("h.cells").alias("names"))
    refuse(lines.select("file").distinct().join(header, "file", "left_anti"), "exports without a header line")
    rows = lines.join(header, "file").where(F.col("line") > F.col("at")).withColumn("cells", F.transform(F.split("text", delimiter, -1), lambda c: F.trim(c)))
    place = F.array_position(F.transform("names", is_date), True).cast("int")
    rows = rows.withColumn("date", F.to_date(F.try_to_timestamp(F.try_element_at("cells", place)))).where("date is not null")
    long = rows.select("file", "line", "date", place.alias("place"), F.posexplode(F.arrays_zip("names", "cells")).alias("i", "c")).where((F.col("i") + 1 != F.col("place")) & (F.coalesce("c.names", F.lit("")) != ""))
    last = Window.partitionBy("file", "c.names", "date").orderBy(F.desc("line"))
    kept = long.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return kept.select("file", F.col("c.names").alias("series_id"), "date", F.expr("try_cast(c.cells as double)").alias("value"))


# -- lineage ------------------------------------------------------------------------------


class Lineage:
    """Rows before and after named steps, counted by the job that writes the result and by no other.

    ``steps = Lineage(); a = steps.start(panel); b = steps.step("members only", a.where(...))``, then
    one write of what follows from b, then ``steps.record()``.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def start(self, df: DataFrame) -> DataFrame:
        return self.step("start", df)

    def step(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        self._seen.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def record(self) -> list[dict]:
        """The steps after the start, in order; asks for a result that has been written."""
        rows = [seen.get["rows"] for _, seen in self._seen]
        return [{"step": name, "rows_before": before, "rows_after": after} for (name, _), before, after in zip(self._seen[1:], rows[:-1], rows[1:], strict=True)]


# -- records ------------------------------------------------------------------------------

RECORD = "record_id string, stage string, produced_by string, operator string, created_utc string, artifacts array<struct<path: string, sha256: string>>, scores map<string,double>"


def write_records(records: DataFrame, path: str) -> None:
    """Append provenance records as JSON lines; each needs an operator, scores that are no finite number become null."""
    refuse(records.where("coalesce(trim(operator), '') = ''"), "records without an operator")
    finite = F.transform_values("scores", lambda _, v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
    records.withColumn("scores", finite).select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """The records of JSON lines with ``broken``: the text of lines that cannot be read as one, or lack what a record has to have."""
    fields = f"{schema}, _broken string"
    parsed = spark.read.text(path).select("value", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    whole = F.col("r._broken").isNull() & F.col("r.stage").isNotNull() & F.col("r.produced_by").isNotNull() & F.col("r.operator").isNotNull()
    names = [c for c in spark.createDataFrame([], schema).columns]
    return parsed.select(*[F.when(whole, F.col(f"r.{c}")).alias(c) for c in names], F.when(~F.coalesce(whole, F.lit(False)), F.col("value")).alias("broken"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below ``path``, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


def stale_records(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(record_id, created_utc, path, state) of what whole records state against ``artifacts(path, sha256)`` as they are now.

    ``state`` is unchanged, changed or missing; a record is stale where one of its artifacts is not unchanged.
    """
    stated = records.where("broken is null").select("record_id", "created_utc", F.explode("artifacts").alias("a")).select("record_id", "created_utc", F.col("a.path").alias("path"), F.col("a.sha256").alias("stated"))
    both = stated.join(artifacts.select("path", "sha256"), "path", "left")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("stated"), "unchanged").otherwise("changed")
    return both.select("record_id", "created_utc", "path", state.alias("state"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, for files that a query writes and reads."""
    settled(spark.range(1))  # names the folder where none is set and the session is local
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
