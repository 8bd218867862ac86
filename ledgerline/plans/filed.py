"""Registered queries that write files of derived tables and read them back: exports, records, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.plans import tables as t
from ledgerline.plans.queries import query, r6
from ledgerline.sources import files, panels


@query("""SELECT substr(p_brand, 1, 7) AS file, p_brand AS series_id, DATE '2020-01-01' + p_size::INT AS date, round(max(p_retailprice) * 100)::BIGINT AS cents FROM part WHERE p_size <= 28 GROUP BY ALL""", days=("date",))
def exported_prices(spark, sf_dir):
    """Brands' prices by day as exports, one a manufacturer, with headers behind different numbers of title lines, read back in one scan."""
    part = t.table(spark, sf_dir, "part").where("p_size <= 28")
    maker = F.substring("p_brand", 7, 1).cast("int")
    priced = part.groupBy(maker.alias("maker"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")).alias("date"), "p_brand").agg(F.max("p_retailprice").alias("v"))
    names = {m: [f"Brand#{i}" for i in range(1, 100) if str(i)[0] == str(m)] for m in range(1, 10)}  # the stated columns of the exports
    wide = priced.groupBy("maker", "date").pivot("p_brand", [n for m in names for n in names[m]]).agg(F.first("v"))
    own = lambda m: F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("n/a")) for n in names[m]])
    line = F.coalesce(*[F.when(F.col("maker") == m, own(m)) for m in names])
    titles = lambda m: [*[f"prices of maker {m}, part {k}" for k in range(m)], f" As_Of ,{','.join(f'  {n}' for n in names[m])}"]
    heads = spark.createDataFrame([(m, k, x) for m in names for k, x in enumerate(titles(m))], "maker int, k int, text string")
    body = wide.select("maker", (F.unix_date("date") + 100).alias("k"), line.alias("text"))
    path = files.scratch_folder(spark, "exports")
    whole = heads.unionByName(body).repartition("maker").sortWithinPartitions("maker", "k").select("maker", "text")
    whole.write.partitionBy("maker").text(path)
    back = files.read_exports(spark, path).where("value is not null")
    name = F.concat(F.lit("Brand#"), F.regexp_extract("file", r"maker=(\d)", 1))
    return back.select(name.alias("file"), "series_id", "date", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS record_id, s_name AS path FROM supplier WHERE s_suppkey % 10 < 7),
    now AS (SELECT s_name AS path, s_suppkey AS k FROM supplier WHERE s_suppkey % 4 > 0)
    SELECT record_id, path, CASE WHEN path NOT IN (SELECT path FROM now) THEN 'missing' WHEN k % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM s""")
def stale_records(spark, sf_dir):
    """Suppliers as artifacts and records of how they were when they were used; broken lines stand among the records."""
    k = F.col("s_suppkey")
    supplier = t.table(spark, sf_dir, "supplier")
    digest = lambda salt: F.sha2(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string"), salt), 256)
    now = supplier.where(k % 4 > 0).select(F.col("s_name").alias("path"), digest(F.lit("")).alias("sha256"))
    records = supplier.where(k % 10 < 7).select(
        k.cast("string").alias("record_id"), F.lit("ingest").alias("stage"), F.lit("loader").alias("produced_by"), F.lit("desk").alias("operator"), F.lit("2024-01-01").alias("created_utc"),
        F.array(F.struct(F.col("s_name").alias("path"), digest(F.when(k % 3 == 0, "as it was").otherwise("")).alias("sha256"))).alias("artifacts"), F.create_map(F.lit("share"), F.when(k % 2 == 0, float("nan")).otherwise(0.5)).alias("scores"),
    )
    path = files.scratch_folder(spark, "records")
    files.write_records(records, path)
    supplier.where(k % 10 == 8).select(F.concat(F.lit('{"record_id": "'), k.cast("string"), F.lit('", "stage"')).alias("value")).write.mode("append").text(path)
    return files.stale_records(files.read_records(spark, path), now).select("record_id", "path", "state")


@query("""SELECT s_suppkey::VARCHAR AS record_id, CASE WHEN s_suppkey % 10 = 8 THEN 'cut off' WHEN s_suppkey % 10 = 9 THEN 'no operator' ELSE 'whole' END AS kind, CASE WHEN s_suppkey % 10 < 8 AND s_suppkey % 2 = 1 THEN 0.5::DOUBLE END AS share FROM supplier""")
def read_records(spark, sf_dir):
    """Lines of records, whole, cut off and without an operator, told apart; numbers that are not finite come back as null."""
    k = F.col("s_suppkey")
    supplier = t.table(spark, sf_dir, "supplier")
    whole = supplier.where(k % 10 < 8).select(
        k.cast("string").alias("record_id"), F.lit("ingest").alias("stage"), F.lit("loader").alias("produced_by"), F.lit("desk").alias("operator"), F.lit("2024-01-01").alias("created_utc"), F.array().cast("array<struct<path:string,sha256:string>>").alias("artifacts"),
        F.create_map(F.lit("share"), F.when(k % 2 == 0, float("inf")).otherwise(0.5)).alias("scores"),
    )
    path = files.scratch_folder(spark, "records")
    files.write_records(whole, path)
    cut = F.concat(F.lit('{"record_id": "'), k.cast("string"), F.lit('", "stage"'))
    anonymous = F.concat(F.lit('{"record_id": "'), k.cast("string"), F.lit('", "stage": "ingest", "produced_by": "loader"}'))
    supplier.where(k % 10 >= 8).select(F.when(k % 10 == 8, cut).otherwise(anonymous).alias("value")).write.mode("append").text(path)
    got = files.read_records(spark, path)
    kind = F.when(F.col("broken").isNull(), "whole").when(F.col("broken").contains("produced_by"), "no operator").otherwise("cut off")
    return r6(got.select(F.coalesce("record_id", F.regexp_extract("broken", r'"record_id": "(\d+)"', 1)).alias("record_id"), kind.alias("kind"), F.col("scores")["share"].alias("share")))


@query(f"""WITH {t.segment_sql()} SELECT 'building' AS series_id, date, floor(value * 100)::BIGINT AS cents FROM seg WHERE series_id = 'BUILDING'""", days=("date",))
def single_series(spark, sf_dir):
    """One series written as CSV, rows without a date among its rows, read back as a panel."""
    own = t.segment_panel(spark, sf_dir).where("series_id = 'BUILDING'").select(F.date_format("date", "yyyy-MM-dd").alias("Day"), F.floor(F.col("value") * 100).alias("Level"))
    path = files.scratch_folder(spark, "series")
    own.unionByName(own.select(F.lit("n/a").alias("Day"), F.col("Level"))).write.option("header", True).csv(path)
    return panels.read_series(spark, path, "Day", "Level", "building").select("series_id", "date", F.col("value").cast("long").alias("cents"))


@query("""WITH f AS (SELECT n_nationkey AS k, repeat(n_name || ' ', 1 + n_nationkey::INT * 3) AS text FROM nation) SELECT k, length(text) + 1 AS size, sha256(text || chr(10)) AS sha256, length(text) + 1 >= 200 AS accepted FROM f""")
def file_catalogue(spark, sf_dir):
    """Nations as files of different sizes, catalogued with size and digest; small ones are marked."""
    nation = t.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.repeat(F.concat("n_name", F.lit(" ")), (1 + F.col("n_nationkey") * 3).cast("int")).alias("text"))
    path = files.scratch_folder(spark, "catalogue")
    nation.repartition("k").write.partitionBy("k").text(path)
    found = panels.catalogue(spark, [path], "*.txt", least=200)
    return found.select(F.regexp_extract("path", r"k=(\d+)", 1).cast("int").alias("k"), F.col("size"), "sha256", "accepted")
