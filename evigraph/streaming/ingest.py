"""Taking in records once, and putting a new version of a table in place in one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the values of the columns; null and empty, and values that only together read alike, differ."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def taken_in(spark: SparkSession, root: str, schema: str, but: int | None = None) -> DataFrame:
    """All records under root, those of one batch left out if given."""
    done = [b for b in _names(spark, root) if b.startswith("batch=") and b != f"batch={but}" and "_SUCCESS" in _names(spark, f"{root}/{b}")]
    schema = f"{schema}, _hash string"
    return spark.read.schema(schema).parquet(*[f"{root}/{b}" for b in done]) if done else spark.createDataFrame([], schema)


def take_in(batch: DataFrame, batch_id: int, root: str, columns: list[str]) -> None:
    """Write the records of a batch whose content root doesn't hold yet, in a folder of the batch's own.

    A batch that is run again, after a lost driver, replaces its own folder and compares with the others only, so it takes
    in the same records; a folder without its mark of success is of a batch that was lost half way, and counts for nothing.
    """
    spark = batch.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)
    own = batch.withColumn("_hash", content_hash(columns))
    first = own.groupBy("_hash").agg(F.min(F.struct(*batch.columns)).alias("r")).select("r.*", "_hash")
    new = first.join(taken_in(spark, root, schema, but=batch_id).select("_hash"), "_hash", "left_anti")
    new.select(*batch.columns, "_hash").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def ingest(stream: DataFrame, root: str, checkpoint: str, columns: list[str]) -> StreamingQuery:
    """Take in a stream's records until it has no more for now; the same content again changes nothing."""
    return stream.writeStream.foreachBatch(lambda b, i: take_in(b, i, root, columns)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(table: DataFrame, root: str, digest: str) -> str:
    """Make table the current version of root, and give the version's folder; a version with the current digest is left as it is.

    First the table is written aside; then one rename puts the numbered pointer in place, which names folder and digest.
    Readers see the old version until that instant, and the new one whole from then on, whatever is lost in between. Of two
    writers that begin from one version, the later rename fails.
    """
    spark = table.sparkSession
    number, folder, have = _pointer(spark, root)
    if have == digest:
        return f"{root}/{folder}"
    name = f"version-{number + 1:08d}-{digest[:16]}"
    table.write.mode("overwrite").parquet(f"{root}/{name}")
    fs, aside = _fs(spark, f"{root}/pointer-{number + 1:08d}-{digest[:16]}.aside")
    out = fs.create(aside, True)
    out.write(bytearray(f"{name} {digest}".encode()))
    out.close()
    _, there = _fs(spark, f"{root}/pointer-{number + 1:08d}")
    if fs.exists(there) or not fs.rename(aside, there):
        raise RuntimeError(f"another writer has published version {number + 1} of {root}")
    return f"{root}/{name}"


def _pointer(spark: SparkSession, root: str) -> tuple[int, str, str]:
    names = [n for n in _names(spark, root) if n.startswith("pointer-") and n[8:].isdigit()]
    if not names:
        return 0, "", ""
    folder, digest = spark.read.text(f"{root}/{names[-1]}").first()[0].split(" ")
    return int(names[-1][8:]), folder, digest


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version of root."""
    _, folder, _ = _pointer(spark, root)
    if not folder:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{folder}")
