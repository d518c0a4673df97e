"""Files and databases: readers, writers, splitting, encodings, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spec import as_list, ident
from millrace.operators.windows import number
from millrace.sources import ranges

RUN_ID = "run_id"


# fixed values: encodings Spark's text formats accept without a further setting
STANDARD = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def _allow(spark: SparkSession, encoding: str) -> None:
    """Other encodings, such as windows-31j, have to be switched on in the session."""
    if encoding.lower() not in STANDARD:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path, schema=None, header: bool = True, encoding: str = "UTF-8", sep: str = ",", line_sep: str | None = None,
             multi_line: bool = False) -> DataFrame:
    """A CSV table; an empty cell is NULL. Without a schema every column is text, so no inference pass runs."""
    _allow(spark, encoding)
    reader = spark.read.options(header=header, encoding=encoding, sep=sep, nullValue="", emptyValue="", multiLine=multi_line, escape='"')
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, encoding: str = "UTF-8", sep: str = ",", line_sep: str | None = None, mode: str = "errorifexists") -> None:
    _allow(df.sparkSession, encoding)
    writer = df.write.mode(mode).options(header=header, encoding=encoding, sep=sep, nullValue="", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if line_sep:
        writer = writer.option("lineSep", line_sep)
    writer.csv(path)


def read_tab(spark: SparkSession, path, schema=None, **options) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", **options)


def read_xml(spark: SparkSession, path, row_tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load(spark: SparkSession, path, fmt: str = "csv", **options) -> DataFrame:
    """A stored table; remote folders and buckets are just other URIs (``s3a://``, ``hdfs://``, ``file:``)."""
    return read_csv(spark, path, **options) if fmt == "csv" else spark.read.format(fmt).options(**options).load(path)


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> None:
    if fmt == "csv":
        write_csv(df, path, mode=mode, **options)
    else:
        df.write.format(fmt).mode(mode).options(**options).save(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """A stored source under a name for later SQL."""
    df.createOrReplaceTempView(name)
    return df


def tee(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the table and go on from the written copy, so it is computed once."""
    save(df, path, fmt)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def split_files(df: DataFrame, by, path: str, fmt: str = "parquet", files_per_key: int = 8) -> None:
    """One folder per key value. Rows of a key are spread over a few tasks, so a hot key writes in parallel."""
    keys = as_list(by)
    spread = F.pmod(F.xxhash64(*[ident(c) for c in df.columns]), F.lit(files_per_key))
    df.repartition(*[ident(k) for k in keys], spread).write.format(fmt).partitionBy(*keys).save(path)


def split_files_numbered(df: DataFrame, by, path: str, fmt: str = "parquet") -> DataFrame:
    """One numbered folder per key value; returns the table of numbers and keys."""
    keys = as_list(by)
    numbered = number(df, "part", keys, groups=True)
    split_files(numbered, "part", path, fmt)
    return numbered.select("part", *[ident(k) for k in keys]).distinct()


def spread_files(df: DataFrame, n: int, path: str, by=None, fmt: str = "parquet") -> None:
    """Spread rows over n folders by a hash of the key, or of the whole row."""
    cols = as_list(by) or df.columns
    part = F.pmod(F.xxhash64(*[ident(c) for c in cols]), F.lit(n))
    split_files(df.withColumn("part", part), "part", path, fmt)


def read_database(spark: SparkSession, url: str, table: str, column: str | None = None, lower=None, upper=None, partitions: int = 64,
                  run: str | None = None, **options) -> DataFrame:
    """A database table over JDBC, read in parallel over the ranges of a numeric or date column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    df = reader.load()
    return df.filter(F.col(RUN_ID) == run) if run is not None else df


def write_database(df: DataFrame, url: str, table: str, run: str, batch: int = 10_000, partitions: int | None = None, **options) -> None:
    """Append rows with the run's id; the table is created with typed columns if missing.

    A task that is run again may insert its batch twice: readers select by run id, and a
    failed run is removed by it.
    """
    out = df.withColumn(RUN_ID, F.lit(run))
    out = out.coalesce(partitions) if partitions else out
    out.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode("append").save()


def convert_encoding(spark: SparkSession, source: str, target: str, source_encoding: str, target_encoding: str,
                     source_line_sep: str | None = None, target_line_sep: str = "\n", schema=None) -> None:
    """Rewrite CSV files in another encoding and newline; bad characters are replaced."""
    df = read_csv(spark, source, schema, encoding=source_encoding, line_sep=source_line_sep)
    write_csv(df, target, encoding=target_encoding, line_sep=target_line_sep)


# fixed values: encodings tried in this order
ENCODINGS = ("utf-8", "cp932", "euc_jp", "iso2022_jp")
HEAD_BYTES = 100_000


def _guess(data: bytes) -> tuple[str, str]:
    newline = "CRLF" if b"\r\n" in data else "CR" if b"\r" in data else "LF"
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig", newline
    if b"\x1b$" in data:
        return "iso2022_jp", newline
    for name in ENCODINGS:
        for cut in range(4):  # the sample may end inside a character
            try:
                data[: len(data) - cut].decode(name)
                return name, newline
            except UnicodeDecodeError:
                continue
    return "unknown", newline


def detect_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Encoding and newline of each file, from its first 100 KB."""
    heads = ranges.heads(spark, path, HEAD_BYTES)

    def guess(batches):
        for pdf in batches:
            found = [_guess(bytes(h)) for h in pdf["head"]]
            yield pdf[["path"]].assign(encoding=[f[0] for f in found], newline=[f[1] for f in found])

    return heads.mapInPandas(guess, "path string, encoding string, newline string")


def check_csv(spark: SparkSession, path, schema: T.StructType, **options) -> DataFrame:
    """Rows and malformed rows per file."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.schema(full).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", **options).csv(path)
    # the hash makes the reader parse every column, so every kind of bad row shows
    one = F.pmod(F.hash(*[ident(f.name) for f in schema.fields]), F.lit(1)) + 1
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum(one).alias("rows"), F.count("_bad").alias("bad_rows"))
