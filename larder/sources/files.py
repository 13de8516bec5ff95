"""File sources and table contracts (ops A1-A4, A6-A8, A10, A11).

Reader option names live in one place (the lab's planted ``headers`` typo is
silently ignored by Spark, so they must be right here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT_COL = "_rescued_data"


def csv_options(header: bool = True) -> dict[str, str]:
    return {"header": "true" if header else "false", "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": CORRUPT_COL, "enforceSchema": "false"}


def all_string_schema(columns: list[str], rescued: bool = False) -> StructType:
    """Bronze schema: every field text, never inferred (A1)."""
    fields = [StructField(c, StringType(), True) for c in columns]
    if rescued:
        fields.append(StructField(CORRUPT_COL, StringType(), True))
    return StructType(fields)


def read_csv_dir(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV folder scan with a declared schema (A1, A2).

    With a ``_rescued_data`` string field in the schema, rows with too many or
    too few fields, or values that do not parse as the declared type, keep
    their raw text there instead of failing the read (A4).
    """
    return spark.read.schema(schema).options(**csv_options()).csv(path)


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of each CSV file under ``path``.

    A file's first line is the first row of its block at offset 0, which one task reads in
    order; only a line a file is handed on.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.filter("at = 0").select("file", "value", F.monotonically_increasing_id().alias("n"))
    return first.groupBy("file").agg(F.min_by("value", "n").alias("header"))


def read_csv_by_name(spark: SparkSession, path: str, schema: StructType | str, rescued: str = CORRUPT_COL) -> DataFrame:
    """Header CSV folder scan whose columns are matched by each file's own header (A4).

    Files may have the declared columns in any order, lack some (null) or have more.
    ``rescued`` is a VARIANT, null where nothing was rescued: an object of the fields that
    aren't declared, of values that don't parse as their declared type (the column itself is
    null), of ``_line`` where a line has too many or too few fields, and of ``_file_path``.

    Names match without regard to case.  A header's empty or repeated names become ``_c0``,
    ``_c1``, ... by their places.  Files of one header are read together; the headers, a few
    layouts, and the files' names, which any scan lists, reach the driver.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = [f for f in schema.fields if f.name != rescued]
    layouts = csv_headers(spark, path).groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    out = spark.createDataFrame([], StructType(wanted)).withColumn(rescued, F.lit(None).cast("variant"))
    for header, files in layouts:
        parsed = spark.range(1).select(F.from_csv(F.lit(header or ""), ", ".join(f"c{i} STRING" for i in range((header or "").count(",") + 1))).alias("h")).first().h
        names, seen = [], set()
        for i, name in enumerate(parsed):
            name = (name or "").strip().lstrip("\ufeff")
            names.append(f"_c{i}" if not name or name.lower() in seen else name)
            seen.add(names[-1].lower())
        while len(names) > 1 and names[-1] == f"_c{len(names) - 1}" and parsed[len(names) - 1] is None:
            names.pop()  # a comma within quotes was counted as well
        line = "__line"
        raw = spark.read.schema(all_string_schema([*names, line])).options(**csv_options() | {"columnNameOfCorruptRecord": line, "enforceSchema": "true"}).csv(sorted(files))
        own = {n.lower(): n for n in names}
        text = {f.name: F.col(f"`{own[f.name.lower()]}`") for f in wanted if f.name.lower() in own}
        parsed_as = {n: text[n].try_cast(schema[n].dataType) for n in text}
        declared = {f.name.lower() for f in wanted}
        kept = {n: F.col(f"`{n}`") for n in names if n.lower() not in declared}
        kept |= {n: F.when(parsed_as[n].isNull(), text[n]) for n in text}
        kept["_line"] = F.col(line)
        pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n), v.alias("v")) for n, v in kept.items()]), lambda e: e["v"].isNotNull()))
        whole = F.map_concat(pairs, F.create_map(F.lit("_file_path"), F.col("_metadata.file_path")))
        cells = [(parsed_as[f.name] if f.name in text else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
        out = out.union(raw.select(*cells, F.when(F.size(pairs) > 0, F.parse_json(F.to_json(whole))).alias(rescued)))
    return out


def stream_csv_dir(spark: SparkSession, path: str, schema: StructType | str,
                   max_files: int | None = None) -> DataFrame:
    """Incremental CSV scan: each new file is read once."""
    r = spark.readStream.schema(schema).options(**csv_options())
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.csv(path)


def list_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Listing of binary documents without loading their bytes (A10)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(path))
    return df.select("path", "length", "modificationTime")


def overwrite_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    """Managed-table overwrite sink (A6, A7: create-or-replace from a query)."""
    w = df.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Append a query result to an existing typed table, by column name."""
    target = df.sparkSession.table(name).columns
    df.select(*target).write.mode("append").insertInto(name)


def manifest(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, files and bytes of each table.

    Row counts are answered from Parquet footers; files and bytes come from
    the hidden ``_metadata`` column, aggregated per file first.
    """
    out = None
    for name, df in tables.items():
        files = (df.select(F.col("_metadata.file_path").alias("f"),
                           F.col("_metadata.file_size").alias("sz"))
                 .groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("sz").alias("sz")))
        one = files.agg(F.sum("n").cast("bigint").alias("n_rows"),
                        F.count(F.lit(1)).cast("bigint").alias("n_files"),
                        F.sum("sz").cast("bigint").alias("size_bytes"))
        one = one.select(F.lit(name).alias("table_name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                         F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                         "n_files", "size_bytes")
        out = one if out is None else out.unionByName(one)
    return out


def schema_diff(actual: StructType, contract: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """Fields whose type differs from the contract (name, expected, actual).

    ``contract`` is (name, simpleString type) pairs, as exported next to a table.
    """
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    diffs = []
    for name, typ in contract:
        if have.get(name) != typ:
            diffs.append((name, typ, have.get(name, "missing")))
    extra = set(have) - {n for n, _ in contract}
    diffs.extend((n, "absent", have[n]) for n in sorted(extra))
    return diffs
