"""File sources: declared-schema CSV, rescued rows, binary listing, manifest, sinks."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMOKE
from larder.sources import files
from larder.sources.tables import TABLES, table


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_declared_schema_rescues_bad_rows(spark, scratch):
    d = os.path.join(scratch, "competitor")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"),
           "competitor,product_id,price,scrape_ts,event_date\n"
           "C0,P1,1.50,2024-01-01 06:00:00,2024-01-01\n"      # good
           "C1,P1,oops,2024-01-01 06:00:00,2024-01-01\n"      # uncastable price
           "C2,P1,2.00,2024-01-01 06:00:00,2024-01-01,extra\n"  # one field too many
           "C3,P1\n")                                          # short row
    schema = ("competitor STRING, product_id STRING, price DOUBLE, scrape_ts TIMESTAMP_NTZ, "
              "event_date DATE, _rescued_data STRING")
    rows = {r.competitor: r for r in files.read_csv_dir(spark, d, schema).collect()}
    assert rows["C0"]._rescued_data is None and rows["C0"].price == 1.5
    assert rows["C1"]._rescued_data is not None and rows["C1"].price is None
    assert rows["C2"]._rescued_data is not None
    assert rows["C3"]._rescued_data is not None


def test_header_option_is_honoured(spark, scratch):
    d = os.path.join(scratch, "stores")
    os.makedirs(d)
    _write(os.path.join(d, "s.csv"), "store_id,name\nS1,One\n")
    df = files.read_csv_dir(spark, d, files.all_string_schema(["store_id", "name"]))
    assert [r.store_id for r in df.collect()] == ["S1"]


def test_binary_listing(spark, scratch):
    d = os.path.join(scratch, "pdfs")
    os.makedirs(os.path.join(d, "sub"))
    _write(os.path.join(d, "a.pdf"), "%PDF-1.4 x")
    _write(os.path.join(d, "sub", "b.pdf"), "%PDF-1.4 yy")
    _write(os.path.join(d, "c.txt"), "no")
    got = files.list_binary(spark, d).collect()
    assert sorted(os.path.basename(r.path) for r in got) == ["a.pdf", "b.pdf"]
    assert sorted(r.length for r in got) == [10, 11]


def test_manifest_counts_files_and_rows(spark):
    m = files.manifest(spark, {t: table(spark, SF_SMOKE, t) for t in ("region", "lineitem")}).collect()
    by = {r.table_name: r for r in m}
    assert by["region"].n_rows == 5 and by["region"].n_files == 1 and by["region"].size_bytes > 0
    assert by["lineitem"].n_columns == len(table(spark, SF_SMOKE, "lineitem").columns)
    assert set(TABLES) >= set(by)


def test_overwrite_and_append_sinks(spark, scratch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS larder_t LOCATION '{scratch}/db'")
    df = spark.range(3).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b"))
    files.overwrite_table(df, "larder_t.sink")
    files.append_table(df.select("b", "a"), "larder_t.sink")
    assert spark.table("larder_t.sink").count() == 6
    files.overwrite_table(df, "larder_t.sink")
    assert spark.table("larder_t.sink").count() == 3


def test_contracts_of_handed_over_tables(spark):
    from larder.sources import contracts

    assert len(contracts.fields(contracts.TICKETS)) == len(contracts.fields(contracts.OWN_BRAND)) == 26
    good = spark.createDataFrame([], contracts.OWN_BRAND)
    assert contracts.breaches(good, contracts.OWN_BRAND) == []
    bad = good.withColumn("score", good.score.cast("string")).drop("page_number").withColumn("more", good.fdc_id)
    assert contracts.breaches(bad, contracts.OWN_BRAND) == [("score", "double", "string"), ("page_number", "int", "missing"), ("more", "absent", "int")]


def test_scan_by_name_and_medallion_tables(spark, scratch):
    from larder.plans.medallion import write_medallion
    from larder.sources.tables import by_name

    paths = write_medallion(spark, SF_SMOKE, scratch)
    gold = spark.read.parquet(paths["gold"])
    gold.createOrReplaceTempView("gold_by_name")
    assert by_name(spark, "gold_by_name").count() == gold.count() > 0
    assert spark.read.parquet(paths["stores"]).count() == 10


def _csv(folder, **contents):
    os.makedirs(folder, exist_ok=True)
    for name, text in contents.items():
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def _by_name(spark, folder, ddl="id INT, price DOUBLE, day DATE"):
    from pyspark.sql import functions as F

    df = files.read_csv_by_name(spark, folder, ddl)
    rows = df.withColumn("_rescued_data", F.to_json("_rescued_data")).collect()
    out = {}
    for r in rows:
        kept = json.loads(r._rescued_data) if r._rescued_data else None
        if kept:
            kept["_file_path"] = os.path.basename(kept["_file_path"])
        out.setdefault(r.id, []).append((r.price, str(r.day) if r.day else None, kept))
    return df, out


def test_rescued_reordered_and_missing_columns(spark, scratch):
    folder = _csv(f"{scratch}/a", plain="id,price,day\n1,1.5,2024-01-02\n", turned="DAY,id,Price\n2024-01-03,2,2.5\n", short="price,id\n3.5,3\n")
    df, rows = _by_name(spark, folder)
    assert df.columns == ["id", "price", "day", "_rescued_data"] and dict(df.dtypes)["_rescued_data"] == "variant"
    assert rows == {1: [(1.5, "2024-01-02", None)], 2: [(2.5, "2024-01-03", None)], 3: [(3.5, None, None)]}


def test_rescued_extra_columns_and_values_that_do_not_parse(spark, scratch):
    folder = _csv(f"{scratch}/b", more='id,"a, b",price\n1,"x, y",1.0\n2,,2.0\n', bad="day,id,price\nsoon,3,cheap\n2024-01-01,4,\n")
    _, rows = _by_name(spark, folder)
    assert rows[1] == [(1.0, None, {"a, b": "x, y", "_file_path": "more.csv"})] and rows[2] == [(2.0, None, None)]
    assert rows[3] == [(None, None, {"day": "soon", "price": "cheap", "_file_path": "bad.csv"})] and rows[4] == [(None, "2024-01-01", None)]


def test_rescued_lines_of_wrong_length_and_odd_headers(spark, scratch):
    folder = _csv(f"{scratch}/c", long="id,price\n1,1.0,left,over\n2\n", odd="id,,id,price\n5,e,6,5.5\n", empty="", header="id,price,new\n")
    _, rows = _by_name(spark, folder)
    assert rows[1] == [(1.0, None, {"_line": "1,1.0,left,over", "_file_path": "long.csv"})]
    assert rows[2] == [(None, None, {"_line": "2", "_file_path": "long.csv"})]
    assert rows[5] == [(5.5, None, {"_c1": "e", "_c2": "6", "_file_path": "odd.csv"})] and sum(map(len, rows.values())) == 3


def test_rescued_nothing_to_read(spark, scratch):
    folder = _csv(f"{scratch}/d", empty="")
    df, rows = _by_name(spark, folder)
    assert rows == {} and df.columns == ["id", "price", "day", "_rescued_data"]
