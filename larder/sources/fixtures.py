"""Entities of the retail / support / chat domain, derived from the source tables.

The domain tables (raw sales, competitor prices, products, stores, tickets,
chats, messages) are not part of the test data, so each one is a Spark
projection of the TPC-H-style tables.  Every derivation is row-local or a
single keyed join/aggregate, so its cost grows linearly with the sources.
The modulo rules only *plant* bad values (NULLs, unparsable text, rescued
fields, ties, empty weeks) into every row class; nothing is filtered away by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.columns import money_text, ship_day_text
from larder.sources.tables import table


def _null_str() -> F.Column:
    return F.lit(None).cast("string")


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze sales lines: every column text, as an ingested CSV would be.

    Lines are dealt by order key, as the join with the orders needs them anyway,
    so the text formatting runs behind that exchange in as many tasks.
    """
    li = _lines(spark, sf_dir).repartition("l_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    text = _line_text(j)
    text.insert(8, F.col("o_orderpriority").alias("payment_type"))
    text.insert(10, F.concat(F.lit("L"), F.col("o_custkey")).alias("loyalty_id"))
    return j.select(*text)


def sales_lines_raw(spark: SparkSession, sf_dir: str, ship_days: tuple | None = None) -> DataFrame:
    """Bronze sales lines without the two columns that come from the order.

    Needs no join; ``ship_days`` (from, to) is a half-open range of days that
    reaches the scan.  For reports that read neither payment type nor loyalty id.
    """
    li = _lines(spark, sf_dir)
    if ship_days:
        li = li.filter((F.col("l_shipdate") >= F.lit(ship_days[0]).cast("timestamp_ntz"))
                       & (F.col("l_shipdate") < F.lit(ship_days[1]).cast("timestamp_ntz")))
    return li.select(*_line_text(li))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")


def _line_text(j: DataFrame) -> list[F.Column]:
    k = F.col("l_orderkey")
    day = ship_day_text(F.col("l_shipdate"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return [
        F.concat(F.lit("T"), k, F.lit("-"), F.col("l_partkey"), F.lit("-"),
                 F.col("l_suppkey")).alias("transaction_id"),
        F.col("l_linenumber").cast("string").alias("line_number"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("store_id"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("product_id"),
        F.when(k % 29 == 0, _null_str())
         .when(k % 47 == 0, F.lit("bad"))
         .when(k % 59 == 0, F.lit("0"))
         .otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("quantity"),
        F.when(k % 31 == 0, _null_str()).otherwise(money_text(unit)).alias("unit_price"),
        F.when(k % 37 == 0, _null_str())
         .otherwise(money_text(unit * F.col("l_discount"))).alias("discount"),
        F.when(k % 41 == 0, _null_str())
         .otherwise(money_text(F.col("l_extendedprice") * (F.lit(1e0) - F.col("l_discount"))))
         .alias("total_amount"),
        F.when(F.col("l_returnflag") == "A", "pickup")
         .when(F.col("l_returnflag") == "N", "delivery")
         .otherwise("in_store").alias("channel"),
        F.when(k % 43 == 0, F.lit("n/a"))
         .otherwise(F.concat(day, F.lit(" "),
                             F.lpad((F.col("l_partkey") % 24).cast("string"), 2, "0"),
                             F.lit(":00:00"))).alias("transaction_ts"),
        F.when(k % 53 == 0, _null_str()).otherwise(day).alias("event_date"),
    ]


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store dimension: one row per supplier (region/nation are 5/25 rows)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    j = s.join(geo, s.s_nationkey == geo.n_nationkey, "left")
    return j.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("store_id"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("city"),
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("state"),
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("zipcode"),
        F.date_add(F.lit("2018-01-01").cast("date"),
                   (F.col("s_suppkey") % 2000).cast("int")).alias("opened_date"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension: one row per part; some base prices missing."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand",
                                            "p_retailprice")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("product_id"),
        F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("p_retailprice")).alias("base_price"),
        F.lit("EA").alias("unit"),
    )


def competitor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze competitor scrapes: three competitors per (product, ship day).

    Every seventh product has no readable price and every fifth scrape a rescued
    field, so cleaning rejects them and some sales find no competitor.  The keys are
    dealt by product to more tasks than made them distinct: each becomes three rows of
    text, which whatever sorts them next would else hold beside the distinct keys.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("d"))
    keys = li.distinct().repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    comp = keys.join(p, keys.l_partkey == p.p_partkey, "inner")
    comp = comp.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    day_txt = F.col("d").cast("string")
    mult = F.lit(85e-2) + ((F.col("l_partkey") * 7 + F.col("k") * 11 + F.dayofmonth("d")) % 31) / F.lit(1e2)
    return comp.select(
        F.concat(F.lit("C"), F.col("k")).alias("competitor"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("product_id"),
        F.when((F.col("l_partkey") + F.col("k")) % 61 == 0, F.lit("oops"))
         .when(F.col("l_partkey") % 7 == 0, F.lit("n/a"))
         .otherwise(money_text(F.col("p_retailprice") * mult)).alias("price"),
        F.concat(day_txt, F.lit(" 06:00:00")).alias("scrape_ts"),
        day_txt.alias("event_date"),
        F.when((F.col("l_partkey") + F.col("k")) % 67 == 0, F.lit('{"extra":"1"}'))
         .when((F.col("l_partkey") + F.col("k")) % 5 == 0, F.lit('{"extra":"5"}'))
         .otherwise(_null_str()).alias("_rescued_data"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store-support tickets from the event stream (the columns the ops use).

    Views of every fourth week are a week late, so that category has weeks
    without tickets.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                             "value", "props")
    late = (F.col("event_type") == "view") & (F.weekofyear("ts") % 4 == 2)
    e = e.withColumn("ts", F.when(late, F.col("ts") + F.make_dt_interval(F.lit(7))).otherwise(F.col("ts")))
    is_open = F.col("event_id") % 5 == 0
    return e.select(
        F.col("event_id").alias("ticket_id"),
        F.when(is_open, "open").otherwise("closed").alias("status"),
        F.col("event_type").alias("issue_category"),
        F.pmod("user_id", F.lit(2**31 - 1)).cast("int").alias("unit_id"),
        F.col("ts").alias("created_time"),
        F.when(is_open, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 72).cast("int")))
         .alias("close_time"),
        (F.col("value") % F.lit(5e0)).alias("csat_score"),
        F.get_json_object("props", "$.k").cast("int").alias("hold_time_seconds"),
        (F.col("event_type") == "error").alias("escalated"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints that users have reached: one per sign-up event, every third without a message."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props").filter(F.col("event_type") == "signup")
    return e.select(F.col("event_id").alias("checkpoint_id"), F.concat(F.lit("user-"), F.col("user_id")).alias("user_id"),
                    F.concat(F.lit("Part "), F.col("event_id") % 9).alias("name"),
                    F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.col("props")).alias("message"))


CHAT_EPOCH = "2024-01-01 00:00:00"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat table: one row per conversation; every third is as old as its user's chat before."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit("U"), F.col("conv_id") % 20).alias("user_id"),
        F.concat(F.lit("Chat "), F.col("conv_id")).alias("title"),
        F.when(F.col("conv_id") % 4 == 0, "public").otherwise("private").alias("visibility"),
        (F.lit(CHAT_EPOCH).cast("timestamp_ntz")
         + F.make_dt_interval(hours=_chat_hour(F.col("conv_id")))).alias("created_at"),
    )


def _hour(conv: F.Column) -> F.Column:
    """Hours after the epoch; ids beyond the range of an interval start over."""
    return F.pmod(conv, F.lit(1_000_000)).cast("int")


def _chat_hour(conv: F.Column) -> F.Column:
    """``_hour``, with ties: the user of a chat is its id mod 20."""
    return F.when((conv % 3 == 0) & (conv >= 20), _hour(conv) - 20).otherwise(_hour(conv))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's request for a page beside one of their chats; some name a chat that isn't there."""
    users = chats(spark, sf_dir).select("user_id").distinct()
    n = F.substring("user_id", 2, 9).cast("long")
    return users.select("user_id", F.when(n % 6 == 5, n + 1_000_000_000).otherwise(n + 40).alias("cursor_id"))


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of messages that a reader asks for, one of them unknown for each chat."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return m.select(F.concat(F.col("conv_id"), F.lit("-"), F.when(F.col("turn") == 0, F.lit(999)).otherwise(F.col("turn") - 1))
                    .alias("message_id"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message table: one row per conversation turn (row-local, no join)."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return m.select(
        F.concat(F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"),
        F.col("conv_id").alias("chat_id"),
        F.col("turn"),
        F.col("role"),
        F.col("text"),
        (F.lit(CHAT_EPOCH).cast("timestamp_ntz")
         + F.make_dt_interval(hours=_hour(F.col("conv_id")),
                              mins=F.col("turn").cast("int"))).alias("created_at"),
    )


def chat_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed change log of chats: versions 0..2 with visibility flips (op M2 input)."""
    c = chats(spark, sf_dir)
    v = c.withColumn("version", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return v.select(
        "id", "user_id", "title",
        F.when((F.col("id") + F.col("version")) % 2 == 0, "public").otherwise("private")
         .alias("visibility"),
        F.col("version").cast("int").alias("version"),
        (F.col("created_at") + F.make_dt_interval(mins=F.col("version").cast("int") * 10))
        .alias("updated_at"),
    )


def uuid_text(seed: F.Column) -> F.Column:
    """8-4-4-4-12 hex text from the md5 of ``seed`` (deterministic ids)."""
    h = F.md5(seed)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


PART_TYPE = "struct<type:string,text:string,media_type:string,name:string,url:string>"


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming chat requests, one per conversation turn (validation input)."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    cid, turn = F.col("conv_id"), F.col("turn")
    text_part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"),
                         F.lit(None).cast("string").alias("media_type"),
                         F.lit(None).cast("string").alias("name"),
                         F.lit(None).cast("string").alias("url"))
    file_part = F.struct(F.lit("file").alias("type"), F.lit(None).cast("string").alias("text"),
                         F.when(turn % 6 == 0, "image/gif").otherwise("image/png").alias("media_type"),
                         F.concat(F.lit("img"), turn, F.lit(".png")).alias("name"),
                         F.when(turn % 9 == 0, F.lit("not a url"))
                          .otherwise(F.concat(F.lit("https://img.test/"), cid, F.lit("/"), turn))
                          .alias("url"))
    parts = F.when(turn % 3 == 0, F.array(text_part, file_part)).otherwise(F.array(text_part))
    return m.select(
        F.concat(cid, F.lit("-"), turn).alias("request_id"),
        F.when(cid % 11 == 0, F.concat(F.lit("chat-"), cid))
         .otherwise(uuid_text(F.concat(F.lit("c"), cid))).alias("chat_uuid"),
        uuid_text(F.concat(F.lit("m"), cid, F.lit("-"), turn)).alias("message_uuid"),
        "role",
        parts.alias("parts"),
        F.when((cid + turn) % 17 == 0, "other-model").when(turn % 2 == 0, "chat-model")
         .otherwise("chat-model-reasoning").alias("selected_model"),
        F.when(cid % 4 == 0, "public").otherwise("private").alias("visibility"),
    )


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn read back by some user (owner or not)."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return m.select(F.concat(F.col("conv_id"), F.lit("-"), F.col("turn")).alias("request_id"),
                    F.col("conv_id").alias("chat_id"),
                    F.concat(F.lit("U"), (F.col("conv_id") + F.col("turn")) % 20).alias("user_id"))


def chats_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat table with some chats missing (their messages become orphans)."""
    return chats(spark, sf_dir).filter(F.col("id") % 13 != 0)


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats a user asked to delete."""
    return chats(spark, sf_dir).filter(F.col("id") % 7 == 0).select(F.col("id").alias("chat_id"))


def trailing_delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit requests: drop a chat's messages from its turn-2 message on."""
    m = messages(spark, sf_dir)
    return m.filter((F.col("turn") == 2) & (F.col("chat_id") % 3 == 0)).select(
        "chat_id", F.col("created_at").alias("cutoff"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response stream per assistant message."""
    m = messages(spark, sf_dir).filter(F.col("role") == "assistant")
    return m.select(F.col("id").alias("stream_id"), "chat_id", F.col("created_at").alias("started_at"))
