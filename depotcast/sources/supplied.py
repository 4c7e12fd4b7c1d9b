"""The logical inputs expressed over the supplied star schema.

Every adapter is a lazy projection of whole tables. Facts keep all their rows:
dimensions are attached with left joins.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotcast.config import EnsembleConfig, SegmentRules, StockLabels
from depotcast.functions.dates import MONTH_PARTITION, between_days, next_month

# fixed values: the columns of the supplied tables and their types
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)

# fixed values: how this data set names its statuses
LABELS = StockLabels(
    factory_new="T0", rented="T1", ready="T2", sale="T3", unavailable="T4", total_loss="T5",
    stolen="T6", administrative="T7", transit_new="T8",
    in_maintenance="Brand#1", in_transit_new="Brand#2", received_new="Brand#3",
    own_programme=("Brand#4", "Brand#5"), awaiting_auction="Brand#6",
    between_branches="Brand#7", collected="Brand#8", impounded="Brand#9",
    misappropriated="Brand#10", operational="O",
)
HOME = "HOME"
ABROAD = "ABROAD"
RULES = SegmentRules(
    country_overrides={ABROAD: "ABROAD"},
    capital_overrides={("ASIA", "NATION_2"): "NATION_2 (capital)", ("EUROPE", "NATION_3"): "NATION_3 (capital)"},
)
INTERNAL_JOB = "internal"
PENDING_STATUSES = (1, 2, 3, 4)

# the first day of the data, the months of the wide table, and a day to plan from
SINCE = date(1995, 1, 1)
FIRST_MONTH = date(1995, 1, 31)
LAST_MONTH = date(2001, 12, 31)
AS_OF = date(2001, 8, 15)
ENSEMBLE = EnsembleConfig(cutoff=date(2001, 4, 30))


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    # a declared schema spares the job that reads file footers
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def _country(region: Column) -> Column:
    return F.when(region == "AMERICA", ABROAD).otherwise(HOME)


def _branch(column: str) -> Column:
    return F.col(column).cast("string").alias("branch")


def _thirds(column: str, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    value = F.col(column)
    return F.when(value.isin(*first), "new").when(value.isin(*second), "semi").otherwise("used")


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """The sites of shipped facts: each supplier's branch and the country it states."""
    nations = load(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    regions = load(spark, folder, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), _country(F.col("r_name")).alias("country")
    )
    return (
        load(spark, folder, "supplier")
        .join(nations.join(regions, "n_regionkey", "left"), "s_nationkey", "left")
        .select(F.col("s_suppkey").alias("site"), _branch("s_nationkey"), "country")
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """The sites of ordered facts: each customer's branch."""
    return load(spark, folder, "customer").select(F.col("c_custkey").alias("site"), _branch("c_nationkey"))


def _partition(facts: DataFrame) -> list[str]:
    return [MONTH_PARTITION] if MONTH_PARTITION in facts.columns else []


def stock_snapshots(spark: SparkSession, folder: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Shipped lines as stock snapshots; ``lineitem`` may be a copy of the table partitioned by month."""
    facts = load(spark, folder, "lineitem") if lineitem is None else lineitem
    parts = load(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("status_desc"),
        _thirds("p_type", ("STANDARD", "ECONOMY"), ("PROMO", "LARGE")).alias("product_rented"),
        F.when(F.col("p_size") <= 16, "new").when(F.col("p_size") <= 33, "semi").otherwise("used")
        .alias("product_class"),
    )
    status = F.concat(F.lit("T"), F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    return (
        facts.join(parts, "l_partkey", "left")
        .select(
            F.col("l_shipdate").alias("snapshot_ts"), F.col("l_suppkey").alias("site"), status.alias("status_type"),
            "status_desc", F.col("l_linestatus").alias("operational_flag"), "product_rented",
            "product_class", F.col("l_quantity").cast("long").alias("qty"), *_partition(facts),
        )
    )


def branch_register(spark: SparkSession, folder: str) -> DataFrame:
    populations = (
        load(spark, folder, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.floor(F.sum(F.col("c_acctbal").cast("decimal(18,2)"))).cast("long").alias("total"))
    )
    regions = load(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    name = F.col("n_name")
    return (
        load(spark, folder, "nation")
        .join(regions, "n_regionkey", "left")
        .join(populations, "n_nationkey", "left")
        .select(
            _branch("n_nationkey"),
            _country(F.col("r_name")).alias("country"),
            name.alias("city"),
            F.col("r_name").alias("region"),
            name.alias("state"),
            (F.col("r_name") == "MIDDLE EAST").cast("int").alias("third_party"),
            F.col("total").alias("population"),
        )
    )


def movements(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(
        F.col("o_orderdate").alias("moved_ts"), F.col("o_custkey").alias("site"), F.col("o_custkey").alias("unit_id"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("prev_status"),
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(
        F.col("o_orderdate").alias("paid_on"), F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("sale_id"),
        _thirds("o_orderpriority", ("1-URGENT", "2-HIGH"), ("3-MEDIUM",)).alias("product"),
    )


def daily_indicators(
    spark: SparkSession, folder: str, months: tuple[date, date] | None = None
) -> DataFrame:
    """Indicators by branch and day; ``months`` limits the orders read to those from one day's month to another's."""
    orders = load(spark, folder, "orders")
    if months is not None:
        orders = between_days(orders, "o_orderdate", months[0].replace(day=1), next_month(months[1]))
    # by customer and day first, so that a customer with very many orders is one row a day
    daily = orders.groupBy(
        F.col("o_custkey").alias("site"), F.col("o_orderdate").cast("date").alias("day")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")
    )
    return daily.join(customers(spark, folder), "site", "left").groupBy("branch", "day").agg(
        F.sum("n").cast("double").alias("mech_total"),
        F.min("least").alias("mech_present"),
        F.max("most").alias("mech_on_ramp"),
    )


def current_units(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("created_ts"), F.col("l_suppkey").alias("site"), F.col("l_orderkey").alias("unit_id")
    )


def maintenance(spark: SparkSession, folder: str, lineitem: DataFrame | None = None) -> DataFrame:
    facts = load(spark, folder, "lineitem") if lineitem is None else lineitem
    return facts.select(
        F.col("l_suppkey").alias("site"), F.col("l_shipdate").alias("finished_ts"), F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_returnflag") == "R", INTERNAL_JOB).otherwise("customer").alias("job_type"),
        *_partition(facts),
    )


def unit_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer at every month opening between the first and the last order."""
    span = load(spark, folder, "orders").agg(
        F.sequence(
            F.date_trunc("MM", F.min("o_orderdate")).cast("timestamp_ntz"),
            F.date_trunc("MM", F.max("o_orderdate")).cast("timestamp_ntz"),
            F.expr("interval 1 month"),
        )
    ).scalar()
    segment = F.col("c_mktsegment")
    status = (
        F.when(segment == "AUTOMOBILE", 1).when(segment == "BUILDING", 2)
        .when(segment == "FURNITURE", 3).when(segment == "HOUSEHOLD", 4).otherwise(5)
    )
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias("unit_id"), _branch("c_nationkey"), status.alias("status_id"),
        F.explode(span).alias("snapshot_ts"),
    )


def restrictions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as restrictions on a customer: open ones have no end, others a fixed length."""
    start, state = F.col("o_orderdate"), F.col("o_orderstatus")
    return load(spark, folder, "orders").select(
        F.col("o_custkey").alias("unit_id"),
        start.alias("valid_from"),
        F.when(state == "F", start + F.expr("interval 45 days"))
        .when(state == "P", start + F.expr("interval 200 days"))
        .alias("valid_to"),
        F.col("o_orderpriority").alias("description"),
    )
