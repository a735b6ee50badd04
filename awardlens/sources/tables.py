"""The contract extract as a view of a star schema of orders, so that the engine runs on such tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import small
from .files import RAW

#: What the order's priority stands for.
METHOD_OF_PRIORITY = {"1-URGENT": "Direct Selection", "2-HIGH": "Request for Proposals", "3-MEDIUM": "Request for Bids", "4-NOT SPECIFIED": "Consultant Qualification  Selection", "5-LOW": "Force Account"}

#: Sellers, about 200 bytes each, that are sent to every executor.
SELLERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and supplier, in the raw schema."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    borrower = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", F.col("n_name").alias("b_name"), F.col("r_name").alias("b_region"), F.col("n_nationkey").alias("b_key"))
    seller = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("s_nation"), F.col("n_nationkey").alias("s_key"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(small(table(spark, sf_dir, "part").select("p_partkey", "p_type")), F.col("l_partkey") == F.col("p_partkey"), "left")
    # Grouped by order once: the suppliers of an order are rows again when all that an order has is joined.
    # Lines are dealt out first, as sets of single lines would be several times as large in the shuffle.
    # A line without a part in the table has its supplier in the contract, if another line of the order has a part.
    own_lines = lines.select("l_orderkey", "l_suppkey", "p_type", F.col("p_partkey").isNotNull().alias("found")).repartition("l_orderkey").groupBy("l_orderkey")
    own_lines = own_lines.agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("types"), F.collect_set("l_suppkey").alias("suppliers"), F.max("found").alias("found")).filter("found").drop("found")
    orders = table(spark, sf_dir, "orders").join(borrower, F.col("o_custkey") == F.col("c_custkey"))
    rows = own_lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("l_suppkey", F.explode("suppliers")).drop("suppliers")
    rows = rows.join(small(seller, SELLERS), F.col("l_suppkey") == F.col("s_suppkey"))
    method = F.create_map(*(F.lit(x) for pair in METHOD_OF_PRIORITY.items() for x in pair))
    regional = F.col("b_key") == 24
    own = {
        "as_of_date": F.lit("08/22/2026"),
        "region": F.col("b_region"),
        "borrower_country": F.when(regional, "World").otherwise(F.col("b_name")),
        "borrower_country_code": F.when(~regional, F.concat(F.lit("N"), F.col("b_key"))),
        "project_id": F.concat(F.lit("P"), F.col("o_custkey")),
        "global_practice_raw": F.col("types"),
        "procurement_category": F.col("c_mktsegment"),
        "procurement_method_raw": F.try_element_at(method, F.col("o_orderpriority")),
        "contract_id": F.col("o_orderkey").cast("long"),
        "signing_date_raw": F.date_format("o_orderdate", "MM/dd/yyyy"),
        "supplier_id": F.concat(F.lit("S"), F.col("s_suppkey")),
        "supplier_name_raw": F.when(F.col("s_suppkey") % 5 == 0, "INDIVIDUAL CONSULTANT").otherwise(F.concat("s_name", F.lit(" Co., Ltd."))),
        "supplier_country": F.col("s_nation"),
        "supplier_country_code": F.concat(F.lit("N"), F.col("s_key")),
        "amount_usd": F.when(F.col("o_orderkey") % 997 == 0, 0.0).otherwise(F.col("o_totalprice")),
        "review_type": F.when(F.col("o_orderstatus") == "F", "Prior").otherwise("Post"),
    }
    return rows.select(*(own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in RAW))
