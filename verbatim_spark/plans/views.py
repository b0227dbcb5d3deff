"""The driver's tables in the roles of the data model, as DataFrames and as the
same CTEs in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code applications: an order is a quotation, its customer the document, a
    part's brand the code and its type the theme. Valence is v / 5, v from -5 to
    5; confidence is 1 - tax / 100."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code_id"), F.col("p_type").alias("theme_id"))
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("document_id"),
        F.when(F.col("o_orderstatus") == "O", "user").when(F.col("o_orderstatus") == "F", "auto").otherwise("search").alias("created_by"),
    )
    return (
        read(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("quotation_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey",
            (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("v"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("quotation_id") == F.col("o_orderkey"))
        .select("quotation_id", "line", "code_id", "theme_id", "document_id", "created_by", "v", "tax", "quantity", "l_suppkey", "l_partkey",
                (F.col("v") / 5.0).alias("valence"), (1 - F.col("tax") / 100.0).alias("confidence"))
    )


APPS = """apps AS (
  SELECT l_orderkey AS quotation_id, l_linenumber AS line, p_brand AS code_id, p_type AS theme_id, o_custkey AS document_id,
    CASE o_orderstatus WHEN 'O' THEN 'user' WHEN 'F' THEN 'auto' ELSE 'search' END AS created_by,
    CAST(round(l_discount * 100) AS INTEGER) - 5 AS v, CAST(round(l_tax * 100) AS INTEGER) AS tax,
    CAST(l_quantity AS INTEGER) AS quantity, l_suppkey, l_partkey,
    (CAST(round(l_discount * 100) AS INTEGER) - 5) / 5.0::DOUBLE AS valence,
    1 - CAST(round(l_tax * 100) AS INTEGER) / 100.0::DOUBLE AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

ANCHOR = "2001-08-01"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: an order is a review, its customer's segment the business, the
    priority's digit the rating, v the text's valence in twentieths (from the
    order's price), the age in days from a fixed date."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("business"))
    return (
        read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("reviewer"), "business",
            F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
            F.datediff(F.lit(ANCHOR).cast("date"), F.col("o_orderdate").cast("date")).alias("days"),
            (F.floor(F.col("o_totalprice")).cast("bigint") % 41 - 20).cast("int").alias("v"),
            (F.col("o_orderstatus") == "P").alias("responded"),
        )
    )


REVIEWS = """reviews AS (
  SELECT o_orderkey AS review_id, o_custkey AS reviewer, c_mktsegment AS business,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating,
    datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS days,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 41 - 20 AS INTEGER) AS v, o_orderstatus = 'P' AS responded
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def typed(oracle: dict[str, str], kinds: dict[str, dict[str, str]]) -> None:
    """Gives columns of some oracles the types that Spark's have: window ranks and
    sizes are 64-bit in DuckDB, sums of big integers 128-bit."""
    for name, columns in kinds.items():
        casts = ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for c, kind in columns.items())
        oracle[name] = f"SELECT * REPLACE ({casts}) FROM ({oracle[name]})"
