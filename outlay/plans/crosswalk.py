"""The driver's star schema seen as public contracts.

A line item is a contract, its order the procedure, the customer the paying authority, the
supplier the winning bidder, the part's type the sector. Money is kept in whole cents, so sums
are exact in any order. The expressions are plain SQL that Spark and other engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = {
    "id": "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING), CAST(CAST(floor(l_discount * 100 + 0.5) AS INT) AS STRING), CAST(CAST(floor(l_tax * 100 + 0.5) AS INT) AS STRING), l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS STRING))",
    "tender_id": "l_orderkey",
    "authority_id": "o_custkey",
    "bidder_id": "l_suppkey",
    "part_id": "l_partkey",
    "lot_id": "l_linenumber",
    "division": "p_type",
    "subject": "p_name",
    "procedure_type": "o_orderpriority",
    "signed_at": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "published_at": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "bids_received": "CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN NULL ELSE l_linenumber END",
    "eu_funded": "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END",
    "currency": "CASE WHEN l_linestatus = 'O' THEN 'EUR' WHEN l_returnflag = 'N' THEN 'USD' ELSE 'BGN' END",
    "amount_cents": "CASE WHEN l_discount >= 0.09 THEN NULL WHEN l_quantity = 1 THEN -CAST(floor(l_extendedprice + 0.5) AS BIGINT) ELSE CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) END",
    "signing_cents": "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)",
    "procedure_cents": "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)",
    "own_cents": "CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)",
}

#: The same table for an SQL engine: ``WITH`` + CONTRACTS_SQL + ...
CONTRACTS_SQL = "contracts AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CONTRACT.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"

#: Procedure types by how open the competition was.
PROCEDURE_GROUPS = {"1-URGENT": "direct", "2-HIGH": "open", "3-MEDIUM": "open", "4-NOT SPECIFIED": "unknown", "5-LOW": "neutral"}
GROUP_SQL = "CASE procedure_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROCEDURE_GROUPS.items()) + " ELSE 'unknown' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns (all by default); joins that none of them needs are left out."""
    names = columns or tuple(CONTRACT)
    text = " ".join(CONTRACT[n] for n in names)
    out = table(spark, sf_dir, "lineitem")
    if " o_" in f" {text}".replace("(", " "):
        out = out.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if " p_" in f" {text}".replace("(", " "):
        out = out.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return out.selectExpr(*[f"{CONTRACT[n]} AS {n}" for n in names])


def eur(column: str) -> str:
    """SQL: cents as a number of euros."""
    return f"CAST({column} AS DOUBLE) / 100"
