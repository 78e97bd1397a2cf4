"""The churn table derived from the ``customer`` and ``orders`` tables.

Features use orders before the cut-off only; the label says whether an order
follows it. Some cells are made dirty on purpose, and some rows come twice, so
the cleaning operators have work to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.schema import COLUMNS

# Fixed values of the derived table.
CUTOFF = "2000-11-01"
INTERNET_OPTION_PERIODS = {
    "OnlineSecurity": 3,
    "OnlineBackup": 5,
    "DeviceProtection": 7,
    "TechSupport": 11,
    "StreamingTV": 13,
    "StreamingMovies": 17,
}


def _pick(*cases: tuple[Column, object], default: object) -> Column:
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(default))


def _order_history(orders: DataFrame) -> DataFrame:
    """One row per customer with an order before the cut-off, in one pass."""
    earlier = F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return (
        orders.groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count_if(earlier).alias("n"),
            F.count_if(~earlier).alias("n_later"),
            F.sum(F.when(earlier, price)).cast("double").alias("tot"),
            F.min(F.when(earlier, F.col("o_orderdate"))).alias("first_order"),
        )
        .where("n > 0")
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21-column customer table with missing tokens, blanks, nulls and duplicates."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = customer.join(_order_history(orders), "c_custkey")
    k, n = F.col("c_custkey"), F.col("n")
    phone = k % 10 != 0
    internet = k % 5 != 0
    total = F.round(F.col("tot") / 1000, 2).cast("decimal(10,2)").cast("string")
    yes_no = lambda condition: _pick((condition, "Yes"), default="No")
    columns = {
        "customerID": F.concat(F.lit("C"), F.lpad(k.cast("string"), 8, "0")),
        "gender": _pick((k % 2 == 0, "Female"), default="Male"),
        "SeniorCitizen": (F.col("c_acctbal") < 0).cast("int"),
        "Partner": _pick((k % 50 == 7, "na"), (F.col("c_nationkey") % 2 == 0, "Yes"), default="No"),
        "Dependents": yes_no(F.col("c_nationkey") % 3 == 0),
        "tenure": F.floor(
            F.datediff(F.lit(CUTOFF).cast("date"), F.col("first_order").cast("date")) / 30
        ).cast("int"),
        "PhoneService": yes_no(phone),
        "MultipleLines": _pick((~phone, "No phone service"), (k % 7 < 3, "Yes"), default="No"),
        "InternetService": _pick((~internet, "No"), (k % 5 == 1, "DSL"), default="Fiber optic"),
        "Contract": _pick((n < 6, "Month-to-month"), (n < 10, "One year"), default="Two year"),
        "PaperlessBilling": yes_no(k % 3 == 0),
        "PaymentMethod": _pick(
            (k % 4 == 0, "Electronic check"),
            (k % 4 == 1, "Mailed check"),
            (k % 4 == 2, "Bank transfer (automatic)"),
            default="Credit card (automatic)",
        ),
        "MonthlyCharges": F.when(k % 41 != 3, F.round(F.col("tot") / n / 2500, 2)),
        "TotalCharges": F.when(k % 37 == 5, F.lit(" ")).otherwise(total),
        "Churn": yes_no(F.col("n_later") == 0),
    }
    for name, period in INTERNET_OPTION_PERIODS.items():
        columns[name] = _pick(
            (~internet, "No internet service"), (k % period < 2, "Yes"), default="No"
        )
    copies = F.when(k % 60 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.select(
        *(columns[name].alias(name) for name in COLUMNS), F.explode(copies).alias("_copy")
    ).drop("_copy")


def separable_target() -> Column:
    """A target that the features do decide, for model queries and tests."""
    number = F.substring("customerID", 2, 8).cast("bigint")
    return _pick(
        (F.col("Contract") == "Month-to-month", "Yes"),
        ((F.col("InternetService") == "Fiber optic") & (number % 4 == 0), "Yes"),
        default="No",
    )
