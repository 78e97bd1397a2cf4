"""The customer table: columns, types and value rules."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnRule:
    """What one column must look like. ``kind`` is string, int, float or a Spark type name."""

    name: str
    kind: str
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple[str, ...] | None = None


# Column names, value lists and bounds of the customer table.
ID_COLUMN = "customerID"
TARGET = "Churn"
POSITIVE, NEGATIVE = "Yes", "No"
MISSING_TOKEN = "na"
YES_NO = ("Yes", "No")
INTERNET_OPTION = ("Yes", "No", "No internet service")
CUSTOMER_RULES: tuple[ColumnRule, ...] = (
    ColumnRule("customerID", "string"),
    ColumnRule("gender", "string", allowed=("Male", "Female")),
    ColumnRule("SeniorCitizen", "int", 0, 1),
    ColumnRule("Partner", "string", allowed=YES_NO),
    ColumnRule("Dependents", "string", allowed=YES_NO),
    ColumnRule("tenure", "int", 0, 100),
    ColumnRule("PhoneService", "string", allowed=YES_NO),
    ColumnRule("MultipleLines", "string", allowed=("Yes", "No", "No phone service")),
    ColumnRule("InternetService", "string", allowed=("DSL", "Fiber optic", "No")),
    ColumnRule("OnlineSecurity", "string", allowed=INTERNET_OPTION),
    ColumnRule("OnlineBackup", "string", allowed=INTERNET_OPTION),
    ColumnRule("DeviceProtection", "string", allowed=INTERNET_OPTION),
    ColumnRule("TechSupport", "string", allowed=INTERNET_OPTION),
    ColumnRule("StreamingTV", "string", allowed=INTERNET_OPTION),
    ColumnRule("StreamingMovies", "string", allowed=INTERNET_OPTION),
    ColumnRule("Contract", "string", allowed=("Month-to-month", "One year", "Two year")),
    ColumnRule("PaperlessBilling", "string", allowed=YES_NO),
    ColumnRule(
        "PaymentMethod",
        "string",
        allowed=(
            "Electronic check",
            "Mailed check",
            "Bank transfer (automatic)",
            "Credit card (automatic)",
        ),
    ),
    ColumnRule("MonthlyCharges", "float", 0, 200),
    ColumnRule("TotalCharges", "float", 0, 10000),
    ColumnRule("Churn", "string", allowed=YES_NO),
)

COLUMNS = [rule.name for rule in CUSTOMER_RULES]
FEATURES = [name for name in COLUMNS if name != TARGET]

# Spark types accepted for each declared kind.
KIND_TYPES = {
    "string": ("string",),
    "int": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double"),
}
NUMERIC_KINDS = ("int", "float")

_SPARK_TYPE = {"string": T.StringType(), "int": T.IntegerType(), "float": T.DoubleType()}


def customer_schema(raw: bool = False, target: bool = True) -> T.StructType:
    """Schema of the customer table; ``raw`` keeps TotalCharges as it arrives, text."""
    fields = []
    for rule in CUSTOMER_RULES:
        if rule.name == TARGET and not target:
            continue
        kind = "string" if raw and rule.name == "TotalCharges" else rule.kind
        fields.append(T.StructField(rule.name, _SPARK_TYPE[kind]))
    return T.StructType(fields)


def load_rules(path: str) -> tuple[ColumnRule, ...]:
    """Rules from a JSON or YAML file: ``{"columns": {name: {type, allowed, min, max}}}``."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise ValueError("reading YAML rules needs PyYAML; use JSON") from error
            content = yaml.safe_load(handle)
        else:
            content = json.load(handle)
    return tuple(
        ColumnRule(
            name,
            spec["type"],
            spec.get("min"),
            spec.get("max"),
            tuple(spec["allowed"]) if spec.get("allowed") else None,
        )
        for name, spec in content["columns"].items()
    )
