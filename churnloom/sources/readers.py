"""Reading customer tables: any Spark format, CSV with missing tokens, records."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom.operators.clean import normalize_nan
from churnloom.schema import customer_schema
from churnloom.sources.storage import materialize
from churnloom.sources.writers import CSV_OPTIONS

# Cells a CSV reader takes as missing.
CSV_MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def scan_table(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Whole collection in any format on the class path, connectors included."""
    reader = spark.read.format(fmt).options(**options)
    return normalize_nan(reader.load(path) if path else reader.load())


def _csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text. A file whose header is not that of the others is an error."""
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(text).options(enforceSchema=False, **CSV_OPTIONS).csv(path)


def _known(name: str, tokens: list[str]) -> Column:
    return F.when(~F.col(name).isin(tokens), F.col(name))


def _invalid(cells: DataFrame, fields: list[T.StructField], tokens: list[str]) -> DataFrame:
    counts = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count_if(
                _known(f.name, tokens).isNotNull() & _known(f.name, tokens).try_cast(f.dataType).isNull()
            ).alias("n_invalid"),
        )
        for f in fields
    ]
    return cells.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def invalid_cells(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    missing_tokens: Iterable[str] = CSV_MISSING_TOKENS,
) -> DataFrame:
    """``column`` and ``n_invalid``: cells that are neither missing nor of the declared type."""
    cells = _csv_cells(spark, path)
    fields = [f for f in (schema or customer_schema(raw=True)).fields if f.name in cells.columns]
    return _invalid(cells, fields, list(missing_tokens))


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    missing_tokens: Iterable[str] = CSV_MISSING_TOKENS,
) -> DataFrame:
    """CSV with a header. All cells are read as text, so that every token is seen, then cast.

    A column with a cell that is neither missing nor of its declared type stays text as a
    whole: no row is lost, and the ``type`` rule of the schema report fails. The files are read
    once and their cells written; such columns are found there. A blank such as ``' '`` is
    text, not a missing cell. All files below ``path`` must have the same columns in the same
    order; another header is an error.
    """
    schema, tokens = schema or customer_schema(raw=True), list(missing_tokens)
    cells = _csv_cells(spark, path)
    names = cells.columns
    present = [f for f in schema.fields if f.name in names]
    extra = [T.StructField(c, T.StringType()) for c in names if c not in schema.names]
    # Each cell is parsed once and written, with its text beside it where it has a type of
    # its own. What is returned are columns of that table under their own names: a renamed
    # column would double what the optimizer knows of every condition on it.
    prefix = "_text"
    while any(n.startswith(prefix) for n in names):
        prefix = f"_{prefix}"
    parsed, texts = [], {}
    for i, field in enumerate([*present, *extra]):
        known = _known(field.name, tokens)
        if isinstance(field.dataType, T.StringType):
            parsed.append(known.alias(field.name))
        else:
            texts[field.name] = f"{prefix}_{i}"
            parsed += [known.try_cast(field.dataType).alias(field.name), known.alias(texts[field.name])]
    table = materialize(cells.select(*parsed), "csv-cells")
    bad = [F.bool_or(F.col(t).isNotNull() & F.col(c).isNull()).alias(c) for c, t in texts.items()]
    wrong = table.agg(*bad).first().asDict() if bad else {}
    return table.select(
        *(F.col(texts[f.name]).alias(f.name) if wrong.get(f.name) else f.name for f in [*present, *extra])
    )


def json_records(
    lines: DataFrame, column: str = "record", schema: T.StructType | None = None
) -> DataFrame:
    """Request records, one JSON object in each row of ``column``, to a table.

    The objects are parsed on the executors. Values take the schema's types; a value that does
    not fit is missing. Fields that no record has stay absent, and unknown ones are kept as
    text, so that the input contract can report both; a nested value is kept as its JSON. Only the
    names of the fields come to the driver. A row that holds no JSON object is an error.
    """
    known = {f.name: f.dataType for f in (schema or customer_schema(target=False)).fields}
    options = {"mode": "PERMISSIVE", "allowNumericLeadingZeros": "true"}
    parsed = lines.select(F.from_json(column, "map<string,string>", options).alias("fields"))
    parsed = materialize(parsed, "records")
    fields = parsed.select(F.explode(F.map_keys("fields")).alias("name")).distinct()
    counts = parsed.agg(F.count("*").alias("n"), F.count("fields").alias("good")).first()
    if not counts["n"]:
        raise ValueError("no record given")
    if counts["good"] < counts["n"]:
        raise ValueError(f"{counts['n'] - counts['good']} records are no JSON objects")
    found = {row["name"] for row in fields.collect()}
    names = [n for n in known if n in found] + sorted(found - set(known))
    return parsed.select(
        *(F.col("fields").getItem(n).try_cast(known.get(n, T.StringType())).alias(n) for n in names)
    )


def records_to_table(
    spark: SparkSession,
    records: Mapping | Iterable[Mapping],
    schema: T.StructType | None = None,
) -> DataFrame:
    """Request records, one or a list, to a table; values take the schema's types.

    Columns that are absent from every record stay absent, and unknown ones are
    kept as text, so that the input contract can report both.
    """
    rows = [records] if isinstance(records, Mapping) else list(records)
    if not rows:
        raise ValueError("no record given")
    schema = schema or customer_schema(target=False)
    names = list(dict.fromkeys(name for row in rows for name in row))
    known = {f.name: f.dataType for f in schema.fields}
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def as_text(value):
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value)

    table = spark.createDataFrame([[as_text(row.get(n)) for n in names] for row in rows], text)
    return table.select(*(F.col(n).try_cast(known.get(n, T.StringType())).alias(n) for n in names))
