"""CSV tables: by position (first column dropped, last the label) or by inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources.lines import numbered_lines

#: Label columns looked for by name, and spellings of a missing value.
TARGETS = ("Species", "Outcome", "species")
MISSING = ("NA", "na", "?", "N/A")


#: The form of a number at the beginning of a cell, in powers of ten or of two, and the smallest normal float.
DECIMAL = r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?|nan)))"
HEXADECIMAL = r"^\s*([+-]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)(?:\.([0-9a-fA-F]*))?(?:[pP]([+-]?\d+))?"
LEAST_FLOAT = 1.1754943508222875e-38


def _number(cell: Column) -> Column:
    """The number that a cell begins with, as a float; what follows it is ignored. A cell without a number, and one beyond the floats, is an error."""
    of = lambda i: F.regexp_extract(cell, HEXADECIMAL, i)
    digits = F.concat(of(2), of(3))
    power = F.coalesce(of(4).try_cast("int"), F.when(of(4) == "", 0).when(of(4).startswith("-"), -100_000).otherwise(100_000))
    # 13 digits and a bit that tells whether more follow are a whole number that a double holds, and decide how a float is rounded.
    leading = F.regexp_replace(digits, "^0+", "")
    head, rest = F.left(leading, F.lit(13)), F.substring(leading, 14, 2**30)
    exponent = power - 4 * F.length(of(3)) + 4 * F.length(rest) - 1
    whole = F.coalesce(F.conv(F.when(head == "", "0").otherwise(head), 16, 10).cast("double"), F.lit(0.0)) * 2 + F.when(rest.rlike("[^0]"), 1.0).otherwise(0.0)
    scaled = F.when(whole == 0, 0.0).otherwise(whole * F.pow(F.lit(2.0), exponent)) * F.when(of(1) == "-", -1.0).otherwise(1.0)
    text = F.regexp_extract(cell, DECIMAL, 1)
    value = F.when(cell.rlike(HEXADECIMAL), scaled).otherwise(text.cast("double"))
    beyond = (F.abs(value.cast("float")) == float("inf")) & ~text.rlike("(?i)inf")
    below = (F.abs(value) < LEAST_FLOAT) & F.when(cell.rlike(HEXADECIMAL), digits.rlike("[^0]")).otherwise(F.split(text, "[eE]")[0].rlike("[1-9]"))
    return F.when(beyond | below, F.raise_error(F.lit("A number is out of range")).cast("float")).otherwise(value.cast("float"))


def load_positional(spark: SparkSession, path: str, strict_lines: bool = False) -> DataFrame:
    """Float features by header name and the string ``label``.

    The first line of each file is its header, wherever else its text occurs.
    The first column is dropped. A cell without content at the end of a line
    counts as absent. ``strict_lines`` keeps a carriage return before a line
    end as part of the last cell; else it is removed.
    """
    head = spark.read.option("lineSep", "\n").text(path).first()
    if head is None:
        raise ValueError("Dataset file is empty")
    first = head[0] if strict_lines else head[0].removesuffix("\r")
    header = first.removesuffix(",").split(",")
    if len(header) < 3:
        raise ValueError("Unexpected CSV header format")
    lines = numbered_lines(spark, path).filter("start > 0 or line > 0")  # but for the header of each file
    if not strict_lines:
        lines = lines.withColumn("value", F.regexp_replace("value", "\r$", ""))
    cells = F.split(F.regexp_replace("value", ",$", ""), ",", -1)
    rows = lines.filter(F.length("value") > 0).withColumn("c", cells)
    place = F.concat(F.lit("Malformed CSV row: "), "file", F.lit(", line "), (F.col("line") + 1).cast("string"), F.when(F.col("start") > 0, F.concat(F.lit(" after byte "), F.col("start").cast("string"))).otherwise(""))
    rows = rows.select(F.when(F.size("c") == len(header), F.col("c")).otherwise(F.raise_error(place)).alias("c"))
    return rows.select(*[_number(F.col("c")[i]).alias(header[i]) for i in range(1, len(header) - 1)], F.col("c")[len(header) - 1].alias("label"))


def load_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Numeric features as doubles and the string ``label``, found by name or else the last column.

    Rows with a missing value in any column go first; then columns that are not
    numbers in every row.
    """
    table = spark.read.option("header", True).csv(path)
    target = next((c for c in TARGETS if c in table.columns), table.columns[-1])
    if target != "Id":
        table = table.drop("Id")
    table = table.replace(list(MISSING), None).dropna("any")
    features = [c for c in table.columns if c != target]
    odd = table.agg(*[F.count(F.when(F.expr(f"try_cast(`{c}` as double)").isNull(), 1)).alias(c) for c in features]).first()
    return table.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features if not odd[c]], F.col(f"`{target}`").cast("string").alias("label"))


def dataset_summary(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: number of rows, feature names, and the first row by ``order`` as text."""
    features = [c for c in df.columns if c != "label" and c not in order]
    first = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in features], F.concat(F.lit("label="), "label"))
    return df.agg(F.count("*").alias("n_rows"), F.lit(" ".join(features)).alias("features"), F.min_by(first, F.struct(*order)).alias("first_row"))
