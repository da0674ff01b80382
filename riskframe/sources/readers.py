"""File readers with explicit schemas (SRC group)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskframe import schemas
from riskframe.functions.columns import WHITESPACE
from riskframe.session import materialise

# Cell texts that stand for a missing value in delimited files.
MISSING_TEXTS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def empty_frame(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def require(*columns: str, returns: T.StructType | str) -> Callable:
    """SRC10: an operator whose input lacks a column gives an empty, typed result."""

    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def checked(df: DataFrame, *args, **kwargs) -> DataFrame:
            if not set(columns) <= set(df.columns):
                return empty_frame(df.sparkSession, returns)
            return operator(df, *args, **kwargs)

        return checked

    return decorate


def normalise_headers(df: DataFrame) -> DataFrame:
    """SRC8: column names without surrounding whitespace."""
    return df.toDF(*[c.strip() for c in df.columns])


def blank_missing(df: DataFrame) -> DataFrame:
    """Null for the cell texts that mean "no value" in string columns."""
    changes = {
        f.name: F.when(~F.col(f"`{f.name}`").isin("", *MISSING_TEXTS), F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != "_corrupt_record"
    }
    return df.withColumns(changes) if changes else df


def _header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Column names of a delimited file; reads one line."""
    row = spark.read.option("header", True).option("encoding", encoding).csv(path).limit(0)
    return row.columns


def _read_known(spark: SparkSession, path: str, encoding: str, types: dict[str, T.DataType]) -> DataFrame:
    """A delimited file whose columns are matched by trimmed, case-insensitive name.

    Files differ in column order and in stray blanks around names, so the
    schema follows the file's own header; unknown columns are strings. In a
    folder every file's header is compared with the first one's, and one that
    differs is an error, never a swap of columns. Cells
    are read as text and cast, so a cell that does not parse becomes null and
    its row stays; a line with the wrong number of cells is kept whole in
    ``_corrupt_record``.
    """
    known = {name.strip().lower(): (name, dtype) for name, dtype in types.items()}
    named = []
    header = _header(spark, path, encoding)
    for raw in header:
        plain = raw.strip(WHITESPACE)
        named.append(known.get(plain.lower(), (plain, T.StringType())))
    reader = (
        spark.read.schema(text_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        # a parser that skips unused cells would not notice lines with too few or too many
        .option("columnPruning", False)
        .option("escape", '"')
    )
    df = reader.csv(path).withColumnsRenamed({h: name for h, (name, _) in zip(header, named)})
    return cast_columns(blank_missing(df), dict(named))


def text_schema(names: list[str]) -> T.StructType:
    """All columns as text, with a place for lines that have the wrong number of cells."""
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt_record"]])


def cast_columns(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Text columns to their types; what does not parse becomes null. Whole numbers may be written "5.0"."""

    def typed(name: str, dtype: T.DataType):
        c = F.col(f"`{name}`")
        if isinstance(dtype, (T.IntegerType, T.LongType)):
            return F.coalesce(c.try_cast(dtype), c.try_cast("double").try_cast(dtype))
        return c.try_cast(dtype)

    changes = {n: typed(n, t) for n, t in types.items() if not isinstance(t, T.StringType)}
    return df.withColumns(changes) if changes else df


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: the order-item CSV (latin-1) with the operators' column names."""
    df = _read_known(spark, path, "ISO-8859-1", {f.name: f.dataType for f in schemas.ORDER_FILE.fields})
    return df.withColumnsRenamed(schemas.ORDER_COLUMNS)


def read_skus(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: the SKU CSV (utf-8) with the operators' column names."""
    df = _read_known(spark, path, "UTF-8", {k: dtype for k, (_, dtype) in schemas.SKU_COLUMNS.items()})
    return df.withColumnsRenamed({k: name for k, (name, _) in schemas.SKU_COLUMNS.items()})


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and the raw lines of those that did not."""
    if "_corrupt_record" not in df.columns:
        return df, empty_frame(df.sparkSession, "_corrupt_record string")
    # text sources refuse to answer from the raw line alone, so the test also looks at a cell
    first = F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit(""))
    bad = F.col("_corrupt_record").isNotNull() & (F.length(first) >= 0)
    good = F.col("_corrupt_record").isNull() & (F.length(first) >= 0)
    return df.filter(good).drop("_corrupt_record"), df.filter(bad).select("_corrupt_record")


def read_csv_with_fallback(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SRC5: each file as utf-8, or as latin-1 when some line of it is not valid utf-8.

    One aggregate over the lines, whose bytes are kept as they are, tells the
    files apart; types are those that fit all files. Files of either encoding
    are read together and have the same columns in the same order.
    """
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"'}

    def read(where, encoding: str, schema: T.StructType | None = None) -> DataFrame:
        reader = spark.read.options(**options, encoding=encoding)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(where)

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    files = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid")).collect()  # a row for each file
    plain, other = ([r["file"] for r in files if r["valid"] is not valid] for valid in (False, True))
    if not other or not plain:
        df = read(path, "ISO-8859-1" if other else "UTF-8")
    else:
        each = [read(plain, "UTF-8").schema, read(other, "ISO-8859-1").schema]
        types = [_common_type(f.dataType, g.dataType) for f, g in zip(*(x.fields for x in each))]
        schema = T.StructType([T.StructField(f.name, t) for f, t in zip(each[0].fields, types)])
        df = read(plain, "UTF-8", schema).unionByName(read(other, "ISO-8859-1", schema))
    return normalise_headers(blank_missing(df))


def _common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that values of both have: the wider number or time, else text."""
    for order in (["int", "bigint", "double"], ["date", "timestamp"]):
        if {a.simpleString(), b.simpleString()} <= set(order):
            return max(a, b, key=lambda t: order.index(t.simpleString()))
    return a if a == b else T.StringType()


#: What ends a fragment of a JSON array read in parallel.
_CLOSE = "}"


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the objects of JSON arrays, each as a text of its own; an array may be one line of any length.

    The bytes are cut at every closing brace, whatever it stands in, so Spark
    splits a file like any text. What a fragment does to the nesting depth
    depends on whether it begins inside a string, and whether the next one does
    follows from the number of its quotes; both are summed up per split, the
    sums handed on from split to split (a few numbers each), and a record ends
    where the depth comes back to that of the array. Elements of an array must
    be objects.
    """
    raw = spark.read.option("lineSep", _CLOSE).text(path)
    # an escaped character never opens, closes or ends anything
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"')
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        parts.alias("parts"),
    )

    def depth(side: int) -> Column:
        """What the fragment, its closing brace included, adds to the depth if it begins outside (0) or inside (1) a string."""
        bare = F.array_join(F.filter("parts", lambda x, i: i % 2 == side), "")
        count = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
        ends_outside = F.when((F.size("parts") - 1 + side) % 2 == 0, 1).otherwise(0)
        return (count("{[") - count("]") - ends_outside).cast("long")

    rows = rows.select("file", "block", "at", "value", (F.size("parts") - 1).cast("long").alias("quotes"), depth(0).alias("out"), depth(1).alias("in"))
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    for start in (0, 1):  # the depth if the split begins outside or inside a string
        rows = rows.withColumn(f"step{start}", F.when(F.col("odd") == start, F.col("out")).otherwise(F.col("in")))
        rows = rows.withColumn(f"depth{start}", F.sum(f"step{start}").over(upto))
    splits = rows.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("step0").alias("sum0"), F.sum("step1").alias("sum1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("begins", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("begins") == 0, F.col("sum0")).otherwise(F.col("sum1"))
    splits = splits.withColumn("own", own).select("file", "block", "begins", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    here = rows.join(splits, ["file", "block"])
    level = F.col("base") + F.when(F.col("begins") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    here = here.select("file", "block", "at", "value", (level == 1).cast("int").alias("ends"))
    here = here.withColumn("nth", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    totals = here.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    totals = totals.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = here.join(totals, ["file", "block"]).withColumn("record", F.col("first") + F.col("nth"))
    whole = numbered.groupBy("file", "record").agg(
        F.max("ends").alias("ended"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts")
    )
    text = F.concat(F.array_join(F.col("parts.value"), _CLOSE), F.lit(_CLOSE))
    return whole.where("ended = 1").select("file", F.regexp_replace(text, r"^[\s,\[]+", "").alias("value"))


def read_json_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: JSON arrays of objects, or JSON Lines; both are read in parallel, whatever the length of a line."""
    first = spark.read.option("lineSep", _CLOSE).text(path).filter(F.trim("value") != "").limit(1).collect()
    if not (first and first[0][0].lstrip(WHITESPACE).startswith("[")):
        return spark.read.json(path)
    records = materialise(array_records(spark, path).select("value"))
    strings = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(strings), spark)


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SRC3: dispatch on the suffix (or on ``fmt``): csv, tsv, json, parquet.

    An unknown suffix is tried as CSV; workbooks are not supported.
    """
    kind = (fmt or path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2]).lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return read_json_any(spark, path)
    if kind in ("xlsx", "xls"):
        raise ValueError(f"Unsupported file type: .{kind}")
    try:
        return read_csv_with_fallback(spark, path, "\t" if kind == "tsv" else ",")
    except Exception as error:
        if kind in ("csv", "tsv"):
            raise
        raise ValueError(f"Unsupported file type: .{kind}") from error


def read_order(place: bool = True) -> Column:
    """Where a row stands in the files read: file time, file, split and, unless on a stream, place in the split."""
    meta = F.col("_metadata")
    return F.struct(
        meta["file_modification_time"].alias("time"),
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
        *([F.monotonically_increasing_id().alias("place")] if place else []),
    )


def category_filter(orders: DataFrame, category: str) -> DataFrame:
    """SRC11: the orders of one category (the predicate reaches the scan)."""
    if "category" not in orders.columns:
        return orders
    return orders.filter(F.col("category") == category)
