"""CSV loading: header names matched to declared columns, array columns mapped from several.

A row whose number can't be read is skipped and counted; blank cells become the type's default; a
key that the header lacks is numbered from 1 in file order.

The file is split among tasks unless a quoted cell holds a line break (some line then has an odd number of
quotes), and parsed once: typed rows are kept in a scratch folder for the steps that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import nodes as n
from .files import first_line
from .scratch import new_folder
from .tables import Table, default, fitted, spark_type


def separator(header: str) -> str:
    return ";" if header.count(";") >= header.count(",") else ","


def _cell(name: str) -> Column:
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def _number(value: Column, of: str) -> Column:
    """Null only where the cell is not blank and no number of the type."""
    return F.when(value.isNull(), F.lit(0).cast(of)).otherwise(value.try_cast(of))


def _broken_lines(spark: SparkSession, path: str) -> bool:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def load(spark: SparkSession, table: Table, path: str, mapping: dict[str, tuple[str, ...]]) -> tuple[DataFrame, int]:
    """Typed rows with their order in column _order, and how many were unreadable."""
    sep = separator(first_line(spark, path))
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=_broken_lines(spark, path), escape='"', ignoreLeadingWhiteSpace=False).withColumn("_order", F.monotonically_increasing_id())
    header = set(raw.columns)
    out, checks = [], []
    for c in table.columns:
        if c.type.kind == "ARRAY":
            sources = list(mapping.get(c.name, ()))[: c.type.size or 2]
            items = [_number(_cell(s), "float") if s in header else F.lit(0.0).cast("float") for s in sources]
            value = F.array(*items, *[F.lit(0.0).cast("float")] * ((c.type.size or 2) - len(items)))
            checks += [i.isNotNull() for i in items]
        elif c.name in header and c.type.kind in ("INT", "FLOAT"):
            value = _number(_cell(c.name), spark_type(c.type).simpleString())
            checks.append(value.isNotNull())
        elif c.name in header:
            value = fitted(F.coalesce(_cell(c.name), F.lit("")), c.type)
        elif c.name == table.key:
            # the order of rows is their rank by position in the file
            value = None
        else:
            value = F.lit(default(c.type)).cast(spark_type(c.type))
        out.append((c.name, value))
    if any(v is None for _, v in out):
        raw = _numbered(raw)
        out = [(k, F.col("_number").cast("int") if v is None else v) for k, v in out]
    sound = checks[0] if checks else F.lit(True)
    for x in checks[1:]:
        sound = sound & x
    folder = new_folder(spark, "load")
    raw.select("_order", sound.alias("_sound"), *(v.alias(k) for k, v in out)).write.parquet(folder)
    marked = spark.read.parquet(folder)
    return marked.where("_sound").drop("_sound"), marked.where(~F.col("_sound")).count()


def _numbered(raw: DataFrame) -> DataFrame:
    """Column _number counts rows from 1: counts per partition first, then positions inside them."""
    from pyspark.sql import Window

    placed = raw.withColumn("_part", F.shiftright("_order", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    bases = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))  # a row per partition of the file
    within = F.col("_order").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(bases, "_part").withColumn("_number", F.col("_base") + within + 1)
