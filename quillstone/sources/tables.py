"""Tables as lists of immutable Parquet parts, and the catalog that names them.

A table's rows are the rows of its parts. Inserting adds a part; deleting rewrites only the parts
that hold a matching row; the catalog file, replaced in one rename, says which parts are current.
Readers keep the parts they started with; vacuum() removes those that are no longer current. One writer
at a time is assumed.

Parts are sorted by key. A secondary index is a second layout of each part, made when the part is:
BTREE rows are range-partitioned and sorted by the column, so row groups prune by its statistics; HASH rows
lie in folders by a hash of the column, so equality reads one folder; RTREE rows are sorted along
a Z-order curve with each coordinate as a column of its own, so boxes prune row groups.
Layouts never change a result.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as n
from . import files


@dataclass
class Table:
    name: str
    columns: list[n.Column]
    key: str
    primary: str
    parts: list[str] = field(default_factory=list)
    #: column (or MULTIMEDIA) -> kind and options
    indexes: dict[str, dict] = field(default_factory=dict)
    virtual: dict[str, list[str]] = field(default_factory=dict)

    def column(self, name: str) -> n.Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name} has no column {name}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type), False) for c in self.columns])


def spark_type(of: n.Type) -> T.DataType:
    return {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "ARRAY": T.ArrayType(T.FloatType(), False)}.get(of.kind, T.StringType())


def default(of: n.Type):
    """What an absent value becomes; there are no nulls in tables."""
    return {"INT": 0, "FLOAT": 0.0, "ARRAY": [0.0] * (of.size or 2)}.get(of.kind, "")


def byte_limit(of: n.Type) -> int | None:
    return 10 if of.kind == "DATE" else of.size or 32 if of.kind == "VARCHAR" else None


def fitted(value: Column, of: n.Type) -> Column:
    """A text column without surrounding spaces, cut to the type's bytes."""
    limit = byte_limit(of)
    if limit is None:
        return value
    cut = F.make_valid_utf8(F.substring(value.cast("binary"), 1, limit).cast("string"))
    return F.trim(F.when(F.octet_length(value) > limit, cut).otherwise(value))


#: Index kinds that are layouts of parts, and the columns they add.
LAYOUTS = ("BTREE", "HASH", "RTREE")
BUCKET, PLACE, BUCKETS = "_bucket", "_place", 16


def _layout_path(part: str, column: str) -> str:
    return f"{part}.by.{column}"


def _bucket(value: Column) -> Column:
    return F.pmod(F.hash(value), F.lit(BUCKETS)).cast("int")


def _dims(table: Table, column: str) -> int:
    return table.column(column).type.size or 2


def z_order(column: str, dims: int) -> Column:
    """Interleaved leading bits of the coordinates, as a bit string: near points mostly share a prefix."""
    width = max(1, 60 // dims)
    bits = []
    for i in range(dims):
        x = F.get(column, F.lit(i)).cast("double")
        scaled = F.atan(x) / F.lit(3.141592653589793) + 0.5
        bits.append(F.lpad(F.bin(F.least(F.lit((1 << width) - 1), F.floor(scaled * (1 << width)))), width, "0"))
    return F.concat(*(F.substring(b, k + 1, 1) for k in range(width) for b in bits))


def pruned(df: DataFrame, kind: str, column: str, dims: int, low, high) -> DataFrame:
    """The rows of a layout that can lie between low and high (points: corner to corner), by the layout's own columns."""
    if kind == "HASH" and low is high:
        return df.where(F.col(BUCKET) == _bucket(low))
    if kind == "RTREE" and len(low) == dims:
        for i in range(dims):
            df = df.where(F.col(f"{PLACE}{i}").between(F.lit(low[i]).cast("float"), F.lit(high[i]).cast("float")))
    return df


class Catalog:
    """All tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/catalog.json"
        self.tables: dict[str, Table] = {}
        if files.exists(spark, self.path):
            for t in json.loads(files.read_text(spark, self.path)):
                t["columns"] = [n.Column(c["name"], n.Type(**c["type"]), c["key"], c["index"]) for c in t["columns"]]
                self.tables[t["name"]] = Table(**t)

    def save(self) -> None:
        files.replace_text(self.spark, self.path, json.dumps([asdict(t) for t in self.tables.values()], indent=1))

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    def create(self, table: Table) -> None:
        if table.name in self.tables:
            raise ValueError(f"table {table.name} exists")
        self.tables[table.name] = table
        self.save()

    def drop(self, name: str) -> None:
        self.table(name)
        del self.tables[name]
        self.save()
        files.remove(self.spark, f"{self.root}/{name}")

    def drop_index(self, table: Table, column: str) -> dict:
        gone = table.indexes.pop(column)
        self.save()
        for part in table.parts:
            files.remove(self.spark, _layout_path(part, column))
        return gone

    def add_layout(self, table: Table, column: str) -> None:
        """Write the layout of every part that table has so far."""
        for part in table.parts:
            self._write_layout(table, part, column)

    def _write_layout(self, table: Table, part: str, column: str) -> None:
        rows, kind = self.spark.read.schema(table.schema).parquet(part), table.indexes[column]["kind"]
        path = _layout_path(part, column)
        if kind == "BTREE":
            rows.repartitionByRange(column).sortWithinPartitions(column, table.key).write.parquet(path)
        elif kind == "HASH":
            hashed = rows.withColumn(BUCKET, _bucket(F.col(column)))
            # rebalanced: small buckets share a task, a bucket with a frequent value is split over several
            hashed.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, column).write.partitionBy(BUCKET).parquet(path)
        elif kind == "RTREE":
            placed = rows.withColumns({f"{PLACE}{i}": F.get(column, F.lit(i)) for i in range(_dims(table, column))})
            placed.withColumn(PLACE, z_order(column, _dims(table, column))).repartitionByRange(PLACE).sortWithinPartitions(PLACE, table.key).drop(PLACE).write.parquet(path)

    def read_by(self, table: Table, column: str) -> DataFrame:
        """The table's rows in the layout of a column, with the layout's own columns."""
        kind = table.indexes[column]["kind"]
        extra = [T.StructField(BUCKET, T.IntegerType())] if kind == "HASH" else [T.StructField(f"{PLACE}{i}", T.FloatType()) for i in range(_dims(table, column))] if kind == "RTREE" else []
        schema = T.StructType([*table.schema.fields, *extra])
        if not table.parts:
            return self.spark.createDataFrame([], schema)
        each = [self.spark.read.schema(schema).parquet(_layout_path(p, column)) for p in table.parts] if kind == "HASH" else [self.spark.read.schema(schema).parquet(*(_layout_path(p, column) for p in table.parts))]
        out = each[0]
        for df in each[1:]:
            out = out.unionByName(df)
        return out

    def vacuum(self, table: Table) -> int:
        """Delete the folders of parts that are no longer current; returns how many."""
        current = {p.rsplit("/", 1)[1] for p in table.parts}
        old = [x for x in files.children(self.spark, f"{self.root}/{table.name}") if x.split(".by.")[0] not in current]
        for x in old:
            files.remove(self.spark, f"{self.root}/{table.name}/{x}")
        return len(old)

    def read(self, table: Table) -> DataFrame:
        return self.spark.read.schema(table.schema).parquet(*table.parts) if table.parts else self.spark.createDataFrame([], table.schema)

    def write_part(self, table: Table, rows: DataFrame) -> str:
        """Write rows, sorted by key so that lookups and ranges prune row groups; the part isn't current yet."""
        path = f"{self.root}/{table.name}/part-{uuid.uuid4().hex}"
        rows.select(*(F.col(c.name) for c in table.columns)).sortWithinPartitions(table.key).write.parquet(path)
        for column, entry in table.indexes.items():
            if entry["kind"] in LAYOUTS:
                self._write_layout(table, path, column)
        return path

    def append(self, table: Table, rows: DataFrame) -> tuple[int, int]:
        """Add the rows whose keys are new, the first of each key; returns how many were added and refused.

        rows may have a column _order that says which is first.
        """
        order = F.col("_order") if "_order" in rows.columns else F.monotonically_increasing_id()
        rows = rows.withColumn("_order", order)
        total, low, high = rows.agg(F.count("*"), F.min(table.key), F.max(table.key)).first()
        first = rows.groupBy(table.key).agg(F.min_by(F.struct(*(F.col(c.name) for c in table.columns)), "_order").alias("_row")).select("_row.*")
        if table.parts:
            # only keys in the new rows' range are read; the range prunes files and row groups
            known = self.read(table).where(F.col(table.key).between(F.lit(low), F.lit(high))).select(table.key)
            first = first.join(known, table.key, "left_anti")
        path = self.write_part(table, first)
        added = self.spark.read.schema(table.schema).parquet(path).count()
        if added:
            table.parts = [*table.parts, path]
            self.save()
        else:
            for x in files.children(self.spark, f"{self.root}/{table.name}"):
                if x.startswith(path.rsplit("/", 1)[1]):
                    files.remove(self.spark, f"{self.root}/{table.name}/{x}")
        return added, total - added

    def delete(self, table: Table, condition: Column) -> int:
        """Remove the matching rows, rewriting only the parts that hold some; returns their number."""
        if not table.parts:
            return 0
        place = F.element_at(F.split("_metadata.file_path", "/"), -2)
        held = self.read(table).where(condition).groupBy(place.alias("part")).agg(F.count("*").alias("k")).collect()  # a row per part
        touched = {r["part"]: r["k"] for r in held}
        parts = []
        for path in table.parts:
            if path.rsplit("/", 1)[1] not in touched:
                parts.append(path)
                continue
            left = self.spark.read.schema(table.schema).parquet(path).where(~F.coalesce(condition, F.lit(False)))
            kept = self.write_part(table, left)
            if self.spark.read.schema(table.schema).parquet(kept).limit(1).count():
                parts.append(kept)
        if touched:
            table.parts = parts
            self.save()
        return sum(touched.values())

    def compact(self, table: Table) -> None:
        """Merge all parts into one, range-partitioned by key."""
        if len(table.parts) > 1:
            table.parts = [self.write_part(table, self.read(table).repartitionByRange(table.key))]
            self.save()
