"""The engine: scripts and calls in, lazy DataFrames out."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fulltext, media, spatial
from .plans import nodes as n
from .plans.parser import parse
from .sources import csv, files
from .sources.scratch import new_folder
from .sources.tables import LAYOUTS, Catalog, Table, default, fitted, pruned, spark_type


@dataclass
class Result:
    """What a statement gave: rows (lazy) or a message, and what it took so far.

    ms: to plan and write. reads, writes: files that the rows come from, and files written. rebuilt:
    an index was made or made anew. breakdown: the same by index ("primary" or a column).
    """

    data: DataFrame | None = None
    message: str | None = None
    ms: float = 0.0
    details: dict = field(default_factory=dict)
    writes: int = 0
    rebuilt: bool = False
    breakdown: dict = field(default_factory=dict)

    @property
    def reads(self) -> int:
        return len(self.data.inputFiles()) if self.data is not None else 0

    def rows(self) -> list:
        """All rows; the time to compute them is added to ms, and breakdown gets what the plan's scans read."""
        if self.data is None:
            return []
        begun = time.perf_counter()
        out = self.data.collect()
        self.ms += (time.perf_counter() - begun) * 1000
        self.breakdown = {**self.breakdown, "rows": len(out), **plan_metrics(self.data)}
        return out

    def metrics(self) -> dict:
        """The envelope as plain values."""
        return {"ms": self.ms, "reads": self.reads, "writes": self.writes, "total": self.reads + self.writes, "rebuilt": self.rebuilt, "breakdown": self.breakdown}

    def summary(self) -> str:
        return f"{self.message or 'rows'} ({self.ms:.4f} ms)"


def plan_metrics(df: DataFrame) -> dict:
    """Files, rows and bytes that the scans of a frame's executed plan have read."""
    found = {"files": 0, "scanned_rows": 0, "bytes": 0}
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            for key, metric in (("files", "numFiles"), ("scanned_rows", "numOutputRows"), ("bytes", "filesSize")):
                held = node.metrics().get(metric)
                found[key] += held.get().value() if held.isDefined() else 0
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@dataclass
class Operation:
    """One operation and those inside it."""

    name: str
    ms: float = 0.0
    inner: list[Operation] = field(default_factory=list)

    def lines(self, depth: int = 0) -> list[str]:
        return [f"{'  ' * depth}{self.name}: {self.ms:.4f} ms", *(x for o in self.inner for x in o.lines(depth + 1))]


class Tracker:
    """Nested operations: each with block is one, and what runs inside belongs to it."""

    def __init__(self) -> None:
        self.open: list[Operation] = []
        self.last: Operation | None = None

    @contextmanager
    def track(self, name: str) -> Iterator[Operation]:
        own, begun = Operation(name), time.perf_counter()
        self.open.append(own)
        try:
            yield own
        finally:
            self.open.pop()
            own.ms = (time.perf_counter() - begun) * 1000
            if self.open:
                self.open[-1].inner.append(own)
            else:
                self.last = own


class Engine:
    """A database under a root folder, or views over frames that other code brings."""

    def __init__(self, spark: SparkSession, root: str | None = None, name: str = "default"):
        self.spark = spark
        self.catalog = Catalog(spark, f"{root.rstrip('/')}/{name}") if root else None
        self.views: dict[str, tuple[DataFrame, str]] = {}
        self.text_indexes: dict[tuple[str, str], fulltext.TextIndex] = {}
        self.virtual: dict[str, dict[str, list[str]]] = {}
        self.tracker = Tracker()
        self.last: Result | None = None

    # -- scripts

    def sql(self, text: str) -> Result | list[Result]:
        """Run a script. A syntax error rejects all of it; a failing statement becomes its own ERROR message."""
        out = []
        for statement in parse(text):
            try:
                out.append(self.execute(statement))
            except Exception as e:
                if isinstance(statement, (n.Select, n.Insert, n.Delete, n.LoadData, n.CreateTable)):
                    out.append(Result(message=f"ERROR: {type(e).__name__}: {e}", details={"error": e}))
                else:
                    out.append(Result(message=f"ERROR: {e}", details={"error": e}))
        return out[0] if len(out) == 1 else out

    def execute(self, s: n.Statement) -> Result:
        begun = time.perf_counter()
        run = {n.CreateTable: self._create, n.LoadData: self._load, n.Select: self._select, n.Insert: self._insert, n.Delete: self._delete, n.CreateIndex: self._create_index,
               n.DropTable: self._drop_table, n.DropIndex: self._drop_index, n.AddVirtual: self._add_virtual, n.DropVirtual: self._drop_virtual}[type(s)]
        name = type(s).__name__
        with self.tracker.track(name):
            out = run(s)
        self.last = replace(out, ms=(time.perf_counter() - begun) * 1000)
        return self.last

    def last_metrics(self) -> dict:
        """The envelope of the last statement, with its nested operations."""
        own = self.last.metrics() if self.last else {}
        return own | {"operations": self.tracker.last.lines() if self.tracker.last else []}

    # -- views over outside frames

    def register(self, name: str, df: DataFrame, key: str) -> None:
        """Query a frame as a table; it can't be changed."""
        self.views[name] = (df, key)

    def frame(self, name: str) -> tuple[DataFrame, str, Table | None]:
        if name in self.views:
            return (*self.views[name], None)
        table = self._table(name)
        return self.catalog.read(table), table.key, table

    def _table(self, name: str) -> Table:
        if self.catalog is None:
            raise KeyError(f"no table {name}")
        return self.catalog.table(name)

    def _virtuals(self, name: str, table: Table | None) -> dict[str, list[str]]:
        return table.virtual if table else self.virtual.get(name, {})

    # -- definitions

    def _create(self, s: n.CreateTable) -> Result:
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names):
            raise ValueError("a column name occurs twice")
        marked = [c for c in s.columns if c.key] or [c for c in s.columns if c.type.kind == "INT"]
        if not marked:
            raise ValueError("a table needs an INT column as its key")
        key = marked[0]
        asked = (key.index or "ISAM").upper()
        primary = asked if asked in n.PRIMARY_KINDS else "BTREE"
        table = Table(s.table, list(s.columns), key.name, primary)
        self.catalog.create(table)
        problems = []
        for c in s.columns:
            if c.index and c.name != key.name:
                try:
                    self._create_index(n.CreateIndex(s.table, c.name, c.index))
                except Exception as e:
                    problems.append(f"{c.name}:{c.index} ({e})")
        return Result(message=f"OK: table {s.table} created (primary={primary}, key={key.name})" + (f"; indexes not made: {', '.join(problems)}" if problems else ""))

    def _drop_table(self, s: n.DropTable) -> Result:
        self.catalog.drop(s.table)
        self.text_indexes = {k: v for k, v in self.text_indexes.items() if k[0] != s.table}
        return Result(message=f"OK: table {s.table} dropped")

    def _create_index(self, s: n.CreateIndex) -> Result:
        """Text and media indexes are built; the others are how parts are laid out, and change no result."""
        table = self._table(s.table)
        if s.kind in n.MEDIA_KINDS:
            if s.feature not in n.FEATURES:
                raise ValueError(f"no feature {s.feature}")
            if "MULTIMEDIA" in table.indexes:
                raise ValueError(f"{s.table} has a media index")
            if media.type_of(s.pattern or "{id}.jpg") not in (None, media.kind_of(s.feature)):
                raise ValueError(f"{s.feature} describes {media.kind_of(s.feature)} files")
            table.indexes["MULTIMEDIA"] = {"kind": s.kind, "feature": s.feature, "directory": s.directory, "pattern": s.pattern}
            try:
                self._build_media(table)
            except Exception:
                del table.indexes["MULTIMEDIA"]
                raise
        else:
            if s.column is None:
                raise ValueError("the index needs a column")
            if s.column == table.key:
                raise ValueError("the key has its primary index")
            if s.column in table.indexes:
                raise ValueError(f"{s.column} has an index")
            if s.kind not in ("BTREE", "HASH", "RTREE", "INVERTED_TEXT"):
                raise ValueError(f"{s.kind} is no secondary index")
            if s.column in table.virtual:
                if s.kind != "INVERTED_TEXT":
                    raise ValueError("virtual columns take text indexes only")
            else:
                kind = table.column(s.column).type.kind
                if s.kind == "RTREE" and kind != "ARRAY":
                    raise ValueError("RTREE needs an ARRAY column")
                if s.kind == "INVERTED_TEXT" and kind not in ("VARCHAR", "DATE"):
                    raise ValueError("INVERTED_TEXT needs a text column")
            if s.kind == "INVERTED_TEXT":
                table.indexes[s.column] = {"kind": s.kind, "language": s.language}
                try:
                    self._build_text(table, s.column)
                except Exception:
                    del table.indexes[s.column]
                    raise
            else:
                table.indexes[s.column] = {"kind": s.kind}
                with self.tracker.track(f"layout {s.column}"):
                    self.catalog.add_layout(table, s.column)
        self.catalog.save()
        return Result(message=f"OK: {s.kind} index on {s.table}" + (f" ({s.column})" if s.column else ""), writes=len(table.parts), rebuilt=True)

    def _drop_index(self, s: n.DropIndex) -> Result:
        table = self._table(s.table)
        if s.column == table.key:
            raise ValueError("the primary index can't be dropped")
        if s.column not in table.indexes:
            raise KeyError(f"{s.table} has no index {s.column}")
        gone = self.catalog.drop_index(table, s.column)
        self.text_indexes.pop((s.table, s.column), None)
        if gone.get("path"):
            files.remove(self.spark, gone["path"])
        return Result(message=f"OK: index {s.column} on {s.table} dropped")

    def _add_virtual(self, s: n.AddVirtual) -> Result:
        if s.table in self.views:
            held, known = self.virtual.setdefault(s.table, {}), self.views[s.table][0].columns
        else:
            table = self._table(s.table)
            held, known = table.virtual, [c.name for c in table.columns]
        if s.column in held or s.column in known:
            raise ValueError(f"column {s.column} exists")
        if missing := [x for x in s.sources if x not in known]:
            raise KeyError(f"no columns {', '.join(missing)}")
        held[s.column] = list(s.sources)
        if s.table not in self.views:
            self.catalog.save()
        return Result(message=f"OK: column {s.column} added")

    def _drop_virtual(self, s: n.DropVirtual) -> Result:
        table = None if s.table in self.views else self._table(s.table)
        held = self._virtuals(s.table, table)
        if s.column not in held:
            raise KeyError(f"{s.column} is no virtual column")
        if table and s.column in table.indexes:
            raise ValueError(f"{s.column} is indexed")
        del held[s.column]
        if table:
            self.catalog.save()
        return Result(message=f"OK: column {s.column} dropped")

    # -- rows

    def _value(self, value: n.Literal, c: n.Column) -> Column:
        if value is None:
            return F.lit(default(c.type)).cast(spark_type(c.type))
        if c.type.kind == "ARRAY":
            point = list(value) if isinstance(value, tuple) else None
            if point is None or len(point) != (c.type.size or 2):
                raise ValueError(f"{c.name} takes points of {c.type.size or 2} numbers")
            return F.array(*(F.lit(float(x)).cast("float") for x in point))
        if c.type.kind in ("INT", "FLOAT"):
            if isinstance(value, (str, tuple)):
                raise ValueError(f"{c.name} takes numbers")
            return F.lit(value).cast(spark_type(c.type))
        return fitted(F.lit(str(value)), c.type)

    def _insert(self, s: n.Insert) -> Result:
        table = self._table(s.table)
        names = list(s.columns) if s.columns else [c.name for c in table.columns]
        if len(s.values) > len(names) or (s.columns and len(s.values) != len(names)):
            raise ValueError("more values than columns" if len(s.values) > len(names) else "columns and values differ in number")
        for x in names:
            table.column(x)
        given = dict(zip(names, s.values, strict=False))
        row = self.spark.range(1).select(*(self._value(given.get(c.name), c).alias(c.name) for c in table.columns))
        return self.insert(s.table, row)

    def insert(self, name: str, rows: DataFrame) -> Result:
        """Add rows of a frame with the table's columns."""
        added, refused = self.catalog.append(self._table(name), rows)
        return Result(message="OK" if added and not refused else "duplicate, not inserted" if not added else f"OK ({refused} duplicates)", details={"added": added, "duplicates": refused})

    def _load(self, s: n.LoadData) -> Result:
        table = self._table(s.table)
        rows, unreadable = csv.load(self.spark, table, s.path, s.mapping)
        added, refused = self.catalog.append(table, rows)
        return Result(message=f"CSV loaded: inserted={added}, duplicates={refused}, cast_err={unreadable}", details={"added": added, "duplicates": refused, "cast_err": unreadable})

    def _delete(self, s: n.Delete) -> Result:
        if not isinstance(s.where, (n.Equals, n.Between)):
            raise NotImplementedError("DELETE takes = and BETWEEN")
        table = self._table(s.table)
        gone = self.catalog.delete(table, self._condition(self.catalog.read(table), s.where, table))
        return Result(message=f"OK ({gone} rows)", details={"deleted": gone})

    # -- queries

    def _condition(self, df: DataFrame, p: n.Equals | n.Between, table: Table | None) -> Column:
        """Literals take the column's type, so comparisons are the column's own and reach the scan."""
        kind = df.schema[p.column].dataType
        column = F.col(p.column)

        def literal(value):
            if isinstance(value, tuple):
                return F.array(*(F.lit(float(x)).cast(kind.elementType) for x in value))
            return F.lit(value).cast(kind)

        if isinstance(p, n.Equals):
            return column == literal(p.value)
        return column.between(literal(p.low), literal(p.high))

    def _concat(self, df: DataFrame, sources: list[str]) -> Column:
        """Values joined by a space; numbers that are zero are left out, empty texts are not."""
        parts = []
        for x in sources:
            kind = df.schema[x].dataType.simpleString()
            parts.append(F.trim(F.col(x)) if kind == "string" else F.nullif(F.col(x), F.lit(0).cast(kind)).cast("string") if kind in ("int", "bigint", "float", "double", "smallint") else F.col(x).cast("string"))
        return F.concat_ws(" ", *parts)

    def _text(self, name: str, table: Table | None, column: str) -> Column:
        df = self.catalog.read(table) if table else self.views[name][0]
        virtual = self._virtuals(name, table)
        return self._concat(df, virtual[column]) if column in virtual else F.col(column)

    def text_index(self, name: str, column: str, language: str | None = None) -> fulltext.TextIndex:
        """The index of a table's column; for views it is made when first asked for."""
        df, key, table = self.frame(name)
        entry = table.indexes.get(column, {}) if table else {}
        if entry.get("kind") == "INVERTED_TEXT" and entry.get("parts") != table.parts:
            self._build_text(table, column)
        if (name, column) in self.text_indexes:
            return self.text_indexes[name, column]
        if table is None:
            made = fulltext.build(df, key, self._text(name, None, column), language or "spanish", new_folder(self.spark, "text"))
        else:
            entry = table.indexes.get(column, {})
            if entry.get("kind") != "INVERTED_TEXT":
                raise ValueError(f"{name}.{column} has no INVERTED_TEXT index")
            made = fulltext.opened(self.spark, entry["path"], table.key, entry["language"])
        self.text_indexes[name, column] = made
        return made

    def _build_text(self, table: Table, column: str) -> None:
        """Write the index of the current parts beside what was there, then make it current.

        Parts that were only added since are analysed alone and their postings joined to the old ones.
        """
        entry = table.indexes[column]
        path = f"{self.catalog.root}/{table.name}.index.{column}.{len(table.parts)}-{time.time_ns()}"
        had = entry.get("parts")
        with self.tracker.track(f"text index {column}"):
            added = [p for p in table.parts if p not in had] if had is not None and set(had) <= set(table.parts) else None
            text = self._text(table.name, table, column)
            if added is None:
                made = fulltext.build(self.catalog.read(table), table.key, text, entry["language"], path)
            else:
                fresh = self.catalog.read(replace(table, parts=added))
                old = fulltext.opened(self.spark, entry["path"], table.key, entry["language"])
                made = fulltext.extended(old, fresh, text, self.catalog.read(table).count(), path)
        old_path = entry.get("path")
        entry |= {"path": path, "parts": list(table.parts)}
        self.text_indexes[table.name, column] = made
        self.catalog.save()
        if old_path:
            files.remove(self.spark, old_path)

    def _layout(self, df: DataFrame, table: Table | None, p: n.Equals | n.Between | n.Within) -> DataFrame:
        """The rows where the predicate can hold, read in the column's own layout if it has one."""
        kind = table.indexes.get(p.column, {}).get("kind") if table else None
        if kind not in LAYOUTS or (kind == "HASH" and not isinstance(p, n.Equals)):
            return df
        out, of = self.catalog.read_by(table, p.column), df.schema[p.column].dataType
        if kind == "HASH" and not isinstance(p.value, tuple):
            value = F.lit(p.value).cast(of)
            return pruned(out, kind, p.column, 0, value, value)
        if kind == "RTREE" and isinstance(p, (n.Equals, n.Within)) and isinstance(at := getattr(p, "point", getattr(p, "value", None)), tuple):
            by = abs(float(p.radius)) if isinstance(p, n.Within) else 0.0
            edge = lambda x, to: float(np.nextafter(np.float32(x), np.float32(to)))  # noqa: E731  outwards, so that rounding loses no row
            low, high = [edge(float(x) - by, -np.inf) for x in at], [edge(float(x) + by, np.inf) for x in at]
            return pruned(out, kind, p.column, table.column(p.column).type.size or 2, low, high)
        return out

    def _select(self, s: n.Select) -> Result:
        df, key, table = self.frame(s.table)
        virtual = self._virtuals(s.table, table)
        p, limit = s.where, s.limit
        extra: list[str] = []
        if isinstance(p, (n.Equals, n.Between)):
            if p.column in virtual:
                df = df.withColumn(p.column, self._concat(df, virtual[p.column]))
            df = self._layout(df, table, p).where(self._condition(df, p, table))
            df = df.orderBy(p.column, key) if isinstance(p, n.Between) else df
        elif isinstance(p, n.Within):
            df = spatial.within(self._layout(df, table, p), p.column, p.point, p.radius)
        elif isinstance(p, n.Nearest):
            df = spatial.nearest(df, p.column, p.point, p.k, key)
        elif isinstance(p, n.Matches):
            df, extra = fulltext.search(df, self.text_index(s.table, p.column), p.query), ["_text_score"]
        elif isinstance(p, n.SimilarTo):
            df, extra, limit = self._similar(table, df, key, p.path, 10 if limit is None else limit), ["_multimedia_score"], None
        made = {v: self._concat(self.frame(s.table)[0], src) for v, src in virtual.items()}
        physical = [c for c in self.frame(s.table)[0].columns]
        wanted = [*physical, *virtual] if s.columns is None else list(s.columns)
        if missing := [c for c in wanted if c not in physical and c not in virtual]:
            raise KeyError(f"{s.table} has no columns {', '.join(missing)}")
        out = df.select(*((made[c].alias(c) if c in made else F.col(c)) for c in wanted), *extra)
        return Result(data=out if limit is None else out.limit(limit))

    # -- media

    def _media(self, place: str, feature: str) -> DataFrame:
        """Files (name, then content, or the image that Spark decoded) of the feature's media."""
        kind = media.kind_of(feature)
        source = self.spark.read.format("image").option("dropInvalid", True) if kind == "image" else self.spark.read.format("binaryFile")
        path, held = ("image.origin", "image") if kind == "image" else ("path", "content")
        return source.load(place).where(media.media_type(F.col(path)) == kind).select(F.element_at(F.split(path, "/"), -1).alias("file"), held)

    def _media_files(self, table: Table, entry: dict) -> DataFrame:
        name = media.file_name(entry["pattern"] or "{id}.jpg", table.key, [c.name for c in table.columns])
        rows = self.catalog.read(table).select(F.col(table.key).alias("key"), name.alias("file"))
        return rows.join(self._media(entry["directory"], entry["feature"]), "file")

    def _build_media(self, table: Table, words: int = 300) -> None:
        import json

        entry = table.indexes["MULTIMEDIA"]
        base = f"{self.catalog.root}/{table.name}.index.MULTIMEDIA"
        with self.tracker.track("descriptors"):
            media.extract(self._media_files(table, entry), entry["feature"]).write.mode("overwrite").parquet(f"{base}/descriptors")
        found = self.spark.read.parquet(f"{base}/descriptors")
        with self.tracker.track("codebook"):
            book = media.codebook(found, words)
        files.replace_text(self.spark, f"{base}/codebook.json", json.dumps(book))
        with self.tracker.track("histograms"):
            media.histograms(found, book).write.mode("overwrite").parquet(f"{base}/histograms")
        hist = self.spark.read.parquet(f"{base}/histograms")
        media.word_weights(hist, hist.select("key").distinct().count()).write.mode("overwrite").parquet(f"{base}/weights")
        entry["path"] = base

    def _similar(self, table: Table | None, df: DataFrame, key: str, path: str, k: int) -> DataFrame:
        import json

        entry = table.indexes.get("MULTIMEDIA") if table else None
        if entry is None:
            raise ValueError("the table has no media index")
        base, stem = entry["path"], path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        book, hist = json.loads(files.read_text(self.spark, f"{base}/codebook.json")), self.spark.read.parquet(f"{base}/histograms")
        idf = self.spark.read.parquet(f"{base}/weights")
        whole = path if "/" in path else f"{entry['directory'].rstrip('/')}/{path}"
        if not files.exists(self.spark, whole):
            return df.withColumn("_multimedia_score", F.lit(0.0)).limit(0)
        content = self._media(whole, entry["feature"]).withColumn("key", F.lit(0))
        query = media.histograms(media.extract(content, entry["feature"]), book)
        scorer = media.inverted_scores if entry["kind"] == "MULTIMEDIA_INV" else media.sequential_scores
        best = media.most_similar(scorer(hist, idf, query), k, stem)
        return df.join(best.select(F.col("key").alias(key), F.col("score").alias("_multimedia_score")), key).orderBy(F.desc("_multimedia_score"), key)

    # -- calls

    def search(self, name: str, column: str, value: n.Literal) -> DataFrame:
        return self._select(n.Select(name, None, n.Equals(column, value))).data

    def between(self, name: str, column: str, low: n.Literal, high: n.Literal) -> DataFrame:
        return self._select(n.Select(name, None, n.Between(column, low, high))).data

    def radius(self, name: str, column: str, point: Iterable[float], radius: float) -> DataFrame:
        return self._select(n.Select(name, None, n.Within(column, tuple(point), radius))).data

    def knn(self, name: str, column: str, point: Iterable[float], k: int) -> DataFrame:
        return self._select(n.Select(name, None, n.Nearest(column, tuple(point), k))).data

    def match(self, name: str, column: str, query: str, limit: int | None = None) -> DataFrame:
        return self._select(n.Select(name, None, n.Matches(column, query), limit)).data

    def create_table(self, name: str, columns: Iterable[n.Column]) -> Result:
        return self.execute(n.CreateTable(name, tuple(columns)))

    def create_index(self, name: str, column: str | None, kind: str, **options) -> Result:
        return self.execute(n.CreateIndex(name, column, kind, **options))

    def drop_index(self, name: str, column: str) -> Result:
        return self.execute(n.DropIndex(column, name))

    def drop_table(self, name: str) -> Result:
        return self.execute(n.DropTable(name))

    def delete(self, name: str, column: str, value: n.Literal) -> Result:
        return self.execute(n.Delete(name, n.Equals(column, value)))

    def range_delete(self, name: str, column: str, low: n.Literal, high: n.Literal) -> Result:
        return self.execute(n.Delete(name, n.Between(column, low, high)))

    def add_virtual_column(self, name: str, column: str, sources: Iterable[str]) -> Result:
        return self.execute(n.AddVirtual(name, column, tuple(sources)))

    def virtual_value(self, name: str, column: str, key: n.Literal) -> str | None:
        """The value of a virtual column in the row of a key."""
        df, own, table = self.frame(name)
        sources = self._virtuals(name, table)[column]
        row = df.where(self._condition(df, n.Equals(own, key), table)).select(self._concat(df, sources)).first()
        return row[0] if row else None

    def media_statistics(self, name: str) -> dict:
        """Rows, descriptors, words and mean words a row of a table's media index."""
        entry = self._table(name).indexes["MULTIMEDIA"]
        hist = self.spark.read.parquet(f"{entry['path']}/histograms")
        rows, pairs, words = hist.agg(F.count_distinct("key"), F.count("*"), F.count_distinct("word")).first()
        return {"kind": entry["kind"], "feature": entry["feature"], "rows": rows, "descriptors": self.spark.read.parquet(f"{entry['path']}/descriptors").count(), "words": words, "words_per_row": pairs / rows if rows else 0.0}

    def vacuum(self, name: str) -> int:
        """Delete the folders that no current part needs; queries planned before may lose theirs."""
        return self.catalog.vacuum(self._table(name))

    def scan(self, name: str) -> DataFrame:
        return self._select(n.Select(name, None)).data

    def preview(self, name: str, rows: int = 100) -> DataFrame:
        return self.scan(name).limit(rows)

    def warm_up(self, name: str) -> None:
        """Keep a table's text indexes in memory and on executors' disks."""
        for (table, _), index in self.text_indexes.items():
            if table == name:
                for df in (index.postings, index.terms, index.norms):
                    df.persist()

    def tables(self) -> list[str]:
        return [*(self.catalog.tables if self.catalog else ()), *self.views]

    def table_info(self, name: str) -> dict:
        t = self._table(name)
        return {"name": name, "key": t.key, "primary": t.primary, "columns": {c.name: c.type for c in t.columns}, "indexes": t.indexes, "virtual": t.virtual, "parts": len(t.parts)}

    def stats(self) -> DataFrame:
        """(table, rows) of all tables."""
        counts = [self.frame(x)[0].agg(F.count("*").alias("rows")).select(F.lit(x).alias("table"), "rows") for x in self.tables()]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out
