"""Registered queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geometry import cosine, dot, norm
from .functions.text import plain_tokens, stemmed
from .operators import fulltext, media
from .session import Engine
from .sources import files
from .sources.scratch import new_folder

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
}

#: Tables that only the statistics read, with any column as key.
COUNTED = {"lineitem": "l_orderkey", "labels": "doc_id", "conversations": "conv_id"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    engine = Engine(spark)
    for x in names:
        engine.register(x, _read(spark, sf_dir, x), (KEYS | COUNTED)[x])
    return engine


def _statement(text: str, *tables: str):
    """A query that runs one SELECT of the dialect over registered tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _engine(spark, sf_dir, *tables).sql(text)
        if out.data is None:
            raise ValueError(out.message)
        return out.data

    return run


# -- points and vectors


def _points(spark: SparkSession, sf_dir: str, dims: int) -> Engine:
    engine = Engine(spark)
    e = _read(spark, sf_dir, "embeddings")
    engine.register("points", e.select("vec_id", "label", F.slice("embedding", 1, dims).alias("place")), "vec_id")
    return engine


def _point_query(text: str, dims: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _points(spark, sf_dir, dims).sql(text).data.drop("place")

    return run


def _point_sql(dims: int, point: tuple[float, ...], where: str = "", tail: str = "") -> str:
    terms = " + ".join(f"(embedding[{i + 1}]::DOUBLE - ({x})) * (embedding[{i + 1}]::DOUBLE - ({x}))" for i, x in enumerate(point))
    return f"SELECT vec_id, label FROM (SELECT *, sqrt({terms}) AS dist FROM embeddings) {where} {tail}"


def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product and cosine of every vector with the first one, and its length."""
    e = _read(spark, sf_dir, "embeddings")
    one = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    both = e.join(one, F.lit(True))
    return both.select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("dot"), F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


# -- text


def _documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs if lang is None else docs.where(F.col("lang") == lang)


def _tf(spark: SparkSession, sf_dir: str, slices: int | None = None) -> DataFrame:
    return fulltext.term_counts(_documents(spark, sf_dir), "doc_id", F.col("text"), "simple", slices)


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(plain_tokens(F.col("text"), "simple")).cast("long").alias("n_tokens"))


def text_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tf(spark, sf_dir).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


def text_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, slices = fulltext.measured(_documents(spark, sf_dir), F.col("text"))
    return fulltext.inverse_frequencies(_tf(spark, sf_dir, slices), total).select("term", "df", F.round("idf", 6).alias("idf"))


def text_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fulltext.build(_documents(spark, sf_dir), "doc_id", F.col("text"), "simple", new_folder(spark, "text"))
    return index.norms.select("doc_id", F.round("norm", 6).alias("norm"))


QUERY = "the thonre ering tion reing with the haned"


#: Words and stems from the published sample vocabularies of the two stemming algorithms.
STEMS = {
    "english": {
        "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol",
        "consolatory": "consolatori", "consolidate": "consolid", "consolingly": "consol", "consonant": "conson", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci",
        "conspirators": "conspir", "constable": "constabl", "constancy": "constanc", "constant": "constant", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead",
        "kneeled": "kneel", "knees": "knee", "knife": "knife", "knightly": "knight", "knitted": "knit", "knives": "knive", "knockers": "knocker",
    },
    "spanish": {
        "cheque": "chequ", "chequeo": "cheque", "cheques": "chequ", "chetumaleños": "chetumaleñ", "cheyenne": "cheyenn", "chiapaneca": "chiapanec", "chiapas": "chiap", "chicana": "chican", "chicas": "chic",
        "chicharrones": "chicharron", "chichimecas": "chichimec", "chicles": "chicl", "torcer": "torc", "toreado": "tor", "toreándolo": "tor", "torear": "tor", "toreó": "tore", "toreros": "torer",
        "tormentas": "torment", "tornados": "torn", "tornen": "torn", "torneos": "torne", "tornillos": "tornill", "torniquete": "torniquet", "torpedearon": "torped", "torpeza": "torpez", "torrenciales": "torrencial",
        "torrente": "torrent", "torreón": "torreon", "torres": "torr",
    },
}


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems of the sample words; the tables are not read."""
    out = None
    for language, words in STEMS.items():
        rows = spark.createDataFrame([(w, w) for w in words], "word string, stem string")
        found = stemmed(rows, "stem", language).select(F.lit(language).alias("language"), "word", "stem")
        out = found if out is None else out.unionByName(found)
    return out


def _search(limit: int | None, language: str = "simple", lang: str | None = None, query: str = QUERY, virtual: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.register("docs", _documents(spark, sf_dir, lang), "doc_id")
        column = "text"
        if virtual:
            engine.sql("ALTER TABLE docs ADD COLUMN both AS CONCAT(source, text)")
            column = "both"
        engine.text_index("docs", column, language)
        found = engine.sql(f'SELECT doc_id FROM docs WHERE {column} @@ "{query}"' + (f" LIMIT {limit}" if limit else "")).data
        return found.select("doc_id", F.round("_text_score", 6).alias("score"))

    return run


def _tokens_sql(text: str = "text") -> str:
    return f"""
docs AS (SELECT doc_id, {text} AS text FROM documents),
words AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(lower(text), '[^\\p{{L}}\\s]', ' ', 'g')), '\\s+')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE length(term) > 1 GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM docs)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term),
norms AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM tf JOIN df USING (term) GROUP BY doc_id)"""


def _search_sql(query: str, tail: str = "", text: str = "text") -> str:
    counts: dict[str, int] = {}
    for w in query.split():
        counts[w] = counts.get(w, 0) + 1
    values = ", ".join(f"('{w}', {k})" for w, k in counts.items())
    return f"""WITH {_tokens_sql(text)},
q AS (SELECT t AS term, k * idf AS w FROM (VALUES {values}) v(t, k) JOIN df ON df.term = t WHERE idf > 0),
hit AS (SELECT doc_id, sum(w * tf * idf) AS dot FROM tf JOIN q USING (term) JOIN df USING (term) GROUP BY doc_id),
scored AS (SELECT doc_id, CASE WHEN norm > 0 THEN dot / (norm * (SELECT sqrt(sum(w * w)) FROM q)) ELSE 0 END AS exact FROM hit JOIN norms USING (doc_id))
SELECT doc_id, round(exact, 6) AS score FROM scored {tail}"""


# -- media: eight descriptors of eight numbers per embedding, sixteen fixed codewords


def _codewords() -> list[list[float]]:
    return [[round(0.15 * (((i >> (j % 4)) & 1) * 2 - 1) + 0.01 * j, 4) for j in range(8)] for i in range(16)]


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.explode(cut).alias("vector"))


def bovw_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.histograms(_descriptors(spark, sf_dir), _codewords()).select("key", "word", F.round("share", 6).alias("share"))


def bovw_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = media.histograms(_descriptors(spark, sf_dir), _codewords())
    return media.word_weights(hist, _read(spark, sf_dir, "embeddings").count()).select("word", F.round("idf", 6).alias("idf"))


def _bovw(scorer, k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hist = media.histograms(_descriptors(spark, sf_dir), _codewords())
        idf = media.word_weights(hist, _read(spark, sf_dir, "embeddings").count())
        best = media.most_similar(scorer(hist, idf, hist.where("key = 0").select("word", "share")).withColumn("score", F.round("score", 6)), k, "0")
        return best.select("key", "score")

    return run


def bovw_kmeans_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = media.codebook(_descriptors(spark, sf_dir), 16)
    return spark.createDataFrame([(i, w) for i, w in enumerate(book)], "word int, centre array<double>")


def _bovw_sql() -> str:
    gap = lambda w: " + ".join(f"(v[{j + 1}]::DOUBLE - ({x})) * (v[{j + 1}]::DOUBLE - ({x}))" for j, x in enumerate(w))
    gaps = ", ".join(gap(w) for w in _codewords())
    return f"""
parts AS (SELECT vec_id AS key, embedding[i * 8 + 1:i * 8 + 8] AS v FROM embeddings, (SELECT unnest(generate_series(0, 7)) AS i)),
near AS (SELECT key, [{gaps}] AS g FROM parts),
word AS (SELECT key, (list_position(g, list_min(g)) - 1)::INT AS word FROM near),
hist AS (SELECT key, word, count(*) / 8.0::DOUBLE AS share FROM word GROUP BY ALL),
idf AS (SELECT word, ln((SELECT count(*) FROM embeddings)::DOUBLE / count(*)) AS idf FROM hist GROUP BY word),
q AS (SELECT word, share * idf AS qw FROM hist JOIN idf USING (word) WHERE key = 0)"""


# -- tables: statements over a database made for the query


def _database(spark: SparkSession) -> Engine:
    return Engine(spark, new_folder(spark, "tables"))


def _done(result) -> None:
    for r in result if isinstance(result, list) else [result]:
        if (r.message or "").startswith("ERROR"):
            raise ValueError(r.message)


def _region(spark: SparkSession, sf_dir: str) -> Engine:
    engine = _database(spark)
    _done(engine.sql("CREATE TABLE region (r_regionkey INT KEY, r_name VARCHAR[20] INDEX BTREE)"))
    engine.insert("region", _read(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return engine


def insert_then_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _region(spark, sf_dir)
    _done(engine.sql('INSERT INTO region VALUES (77, "ATLANTIS"); INSERT INTO region (r_regionkey) VALUES (78)'))
    return engine.scan("region")


def insert_duplicate_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _region(spark, sf_dir)
    _done(engine.sql('INSERT INTO region VALUES (0, "SECOND")'))
    return engine.scan("region")


def _parts(spark: SparkSession, sf_dir: str) -> Engine:
    engine = _database(spark)
    _done(engine.sql("CREATE TABLE part (p_partkey INT KEY INDEX BTREE, p_name VARCHAR[80], p_brand VARCHAR[20] INDEX HASH, p_size INT, p_retailprice FLOAT)"))
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int"), "p_name", "p_brand", "p_size", F.col("p_retailprice").cast("float"))
    engine.insert("part", rows)
    return engine


def index_hash_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality in a HASH layout: one bucket's folder is read."""
    return _parts(spark, sf_dir).sql('SELECT p_partkey, p_brand FROM part WHERE p_brand = "Brand#23"').data


def index_btree_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range in a BTREE layout, made after the rows."""
    engine = _parts(spark, sf_dir)
    _done(engine.sql("CREATE INDEX ON part (p_size) USING BTREE"))
    return engine.sql("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20").data


def index_rtree_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radius in an RTREE layout of points."""
    engine = _database(spark)
    _done(engine.sql("CREATE TABLE points (vec_id INT KEY, label INT, place ARRAY[FLOAT, 2] INDEX RTREE)"))
    engine.insert("points", _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int"), "label", F.slice("embedding", 1, 2).alias("place")))
    return engine.radius("points", "place", (0.01, -0.02), 0.12).drop("place")


def dropped_and_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index, a virtual column and a table are dropped; another session of the same root finds the rest."""
    engine = _region(spark, sf_dir)
    _done(engine.sql("ALTER TABLE region ADD COLUMN both AS CONCAT(r_regionkey, r_name); DROP INDEX r_name ON region; ALTER TABLE region DROP COLUMN both"))
    _done(engine.sql("CREATE TABLE gone (id INT KEY); DROP TABLE gone"))
    again = Engine(spark, engine.catalog.root.rsplit("/", 1)[0])
    info = again.table_info("region")
    found = [(t, len(again.table_info(t)["indexes"]), len(info["virtual"]), info["key"]) for t in again.tables()]
    return spark.createDataFrame(found, "name string, indexes int, virtual int, key string").crossJoin(F.broadcast(again.scan("region").agg(F.count("*").alias("rows"))))


def trimmed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are trimmed and cut to their bytes, absent values become defaults."""
    engine = _database(spark)
    _done(engine.sql('CREATE TABLE t (id INT KEY, s VARCHAR[4], x FLOAT, d DATE); INSERT INTO t VALUES (1, "  ab  ", 1.5, "2020-01-02"); INSERT INTO t VALUES (2, "abcdef"); INSERT INTO t (id, s) VALUES (3, "ñandú")'))
    return engine.scan("t")


def delete_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _parts(spark, sf_dir)
    _done(engine.sql("DELETE FROM part WHERE p_size = 7"))
    return engine.sql("SELECT p_partkey, p_size FROM part").data


def delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _parts(spark, sf_dir)
    _done(engine.sql("DELETE FROM part WHERE p_partkey BETWEEN 10 AND 60"))
    return engine.sql("SELECT p_partkey, p_brand FROM part").data


def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _parts(spark, sf_dir).sql("DELETE FROM part WHERE p_size BETWEEN 1 AND 9; DELETE FROM part WHERE p_size BETWEEN 5 AND 12")
    _done(out)
    return spark.createDataFrame([(i, r.details["deleted"]) for i, r in enumerate(out)], "step int, deleted long")


def _csv(spark: SparkSession, rows: DataFrame, sep: str) -> str:
    """A CSV file of the rows, in key order."""
    lines = [sep.join(rows.columns), *(sep.join("" if v is None else str(v) for v in r) for r in rows.collect())]  # a table of at most some hundred rows
    path = f"{new_folder(spark, 'load')}/rows.csv"
    files.replace_text(spark, path, "\n".join(lines) + "\n")
    return path


def load_csv_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(spark, _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"), ",")
    engine = _database(spark)
    _done(engine.sql(f'CREATE TABLE nation (n_nationkey INT KEY, n_name VARCHAR[30], place ARRAY[FLOAT, 2]); LOAD DATA FROM FILE "{path}" INTO nation WITH MAPPING (place = ARRAY(n_nationkey, n_regionkey))'))
    return engine.scan("nation").select("n_nationkey", "n_name", F.get("place", F.lit(0)).alias("x"), F.get("place", F.lit(1)).alias("y"))


def load_csv_autokey(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(spark, _read(spark, sf_dir, "nation").select("n_name", "n_regionkey").orderBy("n_name"), ";")
    engine = _database(spark)
    _done(engine.sql(f'CREATE TABLE nation (id INT KEY, n_name VARCHAR[30], n_regionkey INT); LOAD DATA FROM FILE "{path}" INTO nation'))
    return engine.scan("nation")


def load_csv_badrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    rows = n.select(F.when(F.col("n_nationkey") % 5 == 0, F.lit("bad")).otherwise((F.col("n_nationkey") % 20).cast("string")).alias("id"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("n_name")).orderBy("n_nationkey")
    path = _csv(spark, rows, ",")
    engine = _database(spark)
    out = engine.sql(f'CREATE TABLE nation (id INT KEY, n_name VARCHAR[30]); LOAD DATA FROM FILE "{path}" INTO nation')
    _done(out)
    d = out[1].details
    return spark.createDataFrame([(d["added"], d["duplicates"], d["cast_err"])], "inserted long, duplicates long, cast_err long")


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, *KEYS, *COUNTED).stats()


QUERIES = {
    "scan_all": _statement("SELECT * FROM region", "region"),
    "project_columns": _statement("SELECT p_name, p_brand, p_size FROM part", "part"),
    "limit_pk_order": _statement("SELECT * FROM nation WHERE n_nationkey BETWEEN 0 AND 1000 LIMIT 7", "nation"),
    "pk_lookup": _statement("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = 77", "orders"),
    "pk_range": _statement("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900", "orders"),
    "eq_string": _statement('SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = "BUILDING"', "customer"),
    "eq_int": _statement("SELECT p_partkey, p_name FROM part WHERE p_size = 15", "part"),
    "eq_float32": lambda spark, sf_dir: (lambda e: (e.register("part", _read(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("float")), "p_partkey"), e.sql("SELECT p_partkey FROM part WHERE p_retailprice = 901.0").data)[1])(Engine(spark)),
    "between_int": _statement("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", "part"),
    "between_float": _statement("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100.5 AND 2500.25", "customer"),
    "between_varchar": _statement('SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN "B" AND "G"', "customer"),
    "between_date_iso": lambda spark, sf_dir: (lambda e: (e.register("orders", _read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "o_orderkey"), e.sql('SELECT * FROM orders WHERE day BETWEEN "1995-01-01" AND "1995-03-31"').data)[1])(Engine(spark)),
    "virtual_concat": lambda spark, sf_dir: (lambda e: (e.sql("ALTER TABLE part ADD COLUMN label AS CONCAT(p_name, p_brand, p_size)"), e.sql("SELECT p_partkey, label FROM part").data)[1])(_engine(spark, sf_dir, "part")),
    "insert_then_select": insert_then_select, "insert_duplicate_rejected": insert_duplicate_rejected, "delete_eq": delete_eq, "delete_range": delete_range, "delete_counts": delete_counts,
    "index_hash_eq": index_hash_eq, "index_btree_range": index_btree_range, "index_rtree_radius": index_rtree_radius, "dropped_and_reopened": dropped_and_reopened, "trimmed_values": trimmed_values,
    "load_csv_mapping": load_csv_mapping, "load_csv_autokey": load_csv_autokey, "load_csv_badrows": load_csv_badrows,
    "spatial_radius_2d": _point_query("SELECT * FROM points WHERE place IN ((0.01, -0.02), 0.12)", 2),
    "spatial_knn_2d": _point_query("SELECT * FROM points WHERE place NEAREST ((0.05, 0.1), 12)", 2),
    "spatial_knn_3d": _point_query("SELECT * FROM points WHERE place NEAREST ((0.0, 0.1, -0.1), 9)", 3),
    "spatial_point_eq": lambda spark, sf_dir: (lambda e: (e.register("points", _read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda v: F.round(v * 4) / 4).cast("array<float>").alias("place")), "vec_id"), e.sql("SELECT vec_id FROM points WHERE place = (0.25, 0.0)").data)[1])(Engine(spark)),
    "vector_cosine": vector_cosine,
    "text_tokens": text_tokens, "text_tf": text_tf, "text_df_idf": text_df_idf, "text_norms": text_norms,
    "fulltext_all": _search(None), "fulltext_topk": _search(10), "fulltext_virtual": _search(15, virtual=True),
    "fulltext_stemmed_es": _search(10, "spanish", "es", "que mente ciones los con"),
    "stems": stems,
    "bovw_histogram": bovw_histogram, "bovw_idf": bovw_idf, "bovw_seq_topk": _bovw(media.sequential_scores, 8), "bovw_inv_topk": _bovw(media.inverted_scores, 8), "bovw_kmeans_codebook": bovw_kmeans_codebook,
    "catalog_stats": catalog_stats,
}

ORACLES: dict[str, str] = {
    "scan_all": "SELECT * FROM region",
    "project_columns": "SELECT p_name, p_brand, p_size FROM part",
    "limit_pk_order": "SELECT * FROM nation ORDER BY n_nationkey LIMIT 7",
    "pk_lookup": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = 77",
    "pk_range": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900",
    "eq_string": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "eq_int": "SELECT p_partkey, p_name FROM part WHERE p_size = 15",
    "eq_float32": "SELECT p_partkey FROM part WHERE p_retailprice::FLOAT = 901.0::FLOAT",
    "between_int": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "between_float": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100.5 AND 2500.25",
    "between_varchar": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'",
    "between_date_iso": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1995-03-31'",
    "virtual_concat": "SELECT p_partkey, concat_ws(' ', trim(p_name), trim(p_brand), nullif(p_size, 0)::VARCHAR) AS label FROM part",
    "insert_then_select": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'ATLANTIS' UNION ALL SELECT 78, ''",
    "insert_duplicate_rejected": "SELECT r_regionkey, r_name FROM region",
    "delete_eq": "SELECT p_partkey::INT AS p_partkey, p_size FROM part WHERE p_size <> 7",
    "delete_range": "SELECT p_partkey::INT AS p_partkey, p_brand FROM part WHERE NOT p_partkey BETWEEN 10 AND 60",
    "delete_counts": "SELECT 0 AS step, count(*) AS deleted FROM part WHERE p_size BETWEEN 1 AND 9 UNION ALL SELECT 1, count(*) FROM part WHERE p_size BETWEEN 10 AND 12",
    "index_hash_eq": "SELECT p_partkey::INT AS p_partkey, p_brand FROM part WHERE p_brand = 'Brand#23'",
    "index_btree_range": "SELECT p_partkey::INT AS p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "index_rtree_radius": "SELECT vec_id::INT AS vec_id, label FROM (" + _point_sql(2, (0.01, -0.02), "WHERE dist <= 0.12") + ")",
    "dropped_and_reopened": "SELECT 'region' AS name, 0 AS indexes, 0 AS virtual, 'r_regionkey' AS key, count(*) AS rows FROM region",
    "trimmed_values": "SELECT * FROM (VALUES (1, 'ab', 1.5::FLOAT, '2020-01-02'), (2, 'abcd', 0::FLOAT, ''), (3, 'ñan', 0::FLOAT, '')) v(id, s, x, d)",
    "load_csv_mapping": "SELECT n_nationkey, n_name, n_nationkey::FLOAT AS x, n_regionkey::FLOAT AS y FROM nation",
    "load_csv_autokey": "SELECT (row_number() OVER (ORDER BY n_name))::INT AS id, n_name, n_regionkey FROM nation",
    "load_csv_badrows": """WITH t AS (SELECT n_nationkey % 20 AS id FROM nation WHERE n_nationkey % 5 <> 0)
SELECT count(DISTINCT id) AS inserted, count(*) - count(DISTINCT id) AS duplicates, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS cast_err FROM t""",
    "spatial_radius_2d": _point_sql(2, (0.01, -0.02), "WHERE dist <= 0.12"),
    "spatial_knn_2d": _point_sql(2, (0.05, 0.1), "", "ORDER BY dist, vec_id LIMIT 12"),
    "spatial_knn_3d": _point_sql(3, (0.0, 0.1, -0.1), "", "ORDER BY dist, vec_id LIMIT 9"),
    "spatial_point_eq": "SELECT vec_id FROM embeddings WHERE round(embedding[1] * 4) / 4 = 0.25 AND round(embedding[2] * 4) / 4 = 0",
    "vector_cosine": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0),
s AS (SELECT vec_id, list_inner_product(e, q) AS d, sqrt(list_inner_product(e, e)) AS n, sqrt(list_inner_product(q, q)) AS m FROM v, q)
SELECT vec_id, round(d, 6) AS dot, round(n, 6) AS norm, CASE WHEN n * m > 0 THEN round(d / (n * m), 6) ELSE 0 END AS cosine FROM s""",
    "text_tokens": f"WITH {_tokens_sql()} SELECT docs.doc_id, coalesce(sum(tf), 0)::BIGINT AS n_tokens FROM docs LEFT JOIN tf USING (doc_id) GROUP BY docs.doc_id",
    "text_tf": f"WITH {_tokens_sql()} SELECT doc_id, term, tf FROM tf",
    "text_df_idf": f"WITH {_tokens_sql()} SELECT term, df, round(idf, 6) AS idf FROM df",
    "text_norms": f"WITH {_tokens_sql()} SELECT doc_id, round(norm, 6) AS norm FROM norms",
    "fulltext_all": _search_sql(QUERY),
    "fulltext_topk": _search_sql(QUERY, "ORDER BY exact DESC, doc_id LIMIT 10"),
    "fulltext_virtual": _search_sql(QUERY, "ORDER BY exact DESC, doc_id LIMIT 15", "concat_ws(' ', trim(source), trim(text))"),
    "stems": "SELECT * FROM (VALUES " + ", ".join(f"('{language}', '{w}', '{x}')" for language, words in STEMS.items() for w, x in words.items()) + ") v(language, word, stem)",
    "bovw_histogram": f"WITH {_bovw_sql()} SELECT key, word, round(share, 6) AS share FROM hist",
    "bovw_idf": f"WITH {_bovw_sql()} SELECT word, round(idf, 6) AS idf FROM idf",
    "bovw_seq_topk": f"""WITH {_bovw_sql()}, s AS (SELECT key, coalesce(sum(share * qw), 0) AS dot, sqrt(sum(share * share)) AS norm FROM hist LEFT JOIN q USING (word) GROUP BY key)
SELECT key, round(dot / (norm * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS score FROM s WHERE key <> 0 ORDER BY score DESC, key LIMIT 8""",
    "bovw_inv_topk": f"""WITH {_bovw_sql()}, s AS (SELECT key, sum(share * idf * qw) AS dot, sqrt(sum((share * idf) * (share * idf))) AS norm FROM hist JOIN idf USING (word) LEFT JOIN (SELECT * FROM q WHERE qw > 0) p USING (word) GROUP BY key)
SELECT key, round(dot / (norm * (SELECT sqrt(sum(qw * qw)) FROM q WHERE qw > 0)), 6) AS score FROM s WHERE key <> 0 AND dot IS NOT NULL ORDER BY score DESC, key LIMIT 8""",
    "catalog_stats": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in (*KEYS, *COUNTED)),
}
