import random

import pytest

from quillstone.plans import nodes as n
from quillstone.session import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(count, seed=1):
    r = random.Random(seed)
    return [(i, f"c{r.randint(0, 30)}", r.randint(0, 500), [r.uniform(-60, 60), r.uniform(-180, 180)]) for i in range(count)]


SCHEMA = "id int, s string, k int, p array<float>"


def filled(engine, data):
    engine.sql("CREATE TABLE t (id INT KEY, s VARCHAR[9] INDEX HASH, k INT INDEX BTREE, p ARRAY[FLOAT] INDEX RTREE)")
    engine.insert("t", engine.spark.createDataFrame(data[:300], SCHEMA))
    engine.insert("t", engine.spark.createDataFrame(data[300:], SCHEMA))


def test_results_are_those_of_scans(engine):
    data = rows(700)
    filled(engine, data)
    got = lambda q: sorted(r.id for r in engine.sql(q).data.collect())
    for _ in range(2):
        assert got('SELECT id FROM t WHERE s = "c7"') == sorted(i for i, s, _, _ in data if s == "c7")
        assert got("SELECT id FROM t WHERE k BETWEEN 40 AND 90") == sorted(i for i, _, k, _ in data if 40 <= k <= 90)
        assert got("SELECT id FROM t WHERE k = 41") == sorted(i for i, _, k, _ in data if k == 41)
        near = [i for i, _, _, (a, b) in engine_points(engine, data) if (a - 10) ** 2 + (b - 20) ** 2 <= 900]
        assert got("SELECT id FROM t WHERE p IN ((10, 20), 30)") == sorted(near) and near
        engine.delete("t", "id", data[0][0])
        engine.range_delete("t", "k", 100, 200)
        data = [r for r in data[1:] if not 100 <= r[2] <= 200]
    assert engine.scan("t").count() == len(data)
    some = data[3]
    assert some[0] in got(f"SELECT id FROM t WHERE p = ({engine.search('t', 'id', some[0]).first().p[0]!r}, {engine.search('t', 'id', some[0]).first().p[1]!r})")


def engine_points(engine, data):
    import numpy as np

    return [(i, s, k, [float(np.float32(x)) for x in p]) for i, s, k, p in data]


def test_plans_prune(engine):
    filled(engine, rows(700))
    by_hash = engine.sql('SELECT id FROM t WHERE s = "c7"').data
    assert "PartitionFilters: [isnotnull(_bucket" in plan(by_hash)
    assert len(by_hash.collect()) and engine.sql('SELECT id FROM t WHERE s = "c7"').reads > 0
    result = engine.sql('SELECT id FROM t WHERE s = "c7"')
    result.rows()
    # a bucket's folder in each of two parts, not all sixteen
    assert 0 < result.breakdown["scanned_rows"] < 200
    ranged = engine.sql("SELECT id FROM t WHERE k BETWEEN 40 AND 90").data
    by_range = plan(ranged)
    assert all(".by.k/" in f for f in ranged.inputFiles()) and "GreaterThanOrEqual(k,40)" in by_range
    boxed = engine.sql("SELECT id FROM t WHERE p IN ((10, 20), 30)").data
    by_box = plan(boxed)
    assert all(".by.p/" in f for f in boxed.inputFiles()) and "GreaterThanOrEqual(_place0," in by_box


def test_vacuum_and_drop(engine, tmp_path):
    filled(engine, rows(700))
    engine.range_delete("t", "k", 0, 100)
    folder = tmp_path / "db" / "default" / "t"
    before = len(list(folder.iterdir()))
    assert engine.vacuum("t") > 0 and len(list(folder.iterdir())) < before
    assert engine.scan("t").count() == engine.sql("SELECT id FROM t WHERE k BETWEEN 0 AND 9999").data.count()
    engine.drop_index("t", "k")
    assert not list(folder.glob("*.by.k")) and engine.sql("SELECT id FROM t WHERE k BETWEEN 101 AND 120").data.count() > 0
    assert engine.create_index("t", "k", "BTREE").rebuilt
    assert list(folder.glob("*.by.k"))


def test_text_index_follows_the_table(engine):
    engine.create_table("d", [n.Column("id", n.Type("INT"), True), n.Column("a", n.Type("VARCHAR", 90))])
    put = lambda *r: engine.insert("d", engine.spark.createDataFrame(list(r), "id int, a string"))
    put((1, "gato negro"), (2, "perro blanco"))
    engine.create_index("d", "a", "INVERTED_TEXT")
    find = lambda q: [r.id for r in engine.match("d", "a", q).collect()]
    assert find("gato") == [1]
    put((3, "gato gato gris"), (4, "nada"))
    assert sorted(find("gato")) == [1, 3] and find("gris") == [3]
    # extended and rebuilt indexes agree
    extended = {r.id: round(r._text_score, 9) for r in engine.match("d", "a", "gato gris").collect()}
    engine.drop_index("d", "a")
    engine.create_index("d", "a", "INVERTED_TEXT")
    assert {r.id: round(r._text_score, 9) for r in engine.match("d", "a", "gato gris").collect()} == extended
    engine.delete("d", "id", 1)
    assert find("gato") == [3]
    again = Engine(engine.spark, engine.catalog.root.rsplit("/", 1)[0])
    assert [r.id for r in again.match("d", "a", "gato").collect()] == [3]


def test_envelope_and_calls(engine):
    filled(engine, rows(50))
    out = engine.sql("SELECT id FROM t WHERE id BETWEEN 3 AND 8")
    assert len(out.rows()) == 6 and out.metrics()["breakdown"]["rows"] == 6 and out.ms > 0
    assert engine.last_metrics()["operations"][0].startswith("Select: ")
    engine.add_virtual_column("t", "v", ["s", "k"])
    row = engine.search("t", "id", 5).first()
    assert engine.virtual_value("t", "v", 5) == f"{row.s} {row.k}" and engine.virtual_value("t", "v", 999) is None
    with engine.tracker.track("outer"):
        with engine.tracker.track("inner"):
            pass
    assert [x.split(":")[0] for x in engine.tracker.last.lines()] == ["outer", "  inner"]
    engine.drop_table("t")
    assert engine.tables() == []


def test_csv_with_and_without_broken_lines(engine, tmp_path):
    (tmp_path / "plain.csv").write_text("id,s\n" + "\n".join(f"{i},\"x, {i}\"" for i in range(1, 50)))
    (tmp_path / "broken.csv").write_text('id,s\n1,"two\nlines"\n2,"say ""hi"""\n3,plain\n')
    engine.sql(f'CREATE TABLE a (id INT KEY, s VARCHAR[20]); LOAD DATA FROM FILE "{tmp_path}/plain.csv" INTO a')
    assert {r.id: r.s for r in engine.scan("a").collect()} == {i: f"x, {i}" for i in range(1, 50)}
    engine.sql(f'CREATE TABLE b (id INT KEY, s VARCHAR[20]); LOAD DATA FROM FILE "{tmp_path}/broken.csv" INTO b')
    assert {r.id: r.s for r in engine.scan("b").collect()} == {1: "two\nlines", 2: 'say "hi"', 3: "plain"}
