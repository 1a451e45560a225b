"""The rows that a codebook is fitted on: those of smallest place, found without gathering all."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.operators import media


def _exact(rows, per_key, total):
    of = defaultdict(list)
    for key, i, place in rows:
        of[key].append((place, i))
    return sorted(x for v in of.values() for x in sorted(v)[:per_key])[:total]


def _placed(spark, keys):
    rows = spark.range(0, 60_000, 1, 6).select(F.expr(keys).cast("long").alias("key"), F.col("id").alias("i"))
    return rows.withColumn("_place", F.xxhash64(F.lit(42), "i"))


@pytest.mark.parametrize(
    ("keys", "per_key", "total"),
    [
        ("id / 8", 1000, 3000),  # no key at its bound
        ("if(id % 10 < 9, 0, id)", 50, 3000),  # one key has nine tenths: more ranges are needed
        ("id % 3", 20, 3000),  # fewer rows than asked for, all ranges
        ("id / 8", 1000, 60_000),  # all rows
    ],
)
def test_the_first_places_are_taken(spark, keys, per_key, total):
    placed = _placed(spark, keys)
    got = [(r["_place"], r["i"]) for r in media.first_placed(placed, per_key, total).collect()]
    assert got == _exact([tuple(r) for r in placed.collect()], per_key, total)


def test_one_task_reads_little_more_than_the_sample(spark, monkeypatch):
    """Each of six tasks sent its first 3,000 rows to the one that makes the sample."""
    monkeypatch.setattr(media, "RANGE", 58, raising=False)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s for s in (found.apply(i) for found in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(found.size()))}
    had = stages()
    vector = F.array(*(F.rand(i) for i in range(4)))
    media.codebook(spark.range(0, 60_000, 1, 6).select((F.col("id") / 8).cast("long").alias("key"), vector.alias("vector")), 3, total=3000)
    alone = [s.shuffleReadRecords() for i, s in stages().items() if i not in had and s.numTasks() == 1]
    assert 3000 <= max(alone) < 10_000  # some stages count what they read twice


def test_the_codebook_repeats(spark):
    """The order of rows is that of their places, not of tasks."""
    rows = spark.range(0, 4000, 1, 4).select((F.col("id") / 8).cast("long").alias("key"), F.array(*(F.hash("id", F.lit(i)) / 2**31 for i in range(4))).alias("vector"))
    assert media.codebook(rows, 3) == media.codebook(rows.repartition(7), 3)
