from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillstone.llm.suffix_dedup import _two_hashes


def test_second_hash_is_no_function_of_the_first(spark):
    rows = spark.createDataFrame([(f"core {i}",) for i in range(20)], "core string").select(*_two_hashes(F.col("core"))).collect()
    chained = [xxh64_intdigest((1).to_bytes(4, "little"), g1 % (1 << 64)) for g1, _ in rows]
    assert all(a != g2 % (1 << 64) for a, (_, g2) in zip(chained, rows))
    old = spark.range(1).select(F.xxhash64(F.lit("core 0")), F.xxhash64(F.lit("core 0"), F.lit(1))).first()
    assert xxh64_intdigest((1).to_bytes(4, "little"), old[0] % (1 << 64)) == old[1] % (1 << 64)
