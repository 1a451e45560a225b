"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate that makes its expected share of the output equal its
target weight. A document's count inverts the Poisson distribution function of its source's rate
at a uniform number hashed from its id, so counts don't depend on partitions, order or retries.
Documents are exploded by their counts and dealt out globally in hash order.

Only DataFrame functions are used. A hot source is a map-side count. The distribution tables hold a
few dozen numbers per source; up to ``send`` numbers in all they are sent to all tasks, and texts move
once, to the place their hash names; beyond that documents are joined by source, and adaptive execution
splits the hot ones.

Cases: a null source is a source of its own; a null doc_id hashes as the word null; rows that
repeat an id get equal counts, each for itself (those without id are placed by their texts, so they fill
no one partition); sources that the targets don't name have weight
zero and are left out; null texts are kept as they are. Extra columns pass through, but an input
column named copy is replaced by the copy number (from 1). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved, unused

_KEY, _CDF = "_mix_source", "_mix_cdf"


def _source() -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _uniform(seed: int, what: str) -> F.Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:{what}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, targets: DataFrame | None = None, size: float | None = None) -> DataFrame:
    """(source key, rate): mean copies per document; targets: source and weight (default: equal for all)."""
    c = F.col
    held = docs.groupBy(_source().alias(_KEY)).agg(F.count("*").alias("held"))
    if targets is None:
        weighed = held.withColumn("weight", F.lit(1.0))
    else:
        named = targets.where(c("weight") > 0).groupBy(_source().alias(_KEY)).agg(F.sum(c("weight").cast("double")).alias("weight"))
        weighed = held.join(named, _KEY)
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("held").alias("all_held"))
    wanted = total.select(((F.lit(float(size)) if size is not None else c("all_held")) / c("all_weight")).alias("per_weight"))
    return weighed.select(_KEY, (c("weight") * wanted.scalar() / c("held")).alias("rate"))


def distribution(rate: DataFrame) -> DataFrame:
    """(source key, array): Poisson distribution function at 0, 1, 2, ... until it is one in double precision."""
    c = F.col
    upto = F.ceil(c("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    each = rate.select(_KEY, "rate", F.explode(F.sequence(F.lit(0), upto)).alias("k"))
    run = Window.partitionBy(_KEY).orderBy("k")
    log_factorial = F.sum(F.when(c("k") > 0, F.log(c("k").cast("double"))).otherwise(0.0)).over(run)
    mass = each.select(_KEY, "k", F.exp(c("k") * F.log("rate") - c("rate") - log_factorial).alias("mass"))
    upward = mass.select(_KEY, "k", F.sum("mass").over(run).alias("p"))
    return upward.groupBy(_KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias(_CDF))


def mix(docs: DataFrame, targets: DataFrame | None = None, *, size: float | None = None, seed: int = 7, send: int = 1_000_000) -> DataFrame:
    """The columns of docs and copy, each document as often as drawn, in global hash order."""
    c = F.col
    keep = [x for x in docs.columns if x != "copy"]
    key, cdf, at = unused([*docs.columns, "copy"], _KEY, _CDF, "_mix_at")
    table = saved(distribution(rates(docs.select("source"), targets, size)), "mixing-counts").toDF(key, cdf)
    small = table.agg(F.coalesce(F.sum(F.size(cdf)), F.lit(0))).first()[0] <= send
    drawn = docs.select(*keep, _source().alias(key)).join(F.broadcast(table) if small else table, key)
    u = _uniform(seed, "count")
    count = F.size(F.filter(c(cdf), lambda p: p <= u))
    many = drawn.select(*keep, F.explode(F.when(count > 0, F.sequence(F.lit(1), count))).alias("copy"))
    text = [F.when(c("doc_id").isNull(), F.xxhash64("text"))] if "text" in keep else []
    placed = many.withColumn(at, F.xxhash64(F.lit(seed), "doc_id", "copy", *text))
    # hashes are even: ranges of equal width need no sample of the rows
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright(F.shiftrightunsigned(c(at).bitwiseXOR(F.lit(-(1 << 63))), 33) * parts, 31).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions(at, "doc_id", "copy").drop(at)


#: DuckDB SQL for mix(documents) with the default targets.
SQL = """
WITH held AS (SELECT source, count(*) AS held FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM held) / held AS rate FROM held),
each AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::INT)) AS k FROM rate),
mass AS (
    SELECT source, k, exp(k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(k::DOUBLE) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)) AS mass FROM each
),
cdf AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS p FROM mass),
drawn AS (
    SELECT *, ('0x' || substr(md5('7:count:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
),
table_of AS (SELECT source, list(p ORDER BY k) AS ps FROM cdf GROUP BY source),
counted AS (
    SELECT doc_id, text, lang, d.source, n_chars, len(list_filter(ps, lambda p: p <= u)) AS n FROM drawn d JOIN table_of t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n))::INT AS copy FROM counted
"""
