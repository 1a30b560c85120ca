"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldtrail.sources.workspace import stored

SEED = 17
TEMPERATURE = 0.5
OWN = ("copy", "copies", "rate", "shuffle_key", "_cdf", "_mixed", "_count")  # columns that the operator adds
DIGITS = 13  # hex digits of the hash that make the uniform number: 52 bits, exact in a double


def _hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts' hash."""
    return F.conv(F.substring(_hashed(*parts), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(1 << (4 * DIGITS)))


def rates(docs: DataFrame, source_column: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): rows of each source and its mean repetitions, so that ``epochs`` times all rows come out in
    proportion to ``weights`` (sources not named: none of their rows), or else to n ** temperature."""
    sizes = stored(docs.groupBy(F.col(source_column).alias("source")).agg(F.count("*").alias("n")), "source-sizes")
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map(F.lit(""), F.lit(0.0))
        share = F.coalesce(F.element_at(named, F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)).cast("double")
    rows, shares = sizes.agg(F.sum("n"), F.sum(share)).first()
    rate = epochs * F.lit(float(rows or 0)) * share / F.lit(float(shares)) / F.col("n") if shares else F.lit(0.0)
    return sizes.select("source", "n", rate.alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, ... as an array, far enough that the rest is below the hash's resolution.
    Terms are made as logarithms, so a large rate does not underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", weights: dict[str, float] | None = None,
                temperature: float = TEMPERATURE, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows, each repeated by its Poisson count, with the columns copy (1 to copies), copies, rate and shuffle_key,
    dealt to partitions and sorted inside them by shuffle_key: a global shuffle.

    A count is the smallest k whose distribution function exceeds the uniform number hashed from (seed, id), so a rerun
    gives the same rows. Rows with one id, repeated rows among them, take the same count. A null source is a source of its
    own, a null id hashes as empty text, no rows give no rows. Columns of these names in the input are replaced.
    """
    docs = docs.drop(*[c for c in OWN if c in docs.columns])
    table = rates(docs, source_column, weights, temperature, epochs).select(F.col("source").alias("_mixed"), "rate", poisson_cdf(F.col("rate")).alias("_cdf"))
    counted = docs.join(table, docs[source_column].eqNullSafe(table["_mixed"]))
    u = uniform(F.lit(seed), F.col(id_column))
    counted = counted.withColumn("copies", F.least(F.size(F.filter("_cdf", lambda c: c <= u)), F.size("_cdf") - 1)).drop("_cdf", "_mixed").where("copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = copies.withColumn("shuffle_key", _hashed(F.lit(seed), F.col(id_column), F.col("copy")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def repeated_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``mix_sources`` with the input's columns alone, those of clashing names included."""
    aside = {c: f"_input_{c}" for c in docs.columns if c in OWN}
    return mix_sources(docs.withColumnsRenamed(aside), **options).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
