"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with a share w of the target and n characters of text among N has the mean repetition rate
``epochs * N * w / n``.  Each document draws its number of copies from the Poisson distribution with
its source's rate: a hash of (seed, doc_id, text digest) gives a uniform number, and the distribution
is inverted at that number by a table of its cumulative probabilities.  Copies are exploded and dealt
out anew by a hash of (seed, document, copy), within whose partitions they are sorted, which is a
global shuffle that any rerun repeats exactly.

Defined cases: a null source is a source of its own; a null or empty text counts one character, so
that no source has the size zero; repeated rows draw the same number of copies each; a source that
``weights`` does not name gets no copies; an empty table gives an empty result.  All columns of the
input come back; the added ones are ``copy`` (from 0) and ``shuffle_key``, and input columns of
these names, in any letter case, are replaced; columns used on the way get names that the input does
not have.  A very large rate (a tiny source among much text) costs a table of its square root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch

#: Digits of the tables of cumulative probabilities: coarser than the rounding of exp(), finer than the uniform numbers matter.
DIGITS = 12
#: Bytes of all tables together up to which they are broadcast; beyond, the documents are joined by source.
BROADCAST_BYTES = 16 << 20
#: Rates above this have tables that begin twelve standard deviations below the rate, where the probability is below the rounding.
LARGE = 1024
#: Entries that one inner step of building a table copies.
STRIDE = 256


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits from the MD5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def table_start(rate: Column) -> Column:
    """The number of copies that the first entry of a rate's table stands for."""
    return F.when(rate > LARGE, F.floor(rate - 12 * F.sqrt(rate) - 24)).otherwise(F.lit(0)).cast("long")


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities from ``table_start`` on, up to where they round to one.

    Terms are built in logarithms.  A table has 24 sqrt(rate) + 48 entries at a large rate, which are
    appended to strides and strides to the table, so building takes time in proportion.
    """
    first = table_start(rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("long")
    # log(k!) by Stirling's series, and k log(rate / k) + k - rate without cancellation.
    k, off = first.cast("double"), (rate - first) / F.greatest(first, F.lit(1))
    at_first = first.cast("double") * F.log1p(off) - (rate - first) - F.log(F.lit(6.283185307179586) * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    log = F.when(first > 0, at_first).otherwise(-rate)
    start = F.struct(log.alias("log"), F.exp(log).alias("sum"), F.array(F.array(F.exp(log))).alias("strides"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["row"], F.array(total)).alias("row"))

    def stride(acc: Column, at: Column) -> Column:
        ks = F.sequence(at, F.least(at + (STRIDE - 1), last))
        begin = F.struct(acc["log"].alias("log"), acc["sum"].alias("sum"), F.array().cast("array<double>").alias("row"))
        inner = F.aggregate(ks, begin, step)
        return F.struct(inner["log"].alias("log"), inner["sum"].alias("sum"), F.concat(acc["strides"], F.array(inner["row"])).alias("strides"))

    starts = F.sequence(first + 1, F.greatest(last, first + 1), F.lit(STRIDE).cast("long"))
    return F.aggregate(starts, start, stride, lambda acc: F.transform(F.flatten(acc["strides"]), lambda c: F.round(F.least(c, F.lit(1.0)), DIGITS)))


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """Rate of each source: mix_source, n_chars, target, rate.

    Without ``weights`` the targets are the sources' shares to the power ``temperature``, made to add to one.
    """
    docs = docs.select(F.col(source_col).alias("mix_source"), F.col(text_col).alias("mix_text"))
    sizes = docs.groupBy("mix_source").agg(F.sum(F.greatest(F.char_length(F.coalesce("mix_text", F.lit(""))), F.lit(1)).cast("long")).alias("mix_chars"))
    if weights is None:
        raw = F.pow(F.col("mix_chars").cast("double"), F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("mix_source") == name, F.lit(float(weight))).otherwise(raw)
    raw = sizes.withColumn("mix_raw", raw)
    total = raw.agg(F.sum("mix_chars").alias("mix_total"), F.sum("mix_raw").alias("mix_norm"))
    return (
        raw.crossJoin(F.broadcast(total))  # one row of totals
        .withColumn("mix_target", F.col("mix_raw") / F.col("mix_norm"))
        .withColumn("mix_rate", F.round(F.lit(float(epochs)) * F.col("mix_total") * F.col("mix_target") / F.col("mix_chars"), 9))
        .select("mix_source", "mix_chars", "mix_target", "mix_rate")
    )


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as its draw says, in a global random order."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy", "shuffle_key")])
    source, cdf, first, rate, u, copies = scratch.free(docs.columns, "mix_source", "mix_cdf", "mix_first", "mix_rate", "mix_u", "mix_copies")
    rates = source_rates(docs, source_col, text_col, weights, temperature, epochs)
    rates = scratch.table(rates.select(F.col("mix_source").alias(source), poisson_table(F.col("mix_rate")).alias(cdf), table_start(F.col("mix_rate")).alias(first), F.col("mix_rate").alias(rate)), "rates")
    held = rates.agg(F.sum(64 + 8 * F.size(cdf) + F.coalesce(F.octet_length(F.col(source).cast("string")), F.lit(0)))).first()[0]
    if (held or 0) <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    rows = docs.withColumn(u, uniform(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    drawn = rows.join(rates, F.col(source_col).eqNullSafe(F.col(source)))
    number = F.when(F.col(rate) > 0, F.col(first) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))).otherwise(F.lit(0)).cast("int")
    out = drawn.withColumn(copies, number).where(F.col(copies) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string"))))
    out = out.drop(source, cdf, first, rate, u, copies)
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
