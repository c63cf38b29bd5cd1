"""Ordered analytics inside sessions, and deterministic splits and samples.

Splits and samples order by a hash of a seed and an identifier, so any engine repeats them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.running import numbered, running
from tessera.operators.staging import delete, staged, written

#: Values of a category up to which a session's counts of each are columns of one aggregate.
FEW_VALUES = 32


def step_index(df: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """Position in the session (from 1) and size of the session."""
    return df.withColumns({
        "session_step_index": F.row_number().over(Window.partitionBy(session).orderBy(*order)),
        "session_record_count": F.count(F.lit(1)).over(Window.partitionBy(session)),
    })


def transitions(df: DataFrame, session: str, order: Sequence[str], node: str, state: str) -> DataFrame:
    """Directed edges to the next record of the session, with the states of both ends."""
    w = Window.partitionBy(session).orderBy(*order)
    out = df.select(F.col(session), F.col(node).alias("source"), F.lead(node).over(w).alias("target"), F.col(state).alias("source_state"), F.lead(state).over(w).alias("target_state"))
    return out.where(F.col("target").isNotNull())


def transition_matrix(edges: DataFrame) -> DataFrame:
    """Counts and overall fractions of (source state, target state)."""
    counts = edges.groupBy("source_state", "target_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row for each pair of states


def session_rates(df: DataFrame, session: str, outcome: str) -> DataFrame:
    y = F.col(outcome).cast("long")
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("row_count"), F.sum(y).alias("outcome_count"), (F.sum(y) / F.count(F.lit(1))).alias("outcome_rate"))


def mode_of(column: str) -> Column:
    """Most frequent value, the smallest of ties."""
    return F.mode(column, True).alias(column)


def few_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The values, as strings, of those columns that have at most ``FEW_VALUES``; at most one more of each comes to the driver."""
    out = {}
    for c in columns:
        found = [r["v"] for r in df.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(FEW_VALUES + 1).collect()]
        if len(found) <= FEW_VALUES and not any("\ufffd" in v for v in found):  # bytes that are no UTF-8 would not come back as they are
            out[c] = found
    return out


def session_profile(df: DataFrame, session: str, numeric: Sequence[str], categorical: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """One row for each session: record count, means, modes (smallest of ties), then the aggregates ``more``.

    Categories of few values are counted in the aggregate of the means, value by value, so the rows are grouped
    once and nothing is joined.  The counts of the others are rows of their own.
    """
    few = few_values(df, categorical)
    counts = {c: [(f"_{i}_{j}", v) for j, v in enumerate(few[c])] for i, c in enumerate(few)}
    out = df.groupBy(session).agg(
        F.count(F.lit(1)).alias("record_count"), *[F.avg(c).alias(c) for c in numeric], *more, *[F.count_if(F.col(c).cast("string") == v).alias(name) for c, held in counts.items() for name, v in held]
    )
    for c, held in counts.items():
        best = F.array_min(F.array(*[F.struct((-F.col(name)).alias("n"), F.lit(v).alias("v")) for name, v in held])) if held else None
        out = out.withColumn(c, F.when(best["n"] < 0, best["v"]) if held else F.lit(None).cast("string"))
    many = [c for c in categorical if c not in few]
    if many:
        long = df.select(session, F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in many]))).where("v IS NOT NULL")
        best = long.groupBy(session, "c", "v").agg(F.count(F.lit(1)).alias("n")).groupBy(session, "c").agg(F.min(F.struct(-F.col("n"), F.col("v").alias("v")))["v"].alias("v"))
        out = out.join(best.groupBy(session).pivot("c", many).agg(F.min("v")), session, "left")
    extra = [c for c in out.columns if c not in {session, "record_count", *numeric, *categorical} and c not in {name for held in counts.values() for name, _ in held}]
    return out.select(session, "record_count", *numeric, *categorical, *extra)


def draw(seed: int, column: str | Column) -> Column:
    """Hash order of an identifier: MD5 of seed and value, joined by two bars."""
    c = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat_ws("||", F.lit(str(seed)), c.cast("string")))


def group_split(df: DataFrame, group: str, seed: int = 42, test_fraction: float = 0.2) -> DataFrame:
    """Adds is_test: whole groups go to the test side, the first of them in hash order up to the fraction; rows without a group are left out."""
    return group_splits(df, group, {"is_test": seed}, test_fraction)


def group_splits(df: DataFrame, group: str, seeds: Mapping[str, int], test_fraction: float = 0.2) -> DataFrame:
    """A column of ``group_split`` for each name and seed.

    The groups are listed once, and a side follows from a row's own hash and the hash of the last test group, so
    the rows are neither joined nor shuffled, however many splits there are.
    """
    groups, path = written(df.select(group).distinct())
    cuts = {name: last_hash(groups, group, seed, test_fraction) for name, seed in seeds.items()}
    delete(df.sparkSession, path)
    return df.where(F.col(group).isNotNull()).withColumns({name: draw(seed, group) <= cuts[name] for name, seed in seeds.items()})


def last_hash(groups: DataFrame, group: str, seed: int, fraction: float) -> str:
    """The hash of the last of the first groups in hash order, at least one and else the fraction (half-even rounding); empty without groups.

    Groups are counted for each three leading digits; only those that share them with the last one are ordered.
    """
    hashes = groups.select(draw(seed, group).alias("h"))
    slot = F.substring("h", 1, 3)
    slots = sorted((r["slot"], r["n"]) for r in hashes.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect())  # 4,096 rows
    left = max(1, round(sum(n for _, n in slots) * fraction))
    for at, n in slots:
        if left <= n:
            return hashes.where(slot == at).orderBy("h").limit(left).agg(F.max("h")).first()[0]
        left -= n
    return ""


def nested_split(df: DataFrame, group: str, seed: int = 42, test_fraction: float = 0.2, validation_fraction: float = 0.2) -> DataFrame:
    """Adds part: test, and of the rest whole groups as validation by another seed (seed + 7), else train."""
    groups, path = written(df.select(group).distinct())
    test = draw(seed, group) <= last_hash(groups, group, seed, test_fraction)
    validation = draw(seed + 7, group) <= last_hash(groups.where(F.col(group).isNotNull() & ~test), group, seed + 7, validation_fraction)
    delete(df.sparkSession, path)
    return df.where(F.col(group).isNotNull()).withColumn("part", F.when(test, "test").when(validation, "validation").otherwise("train"))


def temporal_holdout(df: DataFrame, session: str, timestamp: str, test_fraction: float = 0.2) -> DataFrame:
    """Sessions by their first timestamp, the latest fraction (half-even rounding, at least one) as test.

    Sessions are numbered from the latest start on, equal starts from the largest session on.
    """
    starts = staged(df.groupBy(session).agg(F.min(timestamp).alias("start")))
    n = starts.count()
    if n == 0:
        return starts.withColumn("is_test", F.lit(False))
    test = max(1, round(n * test_fraction))
    return numbered(starts, [F.desc("start"), F.desc(session)], "_nth").select(session, "start", (F.col("_nth") <= test).alias("is_test"))


def sample_rows(df: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows in hash order (a sampling operator)."""
    return df.orderBy(draw(seed, key), key).limit(limit)


def stratified_cap(df: DataFrame, label: str, key: str, limit: int, seed: int = 42, copies: str | None = None) -> DataFrame:
    """At most about ``limit`` rows, each class in proportion: int(limit * class / all) of its first rows in hash order.

    With ``copies``, a row stands for so many equal ones, and as many rows come back as are taken of them.
    """
    totals = df.groupBy(label).agg((F.count(F.lit(1)) if copies is None else F.sum(copies)).alias("class_rows")).withColumn("all_rows", F.sum("class_rows").over(Window.partitionBy()))  # one row for each class
    quota = F.when(F.col("all_rows") <= limit, F.col("class_rows")).otherwise(F.floor(F.lit(limit) * F.col("class_rows") / F.col("all_rows")))
    if copies is not None:
        taken = running(df, [draw(seed, key), F.col(key)], {"_upto": copies}, [label]).join(F.broadcast(totals), label)
        many = F.least(F.col(copies), quota - F.col("_upto") + F.col(copies)).cast("int")
        return taken.withColumn("_many", many).where("_many > 0").select(*[c for c in df.columns if c != copies], F.explode(F.array_repeat(F.lit(1), F.col("_many"))).alias("_each")).drop("_each")
    ranked = numbered(df, [draw(seed, key), F.col(key)], "_rank", [label])
    return ranked.join(F.broadcast(totals), label).where(F.col("_rank") <= quota).drop("_rank", "class_rows", "all_rows")


def split_audit(edges: DataFrame, membership: DataFrame, node: str = "node") -> DataFrame:
    """Edges inside train, inside test, and across: from a frame of (node, is_test)."""
    ends = membership.select(F.col(node).alias("source"), F.col("is_test").alias("source_test"))
    others = membership.select(F.col(node).alias("target"), F.col("is_test").alias("target_test"))
    both = edges.join(ends, "source").join(others, "target")
    return both.groupBy(F.when(F.col("source_test") != F.col("target_test"), "across").when(F.col("source_test"), "test").otherwise("train").alias("part")).agg(F.count(F.lit(1)).alias("edges"))
