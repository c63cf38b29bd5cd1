"""Frequent itemsets and association rules.

Equal transactions are counted once, then candidates are exploded level by level with higher-order
functions; infrequent items are pruned first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators.staging import staged


def transactions(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct family=value items of each row."""
    items = F.array_sort(F.array_distinct(F.array_compact(F.array(*[exprs.item(c, c) for c in columns]))))
    return df.select(*keep, items.alias("items"))


def to_text(items: str | Column) -> Column:
    return F.array_join(F.array_sort(items), ";")


def from_text(text: str | Column) -> Column:
    """Items of a ;-joined text, trimmed, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ";"), F.trim), lambda i: i != "")))


def item_support(rows: DataFrame) -> DataFrame:
    """Transactions that hold each item, and their share."""
    total = rows.agg(F.count(F.lit(1)).alias("transactions"))
    counts = rows.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("item", exprs.family_of("item").alias("family"), exprs.value_of("item").alias("value"), "n", (F.col("n") / F.col("transactions")).alias("support"))


def frequent_itemsets(rows: DataFrame, min_support: float = 0.05, max_length: int = 3) -> DataFrame:
    """Itemsets of up to max_length (1 to 3) items with at least ceil(min_support * n) transactions: itemset, size, n, support."""
    # Every level needs these few rows, so they are made once.
    distinct = staged(rows.groupBy("items").agg(F.count(F.lit(1)).alias("copies")))
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("transactions"))
    need = F.ceil(F.round(F.lit(min_support) * F.col("transactions"), 6))
    single = distinct.select(F.explode("items").alias("i"), "copies").groupBy("i").agg(F.sum("copies").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= need)
    # At most 1 / min_support frequent items stand in one column of each family, so this set is small whatever the input.
    frequent = single.agg(F.array_sort(F.collect_set("i")).alias("frequent"))
    kept = distinct.crossJoin(F.broadcast(frequent)).select(F.array_sort(F.array_intersect("items", "frequent")).alias("s"), "copies")
    kept = kept.groupBy("s").agg(F.sum("copies").alias("copies"))

    def sets(length: int) -> Column:
        n = F.size("s")
        if length == 1:
            return F.transform("s", lambda a: F.array(a))
        if length == 2:
            return F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, n), lambda b: F.array(a, b))))
        inner = lambda a, i: F.flatten(F.transform(F.slice("s", i + 2, n), lambda b, j: F.transform(F.slice("s", i + j + 3, n), lambda c: F.array(a, b, c))))
        return F.flatten(F.transform("s", inner))

    out = None
    for length in range(1, max_length + 1):
        level = kept.select(F.explode(sets(length)).alias("itemset"), "copies").groupBy("itemset").agg(F.sum("copies").alias("n")).withColumn("size", F.lit(length))
        out = level if out is None else out.unionByName(level)
    return out.crossJoin(F.broadcast(total)).where(F.col("n") >= need).select("itemset", "size", "n", (F.col("n") / F.col("transactions")).alias("support"))


def fpgrowth_itemsets(rows: DataFrame, min_support: float = 0.05, max_length: int = 3) -> DataFrame:
    """The same by MLlib's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    rows = staged(rows.select("items"))  # read three times below
    n = rows.count()
    found = FPGrowth(itemsCol="items", minSupport=min_support).fit(rows).freqItemsets
    return found.where(F.size("items") <= max_length).select(F.array_sort("items").alias("itemset"), F.size("items").alias("size"), F.col("freq").alias("n"), (F.col("freq") / F.lit(n)).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Every split of a frequent itemset into antecedent and consequent with enough confidence, and its measures."""
    masks_of = F.sequence(F.lit(1), F.shiftleft(F.lit(1), 3) - 2)  # proper non-empty subsets of up to three items
    parts = F.filter(masks_of, lambda m: m < F.pow(F.lit(2), F.size("itemset")).cast("int") - 1)
    masks = itemsets.where("size > 1").select("itemset", F.col("support").alias("support"), F.explode(parts).alias("mask"))
    chosen = F.expr("filter(itemset, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    rest = F.expr("filter(itemset, (x, i) -> (shiftright(mask, i) & 1) = 0)")
    split = masks.select("itemset", "support", chosen.alias("antecedent"), rest.alias("consequent"))
    side = lambda name: itemsets.select(F.col("itemset").alias(name), F.col("support").alias(f"{name}_support"))
    joined = split.join(side("antecedent"), "antecedent").join(side("consequent"), "consequent")
    confidence = F.col("support") / F.col("antecedent_support")
    out = joined.withColumn("confidence", confidence).where(F.col("confidence") >= min_confidence)
    return out.select(
        "antecedent", "consequent", "antecedent_support", "consequent_support", "support", "confidence",
        (F.col("confidence") / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(F.col("confidence") >= 1, float("inf")).otherwise((1 - F.col("consequent_support")) / (1 - F.col("confidence"))).alias("conviction"),
    )


def merge_algorithms(rules: DataFrame, algorithm: str = "algorithm") -> DataFrame:
    """One row for each rule that any algorithm found: the algorithms, sorted and joined by ;, and the best measures."""
    measures = [c for c in ("support", "confidence", "lift") if c in rules.columns]
    return rules.groupBy("antecedent", "consequent").agg(F.array_join(F.array_sort(F.collect_set(algorithm)), ";").alias("algorithms"), *[F.max(c).alias(c) for c in measures])


def outcome_rules(rules: DataFrame, outcome: str, excluded_families: Sequence[str] = ()) -> DataFrame:
    """Rules whose only consequent is outcome=1 and whose antecedent holds neither the outcome nor a family that defines it."""
    barred = [outcome, *excluded_families]
    return rules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == f"{outcome}=1") & ~F.exists("antecedent", lambda i: exprs.family_of(i).isin(*barred)))


def rank_rules(rules: DataFrame, limit: int = 250) -> DataFrame:
    """The first rules by lift, confidence and support, numbered R1, R2, ... (a top-k report)."""
    text = rules.withColumns({"antecedent_text": to_text("antecedent"), "consequent_text": to_text("consequent")})
    order = [F.desc(F.round("lift", 9)), F.desc(F.round("confidence", 9)), F.desc(F.round("support", 9)), F.col("antecedent_text"), F.col("consequent_text")]
    top = text.orderBy(*order).limit(limit)
    return top.withColumn("rule_id", F.concat(F.lit("R"), F.row_number().over(Window.partitionBy().orderBy(*order)).cast("string")))  # at most ``limit`` rows


def rule_quality(rules: DataFrame) -> DataFrame:
    """Count and ranges of the rule measures."""
    return rules.agg(F.count(F.lit(1)).alias("rule_count"), *[f(m).alias(f"{n}_{m}") for m in ("lift", "confidence", "support") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))])


def validate_transactions(rows: DataFrame, outcome: str) -> DataFrame:
    """Rows, empty transactions, and rows without exactly one outcome item."""
    n = F.size(F.filter("items", lambda i: exprs.family_of(i) == outcome))
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.size("items") == 0).alias("empty_count"), F.count_if(n != 1).alias("without_one_outcome"))
