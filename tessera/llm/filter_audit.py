"""Filter interaction audit: all orders of a set of filters, through a trie with shared states.

What one filter removes depends on the filters before it, but only on which they were, not on their
order.  So the trie of all permutations has one state for each *set* of filters already applied:

1. Each document becomes a verdict row: its part, whether it fails each filter, and whether its
   labels call it good or toxic.  Texts are read once; the verdicts are written to the shared folder.
2. The trie is walked depth-first.  A state is the DataFrame of the survivors of its set, persisted
   while the states below it are made from it, and made once: a prefix in another order that has the
   same set finds it in the memo.  In each state one aggregate counts, for every filter that may come
   next, the documents of each part that it actually removes.
3. The counts of the edges (set, next filter) are spread over all orders and steps by a join on the
   set and the filter.

With f filters there are 2^f states and f * 2^(f-1) edges, at most f + 1 states are persisted at a
time, and a lost executor costs a few filters over the verdicts.  Hot parts are counted by partial
aggregates; hot texts meet an already written table of repeated digests, so adaptive joins can split
them.

The five filters of ``FILTERS``: A, below 50 words; B, below 65 distinct in 100 words; C, above 5
capitals (A-Z) in 100 code points; D, any of ``#$%&*|``; E, the text of a smaller doc_id, whether or not
that one is removed.  Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, told apart by letter case.

Defined cases: a null text counts as empty, so it fails A only (and E, if an empty or null text has a
smaller doc_id); a null doc_id is neither smaller nor larger than any other, so it neither fails E nor
makes others fail it; rows that repeat doc_id and text are documents of their own, none of which is
smaller than the other; a null part is the empty string, together with parts that are empty strings; a
document is good (toxic) if any row of the labels says so, and neither without labels; an empty table
has no parts, so the result is empty; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import scratch

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Filters that look at one text: name -> whether it fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


#: Filters and the letters by which orders name them; E needs the whole table.
FILTERS = "ABCDE"
EDGES = "part string, edges array<struct<before: string, letter: string, kept: bigint, removed: bigint, good_lost: bigint, toxic_lost: bigint>>"


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: part, good, toxic, and a boolean for each filter of ``FILTERS`` that says whether it fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[fails.alias(f) for f, fails in text_filters(F.col("text")).items()])
    own = scratch.table(own, "verdict-texts")
    first = own.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first = scratch.table(first, "verdict-copies")
    marks = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(*marks)
    known = scratch.table(known, "verdict-labels")
    rows = own.join(first, "digest", "left").join(known, "id", "left")
    return rows.select("part", *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")], *[c for c in FILTERS if c != "E"], F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))


def edge_counts(rows: DataFrame, filters: str) -> DataFrame:
    """Walk the trie: part, before (the set, its letters sorted), letter, kept, removed, good_lost, toxic_lost of all edges.

    ``rows`` are verdicts.  Parts without survivors in a state have no row there.
    """
    path = scratch.fresh(rows.sparkSession, "audit-edges")
    memo: set[str] = set()

    def visit(before: str, state: DataFrame) -> None:
        memo.add(before)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        nexts = [f for f in filters if f not in before]
        counts = ", ".join(f"struct('{before}' AS before, '{f}' AS letter, count_if(NOT {f}) AS kept, count_if({f}) AS removed, count_if({f} AND good) AS good_lost, count_if({f} AND toxic) AS toxic_lost)" for f in nexts)
        state.groupBy("part").agg(F.expr(f"array({counts})").alias("edges")).write.mode("append").parquet(path)
        for f in nexts:
            after = "".join(sorted(before + f))
            if after not in memo and len(after) < len(filters):
                visit(after, state.where(f"NOT {f}").drop(f))
        state.unpersist()

    visit("", rows)
    return rows.sparkSession.read.schema(EDGES).parquet(path).select("part", F.inline("edges"))


def all_orders(spark: SparkSession, filters: str) -> DataFrame:
    """filter_order, step, letter and the set before the step, for all orders; f! * f rows."""
    rows = [("".join(o), k + 1, o[k], "".join(sorted(o[:k]))) for o in itertools.permutations(filters) for k in range(len(o))]
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, before string")


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The full table of a set of filters over verdict rows (part, good, toxic and a boolean for each filter).

    One row per part, filter_order and step, zeros included: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.
    """
    spark = rows.sparkSession
    rows = scratch.table(rows.select("part", "good", "toxic", *filters), "verdicts")
    counts = ("kept", "removed", "good_lost", "toxic_lost")
    edges = edge_counts(rows, filters)
    fails = [F.struct(F.lit(f).alias("letter"), F.count_if(F.col(f)).alias("fails"), F.count_if(_only(f, filters)).alias("unique_fails")) for f in filters]
    parts = rows.groupBy("part").agg(F.array(*fails).alias("all")).select("part", F.inline("all"))
    orders = F.broadcast(all_orders(spark, filters))  # f! * f rows
    every = parts.join(orders, "letter").join(edges, ["part", "letter", "before"], "left")
    every = every.select("part", "filter_order", "step", "letter", "before", "fails", "unique_fails", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    share = parts.select("part", "letter").join(orders.groupBy("letter", "before").agg(F.count(F.lit(1)).alias("orders")), "letter").join(edges, ["part", "letter", "before"], "left")
    share = share.groupBy("part", "letter").agg(F.coalesce(F.sum(F.col("orders") * F.col("removed")), F.lit(0)).cast("long").alias("shapley"))
    return every.join(share, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def _only(letter: str, filters: str) -> Column:
    out = F.col(letter)
    for f in filters:
        if f != letter:
            out = out & ~F.col(f)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``audit`` of the five filters over documents and their labels."""
    return audit(verdicts(docs, labels, **columns))

