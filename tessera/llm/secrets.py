"""Secret scans with corpus-wide ownership frequency.

Three kinds of base spans are matched by patterns over whole texts, leftmost and non-overlapping per
kind.  The method adds a fourth kind, ``opaque``: long tokens that mix letters and digits with high
entropy and overlap no base span.  The hash of every candidate's value is then counted over the whole
corpus by distinct repositories (documents) and distinct owners (sources): a value that several
owners carry is a widely copied *example*; one that a single owner carries is *live* if it looks
like a credential, and *weak* if not.  Opaque tokens become spans only where they are live, which
keeps identifiers that many owners share out of the result; base spans always stay.

Defined cases: a null text counts as empty; a null owner is an owner of its own; a row without
candidates is returned with zero counts and the hash of the empty string; repeated rows count as one
repository for their doc_id; positions are code points with an exclusive end; other columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch, ship

#: Kinds in the order in which they break ties.
KINDS = ("assign", "access", "hex", "opaque")
#: Patterns and least lengths of the base kinds.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: A run of at least 16 is the same as a maximal run that is long enough, and skips short ones faster.
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Bits of entropy for each character from which a value looks like a credential; owners from which a value is an example.
ENTROPY_BITS, EXAMPLE_OWNERS = 3.0, 3

Span = tuple[int, int, int, str]  # start, kind, end, value


def base_spans(text: str) -> list[Span]:
    """Base spans in order of start, then kind."""
    found: list[Span] = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def looks_live(value: str) -> bool:
    """Letters and digits together, with high entropy."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= ENTROPY_BITS


def opaque_spans(text: str, base: list[Span]) -> list[Span]:
    """High-entropy tokens that overlap no base span."""
    out, busy, reach = [], [], 0
    for s, _, e, _ in base:  # in order of start; as far as any of them reaches
        if e > reach:
            busy.append((s, e))
            reach = e
    at = 0
    for m in OPAQUE.finditer(text):
        while at < len(busy) and busy[at][1] <= m.start():
            at += 1
        if looks_live(m[0]) and (at == len(busy) or busy[at][0] >= m.end()):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("strong", pa.bool_())]))
SPANS_DDL = "array<struct<kind:int,start:int,end:int,value:string,strong:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            spans = base + opaque_spans(text, base)
            rows.append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest(), "strong": looks_live(v)} for s, k, e, v in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("owner"), pa.array(rows, _SPANS)], names=["doc_id", "owner", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Candidates of each row: doc_id, owner, spans (kind, start, end, SHA-256 of the value, looks live)."""
    ship.ensure(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, owner string, spans {SPANS_DDL}")


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate value, over the whole corpus."""
    each = candidates.select("doc_id", "owner", F.explode("spans").alias("s")).select("doc_id", "owner", F.col("s.value").alias("value"))
    # By value and document, then by value and owner, then by value: a value that everyone carries is spread until few rows are left.
    by_doc = each.groupBy("value", "owner", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_doc.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("n").alias("occurrences"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: doc_id and its found spans with kind, start, end, value digest, owners, repositories and status (live, example or weak)."""
    candidates = scratch.table(scan(docs, id_col, text_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = candidates.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    # Written first: an aggregate by the same key would fix the join's partitions, and a value that everyone carries could not be split.
    owners = scratch.table(ownership(candidates), "owners")
    judged = each.join(owners, "value").withColumn("status", F.when(F.col("owners") >= example_owners, "example").when(F.col("strong"), "live").otherwise("weak"))
    kept = judged.where((F.col("kind") < 3) | (F.col("status") == "live"))
    found = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repositories", "status"))).alias("found"))
    return candidates.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The columns of the query, derived from the spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731  (a second parameter would be taken for the index)
    return scanned.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", one), ",").alias("spans"),
        count(lambda s: s["status"] == "live").alias("n_live"),
        count(lambda s: s["status"] == "example").alias("n_example"),
    )
