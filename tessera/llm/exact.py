"""Exact deduplication with Patricia tries owned by length-and-content-hash partitions.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a
null text counts as empty.  Of equal texts the row with the most code points in the original text,
then the smallest doc_id, stays.

Each map task first inserts its own texts into a local trie and passes on one row for each distinct
text, so a text that a third of all rows share leaves a task once, whatever its number of copies.
The owners of (length, content hash) then insert the full byte strings into their tries; a terminal
node keeps the best row so far and the number of rows.  A trie above its memory bound writes its
largest subtree to a temporary file, which is read back as a trie of its own once the rest is done.

Defined cases: an empty table gives an empty result; null and blank texts form one group of the
empty text; a null doc_id ranks behind every other on equal lengths and is returned as null;
repeated rows (the same doc_id again) count as rows of their group, and each of them is marked kept
if its doc_id is the one that stays.  Columns of the input beyond the two named are ignored.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ship

#: The characters that normalisation deletes.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Bytes of edge labels that one trie holds before it spills a subtree, or, in map tasks, is passed on.
TRIE_BYTES = 128 << 20
LOCAL_BYTES = 48 << 20

Entry = tuple[int, int | None, int]  # code points, doc_id, rows


def better(a: Entry, b: Entry) -> Entry:
    """The entry that stays, with the rows of both."""
    rank = lambda e: (-e[0], e[1] is None, e[1] if e[1] is not None else 0)
    cp, doc, _ = min(a, b, key=rank)
    return cp, doc, a[2] + b[2]


class _Node:
    __slots__ = ("entry", "kids", "label", "spill")

    def __init__(self, label: bytes, entry: Entry | None = None):
        self.label, self.entry = label, entry
        self.kids: dict[int, _Node] = {}
        self.spill = None


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie from byte strings to entries, with spill by subtree."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.limit, self.held = _Node(b""), limit, 0

    def insert(self, key: bytes, entry: Entry) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], entry), node.spill)
                return
            if at == len(key):
                node.entry = entry if node.entry is None else better(node.entry, entry)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = _Node(key[at:], entry)
                self._grew(len(key) - at)
                return
            label = kid.label
            if not key.startswith(label, at):
                cut = _common(label, key[at : at + len(label)])
                upper = _Node(label[:cut])
                kid.label = label[cut:]
                upper.kids[label[cut]] = kid
                node.kids[key[at]] = kid = upper
                label = upper.label
            node, at = kid, at + len(label)

    def _grew(self, n: int) -> None:
        self.held += n + 200
        while self.held > self.limit and self._spill_largest():
            pass

    def _spill_largest(self) -> bool:
        """Write the largest subtree of the first node that branches to a file; False if there is nothing to write."""
        node = self.root
        while len(node.kids) == 1 and next(iter(node.kids.values())).spill is None:
            node = next(iter(node.kids.values()))
        sizes = {k: self._size(v) for k, v in node.kids.items() if v.spill is None}
        if not sizes:
            return False
        kid = node.kids[max(sizes, key=sizes.get)]
        out = tempfile.TemporaryFile()
        for key, entry in self._walk(kid, b""):
            pickle.dump((key, entry), out)
        for path, inner in list(self._spilled(kid, b"")):
            for key, entry in self._read_back(inner):
                pickle.dump((path + key, entry), out)
        self.held -= self._size(kid) - len(kid.label) - 200
        kid.kids, kid.entry, kid.spill = {}, None, out
        return True

    def _size(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            top = stack.pop()
            total += len(top.label) + 200
            stack.extend(top.kids.values())
        return total

    def _walk(self, node: _Node, path: bytes) -> Iterator[tuple[bytes, Entry]]:
        """Entries held in memory below a node."""
        stack = [(node, path)]
        while stack:
            top, at = stack.pop()
            if top.entry is not None:
                yield at, top.entry
            stack.extend((kid, at + kid.label) for kid in top.kids.values())

    def _spilled(self, node: _Node, path: bytes) -> Iterator[tuple[bytes, _Node]]:
        """Spilled nodes below a node, with the bytes that lead to each."""
        stack = [(node, path)]
        while stack:
            top, at = stack.pop()
            if top.spill is not None:
                yield at, top
            stack.extend((kid, at + kid.label) for kid in top.kids.values())

    @staticmethod
    def _read_back(node: _Node) -> Iterator[tuple[bytes, Entry]]:
        end = node.spill.seek(0, os.SEEK_END)
        node.spill.seek(0)
        while node.spill.tell() < end:
            yield pickle.load(node.spill)
        node.spill.close()
        node.spill = None

    def items(self) -> Iterator[tuple[bytes, Entry]]:
        """Every key and entry; spilled subtrees come last, each as a trie of its own."""
        yield from self._walk(self.root, b"")
        for path, node in list(self._spilled(self.root, b"")):
            below = PatriciaTrie(self.limit)
            for key, entry in self._read_back(node):
                below.insert(key, entry)
            for key, entry in below.items():
                yield path + key, entry


_OUT = pa.schema([("length", pa.int64()), ("digest", pa.string()), ("norm", pa.binary()), ("code_points", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])


def _insert_all(batches: Iterator[pa.RecordBatch], limit: int, pass_on: bool) -> Iterator[pa.RecordBatch]:
    """Insert rows of (digest, norm, code_points, doc_id, n); yield a row for each distinct text.

    A key is the text followed by its digest, so that the digest comes back with the text.
    """
    trie = PatriciaTrie(limit)

    def drain() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, (cp, doc, n) in trie.items():
            rows.append((len(key) - 64, key[-64:].decode(), key[:-64] if pass_on else b"", cp, doc, n))
            size += len(key)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("digest", "norm", "code_points", "doc_id", "n")]
        for digest, norm, cp, doc, n in zip(*cols):
            trie.insert(norm + digest.encode(), (cp, doc, n))
        if pass_on and trie.held > LOCAL_BYTES:
            yield from drain()
            trie = PatriciaTrie(limit)
    yield from drain()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct normalised text: digest, keep_id, group_size, keep_code_points."""
    ship.ensure(docs.sparkSession)
    rows = normalised(docs, id_col, text_col).select("digest", F.encode("norm", "UTF-8").alias("norm"), "code_points", "doc_id", F.lit(1).cast("long").alias("n"))
    schema = "length long, digest string, norm binary, code_points long, doc_id long, n long"
    local = rows.mapInArrow(lambda it: _insert_all(it, 4 * LOCAL_BYTES, True), schema)
    owned = local.repartition("length", "digest").mapInArrow(lambda it: _insert_all(it, trie_bytes, False), schema)
    return owned.select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("code_points").alias("keep_code_points"))


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code points of the original text, normalised text and its SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("code_points"), F.translate(text, WHITESPACE, "").alias("norm"))
    return norm.withColumn("digest", F.sha2(F.col("norm"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, id_col, text_col, trie_bytes)
    rows = normalised(docs, id_col, text_col).select("doc_id", "digest")
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
