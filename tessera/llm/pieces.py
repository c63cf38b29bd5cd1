"""SentencePiece encoding and decoding in vectorised merge rounds.

A model of the BPE type merges, again and again, the neighbouring symbols whose concatenation is the
piece of the best score in its vocabulary; of equal scores, the leftmost.  Here the symbols of many
words lie in one flat numpy array:

1. Texts get a leading space and are cut between characters that stand next to each other in no
   piece, since no merge ever crosses such a place.  What lies between two cuts is a *word*.  Equal
   words of a block are encoded once.
2. A round looks up the rank of every pair of neighbours, takes the smallest rank of each word (a
   segmented minimum), merges its occurrences from left to right, and compacts the arrays; words
   without any pair leave.  Merging all occurrences at once is right only while no new pair has a rank
   as good as theirs, which is checked for every merge; elsewhere only the leftmost occurrence is
   merged.  Words that meet such a pair ``PATIENCE`` times, as runs of spaces do, and words longer than
   ``LONG`` symbols, for which rounds would cost the length times the number of ranks, go on in
   *single merges*: the same merges in the same order, but from a queue.
3. Characters without a piece become the pieces of their bytes.

Decoding gathers the bytes of all pieces of a block from one flat table.

The vocabulary is read once by the driver and broadcast; it is bounded by the model's size, whatever
the corpus holds.  Only what the model says is used: pieces, scores, kinds.  A model with a normaliser
other than the identity, or with symbols that are cut out beforehand, is refused.

Defined cases: a null text counts as empty; an empty text has the end id only and decodes to the
empty text; the end id is the only control id added; text that spells a control piece is ordinary
text; the character U+2581 is the model's own sign for a space, and decodes to one; texts of any
length are encoded whole, in slices of ``SLICE`` characters between two cuts; rows are answered one by
one, so repeated rows and ids give repeated results; null ids stay; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ship, textkit

SPACE = 0x2581  # the sign for a space inside pieces
SLICE = 1 << 20
LONG, PATIENCE = 4096, 4
_NONE = np.int32(0x7FFFFFFF)


@dataclass
class Vocabulary:
    """Tables of a model.  A symbol is the id of a piece or, for a character without one, ``size`` plus its code point."""

    pieces: list[bytes]  # what each id decodes to; control ids to nothing
    pair: np.ndarray  # sorted: left symbol << 32 | right symbol
    merged: np.ndarray  # the piece of each pair, and its rank
    rank: np.ndarray
    chars: np.ndarray  # code points that occur in pieces, sorted
    symbol: np.ndarray  # symbol of each of them
    beside: np.ndarray  # sorted: index of a character << 32 | index of one that follows it in some piece
    byte_id: np.ndarray  # id of each byte
    end: int
    _tables: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": {}}

    @property
    def size(self) -> int:
        return len(self.pieces)

    @property
    def symbol_of(self) -> np.ndarray:
        """Symbol of every code point."""
        if "symbol" not in self._tables:
            table = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
            table[self.chars] = self.symbol
            self._tables["symbol"] = table
        return self._tables["symbol"]

    @property
    def index_of(self) -> np.ndarray:
        """Number of every code point among the characters of pieces, from 1; 0 for the others."""
        if "index" not in self._tables:
            table = np.zeros(0x110000, dtype=np.int32)
            table[self.chars] = np.arange(1, len(self.chars) + 1)
            self._tables["index"] = table
        return self._tables["index"]

    @property
    def joined(self) -> np.ndarray:
        """Whether two characters, by their numbers, are neighbours in some piece."""
        if "joined" not in self._tables:
            n = len(self.chars) + 1
            table = np.zeros(n * n, dtype=bool)
            table[(self.beside >> 32) * n + (self.beside & 0xFFFFFFFF)] = True
            self._tables["joined"] = table
        return self._tables["joined"]

    @property
    def slots(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Hash table of the pairs: key and number of the pair in each slot, in how many slots from its own on a pair may stand, bits of a slot's number."""
        if "slots" not in self._tables:
            bits = max(4, (4 * len(self.pair)).bit_length())
            keys, number = np.full((1 << bits) + 64, -2, np.int64), np.zeros((1 << bits) + 64, np.int64)
            home, left, step = _slot(self.pair, bits), np.arange(len(self.pair)), 0
            while len(left):
                at = home[left] + step
                free = keys[at] == -2
                mine = np.zeros(len(left), bool)
                mine[np.unique(at, return_index=True)[1]] = True
                put = free & mine
                keys[at[put]], number[at[put]] = self.pair[left[put]], left[put]
                left, step = left[~put], step + 1
            self._tables["slots"] = (keys, number, step, bits)
        return self._tables["slots"]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of symbols; the rank is ``_NONE`` where there is no such piece."""
        keys, number, steps, bits = self.slots
        key = left << 32 | right
        at = _slot(key, bits)
        there = keys[at]
        ask = np.flatnonzero((there != key) & (there != -2))  # another pair stands there: it may be further on
        for _ in range(steps - 1):
            if not len(ask):
                break
            at[ask] += 1
            there[ask] = keys[at[ask]]
            ask = ask[(there[ask] != key[ask]) & (there[ask] != -2)]
        hit = there == key
        pair = number[at]
        return np.where(hit, self.rank[pair], _NONE), self.merged[pair]


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


def vocabulary(model: str) -> Vocabulary:
    """Read a model file of the BPE type with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if sp.encode(" ", out_type=str) != [chr(SPACE) * 2] or sp.decode(sp.encode("  \tａ x ")) != "  \tａ x ":
        raise ValueError(f"{model}: only models that leave text as it is, behind a leading space, are supported")
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    bytes_of = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(bytes_of) != 256 or any(sp.is_unused(i) for i in range(n)):
        raise ValueError(f"{model}: only models with all bytes and without unused pieces are supported")
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    ids = {names[i]: i for i in normal}
    scores = np.array([sp.get_score(i) for i in normal])
    ranks = dict(zip(normal, (len(scores) - np.searchsorted(np.unique(scores), scores) - 1).tolist()))
    chars = sorted({c for i in normal for c in names[i]})
    symbol = {c: ids.get(c, n + ord(c)) for c in chars}
    number = {c: k + 1 for k, c in enumerate(chars)}
    pairs: dict[int, tuple[int, int]] = {}
    beside = set()
    for i in normal:
        name = names[i]
        beside.update(number[a] << 32 | number[b] for a, b in zip(name, name[1:]))
        for cut in range(1, len(name)):
            left, right = (symbol[s] if len(s) == 1 else ids.get(s) for s in (name[:cut], name[cut:]))
            if left is not None and right is not None:
                pairs[left << 32 | right] = (i, ranks[i])
    keys = sorted(pairs) or [-1]
    decoded = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else names[i].replace(chr(SPACE), " ").encode() for i in range(n)]
    return Vocabulary(
        decoded, np.array(keys, np.int64), np.array([pairs.get(k, (0, 0))[0] for k in keys], np.int64), np.array([pairs.get(k, (0, int(_NONE)))[1] for k in keys], np.int32),
        np.array([ord(c) for c in chars], np.int64), np.array([symbol[c] for c in chars], np.int64), np.array(sorted(beside), np.int64), np.array([bytes_of[b] for b in range(256)], np.int32), sp.eos_id(),
    )


def single_merges(vocab: Vocabulary, symbols: list[int]) -> list[int]:
    """Merge one word pair by pair: best rank first, of equal ranks the leftmost."""
    known = vocab._tables.setdefault("pairs", dict(zip(vocab.pair.tolist(), zip(vocab.rank.tolist(), vocab.merged.tolist()))))
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := known.get(symbols[i] << 32 | symbols[i + 1]))]
    heapq.heapify(queue)
    while queue:
        _, i, left, right, piece = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of them has been merged meanwhile
        symbols[i], symbols[j] = piece, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if found := known.get(piece << 32 | symbols[k]):
                heapq.heappush(queue, (found[0], i, piece, symbols[k], found[1]))
        h = before[i]
        if h >= 0 and (found := known.get(symbols[h] << 32 | piece)):
            heapq.heappush(queue, (found[0], h, symbols[h], piece, found[1]))
    return [s for s in symbols if s >= 0]


def merge_rounds(vocab: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of many words, none of them empty: flat final symbols and their number for each word."""
    total = len(sizes)
    word = np.arange(total)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, sizes, symbols
    patience = np.full(total, PATIENCE)
    patience[sizes > LONG] = 0
    while len(word):
        first = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(word)), sizes)
        rank, merged = vocab.look_up(symbols[:-1], symbols[1:]) if len(symbols) > 1 else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        rank, merged = np.append(rank, _NONE), np.append(merged, 0)
        rank[first + sizes - 1] = _NONE  # the last symbol of a word has no right neighbour
        best = np.minimum.reduceat(rank, first)
        single = (best < _NONE) & (patience[word] <= 0)
        leave = (best == _NONE) | single
        if leave.any():
            goes = leave[of]
            done.append((word[~single & leave], sizes[~single & leave], symbols[goes & ~single[of]]))
            for w in np.flatnonzero(single).tolist():
                mine = np.array(single_merges(vocab, symbols[first[w] : first[w] + sizes[w]].tolist()), np.int64)
                done.append((word[w : w + 1], np.array([len(mine)]), mine))
            symbols, rank, merged, of = symbols[~goes], rank[~goes], merged[~goes], of[~goes]
            word, sizes, best = word[~leave], sizes[~leave], best[~leave]
            of = np.repeat(np.arange(len(word)), sizes)
            if not len(word):
                break
            first = np.cumsum(sizes) - sizes
        n = len(symbols)
        hit = rank == best[of]
        # In a run of overlapping occurrences every second one is merged, from the left.
        begins = hit.copy()
        begins[1:] &= ~hit[:-1]
        run = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        take = hit & ((np.arange(n) - run) % 2 == 0)
        at = np.flatnonzero(take)
        many = np.bincount(of[at], minlength=len(word)) > 1
        if many.any():
            risky = at[many[of[at]]]
            w = of[risky]
            left = risky - 1
            has_left = left >= first[w]
            after_merge = has_left & (risky >= 2) & take[np.maximum(risky - 2, 0)] & (risky - 2 >= first[w])
            left_symbol = np.where(after_merge, merged[np.maximum(risky - 2, 0)], symbols[np.maximum(left, 0)])
            right = risky + 2
            has_right = right < first[w] + sizes[w]
            new_left = np.where(has_left, vocab.look_up(left_symbol, merged[risky])[0], _NONE)
            new_right = np.where(has_right, vocab.look_up(merged[risky], symbols[np.minimum(right, n - 1)])[0], _NONE)
            bad = np.zeros(len(word), bool)
            bad[w[np.minimum(new_left, new_right) <= best[w]]] = True
            if bad.any():
                patience[word[bad]] -= 1
                leftmost = np.append(True, of[at][1:] != of[at][:-1])
                at = at[leftmost | ~bad[of[at]]]
        symbols[at] = merged[at]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        sizes = sizes - np.bincount(of[at], minlength=len(word))
    words = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
    lengths = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
    flat = np.concatenate([d[2] for d in done]) if done else np.zeros(0, np.int64)
    out_sizes, starts = np.zeros(total, np.int64), np.zeros(total, np.int64)
    out_sizes[words] = lengths
    starts[words] = np.cumsum(lengths) - lengths
    return flat[_spans(starts, out_sizes)], out_sizes


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _fall_back(vocab: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids from the symbols of words: characters without a piece become their bytes."""
    raw = symbols >= vocab.size
    if not raw.any():
        return symbols.astype(np.int32), sizes
    code = np.where(raw, symbols - vocab.size, 0)
    width = _utf8_width(code)
    ids = np.repeat(symbols, width).astype(np.int32)
    ids[np.repeat(raw, width)] = vocab.byte_id[np.frombuffer("".join(map(chr, code[raw].tolist())).encode(), np.uint8)]
    return ids, np.add.reduceat(width, np.cumsum(sizes) - sizes)


def _utf8_width(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def _cuts(vocab: Vocabulary, points: np.ndarray) -> np.ndarray:
    """Places that no merge crosses."""
    number = vocab.index_of[points].astype(np.int64)
    return np.flatnonzero(~vocab.joined[number[:-1] * (len(vocab.chars) + 1) + number[1:]]) + 1


def slices(vocab: Vocabulary, text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of about ``size`` characters, divided at cuts only; a part grows until it has one."""
    at, wide = 0, size
    while len(text) - at > wide:
        part = text[at : at + wide]
        cuts = _cuts(vocab, _points(part))
        if len(cuts):
            yield part[: cuts[-1]]
            at, wide = at + int(cuts[-1]), size
        else:
            wide *= 2
    yield text[at:]


def encode_parts(vocab: Vocabulary, parts: list[str]) -> list[np.ndarray]:
    """Ids of parts that begin and end at cuts, or where a text does; equal words of all parts are encoded once."""
    text = "".join(parts)
    if not text:
        return [np.zeros(0, np.int32) for _ in parts]
    points = _points(text)
    edges = np.append(0, np.cumsum([len(p) for p in parts]))
    is_cut = np.zeros(len(points) + 1, bool)
    is_cut[_cuts(vocab, points)] = True
    is_cut[edges] = True
    cut = np.flatnonzero(is_cut[:-1])
    data = text.encode()
    place = np.append(0, np.cumsum(_utf8_width(points)))
    ends = np.append(cut, len(points))
    found = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(place[ends]), pa.py_buffer(data)]).dictionary_encode()
    which = found.indices.to_numpy()
    one = np.zeros(len(found.dictionary), np.int64)
    one[which] = np.arange(len(which))  # a place where each distinct word stands
    sizes = np.diff(ends)[one]
    symbols, sizes = merge_rounds(vocab, vocab.symbol_of[points[_spans(cut[one], sizes)]], sizes)
    ids, sizes = _fall_back(vocab, symbols, sizes)
    first = np.cumsum(sizes) - sizes
    flat = ids[_spans(first[which], sizes[which])]
    upto = np.append(0, np.cumsum(sizes[which]))[np.searchsorted(cut, edges)]
    return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


def encode_texts(vocab: Vocabulary, texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: first and end row, flat ids with the end ids, number of ids of each row."""
    sign = chr(SPACE)
    row = 0
    while row < len(texts):
        end, held = row, 0
        parts: list[str] = []
        owner: list[int] = []
        ids: list[list[np.ndarray]] = []

        def encode() -> None:
            for r, found in zip(owner, encode_parts(vocab, parts)):
                ids[r - row].append(found)
            parts.clear()
            owner.clear()

        while end < len(texts) and (end == row or held + len(texts[end] or "") <= size):
            text = texts[end] or ""
            ids.append([])
            held += len(text)
            for part in slices(vocab, sign + text.replace(" ", sign), size) if text else ():
                parts.append(part)
                owner.append(end)
                if sum(map(len, parts)) >= size:
                    encode()
            end += 1
        encode()
        last = np.array([vocab.end], np.int32)
        rows = [np.concatenate([*found, last]) for found in ids]
        yield row, end, np.concatenate(rows), np.array([len(r) for r in rows])
        row = end


def decode_ids(vocab: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Texts of rows of ids: the pieces' bytes, without control pieces and without the space that encoding put first."""
    if "bytes" not in vocab._tables:
        width = np.array([len(p) for p in vocab.pieces], np.int64)
        # A text begins with the first piece that is not a control id; what is read in its place has lost one leading space.
        vocab._tables["bytes"] = (np.frombuffer(b"".join(vocab.pieces), np.uint8), np.cumsum(width) - width, width, np.array([p.startswith(b" ") for p in vocab.pieces]))
    data, first, width, spaced = vocab._tables["bytes"]
    wide = width[ids]
    out = data[_spans(first[ids], wide)].tobytes()
    done = np.append(0, np.cumsum(wide))
    at = np.append(0, np.cumsum(sizes))
    begin, end = done[at[:-1]], done[at[1:]]
    solid = np.flatnonzero(wide > 0)
    head = np.append(solid, 0)[np.searchsorted(solid, at[:-1])]  # the first piece with bytes from the start of each row on
    strip = (end > begin) & spaced[ids[head]] if len(ids) else np.zeros(len(sizes), bool)
    return [out[a:b].decode("utf-8", "replace") for a, b in zip((begin + strip).tolist(), end.tolist())]


def _vocabulary_of(spark: SparkSession, model: str):
    ship.ensure(spark)
    return spark.sparkContext.broadcast(vocabulary(model))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> (with the end id) of every text."""
    vocab = _vocabulary_of(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, sizes in encode_texts(vocab.value, batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), textkit.ragged(ids, sizes, pa.int32())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids (null: empty)."""
    vocab = _vocabulary_of(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.diff(lists.offsets.to_numpy())
            texts = decode_ids(vocab.value, lists.flatten().to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text that they decode to, in one pass over the texts."""
    vocab = _vocabulary_of(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, sizes in encode_texts(vocab.value, batch.column("text").to_pylist()):
                texts = decode_ids(vocab.value, ids, sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), textkit.ragged(ids, sizes, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
