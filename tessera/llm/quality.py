"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts are turned into ``FEATURES`` by vectorised byte and word counts.  Each feature is cut into
quantile bins; boosting goes through the features in turn, fits a shallow tree to the gradient of
the logistic loss over that feature's bins and adds a fraction of it to the feature's lookup table.
Pairs of features that explain most of what is left get tables of their own, boosted in turn by
trees with one cut on either feature.  A score is the logistic of a sum of table entries.

The model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of
their doc_id; rows whose CRC-32 of the doc_id as text is 2 modulo 4 are held out.  Features are
computed for every row.

Defined cases: a null text counts as empty and is scored like any other; a null doc_id has the text
'' and is held out or not by that; several labels of one doc_id count by their majority, a tie as 1;
null labels are ignored; without labels of both kinds the score is the share of label 1 (0.5 without
any); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch, ship, textkit

#: Most labelled rows that a fit takes to the driver.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "upper_share", "digit_share", "symbol_share", "shout_share", "bar_share", "non_ascii_share", "word_length", "longest_word",
    "short_words", "symbol_words", "stops_per_word", "commas_per_word", "words_per_line", "distinct_words", "distinct_trigrams", "distinct_lines",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_SYMBOL = _class("#$%&*+/<=>@[\\]^_`{|}~")
_SHOUT = _class("!?")
_HIGH = (np.arange(256) >= 128).astype(np.int8)


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes of each row."""
    with_row = np.sort(textkit.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) << np.uint64(20) | row.astype(np.uint64)) if len(row) else hashes
    if not len(with_row):
        return np.zeros(rows)
    new = np.concatenate([[True], with_row[1:] != with_row[:-1]])
    return np.bincount((with_row[new] & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=rows).astype(float)


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Feature rows (float32) of a block of texts."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[offs]).astype(float)

    words = textkit.Words(raw, offs)
    hashes, row = words.hashes(), words.row_of()
    n_words = np.diff(words.first).astype(float)
    lengths = (words.end - words.start).astype(float)
    by_word = lambda values: np.bincount(row, weights=values, minlength=n)
    last = raw[words.end - 1] if len(words) else raw[:0]
    longest = np.zeros(n)
    np.maximum.at(longest, row, lengths)
    grams = textkit.ngrams(hashes, 3)
    at, counts = textkit.windows(words.first, 3)
    trigrams = _distinct(np.repeat(np.arange(n), counts), grams[at] if len(at) else grams[:0], n)
    feeds = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    starts = starts[starts < len(raw)]
    ends = np.minimum(np.concatenate([starts[1:], [len(raw)]]), offs[np.searchsorted(offs, starts, side="right")]) if len(starts) else starts
    line_row = np.searchsorted(offs, starts, side="right") - 1
    lines = np.bincount(line_row, minlength=n).astype(float)
    distinct_lines = _distinct(line_row, textkit.hash_ranges(raw, starts, ends), n)
    some, w = np.maximum(size, 1), np.maximum(n_words, 1)
    out = np.stack([
        np.log1p(size), np.log1p(n_words), per_row(_UPPER[raw]) / np.maximum(per_row(_LETTER[raw]), 1), per_row(_DIGIT[raw]) / some, per_row(_SYMBOL[raw]) / some,
        per_row(_SHOUT[raw]) / some, per_row(raw == 124) / some, per_row(_HIGH[raw]) / some, by_word(lengths) / w, np.log1p(longest),
        by_word(lengths <= 3) / w, by_word(_SYMBOL[last] + _SHOUT[last]) / w, by_word(last == 46) / w, by_word(last == 44) / w, n_words / np.maximum(lines, 1),
        _distinct(row, hashes, n) / w, trigrams / np.maximum(counts, 1), distinct_lines / np.maximum(lines, 1),
    ], axis=1)
    return out.astype(np.float32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offs in textkit.blocks(batch.column("text")):
            x = features(raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), textkit.ragged(x.ravel(), np.full(b - a, len(FEATURES)), pa.float32())], names=["doc_id", "x"])


@dataclass
class AdditiveModel:
    """Lookup tables over binned features and pairs of binned features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j])]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Values for each bin of a regression tree with so many leaves over ordered bins."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            at = np.arange(a + 1, b)
            ok = at[(ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)]
            if len(ok):
                gain = worth(a, ok) + worth(ok, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(ok[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best tree with one cut on either axis of a grid: its gain and its values."""
    cg, ch = (np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h))
    rows, cols = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a, b, d, e = c[rows, cols], c[rows, -1], c[-1, cols], c[-1, -1]
        return [a, b - a, d - a, e - b - d + a]

    gs, hs = parts(cg), parts(ch)
    gain = sum(x**2 / (y + ridge) for x, y in zip(gs, hs)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [float(x[r, c] / (y[r, c] + ridge)) for x, y in zip(gs, hs)]
    values = np.empty(g.shape)
    values[: r + 1, : c + 1], values[: r + 1, c + 1 :], values[r + 1 :, : c + 1], values[r + 1 :, c + 1 :] = v
    return float(gain[r, c]), values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, rate: float = 0.08, leaves: int = 3, pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """Cyclic boosting of main effects, then of the pairs with the largest gain on what is left."""
    model = AdditiveModel()
    if not len(y):
        return model
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    cut = lambda col, n: np.unique(np.quantile(col, np.linspace(0, 1, n + 1)[1:-1]))
    n_features = x.shape[1]
    model.edges = [cut(x[:, j], bins) for j in range(n_features)]
    model.coarse = [cut(x[:, j], coarse_bins) for j in range(n_features)]
    fine = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(n_features):
            g, h = gradient()
            m = len(model.tables[j])
            step = rate * np.clip(_tree(np.bincount(fine[j], g, m), np.bincount(fine[j], h, m), leaves, 1.0, 1.0), -4, 4)
            model.tables[j] += step
            total += step[fine[j]]
    g, h = gradient()

    def grid(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(rough[i] * shape[1] + rough[j], weights, shape[0] * shape[1]).reshape(shape)

    gains = [(_quadrants(grid(i, j, g), grid(i, j, h), 1.0)[0], i, j) for i in range(n_features) for j in range(i + 1, n_features) if len(model.coarse[i]) and len(model.coarse[j])]
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.grids = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = gradient()
            step = rate * np.clip(_quadrants(grid(i, j, g), grid(i, j, h), 1.0)[1], -4, 4)
            model.grids[k] += step
            total += step[rough[i], rough[j]]
    return model


def held_out(id_col: Column) -> Column:
    """Rows that no fit may see: CRC-32 of the doc_id as text is 2 modulo 4."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score."""
    ship.ensure(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = scratch.table(rows.mapInArrow(_featurise, "doc_id long, x array<float>"), "features")
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    usable = table.where(~held_out(F.col("doc_id"))).join(marks, "doc_id")
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample_rows).toArrow()
    x = np.asarray(sample.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if sample.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    model = fit(x, sample.column("y").to_numpy().astype(float) if sample.num_rows else np.zeros(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return table.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
