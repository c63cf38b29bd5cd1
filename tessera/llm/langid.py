"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text (A-Z lower-cased) forwards and backwards and gives every
byte a distribution over the learned languages; a document's probabilities are the mean over all its
bytes.  A text is read in chunks of ``CHUNK`` bytes side by side, each after a run-up of ``CONTEXT``
bytes on either end.  The network is trained in numpy by backpropagation through time on slices of
labelled rows, at most about ``ROWS_PER_LANGUAGE`` for each language and ``SAMPLE_ROWS`` in all, but
8 for each language at least, which a hash of the doc_id chooses; rows whose CRC-32 of the doc_id as
text is 2 modulo 4 are held out.  Prediction reads whole texts.

Defined cases: a null text, or one without any letter (Unicode L), is ``und`` with score 0; so is
every text if no labelled row can be learned from; null labels teach nothing; a null doc_id counts
as the text ''; repeated rows get the same prediction each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ship, textkit
from tessera.llm.quality import held_out

ROWS_PER_LANGUAGE, SAMPLE_ROWS, SLICE = 400, 102_400, 384
UNKNOWN = "und"
HIDDEN, CHUNK, CONTEXT, LANES = 8, 128, 32, 1024
_PAD = 256  # closes the update gate, so the state passes through


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class ByteGRU:
    """Gated recurrent network, one for each direction, with a softmax layer at every position.

    Softsign takes the place of tanh, and (1 + softsign) / 2 that of the logistic function.
    Arrays are (units, lanes): lanes are chunks of text that advance together.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"E{d}"] = draw(3 * hidden, 257, scale=0.5)
            self.p[f"U{d}"] = draw(2 * hidden, hidden, scale=hidden**-0.5)
            self.p[f"V{d}"] = draw(hidden, hidden, scale=hidden**-0.5)
        self.p["W"] = draw(classes, 2 * hidden, scale=0.3)
        self.p["b"] = np.zeros((classes, 1), np.float32)
        self._close_pad()

    def _close_pad(self) -> None:
        for d in "fb":
            self.p[f"E{d}"][:, _PAD] = 0
            self.p[f"E{d}"][: self.hidden, _PAD] = -1e9

    def run(self, symbols: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, units, lanes) over symbols (time, lanes); with ``keep``, also what backpropagation needs."""
        n, steps = self.hidden, len(symbols)
        E, U, V = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"V{d}"]
        h = np.zeros((n, symbols.shape[1]), np.float32)
        out = np.empty((steps, n, symbols.shape[1]), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = E.take(symbols[t], axis=1)
            gates = U @ h
            gates += x[: 2 * n]
            gates = _soft(gates)
            gates *= 0.5
            gates += 0.5
            reset = gates[n:] * h
            new = V @ reset
            new += x[2 * n :]
            new = _soft(new)
            if keep is not None:
                keep.append((t, h, gates, reset, new))
            h = h + gates[:n] * (new - h)
            out[t] = h
        return out

    def logits(self, symbols: np.ndarray) -> np.ndarray:
        """Position scores (time, classes, lanes)."""
        return self.p["W"][:, : self.hidden] @ self.run(symbols, "f") + self.p["W"][:, self.hidden :] @ self.run(symbols, "b") + self.p["b"]

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """Distribution over classes at every position (time, classes, lanes)."""
        scores = self.logits(symbols)
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
        n, tapes = self.hidden, {"f": [], "b": []}
        states = {d: self.run(symbols, d, tapes[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=1)
        scores = self.p["W"] @ both + self.p["b"]
        scores -= scores.max(axis=1, keepdims=True)
        probs = np.exp(scores)
        probs /= probs.sum(axis=1, keepdims=True)
        real = (symbols != _PAD).astype(np.float32)
        total = max(float(real.sum()), 1.0)
        lanes = np.arange(symbols.shape[1])
        loss = float(-(np.log(probs[:, labels, lanes] + 1e-9) * real).sum() / total)
        delta = probs
        delta[:, labels, lanes] -= 1
        delta *= real[:, None, :] / total
        g = {"W": np.einsum("tcl,tul->cu", delta, both, optimize=True), "b": delta.sum(axis=(0, 2))[:, None]}
        up = self.p["W"].T @ delta
        for d, part in (("f", up[:, :n]), ("b", up[:, n:])):
            U, V = self.p[f"U{d}"], self.p[f"V{d}"]
            gU, gV, gE = np.zeros_like(U), np.zeros_like(V), np.zeros_like(self.p[f"E{d}"])
            dh, dx = np.zeros_like(part[0]), np.empty((len(symbols), 3 * n, symbols.shape[1]), np.float32)
            for t, before, gates, reset, new in reversed(tapes[d]):
                dh = dh + part[t]
                z, r = gates[:n], gates[n:]
                dnew = dh * z * (1 - np.abs(new)) ** 2
                dreset = V.T @ dnew
                dgates = np.concatenate([dh * (new - before), dreset * before])
                dgates *= 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
                gV += dnew @ reset.T
                gU += dgates @ before.T
                dx[t, : 2 * n], dx[t, 2 * n :] = dgates, dnew
                dh = dh * (1 - z) + dreset * r + U.T @ dgates
            for k in range(3 * n):
                gE[k] = np.bincount(symbols.ravel(), dx[:, k].ravel(), 257)
            g |= {f"U{d}": gU, f"V{d}": gV, f"E{d}": gE}
        return loss, g


def train(chunks: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 6, lanes: int = 256, rate: float = 0.03, seed: int = 1) -> ByteGRU:
    """Fit a network to chunks (lanes, time) of symbols with a class each, by Adam with clipped gradients and a falling rate."""
    net, rng = ByteGRU(classes, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step, steps = 0, max(1, epochs * -(-len(chunks) // lanes))
    for _ in range(epochs):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), lanes):
            pick = order[at : at + lanes]
            _, g = net.gradients(np.ascontiguousarray(chunks[pick].T), labels[pick])
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x**2
                net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            net._close_pad()
    return net


def chunked(raw: np.ndarray, offs: np.ndarray, size: int = CHUNK, context: int = 0, first: int = 0, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into chunks of symbols (lanes, time), the row of each chunk, and which symbols are its own.

    A chunk has ``context`` bytes of its text before and after its own ones; what lies beyond the text is
    padding.  At most ``most`` chunks from number ``first`` on are made.
    """
    counts = -(-np.diff(offs) // size)
    ends = np.cumsum(counts)
    number = np.arange(first, int(ends[-1]) if most is None else min(int(ends[-1]), first + most)) if len(counts) else np.zeros(0, np.int64)
    row = np.searchsorted(ends, number, side="right")
    start = offs[:-1][row] + (number - (ends - counts)[row]) * size
    at = start[:, None] + np.arange(-context, size + context)[None, :]
    inside = (at >= offs[:-1][row][:, None]) & (at < offs[1:][row][:, None])
    symbols = np.full(at.shape, _PAD, np.int16)
    symbols[inside] = textkit._LOWER[raw[at[inside]]]
    own = inside.copy()
    own[:, :context] = False
    own[:, context + size :] = False
    return symbols, row, own


def pooled(net: ByteGRU, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the mean probabilities over its bytes, and how many bytes are labelled with each class.

    Chunks run side by side.  Each warms its states up, in either direction, on the ``CONTEXT`` bytes of
    its text beyond its ends, so a position always sees at least so many neighbours on both sides.
    """
    rows = len(offs) - 1
    total, marks = np.zeros((rows, net.classes)), np.zeros((rows, net.classes), np.int64)
    chunks = int((-(-np.diff(offs) // CHUNK)).sum())
    for a in range(0, chunks, LANES):
        symbols, row, own = chunked(raw, offs, CHUNK, CONTEXT, a, LANES)
        probs = net.probabilities(np.ascontiguousarray(symbols.T).astype(np.int64))
        own = own.T
        best = np.where(own, probs.argmax(axis=1), -1)
        for c in range(net.classes):
            total[:, c] += np.bincount(row, np.where(own, probs[:, c], 0).sum(axis=0), rows)
            marks[:, c] += np.bincount(row, (best == c).sum(axis=0), rows).astype(np.int64)
    return total / np.maximum(np.diff(offs), 1)[:, None], marks


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[ByteGRU | None, list[str]]:
    """A network trained on a bounded sample of labelled rows, and the languages of its classes."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = usable.groupBy(F.col(lang_col).cast("string").alias("language")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each language
    if not counts:
        return None, []
    rows_per_language = min(rows_per_language, max(8, SAMPLE_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["language"], min(1.0, rows_per_language / r["n"]))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    first = F.pmod(F.xxhash64(F.col(id_col), F.lit(12)), F.greatest(F.char_length(text_col) - SLICE, F.lit(1))).cast("int") + 1
    sample = usable.where(draw < share[F.col(lang_col).cast("string")]).select(F.col(lang_col).cast("string").alias("language"), F.substring(text_col, first, F.lit(SLICE)).alias("text"), draw.alias("draw"))
    sample = sample.toArrow().sort_by([("draw", "ascending"), ("text", "ascending")])
    languages = sorted(r["language"] for r in counts)
    if not sample.num_rows:
        return None, []
    raw, offs = textkit.utf8(sample.column("text"))
    symbols, row, _ = chunked(raw, offs, 64)
    labels = np.searchsorted(np.array(languages), np.array(sample.column("language").to_pylist()))[row]
    return train(symbols.astype(np.int64), labels, len(languages)), languages


def classify(model: tuple[ByteGRU | None, list[str]], column: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(first row, end row, languages, scores, bytes labelled with each class) for blocks of a text column."""
    net, languages = model
    for a, b, raw, offs in textkit.blocks(column):
        if net is None:
            yield a, b, [UNKNOWN] * (b - a), np.zeros(b - a), np.zeros((b - a, 0), np.int64)
            continue
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw >= 97) & (raw <= 122) | (raw >= 65) & (raw <= 90), out=sums[1:])
        spoken = np.diff(sums[offs]) > 0
        for r in np.flatnonzero(~spoken):  # no ASCII letter: look at the characters
            text = raw[offs[r] : offs[r + 1]]
            spoken[r] = bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
        probs, marks = pooled(net, raw, offs)
        names = [languages[k] if s else UNKNOWN for k, s in zip(probs.argmax(axis=1), spoken)]
        yield a, b, names, np.where(spoken, np.minimum(probs.max(axis=1), 1.0), 0.0), marks


def identify(docs: DataFrame, model: tuple[ByteGRU | None, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, position_labels (bytes labelled with each language)."""
    ship.ensure(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, names, scores, marks in classify(model, batch.column("text")):
                shares = [[(model[1][c], int(n)) for c, n in enumerate(m) if n] for m in marks]
                cols = [batch.column("doc_id").slice(a, b - a), pa.array(names, pa.string()), pa.array(scores), pa.array(shares, pa.map_(pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "position_labels"])

    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, position_labels map<string,bigint>")


def keep_identified(docs: DataFrame, model: tuple[ByteGRU | None, list[str]], text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language is known with at least this score."""
    ship.ensure(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, names, scores, _ in classify(model, batch.column(text_col)):
                good = [n != UNKNOWN and s >= least for n, s in zip(names, scores)]
                yield batch.slice(a, b - a).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the labelled rows of ``docs``, then predict all of them: doc_id, held_out, lang_pred, score, position_labels."""
    found = identify(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "position_labels")
