"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

The network is trained here, in NumPy, by backpropagation through time, on windows of ``WINDOW`` bytes from a bounded
sample of labelled texts: ``SAMPLE`` texts a label on average, ``SAMPLE_TEXTS`` over all labels, and ``SAMPLE_WINDOWS``
windows of each, at places drawn from its whole length. This bounds what is fitted on, and with it what the driver holds,
however long texts are and however many labels there are; a label is a language, so their names fit on the driver. It
labels every position: one recurrent state comes from the left and one from the right, and both give the position's probabilities. A
document's probabilities are the means over all positions of its whole text, read in successive windows.

Defined results: a text that is null or has no letter (``\\p{L}``) is ``und`` with score 0, as is every text where there
is nothing to learn from; a null id is in neither part, so it is predicted and never learnt from; null labels are not
learnt from; repeated rows are each predicted; a very long text is read whole; of equal probabilities the first label by
name counts; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.kernel import blocks, lean, text_arrays
from voxtable.llm.shared import table

UNDETERMINED = "und"
WINDOW, HIDDEN = 48, 8
SAMPLE, SAMPLE_TEXTS, SAMPLE_WINDOWS = 200, 20_000, 24
STEPS, BATCH, RATE = 240, 256, 0.02
SEED = 11
#: Windows that run through the network at once.
TOGETHER = 4096


class Network:
    """Weights of both directions; all states are (hidden, batch)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(hidden)).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.w = {}
        for side in "fb":
            self.w |= {f"e{side}": draw(3 * hidden, 256), f"u{side}": draw(2 * hidden, hidden), f"v{side}": draw(hidden, hidden), f"o{side}": draw(len(labels), hidden)}
        self.w["bias"] = np.zeros((len(labels), 1), np.float32)

    def states(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """(time, hidden, batch) states after each position, from the left ("f") or the right ("b").

        Gates are (1 + tanh(a)) / 2, which is the logistic function of 2a.
        """
        e, u, v, n = self.w[f"e{side}"], self.w[f"u{side}"], self.w[f"v{side}"], self.hidden
        out = np.empty((len(x), n, x.shape[1]), np.float32)
        h = np.zeros((n, x.shape[1]), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            given = np.take(e, x[t], axis=1)
            gates = u @ h
            gates += given[: 2 * n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            reset = gates[:n] * h
            new = v @ reset
            new += given[2 * n :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, h, gates, reset, new))
            change = new - h
            change *= gates[n:]
            h = np.add(h, change, out=out[t])
        return out

    def probabilities(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Softmax over the labels: (labels, batch) for the states of one position."""
        p = self.w["of"] @ left
        p += self.w["ob"] @ right
        p += self.w["bias"]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def pooled(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """(labels, batch): the sums of the positions' probabilities, where ``inside`` is 1."""
        left, right = self.states(x, "f"), self.states(x, "b")
        total = np.zeros((len(self.labels), x.shape[1]), np.float32)
        for t in range(len(x)):
            p = self.probabilities(left[t], right[t])
            p *= inside[t]
            total += p
        return total

    def gradients(self, x: np.ndarray, inside: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the positions, and its gradient by each weight."""
        n, g = self.hidden, {k: np.zeros_like(w) for k, w in self.w.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {side: self.states(x, side, kept[side]) for side in "fb"}
        positions, loss = max(1.0, float(inside.sum())), 0.0
        errors = []
        for t in range(len(x)):
            p = self.probabilities(states["f"][t], states["b"][t])
            loss -= float((np.log(p[target, np.arange(len(target))] + 1e-9) * inside[t]).sum())
            p[target, np.arange(len(target))] -= 1
            p *= inside[t] / positions
            errors.append(p)
            g["bias"] += p.sum(axis=1, keepdims=True)
            for side in "fb":
                g[f"o{side}"] += p @ states[side][t].T
        for side in "fb":
            u, v, o = self.w[f"u{side}"], self.w[f"v{side}"], self.w[f"o{side}"]
            back = np.zeros_like(states[side][0])
            by_input = np.zeros((256, 3 * n), np.float32)
            for t, h, gates, reset, new in reversed(kept[side]):
                back = back + o.T @ errors[t]
                r, z = gates[:n], gates[n:]
                d_new = back * z * (1 - new * new)
                d_reset = v.T @ d_new
                d_gates = np.concatenate([d_reset * h * r * (1 - r), back * (new - h) * z * (1 - z)]) * 2
                g[f"v{side}"] += d_new @ reset.T
                g[f"u{side}"] += d_gates @ h.T
                np.add.at(by_input, x[t], np.concatenate([d_gates, d_new]).T)
                back = back * (1 - z) + d_reset * r + u.T @ d_gates
            g[f"e{side}"] = by_input.T
        return loss / positions, g

    def train(self, windows: list[bytes], targets: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over batches with equal shares of the labels. Returns the last loss."""
        rng, loss = np.random.default_rng(seed), float("nan")
        x, inside = rectangle(windows)
        by_label = [np.flatnonzero(targets == k) for k in range(len(self.labels))]
        m, s = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, max(1, batch // len(by_label))) for rows in by_label if len(rows)])
            loss, g = self.gradients(x[:, pick], inside[:, pick], targets[pick])
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                now = rate * min(1, 2 * (1 - step / (steps + 1)))
                self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def rectangle(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) bytes and whether a position is inside, for windows of WINDOW bytes at most."""
    x, inside = np.zeros((len(windows), WINDOW), np.uint8), np.zeros((len(windows), WINDOW), np.float32)
    for k, w in enumerate(windows):
        x[k, : len(w)], inside[k, : len(w)] = np.frombuffer(w, np.uint8), 1
    return np.ascontiguousarray(x.T), np.ascontiguousarray(inside.T)


def predict(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, labels): mean probabilities over all positions of each text; 0 for texts without bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, stops = offsets[owner] + nth * WINDOW, offsets[owner + 1]
    total = np.zeros((len(sizes), len(network.labels)))
    for a in range(0, len(owner), TOGETHER):
        at = starts[a : a + TOGETHER][None, :] + np.arange(WINDOW)[:, None]
        inside = at < stops[a : a + TOGETHER]
        x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        sums = network.pooled(x, inside.astype(np.float32))
        for k in range(len(network.labels)):
            total[:, k] += np.bincount(owner[a : a + TOGETHER], sums[k], len(sizes))
    return total / np.maximum(sizes, 1)[:, None]


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, texts: int, seed: int = SEED) -> list[tuple[str, bytes]]:
    """(label, window) from about ``texts`` texts of each label (fewer where that is over ``SAMPLE_TEXTS``), chosen by a hash of the id, at places chosen by seed."""
    usable = docs.where((remainder(id_col) != 2) & F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(label_col).alias("label"), F.xxhash64(F.lit(seed), id_col).alias("key"), F.col(text_col).alias("text")
    )
    counts = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    if not counts:
        return []
    texts = max(1, min(texts, SAMPLE_TEXTS // len(counts)))
    share = F.create_map(*(F.lit(x) for label, n in sorted(counts.items()) for x in (label, min(1.0, texts / n))))
    chosen = usable.where(F.pmod("key", F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, windows, keys = [], [], []
            for label, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, rng = text.encode(), np.random.default_rng(abs(key))
                last = max(0, len(raw) - WINDOW)
                places = np.unique(rng.integers(0, last + 1, SAMPLE_WINDOWS))
                labels += [label] * len(places)
                keys += [key] * len(places)
                windows += [raw[p : p + WINDOW] for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(keys, pa.int64()), pa.array(windows, pa.binary())], names=["label", "key", "window"])

    rows = chosen.mapInArrow(cut, "label string, key long, window binary").collect()
    return sorted(((r[0], bytes(r[2])) for r in rows))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", texts: int = SAMPLE) -> Network | None:
    rows = sample(docs, id_col, text_col, label_col, texts)
    labels = sorted({label for label, _ in rows})
    if not labels:
        return None
    network, number = Network(labels), {label: k for k, label in enumerate(labels)}
    network.train([w for _, w in rows], np.array([number[label] for label, _ in rows]))
    return network


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"),
        F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("__text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_arrays(batch.column(2))
            languages, scores = [], []
            for a, b in blocks(offsets):
                if model is None:
                    languages += [UNDETERMINED] * (b - a)
                    scores.append(np.zeros(b - a))
                    continue
                p = predict(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                have = np.diff(offsets[a : b + 1]) > 0
                languages += [model.labels[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(axis=1), have, strict=True)]
                scores.append(np.clip(p.max(axis=1), 0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], names=[id_col, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)['__id']}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
