"""Language of whole texts from a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW``; in each, one gated recurrent unit
reads forwards and another backwards, both from a zero state, and the two states at a
position give that position's probabilities of the languages. Every position is labelled so;
a document's probabilities are the means over all its positions, and the largest is predicted (of equal
ones the first language in order). All windows of a batch move in step, so that a step is
a few array operations and a text's length costs time in proportion.

Fitting is backpropagation through time in numpy, on the driver, over at most ``sample`` documents,
of each language those whose ids hash lowest, ``per_language`` at first, and at most ``WINDOWS`` evenly spaced windows of each. These are
parameters; what reaches the driver is at most ``sample * WINDOWS`` windows. A prediction reads
every byte of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
nothing can be learned; a row without an id is held out; rows that repeat are predicted
each, and equal texts get equal results; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Batches, lean, slices

#: Bytes of a window, and the byte that stands for no byte behind a text's end.
WINDOW, PAD = 128, 256
#: What PAD adds to the update gate: a state stays as it is, so the backward direction starts at a text's end.
HOLD = 60.0
#: Windows of one document that fitting may see.
WINDOWS = 6
#: Windows that move in step.
LOCKSTEP = 2048
UNDETERMINED = "und"


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: crc32 of the id as text is a multiple of 5; rows without an id are."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(True))


@dataclass
class Network:
    """Input tables (2, 3h, 257) and recurrent weights (2, 3h, h) of both directions, in the order update, reset,
    candidate; output weights (languages, 2h) and biases; the languages, sorted.

    Texts lie along the last axis everywhere, so that each operation runs over whole rows.
    """

    inputs: np.ndarray
    recurrent: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray
    languages: list[str]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        inputs = normal(2, 3 * hidden, 257) * np.float32(0.3)
        inputs[:, :, PAD] = 0
        inputs[:, :hidden, PAD] = HOLD
        return cls(inputs, normal(2, 3 * hidden, hidden) / np.float32(hidden**0.5), normal(len(languages), 2 * hidden) * np.float32(0.1), np.zeros(len(languages), np.float32), languages)

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions at each position of ``codes`` (width, n): (width, 2h, n). ``keep`` takes what going back needs."""
        width, n = codes.shape
        h = self.recurrent.shape[2]
        out = np.empty((width, 2 * h, n), np.float32)
        state = np.zeros((2, h, n), np.float32)
        for t in range(width):
            gates = np.stack([np.take(self.inputs[0], codes[t], axis=1), np.take(self.inputs[1], codes[width - 1 - t], axis=1)])
            sums = self.recurrent @ state
            both = gates[:, : 2 * h] + sums[:, : 2 * h]
            both *= 0.5
            np.tanh(both, out=both)
            both += 1.0
            both *= 0.5
            update, reset, inner, new = both[:, :h], both[:, h:], sums[:, 2 * h :], gates[:, 2 * h :]
            new += reset * inner
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state, update, reset, inner, new))
            state = state - new
            state *= update
            state += new
            out[t, :h], out[width - 1 - t, h:] = state[0], state[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position: (width, languages, n)."""
        p = self.outputs @ states
        p += self.biases[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (texts, languages); 0 for an empty one."""
        total = np.zeros((len(texts), len(self.languages)))
        owner, codes = cut(texts)
        order = np.argsort((codes == PAD).sum(axis=1), kind="stable")  # short windows stand together
        for i in range(0, len(order), LOCKSTEP):
            at = order[i : i + LOCKSTEP]
            window = codes[at]
            window = window[:, : int((window != PAD).sum(axis=1).max())].T.astype(np.intp)
            p = self.probabilities(self.states(window))
            p *= (window != PAD)[:, None]
            np.add.at(total, owner[at], p.sum(axis=0, dtype=np.float64).T)
        return total / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts, one after the other: place of the text, and byte codes (windows, WINDOW)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-length // WINDOW)
    codes = np.full(int(count.sum()) * WINDOW, PAD, np.int16)
    start = (np.cumsum(count) - count) * WINDOW
    for at, text in zip(start.tolist(), texts, strict=True):
        codes[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return np.repeat(np.arange(len(texts)), count), codes.reshape(-1, WINDOW)


def gradients(network: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of ``codes`` (width, n), and its gradients by backpropagation through time.

    Their order is that of ``inputs, recurrent, outputs, biases``.
    """
    width, n = codes.shape
    h = network.recurrent.shape[2]
    kept: list = []
    states = network.states(codes, kept)
    p = network.probabilities(states)
    real = codes != PAD
    total = max(1, int(real.sum()))
    own = p[:, labels, np.arange(n)]
    loss = float(-np.log(np.maximum(own[real], 1e-12)).sum() / total)
    p[:, labels, np.arange(n)] -= 1
    p *= real[:, None] / np.float32(total)
    by_outputs = np.einsum("tln,thn->lh", p, states, optimize=True)
    above = network.outputs.T @ p
    by_recurrent = np.zeros_like(network.recurrent)
    by_gates = np.empty((2, 3 * h, width, n), network.inputs.dtype)
    back = np.zeros((2, h, n), network.inputs.dtype)
    turned = network.recurrent.transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        before, update, reset, inner, new = kept[t]
        back = back + np.stack([above[t, :h], above[width - 1 - t, h:]])
        by_new = back * (1 - update) * (1 - new * new)
        by_update = back * (before - new) * update * (1 - update)
        by_reset = by_new * inner * reset * (1 - reset)
        for d, place in enumerate((t, width - 1 - t)):
            by_gates[d, :, place] = np.concatenate([by_update[d], by_reset[d], by_new[d]])
        sums = np.concatenate([by_update, by_reset, by_new * reset], axis=1)
        by_recurrent += sums @ before.transpose(0, 2, 1)
        back = back * update + turned @ sums
    order = np.argsort(codes, axis=None, kind="stable")
    known, start = np.unique(codes.ravel()[order], return_index=True)
    by_inputs = np.zeros_like(network.inputs)
    by_inputs[:, :, known] = np.add.reduceat(by_gates.reshape(2, 3 * h, -1)[:, :, order], start, axis=2)
    by_inputs[:, :, PAD] = 0
    return loss, [by_inputs, by_recurrent, by_outputs, p.sum(axis=(0, 2))]


def fit(windows: np.ndarray, labels: list[str], hidden: int = 12, steps: int = 320, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam over batches that hold every language alike often."""
    languages = sorted(set(labels))
    network = Network.fresh(languages, hidden, seed)
    if len(languages) < 2:
        return network
    place = {x: i for i, x in enumerate(languages)}
    label = np.array([place[x] for x in labels])
    members = [np.flatnonzero(label == i) for i in range(len(languages))]
    codes = windows.T.astype(np.intp)
    rng = np.random.default_rng(seed)
    weights = [network.inputs, network.recurrent, network.outputs, network.biases]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        drawn = np.arange(batch) % len(languages) if len(languages) <= batch else rng.integers(0, len(languages), batch)
        at = np.array([members[c][rng.integers(len(members[c]))] for c in drawn])
        _, grads = gradients(network, codes[:, at], label[at])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def _windows(batches: Batches) -> Batches:
    """Evenly spaced windows of each text, at most ``WINDOWS``, as bytes."""
    for piece in slices(batches, "text"):
        found = []
        for text in piece.column("text").to_pylist():
            data = text.encode("utf-8", "surrogatepass")
            n = -(-len(data) // WINDOW)
            found.append([data[k * WINDOW : (k + 1) * WINDOW] for k in sorted({i * (n - 1) // max(1, WINDOWS - 1) for i in range(WINDOWS)})] if n else [])
        yield pa.record_batch([piece.column("lang"), piece.column("_by"), pa.array(found, pa.list_(pa.binary()))], ["lang", "_by", "found"])


def train(docs: DataFrame, sample: int = 3000, per_language: int = 400, **how: float) -> Network:
    """A network from the documents that are not held out; see the module's text for the bounds."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("_by"))
    found = rows.mapInArrow(lean(_windows), "lang string, _by long, found array<binary>")  # texts stay where they are
    # The lowest of each language are found in each partition, then in 64 parts, then whole; last, languages share the bound.
    for part in (", pmod(_by, 64)", ""):
        found = found.selectExpr("lang", "_by", "found", f"row_number() OVER (PARTITION BY lang{part} ORDER BY _by, found) AS _n").where(F.col("_n") <= per_language)
    got = found.orderBy("_n", "_by", "lang", "found").limit(sample).select("lang", "found").toArrow()
    pairs = [(lang, window) for lang, windows in zip(got.column("lang").to_pylist(), got.column("found").to_pylist(), strict=True) for window in windows]
    return fit(cut([w for _, w in pairs])[1], [lang for lang, _ in pairs], **how)


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few hundred KB for any input

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for piece in slices(iter([batch]), "text", 1 << 20):
                texts = [t.encode("utf-8", "surrogatepass") if letter else b"" for t, letter in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)]
                if net.languages:
                    pooled = net.pooled(texts)
                    best = pooled.argmax(axis=1)
                    said = [net.languages[b] if t else UNDETERMINED for b, t in zip(best.tolist(), texts, strict=True)]
                    score = np.round(np.clip(pooled[np.arange(len(best)), best], 0, 1), 4)
                else:
                    said, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select("doc_id", held_out().alias("held_out"), "text", letter).mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")
