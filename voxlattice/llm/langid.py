"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

One network reads the UTF-8 bytes of a text in both directions and gives language probabilities at every byte;
a document's probabilities are the mean over its bytes that belong to letters. The text is cut into windows of
``WINDOW`` bytes which are run side by side; every window of every text is read. Training is truncated only by
those windows: back-propagation through time over whole windows, cross-entropy at every position, Adam.

The gates use the piecewise linear sigmoid clip(x / 4 + 1 / 2, 0, 1); the candidate uses tanh.

Training rows are a bounded sample (``SAMPLE_PER_LANG`` documents of each language, by a hash of id and text), which is a
parameter; prediction reads all rows. Only text and language are read in training, only text in prediction.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; rows without language
are not trained on but predicted; with no labelled row at all every text gives ``und``; repeated rows and
other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlattice.llm.packing import slices
from voxlattice.llm.scratch import numbered

#: Labelled documents of each language that training reads at most, and bytes of each.
SAMPLE_PER_LANG = 400
SAMPLE_BYTES = 2048
HIDDEN = 12
WINDOW = 64
UNDETERMINED = "und"


@dataclass
class BiGru:
    """Weights. ``table``: input projection of each byte (256, 6H); ``rec``: block recurrent (2H, 6H); ``out``: (2H, K)."""

    langs: list[str]
    table: np.ndarray
    rec: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.table, self.rec, self.out, self.bias]


def _mask(hidden: int) -> np.ndarray:
    """Which recurrent weights exist: forward units see forward units only, backward ones backward only."""
    own = np.zeros((2 * hidden, 2 * hidden), np.float32)
    own[:hidden, :hidden] = own[hidden:, hidden:] = 1
    return np.tile(own, (1, 3))


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> BiGru:
    rng, h = np.random.default_rng(seed), hidden
    scale = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return BiGru(langs, scale(256, 6 * h), scale(2 * h, 6 * h) * _mask(h), scale(2 * h, len(langs)), np.zeros(len(langs), np.float32))


def _step(model: BiGru, x: np.ndarray, h: np.ndarray):
    """One step of both directions; columns are (update, reset, candidate) of forward and backward units."""
    n = h.shape[1]
    g = model.table[x[0]]
    both = np.concatenate  # the halves of a row of the table belong to the two directions
    gf, gb = g.reshape(len(h), 3, n), model.table[x[1]].reshape(len(h), 3, n)
    half = n // 2
    g = both([gf[:, :, :half], gb[:, :, half:]], axis=2).reshape(len(h), 3 * n)
    r = h @ model.rec
    gates = g[:, : 2 * n] + r[:, : 2 * n]
    gates *= 0.25
    gates += 0.5
    np.clip(gates, 0, 1, out=gates)
    c = r[:, 2 * n :] * gates[:, n:]
    c += g[:, 2 * n :]
    np.tanh(c, out=c)
    return gates, c, r


def hidden_states(model: BiGru, x: np.ndarray, keep: bool = False):
    """States of both directions at every position, (T, B, 2H); with ``keep`` also what back-propagation needs."""
    steps, rows = x.shape
    n = model.rec.shape[0]
    half = n // 2
    h = np.zeros((rows, n), np.float32)
    states = np.empty((steps, rows, n), np.float32)
    trace = []
    for t in range(steps):
        gates, c, r = _step(model, (x[t], x[steps - 1 - t]), h)
        new = c - h
        new *= gates[:, :n]
        new += h
        if keep:
            trace.append((h, gates, c, r))
        h = new
        states[t, :, :half] = h[:, :half]
        states[steps - 1 - t, :, half:] = h[:, half:]
    return (states, trace) if keep else states


def position_probabilities(model: BiGru, states: np.ndarray) -> np.ndarray:
    z = states @ model.out + model.bias
    z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(-1, keepdims=True)
    return z


def gradients(model: BiGru, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients by back-propagation through time; ``used`` (T, B) marks the positions that count."""
    steps, rows = x.shape
    n = model.rec.shape[0]
    half = n // 2
    states, trace = hidden_states(model, x, keep=True)
    p = position_probabilities(model, states)
    total = max(1.0, float(used.sum()))
    at = (np.arange(steps)[:, None], np.arange(rows)[None], y[None])
    loss = float(-(np.log(p[at] + 1e-9) * used).sum() / total)
    dz = p
    dz[at] -= 1
    dz *= (used / total)[:, :, None]
    d_out = states.reshape(-1, n).T @ dz.reshape(-1, dz.shape[2])
    d_bias = dz.sum((0, 1))
    d_states = dz @ model.out.T
    d_table, d_rec = np.zeros_like(model.table), np.zeros_like(model.rec)
    dh = np.zeros((rows, n), np.float32)
    for t in reversed(range(steps)):
        h, gates, c, r = trace[t]
        dh[:, :half] += d_states[t, :, :half]
        dh[:, half:] += d_states[steps - 1 - t, :, half:]
        z, reset = gates[:, :n], gates[:, n:]
        dc = dh * z * (1 - c * c)
        inside = (gates > 0) & (gates < 1)
        d_gates = np.concatenate([dh * (c - h), dc * r[:, 2 * n :]], 1) * inside * 0.25
        d_pre = np.concatenate([d_gates, dc], 1)
        d_r = np.concatenate([d_gates, dc * reset], 1)
        d_rec += h.T @ d_r
        dh = dh * (1 - z) + d_r @ model.rec.T
        cut = d_pre.reshape(rows, 3, n)
        fwd, bwd = np.zeros_like(cut), np.zeros_like(cut)
        fwd[:, :, :half], bwd[:, :, half:] = cut[:, :, :half], cut[:, :, half:]
        np.add.at(d_table, x[t], fwd.reshape(rows, 3 * n))
        np.add.at(d_table, x[steps - 1 - t], bwd.reshape(rows, 3 * n))
    return loss, [d_table, d_rec * _mask(half), d_out, d_bias]


def letter_bytes(raw: np.ndarray) -> np.ndarray:
    """Bytes that belong to letters as far as a byte can tell: ASCII letters and all of multi-byte characters."""
    return (raw >= 128) | ((raw | 32) - 97 < 26)


def windows(raw: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(N, width) bytes, zero-padded, and each window's text."""
    n = np.diff(bounds)
    count = -(-n // width)
    owner = np.repeat(np.arange(len(n)), count)
    start = bounds[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * width
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    x = padded[start[:, None] + np.arange(width)]
    x[np.arange(width)[None] >= (bounds[1:][owner] - start)[:, None]] = 0
    return x, owner


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 400, batch: int = 256, seed: int = 0) -> BiGru:
    """Fit on (bounded) labelled texts."""
    langs = sorted(set(labels))
    model = new_model(langs, hidden, seed)
    if not langs:
        return model
    order = {k: i for i, k in enumerate(langs)}
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, owner = windows(np.frombuffer(b"".join(texts), np.uint8), bounds)
    y = np.array([order[k] for k in labels])[owner]
    rng = np.random.default_rng(seed)
    # Languages are drawn evenly, so that a frequent one does not swallow the others.
    pools = [np.flatnonzero(y == k) for k in range(len(langs))]
    pools = [(k, p) for k, p in enumerate(pools) if len(p)]
    first, second = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()]
    for step in range(1, steps + 1):
        picked = [pools[i] for i in rng.integers(len(pools), size=batch)]
        rows = np.array([p[int(rng.integers(len(p)))] for _, p in picked])
        xb = x[rows].T
        _, grads = gradients(model, xb, y[rows], letter_bytes(xb).astype(np.float32))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(model.params(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


class Reader:
    """The network laid out for reading: the directions are two blocks of rows, each with its own weights."""

    def __init__(self, model: BiGru):
        n = model.rec.shape[0]
        h = self.hidden = n // 2
        table, rec = model.table.reshape(256, 3, n), model.rec.reshape(n, 3, n)
        # Gates are clip(x / 4 + 1 / 2); scale and shift go into the weights.
        scale = np.array([0.25, 0.25, 1], np.float32)[:, None]
        shift = np.array([0.5, 0.5, 0], np.float32)[:, None]
        half = [slice(0, h), slice(h, n)]
        self.table = np.concatenate([(table[:, :, k] * scale + shift).reshape(256, 3 * h) for k in half]).astype(np.float32)
        self.rec = np.stack([(rec[k][:, :, k] * scale).reshape(h, 3 * h) for k in half]).astype(np.float32)
        self.out, self.bias = [model.out[k] for k in half], model.bias

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows (T, B): sums over letter bytes of the position probabilities (B, K), and the bytes' number."""
        steps, rows = x.shape
        n = self.hidden
        used = letter_bytes(x)
        at = np.concatenate([x, x[::-1].astype(np.int16) + 256], axis=1).astype(np.intp)
        h = np.zeros((2, rows, n), np.float32)
        states = np.empty((2, steps, rows, n), np.float32)
        g, r = np.empty((2 * rows, 3 * n), np.float32), np.empty((2, rows, 3 * n), np.float32)
        for t in range(steps):
            np.take(self.table, at[t], axis=0, out=g, mode="clip")
            np.matmul(h, self.rec, out=r)
            gr = g.reshape(2, rows, 3 * n)
            gates = gr[:, :, : 2 * n]
            gates += r[:, :, : 2 * n]
            np.minimum(gates, 1, out=gates)
            np.maximum(gates, 0, out=gates)
            c = r[:, :, 2 * n :] * gates[:, :, n:]
            c += gr[:, :, 2 * n :]
            np.tanh(c, out=c)
            c -= h
            c *= gates[:, :, :n]
            h += c
            states[0, t] = h[0]
            states[1, steps - 1 - t] = h[1]
        z = states[0] @ self.out[0]
        z += states[1] @ self.out[1]
        z += self.bias
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z *= (used / z.sum(-1))[:, :, None]
        return z.sum(0), used.sum(0)


def document_probabilities(model: BiGru, raw: np.ndarray, bounds: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Mean of the position probabilities over each text's letter bytes, (texts, K); zeros where it has none."""
    n = len(bounds) - 1
    sums, count, reader = np.zeros((n, len(model.langs))), np.zeros(n), Reader(model)
    x, owner = windows(raw, bounds)
    for a in range(0, len(x), rows):
        p, used = reader.pooled(np.ascontiguousarray(x[a : a + rows].T))
        np.add.at(sums, owner[a : a + rows], p)
        np.add.at(count, owner[a : a + rows], used)
    return sums / np.maximum(count, 1)[:, None]


def sample_labelled(docs: DataFrame, text_col: str, lang_col: str, per_lang: int = SAMPLE_PER_LANG, n_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """At most ``per_lang`` different labelled texts of each language, smallest hashes first; their rows come to the driver.

    Of a longer text a stretch of ``n_bytes`` is taken, from a place that its hash names: no opening stands for the whole.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    # Thin by hash before anything is ranked, so that no task sees a language whole; then copies go.
    keep = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, 2.0 * per_lang / n + 50 / n)
        keep = keep | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))))
    begin = F.pmod(F.xxhash64(F.col("h")), F.greatest(F.length("text") - n_bytes + 1, F.lit(1))).cast("int") + 1
    found = rows.where(keep).select("lang", "h", F.col("text").substr(begin, F.lit(n_bytes)).alias("text")).distinct().collect()
    texts, labels, taken = [], [], {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["text"])):
        if taken.setdefault(r["lang"], 0) < per_lang:
            taken[r["lang"]] += 1
            texts.append(r["text"].encode()[:n_bytes])
            labels.append(r["lang"])
    return texts, labels


def predict(docs: DataFrame, model: BiGru, text_col: str = "text", keep: list[Column] | None = None, least: float | None = None, keep_text: bool = False) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for every row, from its whole text.

    With ``least`` only the rows whose language is determined with at least that score.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    # Texts without a letter need no network; the others go to it whole.
    rows = docs.select(*(keep or []), F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__read"))
    kept = len(rows.columns) - (1 if keep_text else 2)
    schema = T.StructType([*rows.schema.fields[:kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = held.value
        for whole in batches:
            for batch in slices(whole, "__text", 2_000_000):
                lang, score = _batch_languages(model, batch.column("__text"), batch.column("__read").to_numpy(zero_copy_only=False))
                out = pa.record_batch([*batch.columns[:kept], pa.array(lang, pa.string()), pa.array(score)], names=schema.names)
                if least is not None:
                    out = out.filter(pa.array([k != UNDETERMINED and s >= least for k, s in zip(lang, score, strict=True)], pa.bool_()))
                yield out

    return rows.mapInArrow(run, schema)


def _batch_languages(model: BiGru, texts: pa.Array, read: np.ndarray) -> tuple[list[str], np.ndarray]:
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    due = np.flatnonzero(read)
    if model.langs and len(due):
        read_texts = texts.take(pa.array(due))
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(read_texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        p = document_probabilities(model, np.frombuffer(b"".join(x.as_buffer() for x in read_texts), np.uint8), bounds)
        for k, i in enumerate(due.tolist()):
            lang[i], score[i] = model.langs[int(p[k].argmax())], min(1.0, float(p[k].max()))
    return lang, score


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **kw) -> BiGru:
    return train(*sample_labelled(docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), text_col, lang_col, **kw))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by a model fitted on those that are not held out."""
    model = fit(docs, text_col, lang_col, id_col)
    keep = [F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out")]
    return predict(docs, model, text_col, keep)


def drop_unidentified(docs: DataFrame, least: float = 0.3, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of ``least`` or more, with all columns.

    Where no labelled row says what languages there are, all texts with a letter stay.
    """
    model, names = fit(docs, text_col, lang_col, id_col), docs.columns
    if not model.langs:
        plain, text = numbered(docs, text_col)
        return plain.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).toDF(*names)
    # Columns travel under names of their own, so that none can clash; the text travels once.
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index(text_col)}"
    others = [F.col(c) for c in plain.columns if c != text]
    found = predict(plain, model, text, others, least, keep_text=True)
    return found.select(*[F.col("__text" if f"c{k}" == text else f"c{k}").alias(n) for k, n in enumerate(names)])
