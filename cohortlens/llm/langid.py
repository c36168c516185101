"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of
labelled rows (``SAMPLE_PER_LANG`` slices of ``SLICE_CHARS`` characters a language), then labels every
position of every whole text.  A text is read in windows of ``STEPS`` bytes; both directions
run at once, and the probabilities at letters are pooled into the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import textvec as V
from .shared import giving_back

HIDDEN = 8
STEPS = 64
BATCH = 2048
SAMPLE_PER_LANG = 400
SLICE_CHARS = 512
EPOCHS = 6
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class BiGRU:
    """Gates z, r and candidate n; weights by direction: ``x`` (2, 256, 3H) for the byte read,
    ``u`` (2, H, 3H) for the state; ``o`` (2, H, C) and ``b`` (C) for the labels."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        self.hidden, self.classes = hidden, classes
        self.w = {"x": f(2, 256, 3 * hidden, k=0.3), "u": f(2, hidden, 3 * hidden, k=0.3),
                  "o": f(2, hidden, classes, k=0.3), "b": np.zeros(classes, np.float32)}

    def states(self, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(2, steps, batch, H): what each direction holds after reading each position of
        ``seq`` (steps, batch).  ``keep`` gets what the backward pass needs, by step."""
        steps, batch = seq.shape
        H = self.hidden
        x, u = self.w["x"].reshape(512, -1), self.w["u"]
        out = np.empty((2, steps, batch, H), np.float32)
        h = np.zeros((2, batch, H), np.float32)
        index = np.stack([seq, seq[::-1]]).astype(np.int64)
        index[1] += 256
        for t in range(steps):
            a = x[index[:, t]]
            g = h @ u
            zr = a[..., :2 * H] + g[..., :2 * H]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[..., :H], zr[..., H:]
            n = r * g[..., 2 * H:]
            n += a[..., 2 * H:]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep is not None:
                keep.append((h, z, r, n, g[..., 2 * H:], index[:, t]))
            h = new
            out[0, t], out[1, steps - 1 - t] = h[0], h[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(steps, batch, C): label probabilities of each position."""
        logits = states[0] @ self.w["o"][0]
        logits += states[1] @ self.w["o"][1]
        logits += self.w["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, seq: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over letters; ``label`` (batch) holds for all positions."""
        keep: list = []
        states = self.states(seq, keep)
        steps, batch = seq.shape
        H = self.hidden
        at = _LETTER[seq]
        d = self.probabilities(states)
        d[:, np.arange(batch), label] -= 1
        d *= (at / max(1, at.sum()))[..., None].astype(np.float32)
        grad = {"b": d.sum(axis=(0, 1)), "o": np.stack([np.einsum("tbh,tbc->hc", states[k], d) for k in (0, 1)]),
                "u": np.zeros_like(self.w["u"]), "x": np.zeros((512, 3 * H), np.float32)}
        into = np.stack([d @ self.w["o"][0].T, (d @ self.w["o"][1].T)[::-1]])  # in reading order
        dh = np.zeros((2, batch, H), np.float32)
        ut = self.w["u"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, gn, index = keep[t]
            dh = dh + into[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=-1)
            np.add.at(grad["x"], index.ravel(), np.concatenate([dz, dr, dn], axis=-1).reshape(-1, 3 * H))
            grad["u"] += h.transpose(0, 2, 1) @ dg
            dh = dh * z + dg @ ut
        grad["x"] = grad["x"].reshape(2, 256, 3 * H)
        return grad

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.02, seed: int = 5) -> None:
        """Adam over shuffled batches of ``windows`` (rows, steps)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, total = 0, max(1, epochs * -(-len(labels) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), batch):
                at = order[lo:lo + batch]
                grad = self.gradients(np.ascontiguousarray(windows[at].T), labels[at])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, w in self.w.items():
                    g = np.clip(grad[k], -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    w -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def windows(data: np.ndarray, offs: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, steps) bytes (A-Z lower-cased, 0 beyond a document's end) and each row's document."""
    length = np.diff(offs)
    count = -(-length // steps)
    doc = np.repeat(np.arange(len(length)), count)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    place = (offs[doc] + inner * steps)[:, None] + np.arange(steps)
    inside = place < offs[doc + 1][:, None]
    out = V.lowered(data)[np.where(inside, place, 0)] if len(data) else np.zeros((0, steps), np.uint8)
    out[~inside] = 0
    return out, doc


def pooled(model: BiGRU, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, C): mean label probability over a document's letters; 0 without any."""
    rows, doc = windows(data, offs)
    total = np.zeros((len(offs) - 1, model.classes + 1))
    for lo in range(0, len(rows), BATCH):
        seq = np.ascontiguousarray(rows[lo:lo + BATCH].T)
        at = _LETTER[seq].astype(np.float32)
        p = model.probabilities(model.states(seq))
        part = np.empty((seq.shape[1], model.classes + 1))
        part[:, :-1] = np.einsum("tbc,tb->bc", p, at)
        part[:, -1] = at.sum(axis=0)
        d = doc[lo:lo + BATCH]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        total[d[first]] += np.add.reduceat(part, first, axis=0)
    return total[:, :-1] / np.maximum(total[:, -1:], 1)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text has remainder 2 modulo 4 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, chars: int = SLICE_CHARS) -> pd.DataFrame:
    """(lang, slice): at most ``per_lang`` labelled training rows a language, chosen by a hash of
    the id, one slice of each at a hashed place."""
    h = F.xxhash64("doc_id")
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    at = (F.pmod(h, F.greatest(F.lit(1), F.char_length("text") - chars + 1)) + 1).cast("int")
    rows = rows.select("lang", "doc_id", F.substring(F.col("text"), at, F.lit(chars)).alias("slice"))
    order = Window.partitionBy("lang").orderBy(h, "doc_id", "slice")
    return (rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang)
            .orderBy("lang", "_n").select("lang", "slice").toPandas())


def train(rows: pd.DataFrame) -> tuple[list[str], BiGRU | None]:
    """(languages in order, network) from a sample; no network below two languages."""
    langs = sorted(rows["lang"].unique())
    if len(langs) < 2:
        return langs, None
    data, offs = V.utf8(pa.array(rows["slice"], pa.large_string()))
    seq, doc = windows(data, offs)
    labels = np.searchsorted(langs, rows["lang"].to_numpy(dtype=object).astype(str))[doc]
    model = BiGRU(len(langs))
    model.fit(seq, labels)
    return langs, model


PRED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, langs: list[str], model: BiGRU | None, column: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (the pooled probability).  ``und`` with
    score 0 where the text is null or has no letter, or nothing was learned; with one
    language learned, that one with score 1.  Raises if a result column is there already."""
    if taken := sorted(set(docs.columns) & {"lang_pred", "score", "_letter"}):
        raise ValueError(f"columns are there already: {taken}")
    keep = docs.columns
    letters = F.coalesce(F.col(f"`{column}`").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in V.blocks(batch.column(column)):
                has = batch.column("_letter").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                p = pooled(model, data, offs) if model is not None else np.ones((hi - lo, 1)) * bool(langs)
                best = p.argmax(axis=1)
                score = np.where(has, np.minimum(1, p[np.arange(hi - lo), best]), 0.0)
                names = [langs[k] if ok and langs else UNKNOWN for k, ok in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(names, pa.string()), pa.array(score)],
                                                 names=[*keep, "lang_pred", "score"])

    return docs.withColumn("_letter", letters).mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, *PRED]))


def identified(docs: DataFrame) -> DataFrame:
    """Train on the training rows of ``docs`` and predict all: doc_id, held_out, lang_pred, score."""
    langs, model = train(sample(docs.select("doc_id", "text", "lang")))
    out = predict(docs.select("doc_id", "text"), langs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
