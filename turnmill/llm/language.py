"""Language of texts by a byte convolutional network, trained and applied in numpy.

Bytes (letters folded to lower case) are embedded, convolved by filters of
several widths, rectified, pooled by their maximum over a fixed window, and
classified by softmax.  A text is cut into windows of ``WINDOW`` bytes that cover
all of it (the last is padded); a text's probabilities are the means over its
windows, weighted by their letters.

Training takes at most ``SAMPLE_ROWS`` labelled documents, those with the lowest
hash of their id, and at most ``SAMPLE_WINDOWS`` windows of each.

Defined results: null text and text without a letter is ``und`` with score 0;
so is every text if nothing could be learned.  A language that the sample lacks
cannot be predicted.  Rows with null language or id teach nothing.  Repeated
rows get equal results and teach once.  Of equal probabilities, the language
first in order is named.  Very long texts are read whole, window by window.
Columns other than id, text and, to learn from, lang play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import is_held_out

WINDOW = 256
SAMPLE_ROWS = 3000
SAMPLE_WINDOWS = 4
HELD_OUT = 1
UNKNOWN = "und"
WIDTHS = (2, 3, 4)
_LETTERISH = np.zeros(256, np.float32)
_LETTERISH[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def fold(raw: np.ndarray) -> np.ndarray:
    """Bytes with ASCII capitals and those of Latin-1 (two bytes) in lower case, and digits as one."""
    out = common.LOWER[raw]
    out[(out >= 48) & (out <= 57)] = 48
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def windows(raw: np.ndarray, limits: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, window) that tile every text, padded by 0, and the text of each."""
    counts = -(-np.diff(limits) // window)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = limits[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
    at = first[:, None] + np.arange(window)
    inside = at < limits[doc + 1][:, None]
    return np.where(inside, raw[np.where(inside, at, 0)] if len(raw) else 0, 0).astype(np.uint8), doc


class ByteCNN:
    def __init__(self, languages: list[str], size: int = 8, filters: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (256, size)), "out": rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * size) ** -0.5, (w * size, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        embed = self.p["embed"][x]
        n, length, size = embed.shape
        pooled, kept = [], {}
        for w in WIDTHS:
            patches = np.lib.stride_tricks.as_strided(embed, (n, length - w + 1, w * size), embed.strides[:1] + embed.strides[1:2] + embed.strides[2:])
            response = np.ascontiguousarray(patches).reshape(-1, w * size) @ self.p[f"w{w}"]
            response = response.reshape(n, length - w + 1, -1)
            kept[w] = (patches, response)
            pooled.append(np.maximum(response.max(1) + self.p[f"b{w}"], 0))
        return np.concatenate(pooled, 1), kept

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        """Probabilities (n, languages) of windows."""
        parts = [self._softmax(self._pooled(x[k : k + batch])[0]) for k in range(0, len(x), batch)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept = self._pooled(x)
        d = self._softmax(pooled)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": pooled.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = (d @ self.p["out"].T) * (pooled > 0)
        size = self.p["embed"].shape[1]
        at = 0
        for w, (patches, response) in kept.items():
            f = response.shape[2]
            own = back[:, at : at + f]
            best = response.argmax(1)
            taken = patches[np.arange(len(x))[:, None], best]
            g[f"w{w}"] = np.einsum("nfp,nf->pf", taken, own)
            g[f"b{w}"] = own.sum(0)
            spread = (own[:, :, None] * self.p[f"w{w}"].T[None]).reshape(-1, w, size)
            used = x[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(w)].reshape(-1, w)
            np.add.at(g["embed"], used.ravel(), spread.reshape(-1, size))
            at += f
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 3e-3, seed: int = 3) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m, v, t = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)), None, 0
        first, second = m
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                part = order[k : k + batch]
                t += 1
                for name, g in self._gradients(x[part], y[part]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        raw, limits = common.text_buffer(batch.column("text"))
        x, doc = windows(fold(raw), limits)
        langs, out = batch.column("lang").to_pylist(), []
        first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        for k, lang in enumerate(langs):
            n = first[k + 1] - first[k]
            for j in np.unique(np.linspace(0, n - 1, min(n, SAMPLE_WINDOWS)).astype(int)) if n else ():
                if _LETTERISH[x[first[k] + j]].sum() >= 4:
                    out.append((lang, x[first[k] + j].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], ["lang", "x"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ByteCNN | None:
    """Fit on documents (doc_id, text, lang) that are not held out; None if there are none."""
    usable = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), 3, HELD_OUT))
    sample = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample_rows)  # the bound of what is broadcast and collected
    # One text of each id and language: the least, so that repeated rows change nothing.
    joined = docs.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    rows = common.map_arrow(joined, _sample_windows, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    names = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(names).fit(x, np.array([names.index(r["lang"]) for r in rows]))


def predict(docs: DataFrame, model: ByteCNN | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every text."""
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raw, limits = common.text_buffer(batch.column("text"))
            n, known = batch.num_rows, batch.column("has_letter").to_numpy(zero_copy_only=False)
            names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None and known.any():
                x, doc = windows(fold(raw), limits)
                weight = _LETTERISH[x].sum(1) + 1e-3
                sums = np.zeros((n, len(model.languages)))
                np.add.at(sums, doc, model.predict(x) * weight[:, None])
                best = sums.argmax(1)
                names = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                scores = np.where(known, sums.max(1) / np.maximum(sums.sum(1), 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names.tolist(), pa.string()), pa.array(np.clip(scores, 0, 1))], ["id", "lang_pred", "score"])

    return common.map_arrow(docs, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those not held out."""
    return predict(docs, train(docs)).select("doc_id", is_held_out(F.col("doc_id"), 3, HELD_OUT).alias("held_out"), "lang_pred", "score")
