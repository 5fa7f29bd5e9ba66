"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and labels every position; a document's
probabilities are the mean of its positions'. The state runs through the text; a long text is read
in windows that start ``CONTEXT`` bytes before and end as many after the bytes they label, so every
byte is labelled in its context, whatever stands there. Training is backpropagation through time in
numpy, on a sample bounded by a number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .arrow_map import map_rows
from .store import hash_sample

UNDETERMINED = "und"
#: Bytes that a window labels, and bytes read before and after them to set the state.
WINDOW, CONTEXT = 1024, 48
#: Positions whose labels are held at a time.
POSITIONS = 2_000_000


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


@dataclass
class BiGRU:
    """Weights of both directions: input rows per byte, recurrent matrices, biases; and the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def initial(cls, languages: list[str], hidden: int, seed: int) -> BiGRU:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            w[f"h{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            w[f"c{d}"] = np.zeros(3 * hidden)
        w["o"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, len(languages)))
        w["q"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def _direction(self, d: str, codes: np.ndarray, keep: list) -> np.ndarray:
        """Hidden states (time, row, hidden) of one direction; ``codes`` is (time, row) in its order."""
        wx, wh, c = (self.weights[k + d] for k in "xhc")
        n = wh.shape[0]
        h = np.zeros((codes.shape[1], n), dtype=wh.dtype)
        out = np.empty((*codes.shape, n), dtype=wh.dtype)
        for t, row in enumerate(codes):
            a = wx[row] + c
            b = h @ wh
            zr = _sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            g = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
            keep.append((h, z, r, g, b[:, 2 * n :]))
            h = z * h + (1 - z) * g
            out[t] = h
        return out

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of (time, row) bytes, and its gradients by backpropagation through time."""
        keep: tuple[list, list] = ([], [])
        states = np.concatenate([self._direction("f", codes, keep[0]), self._direction("b", codes[::-1], keep[1])[::-1]], axis=2)
        y = states @ self.weights["o"] + self.weights["q"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        steps, rows = codes.shape
        n = states.shape[2] // 2
        dy = np.exp(y)
        dy[:, np.arange(rows), target] -= 1
        dy /= steps * rows
        loss = -float(y[:, np.arange(rows), target].mean())
        grad = {"o": np.tensordot(states, dy, ([0, 1], [0, 1])), "q": dy.sum(axis=(0, 1))}
        ds = dy @ self.weights["o"].T
        for d, own, kept, order in (("f", ds[:, :, :n], keep[0], codes), ("b", ds[::-1, :, n:], keep[1], codes[::-1])):
            wh = self.weights[f"h{d}"]
            gh = np.zeros_like(wh)
            inputs = np.empty((steps, rows, 3 * n), dtype=wh.dtype)
            dh = np.zeros((rows, n), dtype=wh.dtype)
            for t in range(steps - 1, -1, -1):
                before, z, r, g, u = kept[t]
                dh = dh + own[t]
                dg = dh * (1 - z) * (1 - g * g)
                dz = dh * (before - g) * z * (1 - z)
                dr = dg * u * r * (1 - r)
                np.concatenate([dz, dr, dg], axis=1, out=inputs[t])
                db = np.concatenate([dz, dr, dg * r], axis=1)
                gh += before.T @ db
                dh = dh * z + db @ wh.T
            flat, read = inputs.reshape(-1, 3 * n), order.ravel()
            line = np.argsort(read, kind="stable")
            codes_seen, at = np.unique(read[line], return_index=True)
            gx = np.zeros_like(self.weights[f"x{d}"])
            gx[codes_seen] = np.add.reduceat(flat[line], at, axis=0)
            grad |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": flat.sum(axis=0)}
        return loss, grad

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Per text, the sum of all its positions' probabilities; a row of zeros for an empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(sizes) - sizes
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        core = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
        first = np.maximum(core - CONTEXT, 0)
        last = np.minimum(core + WINDOW + CONTEXT, sizes[owner])
        order = np.argsort(first - last, kind="stable")  # longest first
        step = max(1, POSITIONS // (WINDOW + 2 * CONTEXT))
        for at in range(0, len(order), step):
            own = order[at : at + step]
            label_from, label_to = (core - first)[own], np.minimum(core + WINDOW, sizes[owner])[own] - first[own]
            sums = self._read(data, (begin[owner] + first)[own], (last - first)[own], label_from, label_to)
            np.add.at(out, owner[own], sums)
        return out

    def _read(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, label_from: np.ndarray, label_to: np.ndarray) -> np.ndarray:
        """Summed probabilities over the labelled positions of windows, longest first; units are rows here."""
        n, steps, width, many = self.weights["hf"].shape[0], int(sizes[0]), len(sizes), len(self.languages)
        active = np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()  # windows that go on at each step
        out = np.zeros((many, width), dtype=np.float32)
        forward = np.empty((many, steps * width), dtype=np.float32)
        lanes, bias = np.arange(width), self.weights["q"][:, None]
        for d in "fb":
            wx, wh = (self.weights[f"x{d}"] + self.weights[f"c{d}"]).T.copy(), self.weights[f"h{d}"].T.copy()
            wx[: 2 * n] *= 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
            wh[: 2 * n] *= 0.5
            wo = (self.weights["o"][:n] if d == "f" else self.weights["o"][n:]).T.copy()
            h = np.zeros((n, width), dtype=np.float32)
            for t in range(steps):
                if (m := active[t]) < h.shape[1]:
                    h = np.ascontiguousarray(h[:, :m])
                place = t if d == "f" else sizes[:m] - 1 - t
                a, b = wx.take(data[starts[:m] + place], axis=1), wh @ h
                zr, g = a[: 2 * n], b[2 * n :]
                zr += b[: 2 * n]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                g *= zr[n:]
                g += a[2 * n :]
                np.tanh(g, out=g)
                h -= g
                h *= zr[:n]
                h += g
                if d == "f":
                    forward[:, t * width : t * width + m] = wo @ h
                    continue
                y = forward.take(place * width + lanes[:m], axis=1)
                y += wo @ h
                y += bias
                y -= y.max(axis=0)
                np.exp(y, out=y)
                y *= ((place >= label_from[:m]) & (place < label_to[:m])) / y.sum(axis=0)
                out[:, :m] += y
        return out.T

    def label(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Language and probability of non-empty texts: the mean of the positions' probabilities."""
        pooled = self.pooled(texts)
        pooled /= np.maximum(pooled.sum(axis=1, keepdims=True), 1e-30)
        best = pooled.argmax(axis=1)
        return [(self.languages[k], min(1.0, float(p[k]))) for k, p in zip(best.tolist(), pooled, strict=True)]


def train(samples: list[tuple[str, str]], hidden: int = 8, steps: int = 400, batch: int = 96, length: int = 40, seed: int = 7) -> BiGRU:
    """Fit on (text, language) pairs with Adam: each step reads ``length`` bytes from random places of random texts.

    Any place of any text can be drawn; texts are drawn evenly, whatever their length. Shorter texts
    are read over and over from their start. With no usable text the weights stay as they began.
    """
    languages = sorted({lang for _, lang in samples})
    model = BiGRU.initial(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    known = [(np.frombuffer(data, dtype=np.uint8), languages.index(lang)) for text, lang in samples if (data := text.encode("utf-8", "surrogatepass"))]
    if not known:
        return model
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(x) for k, x in model.weights.items()}
    for step in range(1, steps + 1):
        pick = [known[k] for k in rng.integers(0, len(known), batch)]
        starts = (rng.random(batch) * [max(1, len(d) - length + 1) for d, _ in pick]).astype(int)
        codes = np.stack([np.resize(d[s : s + length], length) for (d, _), s in zip(pick, starts, strict=True)], axis=1)
        _, grad = model.gradients(codes, np.array([y for _, y in pick]))
        rate = 0.03 * min(1.0, 1.5 * (1 - step / (steps + 1)) + 0.02)
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def training_sample(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 3000) -> list[tuple[str, str]]:
    """At most ``max_rows`` labelled whole texts, picked by a hash of id and length.

    The bound holds for the fit only, and predictions read every row. The driver holds ``max_rows``
    texts at most.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.length(text_col).alias("n"), usable.alias("usable"))
    picked = hash_sample(rows.filter("usable and lang is not null and text is not null"), max_rows, "id", "n")
    return sorted((r.text, r.lang) for r in picked.select("text", "lang").collect())


def identify_rows(df: DataFrame, model: BiGRU, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``df`` with the columns ``lang_out`` and ``score_out`` added (replaced, if there), for every whole text; no shuffle.

    A null text, or one with no letter, is ``und`` with score 0, as is every text where the model
    has learned no language. Very long texts are read whole, window by window. Null ids and repeated
    rows are labelled like any other row; an empty table gives no rows.
    """
    given = df.drop(lang_out, score_out)
    schema = StructType([*given.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])

    def start() -> Callable:
        def step(rows: dict[str, list]):
            found = [(UNDETERMINED, 0.0)] * len(rows[text_col])
            able = [k for k, text in enumerate(rows[text_col]) if text and model.languages and has_letter(text)]
            texts = [rows[text_col][k].encode("utf-8", "surrogatepass") for k in able]
            for k, label in zip(able, model.label(texts) if able else [], strict=True):
                found[k] = label
            yield rows | {lang_out: [f[0] for f in found], score_out: [f[1] for f in found]}

        return step

    return map_rows(given, start, schema)


def identify(df: DataFrame, model: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score), as ``identify_rows`` gives them; other columns are never read."""
    return identify_rows(df.select(id_col, text_col), model, text_col, "lang_pred", "score").select(id_col, "lang_pred", "score")
