"""Language identification by a convolutional network over bytes.

Filters of several widths over one-hot bytes, a maximum over each fixed-length window and a softmax
layer, trained in numpy on a bounded sample of labelled rows. A text is cut into consecutive windows;
all of them are scored and their probabilities averaged by length, so whole texts count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


class ByteNet:
    """widths: of the filters; filters: for each width; window: bytes. Byte 0 pads; A-Z are read as a-z."""

    def __init__(self, labels: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, window: int = 192, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.widths, self.filters, self.window = labels, widths, filters, window
        self.tables = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in widths]
        self.biases = [np.zeros(filters, np.float32) for _ in widths]
        self.out = rng.normal(0, 0.1, (len(widths) * filters, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 700, batch: int = 96, rate: float = 0.02, seed: int = 0) -> None:
        """Adam on windows cut at random from the texts, of random lengths; labels are drawn evenly."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        params = [*self.tables, *self.biases, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            target = rng.integers(0, len(self.labels), batch)
            x = np.zeros((batch, self.window), np.uint8)
            for i, k in enumerate(target):
                t = texts[of[k][rng.integers(len(of[k]))]]
                n = self.window if rng.random() < 0.6 else int(rng.integers(8, self.window + 1))
                at = int(rng.integers(0, max(1, len(t) - n + 1)))
                part = np.frombuffer(t[at : at + n], np.uint8)
                x[i, : len(part)] = part
            pooled, places = [], []
            for table, bias, w in zip(self.tables, self.biases, self.widths, strict=True):
                conv = sum(table[j][x[:, j : self.window - w + 1 + j]] for j in range(w))
                at = conv.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0] + bias)
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            p = softmax(hidden @ self.out + self.out_bias)
            p[np.arange(batch), target] -= 1
            p /= batch
            back = (p @ self.out.T) * (raw > 0)
            grads: list[np.ndarray] = []
            bias_grads = []
            for k, (table, w) in enumerate(zip(self.tables, self.widths, strict=True)):
                own = back[:, k * self.filters : (k + 1) * self.filters]
                g = np.zeros_like(table)
                for j in range(w):
                    np.add.at(g[j], (x[np.arange(batch)[:, None], places[k] + j], np.arange(self.filters)[None, :]), own)
                grads.append(g)
                bias_grads.append(own.sum(axis=0))
            grads += [*bias_grads, hidden.T @ p, p.sum(axis=0)]
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    def compiled(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, tables over pairs of neighbouring bytes (and one over a byte, if it is odd)."""
        out = []
        for table, bias, w in zip(self.tables, self.biases, self.widths, strict=True):
            parts = [(j, (table[j][:, None] + table[j + 1][None]).reshape(1 << 16, self.filters)) for j in range(0, w - 1, 2)]
            if w % 2:
                parts.append((w - 1, table[w - 1].copy()))
            parts[0] = (parts[0][0], parts[0][1] + bias)
            out.append(parts)
        return out

    def windows(self, x: np.ndarray, parts: list[list[tuple[int, np.ndarray]]]) -> np.ndarray:
        """Probabilities of the labels for each row of bytes."""
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for w, tables in zip(self.widths, parts, strict=True):
            n = self.window - w + 1
            conv = None
            for j, table in tables:
                got = table.take((pairs if len(table) > 256 else x)[:, j : j + n], axis=0)
                conv = got if conv is None else np.add(conv, got, out=conv)
            pooled.append(conv.max(axis=1))
        return softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.out_bias)

    def predict(self, texts: list[str | None], parts: list[list[tuple[int, np.ndarray]]]) -> list[tuple[str, float]]:
        raw = [t.encode("utf-8", "replace").lower() if t and LETTER.search(t) else b"" for t in texts]
        counts = np.array([-(-len(b) // self.window) for b in raw])
        flat = np.frombuffer(b"".join(b.ljust(n * self.window, b"\0") for b, n in zip(raw, counts.tolist(), strict=True)), np.uint8).reshape(-1, self.window)
        p = np.concatenate([np.zeros((0, len(self.labels)), np.float32), *(self.windows(flat[i : i + 64], parts) for i in range(0, len(flat), 64))])
        weight = np.full(len(flat), self.window, np.float64)
        last = np.cumsum(counts) - 1
        full = counts > 0
        weight[last[full]] = [len(b) - (n - 1) * self.window for b, n in zip(raw, counts.tolist(), strict=True) if n]
        doc = np.repeat(np.arange(len(raw)), counts)
        sums = np.stack([np.bincount(doc, p[:, k] * weight, len(raw)) for k in range(len(self.labels))], axis=1) if self.labels else np.zeros((len(raw), 0))
        out = []
        for b, s in zip(raw, sums, strict=True):
            if not b or not self.labels:
                out.append((UNKNOWN, 0.0))
            else:
                k = int(s.argmax())
                out.append((self.labels[k], float(min(1.0, s[k] / len(b)))))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if x.shape[1] else x
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = 1200, chars: int = 2000) -> ByteNet:
    """Trains on the rows of the training folds: those whose crc32 of the id as text isn't 1 modulo 3, with a text and a label.

    The sample is bounded: about ``per_label`` rows of each label, chosen by a hash of the id, and
    ``chars`` characters of each, which begin anywhere in the text, by that hash too. Without labelled rows the network has no labels.
    """
    folds = docs.where(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) != 1)
    rows = folds.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    net = ByteNet(sorted(counts))
    if not counts:
        return net
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    draw = F.pmod(F.xxhash64(F.col("i")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    begin = F.pmod(F.xxhash64(F.col("i"), F.lit("begin")), F.greatest(F.length("t") - chars + 1, F.lit(1))).cast("int") + 1
    part = F.substring("t", begin, F.lit(chars)).alias("t")
    got = rows.where(draw < share[F.col("l")]).select(part, "l").collect()
    seen = {r.l for r in got}
    got += [r for k in sorted(set(counts) - seen) for r in rows.where(F.col("l") == k).select(part, "l").limit(per_label).collect()]
    net.fit([r.t.encode("utf-8", "replace").lower() for r in got], np.array([net.labels.index(r.l) for r in got]))
    return net


def identify(docs: DataFrame, net: ByteNet, *, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1, the mean probability of that label over the text's windows).

    ``und`` with score 0 if the text is null or has no letter, or the network no labels. Rows are
    kept as they are, repeated ones too; columns of ``docs`` with these names are replaced. No shuffle.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value.compiled()
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                b = whole.slice(at, 300)
                found = shared.value.predict(b.column(text).to_pylist(), parts)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=arrow.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
