"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into windows of ``window`` bytes. Filters of several widths run over one-hot byte classes, the largest response of
each filter over the window goes through a rectifier, and a softmax layer gives the languages. As the input is one-hot, a
filter is a table: response = sum over its offsets of table[offset][class]. For scoring, the tables of two neighbouring
offsets are added up beforehand into one table of class pairs, which halves the lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.llm.memory import ship, small_batches, small_table, trim, unship, with_scores

WIDTHS, FILTERS, WINDOW, CLASSES = (2, 3, 4), 12, 256, 64


def byte_classes() -> np.ndarray:
    """64 classes: padding, letters without case, white space, digits, a few signs, and 32 for the bytes above ASCII."""
    out = np.full(256, 31, np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = 1 + i
    out[[9, 10, 11, 12, 13, 32]] = 27
    out[48:58] = 28
    out[39], out[45] = 29, 30
    out[128:] = 32 + (np.arange(128, 256) & 31)
    return out


class ByteConvNet:
    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def _weights(self) -> list:
        return [*self.filters, self.bias, self.out, self.shift]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 4) -> None:
        """x: windows of byte classes; y: languages. Adam; the pooled maximum passes its gradient to the place it came from."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self._weights()]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb = x[rows], y[rows]
                pooled, places = [], []
                for w, table in zip(WIDTHS, self.filters):
                    n = xb.shape[1] - w + 1
                    r = sum(table[k].take(xb[:, k : k + n], axis=0) for k in range(w))
                    at = r.argmax(1)
                    places.append(at)
                    pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
                raw = np.concatenate(pooled, 1) + self.bias
                h = np.maximum(raw, 0)
                p = _softmax(h @ self.out + self.shift)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.out.T) * (raw > 0)
                grads = []
                for i, (w, at) in enumerate(zip(WIDTHS, places)):
                    d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    g = np.zeros((w, CLASSES, FILTERS), np.float32)
                    for k in range(w):
                        cls = np.take_along_axis(xb, at + k, 1).astype(np.int64)
                        g[k] = np.bincount((cls * FILTERS + np.arange(FILTERS)).ravel(), d.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS)
                    grads.append(g)
                grads += [dh.sum(0), h.T @ p, p.sum(0)]
                step += 1
                for weight, grad, (m, v) in zip(self._weights(), grads, moments):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def freeze(self) -> ByteConvNet:
        """Adds up the tables of neighbouring offsets."""
        self.pairs = []
        for table in self.filters:
            parts = []
            for k in range(0, len(table) - 1, 2):
                parts.append((k, np.ascontiguousarray((table[k][:, None] + table[k + 1][None]).reshape(-1, FILTERS))))
            self.pairs.append((parts, table[-1] if len(table) % 2 else None))
        return self

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), block):
            xb = x[at : at + block]
            pair = xb[:, :-1].astype(np.intp) * CLASSES + xb[:, 1:]
            pooled = []
            for w, (parts, last) in zip(WIDTHS, self.pairs):
                n = xb.shape[1] - w + 1
                r = parts[0][1].take(pair[:, :n], axis=0, mode="clip")
                for k, table in parts[1:]:
                    r += table.take(pair[:, k : k + n], axis=0, mode="clip")
                if last is not None:
                    r += last.take(xb[:, w - 1 : w - 1 + n], axis=0, mode="clip")
                pooled.append(r.max(1))
            out[at : at + block] = _softmax(np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.shift)
        return out


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(starts: np.ndarray, ends: np.ndarray):
    """Fixed-length windows of byte classes that cover every ``data[start:end]``, each's document, and its length in bytes."""
    count = np.maximum(1, -(-(ends - starts) // WINDOW))
    doc = np.repeat(np.arange(len(starts)), count)
    first = starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    return doc, first, np.minimum(first + WINDOW, ends[doc]) - first


def _cut(data, first, length, classes):
    at = first[:, None] + np.arange(WINDOW)
    x = classes[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else np.zeros((len(first), WINDOW), np.uint8)
    x[np.arange(WINDOW) >= length[:, None]] = 0
    return x


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 600, most_rows: int = 120_000, slice_chars: int = 1_024, seed: int = 1) -> ByteConvNet | None:
    """A network from at most about ``per_language`` rows of each language with a text and label, one slice of at most
    ``slice_chars`` characters from each; rows and slices are chosen by hash. Every label is learned: with more than ``most_rows /
    per_language`` languages each gives fewer rows. None where no row is labelled."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    per_language = max(1, min(per_language, most_rows // len(languages)))
    shares = small_table(docs.sparkSession, [(r["lang"], min(1.0, per_language / r["count"])) for r in sizes], "lang string, share double")
    rows = rows.join(F.broadcast(shares), "lang")
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40))
    spare = F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("text", F.lit(seed + 1)), spare) + 1).cast("int")
    picked = rows.filter(draw / float(1 << 40) < F.col("share")).select("lang", draw.alias("draw"), F.substring(F.col("text"), start, F.lit(slice_chars)).alias("slice"))
    sample = sorted(tuple(r) for r in picked.distinct().limit(4 * per_language * len(languages)).collect())
    rng, classes, number = np.random.default_rng(seed), byte_classes(), {name: i for i, name in enumerate(languages)}
    x, y = [], []
    for language, _, part in sample:
        raw = np.frombuffer(part.encode(), np.uint8)
        starts = list(range(0, len(raw), WINDOW))
        spans = [(s, min(s + WINDOW, len(raw))) for s in starts]
        s = int(rng.integers(0, len(raw)))
        spans += [(s, min(len(raw), s + int(rng.integers(12, 80))))]  # short texts occur as well
        for a, b in spans:
            row = np.zeros(WINDOW, np.uint8)
            row[: b - a] = classes[raw[a:b]]
            x.append(row)
            y.append(number[language])
    model = ByteConvNet(languages)
    model.fit(np.array(x), np.array(y))
    trim()
    return model.freeze()


def identify(docs: DataFrame, model: ByteConvNet | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) of ``docs`` with ``lang_pred`` and ``lang_score``.

    Every window of the whole text is scored; probabilities are averaged by bytes, and the largest is the score. A text that is
    null or has no letter is ``und`` with score 0, as is every text where the model is None. Very long texts are scored in
    blocks of windows. Of languages with equal probability the first by code point is taken. Every repeated row is scored,
    also with a null id. Columns of ``docs`` named like the new ones are replaced. An empty table gives no rows.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("lang_pred", "lang_score")]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    base = docs.select(*keep, F.col(text).alias(unused("_text", docs.columns)), letters.alias(unused("_letters", docs.columns)))
    if model is None:
        return base.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    small_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, model)
    classes = byte_classes()

    def score_all(net, texts):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        doc, first, length = windows_of(ends - np.array([len(r) for r in raw]), ends)
        total = np.zeros((len(raw), len(net.languages)))
        for at in range(0, len(doc), 1024):
            p = net.probabilities(_cut(data, first[at : at + 1024], length[at : at + 1024], classes))
            weight = np.maximum(length[at : at + 1024], 1)[:, None]
            np.add.at(total, doc[at : at + 1024], p * weight)
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        return best, np.minimum(total.max(1), 1.0)

    def scorer():
        net = unship(shared)
        names = np.array([*net.languages, "und"], object)

        def score(batch):
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            best, top = score_all(net, batch.column(batch.num_columns - 2).to_pylist())
            return pa.array(names[np.where(lettered, best, len(names) - 1)], pa.string()), pa.array(np.where(lettered, top, 0.0))

        return score

    return with_scores(base, keep, "lang_pred string, lang_score double", scorer)


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer where ``columns`` have it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``; a null id never is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs, model, keep=["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


QUERIES = {"op4_language_id": op4_language_id}
