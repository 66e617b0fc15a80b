"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step of the network is a word. Its input adds a hashed word embedding and the embeddings of its hashed character 3- and
4-grams, edges of the word included, so that unseen words with known parts are understood. All overlapping windows of the
whole text are scored, and the largest logit is the document's. In training, a document marked toxic counts through its
most toxic window (after a first pass that takes all of them), as the mark doesn't tell where.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.llm.langid import held_out, unused
from shinglemill.llm.memory import ship, small_batches, trim, trim_driver, unship, with_scores

HASHED, DIM, HIDDEN = 1 << 15, 12, 8
WINDOW, STRIDE = 64, 48
#: Distinct words whose inputs a task remembers; words of a text that are scored at once, a multiple of the stride.
_WORDS, _PIECE = 100_000, 48_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces_of(text: str | None):
    """The words of a text, in runs that overlap so that their windows are those of the whole."""
    if not text or len(text) < 4 * _PIECE:
        yield words_of(text)
        return
    found, piece = (m.group() for m in _WORD.finditer(text.lower())), []
    while True:
        more = list(islice(found, _PIECE + WINDOW - STRIDE - len(piece)))
        if not more:
            break
        piece += more
        yield piece
        piece = piece[_PIECE:]


def _grams(words: list[bytes]):
    """Hashes of the byte 3- and 4-grams of every word between edge marks, by word, and how many each has."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[word] - np.arange(len(data))  # bytes up to the word's end
    hashes, owners = [], []
    for n in (3, 4):
        ok = np.flatnonzero(left >= n)
        h = np.full(len(ok), n, np.int64)
        for k in range(n):
            h = (h * 1_000_003 + data[ok + k]) & 0xFFFFFFFF
        hashes.append(((h * 2_654_435_761) >> 13) % HASHED)
        owners.append(word[ok])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    return h[np.argsort(o, kind="stable")].astype(np.uint16), np.bincount(o, minlength=len(words))


class Words:
    """Hash rows of distinct words: row of the word table, and runs of rows of the gram table. All in blocks, as a word has
    many grams."""

    block = 4_096

    def __init__(self, words: list[str]):
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        self.rows = np.fromiter((zlib.crc32(w) % HASHED for w in raw), np.int32, len(raw))
        parts = [_grams(raw[i : i + self.block]) for i in range(0, len(raw), self.block)]
        self.grams = np.concatenate([g for g, _ in parts]) if parts else np.empty(0, np.uint16)
        self.counts = np.concatenate([n for _, n in parts]) if parts else np.empty(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.scale = (1 / np.sqrt(np.maximum(self.counts, 1))).astype(np.float32)

    def __len__(self):
        return len(self.rows)

    def of(self, word: int) -> np.ndarray:
        return self.grams[self.starts[word] : self.starts[word] + self.counts[word]]

    def inputs(self, e_word, e_gram, first: int = 0, last: int | None = None):
        """Inputs of the words ``first`` to ``last``."""
        last = len(self) if last is None else last
        x = e_word[self.rows[first:last]]
        for at in range(first, last, self.block):
            some = np.arange(at, min(at + self.block, last))
            some = some[self.counts[some] > 0]
            if len(some):
                begin, end = self.starts[some[0]], self.starts[some[-1]] + self.counts[some[-1]]
                x[some - first] += np.add.reduceat(e_gram[self.grams[begin:end]], self.starts[some] - begin, 0) * self.scale[some, None]
        return x


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class AttentiveGru:
    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        f = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        self.w = {"word": np.zeros((HASHED, DIM), np.float32), "gram": np.zeros((HASHED, DIM), np.float32), "wx": f(2, DIM, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "u": f(2, HIDDEN, 3 * HIDDEN), "v": f(2 * HIDDEN), "out": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.scale = (1.0, 0.0)

    def project(self, words: Words) -> np.ndarray:
        """Inputs of the gates of both directions, a row of 6 * HIDDEN for each word."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for at in range(0, len(words), 16_384):
            x = words.inputs(self.w["word"], self.w["gram"], at, min(at + 16_384, len(words)))
            for d in (0, 1):
                out[at : at + len(x), d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN] = x @ self.w["wx"][d] + self.w["b"][d]
        return out

    def _run(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, trace: list | None = None):
        """gates: rows by word; ids, mask: window by step. Hidden states of both directions by step."""
        n, steps = ids.shape
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        u = self.w["u"]
        for t in range(steps):
            back = steps - 1 - t
            x = np.stack([gates[ids[:, t], : 3 * HIDDEN], gates[ids[:, back], 3 * HIDDEN :]])
            m = np.stack([mask[:, t], mask[:, back]])[..., None]
            a = np.matmul(h, u)
            zr = _sigmoid(x[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN :] + r * a[..., 2 * HIDDEN :])
            new = h + m * (1 - z) * (c - h)
            if trace is not None:
                trace.append((h, a, z, r, c, m))
            h = new
            states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
        return states

    def _pool(self, states, mask):
        s = states @ self.w["v"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = (a[..., None] * states).sum(0)
        return a, pooled, pooled @ self.w["out"] + self.w["c"][0]

    def logits(self, gates, windows: Windows, block: int = 512) -> np.ndarray:
        out = np.empty(len(windows), np.float32)
        for at in range(0, len(windows), block):
            ids, mask = windows.rows(np.arange(at, min(at + block, len(windows))))
            out[at : at + block] = self._pool(self._run(gates, ids, mask), mask)[2]
        return out

    def step(self, words: Words, ids, mask, y, weight, moments: dict, count: int, rate: float) -> None:
        """One step of Adam on the weighted log loss of some windows."""
        w, trace, g = self.w, [], {}
        x = words.inputs(w["word"], w["gram"])
        gates = np.concatenate([x @ w["wx"][d] + w["b"][d] for d in (0, 1)], 1)
        states = self._run(gates, ids, mask, trace)
        a, pooled, logit = self._pool(states, mask)
        d = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dp = d[:, None] * w["out"]
        da = (states * dp).sum(2)
        ds = a * (da - (a * da).sum(0))
        dstates = a[..., None] * dp + ds[..., None] * w["v"]
        g["v"] = np.tensordot(ds, states, ((0, 1), (0, 1)))
        steps = len(trace)
        dx = np.zeros_like(gates)
        du, dh = np.zeros_like(w["u"]), np.zeros((2, len(ids), HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, act, z, r, c, m = trace[t]
            back = steps - 1 - t
            dh = dh + np.stack([dstates[t, :, :HIDDEN], dstates[back, :, HIDDEN:]])
            dn = dh * m
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * act[..., 2 * HIDDEN :] * r * (1 - r)
            dact = np.concatenate([dz, dr, dc * r], 2)
            dgate = np.concatenate([dz, dr, dc], 2)
            np.add.at(dx[:, : 3 * HIDDEN], ids[:, t], dgate[0])
            np.add.at(dx[:, 3 * HIDDEN :], ids[:, back], dgate[1])
            du += np.matmul(h.transpose(0, 2, 1), dact)
            dh = dh - dn * (1 - z) + np.matmul(dact, w["u"].transpose(0, 2, 1))
        g["u"] = du
        halves = dx[:, : 3 * HIDDEN], dx[:, 3 * HIDDEN :]
        g["wx"] = np.stack([x.T @ h for h in halves])
        g["b"] = np.stack([h.sum(0) for h in halves])
        dword = sum(h @ w["wx"][k].T for k, h in enumerate(halves))
        g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
        np.add.at(g["word"], words.rows, dword)
        if len(words.grams):
            np.add.at(g["gram"], words.grams, np.repeat(dword * words.scale[:, None], words.counts, axis=0))
        for k in ("word", "gram"):
            # One scale for the whole table: an entry moves by what it has seen, not by how rarely it is seen; it fades unless renewed.
            grad, m2 = g.pop(k) * self.learned[k][:, None], moments[k][1]
            some = np.abs(grad).max(1) > 0
            m2 += 0.01 * (np.square(grad[some]).mean() - m2) if some.any() else 0
            w[k] *= 1 - 0.002
            w[k] -= 2 * rate * grad / (np.sqrt(m2[0, 0] / (1 - 0.99**count)) + 1e-8)
        for k, grad in g.items():
            m1, m2 = moments[k]
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            w[k] -= rate * (m1 / (1 - 0.9**count)) / (np.sqrt(m2 / (1 - 0.999**count)) + 1e-8)

    def fit(self, coded: list[np.ndarray], names: list[str], marks: np.ndarray, epochs: int = 7, batch: int = 128, rate: float = 0.01, seed: int = 6) -> None:
        """coded: each text's words by their place in ``names``. Words and grams in very few of the texts keep the embedding 0, so that chance words aren't learned by heart. After the
        first pass the clean windows are the ones that score highest and as many others."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        every = Words(names)
        self._choose_learned(every, coded)
        windows = Windows(coded)
        doc = windows.doc
        y = marks[doc].astype(np.float32)
        count = 0
        for epoch in range(epochs):
            bad, clean = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
            if epoch:
                scores = self.logits(self.project(every), windows)
                top = np.full(len(coded), -np.inf)
                np.maximum.at(top, doc, scores)
                bad = bad[scores[bad] >= top[doc[bad]]]
                hard = clean[np.argsort(-scores[clean], kind="stable")[: 2 * len(bad)]]
                clean = np.unique(np.concatenate([hard, rng.choice(clean, min(len(clean), 2 * len(bad)), replace=False)]))
            used = np.concatenate([bad, clean])
            share = max(y[used].mean(), 1e-3)
            weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3)).astype(np.float32)
            for rows in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
                ids, mask = windows.rows(rows)
                some, local = np.unique(ids, return_inverse=True)
                count += 1
                self.step(Words([names[i] for i in some]), local.reshape(len(rows), -1), mask, y[rows], weight[rows], moments, count, rate)
        scores = self.logits(self.project(every), windows)
        top = np.full(len(coded), -20.0)
        np.maximum.at(top, doc, np.clip(scores, -20, 20))
        self.scale = _logistic(top, marks)

    def _choose_learned(self, every: Words, coded: list[np.ndarray]) -> None:
        """Rows of the tables that occur in enough texts."""
        least = max(3, len(coded) // 300)
        seen = {"word": np.zeros(HASHED, np.int64), "gram": np.zeros(HASHED, np.int64)}
        for words in coded:
            words = np.unique(words)
            seen["word"][np.unique(every.rows[words])] += 1
            runs = [every.of(i) for i in words]
            if runs:
                seen["gram"][np.unique(np.concatenate(runs))] += 1
        self.learned = {k: (n >= least).astype(np.float32) for k, n in seen.items()}

    def probability(self, top: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * np.clip(top, -20, 20) + self.scale[1])


def _logistic(x, y, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve with both classes of equal weight, by Newton steps with some ridge."""
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    X, b = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(X @ b)
        h = (X * (w * p * (1 - p))[:, None]).T @ X + 0.5 * np.eye(2)
        b = b - np.linalg.solve(h, X.T @ (w * (p - y)) + 0.5 * (b - np.array([1.0, 0.0])))
    return float(max(b[0], 1e-3)), float(b[1])


class Windows:
    """Overlapping windows over every document with words: ``doc`` has each window's document, ``rows`` cuts some of them out."""

    def __init__(self, coded: list[np.ndarray]):
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        count = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(len(coded)), count)
        self.flat = np.concatenate(coded).astype(np.int32, copy=False) if len(coded) else np.empty(0, np.int32)
        end = np.cumsum(size)
        self.first = (end - size)[self.doc] + (np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        self.end = end[self.doc]

    def __len__(self):
        return len(self.doc)

    def rows(self, which: np.ndarray):
        """Ids, and the mask of real steps."""
        at = self.first[which, None] + np.arange(WINDOW)
        mask = at < self.end[which, None]
        ids = self.flat[np.where(mask, at, 0)] if len(self.flat) else np.zeros(at.shape, np.int32)
        return np.where(mask, ids, 0), mask.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", per_class: int = 900, clean_per_toxic: int = 3, most_chars: int = 4_000, toxic_chars: int = 100_000, seed: int = 8) -> AttentiveGru | None:
    """A network from at most ``per_class`` toxic documents and ``clean_per_toxic`` times as many clean ones, chosen by hash among
    those with text. A toxic one gives up to ``toxic_chars`` characters, as the mark doesn't tell where, a clean one up to
    ``most_chars``; longer texts give a slice of that length, from a place by hash. labels: id, ``toxic``; null marks are ignored. None where a class has no
    document."""
    trim_driver(docs.sparkSession)
    rows = docs.select(id_col, F.col(text).alias("text")).filter(F.length("text") > 0)
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    marked = marked.join(rows.select(id_col), id_col, "left_semi")
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if sizes.keys() != {0, 1}:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, min(1.0, 1.3 * per_class / sizes[1])).otherwise(min(1.0, 1.3 * clean_per_toxic * per_class / sizes[0]))
    picked = marked.withColumn("draw", draw).filter(F.col("draw") < share)
    chars = F.when(F.col("toxic") == 1, toxic_chars).otherwise(most_chars)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    part = F.substring("text", place, chars).alias("text")
    bound = 2 * (1 + clean_per_toxic) * per_class  # rows of the picked side: ids and marks only
    sample = rows.join(F.broadcast(picked.orderBy("draw").limit(bound)), id_col).select("toxic", "draw", part).distinct().limit(bound).collect()
    sample = sorted((r["draw"], r["toxic"], r["text"]) for r in sample)
    coded, marks, vocabulary = [], [], {}
    for mark in (0, 1):
        chosen = [t for _, m, t in sample if m == mark][: per_class if mark else clean_per_toxic * per_class]
        if not chosen:
            return None
        for t in chosen:
            coded.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32))
        marks += [mark] * len(chosen)
    del sample, chosen
    model = AttentiveGru()
    model.fit(coded, list(vocabulary), np.array(marks))
    del coded, vocabulary
    trim()
    return model


class Scorer:
    """Scores texts with the inputs of distinct words remembered."""

    def __init__(self, model: AttentiveGru):
        self.model, self.known, self.gates = model, {}, np.empty((_WORDS, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            upto, size, split = at, 0, []
            while upto < len(texts) and size < 100_000:
                if len(texts[upto] or "") > 4 * _PIECE:
                    if upto == at:
                        out[at] = max((self._score([p])[0] for p in pieces_of(texts[at])), default=0.0)
                        upto = at + 1
                    break
                split.append(words_of(texts[upto]))
                size += len(split[-1])
                upto += 1
            if split:
                out[at:upto] = self._score(split)
            at = upto
        return out

    def _score(self, split: list[list[str]]) -> np.ndarray:
        words = dict.fromkeys(chain.from_iterable(split))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > len(self.gates):
            self.known, new = {}, list(words)
            if len(new) > len(self.gates):
                self.gates = np.empty((len(new), 6 * HIDDEN), np.float32)
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        for at in range(0, len(new), 8_192):
            part = new[at : at + 8_192]
            self.gates[first + at : first + at + len(part)] = self.model.project(Words(part))
        coded = [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in split]
        windows = Windows(coded)
        top = np.full(len(split), -np.inf)
        np.maximum.at(top, windows.doc, self.model.logits(self.gates, windows))
        return np.where(np.isfinite(top), self.model.probability(top), 0.0)


def score_toxicity(docs: DataFrame, model: AttentiveGru | None, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``keep`` columns (all by default) of ``docs`` with ``toxicity`` (0 to 1) and ``toxic_pred`` (1 from ``threshold`` on, else 0).

    A null text, and one without words, scores 0, as does every text where the model is None. Very long texts are scored in
    runs of windows; of windows that tie the value is the same. Every repeated row is scored, also with a null id. Columns
    named like the new ones are replaced. An empty table gives no rows.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("toxicity", "toxic_pred")]
    body = unused("_text", docs.columns)
    base = docs.select(*keep, F.col(text).alias(body))
    if model is None:
        return base.select(*keep, F.lit(0.0).alias("toxicity"), F.lit(0).alias("toxic_pred"))
    small_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, model)

    def scorer():
        score = Scorer(unship(shared))
        return lambda batch: (pa.array(score(batch.column(batch.num_columns - 1).to_pylist())),)

    scored = with_scores(base, keep, "toxicity double", scorer)
    return scored.withColumn("toxic_pred", (F.col("toxicity") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 3, 1))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id", 3, 1))
    model = train(docs.filter(~F.col("held_out")), labels)
    return score_toxicity(docs, model, keep=["doc_id", "held_out"]).withColumnsRenamed({"toxicity": "score", "toxic_pred": "predicted"})


QUERIES = {"op6_toxicity": op6_toxicity}
