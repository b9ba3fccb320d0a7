"""Language ID: a bidirectional gated recurrent network over UTF-8 bytes.

The cell is a minimal gated unit (one gate ``f``; ``h += f * (c - h)`` with the
candidate ``c`` from the gated state), one per direction, trained in numpy by
backpropagation through time with a label at every position. Prediction labels
every byte of the whole text and pools the positions' probabilities.

Texts are cut into segments of ``SEGMENT`` bytes from their own start, with
``CONTEXT`` bytes on both sides to warm the state up, and many segments run
abreast, so time and memory per task do not depend on a text's length and a
prediction does not depend on the texts beside it.

The network is fitted on the driver from a documented bounded sample: one
window of ``SAMPLE_CHARS`` characters from each of ``SAMPLE_ROWS`` labelled rows,
dealt evenly to the languages (what a rare one does not fill goes to the others),
of each language those that come first in hash order. Every language of the
labelled rows is learned: where they are so many that a share would fall under
``LEAST_PER_LANGUAGE`` rows, the sample is that many rows for each. The lanes that run
abreast are as many as ``LANE_BYTES`` of probabilities hold, so memory does not
grow with the number of languages.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import crc_bucket, table, text_or_empty

SAMPLE_ROWS = 6000
LEAST_PER_LANGUAGE = 20
SAMPLE_CHARS = 400
HIDDEN = 8
STEPS = 500
BATCH = 128
TRAIN_BYTES = 48
SEGMENT = 256
CONTEXT = 16
#: Segments that run abreast: at most so many, and so many bytes of their probabilities.
LANES, LANE_BYTES = 4096, 64 << 20
#: How far below the least score of the labelled rows a text may lie (``keep_known``);
#: the shortest texts of each class, in characters.
LIMIT_SLACK = 0.9
LENGTH_CLASSES = (0, 50, 200)
#: Prediction of a text that is null or has no letter.
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGated:
    """Parameters of both directions; features run along the first axis."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        k, h = len(labels), hidden
        g = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        # per direction: input table (gate rows, then candidate rows), recurrent matrices, output matrix
        self.p = {f"{n}{d}": v for d in (0, 1) for n, v in (
            ("w", g(2 * h, 256, s=0.5)), ("uf", g(h, h, s=0.5 / h ** 0.5)), ("uc", g(h, h, s=1 / h ** 0.5)),
            ("v", g(k, h, s=0.5)))}
        for d in (0, 1):
            self.p[f"w{d}"][:h] -= 1  # a gate that is mostly shut remembers
        self.p["b"] = np.zeros((k, 1), np.float32)

    # ------------------------------------------------------------ training
    def _run(self, x: np.ndarray, d: int):
        h, p = self.hidden, self.p
        state, trace = np.zeros((h, x.shape[1]), np.float32), []
        for t in (range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)):
            a = p[f"w{d}"][:, x[t]]
            f = _sigmoid(a[:h] + p[f"uf{d}"] @ state)
            c = np.tanh(a[h:] + p[f"uc{d}"] @ (f * state))
            trace.append((t, f, c, state))
            state = state + f * (c - state)
        return trace

    def _states(self, trace) -> dict[int, np.ndarray]:
        return {t: s + f * (c - s) for t, f, c, s in trace}

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of x (time, lanes) with labels y
        (lanes), and its gradient by backpropagation through time."""
        p, h, (steps, lanes) = self.p, self.hidden, x.shape
        traces = [self._run(x, d) for d in (0, 1)]
        states = [self._states(t) for t in traces]
        hs = [np.stack([s[t] for t in range(steps)], 1).reshape(h, -1) for s in states]
        z = p["v0"] @ hs[0] + p["v1"] @ hs[1] + p["b"]
        z -= z.max(0)
        q = np.exp(z)
        q /= q.sum(0)
        at = np.tile(y, steps), np.arange(steps * lanes)
        loss = float(-np.log(q[at] + 1e-12).mean())
        q[at] -= 1
        q /= steps * lanes
        grad = {"b": q.sum(1, keepdims=True)}
        for d in (0, 1):
            grad[f"v{d}"] = q @ hs[d].T
            out = (p[f"v{d}"].T @ q).reshape(h, steps, lanes)
            uf, uc = p[f"uf{d}"], p[f"uc{d}"]
            guf, guc, da = np.zeros_like(uf), np.zeros_like(uc), np.zeros((2 * h, steps, lanes), np.float32)
            back = np.zeros((h, lanes), np.float32)
            for t, f, c, s in reversed(traces[d]):
                back = back + out[:, t]
                dac = back * f * (1 - c * c)
                dfs = uc.T @ dac
                daf = (back * (c - s) + dfs * s) * f * (1 - f)
                guc += dac @ (f * s).T
                guf += daf @ s.T
                back = back * (1 - f) + dfs * f + uf.T @ daf
                da[:h, t], da[h:, t] = daf, dac
            flat = x.ravel()
            grad[f"w{d}"] = np.stack([np.bincount(flat, r.ravel(), 256) for r in da]).astype(np.float32)
            grad[f"uf{d}"], grad[f"uc{d}"] = guf, guc
        return loss, grad

    def fit(self, texts: list[bytes], y: list[int], *, steps: int = STEPS, batch: int = BATCH,
            length: int = TRAIN_BYTES, rate: float = 0.02, seed: int = 5) -> BiGated:
        """Adam on random windows of the texts; short texts repeat."""
        rng = np.random.default_rng(seed)
        texts = [t if len(t) >= length else t * (length // len(t) + 1) for t in texts]
        y = np.array(y)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for n in range(1, steps + 1):
            pick = rng.integers(0, len(texts), batch)
            starts = [rng.integers(0, len(texts[i]) - length + 1) for i in pick]
            x = np.stack([np.frombuffer(texts[i], np.uint8, length, s) for i, s in zip(pick, starts, strict=True)], 1)
            _, grad = self.gradient(x, y[pick])
            lr = rate * min(1, n / 20) * max(0.05, 1 - n / steps)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** n)) / (np.sqrt(v2[k] / (1 - 0.99 ** n)) + 1e-8)).astype(np.float32)
        return self

    # ------------------------------------------------------------ prediction
    def _lanes(self, x: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sum of the probabilities over the positions [first, last) of each lane.
        Lanes come longest first: those still running are a prefix at every step."""
        p, h = self.p, self.hidden
        steps, lanes = x.shape
        running = np.searchsorted(-lengths, -np.arange(steps), "left")  # lanes with length > t
        z = np.empty((steps, len(self.labels), lanes), np.float32)
        state = np.zeros((h, lanes), np.float32)
        total = np.zeros((len(self.labels), lanes), np.float64)
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            w, uf, uc, v = (p[f"{n}{d}"] for n in ("w", "uf", "uc", "v"))
            state[:] = 0
            for t in order:
                n = running[t]
                s = state[:, :n]
                a = w.take(x[t, :n], axis=1)
                a[:h] += uf @ s
                f = _sigmoid(a[:h])
                c = a[h:]
                c += uc @ (f * s)
                np.tanh(c, out=c)
                c -= s
                c *= f
                s += c
                if d == 0:
                    np.add(v @ s, p["b"], out=z[t, :, :n])
                else:
                    q = z[t, :, :n]
                    q += v @ s
                    q -= q.max(0)
                    np.exp(q, out=q)
                    q *= ((first[:n] <= t) & (t < last[:n])) / q.sum(0)
                    total[:, :n] += q
        return total

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (texts, labels) over every byte of each text."""
        segs = [(i, max(0, a - CONTEXT), min(len(b), a + SEGMENT + CONTEXT), a, min(len(b), a + SEGMENT))
                for i, b in enumerate(texts) for a in range(0, len(b), SEGMENT)]
        segs.sort(key=lambda s: s[1] - s[2])  # longest first, stable
        total = np.zeros((len(texts), len(self.labels)))
        lanes = max(16, min(LANES, LANE_BYTES // (4 * (SEGMENT + 2 * CONTEXT) * len(self.labels))))
        for at in range(0, len(segs), lanes):
            part = segs[at:at + lanes]
            who, lo, hi, core, end = (np.array(c) for c in zip(*part, strict=True))
            lengths = hi - lo
            x = np.zeros((len(part), lengths[0]), np.uint8)
            for r, (i, a, b, _, _) in enumerate(part):
                x[r, :b - a] = np.frombuffer(texts[i], np.uint8, b - a, a)
            got = self._lanes(np.ascontiguousarray(x.T), lengths, core - lo, end - lo)
            np.add.at(total, who, got.T)
        sizes = np.array([max(1, len(b)) for b in texts])
        return total / sizes[:, None]


def quotas(counts: dict[str, int], n: int) -> dict[str, int]:
    """Rows of each language in a sample of ``n``, as even as ``counts`` lets them be."""
    out, left = {}, n
    small_first = sorted(counts, key=lambda lang: (counts[lang], lang))
    for i, lang in enumerate(small_first):
        out[lang] = min(counts[lang], left // (len(small_first) - i))
        left -= out[lang]
    return out


def _sample(known: DataFrame, n: int) -> DataFrame:
    """The rows of ``known`` (_lang, _h, _text) to learn from, in hash order. Only
    the share of each language that is expected to hold twice its quota is sorted,
    so no task gets the rows of a whole language."""
    counts = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}  # a number a language
    if not counts:
        return known.limit(0)
    take = quotas(counts, max(n, LEAST_PER_LANGUAGE * len(counts)))
    limits = {lang: min((1 << 63) - 1, int((2 * q + 50) / counts[lang] * (1 << 64)) - (1 << 63)) for lang, q in take.items()}

    def of_language(values: dict[str, int]) -> Column:
        pairs = [x for lang, v in values.items() for x in (F.lit(lang), F.lit(v).cast("long"))]
        return F.element_at(F.create_map(*pairs), F.col("_lang"))

    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))
    return (known.where(F.col("_h") <= of_language(limits))
            .withColumn("_place", place).where(F.col("_place") <= of_language(take)).select(*known.columns)
            .orderBy("_h", *known.columns))


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  sample_rows: int = SAMPLE_ROWS) -> BiGated | None:
    """Train on the labelled rows of ``docs`` (see the module's note on the
    sample); None if no row has a label and a text."""
    h = F.xxhash64(F.lit("lang-sample"), F.col(id_col), F.col(text_col))
    at = F.pmod(h, F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(1)).cast("long")).cast("int") + 1
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("_lang"), h.alias("_h"),
        F.substring(F.col(text_col), at, F.lit(SAMPLE_CHARS)).alias("_text"))
    rows = _sample(known, sample_rows).collect()
    rows = [(r["_lang"], r["_text"].encode()) for r in rows if any(map(str.isalpha, r["_text"]))]
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    return BiGated(labels).fit([t for _, t in rows], [labels.index(lang) for lang, _ in rows])


def _parts(texts: list[str], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of about ``size`` characters."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and n < size:
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def _label(model: BiGated | None, texts: list[str]) -> tuple[list[str], list[float]]:
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    mine = [i for i, t in enumerate(texts) if model is not None and any(map(str.isalpha, t))]
    if mine:
        prob = model.predict([texts[i].encode() for i in mine])
        for i, best, p in zip(mine, prob.argmax(1), prob.max(1), strict=True):
            lang[i], score[i] = model.labels[best], min(1.0, float(p))
    return lang, score


def _predict_batches(model: BiGated | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            for at, to in _parts(texts):
                lang, score = _label(model, texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(at, to - at), pa.array(lang), pa.array(score, pa.float64())],
                    ["_id", "lang_pred", "score"])
    return run


def _keep_batches(model: BiGated, text_col: str, limits: list[float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            for at, to in _parts(texts):
                lang, score = _label(model, texts[at:to])
                keep = [w != UNKNOWN and s >= limits[bisect_right(LENGTH_CLASSES, len(t)) - 1]
                        for w, s, t in zip(lang, score, texts[at:to], strict=True)]
                yield b.slice(at, to - at).filter(pa.array(keep))
    return run


def identify_languages(docs: DataFrame, model: BiGated | None, *, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the pooled
    probability of lang_pred over every position).

    Texts that are null or empty or have no letter are ``und`` with score 0, as is
    every text if there is no model. Repeated rows get equal predictions; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = T.StructType([d.schema["_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return d.mapInArrow(_predict_batches(model), schema).withColumnRenamed("_id", "doc_id")


def score_limits(docs: DataFrame, model: BiGated, *, text_col: str = "text", lang_col: str = "lang",
                 slack: float = LIMIT_SLACK) -> list[float]:
    """Least score to keep a text, one for each of ``LENGTH_CLASSES``: ``slack`` times
    the least score of all labelled rows of the class (with a letter). 0 in a class
    without labelled rows."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    place = sum((F.length(text_col) >= c).cast("int") for c in LENGTH_CLASSES[1:])
    scored = identify_languages(known.select(place.alias("_class"), F.col(text_col).alias("_text")), model,
                                id_col="_class", text_col="_text")
    least = {r["_class"]: r["_least"] for r in scored.groupBy(F.col("doc_id").alias("_class")).agg(
        F.min("score").alias("_least")).collect()}  # a number a class
    return [slack * least.get(i, 0.0) for i in range(len(LENGTH_CLASSES))]


def keep_known(docs: DataFrame, model: BiGated, limits: list[float], *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a pooled
    probability of at least the limit of its length (``LENGTH_CLASSES``, in
    characters)."""
    return docs.mapInArrow(_keep_batches(model, text_col, limits), docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's hold-out rule."""
    return crc_bucket(id_col, 4) == 2


def crc_held_out(doc_id) -> bool:
    """The same rule in Python (tests)."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 == 2


# ---------------------------------------------------------------- query
def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    return (identify_languages(docs, model)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


QUERIES = {"op1_lang_id": op1_lang_id}
ORACLE: dict[str, str] = {}
