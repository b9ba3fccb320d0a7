"""Quality classifier by Bradley-Terry pairwise ranking.

A text's worth is linear in its features. The weights are learned from
preference pairs, a row marked 1 preferred to a row marked 0, by the logistic
loss on the pair's feature differences. Features are shares and sizes of the
whole text; each is cut into bins at the quantiles of the training rows, with
pairs of bins for the features that depend on the length.

The cut between good and bad is a quantile of the training rows' scores: the one
with the fewest wrong labels. The published score is the logistic function of
the distance from the cut, shifted so that the cut lies at ``CUT``.

Labelled rows are counted in features, not texts: the driver fits on the
``TRAIN_ROWS`` that come first in hash order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import crc_bucket, first_by_hash, table, text_or_empty

TRAIN_ROWS = 30_000
PAIRS = 4_000_000
BINS = 12
#: Fixed value of the contract: predictions are 1 from this score on.
CUT = 0.3

FEATURES = ("words", "distinct", "lines", "distinct_lines", "word_len", "line_len", "upper", "digit", "mark",
            "odd_mark", "other", "stop", "caps", "short", "repeat", "odd_words")
#: Features that mean something only beside the length.
_WITH_WORDS = ("distinct", "distinct_lines", "lines", "stop", "repeat", "caps", "odd_words")

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[ord("A"):ord("Z") + 1] = True
_LOWER[ord("a"):ord("z") + 1] = True
_DIGIT[ord("0"):ord("9") + 1] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = True
_HIGH = np.arange(256) >= 128
_ODD_WORD = re.compile(rb"[#$%&*+/<=>@\\^_`{|}~\[\]!]+(?=[\s.,;:?'\")]|$)")
_ODD = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP | _HIGH)


def features(text: str) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    raw = text.encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, int(hist[~_SPACE].sum()))
    words = raw.split()
    k = max(1, len(words))
    lines = raw.split(b"\n")
    lens = [len(w) for w in words]
    share = lambda mask: float(hist[mask].sum()) / n
    return [
        float(np.log1p(len(words))), len(set(words)) / k, len(lines) / k, len(set(lines)) / len(lines),
        sum(lens) / k, float(np.log1p(len(raw) / len(lines))), share(_UPPER), share(_DIGIT), share(_STOP), share(_ODD),
        share(_HIGH), sum(w[-1:] in b".,;:?!" for w in words) / k, sum(w[:1].isupper() for w in words) / k,
        sum(c <= 2 for c in lens) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        len(_ODD_WORD.findall(raw)) / k]


class PairwiseRank:
    """Bin edges, weights and the cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, pairs: int = PAIRS, seed: int = 3):
        """Fit on feature rows ``x`` with labels ``y`` (both labels present)."""
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, grid)) for c in x.T]
        codes = self._codes(x)
        size = self.size
        w = np.zeros(size)
        rng = np.random.default_rng(seed)
        good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        square = np.full(size, 1e-8)
        batch, passes = 2000, max(1, pairs // 2000)
        for n in range(passes):  # AdaGrad on the mean loss log(1 + exp(-(s_good - s_bad)))
            i, j = codes[rng.choice(good, batch)], codes[rng.choice(bad, batch)]
            miss = 1 / (1 + np.exp(w[i].sum(1) - w[j].sum(1)))
            g = (np.bincount(j.ravel(), np.repeat(miss, j.shape[1]), size)
                 - np.bincount(i.ravel(), np.repeat(miss, i.shape[1]), size)) / batch + 1e-5 * w
            square += g * g
            w -= 0.3 * (1 - n / passes) * g / np.sqrt(square)
        self.w = w
        s = w[codes].sum(1)
        q = np.linspace(0, 1, 401)
        cuts = np.quantile(s, q)
        wrong = [((s >= c) != (y == 1)).sum() for c in cuts]
        best = np.nonzero(wrong == np.min(wrong))[0]
        at = best[len(best) // 2]  # the middle of the best quantiles
        self.quantile = float(q[at])
        below, above = s[s < cuts[at]], s[s >= cuts[at]]
        self.cut = float((below.max() + above.min()) / 2) if len(below) and len(above) else float(cuts[at])

    @property
    def size(self) -> int:
        b = [len(e) + 1 for e in self.edges]
        return sum(b) + sum(b[0] * b[FEATURES.index(f)] for f in _WITH_WORDS)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """Active binary features of each row, as indexes into the weights."""
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        out, base = [], 0
        for e, b in zip(self.edges, bins, strict=True):
            out.append(base + b)
            base += len(e) + 1
        for f in _WITH_WORDS:
            k = FEATURES.index(f)
            out.append(base + bins[0] * (len(self.edges[k]) + 1) + bins[k])
            base += (len(self.edges[0]) + 1) * (len(self.edges[k]) + 1)
        return np.stack(out, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; ``CUT`` and more is on the good side."""
        far = np.clip(self.w[self._codes(x)].sum(1) - self.cut, -30, 30)
        return 1 / (1 + np.exp(-(far + np.log(CUT / (1 - CUT)))))


_FEATURE_ARRAY = T.ArrayType(T.DoubleType())


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = pa.array([features(t) for t in b.column("_text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("_label"), f], ["_label", "_x"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", rows: int = TRAIN_ROWS) -> PairwiseRank | None:
    """Train on the rows of ``docs`` with a label in ``labels`` (rows with a null
    id or label teach nothing); None unless both labels occur. Where ids repeat, a
    label can stand for several rows: at most twice ``rows`` of them are learned, the
    first in hash order of their features."""
    lab = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"),
                   F.xxhash64(F.lit("quality-sample"), F.col(id_col)).alias("_h")))
    lab = first_by_hash(lab, F.col("_h"), rows)  # documented bound: three numbers a row
    d = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    # the labels are at most ``rows`` rows of a few integers
    known = (d.join(F.broadcast(lab), "_id").select("_label", "_text")
             .mapInArrow(_feature_batches, T.StructType([T.StructField("_label", T.IntegerType()),
                                                         T.StructField("_x", _FEATURE_ARRAY)])))
    got = known.orderBy(F.xxhash64("_x"), "_x", "_label").limit(2 * rows).collect()
    y = np.array([r["_label"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return PairwiseRank(np.array([r["_x"] for r in got]), y)


def _score_batches(model: PairwiseRank | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                if model is None:
                    s = np.full(part.num_rows, CUT)
                else:
                    s = model.score(np.array([features(t) for t in part.column("_text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(s)], ["_id", "score"])
    return run


def score_quality(docs: DataFrame, model: PairwiseRank | None, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 from ``CUT`` on).

    Null text counts as empty; an empty text gets the score of its features like
    any other. Without a model every score is ``CUT``. Repeated rows get equal
    scores; an empty table gives an empty result; other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = T.StructType([d.schema["_id"], T.StructField("score", T.DoubleType())])
    return (d.mapInArrow(_score_batches(model), schema)
            .select(F.col("_id").alias("doc_id"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")))


# ---------------------------------------------------------------- query
def op8_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = crc_bucket("doc_id", 5) == 0
    model = fit_quality(docs.where(~out), labels.where(~out))
    return score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality_rank": op8_quality_rank}
ORACLE: dict[str, str] = {}
