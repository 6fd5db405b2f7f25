"""Line-level quality by a linear-chain conditional random field.

Every line is a node labelled good or bad. A node's features are character and word statistics
of its line and of the lines before and after it; an edge's weights are those of the four label
pairs. Forward-backward gives each line's probability of being good, and a document's quality is
their mean weighted by line length, calibrated on the training documents.

The model is fitted on a bounded sample: in the order of a hash of the id at most SAMPLE documents per label, of
longer ones the first SAMPLE_LINES lines, until FIT_LINES lines are reached (half of them for each label). Labels are those of documents, so fitting takes
two rounds: in the first every line carries its document's label; lines of which the first model
is sure that they are of the other kind then change sides, and the second round learns from
documents with lines of both kinds, which is what the label pairs of neighbours are learnt from.
Only feature numbers of the sample reach the driver. Scoring is a map over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

SAMPLE = 2500
SAMPLE_LINES = 400
FIT_LINES = 200_000
STEPS = (120, 150)
RIDGE = 1e-3
#: Log-odds from which a line of the first round's other kind changes sides (probability 0.95).
SURE = 2.94
#: Statistics of one line.
NAMES = ("log_bytes", "upper", "symbol", "shout", "pipe", "digit", "stop", "other_punct", "non_ascii", "word_bytes", "title", "repeat_words", "repeat_line")
N = len(NAMES)

_CLASS = np.zeros((256, 8), dtype=np.float32)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>@^~=+", b"!?", b"|", b"0123456789", b".", b",;:'\"()-_/\\[]{}", bytes(range(0x80, 0x100)))):
    for _b in _chars:
        _CLASS[_b, _k] = 1


def line_features(text: str) -> np.ndarray:
    """(lines with something in them or one empty line) x N."""
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    out = np.zeros((len(lines), N), dtype=np.float32)
    size = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if len(data):
        kinds = _CLASS_OF[data]
        counts = np.bincount(np.repeat(np.arange(len(lines)), size) * 9 + kinds, minlength=9 * len(lines)).reshape(-1, 9)
        out[:, 1:9] = counts[:, :8] / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    seen_lines: set[str] = set()
    seen: set[tuple] = set()
    for i, line in enumerate(lines):
        w = line.split()
        if not w:
            continue
        out[i, 9] = size[i] / len(w)
        out[i, 10] = sum(map(str.istitle, w)) / len(w)
        tri = list(zip(w, w[1:], w[2:], strict=False))
        if tri:
            before = len(seen)
            seen.update(tri)
            out[i, 11] = 1 - (len(seen) - before) / len(tri)
        out[i, 12] = line in seen_lines
        seen_lines.add(line)
    return out


#: The class of each byte; 8: none.
_CLASS_OF = np.where(_CLASS.any(axis=1), _CLASS.argmax(axis=1), 8)


class Nodes:
    """Features of every node, of the nodes before and after it in its document, and marks of a document's ends.

    The matrix of them all, three times as wide as ``x``, is never made: its products are sums of products of ``x``.
    """

    def __init__(self, x: np.ndarray, first: np.ndarray) -> None:
        self.x, self.first = x.astype(np.float64), first
        self.last = np.concatenate((first[1:], [True]))

    @property
    def width(self) -> int:
        return 1 + 3 * self.x.shape[1] + 2

    def times(self, theta: np.ndarray) -> np.ndarray:
        n = self.x.shape[1]
        own, before, after = (self.x @ theta[1 + n * i : 1 + n * (i + 1)] for i in range(3))
        out = theta[0] + own + theta[-2] * self.first + theta[-1] * self.last
        out[1:] += before[:-1] * ~self.first[1:]
        out[:-1] += after[1:] * ~self.last[:-1]
        return out

    def transposed_times(self, d: np.ndarray) -> np.ndarray:
        before = self.x[:-1].T @ (d[1:] * ~self.first[1:])
        after = self.x[1:].T @ (d[:-1] * ~self.last[:-1])
        return np.concatenate(([d.sum()], self.x.T @ d, before, after, [d @ self.first, d @ self.last]))


@dataclass(frozen=True)
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    pair: np.ndarray  # 2 x 2 log potentials, from and to (0 bad, 1 good)
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.scale, -6, 6)
        return Nodes(scaled, first).times(self.unary)

    def marginals(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(good) of each node of documents of ``sizes`` lines."""
        return chain(self.log_odds(x, starts(sizes)), sizes, self.pair)[0]

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Quality of each document, between 0 and 1."""
        return 1 / (1 + np.exp(-(self.slope * self.evidence(x, sizes) + self.offset)))

    def evidence(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logit of the length-weighted mean marginal."""
        p = self.marginals(x, sizes)
        weight = np.expm1(x[:, 0].astype(np.float64)) + 1
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        mean = np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))


def starts(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), dtype=bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    return first


def chain(u: np.ndarray, sizes: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over documents side by side: P(good) of each node, summed pair marginals (2 x 2).

    Documents are taken from the longest on, so that step t works on those with more than t lines.
    """
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    trans = np.exp(pair - pair.max())
    node = np.stack((1 / (1 + np.exp(u)), 1 / (1 + np.exp(-u))), axis=1)
    alpha = np.empty_like(node)
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]  # documents with size > t
    for t, m in enumerate(live):
        k = at[:m] + t
        a = node[k] if t == 0 else (alpha[k - 1] @ trans) * node[k]
        alpha[k] = a / a.sum(axis=1, keepdims=True)
    post = alpha.copy()
    beta = np.ones((len(size), 2))
    pairs = np.zeros((2, 2))
    for t in range(len(live) - 1, 0, -1):
        m = live[t]
        k = at[:m] + t
        message = node[k] * beta[:m]
        both = alpha[k - 1][:, :, None] * trans * message[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = message @ trans.T
        beta[:m] = b / b.sum(axis=1, keepdims=True)
        g = alpha[k - 1] * beta[:m]
        post[k - 1] = g / g.sum(axis=1, keepdims=True)
    return post[:, 1], pairs


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, prior: float) -> Crf:
    """Two rounds of maximum conditional likelihood on line labels; then calibration on document labels."""
    first = starts(sizes)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = Nodes(np.clip((x - mean) / scale, -6, 6), first)
    truth = np.repeat(y, sizes).astype(np.float64)
    theta, pair = climb(z, sizes, truth, STEPS[0], np.zeros(z.width), np.zeros((2, 2)))
    odds = z.times(theta)
    truth = np.where(odds > SURE, 1.0, np.where(odds < -SURE, 0.0, truth))
    theta, pair = climb(z, sizes, truth, STEPS[1], theta, np.zeros((2, 2)))
    model = Crf(mean, scale, theta, pair)
    slope, offset = calibrate(model.evidence(x, sizes), y, prior)
    return Crf(mean, scale, theta, pair, slope, offset)


def climb(z: Nodes, sizes: np.ndarray, truth: np.ndarray, steps: int, theta: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the log-likelihood of the line labels ``truth``, from the weights given."""
    inside = np.flatnonzero(~starts(sizes))
    seen = np.bincount((truth[inside - 1] * 2 + truth[inside]).astype(int), minlength=4).reshape(2, 2).astype(float)
    m = [np.zeros_like(theta), np.zeros_like(pair)]
    v = [np.zeros_like(theta), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        p, pairs = chain(z.times(theta), sizes, pair)
        grads = [z.transposed_times(truth - p) / len(truth) - RIDGE * theta, (seen - pairs) / len(truth) - RIDGE * pair]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            delta = 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            if i == 0:
                theta = theta + delta
            else:
                pair = np.clip(pair + delta, -3, 3)
    return theta, pair


def calibrate(evidence: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression of the label on the evidence, labels weighted to the share ``prior`` of good ones."""
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-(slope * evidence + offset)))
        g = np.array([(weight * (y - p) * evidence).sum() - 1e-2 * (slope - 1), (weight * (y - p)).sum() - 1e-2 * offset])
        h = weight * p * (1 - p)
        hess = np.array([[(h * evidence**2).sum(), (h * evidence).sum()], [(h * evidence).sum(), h.sum()]]) + 1e-2 * np.eye(2)
        delta = np.linalg.solve(hess, g)
        slope, offset = slope + float(np.clip(delta[0], -1, 1)), offset + float(np.clip(delta[1], -1, 1))
    return max(slope, 1e-3), offset


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id", fit_lines: int = FIT_LINES) -> Crf | None:
    """A model fitted on at most ``sample`` documents of each label and ``fit_lines`` lines; None when a label has no documents.

    Documents with contradicting labels count as bad.
    """
    truth = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    truth = truth.groupBy(F.col(id_col).alias("id")).agg((F.min("quality") == 1).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in truth.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    picked = None
    for y in (0, 1):
        part = truth.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # 2 * sample ids at most are broadcast; rows that repeat an id are one
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")

    def make():
        def run(texts):
            made = [line_features(t)[:SAMPLE_LINES] for t in texts]
            return [m.tobytes() for m in made], [len(m) for m in made]

        return run

    got = map_rows(rows, make, "x binary, lines int", ["text"], ["id", "y"]).dropDuplicates(["id"])
    # At most ``sample`` rows of a label; of those that would pass its half of the lines none but the first goes on.
    upto = F.sum("lines").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    got = got.withColumn("upto", upto).where((F.col("upto") <= fit_lines // 2) | (F.col("upto") == F.col("lines"))).drop("upto")
    got = got.toPandas().sort_values("id", kind="stable")
    if got["y"].nunique() < 2:
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N)
    return fit(x, got["lines"].to_numpy(), got["y"].to_numpy(), n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Crf | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``carry`` columns) with ``score`` and the share of lines likelier bad, ``bad_lines``.

    Null and empty texts are one empty line. Without a model every score is 0.5. Repeated rows,
    null ids and extra columns pass through, but for a ``score`` or ``bad_lines`` of ``docs``, which gives way.
    """

    def make():
        def run(texts):
            if model is None:
                return [0.5] * len(texts), [0.0] * len(texts)
            made = [line_features(t) for t in texts]
            sizes = np.array([len(m) for m in made])
            x = np.concatenate(made)
            p = model.marginals(x, sizes)
            bad = np.add.reduceat((p < 0.5).astype(np.float64), np.cumsum(sizes) - sizes) / sizes
            return model.score(x, sizes).tolist(), bad.tolist()

        return run

    return map_rows(docs, make, "score double, bad_lines double", [text_col], carry, rows=500, chars=1_000_000)
