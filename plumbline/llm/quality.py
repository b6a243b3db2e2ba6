"""Quality rules: gradient-boosted trees over document statistics.

Statistics are ratios of counts over the whole text. Trees split on quantile bins of a bounded sample of labelled
documents (SAMPLE at most), fitted to logistic loss by Newton steps. For features in FALLING a larger value never
raises the score: a split whose sides are in the wrong order is not taken, and the sides' later leaves stay on their
side of the middle. The forest is flattened into numpy arrays of nodes, through which all rows of a batch walk
together, one level at a time.

Null and empty texts have zero counts. A label is the rounded mean of the rows of its doc_id; rows without doc_id or
label teach nothing. Without training rows every score is 1, so only the base rules reject. Repeated rows get equal
results, an empty table an empty one. Extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.toxicity import labelled_sample

SAMPLE = 16_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
LEAST_ROWS, RIDGE = 5, 1.0
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits",
          "n_marks", "n_bars", "longest")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "variety", "line_words", "upper", "digits", "marks", "bars", "longest")
FALLING = ("symbols", "dup_lines", "repeats", "bars")
_SPACE = b"\t\n\x0b\x0c\r "
_FOLLOW = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def _without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of WINDOW words that occurs twice or more in the list."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    starts = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for shift in range(WINDOW):
        inside[shift : shift + len(starts)] |= starts
    return int(inside.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), len(text.translate(None, _SPACE + _FOLLOW)), _without(text, b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words),
        len(set(words)), len(lines), _without(text, _UPPER), _without(text, _DIGITS), _without(text, b"!?"), _without(text, b"|"),
        max(map(len, words), default=0),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct `counts` of the counts of each whole text."""

    def counted(texts: pa.Array) -> pa.Array:
        rows = np.array([counts_of(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], COUNTS)

    kind = "struct<" + ", ".join(f"{n}: bigint" for n in COUNTS) + ">"
    return docs.withColumn("counts", F.arrow_udf(counted, kind)(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of FEATURES."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log2(1 + c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_distinct"] / words, c["n_words"] / lines, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_bars"] / words,
        np.log2(1 + c["longest"]),
    ])


class Forest:
    """Nodes of all trees in arrays; a leaf points at itself."""

    def __init__(self, feature, threshold, left, right, value, roots) -> None:
        self.feature, self.threshold, self.left, self.right = (np.asarray(x) for x in (feature, threshold, left, right))
        self.value, self.roots = np.asarray(value, np.float64), np.asarray(roots, np.int64)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log odds. A row goes left where its value is at most the threshold."""
        out = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                node = np.where(rows[at_row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit_forest(rows: np.ndarray, labels: np.ndarray, falling: tuple[str, ...] = FALLING) -> Forest:
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        for column, x in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, v)):
            column.append(x)
        return k

    if not len(labels):
        return Forest([], [], [], [], [], [])
    mean = np.clip(labels.mean(), 0.01, 0.99)
    margin = np.full(len(labels), np.log(mean / (1 - mean)))
    roots.append(node(float(margin[0])))
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(rows.shape[1])]
    binned = np.column_stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)])
    signs = [-1 if name in falling else 0 for name in FEATURES]

    def best_split(at: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        best = (1e-6, None)
        whole_g, whole_h = g[at].sum(), h[at].sum()
        for f, e in enumerate(edges):
            gs, hs, ns = (np.bincount(binned[at, f], w, len(e) + 1).cumsum()[:-1] for w in (g[at], h[at], np.ones(len(at))))
            if not len(e):
                continue
            sides = [np.clip(-a / (b + RIDGE), low, high) for a, b in ((gs, hs), (whole_g - gs, whole_h - hs))]
            gain = sum(-(a * v + 0.5 * (b + RIDGE) * v * v) for (a, b), v in zip(((gs, hs), (whole_g - gs, whole_h - hs)), sides, strict=True))
            v = np.clip(-whole_g / (whole_h + RIDGE), low, high)
            gain = gain + whole_g * v + 0.5 * (whole_h + RIDGE) * v * v
            bad = (ns < LEAST_ROWS) | (len(at) - ns < LEAST_ROWS) | ((sides[1] - sides[0]) * signs[f] < 0)
            k = int(np.argmax(gain := np.where(bad, -np.inf, gain)))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(sides[0][k]), float(sides[1][k])))
        return best[1]

    def grow(at: np.ndarray, g, h, depth: int, low: float, high: float) -> int:
        own = float(np.clip(-g[at].sum() / (h[at].sum() + RIDGE), low, high))
        split = best_split(at, g, h, low, high) if depth < DEPTH and len(at) >= 2 * LEAST_ROWS else None
        k = node(RATE * own)
        if split is None:
            margin[at] += RATE * own
            return k
        f, cut, a, b = split
        bounds = ((low, high), (low, high)) if not signs[f] else (((a + b) / 2, high), (low, (a + b) / 2))
        goes_left = binned[at, f] <= cut
        feature[k], threshold[k] = f, edges[f][cut]
        left[k] = grow(at[goes_left], g, h, depth + 1, *bounds[0])
        right[k] = grow(at[~goes_left], g, h, depth + 1, *bounds[1])
        return k

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(labels)), p - labels, p * (1 - p), 0, -np.inf, np.inf))
    return Forest(feature, threshold, left, right, value, roots)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    whole = pa.Table.from_batches(parts) if parts else None
    forest = fit_forest(np.zeros((0, len(FEATURES))), np.zeros(0)) if whole is None else fit_forest(
        matrix({n: whole[n].to_numpy() for n in COUNTS}), whole["label"].to_numpy().astype(np.float64))
    root = np.isin(np.arange(len(forest.value)), forest.roots)
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
    columns = (forest.feature, forest.threshold, forest.left, forest.right, forest.value, root)
    yield pa.RecordBatch.from_arrays([pa.array(c.tolist(), k) for c, k in zip(columns, kinds, strict=True)], ["feature", "threshold", "left", "right", "value", "root"])


class Rules:
    """A fitted forest and the scoring of documents."""

    def __init__(self, forest: Forest) -> None:
        self.forest = forest

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, teaches=None) -> Rules:
        rows = labelled_sample(docs, labels, label, sample, F.lit(True) if teaches is None else teaches)
        counted = statistics(rows).select("counts.*", "label", "place").repartition(1).sortWithinPartitions("place").drop("place")
        nodes = counted.mapInArrow(_fit, "feature long, threshold double, left long, right long, value double, root boolean")
        found = nodes.collect()  # 31 nodes a tree at most
        return cls(Forest(*([r[i] for r in found] for i in range(5)), [k for k, r in enumerate(found) if r.root]))

    def score(self, counts: DataFrame) -> DataFrame:
        """counts (from statistics()) with `quality`, the probability that a document is good."""
        forest = counts.sparkSession.sparkContext.broadcast(self.forest)

        def scored(found: pa.Array) -> pa.Array:
            columns = dict(zip(COUNTS, (c.to_numpy(zero_copy_only=False) for c in found.flatten()), strict=True))
            margin = forest.value.margin(matrix(columns)) if len(forest.value.roots) else np.full(len(found), 40.0)
            return pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

        return counts.withColumn("quality", F.arrow_udf(scored, "double")("counts"))
