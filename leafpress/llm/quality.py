"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: a place for each hashed word (its weight grows with the square root
of its count, and the words' part has length one) and one place for the bin of each statistic. The score is
    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,
whose pairwise part is taken in linear time as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2.

The model is fitted on a bounded sample of labelled rows on the driver; statistics' bins are
quantiles of the same sample. Scoring is one narrow pass over the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import LOWER, SPACE_WORDS, texts, words

#: Hashed words, bins of a statistic, rank of the interactions.
WORDS, BINS, RANK = 1 << 15, 12, 6
#: At most so many labelled rows are used for fitting (never for scoring).
FIT_ROWS = 6000
_STATS = [
    "bytes", "words", "mean_word", "upper", "digits", "beyond_ascii", "blanks", "lines", "repeat", "distinct", "shouted", "odd_tail",
    *(f"char_{c}" for c in "!#$%&*.,|@:;?-_/=<>()[]{}\"'"), "long_words", "last_repeat", "line_words",
]


def statistics(buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of structure statistics and metadata for each text; shares, so that length counts once only."""
    m = len(offs) - 1
    size = np.diff(offs).astype(float)
    n = np.bincount(doc, minlength=m).astype(float)
    some, letters = np.maximum(n, 1), np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[offs[1:]] - run[offs[:-1]]) / letters

    def of_words(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=m) / some

    upper = (buf >= 65) & (buf <= 90)
    run = np.concatenate([[0], np.cumsum(upper)])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    two = np.zeros(len(h), bool)
    two[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][first], minlength=m) / some
    length = end - start
    alnum = ((LOWER[buf] >= 97) & (LOWER[buf] <= 122)) | (buf >= 128) | ((buf >= 48) & (buf <= 57))
    tail = np.zeros(len(h), bool)
    if len(h):
        tail = (length >= 3) & ~alnum[end - 1] & ~alnum[np.maximum(end - 2, 0)]
    lines = share(buf == 10) * letters + 1
    cols = [
        np.log1p(size), np.log1p(n), of_words(length), share(upper), share((buf >= 48) & (buf <= 57)), share(buf >= 128), share(buf == 32), lines / some,
        of_words(same), distinct, of_words((run[end] - run[start] == length) & (length > 1)) if len(h) else np.zeros(m), of_words(tail),
        *(share(buf == ord(c)) for c in "!#$%&*.,|@:;?-_/=<>()[]{}\"'"), of_words(length > 20), of_words(two), n / lines,
    ]
    return np.stack(cols, axis=1)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, statistics, text index, word place, word weight) for runs of rows."""
    for lo, hi, buf, offs in texts(column):
        doc, h, start, end = words(buf, offs, SPACE_WORDS)
        stats = statistics(buf, offs, doc, h, start, end)
        key = doc.astype(np.int64) * WORDS + (h % np.uint64(WORDS)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        own, place = key // WORDS, key % WORDS
        weight = np.sqrt(count)
        norm = np.sqrt(np.bincount(own, weights=weight**2, minlength=hi - lo))
        yield lo, hi, stats, own, place, weight / norm[own]


@dataclass
class FactorisationMachine:
    """Linear weights, factors and bin edges; small, of a size that the parameters fix."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def places(edges: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """The place of each statistic's bin, after the words' places."""
        bins = np.stack([np.searchsorted(e, x, side="left") for e, x in zip(edges, stats.T)], axis=1)
        return WORDS + np.arange(len(edges)) * (BINS + 1) + bins

    def score(self, stats: np.ndarray, own: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at = self.places(self.edges, stats)
        m = len(stats)
        scale = 1 / np.sqrt(at.shape[1])
        out = self.bias + self.linear[at].sum(axis=1) * scale + np.bincount(own, weights=self.linear[place] * weight, minlength=m)
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f]
            s = np.bincount(own, weights=v[place] * weight, minlength=m) + v[at].sum(axis=1) * scale
            q = np.bincount(own, weights=(v[place] * weight) ** 2, minlength=m) + (v[at] ** 2).sum(axis=1) * scale**2
            out += 0.5 * (s * s - q)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 25, rate: float = 0.05, decay: float = 2e-4, seed: int = 0) -> FactorisationMachine:
    """Adam on the logistic loss over minibatches. rows: (statistics, word places, word weights)."""
    rng = np.random.default_rng(seed)
    size = WORDS + len(_STATS) * (BINS + 1)
    if not rows:
        return FactorisationMachine(np.zeros((len(_STATS), BINS)), 0.0, np.zeros(size), np.zeros((size, RANK)))
    stats = np.stack([r[0] for r in rows])
    edges = np.quantile(stats, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T.copy()
    at = FactorisationMachine.places(edges, stats)
    scale = 1 / np.sqrt(at.shape[1])
    feats = [(np.concatenate([r[1], a]), np.concatenate([r[2], np.full(len(a), scale)])) for r, a in zip(rows, at)]
    params = [np.zeros(1), np.zeros(size), rng.normal(0, 0.02, (size, RANK))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            idx = np.concatenate([feats[i][0] for i in part])
            x = np.concatenate([feats[i][1] for i in part])
            own = np.repeat(np.arange(len(part)), [len(feats[i][0]) for i in part])
            cut = np.concatenate([[0], np.cumsum([len(feats[i][0]) for i in part])[:-1]])
            v = params[2][idx] * x[:, None]
            s = np.add.reduceat(v, cut, axis=0)
            z = params[0][0] + np.add.reduceat(params[1][idx] * x, cut) + 0.5 * (s * s - np.add.reduceat(v * v, cut, axis=0)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part)
            # Only the batch's places get a step.
            touched, inverse = np.unique(idx, return_inverse=True)
            gx = g[own] * x
            glin = np.bincount(inverse, weights=gx) + decay * params[1][touched]
            full = gx[:, None] * (s[own] - v)
            gfac = np.stack([np.bincount(inverse, weights=full[:, f]) for f in range(RANK)], axis=1) + decay * params[2][touched]
            step += 1
            for j, (where, grad) in enumerate(((slice(None), np.array([g.sum()])), (touched, glin), (touched, gfac))):
                m, u = moments[j]
                m[where] = 0.9 * m[where] + 0.1 * grad
                u[where] = 0.99 * u[where] + 0.01 * grad * grad
                params[j][where] -= rate * (m[where] / (1 - 0.9**step)) / (np.sqrt(u[where] / (1 - 0.99**step)) + 1e-8)
    return FactorisationMachine(edges, float(params[0][0]), params[1], params[2])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as decimal text, leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, stats, own, place, weight in features(batch.column(1)):
            at = np.searchsorted(own, np.arange(hi - lo + 1))
            cells = [slice(at[i], at[i + 1]) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array([s.tobytes() for s in stats], pa.binary()), pa.array([place[c].astype("<i4").tobytes() for c in cells], pa.binary()), pa.array([weight[c].astype("<f4").tobytes() for c in cells], pa.binary())],
                names=["label", "turn", "stats", "places", "weights"],
            )


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fit on at most fit_rows labelled rows that aren't held out, chosen by a hash of their id.

    Texts are looked at whole, as in scoring. Null labels and ids, and labels without a document, are left
    out; of repeated labels the largest counts; rows that share a labelled id all count, but no more than
    fit_rows in all, those first whose id's hash and features are least. Without any labelled row
    the machine scores 0.5 throughout. Other columns are not looked at.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("label"))
    marks = marks.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id")
    # A labelled id may stand on any number of rows, so the bound holds for rows too.
    found = chosen.select("label", "text", F.xxhash64("id").alias("turn")).mapInArrow(_extract, "label int, turn long, stats binary, places binary, weights binary")
    found = found.orderBy("turn", "stats", "places", "label").limit(fit_rows).drop("turn").toArrow()
    rows = [(np.frombuffer(s, float), np.frombuffer(p, "<i4"), np.frombuffer(w, "<f4")) for s, p, w in zip(*(found[c].to_pylist() for c in ("stats", "places", "weights")))]
    target = np.array(found["label"].to_pylist(), float)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0].tobytes(), rows[i][1].tobytes(), target[i]))  # the same whatever order they came in
    return fit_machine([rows[i] for i in order], target[order] if len(order) else target)


def _score(model, keep: float | None, columns: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch in batches:
            for lo, hi, *x in features(batch.column(text_at)):
                p = machine.score(*x)
                if keep is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(p, pa.float64())], names=["doc_id", "score"])
                else:
                    rows = batch.slice(lo, hi - lo).filter(pa.array(p >= keep))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(rows.columns, names=columns)

    return run


def score_quality(docs: DataFrame, machine: FactorisationMachine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row; null and empty texts are scored as empty ones."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of a size that WORDS, BINS and RANK fix
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = base.mapInArrow(_score(model, None, [], 1), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, machine: FactorisationMachine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores threshold or more."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.mapInArrow(_score(model, threshold, docs.columns, docs.columns.index(text_col)), docs.schema)
