"""Quality classifier: an additive model with pairwise interactions (operator 10).

Every feature of a text is cut into bins at quantiles of the training rows.  Boosting goes
round the features in a cycle; each turn fits a shallow tree to one feature's binned
gradients and adds it, shrunk, to that feature's lookup table.  Then the pairs of
features that explain most of what is left get two-dimensional tables in the same way.
A text's score is the logistic of a sum of table entries, so scoring is bin lookups and
additions on whole columns.

Features are computed in Arrow tasks from whole texts.  The model is fitted on at most
``TRAIN_ROWS`` labelled rows (their features, not their texts, reach the driver).

Null and empty texts have all-zero features and are scored like any other.  Without
labelled rows every score is 0.5; with one class only, the smoothed share of that class.
Repeated rows are scored alike; labels of a repeated ``doc_id`` count as their maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propkit.llm import _text as T
from propkit.llm._signals import count_in, keyed, signals
from propkit.llm.toxicity import held_out, label_sample

TRAIN_ROWS, BINS, PAIR_BINS, PAIRS = 20000, 32, 8, 8
FEATURES = ("log_words", "word_length", "upper_share", "symbols_per_word", "marks_per_word", "bars_per_word", "dup_line_share",
            "repeat_share", "distinct_share", "same_neighbour_share", "digit_share", "words_per_line", "short_share",
            "stops_per_word", "punct_end_share", "top_word_share")


def _bytes(*chars: int) -> np.ndarray:
    x = np.zeros(256, bool)
    x[list(chars)] = True
    return x


_UPPER, _LETTER, _DIGIT = _bytes(*range(65, 91)), _bytes(*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)), _bytes(*range(48, 58))
_MARK, _BAR, _STOP = _bytes(ord("!"), ord("?")), _bytes(ord("|")), _bytes(ord("."), ord(","))
_PUNCT = _bytes(*[b for b in range(33, 127) if not chr(b).isalnum()])


def features(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The feature matrix (texts x features) of a block."""
    x = signals(buf, ends)
    n, own, bounds, h, s, e = x["n_words"], x["own"], x["bounds"], x["hash"], x["starts"], x["stops"]
    w = np.maximum(n, 1)
    k = np.sort(keyed(h, own))
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    # distinct words and the most frequent one need the text of each key again
    order = np.argsort(keyed(h, own))
    runs = np.flatnonzero(new)
    run_own, run_len = own[order][runs], np.diff(np.append(runs, len(k)))
    top = np.zeros(len(ends))
    np.maximum.at(top, run_own, run_len)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    letters = count_in(_LETTER[buf], ends)
    chars = x["word_chars"]
    return np.column_stack([
        np.log1p(n), chars / w, count_in(_UPPER[buf], ends) / np.maximum(letters, 1), x["n_symbols"] / w, count_in(_MARK[buf], ends) / w,
        count_in(_BAR[buf], ends) / w, x["n_dup_lines"] / np.maximum(x["n_lines"], 1), x["n_repeat_words"] / w,
        np.bincount(run_own, minlength=len(ends)) / w, T.per_text(same, bounds) / w, count_in(_DIGIT[buf], ends) / np.maximum(chars, 1),
        n / np.maximum(x["n_lines"], 1), T.per_text(e - s <= 3, bounds) / w, count_in(_STOP[buf], ends) / w,
        T.per_text(_PUNCT[buf[e - 1]] if len(e) else np.zeros(0), bounds) / w, top / w]).astype(np.float64)


# ---- fitting --------------------------------------------------------------------

def _tree1(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf values by bin of a tree of the given depth on one feature."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, d: int) -> None:
        G, H = g[a:b].sum(), h[a:b].sum()
        cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        ok = (ch >= least) & (H - ch >= least)
        if d and ok.any():
            gain = np.where(ok, cg ** 2 / (ch + 1) + (G - cg) ** 2 / (H - ch + 1) - G ** 2 / (H + 1), -1)
            i = int(gain.argmax())
            if gain[i] > 1e-9:
                grow(a, a + i + 1, d - 1)
                grow(a + i + 1, b, d - 1)
                return
        out[a:b] = G / (H + 1)

    grow(0, len(g), depth)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Leaf values of a tree that cuts one axis, then both parts along the other; and its gain."""
    G, H = g.sum(), h.sum()
    best, table = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for i in range(1, len(gg)):
            out, gain = np.zeros_like(gg), -G ** 2 / (H + 1)
            for part in (slice(0, i), slice(i, None)):
                line = _tree1(gg[part].sum(0), hh[part].sum(0), 1, least)
                out[part] = line
                gain += float((line * (2 * gg[part].sum(0) - line * (hh[part].sum(0)))).sum())
            if gain > best:
                best, table = gain, out.T.copy() if flip else out
    return table, best


def fit_tables(X: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> dict:
    """Bin edges, one table per feature, the chosen pairs and their tables."""
    y = np.asarray(y, float)
    edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(X.shape[1])]
    coarse = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(X.shape[1])]
    b = [np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(edges)]
    c = [np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(coarse)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), base)

    def derivatives() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    least = max(1e-3, 0.0005 * len(y) * share * (1 - share))
    for _ in range(rounds):
        for j, t in enumerate(tables):
            g, h = derivatives()
            leaf = rate * _tree1(np.bincount(b[j], g, len(t)), np.bincount(b[j], h, len(t)), 2, least)
            t += leaf
            margin += leaf[b[j]]
    g, h = derivatives()
    cell = lambda i, j: c[i] * (len(coarse[j]) + 1) + c[j]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)
    grid = lambda v, i, j: np.bincount(cell(i, j), v, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))
    gains = [(-_tree2(grid(g, i, j), grid(h, i, j), least)[1], i, j) for i in range(len(b)) for j in range(i)]
    pairs = [(i, j) for gain, i, j in sorted(gains)[:PAIRS] if gain < 0]
    grids = [np.zeros(shape(i, j)) for i, j in pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(pairs, grids):
            g, h = derivatives()
            leaf = rate * _tree2(grid(g, i, j), grid(h, i, j), least)[0]
            t += leaf
            margin += leaf[c[i], c[j]]
    return {"edges": edges, "coarse": coarse, "tables": tables, "pairs": pairs, "grids": grids, "base": base}


def score_matrix(m: dict, X: np.ndarray) -> np.ndarray:
    z = np.full(len(X), m["base"])
    for j, (e, t) in enumerate(zip(m["edges"], m["tables"])):
        z += t[np.searchsorted(e, X[:, j], side="left")]
    for (i, j), t in zip(m["pairs"], m["grids"]):
        z += t[np.searchsorted(m["coarse"][i], X[:, i], side="left"), np.searchsorted(m["coarse"][j], X[:, j], side="left")]
    return 1 / (1 + np.exp(-z))


# ---- Spark ----------------------------------------------------------------------

def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, buf, ends in T.blocks(batch.column(1)):
            X = features(buf, ends)
            offs = pa.array(np.arange(0, X.size + 1, X.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends)), pa.ListArray.from_arrays(offs, pa.array(X.reshape(-1)))],
                                             names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, text_col: str = "text") -> dict | None:
    """Fit on at most ``rows`` labelled documents; None when there are none."""
    sample = label_sample(labels, label, rows)
    d = docs.select(F.col("doc_id").alias("_id"), F.col(text_col).cast("string").alias("text"))
    got = d.join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).select("doc_id", F.col("_label").alias("y"), "text")
    got = got.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "text").limit(rows).select("y", "text")  # repeated ids
    got = got.mapInArrow(_features, "y int, x array<double>").collect()
    if not got:
        return None
    rows_ = sorted((r["y"], *r["x"]) for r in got)  # one order for any partitioning
    a = np.array(rows_)
    return fit_tables(a[:, 1:], a[:, 0])


def _scorer(model: dict | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, ends in T.blocks(batch.column(1)):
                score = score_matrix(model, features(buf, ends)) if model else np.full(len(ends), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ends)), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])
    return run


def score(docs: DataFrame, model: dict | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = x.mapInArrow(_scorer(model, threshold), "doc_id long, score double, predicted int")
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
