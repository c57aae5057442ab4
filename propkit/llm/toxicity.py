"""Toxicity by a bidirectional gated recurrent network over words and characters (operator 3).

A text is lower-cased (A-Z) and cut into words (runs of letters, digits and non-ASCII characters)
and runs of symbols; a word that repeats the one before it becomes a sign of repetition.
Overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, cover the whole text.  In each
window a GRU runs in both directions over word inputs (an embedding of the word, if the
vocabulary has it) and character inputs (the sum of embeddings of the word's hashed
character 4-grams, so unseen words with known stems count); attention pools the states
into one logit.

The network is trained in numpy on a bounded sample: ``TRAIN_ROWS`` labelled rows in hash order,
whole texts of at most ``TRAIN_BYTES`` bytes each.  Embeddings start from the smoothed log-odds of
words and 4-grams in the sample.  Every round picks the most telling window of each text,
in the first round by its highest log-odds (a network that knows nothing yet would pick windows
at random and learn from them), later by the network, and learns from those windows; word
embeddings are dropped at random, so that the characters count too, and gradients are
clipped.  ``RESTARTS`` networks are trained from different starts and their logits averaged.  A
logistic curve, fitted to texts that they have not learnt, maps the highest windows of a text
to its score.  One task trains, and only the finished arrays (about 1 MB) reach the driver.  Scoring
is one pass over the texts in Arrow tasks; nothing is shuffled.

Null and empty texts have one empty window and get its score.  Without labelled rows every
score is 0.  Repeated rows are scored alike.  Labels of a repeated ``doc_id`` count as
their maximum.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propkit.llm import _text as T

WINDOW, STRIDE = 32, 24
TRAIN_ROWS, TRAIN_BYTES, VOCABULARY, GRAMS = 3000, 1 << 16, 8192, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 6, 4, 8, 8
CHAR_SCALE = 6.0  # of the mean of a word's character embeddings
TOP, LIMIT, APART = 4, 8.0, 6  # windows that a text is judged by, bound of their logits, one text in so many is kept for the curve
RESTARTS = 2  # networks that are averaged
MISSED = 4.0  # weight of a missed toxic text against a false alarm
DROP, CLIP, LEAST = 0.1, 0.5, 3  # dropped word embeddings, largest gradient, texts that a word of the vocabulary is in

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def label_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out third, in a fixed hash order."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("_label"))
    return known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)


# ---- inputs -------------------------------------------------------------------

def tokens(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(lower-cased buffer, starts, stops, bounds)`` of the inputs of a block: words, runs of
    symbols other than a single common mark, and, for a word that repeats the one before it,
    the sign of repetition that stands behind the texts."""
    buf = T.LOWER[buf]
    kind = np.where(_WORD_BYTE[buf], 2, np.where(T.SPACE[buf], 0, 1)).astype(np.int8)
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    s, e = edge[:-1], edge[1:]
    what = kind[s]
    keep = (what == 2) | ((what == 1) & ((e - s > 1) | ~_MARK[buf[s]]))
    s, e = s[keep], e[keep]
    bounds = np.concatenate(([0], np.searchsorted(s, ends)))
    h = T.span_hash(buf, s, e)
    again = np.flatnonzero((h[1:] == h[:-1]) & (np.diff(T.owner(bounds)) == 0)) + 1
    s[again], e[again] = len(buf), len(buf) + 1
    return np.append(buf, np.uint8(1)), s, e, bounds


def grams(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 4-grams of the words ``buf[s:e]``, a blank before and after each,
    one after another, and the bounds of each word's."""
    size = e - s + 2
    first = np.cumsum(size) - size
    flat = np.full(int(size.sum()) + 3, 0x20, np.uint32)
    inner = np.ones(len(flat), bool)
    inner[first] = False
    inner[first + size - 1] = False
    inner[-3:] = False
    n = e - s
    flat[inner] = buf[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    g = flat[:-3] | flat[1:-2] << np.uint32(8) | flat[2:-1] << np.uint32(16) | flat[3:] << np.uint32(24)
    g = (g * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1)
    keep = np.maximum(size - 3, 1)  # grams that lie in their word; a short word has one
    bounds = np.concatenate(([0], np.cumsum(keep)))
    at = np.repeat(first - bounds[:-1], keep) + np.arange(bounds[-1])
    return g[at].astype(np.int64), bounds


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every window, and the bounds of each text's windows (one at least)."""
    n = np.diff(bounds)
    k = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    wb = np.concatenate(([0], np.cumsum(k)))
    text = np.repeat(np.arange(len(n)), k)
    off = (np.arange(wb[-1]) - wb[text]) * STRIDE
    return bounds[text] + off, np.minimum(WINDOW, n[text] - off), wb


# ---- the network ----------------------------------------------------------------
# Arrays are laid out (features, windows), one step of the sequence at a time.

def new_parameters(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTENTION
    p = {"E": rng.normal(0, 0.1, (words + 1, WORD_DIM)), "C": rng.normal(0, 0.02, (GRAMS, CHAR_DIM)),
         "Wa": rng.normal(0, 0.3, (a, 2 * h)), "ba": np.zeros((a, 1)), "v": rng.normal(0, 0.5, (a, 1)),
         "w": rng.normal(0, 0.5, (2 * h, 1)), "b": np.full((1, 1), -1.0)}
    for k in "fb":  # forward and backward; rows: update, reset, candidate
        p |= {f"W{k}": rng.normal(0, 0.3, (3 * h, d)), f"U{k}": rng.normal(0, 0.3, (3 * h, h)), f"B{k}": np.zeros((3 * h, 1))}
    p["E"][0] = 0  # words outside the vocabulary
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(proj, mask: np.ndarray, U: np.ndarray, order, keep: bool):
    """States of every step; ``proj(t)`` gives the projected inputs, with their bias."""
    h = np.zeros((HIDDEN, mask.shape[1]), U.dtype)
    states, tape = [None] * len(mask), []
    for t in order:
        x, uh = proj(t), U @ h
        zr = _sigmoid(x[: 2 * HIDDEN] + uh[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = np.tanh(x[2 * HIDDEN:] + r * uh[2 * HIDDEN:])
        new = (n + z * (h - n)) * mask[t]
        if keep:
            tape.append((t, z, r, n, h, uh[2 * HIDDEN:]))
        states[t] = h = new
    return states, tape


def _pool(p: dict, hs: list[np.ndarray], mask: np.ndarray):
    q = [np.tanh(p["Wa"] @ h + p["ba"]) for h in hs]
    s = np.where(mask > 0, np.concatenate([p["v"].T @ x for x in q]), -1e9)
    e = np.exp(s - s.max(0)) * mask
    alpha = e / np.maximum(e.sum(0), 1e-9)
    c = sum(a * h for a, h in zip(alpha, hs))
    return (p["w"].T @ c + p["b"])[0], (q, alpha, c)


def forward(p: dict, proj: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows; ``proj`` (6 x hidden, distinct words) holds the projected inputs."""
    h3 = 3 * HIDDEN
    f, _ = _gru(lambda t: proj[:h3].take(index[t], 1), mask, p["Uf"], range(len(mask)), False)
    b, _ = _gru(lambda t: proj[h3:].take(index[t], 1), mask, p["Ub"], range(len(mask) - 1, -1, -1), False)
    return _pool(p, [np.concatenate(x) for x in zip(f, b)], mask)[0]


def loss_and_gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean log loss over windows, its gradients, and those of the inputs ``x`` (steps, features, windows)."""
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in "EC"}
    runs = {k: _gru(lambda t, k=k: p[f"W{k}"] @ x[t] + p[f"B{k}"], mask, p[f"U{k}"],
                    range(len(mask)) if k == "f" else range(len(mask) - 1, -1, -1), True) for k in "fb"}
    hs = [np.concatenate(z) for z in zip(runs["f"][0], runs["b"][0])]
    logit, (q, alpha, c) = _pool(p, hs, mask)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    dl = ((_sigmoid(logit) - y) / len(y))[None]
    g["w"], g["b"] = c @ dl.T, dl.sum(1, keepdims=True)
    dc = p["w"] * dl
    da = np.stack([(h * dc).sum(0) for h in hs])
    ds = alpha * (da - (alpha * da).sum(0))
    dh = []
    for t, h in enumerate(hs):
        g["v"] += q[t] @ ds[t][:, None]
        dq = p["v"] * ds[t] * (1 - q[t] ** 2)
        g["Wa"] += dq @ h.T
        g["ba"] += dq.sum(1, keepdims=True)
        dh.append(alpha[t] * dc + p["Wa"].T @ dq)
    dx = np.zeros_like(x)
    for k, rows in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        U, W = p[f"U{k}"], p[f"W{k}"]
        carry = np.zeros_like(dh[0][rows])
        for t, z, r, n, h, un in reversed(runs[k][1]):
            d = (dh[t][rows] + carry) * mask[t]
            dn = d * (1 - z) * (1 - n ** 2)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            pre = np.concatenate([dz, dr, dn])
            rec = np.concatenate([dz, dr, dn * r])
            g[f"W{k}"] += pre @ x[t].T
            g[f"B{k}"] += pre.sum(1, keepdims=True)
            g[f"U{k}"] += rec @ h.T
            carry = d * z + U.T @ rec
            dx[t] += W.T @ pre
    return loss, g, dx


def _log_odds(hit: np.ndarray, seen: np.ndarray, share: float, prior: float = 10.0) -> np.ndarray:
    p = (hit + prior * share) / (seen + prior)
    return np.log(p / (1 - p)) - np.log(share / (1 - share))


def train(texts: list[str | None], y: np.ndarray, rounds: int = 4, passes: int = 1, batch: int = 128, seed: int = 5,
          restarts: int = RESTARTS) -> dict:
    """The model fitted to texts and labels: arrays ready for ``score_block``, of several
    networks whose logits are averaged."""
    y = np.asarray(y, float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    learnt = np.arange(len(y)) % APART != 0 if len(y) >= 10 * APART else np.ones(len(y), bool)
    words, doc, raw_s, raw_e, bufs, shift, counts = [], [], [], [], [], 0, []
    for first, buf, ends in T.blocks(pa.array(texts, pa.string())):
        low, s, e, bounds = tokens(buf, ends)
        words.append(T.span_hash(low, s, e))
        doc.append(T.owner(bounds) + first)
        raw_s.append(s + shift)
        raw_e.append(e + shift)
        bufs.append(low)
        counts.append(np.diff(bounds))
        shift += len(low)
    h, doc, buf = np.concatenate(words), np.concatenate(doc), np.concatenate(bufs)
    s, e, bounds = np.concatenate(raw_s), np.concatenate(raw_e), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    pairs = np.unique(inv * len(texts) + doc)
    pairs_in = pairs[learnt[pairs % len(texts)]]
    seen = np.bincount(pairs_in // len(texts), minlength=len(uniq))
    hit = np.bincount(pairs_in // len(texts), weights=y[pairs_in % len(texts)], minlength=len(uniq))
    odds = _log_odds(hit, seen, share)
    pick = np.flatnonzero(seen >= LEAST)
    pick = np.sort(pick[np.lexsort((pick, -np.abs(odds[pick]) * np.log1p(seen[pick])))][:VOCABULARY])
    word_id = np.zeros(len(uniq), np.int64)
    word_id[pick] = 1 + np.arange(len(pick))
    gram, gb = grams(buf, s[at], e[at])
    gw = np.repeat(np.arange(len(uniq)), np.diff(gb))
    # presence of a gram in a text, over the distinct (word, text) pairs
    n = np.diff(gb)[pairs // len(texts)]
    gi = np.repeat(gb[pairs // len(texts)] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    gp = np.unique(gram[gi] * len(texts) + np.repeat(pairs % len(texts), n))
    gp = gp[learnt[gp % len(texts)]]
    g_seen = np.bincount(gp // len(texts), minlength=GRAMS)
    g_hit = np.bincount(gp // len(texts), weights=y[gp % len(texts)], minlength=GRAMS)
    start = 0.5 * odds[pick], 0.5 * _log_odds(g_hit, g_seen, share)
    first, length, wb = windows(bounds)

    def network(rng: np.random.Generator) -> dict:
        p = new_parameters(rng, len(pick))
        p["E"][1:, 0], p["C"][:, 0] = start
        adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
        steps = 0
        for rnd in range(rounds):
            if rnd:
                logit = _one(_frozen(p), uniq, word_id, gram, gb, inv, first, length)
            else:  # an untrained network cannot tell: the window with the most telling word
                told = np.append(p["E"][word_id, 0] + CHAR_SCALE * np.add.reduceat(p["C"][gram, 0], gb[:-1]) / np.diff(gb), -1e9)
                logit = np.concatenate([told[_steps(first[i: i + 4096], length[i: i + 4096], inv, len(uniq))[0]].max(0) for i in range(0, len(first), 4096)])
            top = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(wb[:-1], wb[1:])])
            rate = 0.01 if rnd < rounds - 2 else 0.003
            for _ in range(passes):
                order = rng.permutation(np.flatnonzero(learnt))
                for i in range(0, len(order), batch):
                    rows = order[i: i + batch]
                    index, mask = _steps(first[top[rows]], length[top[rows]], inv, len(uniq))
                    used, back = np.unique(index, return_inverse=True)
                    back = back.reshape(index.shape)
                    real = used < len(uniq)
                    wid = np.zeros(len(used), np.int64)
                    wid[real] = word_id[used[real]]
                    sel = np.isin(gw, used[real]) if len(gw) < 1000 else _members(gb, used[real])
                    own = np.repeat(np.arange(len(used))[real], np.diff(gb)[used[real]])
                    char = np.zeros((len(used), CHAR_DIM))
                    np.add.at(char, own, p["C"][gram[sel]])
                    many = np.maximum(np.bincount(own, minlength=len(used)), 1)[:, None]
                    char *= CHAR_SCALE / many
                    wid[rng.random(len(used)) < DROP] = 0
                    table = np.concatenate([p["E"][wid], char], 1)
                    x = table[back].transpose(0, 2, 1)
                    _, g, dx = loss_and_gradients(p, x, mask, y[rows])
                    dt = np.zeros_like(table)
                    np.add.at(dt, back, dx.transpose(0, 2, 1))
                    g["E"], g["C"] = np.zeros_like(p["E"]), np.zeros_like(p["C"])
                    np.add.at(g["E"], wid, dt[:, :WORD_DIM])
                    np.add.at(g["C"], gram[sel], (dt[:, WORD_DIM:] * CHAR_SCALE / many)[own])
                    g["E"][0] = 0
                    norm = np.sqrt(sum(float((v ** 2).sum()) for v in g.values()))
                    g = {k: v * min(1.0, CLIP / max(norm, 1e-12)) for k, v in g.items()}
                    steps += 1
                    for k, v in p.items():
                        m1, m2 = adam[k]
                        m1 += 0.1 * (g[k] - m1)
                        m2 += 0.001 * (g[k] ** 2 - m2)
                        v -= rate * (m1 / (1 - 0.9 ** steps)) / (np.sqrt(m2 / (1 - 0.999 ** steps)) + 1e-8)
        return _frozen(p)

    nets = [network(np.random.default_rng([seed, i])) for i in range(restarts)]
    model = {f"{k}{i}": v for i, net in enumerate(nets) for k, v in net.items()} | {"nets": np.array(restarts)}
    model["keys"], model["ids"] = uniq[pick], word_id[pick]
    # a curve from the windows of a text to its label, from texts that the network has not learnt
    apart = ~learnt if len(set(y[~learnt].tolist())) == 2 else np.ones(len(y), bool)
    told = summaries(_logits(model, uniq, word_id, gram, gb, inv, first, length), wb)
    model["curve"] = _curve(told[apart], y[apart])
    return model


def _members(gb: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = gb[words + 1] - gb[words]
    return np.repeat(gb[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def summaries(logit: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """What a text's windows say together: its ``TOP`` highest logits (the lowest value where it has
    fewer windows) and the logarithm of their number."""
    n = np.diff(wb)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-logit, text))
    out = np.full((len(n), TOP + 1), -1.0)
    nth = np.arange(len(order)) - wb[text]
    first = nth < TOP
    out[text[first], nth[first]] = np.clip(logit[order[first]], -LIMIT, LIMIT) / LIMIT
    out[:, TOP] = np.log(n)
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a logistic curve through the summaries (slightly regularised)."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 0.1), 1e-3)
    weight = np.where(y > 0, MISSED, 1.0)
    for _ in range(60):
        q = _sigmoid(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (q - y)) + ridge * w)
        w -= np.clip(step, -2, 2)
    return w


def _frozen(p: dict) -> dict:
    return {k: v.astype(np.float32) for k, v in p.items()}


def _projected(m: dict, wid: np.ndarray, gram: np.ndarray, gb: np.ndarray) -> np.ndarray:
    """Inputs of distinct words through both directions' weights; the last column is a blank step."""
    char = np.zeros((len(wid), CHAR_DIM), np.float32)
    if len(wid):
        for d in range(CHAR_DIM):
            char[:, d] = np.add.reduceat(m["C"][:, d].take(gram), gb[:-1])
        char *= np.float32(CHAR_SCALE) / np.diff(gb)[:, None].astype(np.float32)
    W, B = np.concatenate([m["Wf"], m["Wb"]]), np.concatenate([m["Bf"], m["Bb"]])
    return np.concatenate([W[:, :WORD_DIM] @ m["E"][wid].T + W[:, WORD_DIM:] @ char.T + B, B], 1)


def _steps(first: np.ndarray, length: np.ndarray, inv: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)[:, None]
    mask = t < length
    at = np.where(mask, first + t, 0)
    return np.where(mask, inv[at] if len(inv) else blank, blank), mask.astype(np.float32)


def _logits(m: dict, *inputs) -> np.ndarray:
    nets = int(m["nets"])
    own = [{k: m[f"{k}{i}"] for k in ("E", "C", "Wa", "ba", "v", "w", "b", "Wf", "Uf", "Bf", "Wb", "Ub", "Bb")} for i in range(nets)]
    return sum(_one(net, *inputs) for net in own) / np.float32(nets)


def _one(m: dict, uniq, word_id, gram, gb, inv, first, length, batch: int = 4096) -> np.ndarray:
    proj = _projected(m, word_id, gram, gb)
    out = np.empty(len(first), np.float32)
    for i in range(0, len(first), batch):
        index, mask = _steps(first[i: i + batch], length[i: i + batch], inv, len(uniq))
        out[i: i + batch] = forward(m, proj, index, mask)
    return out


def score_block(m: dict, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of every text of a block."""
    low, s, e, bounds = tokens(buf, ends)
    h = T.span_hash(low, s, e)
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    pos = np.minimum(np.searchsorted(m["keys"], uniq), max(len(m["keys"]) - 1, 0))
    wid = np.where(m["keys"][pos] == uniq, m["ids"][pos], 0) if len(m["keys"]) else np.zeros(len(uniq), np.int64)
    gram, gb = grams(low, s[at], e[at])
    first, length, wb = windows(bounds)
    logit = _logits(m, uniq, wid, gram, gb, inv, first, length)
    return _sigmoid(summaries(logit, wb) @ m["curve"][:-1] + m["curve"][-1])


# ---- Spark ----------------------------------------------------------------------

def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(t, y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    if any(t for t, _ in got):
        out = io.BytesIO()
        np.savez(out, **train([t for t, _ in got], np.array([y for _, y in got])))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES,
        text_col: str = "text") -> dict | None:
    """Train on at most ``rows`` labelled documents of up to ``text_bytes`` bytes; None when there are none."""
    sample = label_sample(labels, label, rows)
    d = docs.select(F.col("doc_id").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    d = d.where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= text_bytes)
    got = d.join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).select("doc_id", "_text", "_label")
    got = got.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "_text").limit(rows).select("_text", "_label")
    model = got.coalesce(1).mapInArrow(_trainer, "model binary").first()
    if model is None:
        return None
    with np.load(io.BytesIO(model[0])) as arrays:
        return dict(arrays)


def _scorer(model: dict | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, ends in T.blocks(batch.column(1), 1 << 20):
                score = score_block(model, buf, ends) if model else np.zeros(len(ends))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ends)), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])
    return run


def score(docs: DataFrame, model: dict | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = x.mapInArrow(_scorer(model, threshold), "doc_id long, score double, predicted int")
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: dict | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns, in the same pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, ends in T.blocks(batch.column(at), 1 << 20):
                part = batch.slice(first, len(ends))
                yield part.filter(pa.array(score_block(model, buf, ends) < threshold)) if model else part
    return docs.mapInArrow(run, docs.schema)
