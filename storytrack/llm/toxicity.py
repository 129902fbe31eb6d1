"""Toxicity scorer: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network twice: as its own embedding (words frequent enough in the
training sample) and as the embeddings of its hashed character n-grams. A text is cut into
overlapping windows of words; its score is that of its most toxic window. Training is
multiple-instance: of every text, the window that scores highest carries the label.
"""

from __future__ import annotations

import io
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import fit_in_task, fold, fresh, labelled_sample, replace_columns, ship, table

# Bound of the training sample, in labelled documents, and passes over it.
TRAIN_DOCS = 4_000
EPOCHS = 6
THRESHOLD = 0.7
WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN = 8, 12, 8
MIN_COUNT, MAX_WORDS = 8, 20_000
NGRAM_BUCKETS = 1 << 15
PREFIXES = (6, 8)  # bytes, with the mark of the start
PREFIX_WEIGHT = 3  # times that a prefix counts: it is one of many n-grams of its word
MAX_CHARS = 24  # of a word's start that its n-grams cover; longer words are cut into words of this length
CACHE_WORDS = 150_000
BATCH = 2048
PIECE = 1 << 18  # words of a text that are in memory at a time

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    words = WORD.findall((text or "").lower())
    if any(len(w) > MAX_CHARS for w in words):
        words = [w[i:i + MAX_CHARS] for w in words for i in range(0, len(w), MAX_CHARS)]
    return words


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' byte 3- and 4-grams between marks of start and end, and of their
    first ``PREFIXES`` bytes, and their words' places, ascending."""
    marked = [f"^{w}$$".encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words)), size)
    byte = np.frombuffer(b"".join(marked) + bytes(max(PREFIXES)), np.uint8).astype(np.uint32)

    def hashed(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint32)
        for i in range(n):
            h = (h ^ byte[at + i]) * np.uint32(2246822519)
            h ^= h >> np.uint32(13)
        return (h % NGRAM_BUCKETS).astype(np.int64)

    every, starts = np.arange(len(owner)), np.cumsum(size) - size
    left = np.repeat(starts + size, size) - every  # bytes to the word's end
    grams, owners = [], []
    for n, at in [(3, every[left >= 3]), (4, every[left >= 4]), *[(n, starts[size >= n]) for n in PREFIXES * PREFIX_WEIGHT]]:
        grams.append(hashed(at, n))
        owners.append(owner[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], owner[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters ``p`` by name; all float32."""

    def __init__(self, vocabulary: dict[str, int], params: dict[str, np.ndarray] | None = None):
        self.vocabulary = vocabulary
        if params is None:
            rng = np.random.default_rng(7)
            dim = WORD_DIM + CHAR_DIM
            draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
            params = {"word": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)),
                      "char": rng.normal(0, 0.1, (NGRAM_BUCKETS, CHAR_DIM))}
            for d in "fb":
                params |= {f"W{d}": draw(dim, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN),
                           f"b{d}": np.zeros(3 * HIDDEN)}
            params |= {"att": draw(2 * HIDDEN, 2 * HIDDEN), "att_v": draw(2 * HIDDEN), "out": draw(2 * HIDDEN),
                       "bias": np.zeros(1)}
            params["word"][0] = 0
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in params.items()}

    # -- words ---------------------------------------------------------------------------
    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, all n-gram buckets and the word that each bucket belongs to."""
        return (np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words)), *_ngrams(words))

    def inputs(self, rows, grams, owner) -> np.ndarray:
        n = np.bincount(owner, minlength=len(rows)).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        chars = np.add.reduceat(self.p["char"][grams], starts, axis=0) / np.sqrt(n)[:, None]
        return np.concatenate([self.p["word"][rows], chars], axis=1)

    # -- windows -------------------------------------------------------------------------
    def _run(self, gates: np.ndarray, u: np.ndarray, live: np.ndarray, keep: bool):
        """One direction over [time, batch, 3h] gate inputs; all states, and what backward needs."""
        steps, n, _ = gates.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out, saved = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            zr = _sigmoid(gates[t, :, :2 * HIDDEN] + h @ u[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            c = np.tanh(gates[t, :, 2 * HIDDEN:] + rh @ u[:, 2 * HIDDEN:])
            new = c + z * (h - c)
            if live is not None:
                new = np.where(live[t][:, None], new, h)
            if keep:
                saved.append((h, z, r, rh, c))
            out[t] = h = new
        return out, saved

    def forward(self, proj: dict[str, np.ndarray], ids: np.ndarray, live: np.ndarray, keep: bool = False):
        """Scores (logits) of windows [batch, time] of rows of ``proj``, the words' gate inputs."""
        ids, live = ids.T, live.T
        every = None if live.all() else live
        ahead, sf = self._run(proj["f"][ids], self.p["Uf"], every, keep)
        back, sb = self._run(proj["b"][ids[::-1]], self.p["Ub"], None if every is None else live[::-1], keep)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        a = np.tanh(states @ self.p["att"])
        e = np.where(live, a @ self.p["att_v"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbd->bd", w, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (ids, live, states, a, w, pooled, sf, sb)) if keep else logits

    def _back_run(self, d_out, saved, u, live, proj_shape):
        """Gradients of one direction: of its gate inputs and of its recurrent weights."""
        d_gates, d_u = np.empty(proj_shape, np.float32), np.zeros_like(u)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(saved) - 1, -1, -1):
            h, z, r, rh, c = saved[t]
            d_new = d_h + d_out[t]
            on = live[t][:, None]
            d = np.where(on, d_new, 0)
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (h - c) * z * (1 - z)
            d_rh = d_c @ u[:, 2 * HIDDEN:].T
            d_r = d_rh * h * r * (1 - r)
            zr = np.concatenate([d_z, d_r], axis=1)
            d_gates[t] = np.concatenate([zr, d_c], axis=1)
            d_u[:, :2 * HIDDEN] += h.T @ zr
            d_u[:, 2 * HIDDEN:] += rh.T @ d_c
            d_h = np.where(on, d * z + d_rh * r + zr @ u[:, :2 * HIDDEN].T, d_new)
        return d_gates, d_u

    def gradients(self, words, x, proj, ids, live, y) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss; ``words`` is what :meth:`lookup` gave for ``x``'s rows."""
        logits, (idt, lv, states, a, w, pooled, sf, sb) = self.forward(proj, ids, live, keep=True)
        g = (_sigmoid(logits) - y) / len(y)
        out = {"out": pooled.T @ g, "bias": np.array([g.sum()], np.float32)}
        d_pooled = g[:, None] * self.p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("bd,tbd->tb", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(0))
        out["att_v"] = np.einsum("tb,tbd->d", d_e, a)
        d_a = d_e[:, :, None] * self.p["att_v"] * (1 - a * a)
        out["att"] = np.einsum("tbi,tbj->ij", states, d_a)
        d_states = d_states + d_a @ self.p["att"].T
        d_x = np.zeros_like(x)
        for d, rows, part, saved, on in (("f", idt, d_states[:, :, :HIDDEN], sf, lv),
                                         ("b", idt[::-1], d_states[::-1, :, HIDDEN:], sb, lv[::-1])):
            d_gates, out[f"U{d}"] = self._back_run(part, saved, self.p[f"U{d}"], on, (*rows.shape, 3 * HIDDEN))
            d_proj = np.zeros_like(proj[d])
            np.add.at(d_proj, rows[on], d_gates[on])
            out[f"b{d}"] = d_proj.sum(0)
            out[f"W{d}"] = x.T @ d_proj
            d_x += d_proj @ self.p[f"W{d}"].T
        rows, grams, owner = words
        out["word"] = np.zeros_like(self.p["word"])
        np.add.at(out["word"], rows, d_x[:, :WORD_DIM])
        out["word"][0] = 0
        n = np.sqrt(np.bincount(owner, minlength=len(rows)))[:, None]
        out["char"] = np.zeros_like(self.p["char"])
        np.add.at(out["char"], grams, (d_x[:, WORD_DIM:] / n)[owner])
        return out

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words; together they cover every word, each overlaps the next."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else np.zeros(0, np.int64)


def _cut(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = starts[:, None] + np.arange(WINDOW)
    live = at < len(ids)
    return ids[np.where(live, at, 0)], live


def _train(frames) -> bytes:
    texts, labels = [], []
    for pdf in frames:
        for t, y in zip(pdf["text"], pdf["label"], strict=True):
            if words := words_of(t):
                texts.append(words)
                labels.append(float(y))
    out = io.BytesIO()
    if not texts:
        return b""
    count: dict[str, int] = {}
    for words in texts:
        for w in words:
            count[w] = count.get(w, 0) + 1
    often = sorted((w for w, n in count.items() if n >= MIN_COUNT), key=lambda w: (-count[w], w))[:MAX_WORDS]
    net = Network({w: i + 1 for i, w in enumerate(often)})
    every = {w: i for i, w in enumerate(sorted(count))}
    looked = net.lookup(list(every))
    cuts = [_cut(np.array([every[w] for w in words]), windows(len(words))) for words in texts]
    ids, live = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
    first = np.concatenate([[0], np.cumsum([len(c[0]) for c in cuts])[:-1]])
    n_of, y = np.array([len(c[0]) for c in cuts]), np.array(labels, np.float32)
    rng = np.random.default_rng(3)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, gram_start = 0, np.concatenate([[0], np.cumsum(np.bincount(looked[2], minlength=len(every)))])
    positive, negative = np.where(y == 1)[0], np.where(y == 0)[0]
    for epoch in range(EPOCHS):
        if epoch == 0:  # any window of a text stands for it
            chosen = first + (rng.random(len(first)) * n_of).astype(np.int64)
        else:  # the highest one, for clean texts one time in two any
            proj = net.project(net.inputs(*looked))
            s = np.concatenate([net.forward(proj, ids[i:i + BATCH], live[i:i + BATCH])
                                for i in range(0, len(ids), BATCH)])
            top = np.array([f + s[f:f + n].argmax() for f, n in zip(first, n_of, strict=True)])
            other = first + (rng.random(len(first)) * n_of).astype(np.int64)
            chosen = np.where((y == 1) | (rng.random(len(y)) < 0.5), top, other)
        # each class makes up about half of what a pass sees
        again = max(1, min(8, len(negative) // max(1, len(positive))))
        order = rng.permutation(np.concatenate([np.repeat(positive, again), negative]))
        for some in np.array_split(order, max(1, len(order) // 64)):
            b_ids, b_live = ids[chosen[some]], live[chosen[some]]
            used, inverse = np.unique(b_ids, return_inverse=True)
            picks = np.concatenate([np.arange(gram_start[i], gram_start[i + 1]) for i in used])
            # Words are known by their characters alone one time in two: own embeddings learn texts by heart.
            words = (np.where(rng.random(len(used)) < 0.5, looked[0][used], 0), looked[1][picks],
                     np.repeat(np.arange(len(used)), np.diff(gram_start)[used]))
            x = net.inputs(*words)
            grads = net.gradients(words, x, net.project(x), inverse.reshape(b_ids.shape), b_live, y[some])
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
    np.savez(out, _words=np.array(often or [""], dtype=np.str_), **net.p)
    return out.getvalue()


class Scorer:
    """A network with a bounded cache of the gate inputs of the words it has met."""

    def __init__(self, model: bytes):
        held = dict(np.load(io.BytesIO(model)))
        self.net = Network({w: i + 1 for i, w in enumerate(held.pop("_words").tolist())}, held)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.proj = {d: np.empty((CACHE_WORDS, 3 * HIDDEN), np.float32) for d in "fb"}

    def _ids(self, words: list[str]) -> np.ndarray:
        rows = list(map(self.known.get, words))
        new = list(dict.fromkeys(w for w, r in zip(words, rows, strict=True) if r is None))
        if len(self.known) + len(new) > CACHE_WORDS:
            self._clear()
            new = list(dict.fromkeys(words))
            if len(new) > CACHE_WORDS:  # one batch has more words than the cache
                self.proj = {d: np.empty((len(new), 3 * HIDDEN), np.float32) for d in "fb"}
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            base = len(self.known)
            for d, rows_of in self.net.project(self.net.inputs(*self.net.lookup(part))).items():
                self.proj[d][base:base + len(part)] = rows_of
            self.known.update(zip(part, range(base, base + len(part)), strict=True))
        return np.array(list(map(self.known.__getitem__, words)) if new else rows, np.int64)

    def _batch(self, texts: list[list[str]]) -> np.ndarray:
        """Scores (logits) of texts that are held together; a text without words scores -20."""
        out = np.full(len(texts), -20.0)
        some = [i for i, w in enumerate(texts) if w]
        if not some:
            return out
        ids = self._ids([w for i in some for w in texts[i]])
        cuts, at = [], 0
        for i in some:
            cuts.append(_cut(ids[at:at + len(texts[i])], windows(len(texts[i]))))
            at += len(texts[i])
        w_ids, live = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
        order = np.argsort(live.all(1), kind="stable")  # full windows together: they need no masks
        s = np.empty(len(w_ids))
        for i in range(0, len(order), BATCH):
            o = order[i:i + BATCH]
            s[o] = self.net.forward(self.proj, w_ids[o], live[o])
        out[some] = np.maximum.reduceat(s, np.concatenate([[0], np.cumsum([len(c[0]) for c in cuts])[:-1]]))
        return out

    def scores(self, texts) -> np.ndarray:
        """Probabilities for texts of any length, at most about PIECE words in memory at a time."""
        out, held, places, n = np.full(len(texts), -20.0), [], [], 0

        def flush():
            if held:
                np.maximum.at(out, places, self._batch(held))
                held.clear()
                places.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            for at in range(0, max(1, len(words)), PIECE // WINDOW * STRIDE):
                part = words[at:at + PIECE // WINDOW * STRIDE + WINDOW - STRIDE]
                held.append(part)
                places.append(i)
                n += len(part)
                if n >= PIECE:
                    flush()
                    n = 0
        flush()
        return _sigmoid(out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "label", train_docs: int = TRAIN_DOCS) -> bytes:
    """Network trained on the ``train_docs`` labels (id, 0/1) with the smallest id hashes.

    Null labels, ids without a document and texts without words teach nothing; without any
    labelled text the model is empty and every score is 0.5.
    """
    return fit_in_task(labelled_sample(docs, labels, id_col, text_col, label_col, train_docs), _train,
                       ["_place", "text", "label"])


def toxicity_score(spark: SparkSession, text: Column, model: bytes) -> Column:
    """Probability that a text is toxic: that of its most toxic window."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not shared.value:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(_scorer(shared.value).scores(texts.tolist()))

    return run(text)


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: bytes) -> Scorer:
    """The worker's scorer of a model; the last one is kept."""
    key = zlib.crc32(model)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def score_toxicity(docs: DataFrame, model: bytes, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (columns of these names are replaced).

    Every whole text is scored over all its windows; null or empty texts score near 0;
    repeated rows score alike.
    """
    own = fresh(docs, "_s")
    scored = docs.withColumn(own, toxicity_score(docs.sparkSession, F.col(text_col), model))
    return replace_columns(scored, score=F.col(own), predicted=(F.col(own) >= threshold).cast("int")).drop(own)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
