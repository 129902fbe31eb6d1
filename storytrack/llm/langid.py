"""Hierarchical language identification.

A softmax classifier over hashed character 1- to 3-grams first names the language family;
inside it, one linear support vector machine per pair of languages votes, so that closely
related languages are told apart by what separates just the two of them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import fit_in_task, fold, fresh, replace_columns, ship, table, trim_memory

UNDETERMINED = "und"
BUCKETS = 4096
# Bound of the training sample: about this many documents of each language.
TRAIN_PER_LANGUAGE = 1500
MIN_SCORE = 0.25
TEXTS_AT_ONCE = 500  # texts in a batch that goes to Python, where the caller runs the job
PIECE = 1 << 20  # characters that are counted at a time
# Fixed table: families of languages by ISO 639-1 code; codes not named here are one family, "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn pa gu mr ne or ur sd",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "sinitic": "zh", "japonic": "ja", "koreanic": "ko", "hellenic": "el", "celtic": "ga cy br gd",
    "austronesian": "id ms tl jv", "austroasiatic": "vi km", "tai": "th lo",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTERS = None


def _letter_table() -> np.ndarray:
    """Code points below 65536: themselves if letters, else a space."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([c if chr(c).isalpha() else 32 for c in range(65536)], dtype=np.uint32)
    return _LETTERS


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed character 1-, 2- and 3-grams; unit length."""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[max(0, at - 2):at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = code < 65536
        code = np.where(low, _letter_table()[np.where(low, code, 32)], code)
        code = code * np.uint32(2654435761)
        for n in (1, 2, 3):
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ code[i:len(code) - n + 1 + i]) * np.uint32(2246822519)
                h ^= h >> np.uint32(15)
            skip = min(2, at) - (n - 1) if at else 0  # n-grams that the piece before has counted
            counts += np.bincount(h[max(0, skip):] >> np.uint32(20), minlength=BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, rng) -> np.ndarray:
    w = np.zeros((classes, x.shape[1] + 1), np.float32)
    for epoch in range(12):
        rate = 8.0 / (1 + epoch)
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            z = x[at] @ w[:, :-1].T + w[:, -1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            w[:, :-1] -= rate * (p.T @ x[at] / len(at) + 1e-5 * w[:, :-1])
            w[:, -1] -= rate * p.mean(0)
    return w


def _svm_fit(x: np.ndarray, own: np.ndarray, sign: np.ndarray, rng, reg: float = 1e-4) -> np.ndarray:
    """Linear support vector machine (hinge loss, averaged mini-batch subgradients) of the rows ``own`` of ``x``."""
    w, mean, steps = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float64), 0
    for epoch in range(12):
        for at in np.array_split(rng.permutation(len(own)), max(1, len(own) // 64)):
            rate = 4.0 / (1 + steps / 200)
            miss = at[sign[at] * (x[own[at]] @ w[:-1] + w[-1]) < 1]
            w *= 1 - rate * reg
            w[:-1] += rate / len(at) * (sign[miss] @ x[own[miss]])
            w[-1] += rate / len(at) * sign[miss].sum()
            steps += 1
            if epoch >= 6:
                mean += w
    return (mean / max(1, steps - steps // 2)).astype(np.float32) if steps > 1 else w


class Model:
    """Family weights, and for each family its languages and a machine for each pair of them."""

    def __init__(self, languages: list[str], x: np.ndarray, lang: np.ndarray):
        rng = np.random.default_rng(0)
        self.families = sorted({FAMILY_OF.get(c, "other") for c in languages})
        self.members = [[c for c in languages if FAMILY_OF.get(c, "other") == f] for f in self.families]
        family = np.array([self.families.index(FAMILY_OF.get(c, "other")) for c in lang])
        self.w = _softmax_fit(x, family, len(self.families), rng)
        self.pairs = {}
        for langs in self.members:
            for a, b in combinations(langs, 2):
                own = np.flatnonzero((lang == a) | (lang == b))
                self.pairs[a, b] = _svm_fit(x, own, np.where(lang[own] == a, 1, -1).astype(np.float32), rng)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        z = self.w[:, :-1] @ x + self.w[:, -1]
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        langs = self.members[best]
        votes = {c: [0, 0.0] for c in langs}
        margin = {}
        for a, b in combinations(langs, 2):
            w = self.pairs[a, b]
            m = float(w[:-1] @ x + w[-1])
            margin[a, b], margin[b, a] = m, -m
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        won = max(langs, key=lambda c: (votes[c], c))
        sure = [1 / (1 + np.exp(-3 * margin[won, c])) for c in langs if c != won]
        return won, float(p[best] * min(sure, default=1.0))


def _train(frames) -> bytes:
    import pickle

    x, lang = np.empty((0, BUCKETS), np.float32), []
    for pdf in frames:
        for text, code in zip(pdf["text"], pdf["lang"], strict=True):
            if len(lang) == len(x):  # the rows are held once: the array grows where it is
                x.resize((len(x) + 512, BUCKETS), refcheck=False)
            x[len(lang)] = features(text)
            lang.append(code)
    out = io.BytesIO()
    if lang:
        pickle.dump(Model(sorted(set(lang)), x[:len(lang)], np.array(lang)), out)
    return out.getvalue()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = TRAIN_PER_LANGUAGE) -> bytes:
    """Model learnt from about ``per_language`` labelled documents of each language.

    The documents are those with the smallest hashes of their ids. Null and empty texts and
    null labels teach nothing; without any labelled text the model is empty and every
    document is undetermined.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return b""
    share = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    return fit_in_task(known.filter(place < share[F.col("lang")]).withColumn("_place", F.xxhash64("doc_id")),
                       _train, ["_place", "text", "lang"])


def detect(spark: SparkSession, text: Column, model: bytes) -> Column:
    """Struct (lang_pred, score) of a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pickle
        trim_memory()
        known = pickle.loads(shared.value) if shared.value else None
        for texts in batches:
            rows = []
            for t in texts:
                if known is None or t is None or not any(map(str.isalpha, t)):
                    rows.append((UNDETERMINED, 0.0))
                else:
                    rows.append(known.predict(features(t)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])
        trim_memory()

    return run(text)


def identify(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced).

    A null text, or one without letters, is 'und' with score 0. Only the text is read.
    Repeated rows get equal answers; an empty table stays empty.
    """
    own = fresh(docs, "_lid")
    found = docs.withColumn(own, detect(docs.sparkSession, F.col(text_col), model))
    return replace_columns(found, lang_pred=F.col(own)["lang_pred"], score=F.col(own)["score"]).drop(own)


def reject_undetermined(docs: DataFrame, model: bytes, text_col: str = "text",
                        min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that are 'und' or score under ``min_score``; columns as they were."""
    own = fresh(docs, "_lid")
    found = docs.withColumn(own, detect(docs.sparkSession, F.col(text_col), model))
    return found.filter((F.col(own)["lang_pred"] != UNDETERMINED) & (F.col(own)["score"] >= min_score)).drop(own)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
