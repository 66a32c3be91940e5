"""Missing or wrong document language labels, by document and by stretch (problem 10)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.shared import spread

# Three-letter codes and their two-letter codes.
ISO3 = {
    "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "rus": "ru",
}
#: Labelled documents the classifier is fitted on at most; taken by the smallest hashes of their ids.
FIT_DOCUMENTS = 3500
BUCKETS, DIMENSION, EPOCHS, SEED = 1 << 15, 16, 3, 11
#: Words a unit needs to be judged by itself; shorter ones take the language of their neighbours.
LEAST_WORDS = 4
#: Mean probability that a stretch of a mixed text must have.
LEAST_STRETCH = 0.93

_SPLIT = re.compile(r"\n+|(?<=[.!?…])[\"'»”)\]]*\s+(?=\S)")
_HEAD = re.compile(r"^\s*(?:\[?\d{4}-\d{2}-\d{2}[^-]{0,14}- [^:]{1,30}:|(?:>|[-*•]|\(?\d{1,3}[.)])\s)\s*")
_ENDED = re.compile(r"[.!?…:][\"'»”)\]]*\s*$")
_URL = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def code_of_label(column) -> "F.Column":
    """Two-letter code of a label as written (`en-US`, `EN`, `eng`); null for null, empty and `und`."""
    c = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    iso3 = F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])
    return F.when((c == "") | (c == "und"), None).when(F.length(c) == 3, F.element_at(iso3, c)).otherwise(c)


def units_of(text: str) -> list[str]:
    """Sentences and lines of a text without list marks, chat heads, links and addresses."""
    lines: list[str] = []
    for line in text.split("\n"):
        quoted = line.startswith(">")
        bare = _HEAD.sub("", line, count=1)
        marked = bare != line and not quoted
        # a line that was only wrapped goes on with the line before
        if lines and bare.strip() and not marked and lines[-1].strip() and (quoted or not _ENDED.search(lines[-1])):
            lines[-1] += " " + bare
        else:
            lines.append(bare)
    return [u for line in lines for u in _SPLIT.split(_URL.sub(" ", line)) if u and u.strip()]


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def telling_words(unit: str) -> list[str]:
    """Words of a unit that can tell its language: capitalised words inside it (names) are left out.

    Units that are mostly capitalised (headlines, shouting) keep all words.
    """
    words = _WORD.findall(unit)
    rest = words[:1] + [w for w in words[1:] if not w[0].isupper()]
    return [w.lower() for w in (rest if 2 * len(rest) >= len(words) and len(rest) >= 3 else words)]


def subword_ids(units: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (1 to 4, with word boundaries) of all units at once.

    Returns the bucket ids, unit after unit, and the offset at which each unit begins.
    """
    text = "\x00".join(" " + " ".join(telling_words(u)) + " " for u in units) + "\x00"
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    unit = np.concatenate(([0], np.cumsum(c == 0)[:-1]))
    ids, owners = [], []
    h = np.zeros(len(c), dtype=np.uint64)
    dead = np.zeros(len(c), dtype=bool)
    for n in range(1, 5):
        shifted = np.concatenate((c[n - 1 :], np.zeros(min(n - 1, len(c)), dtype=np.uint64)))[: len(c)]
        dead |= shifted == 0
        if n > 2:  # an n-gram does not run over a space in its middle
            middle = np.concatenate((c[n - 2 :], np.zeros(min(n - 2, len(c)), dtype=np.uint64)))[: len(c)]
            dead |= middle == 32
        h = h * np.uint64(0x9E3779B97F4A7C15) + shifted
        keep = ~dead if n > 1 else ~dead & (c != 32)
        x = h[keep] + np.uint64(n)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ids.append((x % np.uint64(buckets)).astype(np.int64))
        owners.append(unit[keep])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.searchsorted(owners[order], np.arange(len(units)))


@dataclass
class LanguageModel:
    """Averaged subword embeddings and a linear softmax, folded into one table of logits per bucket."""

    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5  # the calibrated least probability of an accepted unit

    def probabilities(self, units: list[str]) -> np.ndarray:
        n = len(self.languages)
        if not units or not n:
            return np.zeros((len(units), n))
        ids, at = subword_ids(units)
        counts = np.diff(np.append(at, len(ids)))
        out = np.tile(self.bias, (len(units), 1)).astype(np.float64)
        full = counts > 0
        if full.any():
            sums = np.add.reduceat(self.table[ids], at[full], axis=0)
            out[full] += sums / counts[full, None]
        out /= self.temperature
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
        out[~full] = 1.0 / n
        return out


def _sgd(units: list[str], y: np.ndarray, n: int, rng: np.random.Generator, epochs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, at = subword_ids(units)
    ends = np.append(at[1:], len(ids))
    E = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    W = rng.normal(0, 0.1, (DIMENSION, n)).astype(np.float32)
    b = np.zeros(n, dtype=np.float32)
    weight = (len(y) / n / np.maximum(np.bincount(y, minlength=n), 1))[y]
    steps, batch = 0, 256
    total = epochs * (len(y) // batch + 1)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            rows = rows[ends[rows] > at[rows]]
            if not len(rows):
                continue
            rate = 1.0 * (1 - steps / total)
            steps += 1
            sizes = ends[rows] - at[rows]
            owner = np.repeat(np.arange(len(rows)), sizes)
            flat = ids[np.repeat(at[rows], sizes) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            x = np.add.reduceat(E[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            z = x @ W + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p * np.minimum(weight[rows], 5)[:, None] / len(rows)
            gx = (g @ W.T) / sizes[:, None]
            W -= 10 * rate * (x.T @ g)
            b -= rate * g.sum(axis=0)
            step = -200 * rate * gx
            for k in range(DIMENSION):  # the gradient of a bucket is the sum over its n-grams
                E[:, k] += np.bincount(flat, weights=step[owner, k], minlength=BUCKETS).astype(np.float32)
    return E, W, b


def fit(samples: pd.DataFrame, seed: int = SEED) -> LanguageModel:
    """Fit on documents with columns ``text`` and ``code`` (labels may be wrong for some).

    Two rounds: units that the first round's model is sure are of another language than their
    document's label (wrong labels, foreign stretches) are left out of the second. A tenth of the
    units is held out to calibrate temperature and the threshold of rejection.
    """
    rng = np.random.default_rng(seed)
    units, codes = [], []
    for text, code in zip(samples["text"], samples["code"]):
        own = [u for u in units_of(text) if len(_WORD.findall(u)) >= LEAST_WORDS]
        own = [own[i] for i in sorted(rng.permutation(len(own))[:8])]
        units += own
        codes += [code] * len(own)
    languages = sorted(set(codes))
    if not units:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    index = {c: i for i, c in enumerate(languages)}
    y = np.array([index[c] for c in codes])
    bare = rng.random(len(units)) < 0.3  # texts that lost their accents
    units = [_plain(u) if s else u for u, s in zip(units, bare)]
    held = rng.random(len(units)) < 0.1
    keep = np.ones(len(units), dtype=bool)
    model = None
    for epochs in (2, EPOCHS):
        rows = np.flatnonzero(keep & ~held)
        E, W, b = _sgd([units[i] for i in rows], y[rows], len(languages), rng, epochs)
        model = LanguageModel(languages, (E.astype(np.float64) @ W).astype(np.float32), b)
        p = model.probabilities(units)
        keep = ~((p.argmax(axis=1) != y) & (p.max(axis=1) > 0.6))
    test = np.flatnonzero(held & keep)
    if len(test):
        logits = np.log(model.probabilities([units[i] for i in test]) + 1e-12)

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            return float(-np.log(q[np.arange(len(test)), y[test]] + 1e-12).mean())

        model.temperature = min((0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
        p = model.probabilities([units[i] for i in test])
        right = p.argmax(axis=1) == y[test]
        # accept what keeps 99.5 % of the right ones
        model.threshold = float(min(0.6, np.quantile(p.max(axis=1)[right], 0.005))) if right.any() else 0.5
    return model


def stretches(units: list[str], p: np.ndarray, model: LanguageModel, switch: float = 8.0) -> list[tuple[int, float, int, int]]:
    """``(language, confidence, first unit, last unit)`` of the longest one-language stretches.

    The best path over the units' probabilities with a price for every change of language; units
    of few words and units the model rejects carry no evidence and go with their neighbours.
    """
    if not model.languages:
        return []
    n_words = np.array([len(_WORD.findall(u)) for u in units])
    sure = (n_words >= LEAST_WORDS) & (p.max(axis=1, initial=0) >= model.threshold)
    if not sure.any():
        # a text of few words: take them together
        if n_words.sum() >= 2:
            whole = model.probabilities([" ".join(units)])[0]
            if whole.max() >= max(0.8, model.threshold):
                return [(int(whole.argmax()), float(whole.max()), 0, len(units) - 1)]
        return []
    rows = np.flatnonzero(sure)
    score = np.log(np.maximum(p[rows], 1e-6)) * np.minimum(n_words[rows], 10)[:, None] / 5
    best, back = score[0], []
    for s in score[1:]:
        top = int(best.argmax())
        change = best[top] - switch
        back.append(np.where(best >= change, np.arange(len(best)), top))
        best = np.maximum(best, change) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out: list[list] = []
    for k, lang in enumerate(path):
        i = int(rows[k])
        if out and out[-1][0] == lang:
            out[-1][3], _ = i, out[-1][1].append(float(p[i, lang]))
        else:
            out.append([lang, [float(p[i, lang])], i, i])
    # A stretch that the model is not sure of goes with the surer of its neighbours.
    while len(out) > 1 and min(np.mean(s[1]) for s in out) < LEAST_STRETCH:
        k = min(range(len(out)), key=lambda i: np.mean(out[i][1]))
        sides = [i for i in (k - 1, k + 1) if 0 <= i < len(out)]
        into = max(sides, key=lambda i: np.mean(out[i][1]))
        out[into][2], out[into][3] = min(out[into][2], out[k][2]), max(out[into][3], out[k][3])
        del out[k]
        merged: list[list] = []
        for s in out:
            if merged and merged[-1][0] == s[0]:
                merged[-1][1] += s[1]
                merged[-1][3] = s[3]
            else:
                merged.append(s)
        out = merged
    return [(lang, float(np.mean(c)), a, b) for lang, c, a, b in out]


_SCHEMA = "doc_id bigint, label string, n_segments int, seg_no bigint, lang string, confidence double"


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document and one-language stretch: ``doc_id, label, n_segments, seg_no, lang, confidence``.

    ``label`` is the two-letter code of the given label or null. Whole texts are read. Null and
    empty texts, and texts without words of any language, yield no row. Repeated ``doc_id`` values
    are judged row by row. Only ``doc_id``, ``text`` and ``lang`` are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                texts = [units_of(t) for t in part["text"]]
                p = m.probabilities([u for us in texts for u in us])
                out, at = [], 0
                for doc, label, us in zip(part["doc_id"], part["label"], texts):
                    found = stretches(us, p[at : at + len(us)], m) if us else []
                    at += len(us)
                    out += [(doc, label, len(found), k, m.languages[lang], conf) for k, (lang, conf, _, _) in enumerate(found, 1)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    rows = spread(documents.select("doc_id", "text", "lang")).where("text is not null and text <> ''").select("doc_id", "text", code_of_label(F.col("lang")).alias("label"))
    return rows.mapInPandas(judge, _SCHEMA)


def fit_on(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> LanguageModel:
    """Fit on at most ``fit_documents`` labelled documents, those with the smallest hashes of their ids."""
    labelled = documents.select("doc_id", "text", code_of_label(F.col("lang")).alias("code"))
    labelled = labelled.where("code is not null and length(text) >= 40").select("doc_id", "code", "text")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    return fit(sample.toPandas().sort_values("doc_id"))


def relabel(documents: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Documents whose label is missing or wrong, and all stretches of documents of several languages."""
    model = model or fit_on(documents)
    found = identify(documents, model)
    return found.where((F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang")))
