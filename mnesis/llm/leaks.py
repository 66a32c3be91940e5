"""Evaluation passages inside training documents, found by spaced seeds (problem 9)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.shared import materialise, parallelism, spread

#: Fixed masks over neighbouring tokens; a zero ignores its position, so one altered word between two
#: kept ones does not hide a passage.
MASKS = ("11101", "110101", "1011001")
#: Bits of the filter that spares the join windows no test passage has. Its size is fixed (2 MB), however many
#: passages there are; a full filter spares nothing and loses nothing.
FILTER_BITS = 24
#: Positions of one masked window in test passages that stand in one row of the index; more go to further rows.
POSTINGS = 64
LEAST_WORDS, LEAST_SHARE = 20, 1 / 3
COST, LEAST_EQUAL = 3.0, 0.88
#: The hits of a stretch lie on diagonals of two neighbouring bands, at this share of the needed words at least. One
#: with a word in eight altered has a hit at more than every second place; shared phrases about other facts are
#: scattered over many diagonals and stay far below.
BAND, LEAST_HIT_SHARE = 16, 0.4
LEAST_HITS = int(np.ceil(LEAST_HIT_SHARE * LEAST_WORDS))

_TOKEN = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[>\s]*(?=[^\W\d_])")
_HEAD = re.compile(
    r"^[ \t]*(?:(?:\[?\d{4}-\d{2}-\d{2},? \d{1,2}(?: h |[:h])\d{2}[^-:\n]{0,6}\]? ?-? ?[^:\n]{1,30}:|>+|[-*•–|#]+|\(?\d{1,3}[.)])[ \t]+)+", re.MULTILINE
)
_SPACED = re.compile(r"(?<!\S)(?:[^\W_] ){4,}[^\W_](?!\S)")
_INVISIBLE = {ord(c): None for c in "\u00ad\u200b\u2060"}
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Words in lower case without accents, however the text is laid out.

    Line breaks, quote marks, list marks, runs of spaces, invisible signs and letters set apart by
    single spaces are layout.
    """
    s = text.translate(_INVISIBLE).lower()
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFKD", s))
    return _TOKEN.findall(s)


@lru_cache(maxsize=1 << 18)
def _code(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def _codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_code, words), dtype=np.uint64, count=len(words))


def _windows(codes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of each window of token codes under ``mask``."""
    n = max(0, len(codes) - len(mask) + 1)
    h = np.full(n, salt, dtype=np.uint64)
    for k, keep in enumerate(mask):
        if keep == "1":
            h = (h ^ codes[k : k + n]) * _PRIME
            h ^= h >> np.uint64(31)
    return h


def document_words(text: str) -> list[str]:
    """Tokens of a document without heads of chat lines, list marks, and breaks within words."""
    return tokens(_SPACED.sub(lambda m: m.group().replace(" ", ""), _HEAD.sub("", _BREAK.sub("", text))))


def test_windows(items: DataFrame) -> DataFrame:
    """``hash, postings``: the masked windows of the test passages with item, position and words needed."""
    schema = "hash bigint, item_id bigint, pos int, need int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                codes, n_words = _codes(tokens(text)), sum(bool(tokens(w)) for w in text.split())
                for salt, mask in enumerate(MASKS, 1):
                    h = _windows(codes, mask, salt)
                    need = max(LEAST_WORDS, int(np.ceil(n_words * LEAST_SHARE)))
                    parts.append(pd.DataFrame({"hash": h.view(np.int64), "item_id": item, "pos": np.arange(len(h), dtype=np.int32), "need": np.int32(need)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"hash": [], "item_id": [], "pos": [], "need": []})

    rows = items.mapInPandas(run, schema)
    # a phrase of many passages is spread over rows of a bounded number of postings
    part = F.pmod(F.xxhash64("item_id", F.floor(F.col("pos") / POSTINGS)), F.lit(1 << 20))
    return rows.groupBy("hash", part.alias("part")).agg(F.collect_list(F.struct("item_id", "pos", "need")).alias("postings")).select("hash", "postings")


def window_filter(windows: DataFrame) -> np.ndarray:
    """One bit for each value of the first ``FILTER_BITS`` bits of a hash: whether any test window has them."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = windows.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(%s as int))" % f"shiftrightunsigned(hash, {64 - FILTER_BITS}) % 64")).alias("bits"))
    got = bits.toPandas()  # at most 2 ** (FILTER_BITS - 6) rows
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def suspects(documents: DataFrame, known: np.ndarray) -> DataFrame:
    """``doc_id, words, hits``: documents with enough windows that pass the filter, their tokens and those windows.

    The tokens of a batch are hashed as one array. A stretch has ``LEAST_HITS`` places at least where
    a window is a test passage's, so documents with fewer places that pass are done.
    """
    shared = documents.sparkSession.sparkContext.broadcast(known)
    schema = "doc_id bigint, words string, hits array<struct<hash:bigint,at:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = shared.value
        for pdf in batches:
            words = [document_words(t) for t in pdf["text"]]
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(words)), sizes)
            codes = _codes([w for own in words for w in own])
            places, hashes = [], []
            for salt, mask in enumerate(MASKS, 1):
                h = _windows(codes, mask, salt)
                at = np.flatnonzero(seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                at = at[owner[at] == owner[at + len(mask) - 1]]
                places.append(at)
                hashes.append(h[at].view(np.int64))
            at, h = np.concatenate(places), np.concatenate(hashes)
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            n = np.bincount(owner[np.unique(at)], minlength=len(words)) if len(at) else np.zeros(len(words), int)
            rows = []
            for k in np.flatnonzero(n >= LEAST_HITS):
                lo, hi = np.searchsorted(at, (starts[k], starts[k] + sizes[k]))
                rows.append((pdf["doc_id"].iat[k], " ".join(words[k]), list(zip(h[lo:hi].tolist(), (at[lo:hi] - starts[k]).tolist()))))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "hits"])

    return documents.mapInPandas(run, schema)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of token ids: first and last item position, matches, altered item words.

    A match earns 1, a changed, lost or added word costs 3: passages with a few altered words hold
    together, while phrases that share their wording but report other facts fall apart at each fact.
    """
    n, m = len(doc), len(item)
    score = np.zeros((n + 1, m + 1))
    gain = np.where(doc[:, None] == item[None, :], 1.0, -COST)
    ramp = COST * np.arange(m + 1)
    for i in range(n):
        row = score[i + 1]
        np.add(score[i, :-1], gain[i], out=row[1:])
        np.maximum(row[1:], score[i, 1:] - COST, out=row[1:])
        np.maximum(row, 0, out=row)
        # lost item words: a running maximum along the row
        row += ramp
        np.maximum.accumulate(row, out=row)
        row -= ramp
    i, j = divmod(int(score.argmax()), m + 1)
    if score[i, j] <= 0:
        return 0, -1, 0, 0
    last, matches = j - 1, 0
    while score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + gain[i - 1, j - 1]:
            matches += int(gain[i - 1, j - 1] > 0)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - COST:
            i -= 1
        else:
            j -= 1
    return j, last, matches, last - j + 1 - matches


@lru_cache(maxsize=4096)
def _passage(text: str) -> tuple[np.ndarray, np.ndarray, dict[str, int], dict[str, set[str]], int]:
    """Token ids of a passage, the written word of each, ids by token, tokens by what lacks one letter, words needed."""
    written = [own for w in text.split() if (own := tokens(w))]
    item = [t for own in written for t in own]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(item), 1)}
    near: dict[str, set[str]] = {}
    for t in vocabulary:
        if len(t) >= 4 and not t.isdigit():
            for k in range(len(t)):
                near.setdefault(t[:k] + t[k + 1 :], set()).add(t)
    word_of = np.repeat(np.arange(len(written)), [len(own) for own in written])
    need = max(LEAST_WORDS, int(np.ceil(len(written) * LEAST_SHARE)))
    return np.array([vocabulary[t] for t in item], dtype=np.int64), word_of, vocabulary, near, need


def _mended(words: list[str], vocabulary: dict[str, int], near: dict[str, set[str]]) -> np.ndarray:
    """Ids of words; one that a slip of the keyboard changed stands for the only test word one letter from it."""
    ids = np.fromiter((vocabulary.get(t, 0) for t in words), dtype=np.int64, count=len(words))
    for k in np.flatnonzero(ids == 0):
        t = words[k]
        if len(t) >= 4 and not t.isdigit():
            cuts = [t[:c] + t[c + 1 :] for c in range(len(t))]
            options = set(near.get(t, ())).union(*(near.get(c, ()) for c in cuts), (c for c in cuts if c in vocabulary))
            if len(options) == 1:
                ids[k] = vocabulary[options.pop()]
    return ids


def verified(words: list[str], spans: list[tuple[int, int]], passage: str) -> tuple[int, float] | None:
    """Words covered and share of equal words of the best stretch around the hits, if it is long and alike enough."""
    own, word_of, vocabulary, near, need = _passage(passage)
    best, parts = None, []
    for lo, hi in sorted(spans):  # far-apart parts are aligned each for itself
        if parts and lo - parts[-1][1] <= len(own) + 40:
            parts[-1][1] = max(parts[-1][1], hi)
        else:
            parts.append([lo, hi])
    for lo, hi in parts:
        a, b, matches, _ = align(_mended(words[max(0, lo - 30) : hi + 40], vocabulary, near), own)
        if b >= a:
            span, share = len(np.unique(word_of[a : b + 1])), matches / (b - a + 1)
            if span >= need and share >= LEAST_EQUAL and (best is None or (span, share) > best):
                best = (span, share)
    return best


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words, share``: documents that carry one stretch of a test passage.

    The stretch covers at least a third of the passage's words and no fewer than 20, with a few
    words altered, lost or added, in any layout. Hashes of the masked windows of passages and
    documents are joined; hits on neighbouring diagonals are counted for each document and passage,
    and where there are enough of them the stretch is aligned. The corpus is scanned once, however
    many passages there are. Null and empty texts give no row; repeated documents and passages are
    reported for each copy's id once.
    """
    spark = documents.sparkSession
    passages = items.where("text is not null and item_id is not null").select("item_id", "text")
    windows = materialise(test_windows(passages), "test-windows")
    docs = spread(documents.select("doc_id", "text")).where("doc_id is not null and text is not null and text <> ''")
    found = suspects(docs, window_filter(windows)).withColumn("row", F.xxhash64("doc_id", "words"))
    found = materialise(found, "leak-suspects")
    hits = found.select("row", F.explode("hits").alias("h")).select("row", "h.hash", "h.at").join(windows, "hash").select("row", "at", F.explode("postings").alias("p"))
    lane = F.floor((F.col("at") - F.col("p.pos")) / BAND)
    lanes = (
        hits.select("row", "p.item_id", "p.need", "at", "p.pos", F.explode(F.array(lane, lane - 1)).alias("lane"))
        .groupBy("row", "item_id", "need", "lane").agg(F.size(F.collect_set("pos")).alias("n"), F.size(F.collect_set("at")).alias("m"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        .where(F.least("n", "m") >= F.col("need") * LEAST_HIT_SHARE)
    )
    candidates = lanes.groupBy("row", "item_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    pairs = candidates.join(found.select("row", "doc_id", "words"), "row").join(passages, "item_id").select("doc_id", "item_id", "words", "spans", "text")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, item, words, spans, text in zip(pdf["doc_id"], pdf["item_id"], pdf["words"], pdf["spans"], pdf["text"]):
                if got := verified(words.split(" "), [(x["lo"], x["hi"]) for x in spans], text):
                    rows.append((doc, item, *got))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "share"])

    out = pairs.repartition(parallelism(spark), "doc_id", "item_id").mapInPandas(verify, "doc_id bigint, item_id bigint, words int, share double")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("share").alias("share"))
