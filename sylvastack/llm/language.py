"""Language identification as mixture inference: EM over word likelihoods from character n-grams, penalised choice of the language set."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Bytes of text that are worked on together in training, and with one language in inference; more languages, fewer bytes.
TOGETHER = 500_000
INFER_TOGETHER = 2_000_000
#: Pseudo-count of each n-gram bucket in each language.
ALPHA = 0.5
#: Log-likelihood that a further language must gain for each log of the word count.
PENALTY = 3.0
UNDETERMINED = "und"

_SPACED = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))
_PLAIN_LETTER = re.compile(r"[A-Za-z]")


def _has_letter(text: str) -> bool:
    return bool(_PLAIN_LETTER.search(text)) or any(map(str.isalpha, text))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter byte, first letter of each word, document of each word. Text is lower-cased first."""
    data = b"\n" + b"\n".join(x.lower().encode("utf-8", "surrogatepass").translate(_SPACED) for x in texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    ends = raw == 10
    plain = np.where(ends, 32, raw).astype(np.uint32)
    at = np.flatnonzero(plain != 32)
    before, here, after = plain[at - 1], plain[at], plain[at + 1]
    codes = ((before * np.uint32(65_536) + here * np.uint32(256) + after) * np.uint32(2_654_435_761)) >> np.uint32(17)
    starts = np.flatnonzero(before == 32)
    return codes, starts, np.cumsum(ends)[at[starts]] - 1


def _grouped(texts: list[str], together: int = TOGETHER) -> Iterator[slice]:
    sizes = np.cumsum([len(x) for x in texts]) // together
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


@dataclass
class LanguageModel:
    """Languages in order, and the log-probability of each n-gram bucket (rows) in each of them (columns)."""

    languages: list[str]
    logs: np.ndarray

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the share of each language (zero outside the chosen set), and its number of words."""
        k = len(self.languages)
        codes, starts, owner = _trigrams(texts)
        shares, words = np.zeros((len(texts), k)), np.bincount(owner, minlength=len(texts))
        if not k or not len(starts):
            return shares, words
        # Log-likelihood of each word; a stretch of whole words at a time, so that long texts take no more memory.
        cuts = [*range(0, len(starts), 50_000), len(starts)]
        ends = np.r_[starts, len(codes)]
        fit = np.concatenate([np.add.reduceat(self.logs[codes[ends[a] : ends[b]]], starts[a:b] - starts[a], axis=0) for a, b in zip(cuts, cuts[1:])])
        top = fit.max(axis=1, keepdims=True)
        like = np.exp(fit - top)
        docs = np.flatnonzero(words)
        n = words[docs]
        first = np.r_[0, np.cumsum(n)[:-1]]
        base = np.add.reduceat(top[:, 0], first)

        def em(of: np.ndarray, weights: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log-likelihood of the documents at the places ``of``."""
            m = n[of]
            rows = np.repeat(first[of] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            own, row, at = like[rows], np.repeat(np.arange(len(of)), m), np.r_[0, np.cumsum(m)[:-1]]
            for _ in range(rounds):
                part = own * weights[row]
                part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
                weights = np.add.reduceat(part, at, axis=0) / m[:, None]
            total = np.log(np.maximum((own * weights[row]).sum(axis=1), 1e-300))
            return weights, base[of] + np.add.reduceat(total, at)

        every, _ = em(np.arange(len(docs)), np.full((len(docs), k), 1 / k), 8)
        order = np.argsort(-every, axis=1, kind="stable")
        alone = np.add.reduceat(fit, first, axis=0)
        lead = alone.argmax(axis=1)
        best = np.eye(k)[lead]
        value = alone[np.arange(len(docs)), lead]
        growing = np.arange(len(docs))
        for size in range(2, k + 1):  # a set grows by the next language for as long as the penalised likelihood does
            chosen = np.zeros((len(growing), k))
            np.put_along_axis(chosen, order[growing, :size], 1 / size, axis=1)
            weights, log = em(growing, chosen, 5)
            log = log - PENALTY * (size - 1) * np.log(n[growing] + 1)
            better = log > value[growing]
            growing, weights, log = growing[better], weights[better], log[better]
            if not len(growing):
                break
            best[growing], value[growing] = weights, log
        shares[docs] = best
        return shares, words


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over every row with a text and a language. Only (language, bucket) sums come to the driver: languages x ``BUCKETS`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                own = texts[langs == lang].tolist()
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in _grouped(own):
                    total += np.bincount(_trigrams(own[part])[0], minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = docs.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(languages)), ALPHA)
    place = {x: i for i, x in enumerate(languages)}
    counts[found["bucket"].to_numpy(int), found["lang"].map(place).to_numpy(int)] += found["n"].to_numpy(float)
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32) if languages else counts.astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text"):
    """Column struct(lang, score, languages, shares) of a text: the leading language, its share of the words, and the chosen set.

    Null texts and texts without a letter are ``und`` with score 0 and an empty set; so is everything under a model
    without languages. Ties go to the language that sorts first. Long texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, languages array<string>, shares array<double>")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for column in batches:
            texts = [x or "" for x in column]
            out = []
            for part in _grouped(texts, max(10_000, INFER_TOGETHER // max(1, len(known.languages)))):
                shares, words = known.mixtures(texts[part])
                for text, share, n in zip(texts[part], shares, words):
                    if not n or not share.any() or not _has_letter(text):
                        out.append((UNDETERMINED, 0.0, [], []))
                        continue
                    order = np.argsort(-share, kind="stable")[: np.count_nonzero(share)]
                    out.append((known.languages[order[0]], float(min(1.0, share[order[0]])), [known.languages[i] for i in order], share[order].tolist()))
            yield pd.DataFrame(out, columns=["lang", "score", "languages", "shares"])

    return infer.asNondeterministic()(F.col(text_col))  # else Spark repeats the inference below a filter on its result


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for one fold of ``folds``, by the CRC-32 of the id as text; null ids are training rows."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
