"""Language identification, words first.

A known word scores by the logarithm of its frequency in each language. An unseen word falls back to its character n-grams
of five letters; if none of them is known, to four, and so on down to single letters. A document's score is the posterior
of the best language over the sum of its words.

Training reads a sample of the labelled documents chosen by a hash of their id (about ``SAMPLE_DOCS``, all if there are
fewer). Of every language the model holds the ``MODEL_ENTRIES`` most frequent words and as many n-grams of each length, with
their counts in all languages, so a language with few documents keeps its words beside a large one, and what is broadcast is
bounded by six tables of that many lines per language. Words are runs of letters, lower-cased.

Rules: text that is null or has no letter is ``und`` with score 0; so is everything if nothing could be learned. Ties go to
the language that sorts first. Rows with a null id are never learned from and not held out. Repeated rows are treated alike;
extra columns are kept or ignored by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import doc_bucket, pieces, stored, text_column
from tablewright.llm.textops import span_hashes

SAMPLE_DOCS = 10_000
MODEL_ENTRIES = 50_000
LONGEST = 5
UNKNOWN = "und"
_SMOOTHING = 0.5
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, starts and ends of their words, and the offsets of each text's words."""
    lowered = [t.lower() for t in texts]
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    if len(codes) == 0:
        none = np.zeros(0, np.int64)
        return codes, none, none, np.zeros(len(texts) + 1, np.int64)
    inside = _letter_table()[codes]
    first = np.r_[True, ~inside[:-1]]
    first[offsets[:-1][offsets[:-1] < len(codes)]] = True
    last = np.r_[first[1:] | ~inside[1:], True]
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    return codes, starts, ends, np.searchsorted(starts, offsets, side="left")


def gram_windows(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every n-gram inside the words, and the index of its word."""
    counts = np.maximum(ends - starts - n + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + within, owner


@dataclass
class Model:
    """languages, their log priors, and per level (0: words, n: n-grams) sorted hashes and log frequencies."""

    languages: list[str]
    priors: np.ndarray
    keys: list[np.ndarray]
    logs: list[np.ndarray]

    def find(self, level: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[level]
        if len(keys) == 0:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log frequency per language of distinct words, given in order of their starts."""
        scores = np.zeros((len(starts), len(self.languages)))
        at, known = self.find(0, hashes)
        scores[known] = self.logs[0][at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if len(left) == 0:
                break
            begin, owner = gram_windows(starts[left], ends[left], n)
            at, hit = self.find(n, span_hashes(codes, begin, begin + n))
            owner, at = owner[hit], at[hit]
            count = np.bincount(owner, minlength=len(left))
            for k in range(len(self.languages)):
                total = np.bincount(owner, self.logs[n][at, k], minlength=len(left))
                scores[left, k] = np.where(count > 0, total / np.maximum(count, 1), 0.0)
            left = left[count == 0]
        return scores

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        codes, starts, ends, offsets = words_of(texts)
        if len(starts) == 0 or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        distinct, first, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        order = np.argsort(first)
        scores = np.empty((len(distinct), len(self.languages)))
        scores[order] = self.word_scores(codes, starts[first[order]], ends[first[order]], distinct[order])
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        total = np.tile(self.priors, (len(texts), 1))
        total[filled] += np.add.reduceat(scores[inverse], offsets[:-1][filled], axis=0)
        best = total.argmax(axis=1)
        sure = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        empty = offsets[1:] == offsets[:-1]
        return [UNKNOWN if e else self.languages[b] for b, e in zip(best, empty, strict=True)], np.where(empty, 0.0, sure)


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 20):
        texts, languages = text_column(batch, "text").to_pylist(), batch.column("lang").to_pylist()
        for language in sorted(set(languages)):
            own = [t for t, x in zip(texts, languages, strict=True) if x == language]
            codes, starts, ends, _ = words_of(own)
            for level in range(LONGEST + 1):
                begin, stop = starts, ends
                if level:
                    begin, _ = gram_windows(starts, ends, level)
                    stop = begin + level
                keys, counts = np.unique(span_hashes(codes, begin, stop), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(keys), pa.string()), pa.array(np.full(len(keys), level, np.int32)), pa.array(_signed(keys)), pa.array(counts)],
                    ["lang", "level", "key", "n"],
                )


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, entries: int = MODEL_ENTRIES) -> Model:
    """Learn from the text and language of ``labelled``; rows without either, or without an id, are left out."""
    plain = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = plain.filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    found = rows.count()
    if found > sample_docs:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample_docs / found))
    counts = rows.select("text", "lang").mapInArrow(_count_grams, "lang string, level int, key long, n long")
    counts = stored(counts.groupBy("level", "key", "lang").agg(F.sum("n").alias("n")), "lang-counts")
    totals = counts.groupBy("level", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    languages = sorted({r["lang"] for r in totals})
    at = {name: k for k, name in enumerate(languages)}
    by_count = Window.partitionBy("level", "lang").orderBy(F.desc("n"), "key")
    frequent = counts.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= entries).select("level", "key").distinct()
    # Arrow columns: a line is three numbers here, not a row object.
    code = F.array_position(F.array(*(F.lit(x) for x in languages)), F.col("lang")) - 1 if languages else F.lit(0)
    found = counts.join(frequent, ["level", "key"]).select("level", "key", code.cast("int").alias("code"), "n").toArrow()
    level_of, key, code, n = (found.column(c).to_numpy() for c in ("level", "key", "code", "n"))
    keys, logs = [], []
    for level in range(LONGEST + 1):
        here = np.flatnonzero(level_of == level)
        hashes, row = np.unique(key[here].view(np.uint64), return_inverse=True)
        table = np.zeros((len(hashes), len(languages)))
        table[row, code[here]] = n[here]
        size, kinds = np.zeros(len(languages)), np.zeros(len(languages))
        for r in totals:
            if r["level"] == level:
                size[at[r["lang"]]], kinds[at[r["lang"]]] = r["n"], r["kinds"]
        keys.append(hashes)
        logs.append(np.log((table + _SMOOTHING) / (size + _SMOOTHING * (kinds.max(initial=0) + 1))))
    words = np.array([sum(r["n"] for r in totals if r["level"] == 0 and r["lang"] == x) for x in languages], float)
    return Model(languages, np.log((words + 1) / (words.sum() + len(languages))), keys, logs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*names).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 20):
            found, sure = shared.value.predict(text_column(batch, text).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the quarter of documents that training leaves out."""
    return F.coalesce(doc_bucket(id_col, 4) == 2, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Model:
    return fit(docs.filter(~held_out()))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    found = identify(docs.select("doc_id", "text"), fit_on_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
