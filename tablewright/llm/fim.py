"""Fill-in-middle transformation over a sparse exception index.

Texts stay UTF-8 bytes. Only characters of several bytes are exceptions: the index of a batch records where they are and how
many bytes they take beyond the first. A cut in code points becomes a cut in bytes (and back) by one binary search among the
exceptions; everything between two exceptions is plain arithmetic, and a batch of ASCII has an empty index. No text is ever
decoded to characters.

Each document's two cuts and its form are a function of its id and the seed, so a retried task gives the same result. Plain
documents stay as they are: empty texts, texts that hold one of the marks, and the share asked for. For the others

    psm   <P> prefix <S> suffix <M> middle          spm   <S> suffix <P> prefix <M> middle

``restore`` rebuilds the text from output and form alone. Pieces hold no mark, and a mark cannot begin inside another, so the
first occurrence of each is the one that was set.

Rules: null text counts as empty and a null id as an empty one. Rows with the same id are cut alike, in shares of their own
length. Texts are taken whole; a batch holds about 4 MB of them, or one longer text. Extra columns are not returned by
``transform``; ``restore`` keeps all it is given. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tablewright.llm.common import byte_view, pieces, text_column

MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 documents, those left plain, and of the others those with the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
FORMS = ("plain", "psm", "spm")


class ExceptionIndex:
    """Code-point and byte positions of a batch of texts that lie one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: Excess bytes before the k-th exception, and of all of them at the end.
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(excess)))
        self.at_char = self.at_byte - self.before[:-1]
        self.offsets = offsets
        self.char_offsets = self._chars(offsets)

    def _chars(self, at: np.ndarray) -> np.ndarray:
        found = np.searchsorted(self.at_byte, at, side="left")
        chars = at - self.before[found]
        if len(self.at_char):  # a position inside a character counts that character
            chars = np.where(found > 0, np.maximum(chars, self.at_char[np.maximum(found, 1) - 1] + 1), chars)
        return chars

    def lengths(self) -> np.ndarray:
        """Code points of each text."""
        return np.diff(self.char_offsets)

    def to_bytes(self, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Byte positions, in their text, of code-point positions; one of each per row number."""
        at = self.char_offsets[rows] + chars
        return at + self.before[np.searchsorted(self.at_char, at, side="left")] - self.offsets[rows]

    def to_chars(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code-point positions, in their text, of byte positions."""
        return self._chars(self.offsets[rows] + at) - self.char_offsets[rows]


def _draws(id_col: str, seed: int) -> list:
    """Four unsigned 32-bit numbers per id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """``id_col``, n (code points), form, prefix_chars and middle_chars (null if plain), and output."""
    prefix_mark, suffix_mark, middle_mark = signs = [m.encode() for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = byte_view(text_column(batch, "text"))
            index = ExceptionIndex(data, offsets)
            n = index.lengths()
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            first, second = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            rows = np.arange(len(n))
            cuts = np.stack((offsets[:-1], offsets[:-1] + index.to_bytes(rows, first), offsets[:-1] + index.to_bytes(rows, second), offsets[1:]), axis=1)
            plain = (n == 0) | (h3 % 100 >= 100 - plain_percent)
            whole, forms, outputs = data.tobytes(), [], []
            for i, (begin, left, right, end) in enumerate(cuts.tolist()):
                body = whole[begin:end]
                if plain[i] or any(mark in body for mark in signs):
                    plain[i] = True
                    forms.append("plain")
                    outputs.append(body)
                    continue
                prefix, middle, suffix = whole[begin:left], whole[left:right], whole[right:end]
                if h4[i] % 100 < spm_percent:
                    forms.append("spm")
                    outputs.append(b"".join((suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)))
            columns = [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(first, pa.int64(), mask=plain),
                pa.array(second - first, pa.int64(), mask=plain),
                pa.array(outputs, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    plain_rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *_draws(id_col, seed))
    told = f"id {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return plain_rows.mapInArrow(run, told).withColumnRenamed("id", id_col)


def _between(output: bytes, form: str, signs: Sequence[bytes]) -> tuple[int, int, int]:
    """Where the pieces of one output lie: the end of the first piece, of the second, and the length of a mark before each."""
    second = signs[1] if form == "psm" else signs[0]
    at = output.index(second)
    return at, output.index(signs[2], at + len(second)), len(second)


def restore(transformed: DataFrame, output: str = "output", form: str = "form", marks: Sequence[str] = MARKS) -> DataFrame:
    """All columns, and ``restored`` (the text) and ``restored_prefix`` (its first cut in code points; null if plain)."""
    signs = [m.encode() for m in marks]
    schema = StructType(list(transformed.schema.fields)).add("restored", StringType()).add("restored_prefix", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, output):
            told = text_column(batch, output)
            index = ExceptionIndex(*byte_view(told))
            rows, starts, ends, texts = [], [], [], []
            for i, (body, kind) in enumerate(zip(told.cast(pa.large_binary()).to_pylist(), batch.column(form).to_pylist(), strict=True)):
                if kind not in ("psm", "spm"):
                    texts.append(body)
                    continue
                at, middle, width = _between(body, kind, signs)
                one = body[len(signs[0] if kind == "psm" else signs[1]) : at]
                two, three = body[at + width : middle], body[middle + len(signs[2]) :]
                prefix, suffix = (one, two) if kind == "psm" else (two, one)
                texts.append(b"".join((prefix, three, suffix)))
                begin = len(signs[0]) if kind == "psm" else at + width
                rows.append(i)
                starts.append(begin)
                ends.append(begin + len(prefix))
            where = np.array(rows, np.int64)
            chars = index.to_chars(where, np.array(ends, np.int64)) - index.to_chars(where, np.array(starts, np.int64))
            cut = np.zeros(batch.num_rows, np.int64)
            cut[where] = chars
            plain = np.ones(batch.num_rows, bool)
            plain[where] = False
            restored = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, restored, pa.array(cut, pa.int64(), mask=plain)], schema.names)

    return transformed.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Transform and restore every row: the digests of the output and of the text that was rebuilt from it."""
    told = restore(transform(docs, id_col, text))
    return told.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
