"""Fill-in-middle transformation over lines, by succinct rank and select (operator 11).

The UTF-8 bytes of a slice of documents become one packed bit vector whose ones mark the last byte
of every line.  A document's number of lines is the ones within its bytes; the byte where a part
ends is the place of a one, found by its number.  So a text is cut without being split: no list of
lines is made, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .bits import BitVector
from .shared import lean, sliced

NEWLINE = 10


@dataclass(frozen=True)
class FimParams:
    """``rate`` documents of 100 are transformed, ``spm`` of 100 of these with the suffix first; ``seed`` deals them."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def line_ends(data: np.ndarray, starts: np.ndarray) -> BitVector:
    """Ones at the last byte of every line of the texts that lie in ``data`` between ``starts`` (one more than texts)."""
    bits = data == NEWLINE
    full = starts[1:] > starts[:-1]
    bits[starts[1:][full] - 1] = True
    return BitVector(bits)


def cuts(ends: BitVector, starts: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and the bytes of ``data`` where its prefix and middle end.

    ``first`` and ``second`` are unsigned numbers, reduced by the number of lines and one.
    """
    before = ends.rank(starts)
    n = before[1:] - before[:-1]
    at = np.stack([first % (n + 1), second % (n + 1)])
    low, high = at.min(axis=0), at.max(axis=0)

    def byte_after(lines: np.ndarray) -> np.ndarray:
        out = starts[:-1].copy()
        some = lines > 0
        out[some] = ends.select((before[:-1] + lines - 1)[some]) + 1
        return out

    return n, byte_after(low), byte_after(high)


def _numbers(seed: int, ids: list) -> np.ndarray:
    """The first four 32-bit numbers of the digest of each ``seed:id`` (a null id is written as nothing)."""
    digests = b"".join(sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points between the bytes: those that don't continue a character."""
    counted = BitVector((data & 0xC0) != 0x80)
    return counted.rank(ends) - counted.rank(starts)


def _transform(params: FimParams):
    marks = tuple(m.encode() for m in (params.prefix, params.suffix, params.middle))
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            texts = [t or b"" for t in batch.column("_text").to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)])
            h = _numbers(params.seed, batch.column("_id").to_pylist())
            n, low, high = cuts(line_ends(data, starts), starts, h[:, 0], h[:, 1])
            prefix_chars, middle_chars = _characters(data, starts[:-1], low), _characters(data, low, high)
            plain = np.array([not t or any(x in t for x in marks) for t in texts], bool) | (h[:, 2] % 100 >= params.rate)
            spm = h[:, 3] % 100 < params.spm
            out, forms = [], []
            for k, t in enumerate(texts):
                a, b = int(low[k] - starts[k]), int(high[k] - starts[k])
                if plain[k]:
                    out.append(t)
                elif spm[k]:
                    out.append(b"".join((s, t[b:], p, t[:a], m, t[a:b])))
                else:
                    out.append(b"".join((p, t[:a], s, t[b:], m, t[a:b])))
                forms.append("plain" if plain[k] else "spm" if spm[k] else "psm")
            made = [pa.array(n, pa.int64()), pa.array(forms), pa.array(prefix_chars, pa.int64(), mask=plain), pa.array(middle_chars, pa.int64(), mask=plain), pa.array(out, pa.binary())]
            others = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in ("_text", "_id")]
            kept = [name for name in batch.schema.names if name not in ("_text", "_id")]
            yield pa.RecordBatch.from_arrays([*others, *made], [*kept, *MADE])

    return run


MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def transformed(docs: DataFrame, params: FimParams = FimParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, and n (lines), form, prefix_chars, middle_chars (code points) and output.

    A text is plain (and its output the text) if it is empty or null, holds one of the three marks
    already, or isn't dealt by ``rate``; otherwise form is psm or spm.  Every row stays, repeated
    ones too, with the same outcome for the same id and text; a null id is dealt as one value.
    Columns of ``docs`` with the names of the new ones are replaced.  One pass without a shuffle.
    """
    read = docs.select(*(c for c in docs.columns if c not in (*MADE, text)), F.col(text).cast("binary").alias("_text"), F.col(doc_id).cast("string").alias("_id"))
    kinds = ("long", "string", "long", "long", "binary")
    schema = read.drop("_text", "_id").select("*", *(F.lit(None).cast(k).alias(c) for c, k in zip(MADE, kinds, strict=True))).schema
    return read.mapInArrow(lean(_transform(params)), schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, params: FimParams = FimParams()) -> Column:
    """The text that an output of this form was made of.

    A transformed text holds no mark, and no mark can begin within another or within text before
    one, so the first places of the marks are the ones that were put in.
    """
    tail = lambda x, mark: F.substr(x, F.locate(mark, x) + F.lit(len(mark)))
    between = lambda first, second: F.substring_index(tail(output, first), second, 1)
    middle = tail(output, params.middle)
    psm = F.concat(between(params.prefix, params.suffix), middle, between(params.suffix, params.middle))
    spm = F.concat(between(params.prefix, params.middle), middle, between(params.suffix, params.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def duckdb_sql(params: FimParams = FimParams()) -> str:
    """The digests of outputs and rebuilt texts of ``documents``, for DuckDB."""
    p, s, m = params.prefix, params.suffix, params.middle
    return rf"""
        WITH hashed AS (
          SELECT doc_id, coalesce(text, '') AS t, sha256('{params.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        lined AS (
          SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
            CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
        cut AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high FROM lined),
        parts AS (
          SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {params.rate} THEN 'plain' WHEN h4 % 100 < {params.spm} THEN 'spm' ELSE 'psm' END AS form,
            coalesce(array_to_string(u[1:low], ''), '') AS a, coalesce(array_to_string(u[low + 1:high], ''), '') AS b, coalesce(array_to_string(u[high + 1:n], ''), '') AS c FROM cut)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || a || '{s}' || c || '{m}' || b ELSE '{s}' || c || '{p}' || a || '{m}' || b END) AS output_sha256, sha256(t) AS restored_sha256
        FROM parts"""
