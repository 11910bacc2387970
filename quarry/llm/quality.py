"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

Repetitive text compresses far better than prose and random text hardly at all. Every document's ratio
(compressed / raw UTF-8 bytes) must lie in the band of its length class; of its fixed-size chunks, at most
a quarter of the bytes may lie outside the band of their length class. Every chunk is judged, the last one of a
document, which may be short, by a wider band. Below 128 bytes the frame of zstandard outweighs the text, so nothing
can be told there: the band holds everything, and the base rule on the word count decides.

Defined results: a null text counts as empty (no words, base failed); rows are judged one by one, so
repeated rows get equal verdicts; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm._text import batch_word_hashes, groups, mix, ngram_hashes

_WS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits on compressed / raw size. ``whole``: (bytes from which it holds, low, high), ascending.

    ``chunk``: the same for chunks. The upper limits lie just above clean text of many languages (Chinese and Japanese
    compress least). That tells words of random base64 characters from 512 bytes and of random lower-case letters from
    3500; below, such noise and clean text overlap.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = field(
        default=((128, 0.30, 1.00), (512, 0.25, 0.80), (768, 0.25, 0.77), (1024, 0.25, 0.74), (2048, 0.20, 0.64), (3500, 0.20, 0.585), (16384, 0.15, 0.52))
    )
    chunk_bytes: int = 4096
    chunk: tuple[tuple[int, float, float], ...] = ((128, 0.20, 1.00), (512, 0.20, 0.80), (768, 0.20, 0.77), (1024, 0.20, 0.74), (2048, 0.20, 0.64), (3500, 0.20, 0.585))
    bad_share: float = 0.25


DIGEST = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("bad_chunk_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def in_bands(data: bytes, bands: Bands, compress) -> tuple[float, float, bool]:
    """Whole-document ratio (0 for no bytes), the share of chunk bytes out of band, and the verdict."""
    if not data:
        return 0.0, 0.0, False
    ratio = len(compress(data)) / len(data)

    def fits(size: int, ratio: float, table: tuple[tuple[int, float, float], ...]) -> bool:
        fit = [(lo, hi) for n, lo, hi in table if size >= n]
        return not fit or fit[-1][0] <= ratio <= fit[-1][1]

    ok = fits(len(data), ratio, bands.whole)
    bad = 0
    for i in range(0, len(data), bands.chunk_bytes):
        piece = data[i : i + bands.chunk_bytes]
        bad += len(piece) * (not fits(len(piece), len(compress(piece)) / len(piece), bands.chunk))
    share = bad / len(data)
    return ratio, share, ok and share <= bands.bad_share


def repeated_words(words: np.ndarray, offsets: np.ndarray, n: int = 8) -> np.ndarray:
    """By text, how many words lie in n-word windows that the text holds at least twice."""
    counts = np.diff(offsets)
    out = np.zeros(len(counts), np.int64)
    if len(words) < n:
        return out
    text = np.repeat(np.arange(len(counts)), counts)
    windows = ngram_hashes(words, n) + mix(text[: len(words) - n + 1].astype(np.uint64))
    windows, at = windows[inside := text[: len(words) - n + 1] == text[n - 1 :]], np.flatnonzero(inside)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + n, np.int32)
    np.add.at(cover, at[twice], 1)
    np.subtract.at(cover, at[twice] + n, 1)
    return np.bincount(text[np.cumsum(cover)[: len(words)] > 0], minlength=len(counts)).astype(np.int64)


def _lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_WS)]
    return len(lines) - len(set(lines))


def digests(texts: list[str], bands: Bands) -> dict[str, list]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=bands.level).compress
    data = [t.encode("utf-8", "replace") for t in texts]
    n_words, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for a, b in groups([len(x) for x in data], 4 << 20):
        words, offsets = batch_word_hashes(data[a:b])
        n_words[a:b], repeats[a:b] = np.diff(offsets), repeated_words(words, offsets)
    base = (n_words < 20) | (100 * repeats > 30 * n_words)
    verdicts = [in_bands(x, bands, compress) for x in data]
    return {
        "n_words": n_words.tolist(),
        "word_chars": [len(t) - sum(map(t.count, _WS)) for t in texts],
        "n_symbols": [sum(map(t.count, _SYMBOLS)) for t in texts],
        "n_dup_lines": [_lines(t) for t in texts],
        "n_repeat_words": repeats.tolist(),
        "base_failed": base.tolist(),
        "ratio": [v[0] for v in verdicts],
        "bad_chunk_share": [v[1] for v in verdicts],
        "kept": [v[2] and not f for v, f in zip(verdicts, base.tolist(), strict=True)],
    }


def assess(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), bands: Bands = Bands(), text: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``carry`` of every row and its digest columns, named with ``prefix``. No shuffle."""
    columns = [*carry, *(() if text in carry else (text,))]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(prefix + f.name, f.dataType) for f in DIGEST])
    kinds = {f.name: pa.int64() if f.dataType == T.LongType() else pa.bool_() if f.dataType == T.BooleanType() else pa.float64() for f in DIGEST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = digests([x or "" for x in batch.column(columns.index(text)).to_pylist()], bands)
            arrays = [batch.column(i) for i in range(len(carry))] + [pa.array(found[k], kinds[k]) for k in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*columns).mapInArrow(run, schema)
