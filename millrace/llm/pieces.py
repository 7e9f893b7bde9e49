"""Oversized texts in pieces under a limit, cut at natural boundaries."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import encoder, shipped, vocabulary_path
from millrace.runtime import dealt, require

#: Tokens of a piece at most, and tokens that consecutive pieces share.
LIMIT, OVERLAP = 1_024, 64

#: Where a text may be cut, the strongest last: before white space, after a sentence, a line, a paragraph.
BOUNDARIES = (
    re.compile(r"(?<=\S)(?=\s)"),
    re.compile(r"(?<=[.!?…؟])[\"'”’»)\]]*(?=\s)|(?<=[。！？])[」』”’]?"),
    re.compile(r"\r\n|[\n\r\x0b\x0c\u2028]"),
    re.compile(r"(?:\r\n|[\n\r])[ \t]*(?:(?:\r\n|[\n\r])[ \t]*)+|\u2029"),
)


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, with_text: bool = True) -> DataFrame:
    """Texts in pieces of at most limit tokens: columns id_col, piece, pieces, start, end, n_tokens, shared, text.

    A text within the limit is one piece. A longer one is cut in the fewest pieces that the limit and
    the overlap allow, at targets of equal length, each moved to the strongest boundary near it: a paragraph's
    end, a line's, a sentence's, a word's, else any end of a token that is one of a character. Each piece
    is encoded again on its own; if one exceeds the limit, the text is cut anew in one piece more.
    start and end are character offsets; shared is the number of the text's tokens shared with the piece before: overlap,
    or up to three more where that token boundary lies inside a character; 0 for the first piece.
    Put together without the shared parts, the pieces are the text.

    Null and empty texts give no piece. Repeated rows and null ids come out as often as they stand. text is null unless with_text.
    Texts are dealt over the tasks by their hash, so that long ones that lie together in a file aren't one task's. A text that
    can't be cut within the limit (its pieces would share more than the limit allows) is an error.
    """
    if not 0 <= overlap < limit - 4:
        raise ValueError("the overlap must be smaller than the limit, less the bytes of a character")
    path = shipped(df.sparkSession, vocabulary_path(vocabulary))
    src = require(df, [id_col, text_col]).toDF("_id", "_text").where("_text IS NOT NULL AND _text <> ''")
    src = dealt(src, F.xxhash64("_text", F.spark_partition_id()))
    kind = src.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, pieces int, start int, end int, n_tokens int, shared int, text string"
    out = src.mapInArrow(_split_rows(path, limit, overlap, with_text), schema)
    return out.withColumnRenamed("_id", id_col)


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None) -> DataFrame:
    """Pieces, without their texts, of the texts above the limit alone; texts that have no more bytes than that are left out at once."""
    src = require(df, [id_col, text_col]).where(F.octet_length(F.col(f"`{text_col}`")) > limit)
    return split_texts(src, id_col, text_col, limit, overlap, vocabulary, with_text=False).where("pieces > 1")


def _split_rows(path: str, limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            kind = batch.schema.field("_id").type
            ids, texts = batch.column("_id").to_pylist(), batch.column("_text").to_pylist()
            for start in range(0, len(ids), 64):
                rows = []
                for id_, text in zip(ids[start : start + 64], texts[start : start + 64], strict=True):
                    found = split(text, enc, limit, overlap)
                    rows += [(id_, k, len(found), *p, text[p[0] : p[1]] if with_text else None) for k, p in enumerate(found)]
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [kind, *[pa.int32()] * 6, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["_id", "piece", "pieces", "start", "end", "n_tokens", "shared", "text"])

    return run


@functools.lru_cache(maxsize=2)
def _lengths(enc) -> np.ndarray:
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.max_token_value + 1)], np.int64)


def split(text: str, enc, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces of one text: start, end, tokens, shared."""
    ids = enc.encode_ordinary(text)
    total = len(ids)
    if total <= limit:
        return [(0, len(text), total, 0)]
    raw = np.frombuffer(text.encode(), np.uint8)
    starts_char = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char)])  # characters begun before a byte
    at = np.concatenate([[0], np.cumsum(_lengths(enc)[np.array(ids)])])  # first byte of each token, and the end
    whole = np.append(starts_char, True)[at]  # whether a token boundary is one of characters
    char_at = chars[at]
    strength = np.zeros(len(text) + 1, np.int8)
    for level, pattern in enumerate(BOUNDARIES, 1):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        strength[ends] = np.maximum(strength[ends], level)
    strong = np.where(whole, strength[char_at], -1)

    n = max(2, -(-(total - overlap) // (limit - overlap)))
    while n <= total:
        cuts = _cuts(total, n, limit, overlap, strong, whole)
        if cuts:
            found = [(int(char_at[s]), int(char_at[e]), len(enc.encode_ordinary(text[char_at[s] : char_at[e]])), shared) for s, e, shared in cuts]
            if all(p[2] <= limit for p in found):
                return found
        # each try is one piece more, and from many pieces on some more at once, so that the tries are few
        n += max(1, n // 64)
    raise ValueError(f"a text of {total} tokens can't be cut in pieces of {limit} that share {overlap}")


def _cuts(total: int, n: int, limit: int, overlap: int, strong: np.ndarray, whole: np.ndarray) -> list[tuple[int, int, int]] | None:
    """n pieces as token ranges, each with what it shares with the one before; None if one can't keep the limit."""
    stride = (total - overlap) / n
    near = max(4, int(stride / 4))
    pieces, start, shared = [], 0, 0
    for k in range(1, n):
        target = overlap + k * stride
        low, high = max(round(target - near), start + shared + 1), min(round(target + near), start + limit, total - 1)
        if low > high:
            return None
        spots = np.arange(low, high + 1)
        order = np.lexsort((spots, np.abs(spots - target), -strong[low : high + 1]))
        end = int(spots[order[0]])
        if strong[end] < 0:
            return None
        pieces.append((start, end, shared))
        start = max(0, end - overlap)
        while not whole[start]:
            start -= 1
        shared = end - start
    pieces.append((start, total, shared))
    return pieces if total - start <= limit else None
