"""Encoding of texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.runtime import require, ship

#: File of the vocabulary, as ranks. None: the installed package of public tokenizers.
VOCABULARY: str | None = None
#: Texts of more characters are encoded in chunks of this many, by several tasks.
CHUNK_CHARS = 8_192
#: Characters a chunk reaches into the next one, where the pre-token boundaries of both are compared.
OVERLAP_CHARS = 256
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: the given one, else that of byte_bpe_50k in the installed package."""
    if path or VOCABULARY:
        return path or VOCABULARY
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file; one for a Python worker. Executors that don't have the file get it from the driver."""
    import tiktoken

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def pretokens():
    import regex

    return regex.compile(PATTERN)


def shipped(spark: SparkSession, path: str) -> str:
    """path, once the file is where executors without it can fetch it."""
    sc = spark.sparkContext
    held = getattr(sc, "_millrace_vocabularies", None) or set()
    if path not in held:
        sc.addFile(path)
        sc._millrace_vocabularies = held | {path}
    ship(spark)
    return path


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids: their raw bytes put together."""
    return b"".join(map(encoder(vocabulary_path(path)).decode_single_token_bytes, ids)).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Token ids of each text, without special tokens: columns id_col, ids (array of int).

    A null text and an empty text have an empty list. Strings of special tokens are ordinary text. One row
    for each row of df, also where rows or ids are repeated. Texts of rows with a null id are encoded whole.

    Overlapping chunk encoding: a text of more than chunk_chars characters is cut in chunks that
    reach overlap_chars into the next one. The chunks are pre-tokenised in parallel. Where a chunk and the next
    have a pre-token boundary in common, the cut between them is moved there: from a common boundary on both
    go on alike. If they have none, as in a run of letters longer than the overlap, the next
    boundary is taken that holds whatever came before, and what lies between stays one piece. The pieces are
    encoded in parallel and the ids put together. The ids are those of the whole text.
    """
    path = shipped(df.sparkSession, vocabulary_path(vocabulary))
    src = require(df, [id_col, text_col]).toDF("_id", "_text")
    size = F.length("_text")
    alone = src.where(F.col("_text").isNull() | F.col("_id").isNull() | (size <= chunk_chars))
    kind = src.schema["_id"].dataType.simpleString()
    out = alone.mapInArrow(_encode_rows(path), f"_id {kind}, ids array<int>")
    pieces = _pieces(src.where(F.col("_id").isNotNull() & (size > chunk_chars)), kind, chunk_chars, overlap_chars)
    parts = pieces.mapInArrow(_encode_rows(path), f"_id {_keyed(kind)}, _piece int, _copies int, ids array<int>")
    whole = parts.groupBy("_id").agg(F.max("_copies").alias("_copies"), F.array_sort(F.collect_list(F.struct("_piece", "ids"))).alias("_parts"))
    whole = whole.select(F.col("_id.i").alias("_id"), F.flatten("_parts.ids").alias("ids"), F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("col")
    return out.unionByName(whole).withColumnRenamed("_id", id_col)


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """Number of tokens of each text: columns id_col, n_tokens. Null and empty texts have 0."""
    path = shipped(df.sparkSession, vocabulary_path(vocabulary))
    src = require(df, [id_col, text_col]).toDF("_id", "_text")
    kind = src.schema["_id"].dataType.simpleString()
    long = F.col("_id").isNotNull() & (F.coalesce(F.length("_text"), F.lit(0)) > CHUNK_CHARS)
    out = src.where(~long).mapInArrow(_encode_rows(path, count=True), f"_id {kind}, n_tokens int")
    parts = _pieces(src.where(long), kind, CHUNK_CHARS, OVERLAP_CHARS).mapInArrow(_encode_rows(path, count=True), f"_id {_keyed(kind)}, _piece int, _copies int, n_tokens int")
    whole = parts.groupBy("_id").agg(F.max("_copies").alias("_copies"), F.sum("n_tokens").cast("int").alias("n_tokens"))
    whole = whole.select(F.col("_id.i").alias("_id"), "n_tokens", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("col")
    return out.unionByName(whole).withColumnRenamed("_id", id_col)


def _keyed(kind: str) -> str:
    """An id with the hash of its text: texts of one id don't mix."""
    return f"struct<i:{kind},h:bigint>"


def _encode_rows(path: str, count: bool = False):
    """Batches with the column _text to batches with its ids, or their number, in its place at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_text"]
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                ids = [enc.encode_ordinary(t) if t else [] for t in rows.column("_text").to_pylist()]
                made = pa.array([len(x) for x in ids], pa.int32()) if count else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], made], [*names, "n_tokens" if count else "ids"])

    return run


def _cut(chunk_chars: int, overlap_chars: int):
    """Texts to chunks: _id, _chunk, _last, _text (with the overlap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(batch.column("_id"), batch.column("_text").to_pylist(), strict=True):
                n = -(-len(text) // chunk_chars)
                for start in range(0, n, 64):
                    at = range(start, min(n, start + 64))
                    chunks = [text[c * chunk_chars : (c + 1) * chunk_chars + overlap_chars] for c in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([id_.as_py()] * len(at), batch.schema.field("_id").type), pa.array(at, pa.int32()), pa.array(chunks, pa.string())], ["_id", "_chunk", "_text"]
                    )

    return run


def boundaries(chunk: str, first: bool, last: bool, size: int, overlap: int) -> tuple[list[int], list[int], int | None]:
    """Pre-token boundaries of a chunk within its first overlap, those within its overlap into the next, and its first safe one.

    Offsets of the second are counted from the next chunk's start. Boundaries at the end of the chunk are
    unknown, unless it ends the text, and none after white space is taken. A boundary is safe where a space stands between two other characters: no pre-token has a space after another character.
    """
    head: list[int] = [0] if first else []
    tail: list[int] = []
    safe = 0 if first else None
    end = len(chunk)
    for m in pretokens().finditer(chunk):
        b = m.end()
        if b > end - 3 and not last:  # what follows could lengthen this pre-token: a run goes on, or 'l becomes 'll
            break
        if m.group()[-1].isspace():  # white space at the end of a piece reads otherwise than before a word
            continue
        if b <= overlap:
            head.append(b)
        if size <= b <= size + overlap:
            tail.append(b - size)
        if safe is None and 0 < b < min(size, end - 1) and chunk[b] == " " and not chunk[b - 1].isspace() and not chunk[b + 1].isspace():
            safe = b
    return head, tail, safe


def _report(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in batches:
            rows = [boundaries(t, c == 0, len(t) <= size, size, overlap) for c, t in zip(batch.column("_chunk").to_pylist(), batch.column("_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_chunk"), batch.column("_copies"), pa.array([r[0] for r in rows], lists), pa.array([r[1] for r in rows], lists), pa.array([r[2] for r in rows], pa.int32())],
                ["_id", "_chunk", "_copies", "_head", "_tail", "_safe"],
            )

    return run


def _pieces(long: DataFrame, kind: str, size: int, overlap: int) -> DataFrame:
    """Pieces of long texts that are encoded on their own: _id, _piece, _copies, _text. Equal rows are one, and _copies says how many."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than a chunk")
    kind = _keyed(kind)
    long = long.select(F.struct(F.col("_id").alias("i"), F.xxhash64("_text").alias("h")).alias("_id"), "_text")
    chunks = long.mapInArrow(_cut(size, overlap), f"_id {kind}, _chunk int, _text string")
    # copies of a text are the same chunks
    chunks = chunks.groupBy("_id", "_chunk").agg(F.first("_text").alias("_text"), F.count(F.lit(1)).cast("int").alias("_copies"))
    reports = chunks.mapInArrow(_report(size, overlap), f"_id {kind}, _chunk int, _copies int, _head array<int>, _tail array<int>, _safe int")
    order = Window.partitionBy("_id").orderBy("_chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a boundary in common with the chunk before counts if that one is in step, that is, has a cut of its own
    common = F.array_min(F.array_intersect("_head", F.lag("_tail").over(order)))
    own = F.when(F.col("_chunk") == 0, F.lit(0)).otherwise(F.col("_safe"))
    steps = reports.withColumn("_common", common).withColumn("_own", own)
    # its own cut puts a chunk in step, no common boundary puts it out of step, else it is as the one before
    steps = steps.withColumn("_in", F.last(F.when(F.col("_own").isNotNull(), True).when(F.col("_common").isNull(), False), ignorenulls=True).over(upto))
    led = F.coalesce(F.lag("_in").over(order), F.lit(False)) & F.col("_common").isNotNull()
    cuts = steps.withColumn("_cut", F.when(led, F.col("_common")).otherwise(F.col("_own"))).select("_id", "_copies", "_chunk", "_cut")
    # a chunk's own characters up to its cut belong to the piece before it
    cut = F.col("_cut").isNotNull()
    cuts = cuts.withColumn("_piece", F.last(F.when(cut, F.col("_chunk")), ignorenulls=True).over(upto)).withColumn("_earlier", F.lag("_piece").over(order)).withColumn("_next", F.lead("_cut").over(order))
    # a piece that ends within its own chunk's overlap, or with the text, has all of its characters there
    far = F.when(cut, F.lead("_chunk").over(order).isNotNull() & (F.col("_next").isNull() | (F.col("_next") > overlap)))
    cuts = cuts.withColumn("_far", F.last(far, ignorenulls=True).over(upto)).withColumn("_far_before", F.lag("_far").over(order))
    near = chunks.join(cuts.where(cut & ~F.col("_far")).drop("_copies"), ["_id", "_chunk"])
    near = near.select("_id", "_piece", "_copies", F.substring("_text", F.col("_cut") + 1, F.lit(size) - F.col("_cut") + F.coalesce("_next", F.lit(0))).alias("_text"))
    # the few others are put together from the chunks that they lie in
    cuts = cuts.where("_far OR _far_before")
    own = F.substring("_text", 1, size)
    parts = chunks.join(cuts.drop("_copies"), ["_id", "_chunk"]).select(
        "_id",
        "_copies",
        "_chunk",
        F.explode(
            F.array(
                F.struct(F.when(F.col("_far_before"), F.col("_earlier")).alias("p"), F.when(F.col("_cut") > 0, F.substring(own, F.lit(1), F.col("_cut"))).when(F.col("_cut").isNull(), own).alias("t")),
                F.struct(F.when(F.col("_far") & cut, F.col("_piece")).alias("p"), F.when(F.col("_cut").isNotNull(), F.substring(own, F.col("_cut") + 1, F.lit(size))).alias("t")),
            )
        ).alias("_s"),
    )
    parts = parts.where("_s.p IS NOT NULL AND _s.t IS NOT NULL").select("_id", "_copies", F.col("_s.p").alias("_piece"), "_chunk", F.col("_s.t").alias("_t"))
    held = parts.groupBy("_id", "_piece", "_copies").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_t"))).alias("_l"))
    return near.unionByName(held.select("_id", "_piece", "_copies", F.array_join("_l._t", "").alias("_text")))
