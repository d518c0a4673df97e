"""Sentence-piece ids by a table of distinct chunks, joined back by position.

The library turns white space into a marker and puts one in front. Where no piece of a vocabulary reaches over the start
of a marked word or over a line end, a text's ids are the ids of its chunks, one after the other: a chunk is a run of
markers and what follows up to the next marker or line end, or what a line begins with. So each distinct chunk is
segmented once for the whole corpus.

Texts are handled in blocks of some megabytes. A block lists its distinct chunks, the most frequent first, and each text
becomes the chunks' numbers in that list. The table of distinct chunks is divided into parts by a hash of the chunk:
every block sends each part what it needs of it, the part segments each chunk it meets once, and sends the ids back to
the blocks. A chunk that stands everywhere comes once per block, so no part gets more than its share. The blocks' own
table is bucketed by block, so only the ids move when both meet, and a block is put together in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.stored import bucketed
from millrace.llm.text import slices

MARK = "▁"
LINE = "\n"
#: Bytes of text in one block, whose distinct chunks and ids one task holds.
BLOCK = 1 << 24
_CHUNKS = re.compile(f"{MARK}+[^{MARK}{LINE}]*|{LINE}|[^{MARK}{LINE}]+").findall
_LOADED: dict[str, sentencepiece.SentencePieceProcessor] = {}


def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """The worker's model, loaded once. A model whose ids are not those of its chunks is refused."""
    if path not in _LOADED:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK) or LINE in p]
        sample = "\t 　ﬁ①é  a\r\n b "
        if crossing or model.normalize(sample) != MARK + sample.replace(" ", MARK) or model.encode(""):
            raise ValueError("chunks need a model that keeps white space, puts a marker in front and has no piece across a marker or line end")
        _LOADED[path] = model
    return _LOADED[path]


def chunks_of(text: str) -> list[str]:
    """The chunks of a text in order; none for an empty one."""
    return _CHUNKS(MARK + text.replace(" ", MARK)) if text else []


def segment(model: sentencepiece.SentencePieceProcessor, chunks: Sequence[str]) -> list[list[int]]:
    """The ids of each chunk. The library puts the first marker there itself, save in front of nothing; what has no
    marker stands behind a line end."""
    alone, line = [model.piece_to_id(MARK)], len(model.encode(LINE))  # a marker, then the line end
    found = model.encode([c[1:] if c[:1] == MARK else LINE + c for c in chunks], num_threads=1)
    return [(ids or alone) if c[:1] == MARK else ids[line:] for c, ids in zip(chunks, found)]


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first, compressed: high bytes of small numbers take no room."""
    width = max(int(values.max(initial=0)).bit_length() + 7, 8) // 8
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return bytes([width]) + zstandard.compress(planes.T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


def _split(docs: DataFrame, keep: Sequence[str], most: int, parts: int) -> DataFrame:
    """Rows of a text (block, place, the kept columns, codes) and rows of (block, part, chunks), which name the distinct
    chunks that a block needs of a part. A block's first text also has ``of``, the part of each of its chunks."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), *(T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)),
                           T.StructField("codes", T.BinaryType()), T.StructField("of", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("chunks", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 36
        for batch, texts in slices(batches, most=most):
            known, codes = {LINE: 0}, []
            for text in texts:
                found = chunks_of(text.decode("utf-8", "replace"))
                for c in found:
                    if c not in known:
                        known[c] = len(known)
                codes.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            often = np.bincount(np.concatenate(codes), minlength=len(known))
            often[0] = len(often) + often.sum()  # the line end, which every task knows, stays number 0
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            names = list(known)
            names = [names[i] for i in order.tolist()[1:]]
            of = np.fromiter((zlib.crc32(c.encode()) % parts for c in names), np.int64, len(names))
            sent: dict[int, list[str]] = {}
            for part, name in zip(of.tolist(), names):
                sent.setdefault(part, []).append(name)
            n, blank = len(texts), [None] * len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), *(batch.column(c) for c in keep), pa.array([_packed(rank[c]) for c in codes], pa.binary()),
                pa.array([_packed(of), *blank[1:]], pa.binary()), pa.array(blank, pa.int32()), pa.array(blank, pa.binary()),
            ], schema.names)
            n, blank = len(sent), [None] * len(sent)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * n, pa.int64()), pa.array(blank, pa.int64()), *(pa.nulls(n, batch.column(c).type) for c in keep), pa.array(blank, pa.binary()), pa.array(blank, pa.binary()),
                pa.array(list(sent), pa.int32()), pa.array([zstandard.compress(LINE.join(c).encode(), 3) for c in sent.values()], pa.binary()),
            ], schema.names)
            block += 1

    return docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, "text"]))).mapInArrow(run, schema)


def segmented(rows: Iterable[tuple[int, bytes]], segment: Callable[[list[str]], list[list[int]]]) -> Iterator[tuple[bytes, bytes]]:
    """For rows of (part, chunks), which come by part: how many ids each chunk has, and the ids, packed. Each distinct
    chunk is segmented once."""
    own, table = None, {}
    for part, data in rows:
        if part != own:
            own, table = part, {}
        chunks = zstandard.decompress(data).decode().split(LINE)
        new = [c for c in chunks if c not in table]
        table.update(zip(new, segment(new)))
        found = [table[c] for c in chunks]
        yield _packed(np.array([len(x) for x in found], np.int64)), _packed(np.array([i for x in found for i in x], np.int64))


def _segment_parts(chunks: DataFrame, model: str) -> DataFrame:
    """From rows of (block, part, chunks) sorted by part: home (the block), part, sizes and ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = processor(model)
        batches = iter(batches)
        homes: list[tuple[int, int]] = []

        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for block, part, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "chunks"))):
                    homes.append((block, part))
                    yield part, data

        for sizes, ids in segmented(rows(), lambda c: segment(loaded, c)):
            block, part = homes.pop()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([sizes], pa.binary()), pa.array([ids], pa.binary())], ["home", "part", "sizes", "ids"])

    return chunks.mapInArrow(run, "home long, part int, sizes binary, ids binary")


def _place(at: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray, end: int | None) -> np.ndarray:
    """A text's ids: the ids of its chunks by their numbers, and the end id."""
    length = size[at]
    total = int(length.sum())
    out = np.empty(total + (end is not None), np.int32)
    if total:
        shift = start[at] - (np.cumsum(length) - length)
        out[:total] = flat[np.repeat(shift, length) + np.arange(total)]
    if end is not None:
        out[-1] = end
    return out


def encode(docs: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), end_id: bool = True, block: int = BLOCK) -> DataFrame:
    """The ``keep`` columns and ``ids`` (array<int>), a row per row of ``docs``; ``text`` is encoded whole.

    The ids are those that the library gives, with the model's end id last unless ``end_id`` is false. Null and empty
    texts have the end id alone. Rows are independent: repeated ids or null ids stay rows of their own. A kept column
    named ``ids`` is refused. An empty table gives no rows. A text longer than a block is a block of its own.
    """
    if "ids" in keep:
        raise ValueError("a column named ids would clash with the result")
    processor(model)  # refuse an unfit model before any work
    names = [f"k{i}" for i in range(len(keep))]
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(_split(docs, keep, block, parts), "chunks", "block")
    needed = blocks.where("part IS NOT NULL").select("block", "part", "chunks").repartition("part").sortWithinPartitions("part")
    known = _segment_parts(needed, model)
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        own = processor(model)
        line = own.encode(LINE)[1:]  # behind the marker
        of = _unpacked(next(x for x in left.column("of").to_pylist() if x is not None))
        found = sorted(zip(right.column("part").to_pylist(), right.column("sizes").to_pylist(), right.column("ids").to_pylist()))
        by_part = np.concatenate([[len(line)], *(_unpacked(s) for _, s, _ in found)]).astype(np.int64)
        flat = np.concatenate([line, *(_unpacked(i) for *_, i in found)]).astype(np.int32)
        order = np.concatenate([[0], np.argsort(of, kind="stable") + 1])  # the chunks' numbers as they come by part
        start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        size[order], start[order] = by_part, np.cumsum(by_part) - by_part
        ids = [_place(_unpacked(c), start, size, flat, own.eos_id() if end_id else None) for c in left.column("codes").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        whole = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        return pa.table([*(left.column(n) for n in names), whole.cast(pa.list_(pa.int32()))], names=schema.names)

    texts = blocks.where("codes IS NOT NULL").select("block", *names, "codes", "of")
    return texts.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(put, schema)


def decoded(rows: DataFrame, model: str, result: Sequence[tuple[str, str]], make: Callable[[list[int], str], Sequence]) -> DataFrame:
    """The other columns of ``rows`` and what ``make(ids, text)`` returns for each row's ids and their decoded text.

    ``result``: names and types of its columns. Null ids count as none.
    """
    keep = [c for c in rows.columns if c != "ids" and c not in dict(result)]
    schema = rows.select(*(f"`{c}`" for c in keep)).schema
    for name, kind in result:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        own = processor(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("ids")
                at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).tolist()
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                made = [make(ids, own.decode(ids)) for ids in (flat[a:b].tolist() for a, b in zip(at[:-1], at[1:]))]
                columns = [pa.array([m[i] for m in made], to_arrow_type(schema[n].dataType)) for i, (n, _) in enumerate(result)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, name: str = "text") -> DataFrame:
    """The rows with ``text``, the library's decoding of ``ids``, in place of the ids."""
    return decoded(rows, model, [(name, "string")], lambda ids, text: (text,))
