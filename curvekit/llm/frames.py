"""Token ids in patched frame-of-reference blocks, written as files and read back."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvekit.llm.common import slices
from curvekit.llm.tokens import byte_bpe_encoder, read_file
from curvekit.session import materialize

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
_HEAD = np.dtype([("ids", "<u4"), ("blocks", "<u4"), ("exceptions", "<u4"), ("body", "<u4")])


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned 32 bit) as blocks of 128: less the block minimum, in as many bits as the
    90th percentile needs; larger ones go, with their places, to the block's exception list.

    Layout, little-endian: head; per block its minimum (u4), width (u1) and number of exceptions
    (u1), and the index of block starts in the body (u4); exception places (u1) and whole
    differences (u4); the body, 16 * width bytes per block.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, _HEAD).tobytes()
    grid = np.full(blocks * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bits(np.partition(rest, at, axis=1)[:, at])
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    row, place = np.nonzero(over)
    large = rest[row, place]
    rest[row, place] = 0
    starts = np.concatenate([[0], np.cumsum(width[:-1].astype(np.uint32) * (BLOCK // 8))]).astype("<u4")
    body = np.zeros(int(width.astype(np.int64).sum()) * (BLOCK // 8), np.uint8)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            planes = (rest[which][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(planes.astype(np.uint8).reshape(len(which), -1), axis=1, bitorder="little")
            body[starts[which][:, None].astype(np.int64) + np.arange(packed.shape[1])] = packed
    head = np.array([(n, blocks, len(large), len(body))], _HEAD)
    parts = [head, low.astype("<u4"), width.astype("u1"), over.sum(axis=1).astype("u1"), starts,
             place.astype("u1"), large.astype("<u4"), body]
    return b"".join(p.tobytes() for p in parts)


def unpack(raw: bytes) -> np.ndarray:
    """The ids of pack()."""
    n, blocks, exceptions, size = (int(x) for x in np.frombuffer(raw, _HEAD, 1)[0])
    at = _HEAD.itemsize

    def take(kind, count):
        nonlocal at
        found = np.frombuffer(raw, kind, count, at)
        at += found.nbytes
        return found

    low, width, many, starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u4", blocks)
    place, large, body = take("u1", exceptions), take("<u4", exceptions), take("u1", size)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            packed = body[starts[which][:, None].astype(np.int64) + np.arange(int(w) * BLOCK // 8)]
            planes = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), BLOCK, int(w))
            values = np.zeros((len(which), BLOCK), np.uint32)
            for bit in range(int(w)):
                values |= planes[:, :, bit].astype(np.uint32) << np.uint32(bit)
            rest[which] = values
    rest[np.repeat(np.arange(blocks), many), place] = large
    return (rest + low[:, None]).reshape(-1)[:n]


def _bits(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


SEGMENTS = (
    "part int, segment long, doc_ids array<bigint>, doc_lengths array<bigint>, payload binary"
)


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, end it with end_id and write all ids in ascending key order.

    Rows are dealt into key ranges; a range is a file of segments of about SEGMENT_IDS ids, each
    with its documents' keys and lengths and one packed payload. Files are written through
    Spark's committer, so a lost task leaves nothing half written. A null text is empty and
    has the end id only; null keys come last; repeated keys keep all their rows, ordered by text.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_file(vocabulary))

    def run(batches):
        encode, part = byte_bpe_encoder(shipped.value), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        keys, found, held, segment = [], [], 0, 0
        for batch in batches:
            for piece in slices(batch):
                for doc_id, raw in zip(piece.column("doc_id").to_pylist(), encode(piece.column("text"))):
                    keys.append(doc_id)
                    found.append(raw + end)
                    held += len(found[-1]) // 4
                    if held >= SEGMENT_IDS:
                        yield _segment(part, segment, keys, found)
                        keys, found, held, segment = [], [], 0, segment + 1
        if keys:
            yield _segment(part, segment, keys, found)

    (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("last", F.col("doc_id").isNull())
        .repartitionByRange("last", "doc_id")
        .sortWithinPartitions("last", "doc_id", "text")
        .select("doc_id", "text")
        .mapInArrow(run, SEGMENTS)
        .write.parquet(path)
    )


def _segment(part, segment, keys, found):
    ids = np.frombuffer(b"".join(found), "<u4")
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([segment], pa.int64()),
         pa.array([keys], pa.list_(pa.int64())),
         pa.array([[len(x) // 4 for x in found]], pa.list_(pa.int64())),
         pa.array([pack(ids)], pa.binary())],
        names=["part", "segment", "doc_ids", "doc_lengths", "payload"],
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of write_ids(): doc_id, start, n_tokens and ids, unpacked from the files."""
    return _read(spark, path, "ids array<bigint>", lambda ids: ids.astype(np.int64))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of write_ids(): doc_id, start, n_tokens and ids_crc32, from the unpacked ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark, path, column, of_ids):
    """The start of a segment is the number of ids in the segments before it: one row per
    segment (a quarter million ids) goes through the ordering window, no document. The table
    of starts is written first, so the planner knows its size and leaves the payloads in
    place where it is small."""
    saved = spark.read.schema(SEGMENTS).parquet(path)
    name, kind = column.split(" ", 1)
    ahead = Window.partitionBy(F.lit(0)).orderBy("part")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    lengths = saved.select(
        "part", "segment", F.aggregate("doc_lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")
    )
    parts = lengths.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", (F.sum("n").over(ahead) - F.col("n")).alias("part_start")
    )
    starts = materialize(
        lengths.join(parts, "part").select(
            "part",
            "segment",
            (F.col("part_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"),
        ),
        "segment-starts",
    )
    arrow = pa.list_(pa.int64()) if kind.startswith("array") else pa.int64()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = unpack(one.column("payload")[0].as_py())
                lengths = np.array(one.column("doc_lengths")[0].as_py(), np.int64)
                ends = np.cumsum(lengths)
                values = [of_ids(ids[e - n : e]) for n, e in zip(lengths.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.column("doc_ids")[0].as_py(), pa.int64()),
                     pa.array(ends - lengths + one.column("start")[0].as_py(), pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(values, arrow)],
                    names=["doc_id", "start", "n_tokens", name],
                )

    return saved.join(starts, ["part", "segment"]).select(
        "doc_ids", "doc_lengths", "payload", "start"
    ).mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")
