"""Training-order materialisation (operator 2).

1. ``sequences``: the documents of an input partition form one token stream
   (ids of a public vocabulary, id 1 after every document), chopped into
   sequences of ``LENGTH`` ids; the last one of a partition is filled up with
   id 1.  They are compressed one by one and written once, and counted by
   partition: a sequence's index is its partition's offset plus its place.
2. ``Permutation``: a keyed Feistel network over the next power of two, with
   cycle-walking (apply again until the value is under the count), maps the
   indexes one-to-one onto the slots 0 .. count - 1: the training order, the
   same for the same key, without sorting random numbers.
3. ``materialise``: sequences are range-partitioned by shard (``SHARD`` slots
   each; the slots are known to be dense, so the ranges need no sampling),
   sorted by slot, and every shard is written as one file of records of fixed
   stride, so slot s stands at byte (s mod SHARD) * stride of shard
   s div SHARD.  A shard is written under a temporary name and renamed, so a
   retried task leaves no half file, and readers can start at any slot
   (``read_from``).

Null and empty texts give their id 1; repeated rows are written as often as
they occur; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm.common import saved
from tokenlake.llm.tokenize import default_path, encoder
from tokenlake.llm.words import mix

LENGTH = 2048
END = 1
SHARD = 4096               # sequences of a shard
KEY = 20240607
ROUNDS = 6


class Permutation:
    """One-to-one mapping of 0 .. count - 1 onto itself by a secret key."""

    def __init__(self, count: int, key: int = KEY, rounds: int = ROUNDS):
        bits = max(2, int(count - 1).bit_length())
        self.count = count
        self.low, self.high = bits // 2, bits - bits // 2
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))

    def _network(self, x: np.ndarray, keys: list) -> np.ndarray:
        low, high = np.uint64(self.low), np.uint64(self.high)
        left, right = x >> low, x & np.uint64((1 << self.low) - 1)
        for i, k in keys:
            if i % 2 == 0:
                left = left ^ (mix(right ^ k) >> (np.uint64(64) - high))
            else:
                right = right ^ (mix(left ^ k) >> (np.uint64(64) - low))
        return left << low | right

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = self._network(np.asarray(x).astype(np.uint64), keys)
        while (out := np.flatnonzero(x >= self.count)).size:
            x[out] = self._network(x[out], keys)
        return x.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, list(enumerate(self.keys)))

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, list(enumerate(self.keys))[::-1])


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``(part, place, n_ids, ids)``: sequences of every input partition, ids as little-endian unsigned integers in a zstandard frame."""
    path = path or default_path()

    def run(batches):
        enc, part, place = encoder(path), TaskContext.get().partitionId(), 0
        kind = id_type(len(enc.ends_word))
        held, small = np.zeros(0, kind), zstandard.ZstdCompressor(level=3)

        def made(rows: np.ndarray, n_ids: list[int]):
            return pa.record_batch([pa.array([part] * len(rows), pa.int32()), pa.array(np.arange(place, place + len(rows))),
                                    pa.array(n_ids, pa.int32()), pa.array([small.compress(r) for r in rows], pa.binary())],
                                   names=["part", "place", "n_ids", "ids"])
        for batch in batches:
            for a, b, ids, sizes in enc.batches(batch.column(0)):
                stream = np.full(len(ids) + b - a, END, kind)
                keep = np.ones(len(stream), bool)
                keep[np.cumsum(sizes + 1) - 1] = False
                stream[keep] = ids
                held = np.concatenate((held, stream))
                whole = len(held) // length
                if whole:
                    yield made(held[:whole * length].reshape(whole, length), [length] * whole)
                    place, held = place + whole, held[whole * length:]
        if len(held):
            n = len(held)
            yield made(np.concatenate((held, np.full(length - n, END, kind)))[None, :], [n])
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "part int, place long, n_ids int, ids binary")


def id_type(vocabulary: int) -> str:
    """The smallest unsigned type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _shard_name(number: int) -> str:
    return f"shard-{number:08d}.bin"


def materialise(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, length: int = LENGTH,
                shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Writes the shards under ``folder`` (a URI all executors reach) and returns one row per sequence:
    ``slot, shard, byte_offset, n_ids, crc32, part, place``."""
    path = path or default_path()
    stride = length * int(id_type(len(encoder(path).ends_word))[-1])
    made = saved(sequences(docs, path, length), "sequences", "uncompressed")
    # one number per input partition
    counts = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for part, n in counts:
        offsets[part], total = total, total + n
    permutation, shipped = Permutation(max(1, total), key), spark.sparkContext.broadcast(offsets)

    @F.pandas_udf("long")
    def slot(part: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(permutation.slots(part.map(shipped.value).to_numpy() + place.to_numpy()))

    def write(batches):
        files, base = fs.FileSystem.from_uri(folder)
        number, out, temporary = None, None, ""

        def close():
            if out is not None:
                out.close()
                files.move(f"{base}/{temporary}", f"{base}/{_shard_name(number)}")
        for batch in batches:
            slot, whole, crc = batch.column(0).to_numpy(), zstandard.ZstdDecompressor(), []
            for s, v in zip(slot.tolist(), batch.column(4)):
                if s // shard != number:
                    close()
                    number = s // shard
                    temporary = f"_writing-{_shard_name(number)}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(f"{base}/{temporary}")
                record = whole.decompress(v.as_buffer())
                out.write(record)
                crc.append(zlib.crc32(record))
            yield pa.record_batch([batch.column(0), pa.array(slot // shard), pa.array(slot % shard * stride), batch.column(3),
                                   pa.array(crc, pa.int64()), batch.column(1), batch.column(2)],
                                  names=["slot", "shard", "byte_offset", "n_ids", "crc32", "part", "place"])
        close()

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    shards = -(-total // shard)
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = max(1, -(-shards // tasks)) * shard
    index = saved(made.select(slot("part", "place").alias("slot"), "part", "place", "n_ids", "ids")
                  .repartitionById(tasks, F.expr(f"int(slot div {each})")).sortWithinPartitions("slot")
                  .mapInArrow(write, "slot long, shard long, byte_offset long, n_ids int, crc32 long, part int, place long"), "order")
    with files.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "shards": shards, "shard": shard, "length": length, "stride": stride, "key": key}).encode())
    return index


def read_from(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in training order, read sequentially."""
    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/manifest.json") as f:
        m = json.loads(f.read())
    kind = f"<u{m['stride'] // m['length']}"
    while slot < m["sequences"]:
        number, at = divmod(slot, m["shard"])
        with files.open_input_file(f"{base}/{_shard_name(number)}") as f:
            f.seek(at * m["stride"])
            while len(record := f.read(m["stride"])) == m["stride"]:
                yield np.frombuffer(record, kind)
                slot += 1
