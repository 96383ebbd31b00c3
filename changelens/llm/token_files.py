"""Token-ID / binary output (4): fixed-width bit packing.

File layout (little-endian): blocks of ``BLOCK`` ids, each id in ``width`` bits
(the fewest that hold the vocabulary) within 64-bit words; then the blocks'
byte offsets, the documents' ids and first tokens; then a fixed footer.  Any
range of ids is read with one seek and unpacked with numpy.

Rows are range-sorted by id, each range is one file, and the ranges' token
counts (one manifest row a file) give each file its place in the whole.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, filesystem, partitions, scratch, text_column
from .tokens import encoder, slices

BLOCK = 4096
_FOOTER = "<4sBxxxIQQQQQ"
_MAGIC = b"IDS1"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _layout(n: int, width: int):
    bit = np.arange(n, dtype=np.int64) * width
    return bit >> 6, (bit & 63).astype(np.uint64)


def pack_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit words with ``width`` bits an id; the last word is zero-filled."""
    if not len(ids):
        return np.zeros(0, "<u8")
    if int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    word, shift = _layout(len(ids), width)
    wide = ids.astype(np.uint64)
    words = np.zeros(-(-len(ids) * width // 64), np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[heads]] = np.bitwise_or.reduceat(wide << shift, heads)
    over = shift + np.uint64(width) > 64
    words[word[over] + 1] |= wide[over] >> (np.uint64(64) - shift[over])
    return words.astype("<u8")


def unpack_ids(words: np.ndarray, n: int, width: int) -> np.ndarray:
    word, shift = _layout(n, width)
    words = np.append(words, np.uint64(0))
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return ((low | high) & np.uint64((1 << width) - 1)).astype("<u4")


class TokenFile:
    """Random access to one file: ``ids(a, b)`` and the document index."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        magic, self.width, self.block, self.n_ids, self.n_docs, offsets_at, docs_at, starts_at = struct.unpack(
            _FOOTER, self.file.read_at(struct.calcsize(_FOOTER), end - struct.calcsize(_FOOTER)))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a token file")
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.file.read_at(8 * blocks, offsets_at), "<u8")
        self.end = offsets_at
        self.starts = np.frombuffer(self.file.read_at(8 * self.n_docs, starts_at), "<u8").astype(np.int64)
        self._docs = docs_at

    def doc_ids(self) -> np.ndarray:
        """Ids as structured (present, id): ids may be null."""
        return np.frombuffer(self.file.read_at(9 * self.n_docs, self._docs), [("there", "?"), ("id", "<i8")])

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        low = int(self.offsets[first])
        high = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        words = np.frombuffer(self.file.read_at(high - low, low), "<u8")
        held = min(self.n_ids, (last + 1) * self.block) - first * self.block
        # BLOCK * width is a multiple of 64 bits, so blocks follow on without a gap
        return unpack_ids(words, held, self.width)[a - first * self.block:b - first * self.block]


def write_tokens(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = 2) -> DataFrame:
    """Write one file per id range below ``folder``; return the manifest:
    ``shard`` (in id order), ``path``, ``n_docs``, ``n_ids``, ``base`` (ids in
    all shards before).

    Only files named in the manifest count: a task that runs twice writes two
    files and only the finished one is named.  Null ids come last; equal ids
    are ordered by their texts' hashes; null texts are empty."""
    n = partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]

    def run(batches):
        context, encode = TaskContext.get(), encoder(tokenizer, end_id)
        width = width_of(encode.tokenizer.get_vocab_size())
        path = f"{folder}/ids-{context.partitionId():05d}-{context.taskAttemptId()}.bin"
        out, pending, offsets = None, [], []
        docs, lengths, at, held = [], [], 0, 0

        def put(last: bool):
            nonlocal pending, held, at
            ids = np.concatenate(pending) if pending else np.zeros(0, np.uint32)
            full = len(ids) if last else len(ids) // BLOCK * BLOCK
            for b in range(0, full, BLOCK):
                offsets.append(at)
                at += out.write(pack_ids(ids[b:min(b + BLOCK, full)], width).tobytes())
            pending, held = [ids[full:]], len(ids) - full

        for b in batches:
            if out is None:
                fs, plain = filesystem(path)
                fs.create_dir(plain.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(plain)
            keys = b.column("id")
            there = np.zeros(b.num_rows, [("there", "?"), ("id", "<i8")])
            there["there"] = keys.is_valid().to_numpy(zero_copy_only=False)
            there["id"] = keys.fill_null(0).to_numpy()
            docs.append(there)
            for _, ids, counts in encode.encode(text_column(b, "text")):
                pending.append(ids)
                lengths.append(counts)
                held += len(ids)
                if held >= 64 * BLOCK:
                    put(False)
        if out is None:
            return
        put(True)
        counts, index = np.concatenate(lengths), np.concatenate(docs)
        parts = [np.array(offsets, "<u8").tobytes(), index.tobytes(),
                 (np.cumsum(counts) - counts).astype("<u8").tobytes()]
        places = np.cumsum([at] + [len(p) for p in parts]).tolist()
        n_ids = int(counts.sum())
        for p in parts:
            out.write(p)
        out.write(struct.pack(_FOOTER, _MAGIC, width, BLOCK, n_ids, len(index), *places[:3]))
        out.close()
        yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "path": path,
                                           "n_docs": len(index), "n_ids": n_ids}])

    shards = (rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
              .mapInArrow(run, "shard long, path string, n_docs long, n_ids long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard: the manifest is as long as there are partitions
    return cut(shards, "shards").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """One row per document, from the files: ``doc_id``, ``start`` (ids before
    it), ``n_tokens``, ``ids_crc32``."""
    def run(batches):
        for b in batches:
            for shard in b.to_pylist():
                f = TokenFile(shard["path"])
                keys, ends = f.doc_ids(), np.append(f.starts[1:], f.n_ids)
                for a, z in slices(ends - f.starts, at_once):
                    first = int(f.starts[a])
                    ids = f.ids(first, int(ends[z - 1]))
                    crcs = [zlib.crc32(ids[s - first:e - first].tobytes())
                            for s, e in zip(f.starts[a:z].tolist(), ends[a:z].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys["id"][a:z], mask=~keys["there"][a:z]),
                         pa.array(f.starts[a:z] + shard["base"]), pa.array((ends - f.starts)[a:z]),
                         pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    spread = manifest.repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, tokenizer: str, **params) -> DataFrame:
    folder = scratch(df.sparkSession, "ids")
    return read_tokens(write_tokens(df, folder, tokenizer, **params))
