"""Token ids in files of static range-ANS blocks, and reading them back in parallel.

Format. A folder holds one file per range of ids, in ascending order of the document id. One
frequency table, counted over all ids and scaled to 2**SCALE, is shared by every block. A block
holds whole documents and is coded by itself: LANES interleaved 64-bit states step through its ids
together and share one stream of 32-bit words. Every CHECKPOINT steps the states and the place in
the stream are noted, so that a long block can be decoded from several places at once. Each block
carries the CRC-32 of its ids; the manifest, a table beside the files, has the place and the number
of ids of each block.

A task writes its file under a name of its own and the manifest names only files of tasks
that ended well, so a repeated task leaves at most an unused file.
"""

from __future__ import annotations

import functools
import posixpath
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentguard.llm.bpe import encode_texts
from agentguard.llm.flat import byte_batches
from agentguard.llm.shared import bounded_batches, cores, new_folder, stage
from agentguard.llm.words import IdCache, library, specials

SCALE = 20
LANES = 1024
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 16 << 20
READ_BLOCKS = 8  # blocks per reading task
END_ID = 1
HEAD_BYTES = 64
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SHIFT = np.uint64(SCALE)
_MASK = np.uint64((1 << SCALE) - 1)
_HEAD = struct.Struct("<4sIQIIIIQ")  # mark, crc, ids, lanes, documents, checkpoints, checkpoint step, words


# --- the coder ------------------------------------------------------------------------------


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for every id that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    room = (1 << SCALE) - int((counts > 0).sum())
    if room < 0:
        raise ValueError("the vocabulary is too large for the scale of the frequency table")
    out = np.where(counts > 0, 1 + (counts.astype(object) * room // total).astype(np.int64), 0)
    out[int(np.argmax(counts))] += (1 << SCALE) - int(out.sum())
    return out.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int, every: int = CHECKPOINT):
        """(words, checkpoints): checkpoints are (step, place in words, states), the first at step 0."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, _LOW, dtype=np.uint64)
        out: list[np.ndarray] = []
        marks = []
        f_all, c_all = self.freq[ids], self.start[ids]
        written = 0
        for step in range(steps - 1, -1, -1):
            part = slice(step * lanes, min((step + 1) * lanes, len(ids)))
            f, c = f_all[part], c_all[part]
            x = state[: len(f)]
            full = x >= (f << np.uint64(63 - SCALE))
            if full.any():
                out.append(x[full].astype(np.uint32))
                written += len(out[-1])
                x = np.where(full, x >> _WORD, x)
            q = x // f
            state[: len(f)] = (q << _SHIFT) + (x - q * f) + c
            if step % every == 0:
                marks.append((step, written, state.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, dtype=np.uint32)
        return words, [(step, len(words) - w, s) for step, w, s in marks[::-1]]

    def decode(self, words: np.ndarray, mark, n: int, lanes: int, until: int | None = None) -> np.ndarray:
        """Ids from a checkpoint to the end of the block, or to the step `until`."""
        step, at, states = mark
        steps = -(-n // lanes) if until is None else until
        state = states.copy()
        out = np.empty((max(0, steps - step)) * lanes, dtype=np.uint32)
        words = words.astype(np.uint64)
        for k in range(step, steps):
            live = min(lanes, n - k * lanes)
            x = state[:live]
            slot = x & _MASK
            s = self.symbol[slot]
            x = self.freq[s] * (x >> _SHIFT) + slot - self.start[s]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                if at + len(low) > len(words):
                    raise ValueError("a block of token ids ends early and can't match its checksum")
                x[low] = (x[low] << _WORD) | words[at:at + len(low)]
                at += len(low)
            state[:live] = x
            out[(k - step) * lanes:(k - step) * lanes + live] = s
        return out[: min(n, steps * lanes) - step * lanes]


@functools.lru_cache(maxsize=2)
def _coder(freq: bytes) -> Coder:
    return Coder(np.frombuffer(freq, dtype="<u8"))


def pack_block(coder: Coder, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: head, presence of document ids, ids, lengths, checkpoints, words."""
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    words, marks = coder.encode(ids, lanes)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    parts = [
        _HEAD.pack(b"RANS", zlib.crc32(ids.astype("<u4").tobytes()), len(ids), lanes, len(doc_ids), len(marks), CHECKPOINT, len(words)),
        known.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), lengths.astype("<i8").tobytes(),
        np.array([at for _, at, _ in marks], dtype="<u8").tobytes(), b"".join(s.astype("<u8").tobytes() for _, _, s in marks),
        words.astype("<u4").tobytes(),
    ]
    return b"".join(parts)


class Block:
    def __init__(self, data: bytes):
        mark, self.crc, self.n, self.lanes, docs, marks, every, words = _HEAD.unpack_from(data)
        if mark != b"RANS":
            raise ValueError("not a block of token ids")
        at = _HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        known, ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids, strict=True)]
        self.lengths = take("<i8", docs)
        places = take("<u8", marks)
        states = take("<u8", marks * self.lanes).reshape(marks, self.lanes)
        self.marks = [(k * every, int(p), s.astype(np.uint64)) for k, (p, s) in enumerate(zip(places, states, strict=True))]
        self.words = take("<u4", words)

    def ids(self, coder: Coder) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.uint32)
        out = coder.decode(self.words, self.marks[0], self.n, self.lanes)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a block of token ids does not match its checksum")
        return out

    def section(self, coder: Coder, k: int) -> np.ndarray:
        """The ids between checkpoint k and the next one, decoded from that checkpoint alone."""
        until = self.marks[k + 1][0] if k + 1 < len(self.marks) else None
        return coder.decode(self.words, self.marks[k], self.n, self.lanes, until)


# --- encoding with the library ----------------------------------------------------------------


class LibraryWords:
    """Ids of words from the tokenizers library, many words in one call."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.special = dict(specials(path))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.cache = IdCache()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got, counts = [], np.zeros(len(words), dtype=np.int64)
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            plain = [w for w in part if w not in self.special]
            ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, dtype=np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else np.zeros(0, dtype=np.int64)
            if len(ends) != len(plain) or (len(ends) and ends[-1] != len(ids)):
                raise ValueError("the library split a word that the splitter kept whole")
            n = np.ones(len(part), dtype=np.int64)
            if len(plain) < len(part):
                n[[w not in self.special for w in part]] = np.diff(ends, prepend=0)
                starts = np.cumsum(n) - n
                whole = np.zeros(int(n.sum()), dtype=np.int64)
                mine = np.ones(len(whole), dtype=bool)
                for k, w in enumerate(part):
                    if w in self.special:
                        whole[starts[k]], mine[starts[k]] = self.special[w], False
                whole[mine] = ids
                ids = whole
            else:
                n = np.diff(ends, prepend=0)
            got.append(ids)
            counts[at:at + len(part)] = n
        return (np.concatenate(got) if got else np.zeros(0, dtype=np.int64)), counts


@functools.lru_cache(maxsize=2)
def _library_words(path: str) -> LibraryWords:
    return LibraryWords(path)


def token_ids(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, n, ids as packed little-endian numbers), with the end id after each document."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        encoder = _library_words(path)
        for batch in byte_batches(batches, "text"):
            ids, n = encode_texts([x or "" for x in batch.column("text").to_pylist()], path, encoder)
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, END_ID).astype("<u2" if len(encoder.last) <= 1 << 16 else "<u4")
            n = n + 1
            offsets = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
            packed = pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), packed], names=schema.names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return bounded_batches(slim).mapInArrow(run, schema)


def frequencies(ids: DataFrame, size: int) -> np.ndarray:
    """Count of every id over all documents: at most one row per vocabulary entry comes to the driver."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype=kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = bounded_batches(ids).select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


# --- files ------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def write_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Write the ids of all documents below `folder`; gives the manifest and the frequency table.

    `folder` is a URI that all executors reach. Null and empty texts hold the end id only. Documents
    are in ascending order of their id, nulls first, repeated ids by their ids' bytes.
    """
    spark = docs.sparkSession
    ids = stage(token_ids(docs, path, id_col, text_col), "token-ids")
    size = library(path).get_vocab_size(with_added_tokens=True)
    counts = frequencies(ids, size)
    table = scaled(counts).astype("<u8").tobytes()
    shared = spark.sparkContext.broadcast(table)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    total = int(counts.sum())
    files = max(cores(spark), -(-total // FILE_TOKENS))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("block", T.IntegerType()),
        T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder = _coder(shared.value)
        part = TaskContext.get().partitionId()
        store, base = _open(folder)
        name = f"part-{part:05d}-{uuid.uuid4().hex}.rans"
        rows, out, at = [], None, 0
        held_ids, held, n_held = [], [], 0

        def flush():
            nonlocal out, at, held_ids, held, n_held
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(posixpath.join(base, name))
            whole = np.concatenate(held)
            data = pack_block(coder, held_ids, np.array([len(x) for x in held]), whole.astype(np.int64))
            out.write(data)
            rows.append((part, name, len(rows), at, len(data), len(whole)))
            at += len(data)
            held_ids, held, n_held = [], [], 0

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(x.as_buffer(), dtype=kind)
                if held and n_held + len(own) > BLOCK_TOKENS:
                    flush()
                held_ids.append(doc_id)
                held.append(own)
                n_held += len(own)
        if held:
            flush()
        if out is not None:
            out.close()
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        arrow = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=schema.names)

    # Rows without an id, or with one id, are cut by the head of their ids, which sorts as their bytes do.
    ordered = ids.select("doc_id", "ids").repartitionByRange(files, "doc_id", F.substring("ids", 1, HEAD_BYTES)).sortWithinPartitions("doc_id", "ids")
    return stage(ordered.mapInArrow(write, schema), "token-manifest"), table


def read_files(manifest: DataFrame, folder: str, table: bytes, id_col: str = "doc_id") -> DataFrame:
    """Per document, decoded from the files: id, start (ids before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(table)
    per_file = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = per_file.select("part", before.alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = (
        manifest.withColumn("inside", inside).join(bases, "part")
        .select("file", "offset", "length", (F.col("base") + F.col("inside")).alias("start")))
    schema = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType())])

    def read(batches):
        import pyarrow as pa

        coder = _coder(shared.value)
        store, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(posixpath.join(base, row["file"])) as f:
                    f.seek(row["offset"])
                    block = Block(f.read(row["length"]))
                ids = block.ids(coder).astype("<u4")
                ends = np.cumsum(block.lengths)
                crcs = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), block.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(row["start"] + ends - block.lengths, pa.int64()),
                     pa.array(block.lengths, pa.int64()), pa.array(crcs, pa.int64())], names=schema.names)

    tasks = max(cores(spark), manifest.count() // READ_BLOCKS)
    return blocks.repartition(tasks, "file", "offset").mapInArrow(read, schema)


def write_and_read(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to files in the shared folder and read them back; see `write_files`, `read_files`."""
    folder = new_folder(docs.sparkSession, "token-files")
    manifest, table = write_files(docs, path, folder, id_col, text_col)
    return read_files(manifest, folder, table, id_col)
