"""Lines that several documents hold, kept in one of them, by probing a sharded minimal perfect hash.

The key of a line is the line without ASCII white space at its ends, A to Z in lower case; 128 bits of its digest stand
for it. Keys that only one document holds can never be dropped, so the index is built over the distinct others, dealt to
shards by their leading bits. A shard is a minimal perfect hash and two arrays in its order: a 64-bit fingerprint, which tells
keys that are not in the index, and the number of rows that hold the line; with them goes the smallest id. It has
about SHARD_KEYS entries, however many there are in all.

Documents do not join lines. The digests of their lines go to the cells of their shard, each cell gets the
shard's arrays once and then takes probes as they come. A shard that meets many probes, because one line is in a third of all
documents, has as many cells as it takes to hold CELL_PROBES in each. What comes back are the places of lines to drop.

The perfect hash is a cascade of bit arrays: a level holds the keys that meet no other key in their bit, the rest go to the next
level, and a key's slot is the number of bits set before its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentguard.llm.flat import byte_batches, mix
from agentguard.llm.ngram_join import groups_of
from agentguard.llm.shared import bounded_batches, discard, stage, with_address

LEAST_CHARS = 10
SHARD_KEYS = 1 << 14
CELL_PROBES = 1 << 14
_BLANKS = b" \t\n\x0b\x0c\r"
_K = 0xD1B54A32D192ED03


# --- the perfect hash -------------------------------------------------------------------------


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + mix(b + np.uint64(level * _K % 2**64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct pairs of 64-bit numbers; -1, or any slot, for other pairs."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits) - bits

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(a):
            size = max(64, 2 * len(a))
            at = _places(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(sizes, np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        open_, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(a[open_], b[open_], level, size)
            found = self.bits[at] == 1
            out[open_[found]] = self.before[at[found]]
            open_, base = open_[~found], base + size
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits.astype(bool)).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=sum(sizes))
        return cls(list(sizes), bits.astype(np.int64))


# --- lines ------------------------------------------------------------------------------------


def line_keys(text: str, least: int) -> dict[bytes, list[int]]:
    """Digests of the keys of a text's lines that have at least `least` code points, each with the numbers of its lines."""
    out: dict[bytes, list[int]] = {}
    for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(_BLANKS).lower()
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least):
            out.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(k)
    return out


def _line_table(placed: DataFrame, address: str, id_col: str, text_col: str, least: int) -> DataFrame:
    """(address, id, high, low, at) for each distinct key of each row."""
    slim = placed.select(F.col(address).alias("address"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        *slim.schema.fields[:2], T.StructField("high", T.LongType()), T.StructField("low", T.LongType()),
        T.StructField("at", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text"):
            rows, digests, at = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    keys = line_keys(text, least)
                    rows += [row] * len(keys)
                    digests += keys.keys()
                    at += keys.values()
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            own = batch.select(["address", "id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(at, pa.list_(pa.int32()))],
                names=schema.names)

    return bounded_batches(slim).mapInArrow(run, schema)


# --- the index --------------------------------------------------------------------------------


def build_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """A row per shard: shard, sizes and bits of its perfect hash, fingerprints, held (rows), keepers (ids), probes; and the bits that tell the shard."""
    held = lines.groupBy("high", "low").agg(
        F.min("id").alias("keeper"), F.max("id").alias("top"), F.count(F.lit(1)).alias("held"), F.count("id").alias("named"))
    repeated = stage(held.where("keeper < top OR (named > 0 AND named < held)").select("high", "low", "keeper", "held"), "lines-repeated")
    bits = max(1, math.ceil(math.log2(max(1, repeated.count()) / SHARD_KEYS)))
    id_type = lines.schema["id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("sizes", T.ArrayType(T.IntegerType(), False)), T.StructField("bits", T.BinaryType()),
        T.StructField("fingerprints", T.BinaryType()), T.StructField("held", T.BinaryType()), T.StructField("keepers", T.ArrayType(id_type))])

    def run(batches):
        import pyarrow as pa

        for group in groups_of(batches, 1):
            a, b = (group.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
            hashed = PerfectHash.build(a, b)
            order = np.argsort(hashed.slots(a, b))
            keepers = group.column("keeper").chunk(0).take(pa.array(order))
            counts = np.minimum(group.column("held").to_numpy()[order], 2**32 - 1).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [group.column("shard").chunk(0).slice(0, 1), pa.array([hashed.sizes], pa.list_(pa.int32())), pa.array([hashed.packed()], pa.binary()),
                 pa.array([b[order].astype("<u8").tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(keepers)], pa.int32()), keepers)], names=schema.names)

    dealt = repeated.withColumn("shard", F.shiftrightunsigned("high", 64 - bits)).select("shard", "high", "low", "keeper", "held")
    built = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)
    probes = lines.groupBy(F.shiftrightunsigned("high", 64 - bits).alias("shard")).agg(F.count(F.lit(1)).alias("probes"))
    index = stage(built.join(probes, "shard"), "lines-index")
    discard(repeated)
    return index, bits


def _probe(lines: DataFrame, index: DataFrame, bits: int) -> DataFrame:
    """(address, at, held) of the lines to drop: in the index, and kept in another document."""
    cells = F.ceil(F.col("probes") / CELL_PROBES).cast("int")
    parts = index.select("shard", cells.alias("cells"))
    dealt = lines.withColumn("shard", F.shiftrightunsigned("high", 64 - bits)).join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("address", "low"), F.col("cells")).cast("int").alias("cell"), "address", "id", "high", "low", "at")
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"),
        F.struct("sizes", "bits", "fingerprints", "held", "keepers").alias("index"))
    both = arrays.unionByName(dealt, allowMissingColumns=True).repartition("shard", "cell").sortWithinPartitions(
        "shard", "cell", F.col("index").isNull())
    schema = T.StructType([lines.schema["address"], lines.schema["at"], T.StructField("held", T.LongType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        hashed = prints = counts = keepers = None
        for batch in batches:
            loads = np.flatnonzero(batch.column("index").is_valid().to_numpy(zero_copy_only=False)).tolist()
            cuts = sorted({0, *loads, batch.num_rows})
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low in loads:
                    row = batch.column("index")[low]
                    hashed = PerfectHash.unpacked(row["sizes"].as_py(), row["bits"].as_py())
                    prints = np.frombuffer(row["fingerprints"].as_py(), dtype="<u8")
                    counts = np.frombuffer(row["held"].as_py(), dtype="<u4").astype(np.int64)
                    keepers = row["keepers"].values
                    low += 1
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                a, b = (part.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
                slots = hashed.slots(a, b)
                known = np.flatnonzero(slots >= 0)
                known = known[prints[slots[known]] == b[known]]
                own = pc.fill_null(pc.equal(part.column("id").take(pa.array(known)), keepers.take(pa.array(slots[known]))), False)
                drop = known[~own.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("address").take(pa.array(drop)), part.column("at").take(pa.array(drop)), pa.array(counts[slots[drop]])], names=schema.names)

    return bounded_batches(both).mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, most_held (rows that hold the most frequent dropped line; 0 if none), kept (text).

    Lines end at \\n; a null or empty text is one empty line. Lines with equal keys of at least `least_chars` code points, in at least
    two documents, stay in the document with the smallest id alone, there as often as they stand. Rows that repeat an id are
    one document; null ids are greater than others, and all rows without an id are one document. The lines that stay keep their order, white
    space and case. An empty table gives an empty result; other columns are not read.
    """
    placed, address = with_address(docs.select(id_col, text_col), "lines-documents")
    lines = stage(_line_table(placed, address, id_col, text_col, least_chars), "lines")
    index, bits = build_index(lines)
    hits = _probe(lines, index, bits).groupBy("address").agg(F.flatten(F.collect_list("at")).alias("dropped"), F.max("held").alias("most"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(text, "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "dropped")
    found = placed.join(hits, placed[address] == hits["address"], "left").select(id_col, text.alias("text"), parts.alias("parts"), "dropped", "most")
    return found.select(
        F.col(id_col), F.size("parts").cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.coalesce("most", F.lit(0).cast("long")).alias("most_held"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(rest, lambda k: F.get("parts", k)), "\n")).alias("kept"))
