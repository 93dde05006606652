"""Token ids: encoding whole texts, and shards of raw ids with keyed access through a minimal perfect hash.

A shard is one row of a Parquet table: its raw id payload, the keys (doc_ids) and start offsets of its documents in
file order, and a minimal perfect hash from key to document with a stored fingerprint of each key, so that a lookup costs
a constant number of probes and an absent key is told apart but for one in 2**32.  The rows are written and read by
Spark, so any store that Spark reaches will do, a commit is whole or absent, and a lost executor costs a retry.

The hash is a cascade of bit arrays: a key takes the bit that a hash of it names if no other key does, else it goes on
to the next array; the rank of the bit taken is the key's slot.  Ranks are stored for every word of 64 bits, so nothing
is unpacked or counted when a shard is opened.  ``lookup`` reads the shards' key ranges, then the index columns of the
shards that can hold a key, and last, of the payload, the slices that the index names.

Defined cases: a null or empty text has no ids but the end id; rows with equal doc_ids keep their own ids, stand side by
side (by a hash of the text) and share one key, found as a run; a null doc_id comes first in the order and has no key; an
empty table makes no shard; a very long text is encoded in one piece and makes its shard longer; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, materialize, table

#: Ids in a shard, at least, unless the partition ends.
SHARD_IDS = 1_000_000
#: Distinct white-space-separated chunks whose ids a worker remembers, and their longest length.
REMEMBERED, LONGEST = 300_000, 48
#: Bytes of text that are encoded together, but for a longer single text.
TEXT_AT_ONCE = 2 << 20

_encoders: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts chunk by chunk with the tokenizers library, remembering the ids of chunks.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its chunks' ids in order.
    Special tokens hold no white space either.  A chunk of letters of Latin-1, which composition leaves as they are, and a
    mark at most is one or two pieces, which go to the model at once; the library's whole way is taken otherwise.
    """

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|]?)\\Z")
    #: The byte-level form of a text: visible bytes stand for themselves, the others for characters from U+0100 on.
    VISIBLE = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    BYTES = {b: chr(b) for b in VISIBLE} | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD))}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.BYTES)
        return struct.pack(f"<{len(found)}I", *found) if (found := [t.id for t in self.model.tokenize(piece)]) else b""

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that are not known."""
        out, rest = [b""] * len(chunks), []
        for i, chunk in enumerate(chunks):
            if plain := self.PLAIN.match(chunk):
                out[i] = self._piece(plain[1].lower()) + (self._piece(plain[2]) if plain[2] else b"")
            else:
                rest.append(i)
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = struct.pack(f"<{len(got.ids)}I", *got.ids)
        room = REMEMBERED - len(self.known)
        if room > 0:
            self.known.update((c, x) for c, x in zip(chunks[:room], out) if len(c) <= LONGEST)
        return out

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.known.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(missing, self._learn([distinct[i] for i in missing])):
            found[i] = x
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(upto[-1]) + np.repeat(start[codes] - upto[:-1], n)]
        words = lists.offsets.to_numpy()
        return ids, upto[words - words[0]]

    def encode_many(self, texts: pa.Array):
        """The ids of each text, null ones being empty, as arrays of unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy()) // TEXT_AT_ONCE
        for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(size)) + 1).tolist()], [*cuts[1:], len(texts)]):
            if b > a:
                ids, at = self._together(texts.slice(a, b - a))
                yield from np.split(ids, at[1:-1])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return next(self.encode_many(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- minimal perfect hash ---------------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of unsigned 64-bit keys, another one for each level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 64-bit keys onto 0..n-1; any other key to some slot or -1."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels  # for each bit array: its length, its words of 64 bits, and the ones before each word

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.5) -> "PerfectHash":
        left, levels, before = np.unique(keys), [], 0
        while len(left):
            size = max(64, int(len(left) * room))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=-(-size // 64) * 64) == 1
            words = np.packbits(bits, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append((size, words, (before + np.cumsum(ones) - ones).astype("<u4")))
            before += int(ones.sum())
            left = left[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = _mix(keys[open_], level) % np.uint64(size)
            word, bit = words[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = ranks[(at[hit] >> np.uint64(6)).astype(np.int64)] + np.bitwise_count(lower).astype(np.int64)
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def dump(self) -> bytes:
        sizes = [size for size, _, _ in self.levels]
        return struct.pack(f"<{1 + len(sizes)}I", len(sizes), *sizes) + b"".join(words.tobytes() + ranks.tobytes() for _, words, ranks in self.levels)

    @classmethod
    def load(cls, data: bytes) -> "PerfectHash":
        (n,) = struct.unpack_from("<I", data)
        at, levels = 4 * (n + 1), []
        for size in struct.unpack_from(f"<{n}I", data, 4):
            words = -(-size // 64)
            levels.append((size, np.frombuffer(data, "<u8", words, at), np.frombuffer(data, "<u4", words, at + 8 * words)))
            at += 12 * words
        return cls(levels)


# --- shards -----------------------------------------------------------------------------------------------------------

SHARD = "shard long, n_docs int, n_ids long, first_doc long, last_doc long, width int, keys binary, has_key binary, starts binary, hash binary, rows binary, prints binary, payload binary"


def _print(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000) >> np.uint64(32)).astype("<u4")


def build_shard(number: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> dict:
    """One shard's row.  doc_ids are in ascending order, nulls first."""
    given = np.array([d is not None for d in doc_ids], dtype=bool)
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8")
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i8")
    all_ids = np.concatenate(ids).astype("<u4")
    width = 2 if not len(all_ids) or all_ids.max() < 1 << 16 else 4
    distinct, first = np.unique(keys[given], return_index=True)
    distinct = distinct.view(np.uint64)
    perfect = PerfectHash.build(distinct)
    slots = perfect.slots(distinct)
    rows, prints = np.zeros(len(distinct), dtype="<u4"), np.zeros(len(distinct), dtype="<u4")
    rows[slots], prints[slots] = np.flatnonzero(given)[first], _print(distinct)
    return {
        "shard": number, "n_docs": len(keys), "n_ids": int(starts[-1]),
        "first_doc": int(distinct.view(np.int64).min()) if len(distinct) else None, "last_doc": int(distinct.view(np.int64).max()) if len(distinct) else None,
        "width": width, "keys": keys.tobytes(), "has_key": np.packbits(given).tobytes(), "starts": starts.tobytes(),
        "hash": perfect.dump(), "rows": rows.tobytes(), "prints": prints.tobytes(), "payload": all_ids.astype(f"<u{width}").tobytes(),
    }


class Shard:
    """A shard read back, with or without its payload."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.has_key = np.unpackbits(np.frombuffer(row["has_key"], np.uint8), count=len(self.keys)).astype(bool)
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.hash = PerfectHash.load(row["hash"])
        self.rows, self.prints = np.frombuffer(row["rows"], "<u4"), np.frombuffer(row["prints"], "<u4")
        self.payload = np.frombuffer(row.get("payload") or b"", f"<u{row['width']}")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, -1 where the shard has none."""
        keys = np.asarray(keys, dtype=np.int64).view(np.uint64)
        slots = self.hash.slots(keys)
        hit = slots >= 0
        hit[hit] = self.prints[slots[hit]] == _print(keys[hit])
        out = np.full(len(keys), -1, dtype=np.int64)
        out[hit] = self.rows[slots[hit]]
        return out

    def ids(self, doc: int) -> np.ndarray:
        """Ids of the document at this place in the shard."""
        return self.payload[self.starts[doc] : self.starts[doc + 1]].astype("<u4")


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 1, shard_ids: int = SHARD_IDS, tag: str = "tokens") -> DataFrame:
    """Encodes every text, adds the end id, and writes shards in ascending doc_id order; returns the table read back.

    Shard numbers ascend with doc_id.  Texts are dealt by ranges of doc_id, the only shuffle.
    """
    path = path or vocabulary()
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        enc, part, made, doc_ids, ids, held = encoder(path), None, 0, [], [], 0
        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1))):
                doc_ids.append(doc_id)
                ids += [np.concatenate([found, end])]
                held += len(ids[-1])
                # documents of equal doc_id may end up in neighbouring shards, as they may in neighbouring partitions
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pylist([build_shard((part << 32) + made, doc_ids, ids)], schema=layout)
                    made, doc_ids, ids, held = made + 1, [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_pylist([build_shard((part << 32) + made, doc_ids, ids)], schema=layout)
        give_back()

    layout = _arrow(SHARD)
    # equal doc_ids, nulls among them, may be many: the hash of the text lets them go to several partitions
    order = ("doc_id", F.xxhash64("text"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, SHARD), tag)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, start): ids in all shards before each; a shard holds a million ids or so, so one task can order them."""
    return shards.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(shard, doc_id, offset, n_tokens, ids_crc32) of every document, each looked up in its shard by its key."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                # each key is looked up; further documents of the same key follow the first
                found = shard.find(shard.keys)
                place = np.arange(len(shard.keys))
                same = np.concatenate([[False], (shard.keys[1:] == shard.keys[:-1]) & shard.has_key[1:] & shard.has_key[:-1]]) if len(place) else np.zeros(0, bool)
                run_start = np.maximum.accumulate(np.where(same, 0, place)) if len(place) else place
                place = np.where(shard.has_key, found + place - run_start, place)
                sums = [zlib.crc32(shard.ids(p).tobytes()) for p in place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), row["shard"], dtype=np.int64)), pa.array(shard.keys, mask=~shard.has_key), pa.array(shard.starts[place]), pa.array(shard.starts[place + 1] - shard.starts[place]), pa.array(sums, pa.int64())],
                    names=["shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the first document of each of a given list of keys.

    Three narrow reads: key ranges of all shards; the index columns of the shards in whose range a key lies; the payload
    of those that hold one, cut to the documents' slices where it is read.  What reaches the driver is, for each key, a
    few numbers.
    """
    spark = shards.sparkSession
    wanted = np.array(sorted(set(doc_ids)), dtype=np.int64)

    def probe(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                at = shard.find(wanted)
                hit = np.flatnonzero(at >= 0)
                start = shard.starts[at[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(wanted[hit]), pa.array(np.full(len(hit), row["shard"])), pa.array(start), pa.array(shard.starts[at[hit] + 1] - start), pa.array(np.full(len(hit), row["width"]))], names=["doc_id", "shard", "offset", "n", "width"])

    nothing = spark.createDataFrame([], "doc_id long, ids array<long>")
    if not len(wanted):
        return nothing
    within = F.exists(F.array(*map(F.lit, wanted.tolist())), lambda k: k.between(F.col("first_doc"), F.col("last_doc")))
    able = [r[0] for r in shards.select("shard", "first_doc", "last_doc").where(within).select("shard").collect()]
    if not able:
        return nothing
    index = shards.where(F.col("shard").isin(able)).select("shard", "width", "keys", "has_key", "starts", "hash", "rows", "prints")
    found = index.mapInArrow(probe, "doc_id long, shard long, offset long, n long, width long")
    first = sorted(tuple(r) for r in found.groupBy("doc_id").agg(F.min(F.struct("shard", "offset", "n", "width")).alias("x")).select("doc_id", "x.*").collect())
    if not first:
        return nothing
    slices = F.array(*[F.struct(*[F.lit(int(x)).alias(n) for x, n in zip(r, ("doc_id", "in_shard", "offset", "n", "width"))]) for r in first])
    held = shards.where(F.col("shard").isin(sorted({r[1] for r in first}))).select("shard", "payload", F.explode(F.filter(slices, lambda x: x["in_shard"] == F.col("shard"))).alias("x"))
    cut = held.select("x.doc_id", "x.width", F.substring("payload", (F.col("x.offset") * F.col("x.width") + 1).cast("int"), (F.col("x.n") * F.col("x.width")).cast("int")).alias("raw"))

    def unpack(batches):
        for batch in batches:
            ids = [np.frombuffer(raw.as_buffer(), f"<u{width}").astype(np.int64) for raw, width in zip(batch.column(2), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return cut.select(F.col("doc_id").cast("long"), "width", "raw").mapInArrow(unpack, "doc_id long, ids array<long>")


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and very long texts, repeated and null doc_ids and an empty table: as the module states."""
    shards = write_shards(table(spark, sf_dir, "documents"))
    found = read_documents(shards).join(F.broadcast(shard_starts(shards)) if shards.count() <= 10_000 else shard_starts(shards), "shard")
    return found.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
