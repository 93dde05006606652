"""Near-duplicates by SimHash, linked by meet-in-the-middle ball hashing.

A fingerprint is the majority of the bits of the hashes of a text's shingles.  Two fingerprints link at ``RADIUS`` (3) or
fewer differing bits.  Every distinct fingerprint emits all variants within half that radius, and fingerprints that share
a variant are candidates.  Half of three is one and a half; which of the two a fingerprint uses follows from its parity:

* fingerprints at distance 1 or 3 have different parity.  Even ones emit their variants with two flipped bits, odd ones
  those with one: three differing bits split into two and one.  Two of any three bits lie in the same half of the 64,
  so pairs of flips inside a half are enough;
* fingerprints at distance 2 have the same parity and share a variant with one flipped bit of each.

All fingerprints that share a variant are linked to one of them (verified to be within the radius) that the construction
puts within the radius of all others, so a variant shared by many costs no more links than it has fingerprints.

Shuffled are not the variants but the fingerprints: ``b`` of a variant's bits name its bucket, and a fingerprint goes to
each bucket that some variant of it falls in (1 + b for an odd one, 1 + b + b(b-1)/2 for an even one), where the variants
of that bucket are generated, sorted and compared.  b grows with the logarithm of the number of fingerprints, so that a
bucket holds about ``BUCKET_VARIANTS`` variants.  A bucket returns a spanning forest of its links; the forests are joined
by contraction.  Equal fingerprints are merged before, by an aggregation that combines on the map side.

Defined cases: a null, empty or blank text has fingerprint 0 and links like any other; fewer words than a shingle: the
whole sequence is hashed; equal doc_ids are separate rows of one class; null doc_ids get a class but never name one unless
all are null; an empty table gives an empty result; other columns are ignored by ``near_duplicates`` and kept untouched
by ``drop_near_duplicates``.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, look_up, materialize, slices, table
from .components import contract, local_roots

BITS = 64
HALF = 32
RADIUS = 3
#: Variants that a bucket is meant to hold; with 13 bytes each this bounds a task's memory.
BUCKET_VARIANTS = 2_000_000
#: Mean number of variants of an even and an odd fingerprint.
MEAN_VARIANTS = (1 + 64 + 2 * (32 * 31 // 2) + 1 + 64) / 2


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a whole text, given as UTF-8; A-Z count as a-z, words are split as bytes.split does."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += (np.ones(len(part), dtype=np.float32) @ part.astype(np.float32)).astype(np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", shingle, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)]


def _pair_flips(bits: range) -> np.ndarray:
    return np.array([(1 << i) | (1 << j) for i, j in itertools.combinations(bits, 2)], dtype=np.uint64)


def bucket_links(fps: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints by the variants that fall in this bucket, as a spanning forest (index pairs)."""
    low = np.uint64((1 << bits) - 1)
    away = np.bitwise_count((fps ^ np.uint64(bucket)) & low)
    here = (fps & ~low) | np.uint64(bucket)  # each fingerprint with the flips made that lead to this bucket
    odd = np.bitwise_count(fps) % 2 == 1
    rest = np.array([1 << i for i in range(bits, BITS)], dtype=np.uint64)
    rest_low = np.array([1 << i for i in range(bits, HALF)], dtype=np.uint64)
    pairs = np.concatenate([_pair_flips(range(bits, HALF)), _pair_flips(range(HALF, BITS))])
    none = np.zeros(1, dtype=np.uint64)
    #: (which fingerprints, flips still to make, whether all others at a variant are within the radius of these)
    plans = [
        ((away <= 1) & odd, none, True), ((away == 0) & odd, rest, True),
        ((away <= 1) & ~odd, none, True), ((away == 0) & ~odd, rest, True),
        ((away == 2) & ~odd, none, False), ((away == 1) & ~odd, rest_low, False), ((away == 0) & ~odd, pairs, False),
    ]
    keys, who, centre = [], [], []
    for which, flips, central in plans:
        at = np.flatnonzero(which)
        keys.append((here[at][:, None] ^ flips[None, :]).ravel())
        who.append(np.repeat(at.astype(np.int32), len(flips)))
        centre.append(np.full(len(at) * len(flips), central))
    key, who, centre = np.concatenate(keys), np.concatenate(who), np.concatenate(centre)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)
    key, order = key[shared], order[shared]
    who, centre = who[order], centre[order]
    # centres first, odd ones before even ones: an odd one is within the radius of all, an even one of all but by two flips
    rank = np.where(odd[who], 0, np.where(centre, 1, 2))
    order = np.lexsort((rank, key))
    key, who, centre = key[order], who[order], centre[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    a, b = who[start], who
    near = (a != b) & centre[start] & (np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS)
    a, b = a[near], b[near]
    root = local_roots(len(fps), a, b)
    tied = np.flatnonzero(root != np.arange(len(fps)))
    return tied, root[tied]


def bucket_bits(n: int) -> int:
    """How many bits name a bucket, for n distinct fingerprints."""
    return min(HALF, max(4, math.ceil(math.log2(max(1, n) * MEAN_VARIANTS / BUCKET_VARIANTS))))


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(u, v) edges that connect exactly the distinct fingerprints ``fp`` that links connect."""
    bits = bucket_bits(n)
    masks = {k: F.array(*[F.lit(m).cast("long") for m in _masks(bits, k)]) for k in (1, 2)}
    even = F.bit_count("fp") % 2 == 0
    mine = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    sent = distinct.select("fp", F.explode(F.when(even, masks[2]).otherwise(masks[1])).alias("mask")).select("fp", mine.bitwiseXOR(F.col("mask")).alias("bucket"))

    def run(key, got):
        fps = got.column("fp").to_numpy().view(np.uint64)
        a, b = bucket_links(fps, key[0].as_py(), bits)
        return pa.table({"u": fps[a].view(np.int64), "v": fps[b].view(np.int64)})

    return sent.groupBy("bucket").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id that links reach."""
    rows = materialize(fingerprints(docs, text, id, shingle, seed), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = contract(links(distinct.select("fp"), distinct.count())).select(F.col("node").alias("fp"), "root")
    classes = materialize(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(look_up(classes.select("fp", "root"), "root", smallest).select("fp", "component_id"), "named")
    return look_up(rows, "fp", named, distinct.select("fp", "n")).select("doc_id", "fp", "component_id")


# --- near copies: several short fingerprints --------------------------------------------------------------------------
#
# Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.  A pair at 0.8 differs
# in about 15 % of SimHash bits, 10 of 64: far beyond a radius of three.  It is within three of 32 bits with a probability
# of 0.27 or more, and so in at least one of twenty independent fingerprints of 32 bits with one of 0.998.  Pairs that meet
# in a fingerprint are candidates if the bits of five longs agree so far; the classes that candidates make are then taken
# apart again by the similarity of the sets themselves.

SKETCH = 10  # longs; two fingerprints of 32 bits in each
#: A bucket holds the fingerprints of OWN longs, and compares by these and those that follow, FILTER in all.
OWN, FILTER = 2, 5
#: Differing bits of FILTER longs up to which texts are candidates: a similarity of 0.8 is at 48 (standard deviation 6.4).
SKETCH_RADIUS = 72
#: A bucket's variants are made and compared in parts, by that many further bits, to bound a task's memory.
PART_BITS = 2
#: Texts of a candidate class that are compared in one task; those of a larger class that go to all its tasks; and those
#: that are compared with a whole class at once.
CLASS, LEADERS, ASKED = 64, 16, 32
#: Bitmaps of row numbers that are broadcast at most: 16 MB.
MOST_MAPS = 4_096
SHORT, SHORT_HALF = 32, 16
SHORT_VARIANTS = (1 + 32 + 2 * (16 * 15 // 2) + 1 + 32) / 2


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; words and case as for ``fingerprint``."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g) for g in grams], dtype=np.uint64))


def sketch(h: np.ndarray) -> list[int]:
    """SKETCH independent 64-bit SimHashes of a set of hashes."""
    ones = np.zeros((SKETCH, BITS))
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        count = np.ones(len(part), dtype=np.float32)
        for k in range(SKETCH):
            x = part + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ones[k] += count @ np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    return np.packbits(ones * 2 > len(h), axis=1).view(np.int64)[:, 0].tolist()


def short_variants(fps: np.ndarray, bucket: int, bits: int) -> np.ndarray:
    """Sorted variants of 32-bit fingerprints that fall in a bucket, each with its fingerprint's index in the low 32 bits."""
    low = np.uint64((1 << bits) - 1)
    away = np.bitwise_count((fps ^ np.uint64(bucket)) & low)
    here = (fps & ~low) | np.uint64(bucket)
    odd = np.bitwise_count(fps) % 2 == 1
    none = np.zeros(1, dtype=np.uint64)
    rest = np.array([1 << i for i in range(bits, SHORT)], dtype=np.uint64)
    rest_low = np.array([1 << i for i in range(bits, SHORT_HALF)], dtype=np.uint64)
    pairs = np.concatenate([_pair_flips(range(bits, SHORT_HALF)), _pair_flips(range(SHORT_HALF, SHORT))])
    out = []
    for which, flips in ((away <= np.where(odd, 1, 2), none), (away == 0, rest), ((away == 1) & ~odd, rest_low), ((away == 0) & ~odd, pairs)):
        at = np.flatnonzero(which).astype(np.uint64)
        out.append((((here[at.astype(np.int64)][:, None] ^ flips[None, :]) << np.uint64(32)) | at[:, None]).ravel())
    out = np.concatenate(out)
    out.sort()
    return out


def verified_links(fps: np.ndarray, sketches: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among texts whose short fingerprints share a variant in this bucket, verified by sketch; a spanning forest.

    Of those that share a variant one is drawn, by a hash of the variant, compared with all others that no link connects
    with it yet, and put aside; the rest draw again until links connect all of them.  So all pairs are compared that links
    don't connect anyhow: being near is not transitive, and those near the drawn one may be near to some that it is not.
    """
    packed = short_variants(fps, bucket, bits)
    same = packed[1:] >> np.uint64(32) == packed[:-1] >> np.uint64(32)
    packed = packed[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(packed) else packed
    key, who = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    root, turn = np.arange(len(fps)), 1
    while len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        apart = np.repeat(np.minimum.reduceat(root[who], first) != np.maximum.reduceat(root[who], first), size)
        key, who = key[apart], who[apart]
        if not len(key):
            break
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        drawn = first + ((key[first] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) * np.uint64(turn) % size.astype(np.uint64)).astype(np.int64)
        lead = who[np.repeat(drawn, size)]
        open_ = np.flatnonzero(root[lead] != root[who])
        near = np.zeros(len(open_), dtype=bool)
        for at in range(0, len(open_), 1 << 20):
            part = open_[at : at + (1 << 20)]
            near[at : at + (1 << 20)] = np.bitwise_count(sketches[lead[part]] ^ sketches[who[part]]).sum(axis=1) <= SKETCH_RADIUS
        linked = open_[near]
        if len(linked):
            # the classes so far, joined by the new links
            root = local_roots(len(fps), root[lead[linked]], root[who[linked]])[root]
        key, who, turn = np.delete(key, drawn), np.delete(who, drawn), turn + 2
    tied = np.flatnonzero(root != np.arange(len(fps)))
    return tied, root[tied]


def similar_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the sets that similarities of 0.8 or more connect.

    Each set in turn is compared with the later ones that no link connects with it yet.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    start = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, root = np.zeros(len(values), dtype=bool), np.arange(n)
    a, b = [], []
    for i in range(n - 1):
        later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        later = later[5 * np.minimum(size[later], size[i]) >= 4 * np.maximum(size[later], size[i])]
        if not len(later):
            continue
        mine = flat[start[i] : start[i] + size[i]]
        mark[mine] = True
        for part in np.split(later, np.flatnonzero(np.diff(np.cumsum(size[later]) >> 22)) + 1):
            if not len(part):
                continue
            first = np.cumsum(size[part]) - size[part]
            both = np.add.reduceat(mark[flat[np.arange(size[part].sum()) + np.repeat(start[part] - first, size[part])]], first, dtype=np.int64)
            near = part[9 * both >= 4 * (size[i] + size[part])]  # both / (sum of sizes - both) >= 4 / 5
            a.append(np.full(len(near), i))
            b.append(near)
            if len(near):
                root[np.isin(root, root[near])] = root[i]
        mark[mine] = False
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links_between(sets: list[np.ndarray], asking: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking set, other set) of all similarities of 0.8 or more between the sets that ask and the others, other parts only."""
    asks, others = np.flatnonzero(asking), np.flatnonzero(~asking)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    values = np.concatenate([sets[i] for i in others]) if len(others) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(others)), size[others])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in asks:
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        both = np.bincount(owner[at], minlength=len(others))
        near = others[(both > 0) & (9 * both >= 4 * (size[i] + size[others])) & (part[others] != part[i])]
        a.append(np.full(len(near), i))
        b.append(near)
    return np.concatenate(a), np.concatenate(b)


def _picked(marked: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``marked`` whose number ``row`` is in the one column of ``wanted``.

    Up to ``MOST_MAPS`` bitmaps, 4 KB for 32,768 numbers, are sent to the texts; if there are more, texts are shuffled.
    """
    number = F.col(wanted.columns[0])
    maps = wanted.groupBy(F.bitmap_bucket_number(number).alias("map_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("map_bits"))
    maps = materialize(maps, "maps")
    if maps.count() > MOST_MAPS:
        return marked.join(wanted.select(number.alias(row)).distinct(), row, "left_semi")
    bucket, bits = fresh(marked, "map_bucket"), fresh(marked, "map_bits")
    maps = maps.select(F.col("map_bucket").alias(bucket), F.col("map_bits").alias(bits))
    at = F.bitmap_bit_position(F.col(row))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return marked.join(F.broadcast(maps), F.bitmap_bucket_number(F.col(row)) == F.col(bucket)).where(here).select(*[F.col(f"`{c}`") for c in marked.columns])


def _linked_rows(marked: DataFrame, text: str, row: str, loose: DataFrame, shingle: int) -> DataFrame:
    """(node, root): what similarities of 0.8 or more connect inside the candidate classes ``loose`` (node, root).

    A class of up to ``CLASS`` texts is compared in one task.  A larger one is dealt into chunks of about that many; some
    ``LEADERS`` of its texts go to every chunk.  What the links so far leave outside of the largest part of a class is then
    compared, in blocks of about ``ASKED``, with all its chunks: a link not found yet has an end there.  So all links are
    found that others don't imply, in tasks of bounded size; the cost of a class is its size times what its largest part
    leaves out.
    """
    sizes = loose.groupBy("root").agg(F.count("*").alias("n"))
    placed = look_up(loose, "root", sizes, sizes).withColumn("chunks", F.ceil(F.col("n") / CLASS))
    placed = materialize(placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))), "candidate-classes")
    texts = _picked(marked.select(F.col(row).alias("node"), F.col(text).alias("text")), "node", loose.select("node"))

    def sets_of(got):
        return [shingle_set(t or b"", shingle) for t in got.column("text").cast(pa.binary()).to_pylist()]

    def compare(key, got):
        a, b = similar_links(sets_of(got))
        node = got.column("node").to_numpy()
        return pa.table({"u": node[a], "v": node[b]})

    leads = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit("leader"), "node"), F.ceil(F.col("n") / LEADERS)) == 0)
    dealt = texts.join(placed, "node").withColumn("chunk", F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))))
    parts = contract(dealt.groupBy("root", "chunk").applyInArrow(compare, "u long, v long")).select("node", F.col("root").alias("part"))
    parts = materialize(placed.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")

    large = parts.where("chunks > 1")
    of_part = large.groupBy("root", "part").agg(F.count("*").alias("n"))
    largest = of_part.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("top"), (F.sum("n") - F.max("n")).alias("left_out"))
    largest = materialize(largest.where("left_out > 0"), "largest-parts")
    if largest.isEmpty():
        return parts.select("node", F.col("part").alias("root"))
    asking = look_up(large.select("node", "root", "part", "chunks", "chunk"), "root", largest).where("left_out > 0")
    blocks = F.ceil(F.col("left_out") / ASKED)
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    heard = F.transform(up_to(blocks), lambda b: F.struct(F.col("chunk").alias("chunk"), b.alias("block"), F.lit(False).alias("asks")))
    asks = F.transform(up_to(F.col("chunks")), lambda c: F.struct(c.alias("chunk"), F.pmod(F.xxhash64(F.lit("block"), "node"), blocks).alias("block"), F.lit(True).alias("asks")))
    cells = texts.join(asking.select("node", "root", "part", F.when(F.col("part") != F.col("top"), F.concat(heard, asks)).otherwise(heard).alias("cells")), "node").select("root", "part", "text", F.explode("cells").alias("cell")).select("root", "part", "text", "cell.*")

    def ask(key, got):
        asking, part = got.column("asks").to_numpy(zero_copy_only=False), got.column("part").to_numpy()
        a, b = links_between(sets_of(got), asking, part)
        return pa.table({"u": part[a], "v": part[b]})

    joined = contract(cells.groupBy("root", "chunk", "block").applyInArrow(ask, "u long, v long")).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    return look_up(parts.select("node", "part"), "part", joined).select("node", F.coalesce("whole", "part").alias("root"))


def _row_classes(marked: DataFrame, text: str, row: str, shingle: int = 5) -> DataFrame:
    """(node, root) for every row of ``marked``, which has a number of its own in ``row``: the classes of near copies."""
    names = [f"s{k}" for k in range(SKETCH)]

    def run(batches):
        import xxhash

        for batch in slices(batches):
            digests, found = [], np.zeros((len(batch), SKETCH), dtype=np.int64)
            for k, t in enumerate(batch.column(1).cast(pa.binary())):
                h = shingle_set(t.as_py() or b"", shingle)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                found[k] = sketch(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *[pa.array(found[:, k]) for k in range(SKETCH)]], names=["row", "digest", *names])

    rows = marked.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(run, "row long, digest binary, " + ", ".join(f"{n} long" for n in names))
    rows = materialize(rows, "sketches")
    distinct = materialize(rows.groupBy("digest", *names).agg(F.min("row").alias("node"), F.count("*").alias("n")), "distinct-sketches")
    bits = min(SHORT_HALF - PART_BITS, max(2, math.ceil(math.log2(max(1, distinct.count()) * SHORT_VARIANTS / BUCKET_VARIANTS / 4))))
    masks = {k: F.array(*[F.lit(m).cast("long") for m in _masks(bits, k)]) for k in (1, 2)}

    def buckets(fp):
        flips = F.when(F.bit_count(fp) % 2 == 0, masks[2]).otherwise(masks[1])
        return F.transform(flips, lambda m: fp.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(m))

    sent = None
    filters = [f"f{k}" for k in range(FILTER)]
    for tab, at in enumerate(range(0, SKETCH, OWN)):
        shorts = [x for n in names[at : at + OWN] for x in (F.shiftrightunsigned(n, 32), F.col(n).bitwiseAND(F.lit(0xFFFFFFFF)))]
        columns = [F.col(names[(at + k) % SKETCH]).alias(f) for k, f in enumerate(filters)]
        one = distinct.select("node", *columns, F.explode(F.array_distinct(F.concat(*map(buckets, shorts)))).alias("bucket")).withColumn("bucket", F.col("bucket") + (tab << bits))
        sent = one if sent is None else sent.unionByName(one)

    def link(key, got):
        sketches = np.stack([got.column(n).to_numpy() for n in filters], axis=1).view(np.uint64)
        links = [np.zeros((2, 0), dtype=np.int64)]
        for k in range(OWN):
            for fps in (sketches[:, k] >> np.uint64(32), sketches[:, k] & np.uint64(0xFFFFFFFF)):
                for part in range(1 << PART_BITS):
                    links.append(np.stack(verified_links(fps, sketches, key[0].as_py() % (1 << bits) | part << bits, bits + PART_BITS)))
        root = local_roots(len(sketches), *np.concatenate(links, axis=1))
        tied = np.flatnonzero(root != np.arange(len(root)))
        node = got.column("node").to_numpy()
        return pa.table({"u": node[tied], "v": node[root[tied]]})

    loose = materialize(contract(sent.groupBy("bucket").applyInArrow(link, "u long, v long")), "candidates")
    roots = _linked_rows(marked, text, row, loose, shingle)
    classes = materialize(distinct.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "digest-classes")
    return materialize(look_up(rows.select("row", "digest"), "digest", classes, distinct.select("digest", "n")).select(F.col("row").alias("node"), "root"), "copy-classes")


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    row = fresh(docs, "dedup_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-docs"), row


def near_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """(doc_id, component_id): classes of texts that similarities of 0.8 or more of their sets of shingles connect."""
    marked, row = _marked(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")))
    named = marked.select("doc_id", F.col(row).alias("node")).join(_row_classes(marked, "text", row, shingle), "node")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return look_up(named, "root", smallest).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of ``near_copies``: that of the smallest doc_id (nulls last, equal ones by their order in the input).

    Columns are unchanged.
    """
    marked, row = _marked(docs)
    named = _row_classes(marked, text, row).join(marked.select(F.col(row).alias("node"), F.col(id).alias("dedup_id")), "node")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("dedup_id").isNull().alias("none"), "dedup_id", "node"))["node"].alias("node"))
    return _picked(marked, row, first.select("node")).select(*[marked[c] for c in docs.columns])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Nulls, blank and very long texts, repeated and null doc_ids and an empty table: as the module states."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
