"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made row by row (no shuffle), and only distinct ones go on, so exact copies
cost one aggregation. Two words at most ``distance`` bits apart agree on at least one of
``distance + 1`` bands of bits (pigeonhole), so rows are grouped by band and each group is searched
by the Gray index of ``gray_index``, which reports a spanning forest of the links, never all
pairs. Groups above ``split`` members are dealt out again by bands of the bits that they do not share yet, which loses no link, up to
``LEVELS`` times: then members share so many bits that a group has at most about two million different fingerprints. Components follow by star contraction.

``near_duplicates`` links fingerprints of 64 bits, which tell texts apart that differ in more than a few words. ``near_copies`` is for texts
whose five-word shingles have a similarity of 0.8 or more: its fingerprints have ``words`` times 64 bits, and at 0.8 two differ in 15 % of them on average. Rows are
grouped by bands of ``band`` bits, and each group is searched by the same index for pairs at most ``distance`` bits apart. Bands miss a pair at 0.8 once in
twenty times or so. Groups above ``split`` members are dealt out as pairs of blocks, which loses no link.

Defined cases: null text and text without words have fingerprint zero and link like any other;
texts of any length are read whole, in blocks of words, so memory follows the block; repeated rows come back as often as they went in; a null id keeps its row and never becomes a
component id (a component of null ids alone has a null id); an empty table gives an empty
result; columns besides id and text are ignored, whatever their names, and ``keep_one`` keeps them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, new_folder, stage, table
from .components import connected_components
from .gray_index import Forest, GrayIndex, small_groups

SEED = 42
SHINGLE = 3
DISTANCE = 3
SMALL_GROUP = 48
SPLIT = 20_000
LEVELS = 4
#: For near copies: words of a shingle, 64-bit words of a fingerprint, bits of a band, and the bits in which copies may differ.
COPY_SHINGLE, COPY_WORDS, COPY_BAND, COPY_DISTANCE = 5, 4, 12, 48
# The constants of the SplitMix64 generator.
SPLIT_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def text_hashes(text: str | None, shingle: int = SHINGLE, size: int = 4 << 20) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``shingle`` words, repeats included, in blocks of about ``size`` bytes of text."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only, and ASCII space only
    held: list[bytes] = []  # words that the next block's first shingles begin with
    total = start = 0
    while start < len(data):
        gap = SPACE.search(data, start + size)
        stop = gap.start() if gap else len(data)
        fresh = data[start:stop].split()
        words, start = held + fresh, stop
        total += len(fresh)
        if len(words) >= shingle:
            yield _hashes(words, shingle)
            held = words[len(words) - shingle + 1 :]
        else:
            held = words
    if 0 < total < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def distinct_hashes(text: str | None, shingle: int) -> list[np.ndarray]:
    """XXH64 of the different shingles, so that a line said a thousand times counts once."""
    blocks = list(text_hashes(text, shingle))
    return [np.unique(np.concatenate(blocks))] if blocks else []


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = (ends - sizes).tolist(), ends.tolist()[shingle - 1 :]
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), dtype=np.uint64, count=len(stops))


def fold(blocks: Iterable[np.ndarray], size: int = 1 << 18) -> int:
    """The fingerprint: bit k is 1 if it is set in over half of the hashes."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        total += len(hashes)
        for i in range(0, len(hashes), size):
            part = hashes[i : i + size].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` times 64 bits for each hash; the first word is the hash itself."""
    out = np.empty((len(hashes), words), dtype=np.uint64)
    out[:, 0] = hashes
    step, first, second = (np.uint64(c) for c in SPLIT_MIX)
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(1, words, dtype=np.uint64) * step
        x = (x ^ (x >> np.uint64(30))) * first
        x = (x ^ (x >> np.uint64(27))) * second
    out[:, 1:] = x ^ (x >> np.uint64(31))
    return out


def fold_wide(blocks: Iterable[np.ndarray], words: int, size: int = 1 << 16) -> list[int]:
    """The fingerprint's words, each as ``fold`` makes it of the mixed hashes."""
    counts, total = np.zeros(words * 64, dtype=np.int64), 0
    for hashes in blocks:
        total += len(hashes)
        for i in range(0, len(hashes), size):
            bits = np.unpackbits(_mixed(hashes[i : i + size], words).byteswap().view(np.uint8), axis=1)
            lanes = bits.view(np.uint64)  # eight counters of a byte each, which 255 rows cannot overflow
            for j in range(0, len(lanes), 255):
                counts += np.add.reduce(lanes[j : j + 255], axis=0).view(np.uint8)
    return [int.from_bytes(row.tobytes(), "big") for row in np.packbits((counts * 2 > total).reshape(words, 64), axis=1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` per row; fp is the 64-bit word as a signed long."""

    def rows(batch):
        for key, text in batch:
            yield key, signed(fold(text_hashes(text, shingle)))

    return map_rows(docs, rows, f"{id_col} bigint, fp bigint", [F.col(id_col).cast("bigint"), F.col(text_col).cast("string")])


def _bands(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``parts`` bands that cover ``width`` bits."""
    cuts = [round(i * width / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _finer(mask: int, parts: int) -> list[int]:
    """Masks of the bits of ``mask`` and one of ``parts`` bands of all others.

    Members of a group agree on the bits of its mask and differ in at most ``parts - 1`` of the others, so two that are linked agree on one of these
    masks as well.
    """
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[shift : shift + bits]) for shift, bits in _bands(len(rest), parts)]


def _dealt(frame: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """``(fp, mask, key)``: the rows of groups of ``masks`` in finer groups, each told by its mask and the bits under it."""
    options = None
    for mask in masks:
        finer = F.array(*[F.lit(signed(m)).cast("bigint") for m in _finer(mask, parts)])
        here = F.col("mask") == F.lit(signed(mask)).cast("bigint")
        options = F.when(here, finer) if options is None else options.when(here, finer)
    out = frame.select("fp", F.explode(options).alias("mask"))
    return out.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def search_sorted(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, node, words...)`` in order of key to the edges ``(u, v)`` of nodes within each key; without words the node is the fingerprint.

    Whole groups are worked on, many small ones at a time; only the group that crosses a batch is held back.
    """

    def edges(key: np.ndarray, node: np.ndarray, fps: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        out = []
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        if small.any():
            k, f, name = key[small], fps[small], node[small]
            pairs = small_groups(k, f, distance, int(sizes[sizes <= SMALL_GROUP].max()))
            if len(pairs):
                forest = Forest(len(k))
                forest.link(pairs[:, 0], pairs[:, 1])
                pairs = forest.spanning()
                out.append(np.stack([name[pairs[:, 0]], name[pairs[:, 1]]], axis=1))
        for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            name = node[s : s + n]
            pairs = GrayIndex(fps[s : s + n]).link(distance)
            out.append(np.stack([name[pairs[:, 0]], name[pairs[:, 1]]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)

    def batch(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(found), 65536):
            part = np.ascontiguousarray(found[i : i + 65536])
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        fps = np.stack([c.view(np.uint64) for c in columns[2:] or columns[1:]], axis=1)
        held.append((columns[0], columns[1], fps))
        if columns[0][-1] == held[0][0][0]:
            continue
        key, node, fps = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(key, key[-1]))
        yield from batch(edges(key[:cut], node[:cut], fps[:cut]))
        held = [(key[cut:], node[cut:], fps[cut:])]
    if held:
        yield from batch(edges(*(np.concatenate(x) for x in zip(*held))))


def links(distinct: DataFrame, distance: int = DISTANCE, split: int = SPLIT, folder: str | None = None) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints whose closure is the closure of all links."""
    parts = distance + 1
    masks = [0]
    dealt = _dealt(distinct.select("fp", F.lit(0).cast("bigint").alias("mask")), masks, parts)
    done = None
    for level in range(1, LEVELS):
        large = dealt.groupBy("mask", "key").count().where(F.col("count") > split).select("mask", "key", F.lit(True).alias("large"))
        large = stage(large, f"large-{level}", folder) if folder else large
        if large.isEmpty():
            break
        # At the first level there are at most parts * 2^16 groups with four bands; further down the list is joined as its size asks for.
        marked = dealt.join(F.broadcast(large) if level == 1 and parts == 4 else large, ["mask", "key"], "left")
        small = marked.where("large is null").select("fp", "mask", "key")
        done = small if done is None else done.unionByName(small)
        masks = sorted({m for mask in masks for m in _finer(mask, parts)})
        dealt = _dealt(marked.where("large").select("fp", "mask"), masks, parts)
    dealt = dealt if done is None else done.unionByName(dealt)
    # Groups that meet by a collision of this hash are searched together, which finds the same links.
    ordered = dealt.select(F.xxhash64("mask", "key").alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(lambda it: search_sorted(it, distance), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, split: int = SPLIT
) -> DataFrame:
    """One row per row of ``docs``: ``(id, fp, component_id)``."""
    spark = docs.sparkSession
    folder = new_folder(spark, "simhash")
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "prints", folder)
    nodes = stage(prints.groupBy("fp").agg(F.min(id_col).alias("node")), "nodes", folder)
    edges = links(nodes.select("fp"), distance, split, folder)
    labels = connected_components(edges).select(F.col("node").alias("fp"), "label")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # A label with other members needs their smallest id; all others are their own component.
    smallest = named.groupBy("label").agg(F.min("node").alias("component_id"))
    classes = stage(named.join(smallest, "label").select("fp", "component_id"), "classes", folder)
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, words: int = COPY_WORDS, band: int = COPY_BAND,
    distance: int = COPY_DISTANCE, split: int = SPLIT,
) -> DataFrame:
    """One row per row of ``docs``: ``(id, component_id)``, the smallest id among the near copies of a text."""
    folder = new_folder(docs.sparkSession, "copies")
    names = [f"w{i}" for i in range(words)]

    def rows(batch):
        for key, text in batch:
            yield key, *map(signed, fold_wide(distinct_hashes(text, shingle), words))

    schema = f"{id_col} bigint, " + ", ".join(f"{n} bigint" for n in names)
    prints = stage(map_rows(docs, rows, schema, [F.col(id_col).cast("bigint"), F.col(text_col).cast("string")]), "prints", folder)
    # Numbers of distinct fingerprints; written, so that they are the same whenever they are read.
    nodes = prints.groupBy(*names).agg(F.min(id_col).alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = stage(nodes, "nodes", folder)
    labels = connected_components(_copy_links(nodes, names, band, distance, split, folder))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = stage(labelled.join(smallest, "label").select(*names, "component_id"), "classes", folder)
    return prints.join(classes, names).select(id_col, "component_id")


def _copy_links(nodes: DataFrame, names: list[str], band: int, distance: int, split: int, folder: str) -> DataFrame:
    """Edges ``(u, v)`` between nodes that share a band and are at most ``distance`` bits apart, up to closure within each group."""
    each = 64 // band
    keys = [
        F.lit((w * each + i) << band).cast("bigint") + F.shiftrightunsigned(F.col(name), i * band).bitwiseAND(F.lit((1 << band) - 1))
        for w, name in enumerate(names)
        for i in range(each)
    ]
    # Texts without words are one node, and no copy of a text that has any.
    worded = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    keyed = nodes.where(worded).select("node", *names, F.explode(F.array(*keys)).alias("key"))
    # There are no more keys than bands times 2^band.
    large = keyed.groupBy("key").count().where(F.col("count") > split).select("key", F.ceil(F.col("count") / split).cast("int").alias("blocks"))
    marked = keyed.join(F.broadcast(stage(large, "large", folder)), "key", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))
    dealt = marked.select("key", "node", *names, F.explode(pairs).alias("p"))
    dealt = dealt.select(F.xxhash64("key", "p.a", "p.b").alias("key"), "node", *names)
    ordered = dealt.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(lambda it: search_sorted(it, distance), "u bigint, v bigint")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies left: that with the component's smallest id.

    An id names a document, so of several rows with one id one stays, that with the first text in order. Rows with a null id cannot be told apart, and all stay.
    """
    first = near_copies(docs).where("doc_id is not null").groupBy("doc_id")
    first = first.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("stays")
    first = stage(first.select("doc_id", "n"), "first")
    # The ids that stay are nearly all ids: they are never broadcast, at no size.
    named = lambda ids: docs.where("doc_id is not null").join(ids.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = first.where("n > 1")
    if repeated.isEmpty():
        out = named(first)
    else:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        out = named(first.where("n = 1")).unionByName(named(repeated).withColumn("_loomlog_n", place).where("_loomlog_n = 1").drop("_loomlog_n"))
    return out.unionByName(docs.where("doc_id is null"))
