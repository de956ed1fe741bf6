"""Benchmark decontamination with a broadcast hash set of test n-grams; DataFrame functions only.

Words are made inside the row. Each word position is looked up in a bit table of the benchmark's windows by a hash of four words
of its window, and what passes in a second table by a hash of all of them; both tables have a bounded size, are made by
an aggregate and reach the tasks as one value. They only ever let too much pass, so nothing is lost, and only windows that pass both
leave the row, with their words. These meet the true windows by hash and words, so neither hash collisions nor the tables' false
hits count. The set of windows is broadcast while it has at most ``broadcast_bytes`` bytes; beyond that the few windows
that passed are joined by a shuffle. The result is the same either way and at every size.

Defined cases: null or word-less text has no words and is never contaminated; empty benchmark
items have no windows; an item of fewer than ``n`` words is one window; rows of equal item_id are one item, and a
null item_id counts as the item ``''``; each input row gives one output row, repeated and
null ids included; texts of any length are read whole, in work and memory linear in their length; an empty table gives an
empty result; of other columns ``report`` returns none, whatever their names, and ``clean``, ``remove_spans`` and
``drop_contaminated`` keep all, but for ``_loomlog_*``, which are theirs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, new_folder, stage, table

N = 13
SHARE = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
#: Bits of a table for each window, and the least and most 64-bit words of a table. More windows than fit only let more pass.
BITS = 64
LEAST, MOST = 1 << 6, 1 << 20


def words(col):
    """The words of a text as an array; empty for null."""
    found = F.array_remove(F.split(lower_ascii(col.cast("string")), SEPARATORS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _anchor(w: str, at: str, k: int) -> str:
    """Hash of four words, spread over the window of ``k`` words at ``at``."""
    return f"xxhash64({', '.join(f'get({w}, {at} + {i})' for i in sorted({0, k // 3, 2 * k // 3, k - 1}))})"


class Windows(NamedTuple):
    """The benchmark's windows: ``(h, gram, len)``, ``(h, gram, item)``, their lengths, and two bit tables of one row each."""

    grams: DataFrame
    items: DataFrame
    lengths: list[int]
    slots: int
    anchors: DataFrame
    hashes: DataFrame
    bounded: bool


def windows(
    benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
    most: int = MOST, folder: str | None = None,
) -> Windows:
    """Each distinct window of the items, staged, and what finds it."""
    folder = folder or new_folder(benchmark.sparkSession, "windows")
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), words(F.col(f"`{text_col}`")).alias("w")
    ).where(F.size("w") > 0)
    spread = items.select(
        "item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n}))")).alias("g")
    )
    members = spread.select(F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram"), "item").distinct()
    members = stage(members, "members", folder)
    grams = members.select("h", "gram", F.size(F.split("gram", " ")).alias("len")).distinct()
    # One row: at most n lengths, and two sums.
    lengths, count, size = grams.agg(F.array_sort(F.collect_set("len")), F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("gram") + 24), F.lit(0))).first()
    slots = LEAST
    while slots < most and slots * 64 < BITS * count:
        slots *= 2
    w = grams.withColumn("w", F.split("gram", " "))
    anchor = F.lit(None).cast("bigint")
    for k in lengths:
        anchor = F.when(F.col("len") == k, F.expr(_anchor("w", "0", k))).otherwise(anchor)
    return Windows(grams, members, lengths, slots, _bit_table(w.select(anchor.alias("h")), slots), _bit_table(grams, slots), size <= broadcast_bytes)


def _bit_table(hashes: DataFrame, slots: int) -> DataFrame:
    """One row with an array of ``slots`` 64-bit words in which the bit of each hash is set."""
    spark = hashes.sparkSession
    held = hashes.select(F.expr(f"shiftright(h, 6) & {slots - 1}L").alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    held = held.groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    every = spark.range(slots).join(held, F.col("id") == F.col("slot"), "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("x"))
    return every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits"))


def _passing(bits: str, x: str, slots: int) -> str:
    return f"getbit(get({bits}, cast((shiftright({x}.h, 6) & {slots - 1}L) as int)), cast({x}.h & 63 as int)) = 1"


def _candidates(lengths: list[int], slots: int) -> str:
    """``array<struct<pos, len, h, gram>>`` of the windows of ``w`` that pass both bit tables.

    Each table is named once, so that the optimizer puts its value in the lambda and does not copy it into rows.
    """
    places = ", ".join(
        f"transform(case when size(w) >= {k} then sequence(0, size(w) - {k}) else cast(array() as array<int>) end,"
        f" i -> named_struct('pos', i, 'len', {k}, 'h', {_anchor('w', 'i', k)}))"
        for k in lengths
    )
    near = f"filter(concat({places}), x -> {_passing('_anchors', 'x', slots)})"
    hashed = f"transform({near}, x -> named_struct('pos', x.pos, 'len', x.len, 'h', xxhash64(slice(w, x.pos + 1, x.len))))"
    passed = f"filter({hashed}, x -> {_passing('_hashes', 'x', slots)})"
    return f"transform({passed}, x -> named_struct('pos', x.pos, 'len', x.len, 'h', x.h, 'gram', array_join(slice(w, x.pos + 1, x.len), ' ')))"


def hits(docs: DataFrame, known: Windows, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Per row of ``docs``: id, text_md5, n_words, spans (merged word ranges hit, end exclusive), items (sorted strings)."""
    folder = folder or new_folder(docs.sparkSession, "decontaminate")
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{id_col}`").alias(id_col),
        F.md5(text.cast("binary")).alias("text_md5"),
        words(text).alias("w"),
    )
    empty = "cast(array() as array<struct<pos:int,len:int,h:bigint,gram:string>>)"
    found = _candidates(known.lengths, known.slots) if known.lengths else empty
    # The uid keeps this projection apart from the one below, where the tables' values take the place of their names.
    rows = rows.withColumns({"_anchors": known.anchors.scalar(), "_hashes": known.hashes.scalar()})
    rows = stage(rows.select("uid", id_col, "text_md5", F.size("w").alias("n_words"), F.expr(found).alias("found")), "rows", folder)
    small = (lambda df: F.broadcast(df)) if known.bounded else (lambda df: df)
    met = (
        rows.where(F.size("found") > 0)
        .select("uid", F.explode("found").alias("f"))
        .select("uid", "f.*")
        .join(small(known.grams), ["h", "gram", "len"])
    )
    places = met.groupBy("uid").agg(F.collect_set(F.struct("pos", "len")).alias("s")).select("uid", F.expr(HIT_WORDS).alias("p")).select("uid", F.expr(RUNS).alias("spans"))
    items = met.select("uid", "h", "gram").distinct().join(small(known.items), ["h", "gram"]).select("uid", "item").distinct()
    items = items.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.drop("found").join(places.join(items, "uid"), "uid", "left")
    return out.select(
        id_col,
        "text_md5",
        "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


#: Windows to the sorted places of the words hit, and these to disjoint ranges: a range begins and ends where a neighbour is missing.
HIT_WORDS = "array_sort(array_distinct(flatten(transform(s, x -> sequence(x.pos, x.pos + x.len - 1)))))"
RUNS = """zip_with(filter(p, (x, i) -> i = 0 or get(p, i - 1) < x - 1), filter(p, (x, i) -> i = size(p) - 1 or get(p, i + 1) > x + 1),
  (a, b) -> named_struct('start', a, 'stop', b + 1))"""


def _n_hit():
    return F.expr("aggregate(spans, 0L, (a, x) -> a + x.stop - x.start)")


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per row: words, words hit, items met, and whether hits reach one word in ``share``."""
    return hits(docs, windows(benchmark, n, **kw), id_col).select(
        id_col,
        "text_md5",
        F.col("n_words").cast("long").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((_n_hit() > 0) & (share * _n_hit() >= F.col("n_words"))).alias("contaminated"),
    )


#: The working columns of the functions below.
TEXT_KEY, SPANS, BAD = "_loomlog_text_md5", "_loomlog_spans", "_loomlog_bad"


def _met(docs: DataFrame, known: Windows, share: int) -> DataFrame:
    """``(text key, spans, bad)`` of the distinct texts with hits. Hits follow from the text alone, so texts are the key."""
    met = hits(docs, known).where(F.size("spans") > 0)
    bad = (share * _n_hit() >= F.col("n_words")).alias(BAD)
    return stage(met.select(F.col("text_md5").alias(TEXT_KEY), F.col("spans").alias(SPANS), bad).dropDuplicates([TEXT_KEY]), "hits")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(TEXT_KEY, F.md5(F.col("text").cast("binary")))


def _plain(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """``docs`` without the contaminated rows."""
    met = _met(docs, windows(benchmark, n), share)
    return _keyed(docs).join(met.where(BAD).select(TEXT_KEY), TEXT_KEY, "left_anti").select(*_plain(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with every hit word taken out of its text; all else, separators included, stays."""
    met = _met(docs, windows(benchmark, n), SHARE)
    return _without(_keyed(docs).join(met, TEXT_KEY, "left"), docs)


def _without(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows in the columns of ``docs``, without the words in the spans where these are not null; an ``n_chars`` column follows the text."""
    hit = F.col(SPANS).isNotNull()
    raw = F.regexp_extract_all("text", F.lit(f"({RAW_WORD})"), F.lit(1))
    gaps = F.split("text", RAW_WORD, -1)
    # Hit words as a set of places would be searched for every word; ranges of words between the spans are joined as they are.
    starts = "concat(array(0), transform(_loomlog_spans, s -> s.stop))"
    stops = "concat(transform(_loomlog_spans, s -> s.start), array(size(_loomlog_w)))"
    piece = "array_join(transform(slice(_loomlog_w, k.a + 1, k.b - k.a), (x, i) -> concat(get(_loomlog_g, k.a + i), x)), '')"
    lost = "array_join(slice(_loomlog_g, k.b + 1, k.c - k.b), '')"
    ranges = (
        f"transform(zip_with({starts}, {stops}, (a, b) -> named_struct('a', a, 'b', b)), (k, j) -> named_struct('a', k.a, 'b', k.b,"
        " 'c', coalesce(get(_loomlog_spans, j).stop, size(_loomlog_w) + 1)))"
    )
    rebuilt = f"array_join(transform({ranges}, k -> concat({piece}, {lost})), '')"
    keyed = keyed.withColumn("_loomlog_w", F.when(hit, raw)).withColumn("_loomlog_g", F.when(hit, gaps))
    keyed = keyed.withColumn("text", F.when(hit, F.expr(rebuilt)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = keyed.schema["n_chars"].dataType
        keyed = keyed.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return keyed.select(*_plain(docs))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """``docs`` without the contaminated rows, and with the hit words of the others taken out.

    Words that meet where a passage was can make a window again, so the rows that had hits are searched until none has any.
    No hit is left in the result; rows without hits stay as they are.
    """
    known = windows(benchmark, n)
    met = _met(docs, known, share)
    out = _keyed(docs).join(met, TEXT_KEY, "left_anti").select(*_plain(docs))
    cut = stage(_without(_keyed(docs).join(met.where(~F.col(BAD)), TEXT_KEY), docs), "cut")
    while not (met := _met(cut, known, share)).isEmpty():
        out = out.unionByName(_keyed(cut).join(met, TEXT_KEY, "left_anti").select(*_plain(docs)))
        cut = stage(_without(_keyed(cut).join(met, TEXT_KEY), docs), "cut")
    return out.unionByName(cut)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_md5")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wi AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wi),
pos AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT p.doc_id, p.i, p.k, wi.item_id FROM pos p JOIN wi ON wi.gram = p.gram AND wi.k = p.k),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
