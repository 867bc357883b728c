"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A document is contaminated by a benchmark item if one of its windows of the
item's number of words has a weighted similarity (sum of the smaller over sum
of the larger multiplicities of their five-word shingles) of 0.8 or more with
the item.  Every start of a window is considered, in line with the item or not.
A window of the wanted similarity has a least number of places whose shingle
occurs in items of its size (the overlap that the threshold asks for), so only
windows around that many hits are fingerprinted; none is lost by that.  Window
and item have a fingerprint for each of ``SEEDS``; they meet in an equi-join on
size, seed and one of ``RADIUS + 1`` blocks: two fingerprints within the radius
agree on a block at least.  Pairs within the radius for any seed are verified:
the similarity is computed exactly on the shingles.  At a similarity of 0.8 a
fingerprint differs in 10 of 64 bits on average and in more than the radius for
one pair in some twenty-five; for all of the seeds at once, in one of some ten
thousand.

The items' shingles are broadcast only if they are ``BROADCAST_ROWS`` or fewer,
by count; else they are joined by shuffle, behind a bitmap of ``2 ** BITMAP``
bits that all items' shingles set and that drops the other words of the corpus
inside the scan stage.  What leaves the scan are hits only.

Cases: null or empty texts and items never match; items of fewer than five words
are one shingle of all their words; a document shorter than the item is one
window; windows are shifted inwards at a document's ends; very long texts are
exploded to rows, and gather again only their hits and the windows around them;
rows given twice are both found; a null id is reported as null; an empty table of
documents or items gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut

SHINGLE = 5
THRESHOLD = 0.8
#: Differing bits within which all fingerprints are found.
RADIUS = 15
#: Fingerprints of a window, one for each.
SEEDS = (0, 1, 2)
BROADCAST_ROWS = 200_000
#: Bits (as a power of two) of the bitmap of shingles that stands before a join by shuffle.
BITMAP = 25


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def grams_of(words: str, k: int) -> Column:
    """Hash of the k words from each word on that has k - 1 after it."""
    made = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)]))
    return F.slice(made, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def simhash(grams: str, seed: int = 0) -> Column:
    """64-bit SimHash of a column of hashes, repeats included.

    One pass counts all bits, three to a long in lanes of 21 bits.
    """
    own = f"transform({grams}, g -> xxhash64({seed}, g))" if seed else grams
    spread, lanes, mask = 1 | 1 << 20 | 1 << 40, 1 | 1 << 21 | 1 << 42, (1 << 21) - 1
    added = ", ".join(f"a[{i}] + (((shiftrightunsigned(h, {3 * i}) & 7L) * {spread}L) & {lanes}L)" for i in range(22))
    counts = f"aggregate({own}, array_repeat(0L, 22), (a, h) -> array({added}))"
    bits = " | ".join(f"if(2 * (shiftrightunsigned(c[{b // 3}], {21 * (b % 3)}) & {mask}L) > size({grams}), shiftleft(1L, {b}), 0L)" for b in range(64))
    # The counts are bound once and read 64 times.
    return F.expr(f"transform(array({counts}), c -> {bits})[0]")


def fingerprints(grams: str) -> Column:
    """(seed, fp) of an array of hashes."""
    return F.array(*[F.struct(F.lit(s).alias("seed"), simhash(grams, s).alias("fp")) for s in SEEDS])


def blocks_of(fp: str) -> Column:
    """(block number, value) pairs: any two fingerprints within the radius share one."""
    count = RADIUS + 1
    cuts = [64 * i // count for i in range(count + 1)]
    return F.expr("array(" + ", ".join(f"named_struct('block', {i}, 'value', shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))) + ")")


def bitmap(seeds: DataFrame, power: int) -> Column:
    """A scalar array of longs in which every seed's bit is set, whatever their number: 2 ** power bits."""
    slot = F.col("gram").bitwiseAND((1 << power) - 1)
    words = seeds.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, CAST(gram & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = seeds.sparkSession.range(0, 1 << (power - 6)).select(F.col("id").alias("word")).join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("map")).scalar()


def in_bitmap(made: Column, gram: str, power: int) -> Column:
    word = F.shiftright(F.col(gram).bitwiseAND((1 << power) - 1), 6).cast("int")
    return F.getbit(F.get(made, word), F.col(gram).bitwiseAND(63).cast("int")) == 1


def blocks_of(fp: Column) -> Column:
    """(block number, value) pairs: any two fingerprints within the radius share one."""
    count = RADIUS + 1
    cuts = [64 * i // count for i in range(count + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of the smaller over sum of the larger multiplicities of two arrays."""
    times = lambda col, g: F.size(F.filter(col, lambda x: x == g))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, g: s + F.least(times(F.col(a), g), times(F.col(b), g)))
    return common / (F.size(a) + F.size(b) - common)


def starts_of(k: int, threshold: float) -> Column:
    """Starts of all windows with enough hits to be similar; of a document of n words, ``at`` are the places, in order, of its hits for a size.

    A similarity of t takes t / (1 + t) of the shingles of both sides in common,
    and a window with that many hits lies around as many successive places; each
    run of places adds the starts after its predecessor's.
    """
    last = F.greatest(F.lit(0), F.col("n") - F.col("size"))
    long = F.least(F.col("n"), F.col("size")) - (k - 1)
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold / (1 + threshold)) * (long + F.col("size") - (k - 1)) - 1e-6).cast("int"))
    runs = F.transform(F.slice("at", 1, F.greatest(F.lit(0), F.size("at") - need + 1)), lambda p, i: F.struct(F.greatest(F.lit(0), F.get(F.col("at"), i + need - 1) - long + 1, F.coalesce(F.get(F.col("at"), i - 1) + 1, F.lit(0))).alias("low"), F.least(p, last).alias("high")))
    return F.flatten(F.transform(F.filter(runs, lambda r: r["low"] <= r["high"]), lambda r: F.sequence(r["low"], r["high"])))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, item_id, start, similarity): the best window of each document and item; th is a hash of the row."""
    items = benchmark.select(F.col(item).alias("item_id"), words_of(F.col(item_text)).alias("words")).withColumn("size", F.size("words")).where("size > 0").withColumn("k", F.least("size", F.lit(SHINGLE)))
    keyed = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("th"), F.col(text).alias("text"))
    found = [_matches(keyed, items.where(F.col("k") == r["k"]), r["k"], threshold) for r in items.select("k").distinct().orderBy("k").collect()]
    if not found:
        kind = items.schema["item_id"].dataType.simpleString()
        return keyed.limit(0).selectExpr("doc_id", "th", f"cast(null AS {kind}) AS item_id", "0 AS start", "cast(0 AS double) AS similarity")
    every = reduce(DataFrame.unionByName, found)
    best = F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start")))
    return every.groupBy("doc_id", "th", "item_id").agg(best.alias("b")).select("doc_id", "th", "item_id", "b.start", "b.similarity")


def _matches(keyed: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    known = cut(items.select("item_id", "size", grams_of("words", k).alias("item_grams")).withColumn("fps", fingerprints("item_grams")))
    seeds = known.select("size", F.explode("item_grams").alias("gram")).distinct()
    worded = keyed.withColumn("words", words_of(F.col("text")))
    marks = worded.select("doc_id", "th", F.size("words").alias("n"), F.posexplode(grams_of("words", k)).alias("pos", "gram"))
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    else:
        marks = marks.where(in_bitmap(bitmap(seeds, BITMAP), "gram", BITMAP))
    met = marks.join(seeds, "gram").groupBy("doc_id", "th", "n", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    around = met.withColumn("starts", starts_of(k, threshold)).where(F.size("starts") > 0)
    hits = cut(around.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("size").alias("size"))))).alias("spans")))
    near = keyed.join(hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (keyed.th == hits.th)).select("doc_id", keyed.th, "text", "spans")
    gram = near.withColumn("words", words_of(F.col("text"))).select("doc_id", "th", "spans", grams_of("words", k).alias("grams"))
    cuts = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.slice(F.col("grams"), s["start"] + 1, s["size"] - (k - 1)).alias("grams")))
    windows = gram.select("doc_id", "th", F.explode(cuts).alias("w")).select("doc_id", "th", "w.*").withColumn("f", F.explode(fingerprints("grams"))).select("*", "f.seed", "f.fp").drop("f")
    ours = windows.withColumn("b", F.explode(blocks_of("fp"))).select("*", "b.block", "b.value").drop("b")
    printed = known.withColumn("f", F.explode("fps")).select("item_id", "size", "item_grams", "f.seed", F.col("f.fp").alias("item_fp"))
    theirs = printed.withColumn("b", F.explode(blocks_of("item_fp"))).select("*", "b.block", "b.value").drop("b")
    close = ours.join(theirs, ["size", "seed", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # A pair that meets in several blocks is taken at the first block that agrees.
    same = F.array_min(F.transform(F.filter(F.arrays_zip(blocks_of("fp").alias("x"), blocks_of("item_fp").alias("y")), lambda z: z["x"] == z["y"]), lambda z: z["x"]["block"]))
    once = close.where(F.col("block") == same).withColumn("similarity", weighted_similarity("grams", "item_grams"))
    return once.where(F.col("similarity") >= threshold).select("doc_id", "th", "item_id", "start", "similarity")


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = matches(docs, benchmark, key, text, threshold=threshold).select("doc_id", "th").distinct()
    bad = cut(bad.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")))
    marked = docs.withColumn("__row", F.xxhash64(F.col(key), F.col(text)))
    return marked.join(bad, (F.col("__row") == F.col("__th")) & F.col(key).eqNullSafe(F.col("__id")), "left_anti").drop("__row")
