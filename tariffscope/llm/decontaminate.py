"""Benchmark decontamination with built-in functions only: broadcast test windows, scanned documents.

The benchmark's normalised windows go out as a broadcast hash table when they
are few enough. Otherwise a broadcast filter of bounded size says where a window
may stand, and only those windows are sent, each with its own words, to a shuffled
join. A full window holds a run of half its words that starts at a multiple of
``stride`` words, so documents are scanned in strides; only around a run that some
window has are all windows looked up, and a hash that hits is verified by its
words. No Python runs on executors, and no shuffle carries a document's words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffscope.llm.common import ascii_lower, flagged

WINDOW = 10
#: What isn't part of a word, after lower-casing: ASCII other than digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most distinct windows that are broadcast (some 150 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Bits of the filter that stands in for more windows: 8 MB of bits, some 50 MB as a hash table.
WINDOW_FILTER_BITS = 1 << 26


def words_of(text: Column) -> Column:
    """Words of a normalised text; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body's lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(words: str, lengths: Sequence[int]) -> Column:
    """``(pos, len, hash)`` of every window of each length."""

    def of(hashes: Column, length: int) -> Column:
        last = F.size(hashes) - length
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice(hashes, i + 1, length)).alias("hash")),
        )
        return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<pos:int,len:int,hash:bigint>>"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda hashes: F.concat(*[of(hashes, length) for length in lengths]))


def with_words(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``words``. A generator makes the words, so that later expressions read them and don't split again."""
    return df.select(*columns, F.explode(F.array(words_of(F.col("text")))).alias("words"))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item_id, len, hash, window)``: windows of ``size`` words; an item of fewer words is one window."""
    items = with_words(benchmark, "item_id").filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    each = F.transform(
        F.sequence(F.lit(0), F.size("words") - length), lambda i: F.slice("words", i + 1, length)
    )
    windows = items.select("item_id", F.explode(each).alias("words"))
    return windows.select(
        "item_id",
        F.size("words").alias("len"),
        hash_of(F.col("words")).alias("hash"),
        F.array_join("words", " ").alias("window"),
    ).distinct()


def scan_plan(items: DataFrame) -> tuple[list[int], bool]:
    """Lengths of the items' windows (at most ``WINDOW``), and whether their number is within the broadcast bound."""
    sizes = items.groupBy("len").count().collect()
    return sorted(r["len"] for r in sizes), sum(r["count"] for r in sizes) <= BROADCAST_WINDOWS


def hash_of(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.xxhash64(w)))


def runs_of(windows: DataFrame, length: int, size: int) -> DataFrame:
    """Distinct hashes of the runs of ``length`` words in windows of ``size`` words."""
    words = F.split("window", " ")
    each = F.transform(F.sequence(F.lit(1), F.lit(size - length + 1)), lambda i: hash_of(F.slice(words, i, length)))
    return windows.filter(F.col("len") == size).select(F.explode(each).alias("run")).distinct()


def places_by_stride(scanned: DataFrame, key: Sequence[str], windows: DataFrame, size: int, few: bool) -> DataFrame:
    """``key, words, pos, len, hash`` of the windows of ``size`` words around each run that some window has."""
    length = size - size // 2
    stride = size - length + 1
    runs = runs_of(windows, length, size)
    last = F.size("words") - length
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    hashed = F.transform(F.filter(starts, lambda p: p <= last), lambda p: F.struct(p.alias("at"), hash_of(F.slice("words", p + 1, length)).alias("run")))
    spread = scanned.select(*key, "words", hashed.alias("each")).select(*key, "words", F.explode("each").alias("one"))
    met = spread.select(*key, "words", F.col("one.at").alias("at"), F.col("one.run").alias("run"))
    met = met.join(F.broadcast(runs), "run", "left_semi") if few else maybe(met, "run", runs)
    near = met.select(*key, "words", F.explode(F.sequence(F.col("at") - stride + 1, F.col("at"))).alias("pos"))
    near = near.filter((F.col("pos") >= 0) & (F.col("pos") <= F.size("words") - size))
    window_hash = hash_of(F.slice("words", F.col("pos") + 1, size))
    return near.select(*key, "words", "pos", F.lit(size).alias("len"), window_hash.alias("hash"))


def all_places(scanned: DataFrame, key: Sequence[str], lengths: Sequence[int]) -> DataFrame:
    """``key, words, pos, len, hash`` of every window of each length."""
    each = scanned.select(*key, "words", window_hashes("words", lengths).alias("each"))
    return each.select(*key, "words", F.explode("each").alias("at")).select(
        *key, "words", F.col("at.pos").alias("pos"), F.col("at.len").alias("len"), F.col("at.hash").alias("hash")
    )


def maybe(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose hash in ``column`` isn't in ``wanted``; nothing is shuffled."""
    near = flagged(rows.withColumn("key", F.col(column)), wanted.select(F.col(column).alias("key")), WINDOW_FILTER_BITS)
    return near.filter("maybe").select(*rows.columns)


def occurrences(docs: DataFrame, key: Sequence[str], windows: DataFrame, lengths: Sequence[int], size: int, few: bool) -> DataFrame:
    """``key, pos, len, hash, window`` for each window of ``windows`` that stands in a document."""
    scanned = with_words(docs, *key)
    short = [length for length in lengths if length < size]
    places = [places_by_stride(scanned, key, windows, size, few)] if size in lengths else []
    places += [all_places(scanned, key, short)] if short else []
    found = places[0] if len(places) == 1 else places[0].unionByName(places[1])
    said = F.array_join(F.slice("words", F.col("pos") + 1, F.col("len")), " ")
    if few:
        hits = found.join(F.broadcast(windows), ["len", "hash"]).filter(said == F.col("window"))
    else:
        hits = maybe(found, "hash", windows).select(*key, "pos", "len", "hash", said.alias("window")).join(windows, ["len", "hash", "window"])
    return hits.select(*key, "pos", "len", "hash", "window")


def covered(spans: Column) -> Column:
    """Words inside the union of sorted ``(pos, stop)`` spans."""
    start = F.struct(F.lit(0).alias("done"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            F.greatest(s["done"], x["stop"]).alias("done"),
            (s["total"] + F.greatest(x["stop"] - F.greatest(s["done"], x["pos"]), F.lit(0))).alias("total"),
        ),
        lambda s: s["total"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per input row: id, words, words hit, the items they come from, and the verdict.

    A null or wordless text has no words and isn't contaminated; items without
    words (null, empty) never occur. Rows with equal id and text share a result,
    rows that share an id but differ in text are judged apart. Repeated items and
    windows count once. Extra columns are ignored; empty tables give empty or
    clean results. Texts are scanned whole.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version"))
    found = occurrences_by_document(keyed, benchmark, size)
    every = keyed.select("doc_id", "version", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    same = every["doc_id"].eqNullSafe(found["doc_id"]) & (every["version"] == found["version"])
    zero = F.lit(0).cast("long")
    return every.join(found, same, "left").select(
        every["doc_id"],
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def occurrences_by_document(keyed: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """``doc_id, version, n_hit, items`` of contaminated documents; lists hold distinct spans and windows of one text."""
    key = ["doc_id", "version"]
    items = item_windows(benchmark, size)
    lengths, few = scan_plan(items)
    if not lengths:
        none = F.array().cast("array<string>")
        return keyed.select(*key, F.lit(0).cast("long").alias("n_hit"), none.alias("items")).filter(F.lit(False))
    distinct = items.select("len", "hash", "window").distinct()
    hits = occurrences(keyed, key, distinct, lengths, size, few)
    per_text = hits.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("len")).alias("stop")))).alias("spans"),
        F.collect_set(F.struct("len", "hash", "window")).alias("windows"),
    )
    return (
        per_text.select(*key, covered(F.col("spans")).alias("n_hit"), F.inline("windows"))
        .join(F.broadcast(items) if few else items, ["len", "hash", "window"])
        .groupBy(*key, "n_hit")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without any benchmark window, with the same columns."""
    version = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    hit = occurrences_by_document(docs.select("doc_id", "text", version.alias("version")), benchmark, size)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), version.alias("version"))
    same = rows["id"].eqNullSafe(hit["doc_id"]) & (rows["version"] == hit["version"])
    return rows.join(hit.select("doc_id", "version"), same, "left_anti").select("row.*")
