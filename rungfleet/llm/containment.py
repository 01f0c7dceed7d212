"""Find short items inside long documents: MinHash containment search.

An item of n distinct shingles is contained in a document at threshold t if at
least ceil(t * n) of them occur there, so at most n - ceil(t * n) are missing.
An item's sketch is its bottom-k MinHash, its k smallest shingle hashes, with
k = n - ceil(t * n) + 1: whichever shingles are missing, one of the sketch is
present. Since k follows the size, items are partitioned by size, in powers of
two; the sketches of a partition end at a hash of their own, lower the larger
the items are. Documents, however long, are probed once for each partition,
with those of their shingle hashes that lie below its end. The pairs that the
sketches find, and no others, are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize, maybe_broadcast, word_runs, words

SHINGLE = 5
THRESHOLD = 0.8
#: Rows up to which the sketches, or the ids of candidates, are sent to all executors (32 bytes a row); beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Word n-grams of the lower-cased text, joined by a space; with fewer words
    the whole sequence as one; an empty array without words."""
    def grams(ws: Column) -> Column:
        return F.when((F.size(ws) > 0) & (F.size(ws) < n), F.array(F.array_join(ws, " "))).otherwise(word_runs(ws, n))

    return let(words(F.lower(text)), grams)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """xxhash64 of each of ``shingles(text, n)``, without building their strings twice."""
    return F.transform(shingles(text, n), lambda s: F.xxhash64(s))


def row_key() -> Column:
    """Tells rows that share an id apart by their texts."""
    return F.xxhash64("text")


def text_columns(df: DataFrame) -> list[str]:
    """The columns whose values may be of any length, such as string ids."""
    return [c for c, kind in df.dtypes if kind in ("string", "binary")]


def contained_rows(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, doc_row, item_id, item_row, item_shingles, shared`` for each row of
    ``docs`` that holds at least ``threshold`` of the distinct shingles of a row
    of ``items``.

    ``docs(doc_id, text)`` and ``items(item_id, text)``; other columns are not
    read. Rows are told apart by id and text (``row_key()``), also where ids are
    null or repeated; equal rows come out once. Null or empty texts have no
    shingles and match nothing; an item with fewer than ``n`` words matches a
    document that consists of just those words. Empty tables give an empty result.
    """
    need = F.ceil(F.col("item_shingles") * F.lit(threshold) - F.lit(1e-9))
    grams = F.array_distinct(shingles(F.col("text"), n))
    rows = materialize(items.select("item_id", row_key().alias("item_row"), grams.alias("grams")).where(F.size("grams") > 0).dropDuplicates(["item_id", "item_row"]))
    item_grams = materialize(rows.select("item_id", "item_row", F.explode("grams").alias("gram")))
    sized = materialize(rows.select("item_id", "item_row", F.size("grams").cast("long").alias("item_shingles"), F.array_sort(F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g)))).alias("hashes")))
    sketches = materialize(
        sized.select(
            "item_id",
            "item_row",
            F.floor(F.log2("item_shingles")).alias("size_part"),
            F.explode(F.slice("hashes", F.lit(1), (F.col("item_shingles") - need + 1).cast("int"))).alias("hash"),
        )
    )
    ends = sketches.groupBy("size_part").agg(F.max("hash")).orderBy("size_part").collect()  # a row for each power of two
    docs = docs.select("doc_id", row_key().alias("doc_row"), "text")

    def up_to(hs: Column, end: int) -> Column:
        return F.filter(hs, lambda h: h <= end)

    below = lambda hs: F.array(*[F.struct(F.lit(part).alias("size_part"), up_to(hs, end).alias("hashes")) for part, end in ends])
    probes = docs.select("doc_id", "doc_row", F.explode(let(F.array_distinct(shingle_hashes(F.col("text"), n)), below)).alias("p")) if ends else docs.limit(0).select("doc_id", "doc_row", F.struct(F.lit(0).cast("long").alias("size_part"), F.array().cast("array<long>").alias("hashes")).alias("p"))
    probes = probes.select("doc_id", "doc_row", "p.size_part", F.explode("p.hashes").alias("hash"))
    found = materialize(probes.join(maybe_broadcast(sketches, BROADCAST_ROWS), ["size_part", "hash"]).select("doc_id", "doc_row", "item_id", "item_row").distinct())
    candidates = materialize(found.select(F.col("doc_id").alias("candidate"), F.col("doc_row").alias("candidate_row")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("candidate")) & (F.col("doc_row") == F.col("candidate_row"))
    held = docs.join(maybe_broadcast(candidates, BROADCAST_ROWS, *text_columns(candidates)), same, "left_semi")
    held = held.select("doc_id", "doc_row", F.explode(F.array_distinct(shingles(F.col("text"), n))).alias("gram"))
    some = materialize(item_grams.select("gram").distinct())
    held = held.join(maybe_broadcast(some, BROADCAST_ROWS, "gram"), "gram", "left_semi").distinct()
    # only the pairs that the sketches found meet on shingles
    of_pair = found.alias("f").join(item_grams.alias("g"), F.col("f.item_id").eqNullSafe(F.col("g.item_id")) & (F.col("f.item_row") == F.col("g.item_row")))
    of_pair = of_pair.select(F.col("f.doc_id").alias("candidate"), F.col("f.doc_row").alias("candidate_row"), "f.item_id", "f.item_row", F.col("g.gram").alias("item_gram"))
    met = held.join(of_pair, same & (F.col("gram") == F.col("item_gram")))
    hits = met.groupBy("doc_id", "doc_row", "item_id", "item_row").agg(F.count("*").alias("shared"))
    of_item = sized.select(F.col("item_id").alias("i"), F.col("item_row").alias("r"), "item_shingles")
    of_item = maybe_broadcast(of_item, BROADCAST_ROWS, *text_columns(of_item))
    return (
        hits.join(of_item, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_row") == F.col("r")))
        .where(F.col("shared") >= need)
        .select("doc_id", "doc_row", "item_id", "item_row", "item_shingles", "shared")
    )


def contained_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``doc_id, item_id, item_shingles, shared`` where a row of the document
    holds at least ``threshold`` of the distinct shingles of a row of the item;
    of several such pairs of rows, the one with the largest share, then the largest
    item. See ``contained_rows``."""
    best = F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("share"), "item_shingles", "shared")).alias("best")
    return contained_rows(docs, items, n, threshold).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.item_shingles", "best.shared")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that contain an item; each row is judged by its own
    text, whatever other rows have its id. All columns pass unchanged, whatever
    they are called."""
    leaked, row = fresh(docs, "leaked"), fresh(docs, "leaked_row")
    hit = materialize(contained_rows(docs, items, n, threshold).select(F.col("doc_id").alias(leaked), F.col("doc_row").alias(row)).distinct())
    return docs.join(maybe_broadcast(hit, BROADCAST_ROWS, *text_columns(hit)), F.col("doc_id").eqNullSafe(F.col(leaked)) & (row_key() == F.col(row)), "left_anti")
