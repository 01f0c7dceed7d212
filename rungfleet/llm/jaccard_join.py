"""N-gram Jaccard join: which documents' shingle sets overlap almost entirely.

Exact and without all pairs. Equal sets are one node. Sets that reach the
threshold share a token among the first few of each (the prefix), in an order
that puts frequent tokens last; inverted lists are made of these tokens only,
and each entry knows its token's position in the set.

A list is skipped by blocks of position: what follows a set's first common
token bounds the overlap, so of two linked sets the smaller one has that token
in the first part of its prefix (block 0). Entries of block 1 are never
compared with each other, and a list without block 0 is not read at all. Inside
a block the sizes, the positions and the distances to the list's first pivot
decide, before a pair is made, whether two sets can be linked; distances are
counted on parity bitmaps, whose Hamming distance never exceeds the number of
tokens two sets do not share.

A set's answers are derived from those of a highly similar one: a list compares
its sets with a pivot, the set with the fewest tokens of its own, and a set that
is linked with it takes over all that the pivot is connected with. Entries that
are connected are not compared again. Lists that still hold sets of different
components go on with further pivots, from their smallest components, sixteen
times as many in each round, until no block 0 meets another component. From the
second round on an entry carries its bitmap, folded to 512 bits, and no pair is
made of two sets that are too far apart on it. What passes is verified on the sets
of token hashes (64 bits); where sets come close to many pivots, each one's closest
pivot first, and then what is still not connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, materialize_counted, smaller_batches
from .components import connected_components
from .wordsets import bitmap_size, key_bitmap, shingle_sets, test_bits, text_bytes

#: Bits of the bitmap of frequent tokens, as a power of two.
FREQUENT_BITS = 23
#: A token is frequent if batches that hold it this often add up to so many sets. It changes the order of tokens only.
OFTEN_IN_BATCH, OFTEN = 4, 48
#: So is one whose first list is longer than this.
LONG_LIST = 8
#: Pairs up to which the documents to be verified are picked by a broadcast join (16 bytes a row); beyond, by a bitmap.
BROADCAST_ROWS = 500_000
#: 64-bit words of a folded bitmap.
FOLD = 8
#: Close pairs a set from which each set's closest pivot is verified before the others.
CLOSE_PIVOTS = 2
#: By how many times the pivots of a list grow from round to round.
MORE_PIVOTS = 16


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    return shingle_sets(text_bytes(batch.column("text")), n)


def _parity(s: np.ndarray) -> np.ndarray:
    """Each token flips one bit. There are 512 bits up to 1,024 tokens, and twice
    as many each time the size doubles."""
    bits = 512 << max(0, (len(s) - 1).bit_length() - 10)
    flips = np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(flips, bitorder="little").view(np.int64)


def _key(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)


def describe_sets(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document: its set's size, 128-bit key and parity bitmap; and
    rows without a document for tokens that a batch holds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # slices keep what a worker holds small
        for b in (x.slice(at, 4096) for x in batches for at in range(0, x.num_rows, 4096)):
            sets = list(_sets(b, n))
            token, times = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            token, times = token[times >= OFTEN_IN_BATCH], times[times >= OFTEN_IN_BATCH]
            keys = np.array([_key(s) for s in sets], np.int64).reshape(-1, 2)
            size, none = pa.array([len(s) for s in sets], pa.int32()), pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([_parity(s) for s in sets], longs), none, none], names)
            if len(token):
                k = len(token)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, b.column("doc_id").type), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, longs), pa.array(token.view(np.int64)), pa.array(times)], names)

    names, longs = ["doc_id", "size", "key", "key2", "parity", "token", "times"], pa.list_(pa.int64())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, size int, key long, key2 long, parity array<long>, token long, times long")


def _prefixes(docs: DataFrame, n: int, t: Fraction, frequent: np.ndarray, shared: np.ndarray | None) -> DataFrame:
    """``token, key, size, pos, lonely`` for the prefix tokens of each set, where
    ``pos`` is the token's place in the set's order. With ``shared``, only tokens
    whose bit is set there; ``lonely`` counts the others."""
    sc = docs.sparkSession.sparkContext
    frequent_b, shared_b = sc.broadcast(frequent), sc.broadcast(shared)  # fixed sizes, 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, keys, numbers = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty((0, 3), np.int32)]
            for s in _sets(b, n):
                if not len(s):
                    continue
                length = len(s) - -(-len(s) * t.numerator // t.denominator) + 1
                often = test_bits(frequent_b.value, s)
                prefix = np.concatenate([s[~often][:length], s[often][: max(0, length - int((~often).sum()))]])
                pos = np.arange(length)
                if shared_b.value is not None:
                    pos = np.flatnonzero(test_bits(shared_b.value, prefix))
                tokens.append(prefix[pos])
                keys.append(np.full(len(pos), _key(s)[0], np.int64))
                numbers.append(np.stack([np.full(len(pos), len(s)), pos, np.full(len(pos), length - len(pos))], 1).astype(np.int32))
            number = np.concatenate(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), *(pa.array(np.ascontiguousarray(number[:, i])) for i in range(3))], ["token", "key", "size", "pos", "lonely"])

    return docs.select("text").mapInArrow(run, "token long, key long, size int, pos int, lonely int")


def _full_sets(docs: DataFrame, n: int, wanted: DataFrame, few: bool) -> DataFrame:
    """``id, set_key, tokens`` of the documents whose ids are in ``wanted(id)``, and of
    few others: a join with the ids if they are ``few``, else a bitmap over them,
    keeps the rest from being hashed; the join that follows makes it exact."""
    docs = docs.where("doc_id is not null")
    if few:
        docs, bitmap = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("id"), "left_semi"), None
    else:
        bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted, F.xxhash64("id"), bitmap_size(wanted.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if bitmap is not None:
                b = b.filter(pa.array(test_bits(bitmap.value, b.column("h").to_numpy(zero_copy_only=False).view(np.uint64))))
            sets = [s.view(np.int64) for s in _sets(b, n)]
            keys = pa.array([_key(s)[0] for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), keys, pa.array(sets, pa.list_(pa.int64()))], ["id", "set_key", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, f"id {kind}, set_key long, tokens array<long>")


def _most_apart(a: Column, b: Column, t: Fraction) -> Column:
    """The most tokens that two linked sets of these sizes do not share:
    a + b - 2 * ceil(t * (a + b) / (1 + t))."""
    p, q = t.numerator, t.denominator
    total = (a + b).cast("long")
    return total - 2 * F.ceil(total * p / (p + q) - 1e-9)


def _sizes_fit(a: Column, b: Column, t: Fraction) -> Column:
    return (F.least(a, b) * t.denominator) >= (F.greatest(a, b) * t.numerator)


def _shared_needed(a: Column, b: Column, t: Fraction) -> Column:
    """The fewest tokens that two linked sets of these sizes share."""
    p, q = t.numerator, t.denominator
    return F.ceil((a + b).cast("long") * p / (p + q) - 1e-9)


def _in_block_0(size: Column, pos: Column, t: Fraction) -> Column:
    """Whether the first common token may be here if the set is the smaller one."""
    return (size - pos) >= _shared_needed(size, size, t)


def _positions_fit(a: Column, i: Column, b: Column, j: Column, t: Fraction) -> Column:
    """Whether sets of sizes ``a`` and ``b`` can be linked if their first common token
    is at ``i`` and ``j``: what is left of the shorter rest must reach the overlap.
    A later common token may fail this; the first one of a linked pair never does."""
    return F.least(a - i, b - j) >= _shared_needed(a, b, t)


def _apart(x: Column, y: Column) -> Column:
    """The Hamming distance of two parity bitmaps; the longer one is folded to the
    length of the other, which keeps each token at one bit. Sizes that can be
    linked differ by less than twice, and so do the lengths."""
    fold = lambda a, b: F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), F.size(b)), F.slice(a, F.size(b) + 1, F.size(b)), lambda p, q: p.bitwiseXOR(q))).otherwise(a)
    flips = F.zip_with(fold(x, y), fold(y, x), lambda p, q: F.bit_count(F.coalesce(p, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(q, F.lit(0).cast("long")))))
    return F.aggregate(flips, F.lit(0), lambda a, b: a + b)


def _folded(parity: Column) -> Column:
    """A parity bitmap folded to ``FOLD`` words: each token flips one bit in it, too."""
    fold = F.transform(F.sequence(F.lit(0), F.lit(FOLD - 1)), lambda i: F.aggregate(F.filter(parity, lambda _, at: at % FOLD == i), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
    return F.when(F.size(parity) == FOLD, parity).otherwise(fold)


def _folds_apart(x: Column, y: Column) -> Column:
    return reduce(add, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(FOLD)])


def _verified(pairs: DataFrame, docs: DataFrame, n: int, t: Fraction, few: bool) -> DataFrame:
    """The pairs ``(a, ka, b, kb)`` of representatives that reach the threshold. Of
    rows that share an id, the one with the set that the pair names is used. The
    sets of the ``b`` side, often pivots of many pairs, are few."""
    x = _full_sets(docs, n, pairs.select(F.col("a").alias("id")).distinct(), few)
    y = _full_sets(docs, n, pairs.select(F.col("b").alias("id")).distinct(), few)
    left = x.join(pairs, (F.col("id") == F.col("a")) & (F.col("set_key") == F.col("ka"))).select("a", "b", "kb", F.col("tokens").alias("x"))
    both = left.join(y.select("id", "set_key", F.col("tokens").alias("y")), (F.col("b") == F.col("id")) & (F.col("kb") == F.col("set_key")))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    total = (F.size("x") + F.size("y")).cast("long")
    return materialize(both.select("a", "b", common.alias("common"), total.alias("total")).where((F.col("common") * t.denominator) >= ((F.col("total") - F.col("common")) * t.numerator)).select("a", "b").distinct())


def _linked(near: DataFrame, groups: DataFrame | None, docs: DataFrame, n: int, t: Fraction, n_near: int, n_sets: int) -> DataFrame | None:
    """``groups`` with the links among the ``n_near`` close pairs ``(a, ka, b, kb, apart)`` of
    ``n_sets`` sets. With many pairs a set, the closest ones come first: pairs that
    these connect need no look at their sets."""
    all_of_them = n_near <= CLOSE_PIVOTS * n_sets
    while n_near:
        now, n_now = near, n_near
        if not all_of_them:
            now = near.groupBy("a", "ka").agg(F.min(F.struct("apart", "b", "kb")).alias("p")).select("a", "ka", "p.b", "p.kb")
            now, (n_now,) = materialize_counted(now, F.count(F.lit(1)))
        found = _verified(now.select("a", "ka", "b", "kb"), docs, n, t, n_now <= BROADCAST_ROWS)
        if not found.isEmpty():
            groups = connected_components(found if groups is None else found.union(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if all_of_them:
            break
        all_of_them = True
        near = near.join(now.select("a", "ka", "b", "kb"), ["a", "ka", "b", "kb"], "left_anti")
        if groups is not None:
            for side in ("a", "b"):
                near = near.join(groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
            near = near.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")
        near, (n_near,) = materialize_counted(near, F.count(F.lit(1)))
    return groups


def similar_groups(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    A document's set is the distinct ``n``-word shingles of its text in lower
    case (A to Z); two documents are linked if their sets' Jaccard similarity is
    at least ``threshold``; ``component_id`` is the smallest id that links lead
    to. No similar pair is lost: see the module. Null and empty texts have an
    empty set, linked with nothing, and texts of fewer than ``n`` words one
    shingle. Rows that share an id are one node of the graph, each with the size
    of its own set. Rows with a null id have no component and link nothing. An
    empty table gives an empty result. Other columns are not read.
    """
    docs = smaller_batches(docs.select("doc_id", "text"))
    seen = materialize(describe_sets(docs, n))
    rows = seen.where("size is not null").drop("token", "times")
    often = seen.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN)
    frequent = key_bitmap(often, F.col("token"), FREQUENT_BITS)
    classes = rows.where("size > 0 and doc_id is not null").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("parity").alias("parity"))
    classes = materialize(classes)

    # what the first lists show to be long moves back in the order too; the second lists are made of rarer tokens
    at_0 = F.max(_in_block_0(F.col("size"), F.col("pos"), threshold)).alias("at_0")
    long = _prefixes(docs, n, threshold, frequent, None).groupBy("token").agg(F.count("*").alias("times"), F.min("key").alias("lo"), F.max("key").alias("hi")).where((F.col("lo") != F.col("hi")) & (F.col("times") > LONG_LIST))
    frequent = frequent | key_bitmap(long, F.col("token"), FREQUENT_BITS)
    lists = _prefixes(docs, n, threshold, frequent, None).groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), at_0).where("lo != hi and at_0")
    used = materialize(lists.select("token"))
    shared = key_bitmap(used, F.col("token"), bitmap_size(used.count()))
    entries = _prefixes(docs, n, threshold, frequent, shared).groupBy("token", "key").agg(F.first("size").alias("size"), F.first("pos").alias("pos"), F.first("lonely").alias("lonely"))
    no = F.lit(None).cast("int")
    left = materialize(entries.join(used, "token").select("token", "key", "size", "pos", "lonely", no.alias("apart"), no.alias("width")))

    # rows that share an id tie the classes of their sets together
    of_row = rows.where("size > 0 and doc_id is not null").select("doc_id", "key", "key2").join(classes.select("key", "key2", "rep"), ["key", "key2"])
    tied = of_row.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("m")).where("a != m").select("doc_id", "a")
    links = materialize(tied.join(of_row, "doc_id").select("a", F.col("rep").alias("b")).where("a != b").distinct())
    groups = None if links.isEmpty() else connected_components(links)

    tested, pivots_a_list = None, 1
    while True:
        fold = _folded(F.col("parity")) if pivots_a_list > 1 else F.lit(None).cast("array<long>")
        known = classes.select("key", "rep", fold.alias("fold"))
        known = known.withColumn("component", F.col("rep")) if groups is None else known.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        state = left.join(known.select("key", "component", "fold"), "key")
        still = state.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), at_0).where("lo != hi and at_0").select("token")
        state, (rows_left,) = materialize_counted(state.join(still, "token", "left_semi"), F.count(F.lit(1)))
        if not rows_left:
            break
        # pivots: of the list's smallest components, the sets with the fewest tokens of their own
        count = state.groupBy("token", "component").agg(F.count("*").alias("members"))
        part = F.pmod(F.xxhash64("key", "token"), F.lit(pivots_a_list))
        chosen = state.where(_in_block_0(F.col("size"), F.col("pos"), threshold)).join(count, ["token", "component"]).groupBy("token", part.alias("part"))
        chosen = chosen.agg(F.min(F.struct("members", "lonely", "size", "key", "pos", "component", "apart", "width", "fold")).alias("p"))
        chosen = materialize(chosen.select("token", F.col("p.key").alias("pivot"), *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("size", "pos", "component", "apart", "width", "fold")]))
        most = _most_apart(F.col("size"), F.col("p_size"), threshold)
        pairs = state.join(chosen, "token").where(
            (F.col("component") != F.col("p_component"))
            & _sizes_fit(F.col("size"), F.col("p_size"), threshold)
            & _positions_fit(F.col("size"), F.col("pos"), F.col("p_size"), F.col("p_pos"), threshold)
            # distances to the list's first pivot compare if they were counted on bitmaps of one width
            & F.coalesce((F.col("width") != F.col("p_width")) | (F.abs(F.col("apart") - F.col("p_apart")) <= most), F.lit(True))
            & F.coalesce(_folds_apart(F.col("fold"), F.col("p_fold")) <= most, F.lit(True))
        )
        pairs = pairs.select("key", "pivot").distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["key", "pivot"], "left_anti").join(tested.select(F.col("key").alias("pivot"), F.col("pivot").alias("key")), ["key", "pivot"], "left_anti")
        x = classes.select("key", F.col("rep").alias("a"), F.col("size").alias("asize"), F.col("parity").alias("x"))
        y = classes.select(F.col("key").alias("pivot"), F.col("rep").alias("b"), F.col("size").alias("bsize"), F.col("parity").alias("y"))
        met = pairs.join(x, "key").join(y, "pivot").select("key", "pivot", "a", "b", "asize", "bsize", _apart(F.col("x"), F.col("y")).alias("apart"), F.least(F.size("x"), F.size("y")).alias("width"))
        close = (F.col("a") != F.col("b")) & (F.col("apart") <= _most_apart(F.col("asize"), F.col("bsize"), threshold))
        met, (n_near, n_sets) = materialize_counted(met.withColumn("close", close), F.count_if(F.col("close")), F.approx_count_distinct(F.when(F.col("close"), F.col("a"))))
        near = met.where("close").select("a", F.col("key").alias("ka"), "b", F.col("pivot").alias("kb"), "apart")
        groups = _linked(near, groups, docs, n, threshold, n_near, n_sets)
        tested = met.select("key", "pivot") if tested is None else tested.union(met.select("key", "pivot"))
        left = state.join(chosen.select("token", F.col("pivot").alias("key")), ["token", "key"], "left_anti").drop("component", "fold")
        if pivots_a_list == 1:
            distance = met.groupBy("key", "pivot").agg(F.min("apart").alias("apart"), F.min("width").alias("width"), F.count("*").alias("n")).where("n = 1").drop("n")
            left = left.drop("apart", "width").join(chosen.select("token", "pivot"), "token").join(distance, ["key", "pivot"], "left").drop("pivot")
        left = materialize(left.select("token", "key", "size", "pos", "lonely", "apart", "width"))
        pivots_a_list *= MORE_PIVOTS

    labelled = classes.select("key", "key2", "rep")
    labelled = labelled.withColumn("component", F.col("rep")) if groups is None else labelled.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("key", "key2", F.coalesce("component", "rep").alias("component"))
    return rows.join(labelled, ["key", "key2"], "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows
    with a null id stay; of rows that share the kept id, all stay. All columns
    pass unchanged, whatever they are called."""
    copy = fresh(docs, "copy")
    groups = similar_groups(docs, n, threshold).where("doc_id != component_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(materialize(groups), F.col("doc_id") == F.col(copy), "left_anti")
