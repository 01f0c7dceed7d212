"""Toxicity by nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled rows is the index. A text's vector has the TF-IDF
weights of those of its words whose share of toxic examples is beyond chance,
with counts in powers of two; the other words carry nothing about the label, and
a text without any telling word has no neighbours. Near copies among the examples share
one weight, so that a copied text does not vote many times. Examples with equal
vectors are one entry. The inverted index keeps, per term, the largest weight
in each block of entries; a query bounds every block by the sum of these and
opens blocks from the highest bound down until none can hold a nearer entry,
which gives the exact nearest ones. Their distance-weighted vote is calibrated
by what the same vote says of each example when it is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, smaller_batches

#: Most labelled rows that the index is made from: those with the smallest MD5 of their id.
EXAMPLES = 40_000
NEIGHBOURS, BLOCK, LEAST_DF = 20, 16, 5
_WORD = re.compile(r"[^\W\d_]+")


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the id belongs to the fold that labels are never learned from; a
    null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def text_words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall((text or "").lower())


#: Odd multipliers of the sketches' hash functions.
_SKETCH = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def _sketches(words: list[str]) -> list[int]:
    """The smallest hash of the five-word shingles under four functions; near
    copies share each with a chance equal to their similarity."""
    h = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
    mixed = ((h[None, :] * _SKETCH[:, None]) & np.uint64(0xFFFFFFFFFFFF)) >> np.uint64(16)
    return mixed.min(1).astype(np.int64).tolist()


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's words and counts, and its sketches."""
    for b in batches:
        found = [text_words(t.as_py()) for t in b.column("text")]
        counts = [Counter(ws) for ws in found]
        sketch = [_sketches(ws) for ws in found]
        arrays = [b.column("doc_id"), b.column("toxic"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(map(level, c.values())) for c in counts], pa.list_(pa.int32())), pa.array(sketch, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "words", "counts", "sketch"])


def level(count: int) -> int:
    """A term's count rounded down to a power of two: 1, 2, 4, ... Weights follow
    the levels, so fewer different vectors arise."""
    return 1 << (count.bit_length() - 1)


class Index:
    """Entries (vectors with the weight of their examples and of the toxic ones
    among these) in blocks, and the largest weight of each term in each block."""

    def __init__(self, terms: list[str], idf: np.ndarray, entries: list[tuple], base: float):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.idf, self.base = idf, base
        self.entries = entries = sorted(entries, key=lambda e: e[0])  # alike vectors come into the same blocks
        self.weight = np.array([e[1] for e in entries], float)
        self.toxic = np.array([e[2] for e in entries], float)
        self.doc = [e[3] for e in entries]
        vectors = [self.vector(dict(e[0])) for e in entries]
        # the vectors' terms and weights one after another, and the row of each
        self.cols = np.array([t for v in vectors for t in v], int)
        self.vals = np.array([x for v in vectors for x in v.values()], float)
        self.rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        self.blocks = -(-len(vectors) // BLOCK)
        self.bounds = np.searchsorted(self.rows, np.arange(self.blocks + 1) * BLOCK)
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        order = np.lexsort((self.rows, self.cols))
        cols, rows, vals = self.cols[order], self.rows[order] // BLOCK, self.vals[order]
        terms_seen, begin = np.unique(cols, return_index=True)
        for t, lo, hi in zip(terms_seen.tolist(), begin, [*begin[1:], len(cols)][: len(begin)], strict=True):
            blocks, first = np.unique(rows[lo:hi], return_index=True)
            self.best[t] = (blocks, np.maximum.reduceat(vals[lo:hi], first))
        self.xs, self.ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def nearest(self, query: dict[int, float], weight_needed: float, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines, nearest first, up to the entry with which their
        weight reaches ``weight_needed``, and all that are as near as that one.

        The blocks with the highest bounds are opened until they hold enough; the
        last entry needed gives a floor, and then only blocks whose bound reaches
        it are opened."""
        bound = np.zeros(self.blocks)
        for t, x in query.items():
            blocks, most = self.best.get(t, (slice(0), 0.0))
            bound[blocks] += x * most
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        dense = np.zeros(len(self.idf))
        dense[list(query)] = list(query.values())
        ids, sims, opened, step = np.empty(0, int), np.empty(0), 0, 8
        while opened < len(order):
            more = order[opened : opened + step]
            size = self.bounds[more + 1] - self.bounds[more]
            at = np.repeat(self.bounds[more] - np.cumsum(size) + size, size) + np.arange(size.sum())
            s = np.bincount(self.rows[at], dense[self.cols[at]] * self.vals[at], len(self.weight))
            if without >= 0:
                s[without] = 0
            hit = np.flatnonzero(s)
            ids, sims = np.concatenate([ids, hit]), np.concatenate([sims, s[hit]])
            opened += len(more)
            if self.weight[ids].sum() >= weight_needed:
                by = np.argsort(-sims, kind="stable")
                last = min(np.searchsorted(np.cumsum(self.weight[ids[by]]), weight_needed), len(by) - 1)
                floor = sims[by[last]] - 1e-12
                ids, sims = ids[sims >= floor], sims[sims >= floor]
                step = int((bound[order[opened:]] >= floor).sum())
                if not step:
                    break
            else:
                step *= 4
        by = np.lexsort((ids, -sims))
        return ids[by], sims[by]

    def vote(self, counts: dict[int, int], without: int = -1) -> tuple[float | None, list]:
        """The share of toxic weight among the nearest, by cosine; None if nothing
        is near. Also the ids of up to three nearest examples. An entry can be left
        out, with all of its examples, which have equal vectors."""
        if not counts:
            return None, []
        ids, sims = self.nearest(self.vector(counts), NEIGHBOURS, without)
        if not len(ids):
            return None, []
        near = self.weight[ids] * sims
        return float((self.toxic[ids] * sims).sum() / near.sum() * (near.sum() / (near.sum() + 0.5)) + self.base * 0.5 / (near.sum() + 0.5)), [self.doc[i] for i in ids[:3]]

    def calibrate(self, votes: list[tuple[int, float | None]]) -> None:
        """Monotone map from votes to shares of toxic examples, from ``(entry, vote)``
        of each entry without itself (pool adjacent violators, then midpoints)."""
        seen = [(v, self.weight[i], self.toxic[i]) for i, v in votes if v is not None]
        pools: list[list[float]] = []
        for v, w, t in sorted(seen):
            pools.append([v * w, w, t])
            while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            self.xs = np.array([p[0] / p[1] for p in pools])
            self.ys = np.array([(p[2] + self.base) / (p[1] + 1) for p in pools])  # one example's worth of the overall share
            self.ys = np.maximum.accumulate(self.ys)

    def score(self, vote: float | None, none_near: float) -> float:
        return none_near if vote is None else float(np.clip(np.interp(vote, self.xs, self.ys), 0, 1))


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> tuple[Index, float]:
    """The index over at most ``most`` labelled rows outside the held-out fold, and
    the share of toxic examples among those without any term of the index.

    The sample is the only thing gathered on the driver: ids and labels first
    (``most`` rows), then the distinct vectors of the examples (no more).
    """
    spark = smaller_batches(docs).sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = materialize(known.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one text an id, so the examples are at most `most` rows, however many rows share an id
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    seen = materialize(texts.mapInArrow(_example_words, f"doc_id {kind}, toxic int, words array<string>, counts array<int>, sketch array<long>"))
    # an example weighs as one of those that share a sketch with it, by the sketch that most share
    own = seen.select("doc_id", F.posexplode("sketch").alias("fn", "sketch"))
    copies = own.join(own.groupBy("fn", "sketch").agg(F.count("*").alias("copies")), ["fn", "sketch"]).groupBy("doc_id").agg(F.max("copies").alias("copies"))
    seen = materialize(seen.join(copies, "doc_id").select("doc_id", "toxic", "words", "counts", (1.0 / F.col("copies")).alias("w")))
    total = seen.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("toxic")).alias("t")).first()
    n_all, base = total["n"] or 0.0, (total["t"] or 0.0) / (total["n"] or 1.0)
    if not 0 < base < 1:
        return Index([], np.empty(0), [], base), base
    rates = materialize(
        seen.select("w", "toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("toxic")).alias("t")).where(F.col("n") >= LEAST_DF)
    )
    share = F.col("t") / F.col("n")
    gain = F.col("t") * F.log(share / base) + F.when(share < 1, (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    tried = max(1, rates.count())
    # Chernoff's bound on chance, divided among the words tried; bounded by the sample's words over LEAST_DF
    terms = rates.where((share > base) & (gain > float(np.log(20 * tried)))).select("word", "n").orderBy("word").collect()
    ids = {r["word"]: i for i, r in enumerate(terms)}
    chosen = spark.createDataFrame([(r["word"], i) for r, i in zip(terms, ids.values(), strict=True)], "word string, term int")
    pairs = seen.select("doc_id", "toxic", "w", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("doc_id", "toxic", "w", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    vectors = pairs.join(F.broadcast(chosen), "word").groupBy("doc_id", "toxic", "w").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("vector"))  # `chosen` is bounded as `terms`
    entries = vectors.groupBy("vector").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("toxic")).alias("t"), F.min("doc_id").alias("doc")).collect()
    idf = np.array([np.log(1 + n_all / r["n"]) for r in terms])
    rows = sorted(([tuple((p["term"], p["n"]) for p in e["vector"]), e["w"], e["t"], e["doc"]] for e in entries), key=lambda e: e[0])
    index = Index(list(ids), idf, rows, base)
    shared = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            votes = [shared.value.vote(dict(shared.value.entries[i][0]), without=i)[0] for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(votes, pa.float64())], ["id", "vote"])

    # votes of the sample's entries, in tasks of some hundreds
    votes = spark.range(0, len(rows), 1, max(1, -(-len(rows) // 500))).mapInArrow(left_out, "id long, vote double").collect()
    index.calibrate([(r["id"], r["vote"]) for r in votes])
    with_terms, toxic_with = float(index.weight.sum()), float(index.toxic.sum())
    rest = (n_all - with_terms, n_all * base - toxic_with)
    return index, float(np.clip((rest[1] + base) / (rest[0] + 1), 0, 1))


class _Scorer:
    """Scores of texts; equal vectors are looked up once while this is kept."""

    def __init__(self, index: Index, none_near: float):
        self.index, self.none_near = index, none_near
        self.cache: dict[tuple, tuple[float, list]] = {}

    def score(self, text: str | None) -> tuple[float, list]:
        terms = self.index.terms
        key = tuple(sorted((t, level(n)) for t, n in Counter([terms[w] for w in text_words(text) if w in terms]).items()))
        if key not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            vote, near = self.index.vote(dict(key))
            self.cache[key] = self.index.score(vote, self.none_near), near
        return self.cache[key]


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, cutoff: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``cutoff`` or more; all columns pass
    unchanged. See ``score_toxicity`` for nulls and labels."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*shared.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t.as_py())[0] < cutoff for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for each row of ``docs(doc_id, text)``.

    ``evidence`` lists up to three of the nearest labelled examples. Labels come
    from ``labels(doc_id, toxic)`` rows outside the held-out fold; of several rows
    of an id the highest counts, null ids and null labels are passed over; of
    several texts of an id the example is the smallest. The
    score depends on the text alone. Texts without any term of the index, empty
    and null ones too, get the smoothed share of toxic examples among such
    texts; without labels, or with labels of one kind only, every score is that
    kind's share. Documents are scored where they are read. Other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*shared.value)
        for b in batches:
            out = [scorer.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(b.column("doc_id").type))], ["doc_id", "held_out", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, evidence array<{kind}>")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
