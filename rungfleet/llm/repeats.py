"""Long repeated substrings, marked through run-length indexes.

Texts are UTF-8 bytes; a start is marked if the ``length`` bytes from it also
start anywhere else, in any document. The corpus is cut for this by content:
each window of ``length`` bytes is owned by its anchor, the k-gram of smallest
hash in it, so equal windows have equal anchors. Windows in a row that share
an anchor occurrence make a fragment.

1. Anchors that occur once own nothing repeated. They are found by one count
   per anchor, and everything else is left out of what follows.
2. A fragment that occurs twice as a whole is repeated as a whole.
3. Where an anchor has several different fragments, one copy of each goes to
   the anchor's shard. A shard builds the suffix order of its fragments (unique
   separators between them), run-compresses its Burrows-Wheeler transform, and
   keeps the longest match with the neighbour only at the ends of runs; in
   between, a match is that of the text position before, less one. Streaming
   over the text with these samples gives the matching statistics of every
   position, and starts with a match of ``length`` or more are marked.

A shard has a few hundred kilobytes, whatever the input. An anchor with very many
different fragments would not fit one: its fragments are taken as texts of their
own and cut again, by anchors of twice the length, which differ wherever one of
more bytes differs, into overlapping pieces that go to shards of their own, and so
on. Anchors as long as the windows are the last ones: equal anchors are then equal
windows, so every level works alike and the last one leaves nothing open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, smaller_batches
from .wordsets import bitmap_size, key_bitmap, mix, test_bits

LENGTH, GRAM = 200, 32
#: Bytes of text hashed at a time; positions in it take 18 bits.
CHUNK = 1 << 18
#: Bytes of fragments that a shard has on average; fragments of one anchor beyond which they are cut again.
SHARD_BYTES, MANY = 1 << 18, 3000
#: Odd multipliers of the two rolling hashes.
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POS = np.uint64(CHUNK - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    if base not in _powers:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(CHUNK + 1, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[base] = both[0], both[1]
    return _powers[base]


class _Rolling:
    """Hashes of any substring of ``data``, two of them."""

    def __init__(self, data: np.ndarray, base: int):
        power, self.inverse = _power(base)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[at]


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of ``w`` values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into chunks: the bytes; and for each part its place in the
    chunk, the text it is from and its offset there. A text over a chunk's size
    goes into several, which overlap by ``length - 1``."""
    parts: list[tuple[int, int, bytes]] = []
    total = 0

    def flush():
        sizes = [len(p) for _, _, p in parts]
        return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.cumsum([0, *sizes]), np.array([i for i, _, _ in parts]), np.array([o for _, o, _ in parts])

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for o in range(0, max(1, len(text) - length + 1), CHUNK - length + 1):
            part = text[o : o + CHUNK]
            if total + len(part) > CHUNK:
                yield flush()
                parts, total = [], 0
            parts.append((i, o, part))
            total += len(part)
    if parts:
        yield flush()


def fragments(texts: list[bytes], length: int, gram: int, seed: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """For each fragment: ``anchor`` and ``frag`` (hashes), ``text`` (index), ``at``
    (first window start in the text), ``windows`` (number of starts). ``seed``
    chooses the hash function."""
    w = length - gram + 1
    for data, bounds, which, offset in _pieces(texts, length):
        one, two = _Rolling(data, _BASE), _Rolling(data, _BASE2)
        n = len(data) - gram + 1
        grams = mix(one.of(slice(0, n), slice(gram, gram + n), slice(0, n)) ^ np.uint64(seed * _BASE2 & 0xFFFFFFFFFFFFFFFF))
        least = _window_minima((grams & ~_POS) | np.arange(n, dtype=np.uint64), w) & _POS
        part = np.repeat(np.arange(len(which)), np.maximum(np.diff(bounds) - length + 1, 0))
        starts = np.arange(len(part)) - np.repeat(np.cumsum([0, *np.maximum(np.diff(bounds) - length + 1, 0)])[:-1], np.maximum(np.diff(bounds) - length + 1, 0)) + bounds[part]
        anchor = least[starts].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(part) != 0)]))
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        a, b, p = starts[first], starts[last], anchor[first]
        shape = ((p - a) * 4096 + (b - a)).astype(np.uint64)
        yield {
            "anchor": grams[p].view(np.int64),
            "frag": mix(two.of(a, b + length, a) ^ mix(shape)).view(np.int64),
            "text": which[part[first]],
            "at": a - bounds[part[first]] + offset[part[first]],
            "windows": b - a + 1,
        }


def _suffix_ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Ranks of the suffixes by their first h, 2h, 4h, ... symbols until all differ,
    and h: 4 where four symbols fit one number, else 1."""
    n, base = len(symbols), int(symbols.max()) + 2
    h = 4 if base**4 < 1 << 62 else 1
    padded = np.concatenate([symbols + 1, np.zeros(h, np.int64)])
    key = padded[:n]
    for i in range(1, h):
        key = key * base + padded[i : i + n]
    levels, first = [np.unique(key, return_inverse=True)[1].astype(np.int32)], h
    while levels[-1].max() < n - 1:
        r = levels[-1].astype(np.int64)
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = r[h:] + 1
        levels.append(np.unique(r * (n + 1) + ahead, return_inverse=True)[1].astype(np.int32))
        h *= 2
    return levels, first


def _common_prefix(symbols: np.ndarray, levels: list[np.ndarray], first: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of the common prefix of suffixes ``x`` and ``y``."""
    n, far = len(symbols), np.zeros(len(x), np.int64)
    for table, step in [(levels[k], first << k) for k in range(len(levels) - 1, -1, -1)] + [(symbols, 1)] * (first - 1):
        i, j = x + far, y + far
        ok = (i < n) & (j < n)
        same = np.zeros(len(x), bool)
        same[ok] = table[i[ok]] == table[j[ok]]
        far += same * step
    return far


class RunLengthIndex:
    """The runs of a Burrows-Wheeler transform, with the text position and the
    longest match at each run's two ends. The suffix order itself is not kept."""

    def __init__(self, symbols: np.ndarray):
        levels, first = _suffix_ranks(symbols)
        self.n = n = len(symbols)
        order = np.empty(n, np.int64)
        order[levels[-1]] = np.arange(n)
        before = np.where(order > 0, symbols[order - 1], -1)
        change = before[1:] != before[:-1]
        heads = np.flatnonzero(np.concatenate([[True], change]))
        tails = np.flatnonzero(np.concatenate([change, [True]]))
        self.head_at, self.tail_at = order[heads], order[tails]
        self.head_match, self.tail_match = np.zeros(len(heads), np.int64), np.zeros(len(tails), np.int64)
        self.head_match[1:] = _common_prefix(symbols, levels, first, order[heads[1:] - 1], order[heads[1:]])
        self.tail_match[:-1] = _common_prefix(symbols, levels, first, order[tails[:-1]], order[tails[:-1] + 1])

    def matching_statistics(self) -> np.ndarray:
        """The longest match of each text position with any other, in one pass
        over the text: the nearest sample before it, less the distance."""
        best = np.zeros(self.n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            sampled, value = np.full(self.n, -1, np.int64), np.zeros(self.n, np.int64)
            sampled[at], value[at] = at, match
            near = np.maximum.accumulate(sampled)
            best = np.maximum(best, np.where(near >= 0, value[near] - (np.arange(self.n) - near), 0))
        return best


def repeated_starts(fragments: list[bytes], length: int) -> list[np.ndarray]:
    """For each fragment, the starts of ``length``-byte strings that also start
    elsewhere in it or in another."""
    sizes = np.array([len(f) for f in fragments])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.int64) + len(fragments)
    symbols[ends] = np.arange(len(fragments))  # each separator once
    stat = RunLengthIndex(symbols).matching_statistics()
    return [np.flatnonzero(stat[e - s : e - length + 1] >= length) for s, e in zip(sizes, ends, strict=True)]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted starts as the byte ranges they cover, those in a row as one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist(), strict=True))


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text").cast(pa.binary())]


def _anchors(docs: DataFrame, length: int, gram: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in fragments(_texts(b), length, gram, seed):
                yield pa.RecordBatch.from_arrays([pa.array(f["anchor"]), pa.array(f["frag"])], ["anchor", "frag"])

    return docs.select("text").mapInArrow(run, "anchor long, frag long")


def _occurrences(docs: DataFrame, length: int, gram: int, seed: int, anchors: DataFrame, with_bytes: bool) -> DataFrame:
    """Fragments of the given anchors: where they are, or what bytes they have."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(anchors, F.col("anchor"), bitmap_size(anchors.count())))  # 16 MB at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            for f in fragments(texts, length, gram, seed):
                at = np.flatnonzero(test_bits(bitmap.value, f["anchor"].view(np.uint64)))
                f = {k: v[at] for k, v in f.items()}
                keys = [pa.array(f["anchor"]), pa.array(f["frag"])]
                if with_bytes:
                    body = [texts[t][s : s + n + length - 1] for t, s, n in zip(f["text"].tolist(), f["at"].tolist(), f["windows"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(body, pa.binary())], ["anchor", "frag", "body"])
                else:
                    own = b.select(["doc_id", "row"]).take(pa.array(f["text"]))
                    yield pa.RecordBatch.from_arrays([*keys, *own.columns, pa.array(f["at"]), pa.array(f["windows"], pa.int32())], ["anchor", "frag", "doc_id", "row", "at", "windows"])

    if with_bytes:
        found = docs.select("text").mapInArrow(run, "anchor long, frag long, body binary").dropDuplicates(["anchor", "frag"])
    else:
        found = docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(run, f"anchor long, frag long, doc_id {kind}, row long, at long, windows int")
    return found.join(anchors, "anchor")


def row_key() -> Column:
    """Tells rows that share an id apart by their texts; equal rows have equal spans."""
    return F.xxhash64("text")


def _marked_in_shards(classes: DataFrame, length: int) -> DataFrame:
    """``anchor, frag, spans`` from the shards' indexes."""
    total = classes.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(64, -(-total // SHARD_BYTES))

    def run(table: pa.Table) -> pa.Table:
        starts = repeated_starts(table.column("body").to_pylist(), length)
        spans = [[{"start": s, "stop": e} for s, e in _spans(x, length)] for x in starts]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.Table.from_arrays([table.column("anchor"), table.column("frag"), pa.array(spans, kind)], ["anchor", "frag", "spans"])

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return classes.select("anchor", "frag", "body", shard.alias("shard")).groupBy("shard").applyInArrow(run, "anchor long, frag long, spans array<struct<start:long,stop:long>>")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY, seed: int = 0) -> DataFrame:
    """``doc_id, row, spans``: byte ranges of the rows of ``docs(doc_id, text)`` that
    are covered by ``length``-byte strings which also start elsewhere. Ranges may
    overlap, touch or repeat. ``row`` is ``row_key()``; rows without such a range are
    left out, and equal rows come out once. ``gram`` doubles and ``seed`` counts with
    each level, up to anchors of ``length`` bytes."""
    docs = smaller_batches(docs.select("doc_id", "text"))
    counts = _anchors(docs, length, gram, seed).groupBy("anchor").agg(F.count("*").alias("n"), F.min("frag").alias("lo"), F.max("frag").alias("hi")).where("n > 1")
    anchors = materialize(counts.select("anchor", (F.col("lo") != F.col("hi")).alias("differ")))
    seen = materialize(_occurrences(docs, length, gram, seed, anchors, False))
    per_frag = materialize(seen.groupBy("anchor", "frag", "differ").agg(F.count("*").alias("n")))
    whole = per_frag.where("n > 1").select("anchor", "frag")
    # anchors with different fragments, of which one at least occurs once
    open_anchors = materialize(per_frag.where("differ").groupBy("anchor").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1").select("anchor", "kinds"))
    bodies = materialize(_occurrences(docs, length, gram, seed, open_anchors, True))
    crowded = (F.col("kinds") > many) if gram < length else F.lit(False)  # anchors of `length` bytes are equal windows
    partial = _marked_in_shards(bodies.where(~crowded), length)
    hot = bodies.where(crowded)
    if not hot.isEmpty():
        inner = repeated_spans(hot.select(F.col("frag").alias("doc_id"), F.col("body").alias("text")), length, min(length, 2 * gram), many, seed + 1)
        again = hot.select("anchor", "frag", F.xxhash64("body").alias("row")).join(inner.withColumnRenamed("doc_id", "frag"), ["frag", "row"])
        partial = partial.union(again.select("anchor", "frag", "spans"))
    partial = materialize(partial.where(F.size("spans") > 0))
    full = seen.join(whole, ["anchor", "frag"], "left_semi").select("doc_id", "row", F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("windows") + (length - 1)).alias("stop"))).alias("spans"))
    some = seen.join(partial, ["anchor", "frag"]).select("doc_id", "row", F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["stop"] + F.col("at")).alias("stop"))).alias("spans"))
    # a document has at most one span a window, so its list is bounded by its text
    return materialize(full.union(some).groupBy("doc_id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def _with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` split into rows that may have spans, joined with them, and rows that
    have none, and the name of the column with the spans. Only the former are
    shuffled."""
    columns, key, name = docs.columns, fresh(docs, "row_key"), fresh(docs, "spans")
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(spans, F.col("row"), bitmap_size(spans.count())))
    keyed = docs.withColumn(key, row_key())

    def run(wanted: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = test_bits(bitmap.value, b.column(key).to_numpy(zero_copy_only=False).view(np.uint64))
                yield b.filter(pa.array(hit == wanted))

        return keyed.mapInArrow(pick, keyed.schema)

    some = run(True).alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(f"d.{key}") == F.col("s.row")), "left")
    return some.select(*[F.col(f"d.`{c}`") for c in columns], F.col("s.spans").alias(name)), run(False).drop(key), name


def cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of the text without the spans, bytes removed, and maximal runs."""
    kept, runs, at = [], 0, 0
    for s in sorted((s["start"], s["stop"]) for s in spans or []):
        if s[0] > at or not runs:
            kept.append(text[at : s[0]])
            runs += 1
        at = max(at, s[1])
    kept.append(text[at:])
    out = b"".join(kept)
    return out, len(text) - len(out), runs


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of
    ``docs(doc_id, text)``.

    Null texts count as empty; texts under ``length`` bytes have no spans. Rows
    are texts of their own: repeated rows of ``length`` bytes or more repeat each
    other, whatever their ids, null included. An empty table gives an empty
    result. Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    some, rest, _ = _with_spans(docs, repeated_spans(docs, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            done = [cut(t, s) for t, s in zip(texts, b.column("spans").to_pylist(), strict=True)]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([r for _, _, r in done], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in done], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = some.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    return marked.union(rest.select("doc_id", F.octet_length("text").cast("long"), zero, zero, F.sha2(F.col("text").cast("binary"), 256)))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (a character cut in half
    goes too) and without the rows of which no word is left. Rows that had no
    word, null ones too, go as well. Other columns pass unchanged, whatever they
    are called."""
    some, rest, name = _with_spans(docs, repeated_spans(docs, length))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [cut(t, s)[0].decode("utf-8", "ignore") for t, s in zip(_texts(b), b.column(name).to_pylist(), strict=True)]
            at = b.schema.get_field_index("text")
            b = b.select([c for c in b.schema.names if c != name])
            yield b.set_column(at, "text", pa.array(left, pa.string()))

    return some.mapInArrow(run, schema).union(rest).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
