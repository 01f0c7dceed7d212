"""Token counts with a shortcut for pre-tokens that are one token.

Which vocabulary strings encode alone as one token is proved once, on the
driver, by encoding each of them. A text is split into pre-tokens; those in the
proven set count one each, and only the others are merged, each distinct one
once as long as it stays in a bounded memory of the worker.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of byte-level BPE vocabularies of this kind, and its byte alphabet's printable ranges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))

#: Merged pre-tokens that a worker remembers before it starts anew.
MEMORY = 300_000

_workers: dict = {}


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary."""
    shown = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def whole_tokens(tokenizer_json: str) -> list[str]:
    """Vocabulary strings that, as a text of their own, encode as that one token
    and form one pre-token. Bounded by the vocabulary."""
    import regex
    from tokenizers import Tokenizer

    tok, split = Tokenizer.from_str(tokenizer_json), regex.compile(PATTERN)
    back = {c: b for b, c in byte_alphabet().items()}
    proven = []
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if len(split.findall(text)) == 1 and tok.encode(text, add_special_tokens=False).ids == [i]:
            proven.append(text)
    return proven


def check_supported(tokenizer_json: str) -> None:
    """Raises ``ValueError`` for files whose rules are not those counted here: BPE
    over bytes with the split pattern above, no normalizer, and special strings
    that match as they are."""
    spec = json.loads(tokenizer_json)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level files without a normalizer or prefix space are supported")
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain BPE models are supported")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("added tokens that strip, need word bounds or are normalized are not supported")


class _Counter:
    """A worker's tokenizer, with what it has merged so far."""

    def __init__(self, tokenizer_json: str, proven: list[str]):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.split = regex.compile(PATTERN).findall
        self.proven = dict.fromkeys(proven, 1)
        self.bytes = byte_alphabet()
        self.merged = dict(self.proven)
        special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def merge(self, pre: str) -> int:
        if len(self.merged) > len(self.proven) + MEMORY:
            self.merged = dict(self.proven)
        n = self.merged[pre] = len(self.tok.model.tokenize("".join(map(self.bytes.__getitem__, pre.encode()))))
        return n

    def count(self, text: str) -> int:
        n, parts = 0, [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        for part in parts:
            for pre, k in Counter(self.split(part)).items():
                n += k * (self.merged.get(pre) or self.merge(pre))
        return n


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    ``tokenizer_path`` is a byte-level BPE file of the ``tokenizers`` library,
    read on the driver and sent to the executors (a vocabulary, whose size does
    not follow the data); a file with other rules is refused. Counts are those of the library without begin or end
    tokens; special strings inside a text count as their one token. No shuffle:
    each document is counted where it is read. Null and empty texts have no
    bytes and no tokens. Rows are independent, so repeated rows and null ids
    come out as they went in. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    check_supported(spec)
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value[0])
        worker = _workers.get(key) or _workers.setdefault(key, _Counter(*shared.value))
        for b in batches:
            counts = pa.array([worker.count(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
