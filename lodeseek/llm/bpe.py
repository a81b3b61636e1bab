"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is halved down to leaves, the leaves are encoded in parallel threads, and neighbours are
joined up the tree: a window of pieces around the join is encoded anew and grows until its first and
last piece are those that the two sides have already, so that the rest of both sides stands as it is.
(The pattern reads left to right without looking back: once two readings share a boundary, they agree
from there on.) A long piece that the pattern does not split is encoded the same way over tokens: a
token sequence is the encoding of its bytes if each two neighbours are the encoding of theirs, so a
window whose outer tokens are unchanged makes the join exact.

The vocabulary is read from a tokenizer file on the driver, and broadcast: its size is fixed.
"""

import hashlib
import itertools
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import arrow_map

#: Fixed value: the pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are encoded as a tree of leaves of at most this many.
LEAF_CHARS = 1 << 16
#: Pieces of more bytes are encoded as a tree over tokens.
LEAF_BYTES = 1 << 10
THREADS = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def check_spec(spec: dict) -> None:
    """Raises ValueError if a tokenizer file asks for anything that this encoder does not do."""
    model, split, decoder = (spec.get(k) or {} for k in ("model", "pre_tokenizer", "decoder"))
    fault = None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        fault = "its model is no plain byte-level BPE"
    elif spec.get("normalizer"):
        fault = "it normalises texts"
    elif split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        fault = "it splits texts in another way"
    elif decoder.get("type") != "ByteLevel":
        fault = "it decodes in another way"
    elif any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        fault = "its added tokens take more than their own text"
    else:
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ids = [model["vocab"].get("".join(m), -1) for m in merges]
        # Pieces are merged by rank of the token that results, so ids have to follow the order of merges.
        if any(b <= a for a, b in itertools.pairwise([-1, *ids])):
            fault = "the order of its merges is not that of its ids"
    if fault:
        raise ValueError(f"this tokenizer file can't be used: {fault}")


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks by bytes, and special tokens by text, of a byte-level BPE file; other files are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check_spec(spec)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # Printable bytes stand for themselves in the file, the others for the code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return ranks, special


class TreeEncoder:
    """Encodes and decodes texts; ids are those of the vocabulary, special tokens included."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        self.base = tiktoken.Encoding("tree", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.leaf_chars, self.leaf_bytes = special, leaf_chars, leaf_bytes
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.long_run = regex.compile(r"\p{L}{%d}|\p{N}{%d}|\s{%d}|[^\s\p{L}\p{N}]{%d}" % ((max(1, leaf_bytes // 4),) * 4))
        self.pool = ThreadPoolExecutor(THREADS)

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(t in text for t in self.special):
            return self._segment(text)
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                ids.append(self.special[part])
            else:
                ids += self._segment(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")

    def _segment(self, text: str) -> list[int]:
        if len(text) > self.leaf_chars:
            return self._tree(text)[0]
        if self.long_run.search(text) is None:
            return self.base.encode_ordinary(text)
        return self._pieces(self.find(text))

    def _pieces(self, pieces: list[str]) -> list[int]:
        """Encodes given pieces; the base takes runs of short ones, each long one is a tree of its own."""
        ids: list[int] = []
        for p in pieces:
            b = p.encode()
            if len(b) > self.leaf_bytes:
                ids += self._piece(b)
            else:
                ids += self.base._encode_single_piece(b)
        return ids

    def _leaf(self, text: str) -> tuple[list[int], list[str]]:
        pieces = self.find(text)
        return (self.base.encode_ordinary(text) if self.long_run.search(text) is None else self._pieces(pieces)), pieces

    def _tree(self, text: str) -> tuple[list[int], list[str]]:
        count = 1
        while len(text) / count > self.leaf_chars:
            count *= 2
        marks = [len(text) * k // count for k in range(count + 1)]
        nodes = list(self.pool.map(self._leaf, (text[a:b] for a, b in zip(marks, marks[1:], strict=False))))
        while len(nodes) > 1:
            nodes = list(self.pool.map(lambda ab: self._join(*ab), zip(nodes[::2], nodes[1::2], strict=True)))
        return nodes[0]

    def _tokens_in(self, ids: Iterator[int], size: int) -> int:
        count = 0
        while size > 0:
            size -= len(self.bytes_of[next(ids)])
            count += 1
        return count

    def _join(self, left: tuple, right: tuple) -> tuple[list[int], list[str]]:
        (a, pa_), (b, pb) = left, right
        width = 2
        while True:
            before, after = pa_[-width:], pb[:width]
            window = self.find("".join(before) + "".join(after))
            # The last piece of the left side may go on, so at least one before it has to stand.
            if (len(before) == len(pa_) or window[0] == before[0]) and (len(after) == len(pb) or window[-1] == after[-1]):
                break
            width *= 2
        cut_a = len(a) - self._tokens_in(iter(reversed(a)), sum(len(p.encode()) for p in before))
        cut_b = self._tokens_in(iter(b), sum(len(p.encode()) for p in after))
        return a[:cut_a] + self._pieces(window) + b[cut_b:], pa_[: len(pa_) - len(before)] + window + pb[len(after) :]

    def _piece(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.base._encode_single_piece(data)
        half = len(data) // 2
        left, right = self._piece(data[:half]), self._piece(data[half:])
        width = 2
        while True:
            before, after = left[-width:], right[:width]
            window = self.base._encode_single_piece(b"".join(self.bytes_of[i] for i in before + after))
            if (len(before) == len(left) or window[0] == before[0]) and (len(after) == len(right) or window[-1] == after[-1]):
                return left[: len(left) - len(before)] + window + right[len(after) :]
            width *= 2


_ENCODERS: dict[int, TreeEncoder] = {}


def _encoder(shared) -> TreeEncoder:
    """This worker's encoder for a broadcast vocabulary."""
    if shared.bid not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.bid] = TreeEncoder(*shared.vocabulary.value)
    return _ENCODERS[shared.bid]


class _Shared:
    def __init__(self, spark, path: str):
        self.vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
        self.bid = self.vocabulary._jbroadcast.id()

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "bid": self.bid}


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token ids of each text: the id column and ids (array of int).

    One row per input row; a null text counts as empty and has no tokens; ids may be null or repeat.
    Special tokens written in a text get their own ids, as with the file's own library. Other columns
    are not read.
    """
    shared = _Shared(docs.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_encoder(shared).encode(t) for t in _texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The texts of token ids: the id column and text.

    One row per input row, repeated rows and null ids too. A null array counts as no ids and gives an empty
    text; bytes that are no UTF-8 give replacement characters; an id that the vocabulary lacks raises. Empty
    tables give no rows; other columns are not read.
    """
    shared = _Shared(encoded.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_encoder(shared).decode(v.as_py() or []) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encodes each text, decodes the ids, and returns digests of both: id, n_tokens, ids_sha256, decoded_sha256.

    The same rules as bpe_encode; the ids come too if keep_ids, and stay in the worker otherwise.
    """
    shared = _Shared(docs.sparkSession, path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for batch in batches:
            encoder = _encoder(shared)
            names = names or [str(i) for i in range(len(encoder.bytes_of))]
            counts, of_ids, of_texts, kept = [], [], [], []
            for text in _texts(batch, "text"):
                ids = encoder.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_texts.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
            if keep_ids:
                marks = np.cumsum([0, *counts]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(marks), pa.array(np.concatenate([*kept, np.zeros(0, np.int32)]))))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = arrow_map(rows, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("id", id_col)
