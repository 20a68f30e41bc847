"""Byte-level BPE over a public vocabulary file, and back.

A word keeps its parts in contiguous arrays: the boundaries, the parts' ids and the rank of each adjacent pair.  The
smallest rank is found by scanning, its boundary is deleted and the two neighbouring ranks are refreshed, until no pair
has a rank.  Words here have a few bytes, for which scanning beats any queue; a run of letters of more than ``LONG``
bytes goes through a heap with the same order of merges, so no text costs the square of its length.

The vocabulary (a tokenizer JSON file with a BPE model, byte-level pre-tokens and added tokens) is read by the driver and
broadcast; its size is that of the file and doesn't grow with the data.  Workers keep the ids of words they met, in two
generations of bounded size.

Defined results: a null text is an empty one and has no ids; null ids and repeated rows are rows like others; extra
columns pass through, clashing ones (``ids``, ``decoded``) are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm._shared import plain_columns, ready

LONG = 400
#: Words kept in one generation of a worker's memory of words.
KEPT_WORDS = 150_000
NO_RANK = 1 << 30
#: White space as Unicode has it (the property), which is what byte-level pre-tokenisers split at.
_S = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf" ?\p{{L}}+|'(?:s|t|re|ve|m|ll|d)| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """Merges, ids and bytes of one tokenizer file."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk")):
            raise ValueError("dropout, unknown tokens, prefixes and suffixes are not supported")
        if any(t.get(x) for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in white space or match whole words are not supported")
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level pre-tokens without a prefix space are supported")
        ids: dict[str, int] = model["vocab"]
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = self._raw(token, letters)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = self._raw(token, letters)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _raw(token: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by the contiguous rank array."""
        if len(word) > LONG:
            return self._merge_long(word)
        ids = [self.of_byte[b] for b in word]
        bounds = list(range(len(word) + 1))
        pair = self.merges.get
        none = (NO_RANK, -1)
        ranks = [pair(a << 32 | b, none)[0] for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            ids[i] = pair(ids[i] << 32 | ids[i + 1])[1]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pair(ids[i - 1] << 32 | ids[i], none)[0]
            if i < len(ranks):
                ranks[i] = pair(ids[i] << 32 | ids[i + 1], none)[0]
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges for a long run: a heap of (rank, place) over a linked list."""
        ids: list[int] = [self.of_byte[b] for b in word]
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i] = self.merges[a << 32 | b][1]
            ids[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for x in (prev[i], i):
                if x >= 0 and nxt[x] < n and (m := self.merges.get(ids[x] << 32 | ids[nxt[x]])):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[nxt[x]]))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        made = self.old.get(piece)
        if made is None:
            made = np.array(self.merge(piece.encode()), dtype=np.int32).tobytes()
        if len(piece) <= LONG:
            if len(self.young) >= KEPT_WORDS:
                self.old, self.young = self.young, {}
            self.young[piece] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.split_added and any(t in text for t in self.added):
            parts = self.split_added.split(text)
            return b"".join(np.int32(self.added[p]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        get, make = self.young.get, self._piece
        out = []
        for piece in PIECES.findall(text):
            made = get(piece)
            if made is None:
                made = make(piece)
                get = self.young.get
            out.append(made)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids if 0 <= i < len(table)]).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(raw: bytes) -> Vocabulary:
    """One vocabulary a worker."""
    key = hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


def _with(docs: DataFrame, new: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{new} {kind}"])


@plain_columns(("ids",), ("text_col",))
def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the tokens of the whole text under the tokenizer file at ``path``."""
    spark = ready(docs.sparkSession)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kinds, at = _with(docs, "ids", "array<int>"), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for batch in batches:
            made = [v.encode(t) if t else b"" for t in batch.column(at).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(m) // 4 for m in made])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(made), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, kinds)


@plain_columns(("decoded",), ("ids_col",))
def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids (null for null ids; special tokens are kept)."""
    spark = ready(rows.sparkSession)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kinds, at = _with(rows, "decoded", "string"), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for batch in batches:
            col = batch.column(at)
            texts = []
            for i in range(len(col)):
                ids = col[i].values
                texts.append(None if ids is None else v.decode(ids.to_numpy(zero_copy_only=False).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, kinds)
