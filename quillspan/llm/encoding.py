"""Encoding with a byte-level BPE vocabulary of public_tokenizers.

The different words of an Arrow partition (of each PART_CHARS characters, where it holds more) that were not met before are
laid out behind each other and every mergeable pair is mapped to all its positions.  The ranks that occur are applied in ascending order, each at all its positions at once, and only the lists of the pairs
beside a merge are updated.  A merge can only make pairs of later rank, so this gives each word the ids that merging
it alone, lowest rank first, would give.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.shared import spread

#: Characters of texts that are split and indexed together.
PART_CHARS = 8_000_000
#: Distinct words a task remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED_WORDS = 500_000

# Fixed value: the pattern that splits text before the merges of the vocabulary (public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The file of a public tokenizer: in ``folder``, else where public_tokenizers keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Vocabulary:
    """Ids of the 256 bytes, and for each mergeable pair of ids (rank, id of the merged token)."""

    byte_ids: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level BPE."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    names, spare = [], 256
    for byte in range(256):
        names.append(chr(byte if byte in shown else spare))
        spare += byte not in shown
    return names


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the library ``tokenizers``."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[ids[left], ids[right]] = rank, ids[left + right]
    return Vocabulary([ids[x] for x in _byte_names()], merges)


def encode_words(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word, by one pair occurrence index over all of them."""
    merges, byte_ids = vocabulary.merges, vocabulary.byte_ids
    symbols: list[int] = []
    ends = []
    for word in words:
        symbols.extend(byte_ids[b] for b in word.encode("utf-8", "surrogatepass"))
        symbols.append(-1)  # no pair reaches over it
        ends.append(len(symbols) - 1)
    size = len(symbols)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if pair in merges:
            places.setdefault(pair, []).append(i)
    active = [(merges[pair][0], pair) for pair in places]
    heapq.heapify(active)

    def note(pair: tuple[int, int], at: int) -> None:
        if pair in merges:
            found = places.get(pair)
            if found is None:
                places[pair] = [at]
                heapq.heappush(active, (merges[pair][0], pair))
            else:
                found.append(at)

    while active:
        _, pair = heapq.heappop(active)
        left, right = pair
        merged = merges[pair][1]
        for at in sorted(places.pop(pair)):
            other = after[at]
            if symbols[at] != left or other >= size or symbols[other] != right:
                continue  # taken by a merge in between
            symbols[at], symbols[other] = merged, -2
            follower = after[at] = after[other]
            before[follower] = at
            if at > 0 and symbols[before[at]] >= 0:
                note((symbols[before[at]], merged), before[at])
            if symbols[follower] >= 0:
                note((merged, symbols[follower]), at)
    out, start = [], 0
    for end in ends:
        out.append([x for x in symbols[start:end] if x >= 0])
        start = end + 1
    return out


class Encoder:
    """Encodes batches of texts; words met before are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; NULL and empty ones have no ids."""
        words = [self.split(text) if text else [] for text in texts]
        new = list(dict.fromkeys(w for each in words for w in each if w not in self.known))
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known = {}
            new = list(dict.fromkeys(w for each in words for w in each))
        self.known.update(zip(new, encode_words(new, self.vocabulary), strict=True))
        known = self.known
        ids: list[int] = []
        offsets = [0]
        for each in words:
            for word in each:
                ids.extend(known[word])
            offsets.append(len(ids))
        return np.array(offsets, dtype=np.int64), np.array(ids, dtype=np.int32)


def encode_texts(rows: DataFrame, *, id: str = "doc_id", text: str = "text", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(id, ids) of every row: the token ids of its text, without special tokens.

    NULL and empty texts give an empty list, never NULL; blank texts and names of special tokens inside a text are
    ordinary text.  Repeated ids stay repeated rows, other columns are ignored, an empty table gives an empty table.
    ``tokenizer`` is the path of a byte-level BPE file (default: byte_bpe_50k.json of public_tokenizers); its content,
    fixed in size, is sent to the executors once.  No shuffle.
    """
    spark = rows.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(tokenizer or tokenizer_path("byte_bpe_50k.json")))
    kind = rows.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(np.cumsum(sizes) // PART_CHARS, prepend=-1)).tolist() + [batch.num_rows]
            for at, end in zip(edges, edges[1:], strict=False):
                part = batch.slice(at, end - at)
                offsets, values = encoder(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                yield pa.record_batch([part.column(0), lists], names=[id, ids])

    schema = T.StructType([T.StructField(id, kind), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return spread(rows.select(id, F.col(text).alias("_text"))).mapInArrow(run, schema)
