"""Passages of held-out test items inside a training corpus.

Windows of the length of the shortest passage that counts are taken at every word of items and documents and embedded by
the CGK random walk, under which few edits become few differing places.  Hashes of places sampled from the embeddings
(bit-sampling LSH, repeated until the wanted recall is met) give candidates, and a banded alignment of the words
decides each of them exactly.  Windows and candidates that share too few four-word sequences with the items to be part of
a passage are left out before.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspan.blocks import Sent, in_passes, slices
from quillspan.shared import spread, written

if TYPE_CHECKING:
    import pandas as pd

#: Words in a row of an item that count as a leak, words of slack that altered edges may cost, and share of edits.
PASSAGE_WORDS, EDGE_SLACK, EDIT_SHARE = 25, 2, 0.16
#: Random walks, samples of each, places in a sample, and steps of a walk that places are drawn from.
WALKS, SAMPLES, PLACES, STEPS = 6, 3, 8, 40
#: Price of an edit in the alignment against 1 for a matching word, and words that the two texts may drift apart.
EDIT_PRICE, BAND = 2, 7
#: Score that any passage has at least: its words, less the matches lost and the price of as many edits as may be in the shortest one.
LEAST_SCORE = PASSAGE_WORDS - (1 + EDIT_PRICE) * int(EDIT_SHARE * PASSAGE_WORDS + 1e-9)
#: Words of a sequence; sequences that a window shares with the items at least, and that a passage shares with its item at least.
#: Of 25 words with 4 altered ones, 22 - 4 * 4 sequences stay whole; all other passages that count keep more.  Windows that reach
#: beyond a passage have fewer of it, so that less is asked of them.
GRAM, WINDOW_GRAMS = 4, 5
PASSAGE_GRAMS = PASSAGE_WORDS - GRAM + 1 - GRAM * int(EDIT_SHARE * PASSAGE_WORDS + 1e-9)
#: Words of items that are indexed together (about 500 bytes each), blocks of them that one pass over the documents looks through.
BLOCK_WORDS, PASS_BLOCKS = 100_000, 16
#: Items are cut into parts of so many words, with an overlap that holds the shortest part of a passage that decides.
PART_WORDS, PART_OVERLAP = 20_000, 4 * PASSAGE_WORDS
#: Share of the items, and number of them, that must have a sentence for it to be an instruction.
COMMON_SHARE, COMMON_LEAST = 0.01, 2
#: Characters of documents, and documents, that are looked through together; occurrences of sequences counted at a time.
BATCH_CHARS, BATCH_TEXTS, BATCH_GRAMS = 2_000_000, 2_000, 4_000_000
#: Windows that walk together.
BATCH_WINDOWS = 16_384
#: Bits of the tables that tell most hashes that don't occur.
BITS = 20

_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_MARKUP = re.compile(r"<[^<>\n]{0,200}>|&(?:nbsp|amp|quot|lt|gt|#\d+);|[*_`~#|]+")
_PAGE = re.compile(r"(?m)^[ \t\-–—\[(]{0,40}(?:page|seite|página|p\.)[ \t]*\d+(?:[ \t]*(?:of|/|von|de|sur)[ \t]*\d+)?[ \t\r\-–—\])]{0,40}$|\[\s{0,9}(?:page|p\.)\s{0,9}\d+\s{0,9}\]|^[ \t]{0,40}[-–—][ \t]*\d+[ \t]*[-–—][ \t\r]{0,40}$|\f")
_PAGE_SIGNS, _MARKUP_SIGNS, _HYPHENS = ("page", "seite", "página", "p.", "\f", "\n-", "\n ", "\n\t", "\n–", "\n—"), "<&*_`~#|", "-‐‑"
_BROKEN = re.compile(r"(?<=\w)[-‐‑]\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    """Words of a text apart from case, punctuation, blanks, hyphens, mark-up, page marks and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    # most texts have none of the characters that a pattern needs
    if text[:1] in "-–— \t" or any(x in text for x in _PAGE_SIGNS):
        text = _PAGE.sub(" ", text)
    if any(x in text for x in _MARKUP_SIGNS):
        text = _MARKUP.sub(" ", text)
    if any(x in text for x in _HYPHENS):
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.replace("'", "").replace("’", ""))


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of each sentence or line of an item."""
    return [words_of(x) for x in re.split(r"(?<=[.!?:])\s+|\n+", text or "")]


def own_pieces(sentences: list[list[str]], common: list[bool]) -> list[list[str]]:
    """The parts of an item that are its own: its sentences, cut at those that recur from item to item; long ones in overlapping parts."""
    pieces: list[list[str]] = [[]]
    for words, recurs in zip(sentences, common, strict=True):
        if recurs:
            pieces.append([])
        else:
            pieces[-1].extend(words)
    step = PART_WORDS - PART_OVERLAP
    return [p[at : at + PART_WORDS] for p in pieces if len(p) >= PASSAGE_WORDS for at in range(0, max(1, len(p) - PART_OVERLAP), step)]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(walk: int, sample: int) -> np.ndarray:
    rng = np.random.default_rng(1000 * walk + sample)
    return np.sort(rng.choice(STEPS, PLACES, replace=False))


def window_hashes(words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(table, hash of each window) for every walk and sample; ``words`` must reach a window's length beyond each start.

    A walk outputs the word it stands on and moves on by one word or stays, as a random bit of (step, word) says: two texts
    that differ in few words walk together again soon after each of them.
    """
    coded = _mixed(words, 0)
    for walk in range(WALKS):
        bits = _mixed(words, walk + 1)
        wanted = [_places(walk, s) for s in range(SAMPLES)]
        hashes = [np.zeros(len(starts), np.uint64) for _ in range(SAMPLES)]
        for part in range(0, len(starts), BATCH_WINDOWS):
            at, held = starts[part : part + BATCH_WINDOWS].astype(np.int64), [h[part : part + BATCH_WINDOWS] for h in hashes]
            for step in range(STEPS):
                used = [s for s, places in enumerate(wanted) if step in places]
                here = coded[at] if used else None
                for s in used:
                    held[s] *= np.uint64(0x9E3779B97F4A7C15)
                    held[s] += here
                move = bits[at]
                move >>= np.uint64(step)
                move &= np.uint64(1)
                at += move.view(np.int64)
        for s in range(SAMPLES):
            yield walk * SAMPLES + s, hashes[s] ^ (hashes[s] >> np.uint64(29))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on; 0 where one of them is no word of the items, or the end is near."""
    n = len(words) - GRAM + 1
    out = np.zeros(len(words), np.uint64)
    if n > 0:
        code, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(GRAM):
            part = words[k : k + n]
            code = code * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
            known &= part > 0
        code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[:n] = np.where(known, code ^ (code >> np.uint64(32)) | np.uint64(1), np.uint64(0))
    return out


def _marks(hashes: np.ndarray) -> np.ndarray:
    """Which leading bits occur among hashes."""
    marks = np.zeros(1 << BITS, bool)
    marks[hashes >> np.uint64(64 - BITS)] = True
    return marks


def _ends(keys: np.ndarray) -> np.ndarray:
    """Of each sorted key, where the next different one stands."""
    edges = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    return np.repeat(edges, np.diff(edges, prepend=0)) if len(keys) else np.zeros(0, np.int64)


def _range(keys: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of each wanted key among sorted ones."""
    if not len(keys):
        return np.zeros((2, len(wanted)), np.int64)
    low = np.searchsorted(keys, wanted)
    spot = np.minimum(low, len(keys) - 1)
    return low, np.where(keys[spot] == wanted, ends[spot], low)


@dataclass
class Index:
    """Windows of a block of items, by hash, and where each sequence of GRAM words stands."""

    vocabulary: dict[str, int]
    words: np.ndarray  # of all pieces, one behind the other, with a gap of PASSAGE_WORDS zeros behind each
    item: np.ndarray  # number of the item of each word
    ids: list  # the id of each item
    keys: list[np.ndarray]  # of each table, sorted
    starts: list[np.ndarray]  # where the window of each key starts
    grams: np.ndarray  # hashes, sorted
    gram_at: np.ndarray  # and their places
    marks: list[np.ndarray] = field(default_factory=list)  # of the keys of each table; of the grams
    gram_marks: np.ndarray | None = None
    ends: list[np.ndarray] = field(default_factory=list)  # of each key of each table, and of each gram, where the next one begins
    gram_ends: np.ndarray | None = None

    def mark(self) -> Index:
        """The index with its tables of marks and ends."""
        if self.gram_marks is None:
            self.marks, self.gram_marks = [_marks(k) for k in self.keys], _marks(self.grams)
            self.ends, self.gram_ends = [_ends(k) for k in self.keys], _ends(self.grams)
        return self


def build_index(pieces: list[tuple[object, list[str]]]) -> Index:
    """Index every window of (item, words)."""
    vocabulary: dict[str, int] = {}
    number: dict = {}
    words, item, starts = [], [], []
    for i, piece in pieces:
        starts.extend(range(len(words), len(words) + len(piece) - PASSAGE_WORDS // 2))
        words.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in piece)
        words.extend([0] * PASSAGE_WORDS * 2)
        item.extend([number.setdefault(i, len(number))] * (len(piece) + PASSAGE_WORDS * 2))
    w, s = np.array(words, dtype=np.int32), np.array(starts, dtype=np.int64)
    keys, places = [], []
    if len(s):
        for _, hashes in window_hashes(w, s):
            order = np.argsort(hashes, kind="stable")
            keys.append(hashes[order])
            places.append(s[order])
    grams = gram_hashes(w)
    at = np.flatnonzero(grams)
    at = at[np.argsort(grams[at], kind="stable")]
    return Index(vocabulary, w, np.array(item, dtype=np.int64), list(number), keys, places, grams[at], at)


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) for every position of the ranges low..high."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def align(doc: np.ndarray, doc_at: np.ndarray, items: np.ndarray, item_at: np.ndarray, reach: int = PASSAGE_WORDS + 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded local alignments around pairs of places, all at once: (item words spanned, edits, score) of the best of each.

    ``doc`` and ``items`` are word codes; 0 in items and negative codes in doc match nothing.
    """
    n, width = len(doc_at), 2 * BAND + 1
    column = np.arange(width)
    # score, item words spanned and edits of a cell in one number, so that a maximum carries all three along
    unit, word = 1 << 20, 1 << 10
    match, change, more = unit + word, word + 1 - EDIT_PRICE * unit, 1 - EDIT_PRICE * unit
    cells, best = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
    for step in range(-reach, reach + 1):
        i = item_at + step
        letter = np.where((i >= 0) & (i < len(items)), items[np.clip(i, 0, len(items) - 1)], 0)
        d = (doc_at + step - BAND)[:, None] + column
        other = doc[np.clip(d, 0, len(doc) - 1)]
        # along the band a step of the item with one of the document keeps the column
        new = cells + np.where((other == letter[:, None]) & (letter > 0)[:, None], match, change)
        # an item word left out: from the column to the right
        np.maximum(new[:, :-1], cells[:, 1:] + change, out=new[:, :-1])
        # document words more: from the columns to the left, of the same item word
        new = np.maximum.accumulate(new - more * column, axis=1) + more * column
        new[new < unit] = 0
        cells = new
        np.maximum(best, cells.max(1), out=best)
    return (best >> 10) & 1023, best & 1023, best >> 20


def passes(span: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether an alignment is a passage that counts."""
    return (span >= PASSAGE_WORDS - EDGE_SLACK) & (edits <= EDIT_SHARE * span)


def holds_passage(doc: np.ndarray, doc_at: np.ndarray, items: np.ndarray, item_at: np.ndarray, reach: int = PASSAGE_WORDS + 8) -> np.ndarray:
    """Whether any alignment around each pair of places, whatever its score, is a passage that counts.

    It begins and ends with a matching word.  Up to EDGE_SLACK words that it lacks of a passage are altered edges and count as edits.
    A longer passage has a part of fewer than twice PASSAGE_WORDS words with no larger share of edits, so no more edits are followed.
    """
    n, width = len(doc_at), 2 * BAND + 1
    most = int(EDIT_SHARE * (2 * PASSAGE_WORDS - 1) + 1e-9)
    column, edits = np.arange(width), np.arange(most + 1)
    # by edits: item words from which an alignment counts
    free = int(EDIT_SHARE * PASSAGE_WORDS + 1e-9)
    enough = np.where(edits <= free, np.maximum(PASSAGE_WORDS - EDGE_SLACK, PASSAGE_WORDS + edits - free), np.ceil(edits / EDIT_SHARE - 1e-9)).astype(np.int16)
    none = np.int16(-1000)
    # most item words of an alignment that ends in a cell, by its edits
    cells, out = np.full((most + 1, n, width), none), np.zeros(n, bool)
    for step in range(-reach, reach + 1):
        i = item_at + step
        letter = np.where((i >= 0) & (i < len(items)), items[np.clip(i, 0, len(items) - 1)], 0)
        d = (doc_at + step - BAND)[:, None] + column
        same = (doc[np.clip(d, 0, len(doc) - 1)] == letter[:, None]) & (letter > 0)[:, None] & (d >= 0) & (d < len(doc))
        on = cells + np.int16(1)
        np.maximum(on[0], 1, out=on[0])
        new = np.where(same, on, none)
        out |= (new >= enough[:, None, None]).any((0, 2))
        for e in range(1, most + 1):
            # a word exchanged, an item word left out, a document word more
            np.maximum(new[e], cells[e - 1] + np.int16(1), out=new[e])
            np.maximum(new[e][:, :-1], cells[e - 1][:, 1:] + np.int16(1), out=new[e][:, :-1])
            np.maximum(new[e][:, 1:], new[e - 1][:, :-1], out=new[e][:, 1:])
        new[:, letter == 0] = none
        new[new < 0] = none
        cells = new
    return out


def candidates(words: np.ndarray, starts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in words, place in the index) whose windows meet in a table, one for each diagonal of an item."""
    found = [np.zeros((2, 0), np.int64)]
    for table, hashes in window_hashes(words, starts):
        near = np.flatnonzero(index.marks[table][hashes >> np.uint64(64 - BITS)])
        low, high = _range(index.keys[table], index.ends[table], hashes[near])
        hit = high > low
        which, at = _runs(low[hit], high[hit])
        found.append(np.stack([starts[near[hit]][which], index.starts[table][at]]))
    doc, item = np.concatenate(found, axis=1)
    # of windows on the same few diagonals within a passage's length, one is enough: the alignment reaches around it
    diagonal, stretch = (doc - item + len(index.words) + 4) // 4, doc // (PASSAGE_WORDS // 2)
    diagonals = (len(words) + len(index.words)) // 4 + 2
    _, first = np.unique((stretch * diagonals + diagonal) * len(index.ids) + index.item[item], return_index=True)
    return doc[first], item[first]


def _bands(number: np.ndarray, item: np.ndarray, diagonal: np.ndarray, index: Index, size: int) -> np.ndarray:
    """One number for a text, an item and a band of diagonals twice as wide as an alignment reaches to a side."""
    width = 2 * (BAND + 1)
    return (number * len(index.ids) + item) * ((len(index.words) + size) // width + 3) + (diagonal + len(index.words) + width) // width


def likely(words: np.ndarray, number: np.ndarray, grams: np.ndarray, doc: np.ndarray, item: np.ndarray, index: Index) -> np.ndarray:
    """Which pairs of places have PASSAGE_GRAMS sequences in common within the band that an alignment looks through."""
    wanted = np.unique(_bands(number[doc], index.item[item], doc - item, index, len(words)))
    at = np.flatnonzero(grams)
    at = at[np.isin(number[at], np.unique(number[doc]))]
    low, high = _range(index.grams, index.gram_ends, grams[at])
    met = np.zeros(len(wanted), np.int64)
    block = np.cumsum(high - low) // BATCH_GRAMS
    for b in np.unique(block):
        part = slice(np.searchsorted(block, b, "left"), np.searchsorted(block, b, "right"))
        which, place = _runs(low[part], high[part])
        place, here = index.gram_at[place], at[part][which]
        for side in (-BAND - 1, BAND + 1):
            band = _bands(number[here], index.item[place], here - place + side, index, len(words))
            spot = np.minimum(np.searchsorted(wanted, band), len(wanted) - 1)
            met += np.bincount(spot[wanted[spot] == band], minlength=len(wanted))
    return met[np.searchsorted(wanted, _bands(number[doc], index.item[item], doc - item, index, len(words)))] >= PASSAGE_GRAMS


def leaks_of(split: list[list[str]], index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, number of the item) of every text, given by its words, that contains a passage of an item."""
    nothing = np.zeros(0, np.int64)
    if not index.keys:
        return nothing, nothing
    index.mark()
    get, gap = index.vocabulary.get, [-1] * PASSAGE_WORDS * 2
    words: list[int] = []
    sizes = []
    for text in split:
        words.extend([get(w, -1) for w in text])
        words.extend(gap)
        sizes.append(len(text) + len(gap))
    w = np.array(words, dtype=np.int32)
    number = np.repeat(np.arange(len(split)), sizes)
    # windows that share too few sequences with any item can't be part of a passage
    grams = gram_hashes(w)
    some = np.flatnonzero(grams)
    grams[some[~index.gram_marks[grams[some] >> np.uint64(64 - BITS)]]] = 0
    shared = np.concatenate([[0], np.cumsum(grams > 0)])
    last = np.minimum(np.arange(len(w)) + PASSAGE_WORDS - GRAM + 1, len(w))
    s = np.flatnonzero((shared[last] - shared[:-1] >= WINDOW_GRAMS) & (np.arange(len(w)) < len(w) - 2 * PASSAGE_WORDS))
    if not len(s):
        return nothing, nothing
    doc, item = candidates(w, s, index)
    if not len(doc):
        return nothing, nothing
    keep = likely(w, number, grams, doc, item, index)
    doc, item = doc[keep], item[keep]
    pair = number[doc] * len(index.ids) + index.item[item]
    held, first = np.zeros(0, np.int64), np.unique(pair, return_index=True)[1]
    # one candidate of each pair, then all others of the pairs that it doesn't decide
    for chosen in (first, np.delete(np.arange(len(pair)), first)):
        chosen = chosen[~np.isin(pair[chosen], held)]
        for at in range(0, len(chosen), 20_000):
            some = chosen[at : at + 20_000]
            held = np.union1d(held, pair[some[verified(w, doc[some], index.words, item[some])]])
    return held // len(index.ids), held % len(index.ids)


def verified(words: np.ndarray, doc: np.ndarray, items: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which pairs of places lie in a passage that counts."""
    span, edits, score = align(words, doc, items, item)
    sure = passes(span, edits)
    # the best score may stop short of a passage with edits near its edges; no passage scores less than this
    open_ = np.flatnonzero(~sure & (score >= LEAST_SCORE))
    sure[open_] = holds_passage(words, doc[open_], items, item[open_])
    return sure


def index_blocks(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(block, words, data): pickled indexes of the items' own clauses, BLOCK_WORDS words or a little more each.

    Items are split, counted and indexed by the executors; sentences that more than COMMON_LEAST items and COMMON_SHARE of
    them have are instructions.
    """
    numbered = written(items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct().withColumn("n", F.xxhash64("item", "text")), "leak-items")
    kind = numbered.schema["item"].dataType

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in batches:
            rows = [(n, i, at, " ".join(s)) for n, i, text in zip(pdf["n"], pdf["item"], pdf["text"], strict=True) for at, s in enumerate(sentences_of(text))]
            yield pd.DataFrame(rows, columns=["n", "item", "at", "words"])

    sentences = T.StructType([T.StructField("n", T.LongType()), T.StructField("item", kind), T.StructField("at", T.LongType()), T.StructField("words", T.StringType())])
    each = written(numbered.mapInPandas(split, sentences), "leak-sentences")
    least = max(COMMON_LEAST, COMMON_SHARE * numbered.count())
    often = each.select("n", "words").distinct().groupBy("words").agg(F.count("*").alias("items")).where(F.col("items") > least).select("words", F.lit(True).alias("often"))
    whole = each.join(often, "words", "left").groupBy("n").agg(F.first("item").alias("item"), F.array_sort(F.collect_list(F.struct("at", "words", F.coalesce("often", F.lit(False)).alias("often")))).alias("s"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in batches:
            rows = [(i, " ".join(p), len(p)) for i, s in zip(pdf["item"], pdf["s"], strict=True) for p in own_pieces([x["words"].split() for x in s], [x["often"] for x in s])]
            yield pd.DataFrame(rows, columns=["item", "piece", "size"])

    parts = written(whole.mapInPandas(cut, T.StructType([T.StructField("item", kind), T.StructField("piece", T.StringType()), T.StructField("size", T.LongType())])), "leak-pieces")
    blocks = max(1, -(-int(parts.agg(F.sum("size")).first()[0] or 0) // BLOCK_WORDS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        pdf = pdf.sort_values(["item", "piece"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "words": [int(pdf["size"].sum())], "data": [pickle.dumps(build_index([(i, p.split()) for i, p in zip(pdf["item"].tolist(), pdf["piece"], strict=True)]))]})

    return written(parts.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks))).groupBy("block").applyInPandas(build, "block long, words long, data binary"), "leak-index")


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that contains at least PASSAGE_WORDS words in a row of an item's own clause.

    About one altered word in ten is allowed (EDIT_SHARE); case, punctuation, blanks, hyphens, line ends, quotation
    marks, mark-up, page marks and invisible characters don't count.  Sentences that recur from item to item are instructions
    and don't count either.  NULL and empty texts have no leaks, items with fewer words than a passage none; repeated ids give one
    row; other columns are ignored; without items or documents there are no rows.  The items are indexed in blocks of BLOCK_WORDS words; PASS_BLOCKS of them at most are sent
    out at a time (under a gigabyte), a task reads one of them at a time, and each document is split into words once for all of
    these; more blocks take further passes, whose rows are written before the next one begins.
    """
    spark = docs.sparkSession
    blocks = index_blocks(items, item_id=item_id, text=text)
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])
    read = spread(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text <> ''"))
    kind = to_arrow_type(items.schema[item_id].dataType)

    def search(sent: Sent) -> DataFrame:
        # Arrow batches throughout: the tasks of this pass need no pandas, whose import would be a good part of their time
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", BATCH_CHARS, BATCH_TEXTS):
                    split = [words_of(x) for x in part.column("text").to_pylist()]
                    for index in sent:
                        number, item = leaks_of(split, index)
                        yield pa.record_batch([part.column("id").take(pa.array(number)), pa.array([index.ids[i] for i in item], kind)], names=[doc_id, item_id])

        return read.mapInArrow(run, schema)

    out = in_passes(blocks, PASS_BLOCKS, pickle.loads, search, "leaks")
    return spark.createDataFrame([], schema) if out is None else out.distinct()
