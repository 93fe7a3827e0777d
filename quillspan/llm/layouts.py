"""The same record in several layouts: blanks, letter case, punctuation and field order apart.

Texts are streamed as code points through a lookup table that skips or folds each one, straight into polynomial
hashes; canonical strings are never built.  Rows whose hashes meet and whose texts differ are compared symbol by symbol with two
pointers that skip what doesn't count, many rows at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.forms import lookalikes, mapping
from quillspan.shared import spread, written
from quillspan.skew import salted_lookup

#: Moduli and bases of the four polynomial hashes (products stay below 2**63); together 124 bits.
MODULI = np.array([2147483647, 2147483629, 2147483587, 2147483579], dtype=np.int64)
BASES = np.array([1000003, 69069, 16777619, 28629151], dtype=np.int64)

HIDDEN, SKIP, KEEP = 0, 1, 2
#: Characters that count from which a pair of texts is compared on its own, and characters of it taken at a time.
LONG, CHUNK = 2_000, 65_536
#: Rows of a batch that are hashed or compared together.
BATCH_ROWS = 10_000

_SEPARATORS = ";|,\n"
_SIZE = 0x110000


@lru_cache(maxsize=1)
def letter_classes() -> dict[str, str]:
    """Letter → representative of the letters it equals by case or by shape, one step after another.

    Raises ValueError where that would make two letters of the Latin alphabet one.
    """
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for char, latin in lookalikes().items():
        for x in (char, latin):
            for y in (x.lower(), x.upper()):
                if len(y) == 1:
                    a, b = root(x), root(y)
                    parent[max(a, b, key=lambda c: (ord(c) > 127, ord(c)))] = min(a, b, key=lambda c: (ord(c) > 127, ord(c)))
        a, b = root(char), root(latin)
        parent[max(a, b, key=lambda c: (ord(c) > 127, ord(c)))] = min(a, b, key=lambda c: (ord(c) > 127, ord(c)))
    classes: dict[str, str] = {}
    for x in parent:
        classes[x] = root(x).lower()
    for x in "abcdefghijklmnopqrstuvwxyz":
        if classes.get(x, x) != x:
            raise ValueError(f"{x} would equal {classes[x]}")
    return classes


def folded(char: str) -> tuple[int, str]:
    """(HIDDEN, SKIP or KEEP, the symbols of a kept character).  A dot and a hyphen count by what stands beside."""
    form = mapping().get(char, char)
    if form == "":
        return HIDDEN, ""
    classes, out = letter_classes(), []
    for x in form:
        for y in unicodedata.normalize("NFD", x.casefold()):
            kind = unicodedata.category(y)
            if kind[0] in "LMN" or kind in ("Sc", "So") or kind == "Sm" and y not in "+<=>|~^−":
                out.append(classes.get(y, y))
    return (KEEP, "".join(out)) if out else (SKIP, "")


class FoldTable:
    """Lookup tables by code point, filled for the characters that occur."""

    def __init__(self) -> None:
        self.kind = np.full(_SIZE, 255, dtype=np.uint8)
        self.start = np.zeros(_SIZE, dtype=np.int32)
        self.length = np.zeros(_SIZE, dtype=np.int8)
        self.digit = np.zeros(_SIZE, dtype=bool)
        self.accent = np.zeros(_SIZE + 1, dtype=np.uint8)  # by symbol, its place among accents
        self.special = np.zeros(_SIZE, dtype=np.uint8)  # 1 dot, 2 minus, 3 equals sign, 4 separator of fields
        self.flat = np.zeros(0, dtype=np.int64)

    def fill(self, codes: np.ndarray) -> None:
        new = np.unique(codes[self.kind[codes] == 255])
        if not len(new):
            return
        flat = self.flat.tolist()
        for code in new.tolist():
            char = chr(code)
            kind, symbols = folded(char)
            form = mapping().get(char, char)
            special = 1 if form == "." else 2 if form in "-−" and form else 3 if form == "=" else 4 if form and form in _SEPARATORS else 0
            self.kind[code], self.special[code] = kind, special
            self.digit[code] = form.isdigit()
            for x in symbols:
                self.accent[ord(x) + 1] = unicodedata.combining(x)
            symbols = symbols or ("." if special == 1 else "-" if special == 2 else "")
            self.start[code], self.length[code] = len(flat), len(symbols)
            flat.extend(ord(x) + 1 for x in symbols)
        self.flat = np.array(flat, dtype=np.int64)


@lru_cache(maxsize=1)
def table() -> FoldTable:
    """The process's fold table."""
    return FoldTable()


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one behind the other, and the row of each."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes, np.repeat(np.arange(len(texts)), np.diff(begins[offsets - offsets[0]]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Kept:
    """What counts of a batch of texts: code points in order, cut into fields where a text has at least two."""

    rows: int
    codes: np.ndarray  # the characters that count
    segment: np.ndarray  # the segment of each
    segment_row: np.ndarray  # the text of each segment


def kept_characters(texts: pa.Array) -> Kept:
    """Stream texts through the skip table.

    A text with at least two ``name=value`` fields is cut at the last ``;``, ``|``, ``,`` or line end before each equals sign.
    """
    n, t = len(texts), table()
    codes, row = _code_points(texts)
    t.fill(codes)
    seen = t.kind[codes] != HIDDEN
    codes, row = codes[seen], row[seen]
    size = len(codes)
    if not size:
        return Kept(n, codes, np.zeros(0, np.int64), np.zeros(0, np.int64))
    special, digit, kind = t.special[codes], t.digit[codes], t.kind[codes]
    same_next = np.append(row[1:] == row[:-1], False)
    next_digit = np.append(digit[1:], False) & same_next
    last_digit = np.insert(digit[:-1], 0, False) & np.insert(same_next[:-1], 0, False)
    keep = (kind == KEEP) | ((special == 1) & last_digit & next_digit) | ((special == 2) & next_digit)
    begin = np.insert(~same_next[:-1], 0, True)
    equals = special == 3
    at = np.flatnonzero(equals & (np.bincount(row[equals], minlength=n)[row] >= 2))
    if len(at):
        edge = np.maximum.accumulate(np.where((special == 4) | begin, np.arange(size), 0))
        begin[edge[at]] = True
    segment = np.cumsum(begin) - 1
    return Kept(n, codes[keep], segment[keep], row[begin])


def _folded(kept: Kept) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the kept characters and the segment of each; accents of one letter in the standard's order."""
    t = table()
    lengths = t.length[kept.codes].astype(np.int64)
    source = np.repeat(np.arange(len(kept.codes)), lengths)
    within = np.arange(len(source)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols, owner = t.flat[t.start[kept.codes][source] + within], kept.segment[source]
    accent = t.accent[symbols]
    swapped = (accent[:-1] > accent[1:]) & (accent[1:] > 0) & (owner[:-1] == owner[1:])
    if swapped.any():
        base = np.cumsum((accent == 0) | np.insert(owner[1:] != owner[:-1], 0, True))
        some = np.flatnonzero(np.isin(base, base[:-1][swapped]))
        symbols[some] = symbols[some[np.lexsort((accent[some], base[some]))]]
    return symbols, owner


def _segment_hashes(kept: Kept) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Two 64-bit hashes of each segment, and whether it holds anything."""
    symbols, owner = _folded(kept)
    segments = len(kept.segment_row)
    counts = np.bincount(owner, minlength=segments)
    starts = np.cumsum(counts) - counts
    place = np.arange(len(symbols)) - np.repeat(starts, counts)
    parts = []
    longest = int(counts.max()) if len(counts) else 0
    for modulus, base in zip(MODULI.tolist(), BASES.tolist(), strict=True):
        terms = symbols * _powers(base, modulus, longest)[place] % modulus
        total = np.concatenate([[0], np.cumsum(terms)])
        parts.append((total[starts + counts] - total[starts]) % modulus)
    filled = counts > 0
    out = []
    for a, b in ((0, 1), (2, 3)):
        value = _mix((parts[a].astype(np.uint64) << np.uint64(32)) + parts[b].astype(np.uint64) + (counts.astype(np.uint64) << np.uint64(24)))
        value[~filled] = 0
        out.append(value)
    return (out[0], out[1]), filled


def layout_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes for each text, and whether it holds anything that counts.

    Texts equal after unification and apart from blanks, case, punctuation and the order of name=value fields have
    the same hashes: those of the fields are added up, so that their order doesn't matter.
    """
    kept = kept_characters(texts)
    values, filled = _segment_hashes(kept)
    out = []
    for value in values:
        added = np.zeros(kept.rows, np.uint64)
        np.add.at(added, kept.segment_row, value)
        out.append(added.view(np.int64))
    some = np.zeros(kept.rows, bool)
    some[kept.segment_row[filled]] = True
    return out[0], out[1], some


def _visited(kept: Kept) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters that count in the order they are compared in, where each text's begin, texts with fields): fields by their hash."""
    row = kept.segment_row[kept.segment]
    fields = np.bincount(kept.segment_row, minlength=kept.rows) > 1
    codes = kept.codes
    if fields.any():
        value = _segment_hashes(kept)[0][0]
        order = np.lexsort((np.arange(len(row)), kept.segment, np.where(fields[row], value[kept.segment], 0), row))
        codes = codes[order]
    counts = np.bincount(row, minlength=kept.rows)
    return codes, np.concatenate([[0], np.cumsum(counts)]), fields


def same_layout(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the texts of each pair are one record: two pointers a pair, all pairs a step at a time.

    A pointer stands on a character that counts and on one of the symbols it folds to.  Pairs that part at accents in another
    order or in fields whose hashes meet by accident are looked at once more, one by one.
    """
    t = table()
    one, edge_one, fields_one = _visited(kept_characters(a))
    two, edge_two, fields_two = _visited(kept_characters(b))
    same, unsure = np.zeros(len(a), bool), np.zeros(len(a), bool)
    sizes = np.maximum(np.diff(edge_one), np.diff(edge_two))
    for k in np.flatnonzero(sizes > LONG).tolist():
        same[k] = _same_stream(one[edge_one[k] : edge_one[k + 1]], two[edge_two[k] : edge_two[k + 1]])
        unsure[k] = not same[k]
    live = np.flatnonzero(sizes <= LONG)
    i, j, x, y = edge_one[live], edge_two[live], np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    while len(live):
        over_one, over_two = i == edge_one[live + 1], j == edge_two[live + 1]
        over = over_one | over_two
        if over.any():
            same[live[over_one & over_two]] = True
            unsure[live[over_one != over_two]] = True
            live, i, j, x, y = live[~over], i[~over], j[~over], x[~over], y[~over]
        p, q = one[i], two[j]
        met = t.flat[t.start[p] + x] == t.flat[t.start[q] + y]
        if not met.all():
            unsure[live[~met]] = True
            live, i, j, x, y, p, q = live[met], i[met], j[met], x[met], y[met], p[met], q[met]
        x, y = x + 1, y + 1
        next_one, next_two = x == t.length[p], y == t.length[q]
        i, j, x, y = i + next_one, j + next_two, np.where(next_one, 0, x), np.where(next_two, 0, y)
    for k in np.flatnonzero(unsure).tolist():
        text, other = a[k].as_py(), b[k].as_py()
        same[k] = (fields_one[k] and fields_two[k] or _has_accents(text) and _has_accents(other)) and same_record(text, other)
    return same


def _has_accents(text: str) -> bool:
    return any(unicodedata.combining(y) for x in text if ord(x) > 127 for y in folded_char(x)[1])


def _same_stream(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two streams of characters fold to the same symbols, CHUNK characters at a time."""
    t = table()

    def chunks(codes: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(codes), CHUNK):
            part = codes[at : at + CHUNK]
            lengths = t.length[part].astype(np.int64)
            yield t.flat[np.repeat(t.start[part], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]

    left, right, p, q = chunks(one), chunks(two), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        p = p if len(p) else next(left, p)
        q = q if len(q) else next(right, q)
        n = min(len(p), len(q))
        if not n:
            return len(p) == len(q)
        if (p[:n] != q[:n]).any():
            return False
        p, q = p[n:], q[n:]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, modulus: int, length: int) -> np.ndarray:
    known = _POWERS.get(modulus, np.ones(1, np.int64))
    while len(known) < length:  # doubling: the second half is the first times base**half
        step = pow(base, len(known), modulus)
        known = np.concatenate([known, known * step % modulus])
    _POWERS[modulus] = known
    return known


def _symbols(text: str, start: int, end: int) -> Iterator[str]:
    """The symbols that count in text[start:end], one after the other, accents of one letter in the standard's order."""
    held: list[str] = []
    for x in _unordered(text, start, end):
        if unicodedata.combining(x):
            held.append(x)
            continue
        yield from sorted(held, key=unicodedata.combining)
        held = []
        yield x
    yield from sorted(held, key=unicodedata.combining)


def _unordered(text: str, start: int, end: int) -> Iterator[str]:
    i = start
    previous_digit = False
    while i < end:
        kind, symbols = folded_char(text[i])
        i += 1
        if kind == HIDDEN:
            continue
        form = mapping().get(text[i - 1], text[i - 1])
        if kind == KEEP:
            yield from symbols
        elif form in (".", "-", "−"):
            j = i
            while j < end and folded_char(text[j])[0] == HIDDEN:
                j += 1
            before_digit = j < end and mapping().get(text[j], text[j]).isdigit()
            if before_digit and (form != "." or previous_digit):
                yield "." if form == "." else "-"
        previous_digit = form.isdigit()


folded_char = lru_cache(maxsize=100_000)(folded)


def _fields(text: str) -> list[tuple[int, int]]:
    """The segments of a text: its fields if there are at least two, else the whole."""
    forms = [mapping().get(c, c) for c in text]
    equals = [i for i, c in enumerate(forms) if c == "="]
    if len(equals) < 2:
        return [(0, len(text))]
    begins = {0}
    for at in equals:
        i = at
        while i > 0 and forms[i] not in tuple(_SEPARATORS):
            i -= 1
        begins.add(i)
    begins = sorted(begins)
    return list(zip(begins, [*begins[1:], len(text)], strict=True))


def _equal(a: str, x: tuple[int, int], b: str, y: tuple[int, int]) -> bool:
    one, two = _symbols(a, *x), _symbols(b, *y)
    while True:
        p, q = next(one, None), next(two, None)
        if p != q:
            return False
        if p is None:
            return True


def same_record(a: str, b: str) -> bool:
    """Whether two texts are one record in different layouts: two pointers, skipping what doesn't count."""
    if a == b:
        return True
    one, two = _fields(a), _fields(b)
    if len(one) == 1 and len(two) == 1:
        return _equal(a, one[0], b, two[0])
    one = [x for x in one if next(_symbols(a, *x), None) is not None]
    left = [y for y in two if next(_symbols(b, *y), None) is not None]
    if len(one) != len(left):
        return False
    for x in one:
        match = next((y for y in left if _equal(a, x, b, y)), None)
        if match is None:
            return False
        left.remove(match)
    return True


_HASHED = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(at, BATCH_ROWS)
            h1, h2, some = layout_hashes(batch.column("text"))
            out = pa.record_batch([batch.column("id").cast(pa.int64()), batch.column("text").cast(pa.string()), pa.array(h1), pa.array(h2)], names=["id", "text", "h1", "h2"])
            yield out.filter(pa.array(some))


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each row is one record with the kept one, whose text is NULL where it is the same; texts of rows that aren't stay."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(at, BATCH_ROWS)
            text, kept = batch.column("text"), batch.column("keep_text")
            same = np.ones(batch.num_rows, bool)
            open_ = np.flatnonzero(pc.is_valid(kept).to_numpy(zero_copy_only=False))
            if len(open_):
                same[open_] = same_layout(text.take(pa.array(open_)), kept.take(pa.array(open_)))
            left = pc.if_else(pa.array(same), pa.scalar(None, pa.string()), text.cast(pa.string()))
            yield pa.record_batch([batch.column("h1"), batch.column("h2"), batch.column("id"), left, batch.column("keep_id"), batch.column("n"), pa.array(same)], names=["h1", "h2", "id", "text", "keep_id", "n", "same"])


_CHECKED = "h1 long, h2 long, id long, text string, keep_id long, n long, same boolean"


def collapse_layouts(rows: DataFrame, *, id: str = "id", text: str = "text") -> DataFrame:
    """(id, keep_id, copies) of every row whose text holds anything that counts.

    ``keep_id`` is the smallest id of the record, ``copies`` how many rows the record has.  NULL, empty, blank and
    punctuation-only texts are no record and have no row.  A repeated id counts as a row of its own.  Other columns are
    ignored.  Each row is compared with the kept row of its hash; rows that differ from it (hashes meeting by
    accident) go into a further round, in which the first of them is kept, until none differ.  Groups are counted before rows are
    shuffled, and hot ones salted.
    """
    read = rows.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text <> ''")
    left = written(spread(read).mapInArrow(_hash_batches, _HASHED).withColumn("key", F.struct("h1", "h2")).drop("h1", "h2"), "layouts")
    out = None
    while True:
        groups = left.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "text")).alias("first"))
        kept = groups.select("key", "n", F.col("first.id").alias("keep_id"), F.col("first.text").alias("keep_text"))
        single = kept.where("n = 1").select(F.col("keep_id").alias("id"), "keep_id", F.lit(1).cast("long").alias("copies"))
        met = salted_lookup(left, kept.where("n > 1").withColumn("of", F.col("n")), "key")
        differs = F.col("text") != F.col("keep_text")
        sent = met.select("key.h1", "key.h2", "id", F.when(differs, F.col("text")).alias("text"), F.when(differs, F.col("keep_text")).alias("keep_text"), "keep_id", F.col("of").alias("n"))
        checked = written(sent.mapInArrow(_check_batches, _CHECKED), "layouts-met")
        same = checked.where("same")
        apart = checked.where("not same").select(F.struct("h1", "h2").alias("key"), "id", "text")
        if again := bool(apart.limit(1).count()):
            # as good as never any: hashes of 124 bits met by accident
            fewer = apart.groupBy(F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).agg(F.count("*").alias("apart"))
            same = same.join(fewer, ["h1", "h2"], "left").withColumn("n", F.col("n") - F.coalesce("apart", F.lit(0)))
        found = single.unionByName(same.select("id", "keep_id", F.col("n").alias("copies")))
        out = found if out is None else out.unionByName(found)
        if not again:
            return out
        left = written(apart, "layouts")
