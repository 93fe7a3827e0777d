"""Cosine similarity of texts by shared grams, near duplicates, a greedy guard, and nearest vectors."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.blocks import Sent, in_passes
from quillspan.functions.text import TERM, grams, terms
from quillspan.operators.quantiles import exact_quantiles
from quillspan.shared import written

#: Cosine from which texts are near duplicates.
NEAR = 0.72
#: Texts of a block, products of entries up to which a gram is multiplied entry by entry, and dense columns multiplied at a time.
BLOCK, FEW_PRODUCTS, COLUMNS = 1024, 256, 2048
#: Counts of a pair of grams up to which they are multiplied entry by entry in packed blocks, and pairs of blocks of a task.
FEW_ENTRIES, TASK_CELLS = 2048, 16
#: Blocks of one side that a task holds at most, packed.
PART_BLOCKS = 256
#: Texts of a group that the guard decides in a round.
FRONT = 2048
#: Texts of a group, about so many by id, that are held against all others before all pairs are.
FIRST = 64
#: Query vectors of a block, and blocks that are sent out in one pass over the rows.
BLOCK_QUERIES, PASS_BLOCKS = 20_000, 16


def matched(left: DataFrame, right: DataFrame, by: list[str], on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on the group columns ``by``, where NULL is a group like any other, and on ``on``."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in [*by, *on]})
    rule = F.lit(True)
    for c in by:
        rule = rule & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for c in on:
        rule = rule & (F.col(c) == F.col(f"_{c}"))
    return left.join(other, rule, how).drop(*[f"_{c}" for c in [*by, *on]])


def vectors(docs: DataFrame, by: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, id, grams, weights): the counts of the one- and two-word grams of each text, to length 1.

    Grams are 64-bit hashes in ascending order.  Texts without a gram, and NULL ones, have no vector.  No shuffle.
    """
    tokens = docs.where(F.col(text).isNotNull()).select(*by, F.col(id).alias("id"), terms(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    hashed = tokens.select(*by, "id", F.sort_array(F.transform(grams(F.col("_t")), lambda g: F.xxhash64(g))).alias("grams"))
    schema = T.StructType([*hashed.schema.fields, T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(by) + 1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            fresh = np.ones(len(values), bool)
            fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(fresh)
            n = np.diff(np.append(at, len(values))).astype(float)
            length = np.sqrt(np.bincount(row[at], n * n, batch.num_rows))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=batch.num_rows))]), pa.int32())
            weights = pa.ListArray.from_arrays(offsets, pa.array(n / length[row[at]]))
            yield pa.record_batch([*batch.columns[: len(by) + 1], pa.ListArray.from_arrays(offsets, pa.array(values[at])), weights], names=schema.names)

    return hashed.mapInArrow(count, schema)


def cosines(left: tuple[list, list], right: tuple[list, list]) -> np.ndarray:
    """The dot products of all vectors of two blocks, each given as (grams, weights).

    Grams that few of a block have are multiplied entry by entry, the others as dense columns.
    """
    rows = [np.repeat(np.arange(len(g)), [len(x) for x in g]) for g, _ in (left, right)]
    flat = [np.concatenate([*g, np.zeros(0, np.int64)]) for g, _ in (left, right)]
    weight = [np.concatenate([*w, np.zeros(0)]) for _, w in (left, right)]
    shared = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(left[0]), len(right[0])))
    if not len(shared):
        return out
    column = []
    for k in range(2):
        spot = np.minimum(np.searchsorted(shared, flat[k]), len(shared) - 1)
        keep = shared[spot] == flat[k]
        order = np.argsort(spot[keep], kind="stable")
        column.append(spot[keep][order])
        rows[k], weight[k] = rows[k][keep][order], weight[k][keep][order]
    counts = [np.bincount(c, minlength=len(shared)) for c in column]
    few = counts[0] * counts[1] <= FEW_PRODUCTS
    begin = np.cumsum(counts[1]) - counts[1]
    one = np.flatnonzero(few[column[0]])
    many = counts[1][column[0][one]]
    other = np.arange(many.sum()) + np.repeat(begin[column[0][one]] - (np.cumsum(many) - many), many)
    one = np.repeat(one, many)
    out += np.bincount(rows[0][one] * out.shape[1] + rows[1][other], weight[0][one] * weight[1][other], out.size).reshape(out.shape)
    dense = np.flatnonzero(~few)
    for at in range(0, len(dense), COLUMNS):
        part = dense[at : at + COLUMNS]
        sides = []
        for k in range(2):
            spot = np.minimum(np.searchsorted(part, column[k]), len(part) - 1)
            keep = part[spot] == column[k]
            side = np.zeros((out.shape[k], len(part)))
            side[rows[k][keep], spot[keep]] = weight[k][keep]
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _blocked(vecs: DataFrame, by: list[str]) -> DataFrame:
    """``vecs`` with the block of each row (by a hash of its id) and the number of blocks of its group."""
    sizes = vecs.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    return matched(vecs, sizes, by, []).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _cells(left: DataFrame, right: DataFrame | None, by: list[str], work, schema: str) -> DataFrame:
    """The rows of ``work(left rows, right rows, whether both are the same)`` for all pairs of blocks of each group.

    Of one set of rows with itself (``right`` None) each pair of blocks is taken once.  Every pair of blocks is a task's unit, so a group of any
    size is spread, and each block is sent to as many units as its group has blocks: the work grows with the square of a group.
    """
    def sent(df: DataFrame, side: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")
        every = df.select("*", F.lit(side).alias("_side"), other)
        i, j = (F.col("block"), F.col("_o")) if side == 0 else (F.col("_o"), F.col("block"))
        if right is None:
            i, j, mine = F.least("block", "_o"), F.greatest("block", "_o"), (F.col("block") > F.col("_o")).cast("int")
            every = every.withColumn("_side", mine)
        return every.withColumns({"_i": i, "_j": j}).drop("block", "blocks", "_o")

    rows = sent(left, 0) if right is None else sent(left, 0).unionByName(sent(right, 1))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    itself = right is None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        alone = itself and pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        out = work(a, a if alone else b, alone)
        for c in by:
            out[c] = pd.Series([pdf[c].iloc[0]] * len(out), dtype=object, index=out.index)
        return out

    return rows.repartition(tasks, *by, "_i", "_j").groupBy(*by, "_i", "_j").applyInPandas(run, ", ".join([*[f"`{c}` {dict(rows.dtypes)[c]}" for c in by], schema]))


@dataclass
class Block:
    """Texts of a group as counts of grams, by gram: entry k of gram g, edges[g] <= k < edges[g + 1], is its count in a text (row)."""

    ids: np.ndarray  # of each text (the smallest of its copies)
    copies: np.ndarray
    grams: np.ndarray  # 64-bit hashes, ascending
    edges: np.ndarray
    rows: np.ndarray
    counts: np.ndarray
    members: tuple[np.ndarray, np.ndarray] | None = None  # all ids, copies too, and their texts; where asked for

    @classmethod
    def of(cls, ids: np.ndarray, copies: np.ndarray, gram: np.ndarray, row: np.ndarray, count: np.ndarray) -> Block:
        """From entries in any order; those of one gram and row are added up."""
        order = np.lexsort((row, gram))
        gram, row, count = gram[order], row[order], count[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(fresh)
        gram, row, count = gram[at], row[at], np.add.reduceat(count, at) if len(at) else count
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        begins = np.flatnonzero(first)
        return cls(ids, copies, gram[begins], np.append(begins, len(gram)), row.astype(np.int64), count.astype(np.int64))

    def dump(self) -> bytes:
        kind = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        plain = pickle.dumps((self.ids, self.copies, self.grams, kind(np.diff(self.edges)), kind(self.rows), kind(self.counts), self.members))
        return len(plain).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(plain, asbytes=True)

    @classmethod
    def load(cls, data: bytes) -> Block:
        ids, copies, grams, many, rows, counts, members = pickle.loads(pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True))
        return cls(ids, copies, grams, np.concatenate([[0], np.cumsum(many, dtype=np.int64)]), rows.astype(np.int64), counts.astype(np.int64), members)

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def lengths(self) -> np.ndarray:
        """Squares of the lengths of the vectors, in whole numbers."""
        return np.bincount(self.rows, self.counts * self.counts, len(self.ids))

    def take(self, rows: np.ndarray) -> Block:
        """The texts ``rows``, in that order."""
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        new = place[self.rows]
        keep = new >= 0
        gram = np.repeat(self.grams, np.diff(self.edges))[keep]
        return Block.of(self.ids[rows], self.copies[rows], gram, new[keep], self.counts[keep])

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        starts = np.cumsum([0, *map(len, blocks)])
        gram = np.concatenate([np.repeat(b.grams, np.diff(b.edges)) for b in blocks])
        row = np.concatenate([b.rows + n for b, n in zip(blocks, starts, strict=False)])
        return Block.of(np.concatenate([b.ids for b in blocks]), np.concatenate([b.copies for b in blocks]), gram, row, np.concatenate([b.counts for b in blocks]))

    def cosines(self, other: Block) -> np.ndarray:
        """Cosines of all texts with all of ``other``: products of counts, which are exact, over the lengths."""
        out = self.products(other).astype(float)
        out /= np.sqrt(self.lengths)[:, None]
        out /= np.sqrt(other.lengths)[None, :]
        return out

    def products(self, other: Block) -> np.ndarray:
        """Products of the counts of all texts with those of all of ``other``: whole numbers, in single precision where that holds them."""
        spot = np.minimum(np.searchsorted(self.grams, other.grams), max(len(self.grams) - 1, 0))
        its = np.flatnonzero(self.grams[spot] == other.grams) if len(self.grams) else spot[:0]
        mine = spot[its]
        shape = len(self), len(other)
        many = [(b.edges[1:] - b.edges[:-1])[at] for b, at in ((self, mine), (other, its))]
        few = many[0] * many[1] <= FEW_ENTRIES

        def entries(b: Block, at: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.arange(n.sum()) + np.repeat(b.edges[at] - (np.cumsum(n) - n), n)

        # grams that few texts of both have: each entry with each
        n = many[1][few]
        one = entries(self, mine[few], many[0][few])
        each = np.repeat(n, many[0][few])
        two = np.arange(each.sum()) + np.repeat(np.repeat(other.edges[its[few]], many[0][few]) - (np.cumsum(each) - each), each)
        at = np.repeat(self.rows[one] * shape[1], each) + other.rows[two]
        weights = np.repeat(self.counts[one], each) * other.counts[two]
        # sums of whole numbers below 2 ** 24 are exact in single precision
        kind = np.float32 if max(x.lengths.max(initial=0) for x in (self, other)) < 2**24 else np.float64
        out = np.bincount(at, weights, shape[0] * shape[1]).astype(kind).reshape(shape)
        # the others as dense columns
        dense = np.flatnonzero(~few)
        for begin in range(0, len(dense), COLUMNS):
            part = dense[begin : begin + COLUMNS]
            sides = []
            for b, where, m in ((self, mine, many[0]), (other, its, many[1])):
                side = np.zeros((len(b), len(part)), kind)
                k = entries(b, where[part], m[part])
                side[b.rows[k], np.repeat(np.arange(len(part)), m[part])] = b.counts[k]
                sides.append(side)
            out += sides[0] @ sides[1].T
        return out

    def bins(self, other: Block, bins: int) -> np.ndarray:
        """The bin of each cosine, to six places, of ``bins`` equal ones of 0..1, the last one closed.

        Cosines are worked out in single precision; those near the edge of a bin are worked out anew as ``cosines`` does.
        """
        product = self.products(other)
        lengths = np.sqrt(self.lengths), np.sqrt(other.lengths)
        at = product.astype(np.float32)
        at *= (bins / lengths[0]).astype(np.float32)[:, None]
        at *= (1 / lengths[1]).astype(np.float32)[None, :]
        at += np.float32(bins * 0.5e-6)  # cosines are rounded to millionths, half up
        off = np.rint(at)
        np.maximum(off, 1, out=off)  # 0 is no edge
        np.subtract(at, off, out=off)
        np.abs(off, out=off)
        out = np.minimum(at.astype(np.int32), bins - 1)
        i, j = np.nonzero(off < bins * 2e-6)
        out[i, j] = np.minimum(_micro(product[i, j].astype(float) / lengths[0][i] / lengths[1][j]) * bins // 1_000_000, bins - 1)
        return out


def _micro(cosine: np.ndarray) -> np.ndarray:
    """Cosines in millionths, rounded half up."""
    return np.floor(cosine * 1e6 + 0.5).astype(np.int64)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes, in that order."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x + b.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _packed(docs: DataFrame, by: list[str], id: str, text: str, members: bool = False) -> DataFrame:
    """(by…, block, blocks, data): one text of each class of equal ones, in blocks of about BLOCK by the text; written.  ``members``: with
    the ids of all copies.

    Texts are shuffled once and their vectors never: a block leaves the task that made it packed, some 600 bytes a text.
    """
    rows = docs.where(F.col(text).isNotNull()).select(*by, F.col(id).alias("id"), F.col(text).alias("_t"), F.sha2(text, 256).alias("_h"))
    sizes = written(rows.groupBy(*by).agg(F.ceil(F.approx_count_distinct("_h", 0.02) / F.lit(BLOCK)).cast("int").alias("blocks")), "group-sizes")
    placed = matched(rows, sizes, by, []).withColumn("block", F.pmod(F.xxhash64("_h"), F.col("blocks")).cast("int"))
    placed = placed.where(F.lower("_t").rlike(TERM))  # a test of the tokens would work them out twice
    classes = placed.repartition(_tasks(docs), *by, "block").groupBy(*by, "block", "_h").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("blocks").alias("blocks"), F.first("_t").alias("_t"), *([F.collect_list("id").alias("all")] if members else []))
    more = ["all"] if members else []
    tokens = classes.select(*by, "block", "blocks", "id", "m", *more, F.transform(terms(F.col("_t")), lambda t: F.xxhash64(t)).alias("tokens"))
    kinds = dict(tokens.dtypes)

    def pack(table: pa.Table) -> pa.Table:
        lists = table.column("tokens").combine_chunks()
        token = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        # a pair of neighbours is told by the hashes of both
        pair = np.flatnonzero(row[1:] == row[:-1])
        gram = np.concatenate([token, _paired(token[pair], token[pair + 1])])
        row = np.concatenate([row, row[pair]])
        block = Block.of(table.column("id").to_numpy(), table.column("m").to_numpy(), gram, row, np.ones(len(gram), np.int64))
        if members:
            every = table.column("all").combine_chunks()
            block.members = every.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(every)), np.diff(every.offsets.to_numpy()))
        return table.select([*by, "block", "blocks"]).slice(0, 1).append_column("data", pa.array([block.dump()], pa.binary()))

    return written(tokens.groupBy(*by, "block").applyInArrow(pack, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "block int, blocks int, data binary"])), "blocks")


#: Bytes that an Arrow batch of packed blocks has at most, and the setting.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _written(df: DataFrame, name: str) -> DataFrame:
    """``written``, with small Arrow batches: a row has blocks of half a MB, and batches are held by the JVM and by Python."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_SETTING, None)
    conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        return written(df, name)
    finally:
        conf.unset(BATCH_SETTING) if before is None else conf.set(BATCH_SETTING, before)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _over_cells(blocks: DataFrame, others: DataFrame | None, by: list[str], start: Callable, schema: str, coarse: bool = False) -> DataFrame:
    """What is said of all pairs of blocks of each group; those of one table with itself (``others`` None) are taken once.

    Tasks read their blocks from where they are written, each some of one side and some of the other, so no block is ever shuffled, however many it
    meets.  A task calls ``start()`` for each group it comes to, which gives (meet, end): meet(block, other, whether they are the same)
    gives columns or None, end() what is left to say.  ``coarse``: no more tasks than keep the cores busy.
    """
    kinds = dict(blocks.dtypes)
    alone = others is None
    right = (blocks if alone else others).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("block").alias("_j"), F.col("data").alias("_b"))
    rule = F.col("_i") <= F.col("_j") if alone else F.lit(True)
    for c in by:
        rule = rule & F.col(c).eqNullSafe(F.col(f"_{c}"))
    few = int(np.ceil(np.sqrt(4 * blocks.sparkSession.sparkContext.defaultParallelism)))
    sizes = (blocks if alone else blocks.select(*by).unionByName(others.select(*by))).groupBy(*by).count()
    cells, every = sizes.agg(F.sum(F.col("count") * F.col("count") / 2), F.sum("count")).first()
    parts = max(few, -(-int(every or 0) // PART_BLOCKS), 0 if coarse else int(np.ceil(np.sqrt((cells or 0) / TASK_CELLS))))
    left = blocks.select(*by, F.col("block").alias("_i"), F.col("data").alias("_a")).coalesce(parts).sortWithinPartitions(*by)
    pairs = left.join(right.coalesce(parts).hint("shuffle_replicate_nl"), rule).select(*by, "_i", "_j", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known, mine, own, meet, end = None, None, None, None, None, None

        def said(columns: dict | None) -> Iterator[pa.RecordBatch]:
            n = len(next(iter(columns.values()))) if columns else 0
            if n:
                at = pa.array(np.zeros(n, np.int32))
                yield pa.record_batch([*[x.take(at) for x in own], *[pa.array(x) for x in columns.values()]], names=[*by, *columns])

        for batch in batches:
            for k in range(batch.num_rows):
                here = tuple(batch.column(c)[k].as_py() for c in range(len(by)))
                i, j = batch.column(len(by))[k].as_py(), batch.column(len(by) + 1)[k].as_py()
                if group != here:
                    if end:
                        yield from said(end())
                    group, own, known = here, [batch.column(c).slice(k, 1) for c in range(len(by))], None
                    meet, end = start()
                if known != i:
                    known, mine = i, Block.load(batch.column(len(by) + 2)[k].as_buffer())
                same = alone and i == j
                yield from said(meet(mine, mine if same else Block.load(batch.column(len(by) + 3)[k].as_buffer()), same))
        if end:
            yield from said(end())

    return pairs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], schema]))


def _products(a: Block, b: Block, alone: bool) -> np.ndarray:
    """Cosines of two blocks; NaN below the diagonal where both are the same, so that each pair counts once."""
    out = a.cosines(b)
    if alone:
        out[np.tril_indices(len(out))] = np.nan
    return out


def _near(a: Block, b: Block, alone: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of the near pairs of two blocks, a < b."""
    values = _products(a, b, alone)
    i, j = np.nonzero(values >= threshold - 1e-9)
    x, y = a.ids[i], b.ids[j]
    return np.minimum(x, y), np.maximum(x, y), values[i, j]


def similar_pairs(docs: DataFrame, by: list[str], threshold: float = NEAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, a, b, cosine) of all pairs a < b of a group whose cosine reaches ``threshold``, exactly.

    Equal texts are one class: pairs are between class representatives (the smallest id), see ``classes_of``.  Counts without
    weights for rarity put most of a vector into its commonest grams, so that no prefix of a vector tells pairs apart; all pairs of blocks
    of a group are multiplied instead, and only near pairs leave a task.
    """

    def start() -> tuple:
        return lambda a, b, alone: dict(zip(("a", "b", "cosine"), _near(a, b, alone, threshold), strict=True)), lambda: None

    kind = dict(docs.dtypes)[id]
    return _over_cells(_packed(docs, by, id, text), None, by, start, f"a {kind}, b {kind}, cosine double")


def near_ids(known: DataFrame, new: DataFrame, by: list[str], threshold: float = NEAR) -> DataFrame:
    """(by…, id) of the vectors of ``new`` that are near one of ``known`` in their group."""

    def hit(a: pd.DataFrame, b: pd.DataFrame, alone: bool) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": b["id"].iloc[:0]})
        values = cosines((a["grams"].tolist(), a["weights"].tolist()), (b["grams"].tolist(), b["weights"].tolist()))
        return pd.DataFrame({"id": b["id"].to_numpy()[values.max(0) >= threshold - 1e-9]})

    # both sides in blocks of the same groups
    both = _blocked(known.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))), by)
    sides = [both.where("not _new").drop("_new"), both.where("_new").drop("_new")]
    return _cells(*sides, by, hit, f"id {dict(new.dtypes)['id']}").distinct()


def _counted(docs: DataFrame, by: list[str], id: str, text: str, say: Callable, schema: str) -> DataFrame:
    """What ``say`` makes of the counts of pairs by cosine in millionths (0 to a million) that a task has come to, copies included."""

    def start() -> tuple:
        total = np.zeros(1_000_001, np.int64)

        def meet(a: Block, b: Block, alone: bool) -> None:
            values = a.cosines(b)
            if alone:
                here = np.triu_indices(len(a), 1)
                values, n = values[here], (a.copies[here[0]] * a.copies[here[1]]).astype(float)
                total[1_000_000] += (a.copies * (a.copies - 1) // 2).sum()
            else:
                values, n = values.ravel(), np.outer(a.copies, b.copies).ravel().astype(float)
            micro = np.minimum(_micro(values), 1_000_000)
            np.add(total, np.bincount(micro, None if n.size and n.max() == 1 else n, len(total)).astype(np.int64), out=total)

        return meet, lambda: say(total)

    return _over_cells(_packed(docs, by, id, text), None, by, start, schema, coarse=True)


#: Ranges of cosines whose counts go from task to task in one piece.
PIECES = 16


def cosine_counts(docs: DataFrame, by: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, cosine, n): how many pairs of texts of each group, copies included, have each cosine, to six places.

    At most a million and one rows a group, however many pairs it has.
    """
    found = _counted(docs, by, id, text, _pieces, "piece int, data binary")

    def add(table: pa.Table) -> pa.Table:
        total = _whole(table)
        some = np.flatnonzero(total)
        own = table.select(by).take(pa.array(np.zeros(len(some), np.int32)))
        return own.append_column("cosine", pa.array(some / 1_000_000)).append_column("n", pa.array(total[some]))

    kinds = dict(found.dtypes)
    return found.groupBy(*by, "piece").applyInArrow(add, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "cosine double, n long"]))


def _pieces(total: np.ndarray) -> dict:
    """Counts by cosine, packed."""
    pieces = np.array_split(total, PIECES)
    some = [k for k, x in enumerate(pieces) if x.any()]
    return {"piece": np.array(some, np.int32), "data": [pa.Codec("zstd", 3).compress(pieces[k].tobytes(), asbytes=True) for k in some]}


def _whole(table: pa.Table) -> np.ndarray:
    """The sum of packed counts by cosine."""
    total = np.zeros(1_000_001, np.int64)
    parts = np.array_split(total, PIECES)  # views
    for piece, data in zip(table.column("piece").to_pylist(), table.column("data"), strict=True):
        parts[piece] += np.frombuffer(pa.Codec("zstd").decompress(data.as_buffer(), 8 * len(parts[piece])), np.int64)
    return total


def classes_of(docs: DataFrame, by: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, id, class_id): equal texts of a group are one class, named by its smallest id; NULL texts have none."""
    rows = docs.where(F.col(text).isNotNull()).select(*by, F.col(id).alias("id"), F.sha2(text, 256).alias("h"))
    least = rows.groupBy(*by, "h").agg(F.min("id").alias("class_id"))
    return matched(rows, least, by, ["h"]).select(*by, F.col("id").alias(id), "class_id")


def similarity_report(docs: DataFrame, by: list[str], threshold: float = NEAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, texts, pairs, mean_cosine, median_cosine, p95_cosine, max_cosine, near_pairs, near_pct) over all pairs of a group,
    copies included, of cosines to six places.  Groups of fewer than two texts with a gram have no row."""
    found = _counted(docs, by, id, text, _pieces, "piece int, data binary")

    def figures(table: pa.Table) -> pa.Table:
        total = _whole(table)
        upto = np.cumsum(total)
        pairs = int(upto[-1])
        near = int(total[np.arange(len(total)) / 1_000_000 >= threshold].sum())
        mean = sum(int(k) * int(total[k]) for k in np.flatnonzero(total)) / pairs / 1_000_000

        def quantile(q: float) -> float:
            # interpolated between neighbours, as PERCENTILE_CONT does
            rank = q * (pairs - 1)
            low, high = (int(np.searchsorted(upto, int(f(rank)), "right")) / 1_000_000 for f in (np.floor, np.ceil))
            return low + (rank - np.floor(rank)) * (high - low)

        out = table.select(by).slice(0, 1)
        for name, value in (("pairs", pairs), ("near_pairs", near), ("mean", mean), ("median", quantile(0.5)), ("p95", quantile(0.95)), ("top", int(np.flatnonzero(total)[-1]) / 1_000_000)):
            out = out.append_column(name, pa.array([value]))
        return out

    # a group's counts are packed and a million and one at most, however many pairs it has
    keys = [f"`{c}` {dict(found.dtypes)[c]}" for c in by]
    joined = found.groupBy(*by).applyInArrow(figures, ", ".join([*keys, "pairs long, near_pairs long, mean double, median double, p95 double, top double"]))
    texts = (1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2  # pairs are n (n - 1) / 2
    return joined.select(
        *by, F.round(texts).cast("long").alias("texts"), "pairs", F.round("mean", 4).alias("mean_cosine"), F.round("median", 4).alias("median_cosine"), F.round("p95", 4).alias("p95_cosine"),
        F.round("top", 4).alias("max_cosine"), "near_pairs", F.round(100 * F.col("near_pairs") / F.col("pairs"), 4).alias("near_pct"),
    )


def cosine_histogram(docs: DataFrame, by: list[str], bins: int = 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, bin, n): pairs of each group by cosine in ``bins`` equal bins of 0..1, the last one closed; bins without a pair are left out."""

    def start() -> tuple:
        total = np.zeros(bins, np.int64)

        def meet(a: Block, b: Block, alone: bool) -> None:
            here = a.bins(b, bins)
            if alone:
                total[bins - 1] += (a.copies * (a.copies - 1) // 2).sum()
                here[np.tril_indices(len(a))] = bins  # each pair counts once
            n = np.bincount(here.ravel(), minlength=bins + 1)[:bins]
            # pairs with copies count more than once: rows that have some, and of the other rows those columns
            x, y = np.flatnonzero(a.copies > 1), np.flatnonzero(b.copies > 1)
            rest = np.flatnonzero(a.copies == 1)
            for i, j in ((x, np.arange(len(b))), (rest, y)):
                if len(i) and len(j):
                    more = np.outer(a.copies[i], b.copies[j]) - 1
                    n = n + np.bincount(here[np.ix_(i, j)].ravel(), more.ravel().astype(float), bins + 1)[:bins].astype(np.int64)
            np.add(total, n, out=total)

        return meet, lambda: {"bin": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]}

    found = _written(_over_cells(_packed(docs, by, id, text), None, by, start, "bin int, n long", coarse=True), "bins")
    return found.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def first_offenders(docs: DataFrame, by: list[str], k: int = 10, worst: bool = False, threshold: float = NEAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, rank, a, b, cosine): the first ``k`` near pairs of each group by id, or the ``k`` with the largest cosine.

    The first pairs begin with the first texts: these are held against all texts of their group, and where that gives ``k`` pairs or more no other can
    come before them.  Only groups in which it gives fewer, and all where the worst pairs are asked for, have all pairs multiplied.
    """

    def start() -> tuple:
        best: list = []  # the first k pairs so far: a, b, cosine

        def meet(a: Block, b: Block, alone: bool) -> None:
            if not worst and best and len(best[0]) == k:
                # a pair whose smaller id is behind those of k pairs isn't one of the first k
                last = best[0][-1]
                x, y = np.flatnonzero(a.ids <= last), np.flatnonzero(b.ids <= last)
                cells = [(a.take(x), b, False)] * bool(len(x)) + [(a, b.take(y), False)] * (bool(len(y)) and not alone)
            else:
                cells = [(a, b, alone)]
            for one, two, same in cells:
                x, y, cosine = _near(one, two, same, threshold)
                keep = x != y
                x, y, cosine = (np.concatenate([old, new[keep]]) for old, new in zip(best or (x[:0], y[:0], cosine[:0]), (x, y, cosine), strict=True))
                if worst and len(x) > 4 * k:
                    micro = _micro(cosine)
                    most = np.flatnonzero(micro >= np.partition(micro, len(micro) - k)[len(micro) - k])
                    x, y, cosine = x[most], y[most], cosine[most]
                order = np.lexsort((y, x, -_micro(cosine))) if worst else np.lexsort((y, x))
                x, y, cosine = x[order], y[order], cosine[order]
                # a pair may be met from both sides
                fresh = np.ones(len(x), bool)
                fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                best[:] = [z[fresh][:k] for z in (x, y, cosine)]

        return meet, lambda: dict(zip(("a", "b", "cosine"), best, strict=True)) if best else None

    kind = dict(docs.dtypes)[id]
    schema = f"a {kind}, b {kind}, cosine double"
    order = ([F.desc(F.round("cosine", 6))] if worst else []) + [F.col("a"), F.col("b")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "rank", "a", "b", "cosine")

    blocks = _packed(docs, by, id, text)
    if worst:
        return ranked(_over_cells(blocks, None, by, start, schema))
    fronts, whole = _fronts(blocks, by, kind)
    # two tasks may meet a pair of first texts from either side
    met = _over_cells(blocks, fronts, by, start, schema, coarse=True).dropDuplicates([*by, "a", "b"])
    early = _written(ranked(met), "first-pairs")
    done = early.groupBy(*by).count().where(F.col("count") >= k).select(*by).unionByName(whole)
    rest = written(matched(blocks, done, by, [], "left_anti"), "blocks")
    if not rest.limit(1).count():
        return early
    return matched(early, done, by, [], "left_semi").unionByName(ranked(_over_cells(rest, None, by, start, schema)))


def _fronts(blocks: DataFrame, by: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(by…, block, data): the first texts by id of each group, about FIRST of them, packed; and the groups (by…) that have no other texts."""
    kinds = dict(blocks.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    width = len(by)

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.sort(Block.load(batch.column("data")[k].as_buffer()).ids)
                quota = -(-2 * FIRST // batch.column("blocks")[k].as_py()) + 8
                value = pa.array(ids[quota - 1 : quota] if len(ids) > quota else [None], pa.string() if ids.dtype == object else pa.from_numpy_dtype(ids.dtype))
                yield pa.record_batch([*[batch.column(c).slice(k, 1) for c in range(width)], value], names=[*by, "edge"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                packed, last = Block.load(batch.column("data")[k].as_buffer()), batch.column("last")[k].as_py()
                rows = np.arange(len(packed)) if last is None else np.flatnonzero(packed.ids <= last)
                if len(rows):
                    yield pa.record_batch([*[batch.column(c).slice(k, 1) for c in range(width)], pa.array([packed.take(rows).dump()], pa.binary())], names=[*by, "data"])

    def join(table: pa.Table) -> pa.Table:
        front = Block.joined([Block.load(x.as_buffer()) for x in table.column("data")])
        return table.select(by).slice(0, 1).append_column("block", pa.array([0], pa.int32())).append_column("data", pa.array([front.dump()], pa.binary()))

    edges = blocks.mapInArrow(edge, ", ".join(filter(None, [keys, f"edge {kind}"])))
    told = _written(edges.groupBy(*by).agg(F.min("edge").alias("last")), "first-edges")
    cut = matched(blocks, told, by, []).select(*by, "data", "last").mapInArrow(first, ", ".join(filter(None, [keys, "data binary"])))
    fronts = cut.groupBy(*by).applyInArrow(join, ", ".join(filter(None, [keys, "block int, data binary"])))
    return _written(fronts, "fronts"), told.where("last is null").select(*by)


def duplicate_guard(docs: DataFrame, by: list[str], threshold: float = NEAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, id, accepted): in order of id, a text is rejected if an accepted one before it is a near duplicate.

    The outcome is that of taking the texts one by one.  Copies
    of a text follow it and are rejected; texts without a gram are accepted, copies among them too, and NULL texts are left out.
    """
    return _guarded(docs, by, threshold, id, text)[0]


def _guarded(docs: DataFrame, by: list[str], threshold: float, id: str, text: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The outcome of the guard, the packed blocks, and the packed accepted texts of each round."""
    kinds = dict(docs.dtypes)
    gramless = docs.where(F.col(text).isNotNull() & ~F.lower(text).rlike(TERM)).select(*by, id, F.lit(True).alias("accepted"))
    blocks = _packed(docs, by, id, text, True)
    taken = _in_order(blocks, by, threshold, kinds[id])
    ok = None
    for part in taken:
        here = part.select(*by, F.explode("ids").alias("class_id"))
        ok = here if ok is None else ok.unionByName(here)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                packed = Block.load(batch.column("data")[k].as_buffer())
                ids, text = packed.members
                at = pa.array(np.zeros(len(ids), np.int32))
                yield pa.record_batch([*[batch.column(c).slice(k, 1).take(at) for c in range(len(by))], pa.array(ids), pa.array(packed.ids[text])], names=[*by, id, "class_id"])

    # the ids of all copies come from the blocks, so that neither texts nor their hashes are shuffled anew
    keys = [f"`{c}` {kinds[c]}" for c in by]
    every = _written(blocks.select(*by, "data").mapInArrow(named, ", ".join([*keys, f"`{id}` {kinds[id]}, class_id {kinds[id]}"])), "guard-ids")
    out = matched(every, ok.withColumn("ok", F.lit(True)), by, ["class_id"], "left")
    return out.select(*by, id, ((F.col(id) == F.col("class_id")) & F.coalesce("ok", F.lit(False))).alias("accepted")).unionByName(gramless), blocks, taken


def _in_order(blocks: DataFrame, by: list[str], threshold: float, kind: str) -> list[DataFrame]:
    """(by…, ids, block, data) of the accepted texts of each round, a row for each group.

    Each round takes the first texts of each group that are left, about FRONT of them, in order of id; a task decides those of a
    group one after the other.  All texts behind them are then held against those that were accepted, and rejected ones are left out of
    all further rounds.  So no table of near pairs is needed, and texts are multiplied with accepted ones only.  What is left is a bit a text.
    """
    kinds = dict(blocks.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    schema = ", ".join(filter(None, [keys, f"block int, left binary, edge {kind}"]))
    width = len(by)

    def edge(ids: np.ndarray, quota: int):
        """The largest id that a round may take of a block: None if all."""
        return np.sort(ids)[quota - 1] if len(ids) > quota else None

    def quota(blocks: int) -> int:
        return -(-2 * FRONT // blocks) + 8

    def state(own: list[pa.Array], block: int, blocks: int, packed: Block, left: np.ndarray) -> pa.RecordBatch:
        ids = packed.ids[left]
        last = edge(ids, quota(blocks))
        value = pa.array([last], pa.string() if ids.dtype == object else pa.from_numpy_dtype(ids.dtype))
        names = [*by, "block", "left", "edge"]
        return pa.record_batch([*own, pa.array([block], pa.int32()), pa.array([np.packbits(left).tobytes()], pa.binary()), value], names=names)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                packed = Block.load(batch.column("data")[k].as_buffer())
                yield state([batch.column(c).slice(k, 1) for c in range(width)], batch.column("block")[k].as_py(), batch.column("blocks")[k].as_py(), packed, np.ones(len(packed), bool))

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                packed = Block.load(batch.column("data")[k].as_buffer())
                left = np.unpackbits(np.frombuffer(batch.column("left")[k].as_buffer(), np.uint8), count=len(packed)).astype(bool)
                last = batch.column("last")[k].as_py()
                rows = np.flatnonzero(left & (packed.ids <= last) if last is not None else left)
                if len(rows):
                    yield pa.record_batch([*[batch.column(c).slice(k, 1) for c in range(width)], pa.array([packed.take(rows).dump()], pa.binary())], names=[*by, "data"])

    def decide(table: pa.Table) -> pa.Table:
        texts = Block.joined([Block.load(x.as_buffer()) for x in table.column("data")])
        texts = texts.take(np.argsort(texts.ids, kind="stable"))
        near = np.concatenate([texts.take(np.arange(at, min(at + BLOCK, len(texts)))).cosines(texts) >= threshold - 1e-9 for at in range(0, len(texts), BLOCK)])
        rejected, chosen = np.zeros(len(texts), bool), []
        for k in range(len(texts)):
            if not rejected[k]:
                chosen.append(k)
                rejected |= near[k]
        accepted = texts.take(np.array(chosen))
        out = table.select(by).slice(0, 1).append_column("ids", pa.array([accepted.ids])).append_column("block", pa.array([0], pa.int32()))
        return out.append_column("data", pa.array([accepted.dump()], pa.binary()))

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                packed = Block.load(batch.column("data")[k].as_buffer())
                left = np.unpackbits(np.frombuffer(batch.column("left")[k].as_buffer(), np.uint8), count=len(packed)).astype(bool)
                last = batch.column("last")[k].as_py()
                left &= packed.ids > last
                if left.any():
                    rows = np.flatnonzero(left)
                    accepted, rest = Block.load(batch.column("_data")[k].as_buffer()), packed.take(rows)
                    parts = [accepted] if len(accepted) <= BLOCK else [accepted.take(np.arange(at, min(at + BLOCK, len(accepted)))) for at in range(0, len(accepted), BLOCK)]
                    left[rows] = np.max([part.cosines(rest).max(0, initial=0) for part in parts], axis=0) < threshold - 1e-9
                if left.any():
                    yield state([batch.column(c).slice(k, 1) for c in range(width)], batch.column("block")[k].as_py(), batch.column("blocks")[k].as_py(), packed, left)

    open_ = _written(blocks.mapInArrow(begin, schema), "guard-left")
    taken: list[DataFrame] = []
    while True:
        told = written(open_.groupBy(*by).agg(F.min("edge").alias("last")), "guard-edges")
        named = matched(open_.drop("edge"), told, by, [])
        here = matched(blocks, F.broadcast(named), by, ["block"])
        sent = here.mapInArrow(front, ", ".join(filter(None, [keys, "data binary"])))
        new = _written(sent.groupBy(*by).applyInArrow(decide, ", ".join(filter(None, [keys, f"ids array<{kind}>, block int, data binary"]))), "guard-taken")
        taken.append(new)
        rest = matched(new, told.where("last is not null"), by, [], "left_semi")
        chosen = rest.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("data").alias("_data"))
        rule = F.lit(True)
        for c in by:
            rule = rule & F.col(c).eqNullSafe(F.col(f"_{c}"))
        pairs = here.where("last is not null").join(chosen.hint("shuffle_replicate_nl"), rule).drop(*[f"_{c}" for c in by])
        open_ = _written(pairs.select(*by, "block", "blocks", "data", "left", "last", "_data").mapInArrow(behind, schema), "guard-left")
        if not open_.limit(1).count():
            return taken


def guard_log(docs: DataFrame, by: list[str], threshold: float = NEAR, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(by…, id, accepted, similarity, closest_to): the outcome of ``duplicate_guard``, and of each text the accepted one before it that
    is nearest (of equal ones the first), with their cosine to six places; 0 and NULL where there is none with a common gram."""
    outcome, blocks, taken = _guarded(docs, by, threshold, id, text)
    decided = written(outcome, "guard-decided")
    kind = dict(docs.dtypes)[id]
    accepted = None
    for n, part in enumerate(taken):
        here = part.select(*by, F.lit(n).alias("block"), "data")
        accepted = here if accepted is None else accepted.unionByName(here)

    def start() -> tuple:
        def meet(a: Block, b: Block, alone: bool) -> dict:
            # a: texts, b: accepted ones in order of id; the best of the first n of these, for each n, and the first of them that has it
            values = _micro(b.cosines(a))
            best = np.maximum.accumulate(values, 0)
            at = np.zeros(values.shape, np.int32)
            at[1:] = np.where(best[1:] > best[:-1], np.arange(1, len(b), dtype=np.int32)[:, None], 0)
            np.maximum.accumulate(at, 0, out=at)
            ids, text = a.members
            n = np.searchsorted(b.ids, ids) - 1  # the last accepted one before each
            score = np.where(n >= 0, best[n, text], 0)
            some = score > 0
            return {"id": ids[some], "similarity": score[some] / 1e6, "closest_to": b.ids[at[n, text][some]]}

        return meet, lambda: None

    found = _over_cells(blocks, accepted, by, start, f"id {kind}, similarity double, closest_to {kind}")
    first = found.groupBy(*by, "id").agg(F.max_by(F.struct("similarity", "closest_to"), F.struct("similarity", -F.col("closest_to"))).alias("x"))
    return matched(decided, first.withColumnRenamed("id", id), by, [id], "left").select(*by, id, "accepted", F.coalesce("x.similarity", F.lit(0.0)).alias("similarity"), F.col("x.closest_to").alias("closest_to"))


def store_vectors(rows: DataFrame, path: str, reset: bool = True, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Write (id, vector) with each vector brought to length 1, anew or behind what is there, and return the table.

    Rows whose vector is NULL, empty or zero are left out.
    """
    length = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select(id, F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull()).withColumn("n", length).where("n > 0")
    unit.select(id, F.transform("v", lambda x: x / F.col("n")).alias(vector)).write.mode("overwrite" if reset else "append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 3, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` rows nearest to each query by cosine, exactly, the query itself left out.

    Queries go out in blocks of about BLOCK_QUERIES, at most PASS_BLOCKS of them in one pass over the rows; each task keeps the best ``k`` of its
    rows for every query, and those are merged.  Ties are decided by id.  Rows whose vector is NULL, empty or zero are left out.
    """
    spark = rows.sparkSession
    read = rows.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["v"].tolist(), dtype=float)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "data": [pickle.dumps((pdf["id"].to_numpy(), np.divide(m, length, out=np.zeros_like(m), where=length > 0)))]})

    packed = written(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(pack, "block long, data binary"), "queries")

    def search(sent: Sent) -> DataFrame:
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top: list[pd.DataFrame | None] = [None] * len(sent)
            for pdf in batches:
                x = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), -1)
                long = np.linalg.norm(x, axis=1)
                x, ids = x[long > 0] / long[long > 0, None], pdf["id"].to_numpy()[long > 0]
                if not len(ids):
                    continue
                for block, (names, q) in enumerate(sent):
                    distance = 1 - q @ x.T
                    distance[names[:, None] == ids[None, :]] = np.inf
                    n = min(len(ids), k + 8)
                    near = np.argpartition(distance, n - 1, axis=1)[:, :n]
                    # rows as near as the furthest kept stay, so that ties can be decided by id
                    edge = np.take_along_axis(distance, near, 1).max(1)
                    a, b = np.nonzero((distance <= edge[:, None]) & np.isfinite(distance))
                    here = pd.DataFrame({"query_id": names[a], "id": ids[b], "distance": distance[a, b]})
                    both = here if top[block] is None else pd.concat([top[block], here])
                    top[block] = both.sort_values(["distance", "id"]).groupby("query_id").head(k)
            yield from (x for x in top if x is not None)

        return read.mapInPandas(best, "query_id long, id long, distance double")

    out = in_passes(packed, PASS_BLOCKS, pickle.loads, search, "nearest")
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_vote(near: DataFrame, labels: DataFrame, id: str = "vec_id", label: str = "label") -> DataFrame:
    """(query_id, voted): the label most of the nearest rows have; ties go to the smallest label."""
    votes = near.join(labels.select(F.col(id).alias("id"), F.col(label).alias("label")), "id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("voted"))


def calibrate(values: DataFrame, value: str, percentile: float = 0.75) -> DataFrame:
    """(threshold, mean, median, p25, p90, maximum, n) of the finite values; without any, the threshold is infinity."""
    x = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.col(value).cast("double"))
    values = values.select(x.alias("x"))
    parts = exact_quantiles(values, [], "x", {"threshold": percentile, "median": 0.5, "p25": 0.25, "p90": 0.9})
    out = values.agg(F.avg("x").alias("mean"), F.max("x").alias("maximum"), F.count("x").alias("n")).join(F.broadcast(parts), how="left")  # one row each
    return out.select(F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"), "mean", "median", "p25", "p90", "maximum", "n")
