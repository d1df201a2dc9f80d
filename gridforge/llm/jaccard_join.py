"""Jaccard join of whole texts on word n-grams, as a blocked sparse matrix product.

The matrix has a row for each class of texts with equal sets and a column for each n-gram.

1. Columns. Tasks send packed 32-bit values of their n-grams to range shards, which write the
   values of n-grams with two or more rows, with a size class, to the shared folder.
2. Bounds. A link at ``percent`` needs that share of a row's n-grams in the other row, so rows with
   fewer shared columns are done; of the others only the rarest columns, one more than a link can
   miss, are posted (a common global order by size class and hash makes that lossless). Sizes that
   link differ by less than a band, so a row is posted under its own band and the next one.
3. Blocks. The rows of a posting belong to its least row, their centre; postings with one centre are
   one tile. Tiles above a bound are cut into blocks; every block is multiplied with itself: overlap
   counts of a row with all others come from adding up its columns' postings, and pairs under the
   bound that their sizes give are discarded. Rows of the component that is largest so far need no
   product of their own, as every pair with a row outside of it is counted from that row. A chain of
   links through many tiles costs no more than its tiles.
4. Tiles of several blocks. Blocks are multiplied with themselves and with about 32 pivot rows; rows
   that are then outside of the tile's largest component are multiplied with all its blocks. All
   pairs of different components are counted, and no group's pairs are written out.

Links are only ever written as stars, one row for each row of a tile at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import Folder, blob_batches, buckets_of, by_shard, exchange, lookup, pick, shard_of, shards_of, unpack
from ._graph import components, hot_limit, join_counted
from ._text import mix, row_ngrams, slices, words

CHUNK = 1 << 20
PIVOTS = 32
LEAST_BLOCK = 8_000
MOST_BLOCK = 1 << 21
#: Sets whose copies a task remembers at a time.
SEEN = 1 << 18


def sets(column, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-gram hashes by row and in order, row edges, two 64-bit signatures of each row's set)."""
    w = words(column)
    key, row = row_ngrams(w, n)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    if len(key):
        new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
        key, row = key[new], row[new]
    edge = np.searchsorted(row, np.arange(len(w.rows)))
    sign = []
    for salt in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(key ^ np.uint64(salt)))))
        sign.append(mix((total[edge[1:]] - total[edge[:-1]]) ^ np.diff(edge).astype(np.uint64)).view(np.int64))
    return key, edge, np.stack(sign, 1)


def stars(arrays: list[np.ndarray], percent: int, must: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(component labels, the least index; counted pairs) of sets that link at ``percent`` of their union.

    With ``must`` only pairs with such a row are sure to be counted, else all pairs.
    """
    count, pairs = len(arrays), 0
    parent, weight = list(range(count)), [1] * count
    size = np.array([len(a) for a in arrays], np.int64)
    doc = np.repeat(np.arange(count), size)
    _, group = np.unique(np.concatenate(arrays), return_inverse=True)
    order = np.argsort(group, kind="stable")
    posted, where = doc[order], np.searchsorted(group[order], np.arange(len(group) and group.max() + 2))
    edge = np.concatenate(([0], np.cumsum(size)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    largest = 0
    for i in range(count) if must is None else np.flatnonzero(must).tolist():
        if weight[root(largest)] == count:
            break
        if must is None and i and root(i) == root(largest):
            continue
        mine = group[edge[i] : edge[i + 1]]
        low, many = where[mine], where[mine + 1] - where[mine]
        at = np.arange(many.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        other, overlap = np.unique(posted[at], return_counts=True)
        pairs += len(other)
        for j in other[100 * overlap >= percent * (size[i] + size[other] - overlap)].tolist():
            a, b = sorted((root(i), root(j)))
            if a != b:
                parent[b] = a
                weight[a] += weight[b]
                if weight[a] > weight[root(largest)]:
                    largest = a
    return np.array([root(i) for i in range(count)], np.int64), pairs


def jaccard_components(df: DataFrame, n: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a row's set has its distinct n-grams of n
    words, with fewer words the whole sequence as one. Rows without words, null or empty, have no
    n-gram and link with nothing. Rows link when 100 * intersection >= percent * union; component_id
    is the smallest doc_id reachable by links (null only where all of a component are null). Repeated
    rows and rows that share a doc_id are rows of their own. N-grams are compared by 64-bit hashes,
    equal sets by 128-bit ones. An empty table gives an empty result; only the two named columns are
    read.
    """
    docs = pick(df, id_column, text_column).toDF("doc_id", "text")
    (shards, fine), folder = shards_of(docs), Folder(df.sparkSession)
    buckets = shards * fine

    def parts(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                key, edge, sign = sets(part.column(1), n)
                new = np.zeros(len(sign), bool)  # most equal sets of a task count and are carried once
                if len(seen) > SEEN:
                    seen.clear()
                for k, s in enumerate(map(tuple, sign.tolist())):
                    if edge[k + 1] > edge[k] and s not in seen:
                        seen.add(s)
                        new[k] = True
                yield part, key, edge, sign, new

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            key = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            many = np.minimum(np.diff(np.append(first, len(key))), 255)
            yield from by_shard(shard_of(key[first], buckets), buckets, key[first].astype(np.uint32), many.astype(np.uint8))

        for _, key, edge, _, new in parts(batches):
            held.append(key[np.repeat(new, np.diff(edge))])
            if sum(map(len, held)) > CHUNK:
                yield from blob_batches(out())
                held = []
        if sum(map(len, held)):
            yield from blob_batches(out())

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, kinds = TaskContext.get().partitionId(), 0
        with folder.pack(f"columns-{shard}") as add:
            for _, blobs in buckets_of(batches, fine):
                value, many = unpack(blobs, (np.uint32, np.uint8))
                order = np.argsort(value, kind="stable")
                value, many = value[order], many[order].astype(np.int64)
                first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
                total = np.add.reduceat(many, first) if len(first) else many
                keep = total > 1
                kinds += int(keep.sum())
                add(value[first][keep], np.minimum(np.log2(np.maximum(total[keep], 1)) * 4, 255).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([kinds], pa.int64())], names=["kinds"])

    exchange(docs.mapInArrow(columns, "bucket int, blob binary"), shards, fine).mapInArrow(shared, "kinds long").agg(F.sum("kinds")).first()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [x for k in range(shards) for x in zip(*[iter(folder.unpack(f"columns-{k}"))] * 2, strict=True)]
        place = TaskContext.get().partitionId() << 33
        for part, key, edge, sign, new in parts(batches):
            size = np.diff(edge)
            kinds, back = np.unique(key, return_inverse=True)
            cut = np.searchsorted(shard_of(kinds, buckets), np.arange(buckets + 1))
            rank = np.zeros(len(kinds), np.int64)  # 0: in one row only
            for k in np.flatnonzero(np.diff(cut)):
                value = kinds[cut[k] : cut[k + 1]].astype(np.uint32)
                order = np.argsort(value)
                at, hit = lookup(tables[k][0], value[order])
                rank[cut[k] + order[hit]] = 1 + tables[k][1][at[hit]].astype(np.int64)
            rank = rank[back]
            common = np.concatenate(([0], np.cumsum(rank > 0)))
            common = common[edge[1:]] - common[edge[:-1]]
            candidate = new & (100 * common >= percent * size) & (size > 0)
            whole, posted = [None] * len(size), [None] * len(size)
            for k in np.flatnonzero(candidate):
                mine, r = key[edge[k] : edge[k + 1]], rank[edge[k] : edge[k + 1]]
                miss = size[k] - -(-percent * size[k] // 100)
                order = np.lexsort((mine, r))[: miss + 1]
                order = order[r[order] > 0]
                if len(order):
                    whole[k], posted[k] = mine.tobytes(), mine[order].view(np.int64)
            none = size == 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(sign[:, 0], mask=none), pa.array(sign[:, 1], mask=none), pa.array(place + np.arange(len(size))), pa.array(whole, pa.binary()), pa.array(posted, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "high", "low", "id", "grams", "posted"])
            place += len(size)

    rows = folder.save(docs.mapInArrow(bounded, "doc_id long, n_shingles long, high long, low long, id long, grams binary, posted array<long>"), "rows")
    # classes of equal sets; one with postings is known by the least row that carries them
    carrier = F.when(F.col("posted").isNotNull(), F.col("id"))
    kinds = folder.save(rows.filter(F.col("high").isNotNull()).groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.min(carrier).alias("id"), F.count("*").alias("many")), "kinds")
    classes = folder.save(rows.filter(F.col("posted").isNotNull()).select("id", "n_shingles", "grams", "posted").join(kinds.filter(F.col("id").isNotNull()).select("id"), "id", "left_semi"), "classes")

    band = F.floor(F.log(F.col("n_shingles") + 0.5) / F.log(F.lit(100 / percent + 1e-9))).cast("int") if percent < 100 else F.col("n_shingles").cast("int")
    postings = classes.select("id", F.col("n_shingles").alias("size"), F.explode("posted").alias("gram"), band.alias("band"))
    postings = folder.save(postings.select("id", "size", F.explode(F.array(F.xxhash64("gram", "band"), F.xxhash64("gram", F.col("band") + 1))).alias("gram")), "postings")
    most = hot_limit(postings.count(), shards)
    centres = postings.groupBy("gram").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("many")).filter("last > centre").drop("last")
    near = folder.save(join_counted(postings, centres, ["gram"], most).select("centre", "id", "size").distinct(), "near")

    total, members = near.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    most = hot_limit(members, shards)
    block = int(min(max(total // (2 * shards), LEAST_BLOCK), MOST_BLOCK))
    of = near.groupBy("centre").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks"), F.count("*").alias("count"), F.count("*").alias("many"))
    tiled = join_counted(near, of, ["centre"], most).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit(2)), F.col("count")) < PIVOTS)
    tiles = tiled.select("centre", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("tile"), "id", F.lit(False).alias("must"))
    grams = classes.select("id", "grams")
    tree = components(_multiply(tiles.join(grams, "id"), shards, percent), folder, "links-1", shards)

    # rows of tiles of several blocks that are outside of the tile's largest component
    wide = tiled.filter("blocks > 1").select("centre", "id", "size", "blocks", "own")
    placed = folder.save(wide.join(tree.withColumnRenamed("node", "id"), "id", "left").select("centre", "id", "size", "blocks", "own", F.coalesce("root", "id").alias("root")), "placed")
    weights = placed.groupBy("centre", "root").agg(F.sum("size").alias("weight"), F.count("*").alias("count"))
    largest = weights.groupBy("centre").agg(F.max_by("root", F.struct("weight", "root")).alias("main"), F.sum("count").alias("many"))
    outside = folder.save(join_counted(placed, largest, ["centre"], most).filter("root <> main").select("centre", "id", "size", "blocks"), "outside")
    left = outside.groupBy("centre").agg(F.ceil(F.sum("size") / MOST_BLOCK).cast("int").alias("parts"), F.count("*").alias("rest"))
    if not outside.isEmpty():
        part = F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")
        rest = join_counted(outside, left.withColumnRenamed("rest", "many"), ["centre"], most).withColumn("part", part)
        every = rest.select("centre", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "part", "parts")
        musts = every.select("centre", (F.col("own") * F.col("parts") + F.col("part")).alias("tile"), "id", F.lit(True).alias("must"))
        whole = left.join(largest.drop("main"), "centre").drop("rest")
        others = join_counted(placed, whole, ["centre"], most).select("centre", "id", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
        others = others.select("centre", (F.col("own") * F.col("parts") + F.col("part")).alias("tile"), "id", F.lit(False).alias("must"))
        both = musts.unionByName(others).groupBy("centre", "tile", "id").agg(F.max("must").alias("must"))
        more = _multiply(both.join(grams, "id"), shards, percent)
        tree = components(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), folder, "links-2", shards)

    linked = kinds.filter(F.col("id").isNotNull()).join(tree.withColumnRenamed("node", "id"), "id", "left").select("high", "low", "least", "many", F.coalesce("root", "id").alias("root"))
    linked = linked.withColumnRenamed("many", "copies")
    joined = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    named = join_counted(linked, joined, ["root"], most).select("high", "low", "component_id", F.col("copies").alias("many"))
    named = folder.save(named.unionByName(kinds.filter(F.col("id").isNull()).select("high", "low", F.col("least").alias("component_id"), "many")), "named")
    some = rows.filter(F.col("high").isNotNull()).select("doc_id", "n_shingles", "high", "low")
    texts = kinds.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    found = join_counted(some, named, ["high", "low"], hot_limit(texts, shards)).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.filter(F.col("high").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _multiply(tiles: DataFrame, shards: int, percent: int) -> DataFrame:
    """Links inside every (centre, tile), as (a, b) from each row to the first of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, grams, must = None, [], [], []

        def done():
            labels, _ = stars(grams, percent, np.array(must) if any(must) else None)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            own = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[labels[at]])], names=["a", "b"])

        for batch in batches:
            for c, t, i, g, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, t) != key:
                    if len(ids) > 1:
                        yield done()
                    key, ids, grams, must = (c, t), [], [], []
                ids.append(i)
                grams.append(np.frombuffer(g, np.uint64))
                must.append(m)
        if len(ids) > 1:
            yield done()

    dealt = tiles.select("centre", "tile", "id", "grams", "must").repartition(shards, "centre", "tile").sortWithinPartitions("centre", "tile")
    return dealt.mapInArrow(run, "a long, b long")
