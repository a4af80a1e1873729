"""Exact n-gram Jaccard join.

Every text is the set of its word n-grams. Texts with equal sets are one class,
compared through the one of the least doc_id. Two sets that reach the threshold share one of
the leading grams of both, counted from the rarest, those that together outweigh what may be
lacking. Grams are counted first: what a single text has leads nowhere and only uses up
what may be lacking, so that few grams have to be looked up, and few texts.

Texts that meet at a leading gram and may reach the threshold by their sizes and the places of the gram are joined
to components. All sets of a component are compared with each other, a block with a block at a time, by
the product of the matrices of frequent grams and the lists of the others. Counted are links and what they
lead to; pairs are listed only where they are asked for.

Postings go between tasks in few rows of many, for grams and then for documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, broadcast_if_small, column, components, grouped, lean, list_array, slices, stars

N = 3
THRESHOLD = 0.5
#: Postings of a bucket of grams, about, which a task sorts at once.
POSTINGS = 1_000_000
#: Beyond so many documents that meet at a gram, each is joined to the next in size instead of to all that pass the filter.
CHAIN = 64
#: Leading postings, and edges, that a task joins at once.
MEET, EDGES = 200_000, 500_000
#: Sets of a block, and their grams, about. Components of one block share cells of less than twice this size.
BLOCK, BLOCK_GRAMS = 1200, 500_000
#: Tasks that compare blocks, at most.
TASKS = 2000
#: Buckets, or cells, that a task takes one after the other where they are many, and the tasks that there are in any case, if as many parts.
#: Each task writes a file, for which the JVM starts processes where Hadoop lacks its native library.
IN_TURN, LEAST_TASKS = 8, 64

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(x) for x in distinct.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): the distinct word n-grams of each text, hashed, in order. A text of fewer words is one gram."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    values, doc = lists.flatten(), pc.list_parent_indices(lists)
    values = pc.replace_substring_regex(coded.dictionary, r"^[^\pL\pN]+|[^\pL\pN]+$", "").take(coded.indices) if len((coded := values.dictionary_encode())) else values
    full = pc.not_equal(pc.binary_length(values), 0)
    values, doc = values.filter(full), doc.filter(full).to_numpy().astype(np.int64)
    coded = values.dictionary_encode()
    h = word_hashes(coded.dictionary)[coded.indices.to_numpy()] if len(values) else np.zeros(0, np.uint64)
    count = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(count) - count
    place = np.arange(len(h)) - start[doc]
    g = np.zeros(len(h), dtype=np.uint64)
    for k in range(n):
        there = place + k < count[doc]
        at = np.where(there, np.arange(len(h)) + k, 0)
        g = mix(g * MIX[1] + np.where(there, h[at] if len(h) else h, np.uint64(k + 1)) + MIX[0])
    take = (place + n <= count[doc]) | (place == 0)
    g, doc = g[take], doc[take]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])) if len(g) else np.zeros(0, bool)
    return doc[new], g[new]


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")


def _keyed(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram) of the sets of a batch, and the key and size of each."""
    import xxhash

    doc, gram = gram_sets(column(batch, "text"), n)
    counts = np.bincount(doc, minlength=batch.num_rows)
    ends, raw = np.cumsum(counts), gram.tobytes()
    key = [xxhash.xxh3_64_intdigest(raw[8 * (e - c) : 8 * e], seed=5) for e, c in zip(ends, counts)]
    return doc, gram, np.array(key, dtype=np.uint64).view(np.int64), counts


def _keys(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, _, key, counts = _keyed(batch, n)
                out = pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(key), pa.array(counts, pa.int32())], names=["id", "key", "size"])
                yield out.filter(pa.array(counts > 0))

    return run


PACKED = "bucket int, docs boolean, least long, ids binary, values binary, more binary"


def _pack(bucket: int, docs: bool, ids: np.ndarray, values: np.ndarray, more: np.ndarray) -> tuple:
    """A row of many postings or documents; ids are kept as what exceeds the least, in four bytes where they fit."""
    least = int(ids.min())
    over = ids.view(np.uint64) - np.uint64(least % 2**64)
    over = over.astype(np.uint32) if int(over.max()) < 2**32 else over
    return bucket, docs, least, over.tobytes(), values.tobytes(), more.tobytes()


def _unpack(row: dict, value: type, more: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, extra = np.frombuffer(row["values"], value), np.frombuffer(row["more"], more)
    over = np.frombuffer(row["ids"], np.uint32 if len(row["ids"]) == 4 * len(values) else np.uint64)
    return (over.astype(np.uint64) + np.uint64(row["least"] % 2**64)).view(np.int64), values, extra


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [part.split()[0] for part in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys start, and their lengths."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _postings(n: int, buckets: int):
    """Over (id, text, want, copies): what each bucket of grams gets of the sets whose key is the wanted one, and the documents' sizes and copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, gram, key, counts = _keyed(batch, n)
                right = (key == column(batch, "want").to_numpy()) & (counts > 0)
                if not right.any():
                    continue
                ids, copies = column(batch, "id").to_numpy(), column(batch, "copies").to_numpy()
                at = int(mix(ids[right][:1])[0] % np.uint64(buckets))
                rows = [_pack(-1 - at, True, ids[right], counts[right].astype(np.int64), copies[right])]
                gram, doc = gram[right[doc]], doc[right[doc]]
                # the lowest 48 bits go along, and the bucket comes from those above
                bucket = (gram >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                gram, doc, bucket = gram[order], doc[order], bucket[order]
                for s, c in zip(*_runs_of(bucket)):
                    g = gram[s : s + c]
                    rows.append(_pack(int(bucket[s]), False, ids[doc[s : s + c]], g.astype(np.uint32), (g >> np.uint64(32)).astype(np.uint16)))
                yield _packed(rows)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket, over rows sorted by it."""
    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and held:
                yield bucket, held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield bucket, held


def _shared(doc_buckets: int):
    """Over postings by bucket of grams: those of grams that several documents have, with a measure of how many, by bucket of documents."""

    def spread(docs: bool, ids: np.ndarray, values: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        bucket = (mix(ids.view(np.uint64)) % np.uint64(doc_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ids, values, more, bucket = ids[order], values[order], more[order], bucket[order]
        return _packed([_pack(int(bucket[s]), docs, ids[s : s + c], values[s : s + c], more[s : s + c]) for s, c in zip(*_runs_of(bucket))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                yield spread(True, *map(np.concatenate, zip(*(_unpack(r, np.int64, np.int64) for r in rows))))
                continue
            ids, low, high = map(np.concatenate, zip(*(_unpack(r, np.uint32, np.uint16) for r in rows)))
            del rows
            gram = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
            order = np.argsort(gram)
            ids, gram = ids[order], gram[order]
            starts, times = _runs_of(gram)
            several = np.repeat(times > 1, times)
            ids, gram = ids[several], gram[several]
            order = np.lexsort((ids, gram))
            ids, gram = ids[order], gram[order]
            new = np.append(True, (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
            ids, gram = ids[new], gram[new]  # of repeated rows each posting once
            starts, times = _runs_of(gram)
            several = np.repeat(times > 1, times)
            if several.any():
                # rarest first needs no more than the order of magnitude, the same for all that have the gram
                rank = np.repeat(np.minimum(255, 8 * np.log2(np.maximum(times, 1))).astype(np.uint8), times)
                gram |= np.uint64(bucket) << np.uint64(48)
                yield spread(False, ids[several], gram[several].view(np.int64), rank[several])

    return run


SETS = "id long, size long, copies long, leading int, grams array<long>"


def _led(threshold: float):
    """Over shared postings by bucket of documents: the sets that may have a similar one; grams are the shared ones, rarest first, of which the leading ones have to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            posted = [_unpack(r, np.int64, np.uint8) for r in rows if not r["docs"]]
            if not posted:
                continue
            own, size, copies = map(np.concatenate, zip(*(_unpack(r, np.int64, np.int64) for r in rows if r["docs"])))
            ids, gram, rank = map(np.concatenate, zip(*posted))
            del rows, posted
            own, first = np.unique(own, return_index=True)
            size, copies = size[first], copies[first]
            doc = np.searchsorted(own, ids)
            order = np.lexsort((gram, rank, doc))
            gram, doc = gram[order], doc[order]
            count = np.bincount(doc, minlength=len(own))
            place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc] + (size - count)[doc]
            leading = np.bincount(doc[place <= (1 - threshold) * size[doc] + 1e-6], minlength=len(own))
            keep = leading > 0
            gram = gram[keep[doc]]
            columns = [pa.array(own[keep]), pa.array(size[keep]), pa.array(copies[keep]), pa.array(leading[keep], pa.int32()), list_array(gram, count[keep], pa.int64())]
            made = pa.RecordBatch.from_arrays(columns, names=["id", "size", "copies", "leading", "grams"])
            for at in range(0, made.num_rows, 1000):
                yield made.slice(at, 1000)

    return run


def _meeting(threshold: float):
    """Over (gram, size, left, id), sorted: as few edges as join the documents that meet at a gram and may be similar."""

    def edges(gram: np.ndarray, size: np.ndarray, left: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        starts, times = _runs_of(gram)
        many = np.repeat(times > CHAIN, times)
        k = np.flatnonzero(many[:-1] & (gram[1:] == gram[:-1]))
        # in order of size: who lie on either side of a gap that no similar pair spans don't belong together
        k = k[size[k + 1] * threshold <= size[k] + 1e-6]
        u, v = [ids[k]], [ids[k + 1]]
        live, held = np.flatnonzero(~many), len(k)
        for d in range(1, CHAIN):
            live = live[live + d < len(gram)]
            live = live[gram[live + d] == gram[live]]
            if not len(live):
                break
            other = live + d
            able = np.minimum(left[live], left[other]) >= threshold / (1 + threshold) * (size[live] + size[other]) - 1e-6
            u.append(ids[live[able]])
            v.append(ids[other[able]])
            held += len(u[-1])
            if held > EDGES:
                tree = stars(np.concatenate(u), np.concatenate(v))
                u, v, held = [column(tree, "u").to_numpy()], [column(tree, "v").to_numpy()], 0
        u, v = np.concatenate(u), np.concatenate(v)
        return stars(u, v) if len(u) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "size", "left", "id"]
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append([column(batch, x).to_numpy() for x in names])
                n += batch.num_rows
            if n < MEET:
                continue
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], side="left"))
            if cut and (out := edges(*(x[:cut] for x in whole))) is not None:
                yield out
            held, n = [[x[cut:] for x in whole]], len(whole[0]) - cut if cut else 0
        if held and (out := edges(*(np.concatenate(x) for x in zip(*held)))) is not None:
            yield out

    return run


def common(a: np.ndarray, row_a: np.ndarray, n_a: int, b: np.ndarray, row_b: np.ndarray, n_b: int) -> np.ndarray:
    """How many members the sets of one side share with those of the other, exactly: (n_a, n_b)."""
    out = np.zeros(n_a * n_b, dtype=np.float32)
    words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b = at[: len(a)], at[len(a) :]
    in_a, in_b = np.bincount(at_a, minlength=len(words)), np.bincount(at_b, minlength=len(words))
    cost = in_a * in_b
    dense = cost > n_a * n_b / 100
    number = np.cumsum(dense) - 1
    matrix = out.reshape(n_a, n_b)
    for s in range(0, int(dense.sum()), 1024):
        sides = []
        for word, row, n in ((at_a, row_a, n_a), (at_b, row_b, n_b)):
            some = dense[word] & (number[word] >= s) & (number[word] < s + 1024)
            x = np.zeros((n, 1024), dtype=np.float32)
            x[row[some], number[word[some]] - s] = 1
            sides.append(x)
        matrix += sides[0] @ sides[1].T
    some = ~dense[at_a] & (cost[at_a] > 0)
    word, row = at_a[some], row_a[some]
    order = np.argsort(at_b, kind="stable")
    sorted_b, first = row_b[order], np.cumsum(in_b) - in_b
    ends = np.cumsum(in_b[word])
    s = 0
    while s < len(word):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + (2 << 20), side="right")))
        times = in_b[word[s:e]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[word[s:e]], times)
        out += np.bincount(np.repeat(row[s:e], times) * n_b + sorted_b[place], minlength=len(out)).astype(np.float32)
        s = e
    return matrix


def _compared(threshold: float, listed: bool):
    """Over the sets of two blocks (own is 0 or 1, all 0 for a block with itself): (a, b, jaccard) of every similar pair if listed, otherwise (a, b, n) of every set that has any: a leads to it, and the number of documents it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, whole in grouped(batches, ["cell", "i", "j"]):
            own = column(whole, "own").to_numpy()
            sides = []
            for side in (0, 1):
                part = whole.filter(pa.array(own == side))
                grams = column(part, "grams")
                sides.append((column(part, "id").to_numpy(), column(part, "size").to_numpy(), column(part, "copies").to_numpy(), grams.flatten().to_numpy(), pc.list_parent_indices(grams).to_numpy()))
            (ids, size, copies, gram, row), other = sides[0], sides[1] if own.any() else sides[0]
            alone = other is sides[0]
            if not len(ids) or not len(other[0]):
                continue
            n = common(gram, row, len(ids), other[3], other[4], len(other[0]))
            linked_to, linked_from = np.zeros(len(ids)), np.zeros(len(other[0]))
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            # some rows at a time: a dense cell has as many pairs as the square of its sets
            step = max(1, EDGES // len(other[0]))
            for s in range(0, len(ids), step):
                jaccard = n[s : s + step].astype(np.float64)
                jaccard /= size[s : s + step, None] + other[1][None, :] - jaccard
                near = jaccard >= threshold
                if alone:
                    near[np.arange(len(near)), np.arange(s, s + len(near))] = False
                linked_to[s : s + step] = near @ other[2].astype(np.float64)
                linked_from += copies[s : s + step].astype(np.float64) @ near
                i, j = np.nonzero(np.triu(near, s + 1) if alone else near)
                a, b = ids[s + i], other[0][j]
                if listed and len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(jaccard[i, j])], names=["a", "b", "value"])
                elif len(a):
                    tree = stars(a, b)
                    u.append(column(tree, "u").to_numpy())
                    v.append(column(tree, "v").to_numpy())
            if listed or len(u) == 1:
                continue
            tree = stars(np.concatenate(u), np.concatenate(v))
            root = dict(zip(column(tree, "u").to_pylist(), column(tree, "v").to_pylist()))
            for who, linked in [(ids, linked_to), *([] if alone else [(other[0], linked_from)])]:
                some = np.flatnonzero(linked)
                names = who[some].tolist()
                columns = [pa.array([root.get(x, x) for x in names], pa.int64()), pa.array(names, pa.int64()), pa.array(linked[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "value"])

    return run


def with_cells(room: DataFrame, small: int) -> DataFrame:
    """component, blocks and cell of components of m sets, g grams and so many blocks; large ones have a cell each, the others share about small cells of less than 2 * BLOCK sets and 2 * BLOCK_GRAMS grams."""
    group = F.pmod(F.xxhash64("component"), F.lit(small)).cast("int")
    before = Window.partitionBy("group").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    full = lambda c, most: F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / most)
    one = room.where("blocks = 1").withColumn("group", group)
    shared = one.select("component", "blocks", (-1 - F.pmod(F.xxhash64("group", full("m", BLOCK), full("g", BLOCK_GRAMS)), F.lit(2**62))).alias("cell"))
    return shared.union(room.where("blocks > 1").select("component", "blocks", F.xxhash64("component").bitwiseAND(2**62 - 1).alias("cell")))


def tasks(parts: int) -> int:
    """How many tasks so many buckets or cells go to."""
    return max(min(parts, LEAST_TASKS), -(-parts // IN_TURN))


def similar(docs: DataFrame, scratch: Scratch, n: int, threshold: float, listed: bool) -> tuple[DataFrame, DataFrame]:
    """(rep, id, copies) of every text with a gram, and what _compared() says of the representatives."""
    base = _base(docs)
    each = base.mapInArrow(lean(_keys(n)), "id long, key long, size int")
    keyed = scratch.save(each.groupBy("id").agg(F.min(F.struct("key", "size")).alias("s")).select("id", "s.*"))
    reps = scratch.save(keyed.groupBy("key", "size").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = keyed.join(reps, ["key", "size"]).select("rep", "id", "copies")
    many, grams = reps.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, min(65536, -(-grams // POSTINGS)))
    doc_buckets = buckets
    wanted = broadcast_if_small(reps.select(F.col("rep").alias("id"), F.col("key").alias("want"), "copies"), many, 48)
    postings = base.join(wanted, "id").mapInArrow(lean(_postings(n, buckets)), PACKED)
    sort = lambda df, k: df.repartitionById(tasks(k), F.pmod("bucket", F.lit(tasks(k)))).sortWithinPartitions("bucket")
    shared = scratch.save(sort(postings, buckets).mapInArrow(lean(_shared(doc_buckets)), PACKED))
    sets = scratch.save(sort(shared, doc_buckets).mapInArrow(lean(_led(threshold)), SETS))
    scratch.drop(shared)
    unshared = F.col("size") - F.size("grams")
    leading = sets.select("id", "size", unshared.alias("unshared"), F.posexplode(F.slice("grams", F.lit(1), F.col("leading"))).alias("at", "gram"))
    leading = leading.select("gram", "size", (F.col("size") - F.col("unshared") - F.col("at")).alias("left"), "id")
    edges = leading.repartition("gram").sortWithinPartitions("gram", "size").mapInArrow(lean(_meeting(threshold)), "u long, v long")
    nodes = scratch.save(components(edges, scratch, "u", "v"))
    placed = scratch.save(nodes.withColumnRenamed("node", "id").join(sets, "id"))
    room = placed.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.size("grams")).alias("g"))
    room = scratch.save(room.select("component", "m", "g", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int").alias("blocks")))
    one, total = F.col("blocks") == 1, lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    m, g, meetings = room.agg(total(F.when(one, F.col("m"))), total(F.when(one, F.col("g"))), total(F.when(~one, F.col("blocks") * (F.col("blocks") + 1) / 2))).first()
    small = max(1, -(-m // BLOCK), -(-g // BLOCK_GRAMS))
    # small components share cells; large ones fall into blocks, each of which meets every other
    rooms = room.count()
    tiles = placed.join(broadcast_if_small(with_cells(room, small), rooms, 32), "component")
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    tiles = tiles.select("cell", i, j, (F.col("block") > F.col("other")).cast("int").alias("own"), "id", "size", "copies", "grams")
    schema = "a long, b long, value double"
    found = tiles.repartition(min(TASKS, tasks(small + meetings)), "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(lean(_compared(threshold, listed)), schema)
    return members, scratch.save(found)


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id_a, doc_id_b (the greater) and jaccard of similar documents, pair by pair; linked() says the same without a row for each pair.

    Documents with equal sets are tied: the one of the least doc_id stands for
    them. It has a row with each of the others (jaccard 1) and is the one that the
    rows of near sets name, so that copies add rows in proportion to their number.
    Rows without a doc_id, a text or any word have no set and no part in the
    result; of rows of one doc_id with different sets, that of the least hash
    counts. Repeated rows count once. A text of fewer than n words is a single
    gram; long texts count whole. Other columns are ignored, and an empty table
    gives no rows. Every pair at or above the threshold is found, and values are exact.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    members, pairs = similar(docs, scratch, n, threshold, True)
    equal = members.where("id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), F.round("value", 6).alias("jaccard")).unionByName(equal)


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and links of every distinct doc_id.

    links is the number of other documents at or above the threshold, exact copies
    among them; class_id is the least doc_id that such links lead to. Both are exact. A document
    without a text or any word is a class of its own without links. A null doc_id is left out; of rows
    of one doc_id with different sets, that of the least hash counts. Repeated rows count once, a text of fewer than n
    words is a single gram, and long texts count whole. Other columns are ignored, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngram-classes")
    members, found = similar(docs, scratch, n, threshold, False)
    classes = scratch.save(components(found.select("a", "b"), scratch))
    near = found.groupBy("b").agg(F.sum("value").cast("long").alias("near"))
    of = members.join(near, F.col("rep") == F.col("b"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    links = F.coalesce("near", F.lit(0)) + F.col("copies") - 1
    of = of.select("id", F.coalesce("component", "rep").alias("class"), links.alias("n"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = ids.join(of, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("links"))


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keep_id) of the documents that have a near duplicate; keep_id is the least doc_id of the group."""
    scratch = Scratch(docs.sparkSession, "ngram-groups")
    return scratch.save(linked(docs, n, threshold).where("links > 0").select("doc_id", F.col("class_id").alias("keep_id")))


def dedupe(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs less those whose group keeps another doc_id.

    Rows without a doc_id stay; rows of one doc_id stay or go together.
    """
    drop = groups(docs, n, threshold).where("doc_id <> keep_id").select(F.col("doc_id").alias("__drop_id"))
    return docs.join(broadcast_if_small(drop, drop.count(), 16), F.col("doc_id").cast("long") == F.col("__drop_id"), "left_anti")
