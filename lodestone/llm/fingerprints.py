"""Document fingerprints from content-defined chunks.

A text (lower case, white space folded) is cut where the gear hash of the last
bytes has enough leading zeros: more of them before the normal size, fewer
after it, so that chunk sizes lie close together. Boundaries follow the content,
so that an insertion changes the chunks around it only. Fingerprints are made of
FINE chunks of about five words, whose boundaries hang on four bytes, so that a near copy
with an edit every few words still shares most of them. A document's fingerprint
is the set of its chunk digests, weighted by chunk length; a chunk that returns
has another digest each time, so that a line said ten times isn't contained in
a text that says it once. The containment of A in B is the weight of A's
chunks that B has too over the weight of all of A's.

Two documents match where one is contained in the other to CONTAINED, or to NEAR
and is no small part of it, COVERED at least: a short text that happens to have a common line is no near copy of
every text with that line. Matches are found exactly: two of them share one of the
rarest chunks, those that together outweigh what may be lacking, of one document
or of both. Documents with equal fingerprints are one class.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, Scratch, broadcast_if_small, column, components, lean, list_array, slices, stars

LEAST, NORMAL, MOST = 128, 512, 2048
#: Leading zero bits that a cut needs before and after the normal size.
HARD, EASY = 11, 7
#: Least, normal and most bytes, leading zero bits before and after the normal size, and bytes hashed, of a fingerprint's chunks.
FINE = (8, 24, 96, 6, 3, 4)
#: Near copies with word-trigram Jaccard from 0.5 reach the latter two; see the README for how many.
CONTAINED, NEAR, COVERED = 0.8, 0.4, 0.3
#: Shares of the digests that go to their counts one after the other, so that only one share lies on disk at a time; each cuts the texts anew.
PASSES = 2
COLUMNS = ["contained_id", "container_id", "containment", "coverage"]
COUNTED = ["fingerprint", "root", "name", "n"]
#: Fingerprints, and about how many digests of them, that make a block; two blocks are compared at once.
BLOCK, LOAD = 3000, 1 << 20
#: Bits of a cell that number the block of its room.
BLOCK_BITS = 20
#: Times that labels go to the chunks and back.
ROUNDS = 2
#: Shared digests and cells that a task holds at once to compare sets.
MEETINGS = 1 << 20
#: How many times the digests of all sets lie on disk at once while they are compared.
SPREAD = 3
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
GEAR[0] = 0
PAD = 32


#: The low bits of a digest, which hold its chunk's size less 1.
SIZE_BITS = 7


def gear(data: np.ndarray, last: int = 32) -> np.ndarray:
    """The gear hash at every byte: the sum of GEAR of the last bytes (a power of 2 of them), each shifted by its distance."""
    h, s = GEAR[data], 1
    while s < last:
        low = h[:-s] << np.uint32(s)
        h[s:] += low
        s *= 2
    return h


def normal(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"\s+", " "))


def chunks(texts: list[bytes], sizes: tuple[int, ...] = (LEAST, NORMAL, MOST, HARD, EASY, PAD)) -> tuple[np.ndarray, list[bytes]]:
    """(chunks of each text, all chunks)."""
    least, usual, most, strict, loose, last = sizes
    joined = b"\0" * PAD + (b"\0" * PAD).join(texts)
    h = gear(np.frombuffer(joined, dtype=np.uint8), last)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - loose)))
    hard = easy[h[easy] < np.uint32(1 << (32 - strict))].tolist()
    easy = easy.tolist()
    counts, out, at = np.zeros(len(texts), dtype=np.int64), [], PAD
    for i, text in enumerate(texts):
        s, end, before = at, at + len(text), len(out)
        while s < end:
            cut = min(s + most, end)
            if end - s > least:
                k = bisect_left(hard, s + least)
                if k < len(hard) and hard[k] < min(s + usual, end):
                    cut = hard[k] + 1
                else:
                    k = bisect_left(easy, s + usual)
                    if k < len(easy) and easy[k] < cut:
                        cut = easy[k] + 1
            out.append(joined[s:cut])
            s = cut
        counts[i] = len(out) - before
        at = end + PAD
    return counts, out


def numbered(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The digests, in order of (doc, digest), with the bits above the size changed where the digest stood before."""
    new = np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])) if len(keys) else np.zeros(0, bool)
    at = np.arange(len(keys))
    times = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    changed = keys.view(np.uint64) ^ (times * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS))
    return changed.view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            texts = [x or b"" for x in normal(column(batch, "text")).cast(pa.binary()).to_pylist()]
            counts, parts = chunks(texts, FINE)
            sizes = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
            keys = np.fromiter(map(digest, parts), dtype=np.uint64, count=len(parts))
            keys = (keys >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS) | (sizes - 1).astype(np.uint64)).view(np.int64)
            doc = np.repeat(np.arange(len(texts)), counts)
            order = np.lexsort((keys, doc))
            keys, sizes, doc = keys[order], sizes[order], doc[order]
            keys = numbered(doc, keys)
            order = np.lexsort((keys, doc))
            keys, sizes, doc = keys[order], sizes[order], doc[order]
            n = np.bincount(doc, minlength=len(texts))
            ends = np.cumsum(n)
            own = np.array([digest(keys[e - c : e].tobytes(), seed=1) for e, c in zip(ends, n)], dtype=np.uint64).view(np.int64)
            weight = np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(own), pa.array(weight), list_array(keys, n, pa.int64()), list_array(sizes, n, pa.int32())],
                names=["doc_id", "fingerprint", "weight", "digests", "sizes"],
            )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (of the set), weight, digests and sizes of every row with a text; an empty text has no chunk. A digest's lowest SIZE_BITS hold the chunk's size less 1."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return base.mapInArrow(lean(_fingerprints), "doc_id long, fingerprint long, weight long, digests array<long>, sizes array<int>")


def _overlaps(keys: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, weight of the common digests) of each set i that shares any with a set j of the others. Both are runs of digests, and how many each set has."""
    kinds, kind = np.unique(others, return_inverse=True)
    holder = np.repeat(np.arange(len(other_sizes)), other_sizes)[np.argsort(kind, kind="stable")]
    n = np.bincount(kind, minlength=len(kinds))
    starts = np.cumsum(n) - n
    at = np.minimum(np.searchsorted(kinds, keys), len(kinds) - 1)
    held = np.flatnonzero(kinds[at] == keys)
    owner, at, weight = np.repeat(np.arange(len(sizes)), sizes)[held], at[held], (keys[held] & ((1 << SIZE_BITS) - 1)) + 1
    first = np.searchsorted(owner, np.arange(len(sizes) + 1))
    upto, width, s = np.append(0, np.cumsum(n[at]))[first], len(other_sizes), 0
    while s < len(sizes):
        e = max(min(np.searchsorted(upto, upto[s] + MEETINGS, side="right") - 1, s + MEETINGS // width, len(sizes)), s + 1)
        own = slice(first[s], first[e])
        times = n[at[own]]
        met = holder[np.repeat(starts[at[own]] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        common = np.bincount(np.repeat(owner[own] - s, times) * width + met, weights=np.repeat(weight[own], times))
        some = np.flatnonzero(common)
        yield some // width + s, some % width, common[some].astype(np.int64)
        s = e


def _common(contained: float, near: float, covered: float, listed: bool):
    """Over the sets of one cell, those of its blocks against each other and the visitors against the block: the matches by their names, the one that is contained more first; unless listed, each fingerprint that has any, a name that they lead to, its own and the number of documents matched."""

    def run(key: tuple, sets: pd.DataFrame) -> pd.DataFrame:
        weight, name, copies = (sets[c].to_numpy() for c in ("weight", "name", "copies"))
        part, digests = sets["part"].to_numpy(), sets["digests"].to_numpy()
        out, n = [], np.zeros(len(sets), dtype=np.int64)
        one, two, guests = (np.flatnonzero(part == k) for k in range(3))
        room, i, j, slot = key
        within = [(one, two)] if i != j else [(one, one)] if slot == 0 else []
        for left, right in (*within, (guests, one)):
            if not len(left) or not len(right):
                continue
            lists = [[np.asarray(digests[k]) for k in side] for side in (left, right)]
            flat = [(np.concatenate(x), np.array([len(y) for y in x])) for x in lists]
            for i, j, common in _overlaps(*flat[0], *flat[1]):
                i, j = left[i], right[j]
                first = (weight[i] < weight[j]) | (weight[i] == weight[j]) & (name[i] < name[j])
                x, y = np.where(first, i, j), np.where(first, j, i)
                p, q = common / weight[x], common / weight[y]
                good = ((p >= contained) | (p >= near) & (q >= covered)) & (name[x] != name[y])
                if left is right:
                    good &= i < j
                x, y, p, q = x[good], y[good], p[good], q[good]
                np.add.at(n, x, copies[y])
                np.add.at(n, y, copies[x])
                if listed:
                    out += [(*both, *v) for both, v in zip(np.column_stack([name[x], name[y]]).tolist(), np.column_stack([p, q]).round(6).tolist())]
                elif len(x):
                    tree = stars(name[x], name[y])
                    out.append(np.column_stack([column(tree, "u").to_numpy(), column(tree, "v").to_numpy()]))
        if listed:
            return pd.DataFrame(out, columns=COLUMNS)
        edges = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
        tree = stars(edges[:, 0], edges[:, 1]) if len(edges) else None
        root = dict(zip(column(tree, "u").to_pylist(), column(tree, "v").to_pylist())) if tree else {}
        some = np.flatnonzero(n)
        return pd.DataFrame({"fingerprint": sets["id"].to_numpy()[some], "root": [root.get(x, x) for x in name[some].tolist()], "name": name[some], "n": n[some]}, columns=COUNTED)

    return run


def matches(docs: DataFrame, scratch: Scratch, contained: float, near: float, covered: float, listed: bool) -> tuple[DataFrame, DataFrame]:
    """(fingerprint, weight, ids) of all classes, and what _common() says of them."""
    # cutting again for each share costs less disk than keeping every chunk until the shared ones are known
    prints = fingerprint(docs.where("doc_id is not null")).where("weight > 0")
    classes = scratch.save(prints.groupBy("fingerprint").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_set("doc_id")).alias("ids")))
    same = Window.partitionBy("digest")
    rows = prints.select("fingerprint", F.explode("digests").alias("digest"))
    # a chunk that no other document has is never a way to another; it only uses up what may be lacking
    shared = []
    for share in range(PASSES):
        own = rows.where(F.pmod(F.shiftright("digest", SIZE_BITS), F.lit(PASSES)) == share)
        several = own.select("*", F.min("fingerprint").over(same).alias("low"), F.max("fingerprint").over(same).alias("high")).where("low <> high").select("digest", "fingerprint").distinct()
        shared.append(scratch.save(several.withColumn("df", F.count("*").over(same))))
    common = reduce(DataFrame.union, shared)
    weighed = common.withColumn("size", F.col("digest").bitwiseAND((1 << SIZE_BITS) - 1) + 1).join(classes.select("fingerprint", "weight", F.element_at("ids", 1).alias("name"), F.size("ids").alias("copies")), "fingerprint")
    lacking = F.col("weight") - F.sum("size").over(Window.partitionBy("fingerprint"))
    rarest = Window.partitionBy("fingerprint").orderBy("df", "digest")
    before = lacking + F.sum("size").over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    ordered = weighed.select("digest", "fingerprint", "weight", "name", "copies", before.alias("before"), F.lag("digest").over(rarest).alias("rarer"))
    # the windows have put each document's chunks together, so that gathering them shuffles nothing
    chunks = F.collect_list(F.struct("digest", "before", "rarer")).alias("chunks")
    prefixes = scratch.save(ordered.groupBy("fingerprint").agg(F.first("weight").alias("weight"), F.first("name").alias("name"), F.first("copies").alias("copies"), chunks))
    scratch.drop(*shared)
    sets, rooms = placed(prefixes, scratch, min(contained, near, covered))
    scratch.drop(prefixes)
    ranked = sets.select("fingerprint", "weight", "cell", F.inline("chunks"))
    side = lambda c: [F.col("fingerprint").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("weight", "before", "rarer", "cell"))]
    enough = lambda least: F.col("before") <= (1 - least) * F.col("weight") + 1e-6
    leading = ranked.where(enough(min(contained, near, covered)))
    a, b = leading.select("digest", *side("a")), leading.select("digest", *side("b"))
    # what the two share from this chunk on has to reach what a match shares at least
    needed = F.greatest(near * F.least("a_weight", "b_weight"), covered * F.greatest("a_weight", "b_weight")) - 1e-6
    able = lambda c: F.col(f"{c}_weight") - F.col(f"{c}_before") >= needed
    # two that also share the next rarer chunk have met there
    met = F.coalesce(F.col("a_rarer") == F.col("b_rarer"), F.lit(False))
    # two of one room are compared there anyway; of others the one of the smaller room visits the block of the other
    room = lambda c: F.shiftright(f"{c}_cell", BLOCK_BITS)
    guest = F.when(room("a") < room("b"), F.col("a")).otherwise(F.col("b"))
    visit = [guest.alias("guest"), F.greatest("a_cell", "b_cell").alias("cell")]
    apart = room("a") != room("b")
    mutual = a.join(b, "digest").where(F.col("a") < F.col("b")).where(able("a") & able("b") & ~met & apart).select(*visit)
    part = scratch.save(ranked.where(enough(contained)).select("digest", *side("a")))
    ways = part.select("digest").distinct()
    n = ways.count()
    # where few chunks lead, the others needn't be shuffled
    whole = (ranked.join(F.broadcast(ways), "digest", "left_semi") if n * 16 <= BROADCAST_BYTES else ranked).select("digest", *side("b"))
    # what leads on both sides has been joined above
    leads = (F.col("b_before") <= (1 - min(contained, near, covered)) * F.col("b_weight") + 1e-6) & able("a") & able("b")
    fits = (F.col("a") != F.col("b")) & (F.col("b_weight") >= F.col("a_weight")) & ~met & ~leads
    inside = part.join(whole, "digest").where(fits & apart).select(*visit)
    visits = scratch.save(mutual.union(inside).distinct())
    kinds = zip(COLUMNS, ("long", "long", "double", "double")) if listed else zip(COUNTED, ("long",) * 4)
    return classes, compared(sets, rooms, visits, scratch, _common(contained, near, covered, listed), ", ".join(f"{c} {k}" for c, k in kinds))


def placed(prefixes: DataFrame, scratch: Scratch, least: float) -> tuple[DataFrame, DataFrame]:
    """prefixes with the cell, a room and a block of it, that each lives in, and (room, blocks) of all rooms; larger rooms have higher numbers.

    Fingerprints with much in common shall share a room, so that their pairs need no listing: each takes the label
    that most of its leading chunks have, and these the one that most of their holders have. Labels that few
    have share rooms. Any other choice would give the same matches. A fingerprint without leading chunks has cell 0.
    """
    led = F.filter("chunks", lambda c: c["before"] <= (1 - least) * F.col("weight") + 1e-6)
    digests = prefixes.select("fingerprint", F.transform(led, lambda c: c["digest"]).alias("d"))
    said = digests.select("fingerprint", F.array_min(F.transform("d", lambda x: F.xxhash64(x))).alias("label"), F.explode("d").alias("digest"))
    for _ in range(ROUNDS):
        heard = said.withColumn("label", F.mode("label").over(Window.partitionBy("digest")))
        before, said = said, scratch.save(heard.withColumn("label", F.mode("label").over(Window.partitionBy("fingerprint"))))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    own = scratch.save(said.groupBy("fingerprint").agg(F.first("label").alias("label")))
    scratch.drop(said)
    held = F.count("*").over(Window.partitionBy("label"))
    shared = F.pmod(F.xxhash64("label"), F.lit(own.count() // BLOCK + 1))
    homes = own.withColumn("m", held).select("fingerprint", F.when(F.col("m") * 2 > BLOCK, F.col("label")).otherwise(shared).alias("home"))
    sets = scratch.save(prefixes.join(homes, "fingerprint", "left"))
    scratch.drop(own)
    sized = sets.where("home is not null").groupBy("home").agg(F.count("*").alias("m"), F.sum(F.size("chunks")).alias("load"))
    rooms = sized.select("home", F.row_number().over(Window.orderBy("m", "home")).cast("long").alias("room"), F.ceil(F.greatest(F.col("m") / BLOCK, F.col("load") / LOAD)).cast("int").alias("blocks"))
    rooms = scratch.save(rooms)
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    cell = F.coalesce(F.shiftleft("room", BLOCK_BITS) + block, F.lit(0))
    return sets.join(broadcast_if_small(rooms, rooms.count(), 40), "home", "left").select(*prefixes.columns, cell.alias("cell")), rooms.drop("home")


def compared(sets: DataFrame, rooms: DataFrame, visits: DataFrame, scratch: Scratch, run, schema: str) -> DataFrame:
    """run() over each two blocks of a room, and over the guests of each block, so many at a time; a share of all this lies on disk at once."""
    called = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots"))
    called, rooms = (broadcast_if_small(x, x.count(), 32) for x in (scratch.save(called), rooms))
    room, block = F.shiftright("cell", BLOCK_BITS), F.col("cell").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    own = sets.select(F.col("fingerprint").alias("id"), "weight", "name", "copies", F.array_sort("chunks.digest").alias("digests"), "cell")
    living = own.where("cell > 0").withColumn("room", room).join(rooms, "room").join(called, "cell", "left")
    living = living.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block", block)
    more = F.when(F.col("other") == F.col("block"), F.coalesce("slots", F.lit(1))).otherwise(1)
    living = living.withColumn("slot", F.explode(F.sequence(F.lit(0), more - 1)))
    i, j = F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j")
    keep = ["id", "weight", "name", "copies", "digests"]
    living = living.select("room", i, j, "slot", *keep, (F.col("block") > F.col("other")).cast("int").alias("part"))
    calls = visits.join(called, "cell").select(F.col("guest").alias("id"), room.alias("room"), block.alias("i"), block.alias("j"), F.pmod(F.xxhash64("guest"), F.col("slots")).cast("int").alias("slot"))
    guests = own.select(*keep).join(calls, "id").select("room", "i", "j", "slot", *keep, F.lit(2).alias("part"))
    keys = ["room", "i", "j", "slot"]
    out = living.unionByName(guests)
    size = F.sum(F.size("digests"))
    whole, spread = (x.agg(size).first()[0] or 0 for x in (own, out))
    shares = max(1, -(-spread // max(SPREAD * whole, LOAD)))
    each = [out.where(F.pmod(F.xxhash64(*keys), F.lit(shares)) == k).groupBy(*keys).applyInPandas(run, schema) for k in range(shares)]
    return each[0] if shares == 1 else reduce(DataFrame.union, [scratch.save(x) for x in each])


def containment(docs: DataFrame, contained: float = CONTAINED, near: float = NEAR, covered: float = COVERED) -> DataFrame:
    """contained_id, container_id, containment (of the first in the second) and coverage (of the second by the first) of documents that match.

    The first weighs no more than the second. Of documents with equal
    fingerprints the one of the least doc_id stands for them: it has a row as
    container of each of the others (1 and 1), and is the one that all other rows name. Rows
    without a doc_id, a text or any chunk have no part in the result; of rows of one
    doc_id each fingerprint counts once, and a doc_id never matches itself. Long
    texts count whole. Other columns are ignored, and an empty table gives no rows. linked() says the same without a row for each pair.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    classes, found = matches(docs, scratch, contained, near, covered, True)
    one = F.lit(1.0)
    own = classes.select(F.element_at("ids", 1).alias("container_id"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("contained_id"), one.alias("containment"), one.alias("coverage"))
    return scratch.save(found.unionByName(own.select(*COLUMNS)))


def linked(docs: DataFrame, contained: float = CONTAINED, near: float = NEAR, covered: float = COVERED) -> DataFrame:
    """doc_id, class_id and links of every distinct doc_id, by the matches that containment() lists.

    links is the number of other documents that it matches, either way round, and of those with an equal
    fingerprint; where rows of one doc_id have several fingerprints, the matches of each are added. class_id
    is the least doc_id that matches lead to. A document without a text or any chunk is a class of its own without
    links. A null doc_id is left out, other columns are ignored, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint-classes")
    classes, found = matches(docs, scratch, contained, near, covered, False)
    found = scratch.save(found)
    each = classes.select("fingerprint", F.element_at("ids", 1).alias("first"), F.size("ids").alias("copies"), F.explode("ids").alias("id"))
    edges = found.select(F.col("root").alias("a"), F.col("name").alias("b")).union(each.where("id <> first").select("first", "id"))
    groups = components(edges, scratch)
    near_of = found.groupBy("fingerprint").agg(F.sum("n").alias("n"))
    links = each.join(near_of, "fingerprint", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = ids.join(groups, F.col("doc_id") == F.col("node"), "left").join(links, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
