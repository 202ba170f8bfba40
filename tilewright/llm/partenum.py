"""Exact n-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct 5-word shingles. Sets of Jaccard likeness 0.75 or more differ
in at most a seventh of their summed sizes, so a document of size s and any partner differ in at most
k(s) shingles. Sizes are cut into bands; in a band the domain of shingles is partitioned into n parts
by hash. Of a set's non-empty parts at most k differ from a partner's, so of any k + 1 of them, taken
in one order for all documents, one part is shared whole: its content is a signature that both have.
A document near the top of its band has signatures for the next band as well.

Shingles found very often are left out of the parts first, so that passages which many documents
share make no signatures; this keeps the bound as long as more than k parts hold other shingles. A
document with too few of those has all the signatures that it can have without them, and those of
its whole set too; if even that has too few parts, its single shingles are signatures. Two documents
that link always meet in one of these ways, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.naming import text_key, unused
from tilewright.llm.scratch import small_batches, written
from tilewright.llm.textbytes import BASE, mixed, runs, shingles, summed, words

SHINGLE_WORDS = 5
BAND = 4  # a band holds sizes from BAND^i to BAND^(i+1) - 1
LEAST_PARTS = 64
HASH_BYTES = 6
#: Shingles that so many documents have, and so many of them at most, make no signatures. This steers work only, never results.
FREQUENT, MAX_FREQUENT = 8, 200_000
LOCAL_FREQUENT, LOCAL_KEPT = 2, 20_000
#: Least bits of the odd sketch that stands for a set until its cluster shows that a link is possible; it has two bits a member or more.
LEAST_BITS = 256
#: Clusters are compared in blocks of about so many sets.
BLOCK = 256
#: Columns of a matrix of members at once, and how many of its cells' products cost as much as one search. They steer work only, never results.
COLUMNS, SEARCH_COST = 4_096, 200
#: A table of set ids is broadcast up to so many rows.
BROADCAST_ROWS = 2_000_000


def largest_partner(s: np.ndarray) -> np.ndarray:
    return s * 4 // 3


def band_of(s: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([BAND**i for i in range(1, 31)], np.int64), s, "right")


def parts_of(band: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_PARTS, 2 * BAND ** band.astype(np.int64))


def pack(h: np.ndarray) -> np.ndarray:
    """The low 6 bytes of each hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASH_BYTES] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's odd sketch: a power of two, at least twice its size."""
    return np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64))


def odd_sketches(row: np.ndarray, h: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of hash counts in ``bits`` cells (by row), as bytes end to end, and where each row's begin.

    Two sketches of one width differ in no more cells than their sets do in members; a sketch of twice
    the width becomes one of half by adding its halves.
    """
    first = np.concatenate(([0], np.cumsum(bits)))
    at = first[row] + (mixed(h) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=first[-1]).astype(np.uint8) & 1), first // 8


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (128 bits of the text), node (a hash of the whole set; null if empty), n, members (packed hashes) and sketch (both once per node and task), and rows of frequent shingles (node null, n -1, members, times)."""
    small_batches(docs.sparkSession)
    mask = np.uint64((1 << 8 * HASH_BYTES) - 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pending, pending_n, often = [], 0, {}

        def count():
            nonlocal pending, pending_n
            if pending:
                u, c = np.unique(np.concatenate(pending), return_counts=True)
                for x, k in zip(u[c >= LOCAL_FREQUENT].tolist(), c[c >= LOCAL_FREQUENT].tolist(), strict=True):
                    often[x] = often.get(x, 0) + k
                if len(often) > 4 * LOCAL_KEPT:
                    for x in sorted(often, key=often.get)[: len(often) - LOCAL_KEPT]:
                        del often[x]
            pending, pending_n = [], 0

        for batch in batches:
            ids, keys, texts = batch.column("doc_id"), batch.column("key"), batch.column("text")
            for at, data, offsets in runs(texts):
                rows = len(offsets) - 1
                row, h = words(data, offsets)
                row, h = shingles(row, h, SHINGLE_WORDS, rows)
                n = np.bincount(row, minlength=rows)
                first = np.concatenate(([0], np.cumsum(n)))
                full = np.flatnonzero(n)
                node = mixed(summed(mixed(h), first[full]) + n[full].astype(np.uint64) * BASE).view(np.int64)
                h &= mask
                packed, (odd, odd_at) = pack(h), odd_sketches(row, h, sketch_bits(n))
                members: list[bytes | None] = [None] * rows
                sketches: list[bytes | None] = [None] * rows
                nodes: list[int | None] = [None] * rows
                for i, x in zip(full.tolist(), node.tolist(), strict=True):
                    nodes[i] = x
                    if x not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(x)
                        members[i] = packed[first[i] : first[i + 1]].tobytes()
                        sketches[i] = odd[odd_at[i] : odd_at[i + 1]].tobytes()
                        pending.append(h[first[i] : first[i + 1]])
                        pending_n += first[i + 1] - first[i]
                if pending_n > 500_000:
                    count()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, rows), keys.slice(at, rows), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), pa.array(members, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(rows, pa.list_(pa.int64()))],
                    ["doc_id", "key", "node", "n", "members", "sketch", "times"],
                )
        count()
        top = sorted(often, key=often.get, reverse=True)[:LOCAL_KEPT]
        if top:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([pack(np.array(top, np.uint64)).tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([[often[x] for x in top]], pa.list_(pa.int64()))],
                ["doc_id", "key", "node", "n", "members", "sketch", "times"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind_type = to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, node bigint, n bigint, members binary, sketch binary, times array<bigint>")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """Hashes of frequent shingles, MAX_FREQUENT at most, sorted."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, t in zip(b.column("members"), b.column("times"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(m.as_py()).view(np.int64)), t.values], ["h", "n"])

    counts = sets.filter("n = -1").select("members", "times").mapInArrow(spread, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    return np.sort(top.column("h").to_numpy()).astype(np.uint64)


def part_signatures(at: np.ndarray, h: np.ndarray, n: np.ndarray, salt: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of the first ``limit`` non-empty parts of each row, and the number of non-empty parts of each row.

    at, h: rows and members. n, salt, limit: by row.
    """
    part = (mixed(h ^ salt[at]) >> np.uint64(11)) % n[at].astype(np.uint64)
    key = (at.astype(np.uint64) << np.uint64(36)) | part
    order = np.argsort(key, kind="stable")
    key, inner = key[order], mixed(h[order] + BASE)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    row = at[order][starts]
    nth = np.arange(len(starts)) - np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n)))))[row]
    sig = mixed(summed(inner, starts) ^ mixed((key[starts] & np.uint64((1 << 36) - 1)) + salt[row]))
    use = nth < limit[row]
    return row[use], sig[use], np.bincount(row, minlength=len(n))


def signatures_of(sizes: np.ndarray, at: np.ndarray, h: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of sets given by their sizes and members (rows ascending)."""
    rows_out, sigs_out = [], []
    first = np.concatenate(([0], np.cumsum(sizes)))
    light = np.ones(len(h), bool)
    if len(often):
        place = np.minimum(np.searchsorted(often, h), len(often) - 1)
        light = often[place] != h
    band = band_of(sizes)
    for up in (0, 1):
        has = np.flatnonzero((sizes > 0) & ((largest_partner(sizes) >= BAND ** (band + 1)) | (up == 0)))
        if not len(has):
            continue
        s, level = sizes[has], band[has] + up
        partner = np.minimum(largest_partner(s), BAND ** (level + 1) - 1)
        k = (s + partner) // 7
        new_row = np.full(len(sizes), -1)
        new_row[has] = np.arange(len(has))
        mine = new_row[at] >= 0
        a, x, li = new_row[at[mine]], h[mine], light[mine]
        salt = mixed(level.astype(np.uint64) + np.uint64(1))
        r, g, full = part_signatures(a[li], x[li], parts_of(level), salt, k + 1)
        rows_out.append(has[r])
        sigs_out.append(g)
        few = full <= k
        if few.any():
            m = few[a]
            r, g, full2 = part_signatures(a[m], x[m], parts_of(level), mixed(salt + np.uint64(7)), np.where(few, k + 1, 0))
            rows_out.append(has[r])
            sigs_out.append(g)
            fewer = few & (full2 <= k)
            m = fewer[a]
            if m.any():
                rows_out.append(has[a[m]])
                sigs_out.append(mixed(x[m] ^ mixed(salt[a[m]] + np.uint64(13))))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(sigs_out)


def signatures(sets: DataFrame, often: np.ndarray) -> DataFrame:
    """sig, node of every set."""
    shared = sets.sparkSession.sparkContext.broadcast(often)  # MAX_FREQUENT hashes at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for at, data, offsets in runs(batch.column("members")):
                sizes = np.diff(offsets) // HASH_BYTES
                row, sig = signatures_of(sizes, np.repeat(np.arange(len(sizes)), sizes), unpack(data.tobytes()), shared.value)
                own = nodes[at : at + len(sizes)][row]
                for i in range(0, len(row), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[i : i + 100_000].view(np.int64)), pa.array(own[i : i + 100_000])], ["sig", "node"])

    return sets.filter("members IS NOT NULL AND n > 0").select("node", "members").mapInArrow(emit, "sig bigint, node bigint")


def clusters(sigs: DataFrame) -> DataFrame:
    """center, node: of the nodes that share a signature, the least is the center of all (itself too). Signatures of one node are left out.

    Spark sorts the signatures, so a task reads them in order and holds one batch, however often one occurs.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            # The signature that the last batch ended with goes on with its center.
            s = np.concatenate((s, b.column("sig").to_numpy(zero_copy_only=False)))
            n = np.concatenate((n, b.column("node").to_numpy(zero_copy_only=False)))
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
            s, n = s[new], n[new]
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            count = np.diff(np.append(starts, len(s)))
            several = np.repeat(count > 1, count)
            pairs = np.unique(np.stack((np.repeat(n[starts], count)[several], n[several])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["center", "node"])
            s, n = s[starts[-1:]], n[starts[-1:]]

    return sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(gather, "center bigint, node bigint").distinct()


class Joined:
    """Union-find over the rows of one group."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def label(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, x: int, others: np.ndarray) -> None:
        label = self.label()
        self.parent = np.where(np.isin(label, label[others]), label[x], label)


def shared_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many members the two sets of each pair (x, y) share. Many pairs go through products of 0/1 matrices, few by search."""
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    values, col = np.unique(flat, return_inverse=True)
    several = np.bincount(col) > 1
    if len(sets) ** 2 * int(several.sum()) < SEARCH_COST * int(size[pairs[1]].sum()):
        place, use = np.cumsum(several) - 1, several[col]
        row, col = row[use], place[col[use]]
        order = np.argsort(col, kind="stable")
        row, col, both = row[order], col[order], np.zeros((len(sets), len(sets)), np.int64)
        for at in range(0, int(several.sum()), COLUMNS):
            lo, hi = np.searchsorted(col, (at, at + COLUMNS))
            has = np.zeros((len(sets), COLUMNS), np.float32)  # counts of COLUMNS at most are exact
            has[row[lo:hi], col[lo:hi] - at] = 1
            both += (has @ has.T).astype(np.int64)
        return both[pairs[0], pairs[1]]
    first = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(pairs.shape[1], np.int64)
    starts = np.flatnonzero(np.concatenate(([True], pairs[0][1:] != pairs[0][:-1]))) if len(out) else ()
    for lo, hi in zip(starts, [*starts[1:], len(out)], strict=True):
        x, rest = pairs[0][lo], pairs[1][lo:hi]
        k = size[rest]
        at = np.repeat(first[rest], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        place = np.minimum(np.searchsorted(sets[x], flat[at]), size[x] - 1)
        out[lo:hi] = np.add.reduceat((sets[x][place] == flat[at]).astype(np.int64), np.cumsum(k) - k)
    return out


def links_in(node: np.ndarray, block: np.ndarray, sets: list[np.ndarray], lesser: list[list[int]], crossing: bool, numerator: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join what links join in a group, and how many links each set has of those that the group owns.

    Every pair is looked at (only across blocks, if crossing). Sizes and odd sketches (parities of hash
    counts, which differ in no more places than the sets) rule pairs out; the rest are intersected.
    lesser: the lesser centers of each set's clusters; a pair that shares one of them is counted there.
    """
    size = np.array([len(x) for x in sets])
    width = int(sketch_bits(size).max())
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    sketch = odd_sketches(row, flat, np.full(len(sets), width))[0].view(np.uint64).reshape(len(sets), -1) if len(sets) > 2 else None
    pairs = []
    for x in range(len(sets) - 1):
        rest = np.arange(x + 1, len(sets))
        rest = rest[100 * np.minimum(size[rest], size[x]) >= numerator * np.maximum(size[rest], size[x])]
        if crossing:
            rest = rest[block[rest] != block[x]]
        if len(rest) and sketch is not None:
            rest = rest[np.bitwise_count(sketch[rest] ^ sketch[x]).sum(1) * (100 + numerator) <= (100 - numerator) * (size[rest] + size[x])]
        pairs.append(np.stack((np.full(len(rest), x), rest)))
    pairs = np.concatenate(pairs, 1)
    inter = shared_counts(sets, pairs) if pairs.shape[1] else np.zeros(0, np.int64)
    pairs = pairs[:, 100 * inter >= numerator * (size[pairs[0]] + size[pairs[1]] - inter)]
    may = np.array([len(x) > 0 for x in lesser])[pairs].all(0)
    if may.any():
        again = np.zeros(len(may), bool)
        again[may] = shared_counts([np.array(sorted(x), np.int64) for x in lesser], pairs[:, may]) > 0
        pairs = pairs[:, ~again]
    joined, found = Joined(len(sets)), []
    for x in np.unique(pairs[0]).tolist():
        hit, label = pairs[1][pairs[0] == x], joined.label()
        hit = hit[label[hit] != label[x]]
        if len(hit):
            found += [(int(node[x]), int(node[y])) for y in hit]
            joined.join(x, hit)
    return found, np.bincount(pairs.ravel(), minlength=len(sets))


def joining_links(node: np.ndarray, block: np.ndarray, sets: list[np.ndarray], crossing: bool, numerator: int) -> list[tuple[int, int]]:
    """Links that join what links join in a group: each set is compared only with those that no link leads to yet, so a group of copies of one text takes about one comparison a set."""
    size = np.array([len(x) for x in sets])
    width = int(sketch_bits(size).max())
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    first = np.concatenate(([0], np.cumsum(size)))
    sketch = odd_sketches(row, flat, np.full(len(sets), width))[0].view(np.uint64).reshape(len(sets), -1) if len(sets) > 2 else None
    joined, found = Joined(len(sets)), []
    for x in range(len(sets) - 1):
        label = joined.label()
        rest = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        rest = rest[100 * np.minimum(size[rest], size[x]) >= numerator * np.maximum(size[rest], size[x])]
        if crossing:
            rest = rest[block[rest] != block[x]]
        if len(rest) and sketch is not None:
            rest = rest[np.bitwise_count(sketch[rest] ^ sketch[x]).sum(1) * (100 + numerator) <= (100 - numerator) * (size[rest] + size[x])]
        if not len(rest):
            continue
        k = size[rest]
        at = np.repeat(first[rest], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        place = np.minimum(np.searchsorted(sets[x], flat[at]), size[x] - 1)
        inter = np.add.reduceat((sets[x][place] == flat[at]).astype(np.int64), np.cumsum(k) - k)
        hit = rest[100 * inter >= numerator * (size[rest] + size[x] - inter)]
        if len(hit):
            found += [(int(node[x]), int(node[y])) for y in hit]
            joined.join(x, hit)
    return found


def dealt(near: DataFrame, blocks: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of clusters (center, node) with what is held of each node, dealt to pairs of blocks (center, i, j) in order."""
    rows = near.join(blocks, "center").join(held, "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("center", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *held.columns)
    return rows.repartition("center", "i", "j").sortWithinPartitions("center", "i", "j", "node")


def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int, int], list[list]]]:
    """(center, i, j) and the columns of each group with more than one row."""
    key, held = None, []
    for batch in batches:
        data = batch.to_pydict()
        keys = list(zip(data["center"], data["i"], data["j"], strict=True))
        rows = list(zip(*(data[c] for c in columns), strict=True))
        for k, r in zip(keys, rows, strict=True):
            if k != key:
                if len(held) > 1:
                    yield key, [list(c) for c in zip(*held, strict=True)]
                key, held = k, []
            held.append(r)
    if len(held) > 1:
        yield key, [list(c) for c in zip(*held, strict=True)]


def blocks_of(near: DataFrame) -> DataFrame:
    return near.groupBy("center").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("m")).filter("m > 1").drop("m")


def fold(sketch: bytes, width: int) -> np.ndarray:
    """A sketch of ``width`` bytes, or one twice as long halved to it, as 64-bit words."""
    x = np.frombuffer(sketch, np.uint64)
    return x if len(sketch) == width else x[: len(x) // 2] ^ x[len(x) // 2 :]


def hopeful(near: DataFrame, sets: DataFrame, numerator: int = 75) -> DataFrame:
    """The rows of clusters whose size and sketch leave room for a link with another of the cluster."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (node, block, n, sketch) in groups(batches, ["node", "block", "n", "sketch"]):
            block, n = np.array(block), np.array(n)
            width = np.array([len(x) for x in sketch])
            any_link = np.zeros(len(n), bool)
            # Sets that can link are of like size, so their widths are equal or one is twice the other.
            for w in np.unique(width).tolist():
                use = np.flatnonzero((width == w) | (width == 2 * w))
                odd = np.stack([fold(sketch[i], w) for i in use.tolist()])
                m, blk, narrow = n[use], block[use], np.flatnonzero(width[use] == w)
                for x in narrow.tolist():
                    ok = 100 * np.minimum(m, m[x]) >= numerator * np.maximum(m, m[x])
                    ok[x] = False
                    if key[1] != key[2]:
                        ok &= blk != blk[x]
                    y = np.flatnonzero(ok)
                    if len(y):
                        y = y[np.bitwise_count(odd[y] ^ odd[x]).sum(1) * (100 + numerator) <= (100 - numerator) * (m[y] + m[x])]
                        any_link[use[y]] = True
                        any_link[use[x]] |= len(y) > 0
            found = np.flatnonzero(any_link)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key[0])), pa.array(np.array(node)[found])], ["center", "node"])

    held = sets.filter("sketch IS NOT NULL AND n > 0").select("node", "n", "sketch").dropDuplicates(["node"])
    return dealt(near, blocks_of(near), held).mapInArrow(look, "center bigint, node bigint").distinct()


def cluster_links(near: DataFrame, sets: DataFrame, numerator: int = 75, count: bool = True) -> DataFrame:
    """Links (a, b; n null) enough to join all that link within each cluster (center, node), and rows (a, b null, n) whose n sum to the links of node a.

    Every link is counted once: in the cluster of the least center that both ends have, in one pair of blocks.
    Without ``count`` only the joining links are looked for, and the others are not compared. A cluster of more than BLOCK nodes is compared block by block in many tasks; a task holds the sets
    of two blocks at most. Sketches are looked at first, so that sets are only sent where they matter.
    """
    near = written(hopeful(near, sets, numerator), "hopeful")
    nodes = written(near.select("node").distinct(), "hopeful-nodes")
    small = F.broadcast if nodes.count() <= BROADCAST_ROWS else (lambda df: df)
    held = sets.filter("members IS NOT NULL AND n > 0").select("node", "members").join(small(nodes), "node", "left_semi").dropDuplicates(["node"])
    if not count:

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, i, j), (node, block, members) in groups(batches, ["node", "block", "members"]):
                found = joining_links(np.array(node), np.array(block), [np.sort(unpack(m)) for m in members], i != j, numerator)
                yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.int64()) for k in range(2)), pa.nulls(len(found), pa.int64())], ["a", "b", "n"])

        return dealt(near, blocks_of(near), held).mapInArrow(join, "a bigint, b bigint, n bigint")
    held = held.join(near.groupBy("node").agg(F.collect_list("center").alias("centers")), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (center, i, j), (node, block, members, centers) in groups(batches, ["node", "block", "members", "centers"]):
            lesser = [[c for c in cs if c < center] for cs in centers]
            found, n = links_in(np.array(node), np.array(block), [np.sort(unpack(m)) for m in members], lesser, i != j, numerator)
            has = np.flatnonzero(n)
            rows = [*((x, y, None) for x, y in found), *((node[k], None, int(n[k])) for k in has.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], ["a", "b", "n"])

    return dealt(near, blocks_of(near), held).mapInArrow(compare, "a bigint, b bigint, n bigint")


def linked_sets(docs: DataFrame, id_col: str, text_col: str, count: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, their links and link counts (cluster_links), and node, label (the component) of every set that is not empty."""
    sets = written(shingle_sets(docs, id_col, text_col), "shingle-sets")
    near = written(clusters(signatures(sets, frequent_shingles(sets))), "clusters")
    links = written(cluster_links(near, sets, count=count), "cluster-links")
    nodes = sets.filter("n >= 0 AND node IS NOT NULL").select("node").distinct()
    return sets, links, nodes.join(components(links.filter("b IS NOT NULL")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (how many other sets its set links with).

    A null, empty or blank text has the empty set, no link, and its own id as component. Equal sets
    are one node, so repeated rows and copies are linked without making pairs; null ids take part but
    are never the smallest. Every pair of different sets that links is counted.
    """
    sets, links, labels = linked_sets(docs, id_col, text_col)
    nodes = sets.filter("n >= 0 AND node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    parent = nodes.join(labels, "node")
    smallest = parent.groupBy("label").agg(F.min("least").alias("component_id"))
    degree = links.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    known = parent.join(smallest, "label").join(degree, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = sets.filter("n >= 0").select("doc_id", "n", "node")
    lone = rows.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    placed = rows.filter("node IS NOT NULL").join(known, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return placed.unionByName(lone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, of its smallest id (null is the largest); documents without words all stay.

    Rows are told apart by id and text, so ids may be null or shared. Rows that are equal in both are
    one text of one component, of which one row stays; of several texts with the smallest id the one with
    the smallest key stays. Null, empty and blank texts are in no component. Texts of any length are
    whole. An empty table stays empty; other columns are kept as they are, whatever their names.
    """
    sets, _, labels = linked_sets(docs, id_col, text_col, count=False)
    same = sets.filter("n > 0").groupBy("node", "doc_id", "key").agg(F.count("*").alias("times"))
    rows = written(same.join(labels, "node"), "row-labels")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = rows.groupBy("label").agg(F.min(order).alias("first"))
    found = rows.join(first, "label").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_same"), "times",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).alias("stays"),
    )
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, text_key(text_col))
    name, same = unused(keyed, "_id"), unused(keyed, "_same")
    marked = lambda left, marks, how: left.join(marks.select(F.col("_id").alias(name), F.col("_same").alias(same)), F.col(id_col).eqNullSafe(F.col(name)) & (F.col(key) == F.col(same)), how)
    again = found.filter("stays AND times > 1")
    rest = marked(keyed, found.filter("NOT stays"), "left_anti")
    single = marked(rest, again, "left_anti")
    double = marked(rest, again, "left_semi").dropDuplicates([id_col, key])
    return single.unionByName(double).drop(key)
