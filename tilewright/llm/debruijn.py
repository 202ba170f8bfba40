"""Removal of repeated passages by compaction of a de Bruijn graph of words.

Every stretch of ``width`` words of a text is an edge of the graph, from its first width - 1 words to
its last. Only edges that occur more than once matter. Candidates come from minimizers: the leftmost
least hash of the grams inside an edge is its anchor, equal edges have equal anchors, and the edges
with one anchor place are consecutive. Where an anchor has the same words around it wherever it is, its
edges are one path from the start; where not, every edge stands for itself.

Paths are counted with their least source coordinate. A path joins the one behind it where neither end
branches: everywhere the first is followed by the second, and the second preceded by the first. Two such
paths meet in a Spark join at their shared node, and the source coordinates check the joint: the second
must lie in its first source right behind the first. So compacted paths are stretches of consecutive
source coordinates, and only their first edges are looked up in the texts again.

Edges are compared by 128 bits: two hashes of their words that are built from different word hashes.
Equal texts are one path each from the start: the one with the least id stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.scratch import Scratch, broadcast_if_small
from tilewright.llm.suffixdedup import least_places, merged_spans
from tilewright.llm.textbytes import BASE, INVERSE, RUN_BYTES, mixed, powers, prefix_hash, runs

WIDTH, GRAM = 20, 8
#: The base of the second hashes.
OTHER = np.uint64(0xD1342543DE82EF95)
OTHER_INVERSE = np.uint64(pow(int(OTHER), -1, 1 << 64))
#: Windows are looked through in pieces of so many.
PIECE = 1 << 20
#: Tables of anchors, paths and spans are broadcast up to so many bytes, as estimated by row; Spark's hashed form takes about twice that.
BROADCAST_BYTES = 64 << 20
#: Compacted paths end at multiples of so many words of their source, so that no task holds a whole text's.
SOURCE_BLOCK = 4_096


def word_hashes(data: np.ndarray, offsets: np.ndarray, second: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, hashes) of the words of texts laid end to end: one or two hashes of each word.

    Long texts are hashed in pieces that end at white space.
    """
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1]))[: len(solid)] | edge[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True]))[: len(solid)] | edge[1:])) + 1
    bases = ((BASE, INVERSE), (OTHER, OTHER_INVERSE))[: 1 + second]
    out: list[list[np.ndarray]] = [[] for _ in bases]
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + 4 * RUN_BYTES, "right")))
        lo, hi = starts[at:last] - starts[at], ends[at:last] - starts[at]
        piece = data[starts[at] : ends[last - 1]]
        for (base, inverse), hashes in zip(bases, out, strict=True):
            c = prefix_hash(piece, base)
            hashes.append(mixed((c[hi] - c[lo]) * powers(inverse, len(piece) + 1)[lo] + (hi - lo).astype(np.uint64)))
        at = last
    return np.searchsorted(offsets, starts, "right") - 1, [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in out]


class Sequences:
    """Hashes of stretches of words, from running sums."""

    def __init__(self, h: np.ndarray, base: np.uint64, inverse: np.uint64):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(base, len(h)), out=self.sums[1:])
        self.scale = powers(inverse, len(h) + 1)

    def every(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size:] - self.sums[:n]) * self.scale[:n]) if n else np.zeros(0, np.uint64)

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.scale[lo] + (hi - lo).astype(np.uint64))


def segments(row: np.ndarray, first: Sequences, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, anchor): the edges from lo to hi - 1 share one anchor place; anchor is the hash there."""
    n = len(row) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),)
    grams = first.every(gram)
    found = []
    for at in range(0, n, PIECE):
        piece = grams[at : at + PIECE + width - gram]
        place = least_places(piece, width - gram + 1) + at
        rows = row[at : at + len(place)]
        fits = rows == row[at + width - 1 : at + width - 1 + len(place)]
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1]) | (fits[1:] != fits[:-1])
        lo = np.flatnonzero(change)
        hi = np.append(lo[1:], len(place))
        use = fits[lo]
        found.append((lo[use] + at, hi[use] + at, mixed(grams[place[lo[use]]] + np.uint64(width)).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """node, anchor, content (a hash of all words of the segment) of all segments. rows: node, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for k, data, offsets in runs(batch.column("text")):
                row, (h, g) = word_hashes(data, offsets, True)
                lo, hi, anchor = segments(row, Sequences(h, BASE, INVERSE), width, gram)
                content = Sequences(g, OTHER, OTHER_INVERSE).between(lo, hi + width - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k + row[lo]]), pa.array(anchor), pa.array(content)], ["node", "anchor", "content"])

    return rows.select("node", "text").mapInArrow(read, "node bigint, anchor bigint, content bigint")


def cut_segments(rows: DataFrame, kind: str, width: int, gram: int) -> DataFrame:
    """All segments of rows (doc_id, node, text): doc_id, node, start (word), anchor, content, edges and checks (two hashes of each edge), before and after (the edge on either side in the text).

    If rows have ``wanted`` and ``several`` (arrays), only the segments with an anchor of the first; their ``several`` says whether the second has it too.
    """
    names = ["doc_id", "node", "start", "anchor", "content", "edges", "checks", "before", "after"]
    listed = "wanted" in rows.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for k, data, offsets in runs(batch.column("text")):
                row, (h, g) = word_hashes(data, offsets, True)
                first, second = Sequences(h, BASE, INVERSE), Sequences(g, OTHER, OTHER_INVERSE)
                lo, hi, anchor = segments(row, first, width, gram)
                if not len(lo):
                    continue
                edge, check = first.every(width).view(np.int64), second.every(width).view(np.int64)
                n = len(edge)
                fits = row[:n] == row[width - 1 : width - 1 + n]
                # The valid edges in order are those of the segments in order.
                cut = pa.array(np.concatenate(([0], np.cumsum(hi - lo))), pa.int32())
                of = row[lo]
                prev, nxt = np.maximum(lo - 1, 0), np.minimum(hi, n - 1)
                begins = (lo == 0) | (row[prev] != of)
                ends = (hi >= n) | ~fits[nxt] | (row[nxt] != of)
                start = lo - np.searchsorted(row, of)
                out = pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(k + of)), pa.array(nodes[k + of]), pa.array(start), pa.array(anchor), pa.array(second.between(lo, hi + width - 1).view(np.int64)),
                    pa.ListArray.from_arrays(cut, pa.array(edge[fits])), pa.ListArray.from_arrays(cut, pa.array(check[fits])),
                    pa.array(edge[prev], mask=begins), pa.array(edge[nxt], mask=ends),
                ], names)
                if listed:
                    wanted, several = (np.unique(batch.column(c).slice(k, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False)) for c in ("wanted", "several"))
                    out = out.append_column("several", pa.array(np.isin(anchor, several))).filter(pa.array(np.isin(anchor, wanted)))
                yield out

    schema = f"doc_id {kind}, node bigint, start bigint, anchor bigint, content bigint, edges array<bigint>, checks array<bigint>, before bigint, after bigint"
    return rows.mapInArrow(read, schema + ", several boolean" * listed)


def path_places(rows: DataFrame, kind: str, width: int, gram: int, scratch: Scratch) -> DataFrame:
    """The places of paths that may repeat: head and tail (edges), check, n (edges), doc_id, node, start, before, after."""
    counted = anchors(rows, width, gram).groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("several"))
    twice = scratch.write(counted.filter("n > 1").select("anchor", "several"), "anchors")
    if 40 * twice.count() <= BROADCAST_BYTES:
        cut = cut_segments(rows, kind, width, gram).join(F.broadcast(twice), "anchor")
    else:  # Anchors go to the texts that have them, and not the segments of all texts to the anchors.
        has = anchors(rows, width, gram).select("node", "anchor").distinct().join(twice, "anchor")
        lists = has.groupBy("node").agg(F.collect_list("anchor").alias("wanted"), F.collect_list(F.when(F.col("several"), F.col("anchor"))).alias("several"))
        cut = cut_segments(rows.join(lists, "node").select("doc_id", "node", "text", "wanted", "several"), kind, width, gram)
    last = F.size("edges") - 1
    zero = F.lit(0)

    def path(k, n, head, tail, check, before, after):
        return F.struct(k.alias("k"), n.alias("n"), head.alias("head"), tail.alias("tail"), check.alias("check"), before.alias("before"), after.alias("after"))

    whole = path(zero, F.size("edges"), F.get("edges", zero), F.get("edges", last), F.col("content"), F.col("before"), F.col("after"))
    single = F.transform(F.sequence(zero, last), lambda k: path(
        k, F.lit(1), F.get("edges", k), F.get("edges", k), F.get("checks", k),
        F.when(k == 0, F.col("before")).otherwise(F.get("edges", k - 1)), F.when(k == last, F.col("after")).otherwise(F.get("edges", k + 1)),
    ))
    each = cut.select("doc_id", "node", "start", F.explode(F.when(F.col("several"), single).otherwise(F.array(whole))).alias("p"))
    return each.select("doc_id", "node", (F.col("start") + F.col("p.k")).alias("start"), "p.head", "p.check", "p.tail", "p.n", "p.before", "p.after")


def compacted(places: DataFrame, scratch: Scratch) -> DataFrame:
    """head, check, first (least doc_id, start), n (edges) of the repeated paths of the graph, joined as far as they do not branch."""
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    paths = scratch.write(
        places.groupBy("head", "check").agg(
            F.count("*").alias("places"), F.min(F.struct("doc_id", "start")).alias("first"), F.first("n").alias("n"), F.first("tail").alias("tail"), only("before").alias("before"), only("after").alias("after")
        ).filter("places > 1"), "paths",
    )
    # A path and the one behind it meet at the edge between them; the source coordinates check the joint.
    ahead = paths.filter("after IS NOT NULL").select(F.col("after").alias("head"), F.col("tail").alias("_tail"), F.col("first").alias("_first"), F.col("n").alias("_n"), F.col("places").alias("_places"))
    joint = (F.col("before") == F.col("_tail")) & (F.col("places") == F.col("_places"))
    behind = F.col("first.doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("first.start") == F.col("_first.start") + F.col("_n"))
    joined = paths.filter("before IS NOT NULL").join(ahead, "head").filter(joint & behind).select("head", "check").distinct().withColumn("joined", F.lit(True))
    linked = paths.join(joined, ["head", "check"], "left").select("head", "check", "first", "n", "places", "before", "tail", F.coalesce("joined", F.lit(False)).alias("joined"))
    # A chain of joined paths is a stretch of its source: each begins where the one before it ends.
    order = Window.partitionBy(F.col("first.doc_id"), F.floor(F.col("first.start") / SOURCE_BLOCK)).orderBy("first.start", "head", "check")
    goes_on = F.col("joined") & (F.lag("tail").over(order) == F.col("before")) & (F.lag(F.col("first.start") + F.col("n")).over(order) == F.col("first.start"))
    chained = linked.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    key = ["first.doc_id", F.floor(F.col("first.start") / SOURCE_BLOCK).alias("block"), "chain"]
    best = chained.select(*key, "begins", "head", "check", "first", "n").groupBy("doc_id", "block", "chain").agg(F.sum("n").alias("n"), F.max_by(F.struct("head", "check", "first"), "begins").alias("p"))
    return best.select("p.*", "n")


def repeated_spans(rows: DataFrame, kind: str, width: int, gram: int, scratch: Scratch) -> DataFrame:
    """doc_id, node, lo, hi (words from lo to hi - 1) of the places of repeated paths that are not their first. rows: doc_id, node, text."""
    places = scratch.write(path_places(rows, kind, width, gram, scratch), "places")
    paths = scratch.write(compacted(places, scratch), "compacted")
    found = places.select("head", "check", "doc_id", "node", "start").join(broadcast_if_small(paths, F.lit(64), BROADCAST_BYTES), ["head", "check"])
    earlier = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))
    return found.filter(earlier).select("doc_id", "node", F.col("start").alias("lo"), (F.col("start") + F.col("n") + width - 1).alias("hi"))


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, n_words, n_removed, spans (removed words, first/end), kept (words joined by one space).

    Words end at spaces and the control characters 9 to 13. A word goes if a stretch of ``width`` words
    over it also starts earlier, that is at a smaller (id, word number); a null id is smaller than all
    others. Rows that share an id do not come before one another: of equal rows every one stays or
    goes like the others. Null texts have no words, texts of less than ``width`` words stay whole, an
    empty table gives an empty result, and texts of any length are whole. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"node": F.xxhash64("text"), "key": F.unhex(F.md5("text"))})
    # Of equal texts the one with the least id is looked at; the others go wholly, if they have a window.
    copies = scratch.write(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id")).alias("original")).filter("n > 1").select("key", "original"), "copies")
    extra = F.col("original").isNotNull() & ~F.col("original.doc_id").eqNullSafe(F.col("doc_id"))
    rows = rows.join(broadcast_if_small(copies, F.lit(80), BROADCAST_BYTES), "key", "left").select("doc_id", "node", "text", extra.alias("extra"))
    found = repeated_spans(rows.filter("NOT extra").select("doc_id", "node", "text"), kind, width, gram, scratch)
    known = scratch.write(merged_spans(found, ["doc_id", "node"]), "word-spans")
    scratch.drop_all_but("word-spans", "copies")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, removed, kept = [], [], []
                out = []
                for text, gone, extra in zip(part.column("text"), part.column("spans").to_pylist(), part.column("extra").to_pylist(), strict=True):
                    words = text.as_py().split()
                    rest, k = [], 0
                    if extra and len(words) >= width:
                        gone = [[0, len(words)]]
                    out.append(gone)
                    for x, y in gone:
                        rest += words[k:x]
                        k = y
                    rest += words[k:]
                    size.append(len(words))
                    removed.append(len(words) - len(rest))
                    kept.append(b" ".join(rest))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, part.column("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], names)

    spans = broadcast_if_small(known.withColumnRenamed("doc_id", "_id"), 48 + 48 * F.size("spans"), BROADCAST_BYTES)
    joined = rows.join(spans, (rows["node"] == spans["node"]) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", F.col("text").cast("binary").alias("text"), "extra", F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans")).mapInArrow(
        keep, f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept string"
    )
