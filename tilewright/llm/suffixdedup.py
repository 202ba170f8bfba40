"""Removal of long repeated strings with suffix arrays built by two-stage sorting.

A string of ``width`` bytes is repeated if it starts at two places of the corpus. Every such string
holds a content-chosen anchor: the leftmost least hash of the GRAM-byte grams inside it. Equal strings
have equal anchors, so only texts around anchors that occur more than once are looked at, and places
that can match meet under the anchor's hash. The starts of strings that share an anchor form a segment
with the bytes that they cover. Segments that are equal are counted, not compared. Of the others, the
suffix array of each group tells which starts repeat: suffixes smaller than their successors are sorted
directly, the rest are induced by bucket scans, and neighbours in the array whose common prefix reaches
``width`` are repeated. Only the suffixes that starts need take part.

A group of more than GROUP_BYTES is split by what stands around its anchor: starts at near distances
from the anchor form a class, all strings of a class share a core, and the parts of segments that a
class covers meet under the core's hash; equal parts are counted, different ones compared as above. A
core that still has too many different parts is split down to its strings, which meet whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.scratch import Scratch, broadcast_if_small
from tilewright.llm.textbytes import BASE, INVERSE, RUN_BYTES, mixed, powers, prefix_hash, runs

WIDTH, GRAM = 400, 32
#: Texts are read in pieces of so many starts, so a text of any length fits.
PIECE = 1 << 18
#: Suffix arrays are built over about so many bytes at a time; a group of more than GROUP_BYTES is split into classes of CLASS distances.
BLOCK_BYTES, GROUP_BYTES, CLASS = 128 << 10, 128 << 10, 16
#: A table of wanted anchors or of spans is broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


def least_places(h: np.ndarray, span: int) -> np.ndarray:
    """For each x the place of the leftmost least value of h[x : x + span] (len(h) - span + 1 of them)."""
    n = len(h)
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)  # n < 2^24
    blocks = -(-n // span)
    full = np.full(blocks * span, np.uint64((1 << 64) - 1))
    full[:n] = key
    grid = full.reshape(blocks, span)
    right = np.minimum.accumulate(grid, axis=1).reshape(-1)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - span + 1
    return (np.minimum(left[:m], right[span - 1 : span - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first starts, last starts + 1, anchors' places, anchors' hashes) of the segments of texts laid end to end, piece by piece."""
    at = 0
    while at + width <= len(data):
        piece = data[at : at + PIECE + width - 1]
        c = prefix_hash(piece)
        m = len(piece) - gram + 1
        h = mixed((c[gram:] - c[:m]) * powers(INVERSE, m))
        place = least_places(h, width - gram + 1)
        row = np.searchsorted(offsets, np.arange(at, at + len(place)), "right") - 1
        fits = np.arange(at, at + len(place)) + width <= offsets[row + 1]
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
        lo = np.flatnonzero(change)
        hi = np.append(lo[1:], len(place))
        use = fits[lo]
        lo, hi = lo[use], hi[use]
        yield row[lo], lo + at, hi + at, place[lo] + at, mixed(h[place[lo]] + np.uint64(width)).view(np.int64)
        at += PIECE


def two_stage_suffix_array(text: np.ndarray, depth: int = WIDTH, starts: np.ndarray | None = None) -> np.ndarray:
    """Suffix array, exact in the first ``depth`` bytes; of ``starts`` and the suffixes that they are induced from, if given.

    Suffixes smaller than their successor are sorted directly. A scan of the buckets of first bytes in
    ascending order then puts each larger suffix behind those already in its bucket when the suffix
    that follows it is met.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    nxt = np.repeat(change, np.diff(np.concatenate(([-1], change))))  # last place of the run that each place is in
    smaller = np.zeros(n, bool)
    inner = nxt < n - 1
    smaller[inner] = text[nxt[inner]] < text[nxt[inner] + 1]
    raw = text.tobytes()
    wanted = np.ones(n, bool)
    if starts is not None:
        # A larger suffix is induced from those that follow it, up to the next smaller one.
        ends = np.append(np.flatnonzero(smaller), n - 1)
        gain = np.zeros(n + 1, np.int32)
        np.add.at(gain, starts, 1)
        np.add.at(gain, ends[np.searchsorted(ends, starts)] + 1, -1)
        wanted = np.cumsum(gain)[:n] > 0
    direct = np.flatnonzero(smaller & wanted)
    # Suffixes with the same first two bytes are sorted at a time, so few of their beginnings are copied at once.
    pair = (text[direct].astype(np.int64) << 8) | np.append(text, 0)[direct + 1]
    direct = direct[np.argsort(pair, kind="stable")]
    edges = np.concatenate(([0], np.cumsum(np.bincount(pair, minlength=1 << 16))))
    for k in np.flatnonzero(np.diff(edges) > 1).tolist():
        same = direct[edges[k] : edges[k + 1]]
        direct[edges[k] : edges[k + 1]] = sorted(same.tolist(), key=lambda i: raw[i : i + depth])
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Deals the larger suffixes before the scanned ones to their buckets; those of this very bucket come back."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before] & wanted[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for b in np.unique(first).tolist():
            if b != byte:
                waiting[b].append(before[first == b])
        return before[first == byte]

    own = induce(np.array([n]), -1)  # the empty suffix comes first
    for byte in range(256):
        larger = np.concatenate(waiting[byte]) if waiting[byte] else own[:0]
        while len(larger):
            out.append(larger)
            larger = induce(larger, byte)
        mine = direct[cuts[byte] : cuts[byte + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, byte)
    return np.concatenate(out) if out else direct


def repeated_starts(text: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which of ``starts`` (all with ``width`` bytes after them) begin a string that another of them begins too."""
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    order = two_stage_suffix_array(text, width, starts)
    order = order[valid[order]]
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(text)].astype(np.uint64)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for k in (*range(0, width - 7, 8), width - 8):  # common prefixes of neighbours, 8 bytes at a time
        alive = alive[word[a[alive] + k] == word[b[alive] + k]]
    hit = np.zeros(len(text), bool)
    hit[a[alive]] = hit[b[alive]] = True
    return hit[starts]


def spans(flags: np.ndarray) -> list[list[int]]:
    """[first, end) runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """anchor, node, ident (of the anchor's place) of all segments. docs: node, check, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "check"))
            for at, data, offsets in runs(batch.column("text")):
                for row, lo, _, _, key in segments(data, offsets, width):
                    node = nodes[at + row]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node, place_id(node, checks[at + row], lo - offsets[row]))], ["anchor", "node", "ident"])

    return docs.mapInArrow(read, "anchor bigint, node bigint, ident bigint")


def place_id(node: np.ndarray, check: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number of a place, to tell whether two places of one anchor are the same."""
    return mixed(start.astype(np.uint64) * BASE + mixed(node.view(np.uint64) + mixed(check.view(np.uint64)))).view(np.int64)


def identity(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text with different seeds: texts are the same if both are."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def digests(pieces: list[bytes]) -> pa.Array:
    return pa.array([digest(x) for x in pieces], pa.int64())


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows 0, 1 ... each repeated ``count`` times, and first, first + 1 ... in each."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]


def cut_segments(docs: DataFrame, width: int) -> DataFrame:
    """The segments of docs (node, check, text, anchors) whose anchor is in ``anchors``, once per text and task: anchor, content (a hash of data), node, check, start (in the text), n_starts, at (the anchor's place in data), ident, data."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names = ["anchor", "content", "node", "check", "start", "n_starts", "at", "ident", "data"]
        for batch in batches:
            nodes, checks, wants = *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "check")), batch.column("anchors")
            lists, flat = wants.offsets.to_numpy(), wants.values.to_numpy(zero_copy_only=False)
            new = np.zeros(len(nodes), bool)
            for i, x in enumerate(zip(nodes.tolist(), checks.tolist(), strict=True)):
                new[i] = x not in seen
                if len(seen) < 1_000_000:
                    seen.add(x)
            for k, data, offsets in runs(batch.column("text")):
                want = np.unique(flat[lists[k] : lists[k + len(offsets) - 1]])
                for row, lo, hi, place, key in segments(data, offsets, width):
                    use = np.flatnonzero(new[k + row] & np.isin(key, want))
                    row, lo, hi, place, key = (x[use] for x in (row, lo, hi, place, key))
                    node, check, start = nodes[k + row], checks[k + row], lo - offsets[row]
                    raw = [data[x:y].tobytes() for x, y in zip(lo, hi + width - 1, strict=True)]
                    cols = [pa.array(key), digests(raw), *(pa.array(x) for x in (node, check, start, hi - lo, place - lo, place_id(node, check, start)))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary())], names)

    return docs.mapInArrow(cut, "anchor bigint, content bigint, node bigint, check bigint, start bigint, n_starts bigint, at bigint, ident bigint, data binary")


def cut_classes(segments: DataFrame, width: int) -> DataFrame:
    """The parts of segments (anchor, content, at, n_starts, data) by class of distances from the anchor: anchor, content, first and last (start in the segment), core and part (hashes of what the class's strings share and cover)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "content", "at", "n_starts")]
            for k, data, offsets in runs(batch.column("data")):
                anchor, content, at, n = (x[k : k + len(offsets) - 1] for x in cols)
                low, high = (at - n + 1) // CLASS, at // CLASS
                row, cls = spread(low, high - low + 1)
                begin = offsets[row] + at[row] - CLASS * cls
                end = begin - CLASS + 1 + width
                c = prefix_hash(data)
                # Near the ends of its starts a class may reach beyond the segment; strings there still hold the core's bytes.
                core = mixed((c[end] - c[begin]) * powers(INVERSE, len(data) + 1)[begin] + mixed(anchor[row].view(np.uint64)) + cls.astype(np.uint64) * BASE)
                # Distances from CLASS * class to CLASS * class + CLASS - 1 are starts at - distance.
                first, last = np.maximum(0, at[row] - CLASS * cls - (CLASS - 1)), np.minimum(n[row] - 1, at[row] - CLASS * cls)
                part = digests([data[x:y].tobytes() for x, y in zip(offsets[row] + first, offsets[row] + last + width, strict=True)])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (anchor[row], content[row], first, last, core.view(np.int64))), part], ["anchor", "content", "first", "last", "core", "part"])

    return segments.mapInArrow(cut, "anchor bigint, content bigint, first bigint, last bigint, core bigint, part bigint")


def cut_strings(parts: DataFrame, width: int) -> DataFrame:
    """Every string of parts (anchor, content, first, n_starts, data): string, check (two hashes of it), anchor, content, nth."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "content", "first", "n_starts")]
            for k, data, offsets in runs(batch.column("data")):
                anchor, content, at, n = (x[k : k + len(offsets) - 1] for x in cols)
                row, nth = spread(np.zeros(len(n), np.int64), n)
                begin = offsets[row] + nth
                c = prefix_hash(data)
                h = mixed((c[begin + width] - c[begin]) * powers(INVERSE, len(data) + 1)[begin])
                check = digests([data[x : x + width].tobytes() for x in begin])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), check, *(pa.array(x) for x in (anchor[row], content[row], at[row] + nth))], ["string", "check", "anchor", "content", "nth"])

    return parts.mapInArrow(cut, "string bigint, check bigint, anchor bigint, content bigint, nth bigint")


def compared(groups: DataFrame, width: int) -> DataFrame:
    """Repeated starts of groups (meet, anchor, content, again, first, n_starts, data), each of GROUP_BYTES at most, by suffix arrays: anchor, content, lo, hi (starts from lo to hi - 1 in the segment). Rows marked again are compared but not returned."""
    names = ["meet", "anchor", "content", "again", "first", "n_starts", "data"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush() -> pa.RecordBatch:
            text = np.frombuffer(b"".join(r[6] for r in held), np.uint8)
            n = np.array([r[5] for r in held])
            length = np.array([len(r[6]) for r in held])
            _, starts = spread(np.cumsum(length) - length, n)
            hit = np.split(repeated_starts(text, starts, width), np.cumsum(n)[:-1])
            out = [(r[1], r[2], r[4] + a, r[4] + b) for r, x in zip(held, hit, strict=True) if not r[3] and x.any() for a, b in spans(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["anchor", "content", "lo", "hi"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                for r in zip(*(batch.column(c).slice(at, 1_000).to_pylist() for c in names), strict=True):
                    if r[0] != last and size >= BLOCK_BYTES:
                        yield flush()
                        held, size = [], 0
                    held.append(r)
                    size += len(r[6])
                    last = r[0]
        if held:
            yield flush()

    return groups.select(names).repartition("meet").sortWithinPartitions("meet").mapInArrow(sort, "anchor bigint, content bigint, lo bigint, hi bigint")


def repeated_spans(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """node, check, lo, hi (bytes from lo to hi - 1) that repeated strings cover, overlapping or not. docs: node, check, text, a row per text or more."""
    found = scratch.write(anchors(docs, width), "anchors")
    # Written, so that both sides of the join are plain shuffles and a very frequent anchor can be split.
    twice = scratch.write(found.groupBy("anchor").agg(F.min("ident").alias("lo"), F.max("ident").alias("hi")).filter("lo != hi").select("anchor"), "twice")
    wanted = scratch.write(found.join(twice, "anchor").groupBy("node").agg(F.collect_set("anchor").alias("anchors")), "wanted")
    scratch.drop("anchors", "twice")
    known = broadcast_if_small(wanted, 32 + 8 * F.size("anchors"), BROADCAST_BYTES)
    members = scratch.write(cut_segments(docs.join(known, "node").select("node", "check", "text", "anchors"), width), "segments")
    distinct = scratch.write(
        members.groupBy("anchor", "content")
        .agg(F.min("ident").alias("lo"), F.max("ident").alias("hi"), F.first("n_starts").alias("n_starts"), F.first("at").alias("at"), F.first("data").alias("data"))
        .select("anchor", "content", (F.col("lo") != F.col("hi")).alias("again"), "n_starts", "at", "data"),
        "distinct-segments",
    )
    zero = F.lit(0).cast("long")
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("bytes")).filter("n > 1")
    whole = distinct.filter("again").select("anchor", "content", zero.alias("lo"), F.col("n_starts").alias("hi"))
    several = distinct.join(sizes, "anchor")
    small = several.filter(F.col("bytes") <= GROUP_BYTES).select(F.col("anchor").alias("meet"), "anchor", "content", "again", zero.alias("first"), "n_starts", "data")

    # Groups that are too large: their parts by class. Of equal parts one is compared with the others.
    large = several.filter(F.col("bytes") > GROUP_BYTES).select("anchor", "content", "at", "n_starts", "data")
    classes = scratch.write(cut_classes(large, width), "classes")
    place = F.struct("anchor", "content", "first", "last")
    parts = scratch.write(classes.groupBy("core", "part").agg(F.count("*").alias("n"), F.min(place).alias("p")).select("core", "part", "n", "p.*"), "parts")
    shared = classes.join(parts.filter("n > 1").select("core", "part"), ["core", "part"]).select("anchor", "content", F.col("first").alias("lo"), (F.col("last") + 1).alias("hi"))
    met = parts.join(parts.groupBy("core").agg(F.count("*").alias("k"), F.sum(F.col("last") - F.col("first") + width).alias("bytes")).filter("k > 1"), "core")
    cut = met.join(large, ["anchor", "content"]).select(
        F.col("core").alias("meet"), "anchor", "content", (F.col("n") > 1).alias("again"), "first", (F.col("last") - F.col("first") + 1).alias("n_starts"),
        F.substring("data", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + width).cast("int")).alias("data"), "bytes",
    )
    by_array = compared(small.unionByName(cut.filter(F.col("bytes") <= GROUP_BYTES).drop("bytes")), width)
    strings = cut_strings(cut.filter(F.col("bytes") > GROUP_BYTES).select("anchor", "content", "first", "n_starts", "data"), width)
    twofold = strings.groupBy("string", "check").agg(F.count("*").alias("n")).filter("n > 1").select("string", "check")
    alone = strings.join(twofold, ["string", "check"]).select("anchor", "content", F.col("nth").alias("lo"), (F.col("nth") + 1).alias("hi"))
    hits = scratch.write(merged_spans(whole.unionByName(by_array).unionByName(shared).unionByName(alone), ["anchor", "content"]), "repeated-starts")
    placed = members.select("anchor", "content", "node", "check", "start").distinct().join(hits, ["anchor", "content"]).select("node", "check", "start", F.explode("spans").alias("s"))
    return placed.select("node", "check", (F.col("start") + F.col("s")[0]).alias("lo"), (F.col("start") + F.col("s")[1] - 1 + width).alias("hi"))


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and spans (arrays lo, hi, in order) of what lo, hi cover by key. Spans of a text or segment: a few for each of its bytes at most."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("lo") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.withColumn("before", before).withColumn("run", run).groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.array("lo", "hi"))).alias("spans"))


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, n_bytes, n_removed, spans (removed bytes, first/end), kept (binary).

    Null counts as empty. A text of ``width`` bytes or more that another row has too goes wholly; of
    shorter ones nothing goes. Every occurrence goes, the first too, as judged on the input. An empty
    table gives an empty result. Texts of any length are whole; other columns of the input are ignored,
    whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns(dict(zip(("node", "check"), identity(F.col("text")), strict=True)))
    size = F.octet_length("text")
    copied = rows.filter(size >= width).groupBy("node", "check").agg(F.count("*").alias("n"), F.max(size).cast("long").alias("hi")).filter("n > 1").select("node", "check", F.lit(0).cast("long").alias("lo"), "hi")
    found = repeated_spans(rows.select("node", "check", "text"), width, scratch)
    known = scratch.write(merged_spans(found.unionByName(copied), ["node", "check"]), "spans")
    scratch.drop_all_but("spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        for batch in batches:
            for k, data, offsets in runs(batch.column("text"), RUN_BYTES):
                n = len(offsets) - 1
                spans = batch.column("spans").slice(k, n)
                out, removed = [], []
                for i, gone in enumerate(spans.to_pylist()):
                    raw, kept, at = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
                    for x, y in gone or ():
                        kept.append(raw[at:x])
                        at = y
                    kept.append(raw[at:])
                    out.append(b"".join(kept))
                    removed.append(len(raw) - len(out[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, n), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), spans, pa.array(out, pa.binary())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(broadcast_if_small(known, 40 + 48 * F.size("spans"), BROADCAST_BYTES), ["node", "check"], "left")
    return joined.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans")).mapInArrow(
        keep, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    )
