"""The mixing schedule slot by slot, and what it takes of every document, from their definitions."""

import collections
import math
import random

import pytest

from tilewright.llm import mixing


def scheduled(targets, block):
    """(slot, src, rank, epoch, block, words) of all slots. targets: (src, source_size, taken_words) in order."""
    slots = {}
    for src, size, words in targets:
        blocks = -(-size // block)
        slots[src] = (words // size) * blocks + -(-(words % size) // block) if size else 0
    total, edges, at = sum(slots.values()), [], 0
    for src, n in sorted(slots.items()):
        if n:
            edges.append((src, at / total, (at + n) / total))
            at += n
    # A range ends where the next begins, the last at 1.
    edges = [(src, lo, edges[k + 1][1] if k + 1 < len(edges) else 1.0) for k, (src, lo, _) in enumerate(edges)]
    taken, out = collections.Counter(), []
    for i in range(total):
        u = math.fmod(float(i) * mixing.GOLDEN, 1.0)
        src = next(s for s, lo, hi in edges if lo <= u < hi)
        out.append((i, src, taken[src]))
        taken[src] += 1
    for src, n in slots.items():
        out += [(total + rank * len(targets) + src, src, rank) for rank in range(taken[src], n)]
    known = {src: (size, words) for src, size, words in targets}
    rows = []
    for slot, src, rank in out:
        if rank < slots[src]:
            size, words = known[src]
            blocks = -(-size // block)
            epoch, k = divmod(rank, blocks)
            rows.append((slot, src, rank, epoch, k, min(block, size - k * block, words - epoch * size - k * block)))
    return sorted(rows)


@pytest.mark.parametrize("block", [7, 64])
def test_schedule_slot_by_slot(spark, block):
    rng = random.Random(block)
    docs = [(k, rng.choice(["a", "b", "b", "b", None, "dé"]), " ".join(["w"] * rng.randrange(0, 60))) for k in range(150)] + [(900, "empty", None)]
    m = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), block_words=block)
    known = sorted((r.src, r.source_size, round(r.target)) for r in m.targets.collect())
    got = sorted((r.slot, r.src, r.rank, r.epoch, r.block, r.words) for r in m.slots.collect())
    assert got == scheduled(known, block) and len({r[1] for r in got}) == 4
    assert sum(r[5] for r in got) == sum(words for _, _, words in known)
    # A document takes the words of its pieces, as often as slots take their blocks.
    used = collections.defaultdict(list)
    for _, src, _, _, k, words in got:
        used[src, k].append(words)
    want = collections.Counter()
    for p in m.sized.collect():
        for k in range(p.start // block, -(-(p.start + p.size) // block)) if p.size else ():
            lo, hi = max(p.start, k * block) - k * block, min(p.start + p.size, (k + 1) * block) - k * block
            want[p.doc_id] += sum(max(0, min(hi, w) - lo) for w in used[p.src, k])
    taken = {r.doc_id: r.taken for r in mixing.taken(m, block).collect()}
    assert taken == {i: want[i] for i, _, _ in docs}
