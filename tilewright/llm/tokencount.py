"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists the pieces that end at each character, longest first. The search
keeps, for each position, the best score and the number of pieces on its path, never the path. Ties
go as in the tokenizers library: a later candidate replaces an earlier one only if it scores higher,
so of equal scores the longest last piece wins; an unknown character costs the lowest score less 10
and counts its UTF-8 bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Counts of words are kept by each Python worker, this many at most.
CACHE_WORDS = 300_000
#: Positions of a chunk that no piece reaches any more go after so many.
TRIM = 4_096


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file, read on the driver; its size is that of the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = tuple((sp.id_to_piece(i), float(sp.get_score(i))) for i in range(n) if not sp.is_control(i))
    return Vocabulary(pieces, all(any(p == f"<0x{b:02X}>" for p, _ in pieces[:300]) for b in range(256)))


class Counting:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in vocabulary.pieces)
        self.unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        self.cache: dict[str, tuple[int, float]] = {}

    def chunk(self, s: str) -> tuple[int, float]:
        """Pieces and score of one chunk (a word with its space sign), in memory of the longest piece's length, however long the chunk."""
        best, count, lost = [0.0], [0], False
        matches = self.automaton.iter(s)
        ahead = next(matches, None)
        for end, char in enumerate(s):
            top, single = None, False
            while ahead is not None and ahead[0] == end:
                length, score = ahead[1]
                single |= length == 1
                x = best[-length] + score
                if top is None or x > top:
                    top, c, u = x, count[-length] + 1, False
                ahead = next(matches, None)
            if not single:
                x = best[-1] + self.unknown
                if top is None or x > top:
                    top, u = x, True
                    c = count[-1] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not lost))
            best.append(top)
            count.append(c)
            lost = u
            if len(best) > self.longest + TRIM:
                del best[: -self.longest], count[: -self.longest]
        return count[-1], best[-1]

    def text(self, text: str | None) -> tuple[int, int, float]:
        """(chunks, pieces, score). Chunks begin at each space; one is put before the text if it has none."""
        if not text:
            return 0, 0, 0.0
        text = text.replace(SPACE, " ")
        words = Counter((text[1:] if text[0] == " " else text).split(" "))
        chunks = pieces = 0
        total = 0.0
        cache = self.cache
        for w, k in words.items():
            got = cache.get(w)
            if got is None:
                got = self.chunk(SPACE + w)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(w) < 100:
                    cache[w] = got
            chunks += k
            pieces += k * got[0]
            total += k * got[1]
        return chunks, pieces, total


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chunks, n_tokens, score of every whole text.

    Null and empty texts have no tokens and score 0. Repeated rows and ids keep a row each, and equal
    texts count equal; ties of score go as at the top of this module. Words and texts of any length are
    read whole. Other input columns, whatever their names, are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's own size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(shared.value)
        for batch in batches:
            rows = [counting.text(t.as_py()) for t in batch.column("text")]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["doc_id", "n_chunks", "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(count, f"doc_id {kind}, n_chunks bigint, n_tokens bigint, score double")
