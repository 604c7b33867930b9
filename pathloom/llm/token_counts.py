"""Token counts by a unigram vocabulary: Viterbi that keeps no pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, column, kept

MARK = "▁"
#: What an unknown character scores below the worst piece.
UNKNOWN = 10.0


def text_pieces(path: str) -> list[tuple[str, float]]:
    """The vocabulary without the pieces that are no text: control, unknown, unused and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return [piece for i, piece in enumerate(vocabulary(path)) if not odd(i)]


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with scores of a sentencepiece model file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Numbers of tokens that a unigram tokenizer gives, without the tokens.

    White space U+0020 becomes the mark, one is put before a text that starts
    without, and the text is cut before each mark. In a word an Aho-Corasick
    automaton finds all pieces; going through their ends, each place keeps the
    best score of a way there and its number of tokens. Of equal scores the
    one whose last piece starts first wins. A character that is no piece
    scores ``UNKNOWN`` below the worst piece and counts as its UTF-8 bytes
    (byte fallback). These are the rules of the tokenizers library's unigram
    model. Counts of words are kept, up to ``max_words`` of them.
    """

    def __init__(self, pieces: list[tuple[str, float]], max_words: int = 300_000, max_chars: int = 16_000_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.singles = set()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.max_words, self.max_chars = max_words, max_chars
        self.known, self.chars = _Known(self), 0

    def word(self, word: str) -> int:
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        done = 0  # places up to here are settled
        unknown, singles = self.unknown, self.singles

        def unseen(upto: int) -> None:
            """Settles places at which no piece ends."""
            nonlocal done
            while done < upto:
                best[done + 1] = best[done] + unknown
                count[done + 1] = count[done] + len(word[done].encode("utf-8", "surrogatepass"))
                done += 1

        at, top, tokens = -1, 0.0, 0
        ends: list[tuple[int, list[tuple[int, float]]]] = []
        for end, piece in self.automaton.iter(word):
            if end != at:
                ends.append((end, []))
                at = end
            ends[-1][1].append(piece)
        for end, found in ends:
            unseen(end)
            found.sort(reverse=True)  # the longest first: it starts first
            length, score = found[0]
            top, tokens = best[end + 1 - length] + score, count[end + 1 - length] + 1
            for length, score in found[1:]:
                other = best[end + 1 - length] + score
                if other > top:
                    top, tokens = other, count[end + 1 - length] + 1
            if word[end] not in singles and (other := best[end] + unknown) > top:
                top, tokens = other, count[end] + len(word[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, tokens
            done = end + 1
        unseen(n)
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.known) > self.max_words or self.chars > self.max_chars:
            self.known, self.chars = _Known(self), 0
        text = text.replace(" ", MARK)
        words = text.split(MARK)
        if not words[0]:
            del words[0]  # the text starts with the mark
        return sum(map(self.known.__getitem__, words))


class _Known(dict):
    """Counts of words without their mark."""

    def __init__(self, owner: UnigramCounter):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        self[word] = n = self.owner.word(MARK + word)
        self.owner.chars += len(word)
        return n


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]] | str, text_col: str = "text", to: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text in column ``to``.

    ``pieces`` is a vocabulary or the path of a sentencepiece model on each
    machine, of which the pieces that are text are taken with their scores.
    Scores are read as log probabilities. A model of another kind may be given
    too: the scores of a BPE model are minus the ranks of its merges, so the
    counts are those of the unigram rule over its pieces (the way with the
    least sum of ranks) and not those of its merges. One pass without a
    shuffle. All other columns are kept; null and empty texts count 0, and
    texts of any length are read whole; rows neither come nor go, and no rows
    give no rows.
    """
    others = [c for c in docs.columns if c != to]
    kind = T.StructType([docs.schema[c] for c in others] + [T.StructField(to, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(pieces, lambda: UnigramCounter(text_pieces(pieces))) if isinstance(pieces, str) else UnigramCounter(pieces)
        for batch in blocks(batches, text_col, 2 << 20):
            counts = pa.array([counter.text(x) for x in column(batch, text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*others, to])

    return docs.select(*(F.col(f"`{c}`") for c in others)).mapInArrow(run, kind)
