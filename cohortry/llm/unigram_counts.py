"""Count-only Viterbi: token counts of a unigram vocabulary without building the tokens.

Aho-Corasick enumerates every vocabulary match; dynamic programming carries (best score, number of pieces) per position.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from .common import WordTable, held_table, id_text, slices, split_all

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file; byte, control and unknown pieces never match text and are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


class Counter:
    """Tie rules of the unigram tokenizer: a later candidate replaces an earlier one only when its score is strictly larger, candidates of one
    end come by ascending start, and an unknown character (lowest score - 10, counted as its UTF-8 bytes) is tried where no one-character piece exists.

    Text is split before a space mark that follows another character. That is exact as no piece holds a mark after another character (checked) and
    scores are integers or few enough not to round; words are then counted once and remembered in a bounded table.
    """

    def __init__(self, vocab: Sequence[tuple[str, float]]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in vocab:
            if re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError(f"piece {piece!r} crosses a word boundary")
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        if odd := next((p for p, _ in vocab if len(p) > 1 and not self.single.issuperset(p)), None):
            raise ValueError(f"piece {odd!r} holds a character that is no piece")
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.known = WordTable(lambda new: list(map(self.word, new)), CACHED_WORDS)

    def word(self, w: str) -> int:
        n = len(w)
        score: list[float | None] = [0.0, *[None] * n]
        pieces = [0] * (n + 1)
        closed = 0  # positions up to here have had their unknown character tried
        for last, (length, s) in self.found.iter(w):
            end = last + 1
            while closed < last:
                self._close(w, closed, score, pieces)
                closed += 1
            if (at := score[end - length]) is not None and ((best := score[end]) is None or at + s > best):
                score[end] = at + s
                pieces[end] = pieces[end - length] + 1
        while closed < n:
            self._close(w, closed, score, pieces)
            closed += 1
        return pieces[n]

    def _close(self, w: str, i: int, score: list, pieces: list[int]) -> None:
        if w[i] not in self.single:
            if score[i + 1] is None or score[i] + self.unknown > score[i + 1]:
                score[i + 1] = score[i] + self.unknown
                pieces[i + 1] = pieces[i] + len(w[i].encode("utf-8", "surrogatepass"))

    def counts(self, texts: Iterable[str]) -> list[tuple[int, int]]:
        """(words, tokens) per text; an empty text has none."""
        look = self.known.__getitem__
        out = [(sum(map(len, parts)), sum(sum(map(look, words)) for words in parts)) for parts in split_all(texts, self._words, self.known)]
        self.known.settle()
        return out

    def _words(self, text: str) -> list[str]:
        return self.chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> tuple[int, int]:
        return self.counts([text])[0]


def counter_of(path: str) -> Counter:
    """One counter per worker process: what it has learnt serves the next task."""
    return held_table(("token counter", path), lambda: Counter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_chars, n_words, n_tokens. A null text counts as empty, an empty one has no token; repeated rows give repeated
    rows and a null doc_id stays null. Row-wise: no shuffle, memory bounded by a slice of texts and the word table."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(path)
        for frame in frames:
            for some in slices(frame):
                both = counter.counts(some["text"])
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "n_chars": some["text"].str.len().to_numpy(), "n_words": [a for a, _ in both], "n_tokens": [b for _, b in both]})

    return id_text(docs).mapInPandas(run, "doc_id long, n_chars long, n_words long, n_tokens long")
