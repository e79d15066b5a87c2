"""SentencePiece encoding and decoding as a weighted finite-state transducer.

T = normaliser o lexicon o pairs. The normaliser maps a space to the space mark and puts one in front. The lexicon is a trie of the pieces: reading a
piece writes its id at weight 1; a character without a piece writes its byte ids at weight 1 each. `pairs` is an acceptor over piece sequences:
state = last piece, and the arc to the next piece exists only if merging their joined characters by the model's scores gives back just these two.
A sequence whose neighbours all pass is the one that byte-pair merging yields, so the composition with an input has one finite path and the tropical
(min, +) shortest path through it is the model's encoding. The composition is expanded lazily, longest arc first, and states from which no path goes on are
remembered; as there is one finite path, the first one found is the shortest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import WordTable, held_table, id_text, slices, split_all

SPACE = "▁"
CACHED_WORDS = 300_000
CACHED_PAIRS = 500_000


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.lexicon = {p: i for i, p in enumerate(self.pieces) if not (i in self.byte_of or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.lexicon.items()}
        self.prefixes = {p[:k] for p in self.lexicon for k in range(1, len(p) + 1)}
        probe = "  Aé ﬁ\t① "
        if len(self.byte_id) != 256 or sp.normalize(probe) != self.normalise(probe):
            raise ValueError("only models with byte fallback and the plain normaliser (space marks, one in front) are compiled")
        if odd := next((p for p in self.lexicon if re.search(f"[^{SPACE}]{SPACE}", p)), None):
            raise ValueError(f"piece {odd!r} crosses a word boundary")
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.text_of = [p.replace(SPACE, " ") for p in self.pieces]
        inside = {p[i:i + 2] for p in self.lexicon for i in range(len(p) - 1)}
        self.joins = inside  # neighbouring characters that some piece holds; between others every path has a state
        self.whole: dict[str, int] = {}  # piece -> id, -1 where merging its characters gives something else
        self.passes: dict[int, bool] = {}
        self.runs = re.compile(rf"{SPACE}*[^\W\d_]+|[\W\d_]+?(?={SPACE}*[^\W\d_]|$)", re.DOTALL)
        self.parts = WordTable(lambda new: list(map(self.shortest, new)), CACHED_WORDS)
        self.known = WordTable(self._learn, CACHED_WORDS)

    @staticmethod
    def normalise(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """Reference merging of a short string: the best-scored adjacent pair first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _pair(self, a: str, b: str, key: int) -> bool:
        if len(self.passes) >= CACHED_PAIRS:
            self.passes.clear()
        self.passes[key] = ok = self.merged(a + b) == [a, b]
        return ok

    def _arcs(self, w: str, at: int) -> list[tuple[int, int, str]]:
        """(end, id, piece) of the lexicon's arcs from a position, longest last. Id -1: no piece, the character's bytes."""
        if w[at] not in self.lexicon:
            return [(at + 1, -1, w[at])]
        out, prefixes, whole = [], self.prefixes, self.whole
        for end in range(at + 1, len(w) + 1):
            piece = w[at:end]
            if piece not in prefixes:
                break
            i = whole.get(piece)
            if i is None:
                i = whole[piece] = self.lexicon[piece] if piece in self.lexicon and self.merged(piece) == [piece] else -1
            if i >= 0:
                out.append((end, i, piece))
        return out

    def shortest(self, w: str) -> tuple[int, ...]:
        """Ids on the finite path of a string, by depth-first expansion of (position, last piece) states."""
        n, passes = len(w), self.passes
        dead: set[tuple[int, int]] = set()
        path: list[tuple[int, int, str]] = [(0, -1, "")]
        arcs = [self._arcs(w, 0)]
        while True:
            at, last, text = path[-1]
            if at == n:
                break
            step = None
            while arcs[-1]:
                end, i, piece = arcs[-1].pop()
                if (end, i) in dead:
                    continue
                if last >= 0 and i >= 0:
                    ok = passes.get(key := last << 20 | i)
                    if not (self._pair(text, piece, key) if ok is None else ok):
                        continue
                step = (end, i, piece)
                break
            if step is None:
                if len(path) == 1:
                    raise ValueError(f"no path for {w!r}")
                dead.add((at, last))
                path.pop()
                arcs.pop()
            else:
                path.append(step)
                arcs.append(self._arcs(w, step[0]) if step[0] < n else [])
        ids: list[int] = []
        for _, i, piece in path[1:]:
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
        return tuple(ids)

    def _learn(self, new: list[str]) -> list[tuple[int, ...]]:
        """Ids of new words, put together from the stretches between characters that no piece joins."""
        joins, plans = self.joins, []
        for w in new:
            runs = self.runs.findall(w)
            parts = [runs[0]]
            for r in runs[1:]:
                if parts[-1][-1] + r[0] in joins:
                    parts[-1] += r
                else:
                    parts.append(r)
            plans.append(parts)
        self.parts.hold({x for p in plans for x in p})
        out = [self.parts[p[0]] if len(p) == 1 else tuple(i for x in p for i in self.parts[x]) for p in plans]
        self.parts.settle()
        return out

    def encode_all(self, texts: Iterable[str]) -> list[list[int]]:
        out = []
        for parts in split_all(texts, self._words, self.known):
            ids: list[int] = []
            for words in parts:
                for w in map(self.known.__getitem__, words):
                    ids += w
            out.append(ids)
        self.known.settle()
        return out

    def _words(self, text: str) -> list[str]:
        return self.chunks.findall(self.normalise(text))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: Sequence[int]) -> str:
        """The inverse transduction: bytes are joined (broken ones become U+FFFD), marks become spaces, the one in front goes."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.text_of.__getitem__, ids))
        else:
            out, raw = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw = bytearray()
                out.append(self.text_of[i])
            text = "".join([*out, raw.decode("utf-8", "replace")])
        return text[1:] if text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    """One transducer per worker process: what it has learnt serves the next task."""
    return held_table(("transducer", path), lambda: Transducer(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each document. A null text counts as empty and has no id; repeated rows give repeated rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for frame in frames:
            for some in slices(frame, chars=500_000):
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "ids": t.encode_all(some["text"])})

    return id_text(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids are empty."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").to_numpy(), "text": ["" if x is None else t.decode(x) for x in frame["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def audit(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_ids, n_byte_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_equal
    (the decoded text is the text, with space marks of the text read as spaces)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(path)
        for frame in frames:
            for some in slices(frame, chars=500_000):
                rows = []
                for doc_id, text, ids in zip(some["doc_id"], some["text"], t.encode_all(some["text"]), strict=True):
                    raw = np.array(ids, dtype="<u4")
                    rows.append((doc_id, len(ids), int(((raw >= min(t.byte_of)) & (raw <= max(t.byte_of))).sum()), zlib.crc32(raw.tobytes()), t.decode(ids) == text.replace(SPACE, " ")))
                yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_equal"]).astype({"doc_id": "Int64"})

    return id_text(docs).mapInPandas(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_equal boolean")
