"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all pieces. One pass over a text visits its output links at each position:
every piece that ends there relaxes the best score of that position. The best segmentation has
the largest sum of piece scores; of equal sums the one with the longer last piece. A character
that no piece covers by itself is a fallback at 10 below the smallest usable score and becomes byte pieces.

Spaces become U+2581, and one is put in front of a text; a U+2581 of the text itself becomes
bytes, so decoding gives every text back exactly. No piece goes on past the end of a word, so a
text falls into words that are segmented on their own, each distinct one once (a table of bounded
size keeps them); if a vocabulary has pieces across words, whole texts are segmented.

Null and empty texts have no pieces. Texts of any length are handled; the search holds a window of a word, or of a text where
pieces go across words, however long it is. Rows that repeat are encoded alike. Columns of the input whose names clash with
the new ones (also in another case, unless the session tells cases apart) are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from .common import other_columns

SPACE = "▁"
#: Words that the table of one task keeps, and the longest of them.
WORDS_KEPT, WORD_LENGTH = 300_000, 48
#: Characters that one pass holds the best paths of; longer where these have not met.
WINDOW = 1 << 16


def vocabulary(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of each id of a model file; kind is normal, byte or special."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: p.is_unknown(i) or p.is_control(i) or p.is_unused(i)
    return [(p.id_to_piece(i), p.get_score(i), "byte" if p.is_byte(i) else "special" if special(i) else "normal") for i in range(p.get_piece_size())]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.singles: set[str] = set()
        chars: set[str] = set()
        scores = []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif kind == "special" or not piece:
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if piece not in self.automaton:
                    self.automaton.add_word(piece, (len(piece), score, i))
                scores.append(score)
                chars.update(piece)
                if len(piece) == 1:
                    self.singles.add(piece)
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte pieces: texts could not be given back")
        self.automaton.make_automaton()
        self.fallback = min((s for s in scores if s > -1e8), default=0.0) - 10.0
        self.longest = max((len(p) for p, _, k in pieces if k == "normal"), default=1)
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, k in pieces if k == "normal")
        self.cut_lines = "\n" not in chars
        self.known: dict[str, bytes] = {}

    def _scan(self, word: str) -> list[tuple[int, int]]:
        """For each position of the word the (length, id) of the piece that ends there on its best path; id -1: the fallback."""
        n = len(word)
        best, back = [0.0] + [-1e300] * n, [(0, -1)] * (n + 1)
        singles, at = self.singles, 0
        whole = singles.issuperset(word)
        for end, (length, score, i) in self.automaton.iter(word):
            end += 1
            if not whole:
                while at < end:
                    at += 1
                    if word[at - 1] not in singles:
                        best[at], back[at] = best[at - 1] + self.fallback, (1, -1)
            s = best[end - length] + score
            if s > best[end]:
                best[end], back[end] = s, (length, i)
        while not whole and at < n:
            at += 1
            if word[at - 1] not in singles:
                best[at], back[at] = best[at - 1] + self.fallback, (1, -1)
        return back

    def _path(self, word: str, back: list[tuple[int, int]], n: int, stand_in: str) -> list[int]:
        """Ids on the best path to position ``n``."""
        out = []
        while n > 0:
            length, i = back[n]
            n -= length
            if i >= 0:
                out.append(i)
            else:
                char = SPACE if word[n] == stand_in else word[n]
                out += [self.byte_id[b] for b in reversed(char.encode())]
        out.reverse()
        return out

    def viterbi(self, word: str, stand_in: str = "") -> list[int]:
        """Ids of the best segmentation. stand_in: what stands for a U+2581 of the text.

        A long word goes in windows: the best paths to the last positions of a window, on one of which every longer
        path goes on, are followed back to where they meet; what is before that is final.
        """
        out, at, window = [], 0, WINDOW
        while len(word) - at > window:
            part = word[at : at + window]
            back = self._scan(part)
            open_ = set(range(len(part) - self.longest + 1, len(part) + 1))
            while len(open_) > 1:
                end = max(open_)
                open_.remove(end)
                open_.add(max(0, end - back[end][0]))
            cut = open_.pop()
            if cut <= 0:
                window *= 2
                continue
            out += self._path(part, back, cut, stand_in)
            at, window = at + cut, WINDOW
        part = word[at:]
        return out + self._path(part, self._scan(part), len(part), stand_in)

    def _ids(self, word: str, stand_in: str) -> bytes:
        got = np.array(self.viterbi(word.replace(" ", SPACE), stand_in), np.int32).tobytes()
        if len(word) <= WORD_LENGTH and not (stand_in and stand_in in word):
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[word] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        stand_in = ""
        if SPACE in text:
            stand_in = next(c for c in map(chr, range(0xF0000, 0x110000)) if c not in text and c not in self.singles)
            text = text.replace(SPACE, stand_in)
        if not self.by_word:
            return np.array(self.viterbi((" " + text).replace(" ", SPACE), stand_in), np.int32)
        # a word has all the spaces before it; a line end that no piece holds is a word of its own
        if "  " in text or text[0] == " ":
            words = re.findall(r" +(?:[^ \n]+|(?=\n)|$)|[^ \n]+|\n" if self.cut_lines else r" +[^ ]*", " " + text)
        elif self.cut_lines:
            words = (" " + text.replace(" ", "\0 ").replace("\n", "\0\n\0")).split("\0") if "\0" not in text else re.findall(r" +(?:[^ \n]+|(?=\n)|$)|[^ \n]+|\n", " " + text)
        else:
            words = re.findall(r" +[^ ]*", " " + text)
        known, ids = self.known.get, self._ids
        return np.frombuffer(b"".join([known(w) or (ids(w, stand_in) if w else b"") for w in words]), np.int32)

    def decode(self, ids) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])[1:].decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The automaton of a broadcast vocabulary, built once in a worker."""
    if shared.value[0] not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.value[0]] = Codec(shared.value[1])
    return _CODECS[shared.value[0]]


def _lists(found: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32()), pa.array(flat, pa.int32()))


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _share(docs: DataFrame, pieces: list):
    return docs.sparkSession.sparkContext.broadcast((hash(tuple(pieces)), pieces))


def encode(docs: DataFrame, pieces: list[tuple[str, float, str]], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ids array<int>, n_pieces, and round_trip: whether decoding the ids gives the text (null as empty).

    Columns of those names are replaced; with ``keep_text`` False the text is left out.
    """
    shared = _share(docs, pieces)
    new = ("ids", "n_pieces", "decoded_sha256", "round_trip")
    kept, schema = other_columns(docs, new)
    keep = kept.columns
    at = keep.index(text_col)
    out = [c for c in keep if keep_text or c != text_col]
    if not keep_text:
        schema = other_columns(kept, (text_col,))[1]
    schema = ", ".join(x for x in (schema, "ids array<int>, n_pieces long, decoded_sha256 string, round_trip boolean") if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for whole in batches:
            for batch in _slices(whole):
                texts = batch.column(at).to_pylist()
                ids = [codec.encode(t) for t in texts]
                back = [codec.decode(x.tolist()) for x in ids]
                columns = [batch.column(i) for i, c in enumerate(keep) if c in out]
                more = [_lists(ids), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()), pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*columns, *more], names=[*out, *new])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: list[tuple[str, float, str]], ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids (null ids: null text); a column of that name is replaced."""
    shared = _share(encoded, pieces)
    kept, schema = other_columns(encoded, (text_col,))
    keep = kept.columns
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for whole in batches:
            for batch in _slices(whole):
                texts = [None if x is None else codec.decode(x) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, text_col])

    return kept.mapInArrow(run, f"{schema}, `{text_col}` string")
