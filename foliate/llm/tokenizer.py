"""Byte-level BPE ids of whole texts through the ``tokenizers`` library, with pieces remembered.

The pre-tokenizer's pattern never matches across a single space that stands
before a non-space, nor across a newline between two non-spaces. A text cut
there encodes to the same ids piece by piece. Arrow splits a batch into pieces
(words, mostly) and numbers the different ones; only those are looked up or
encoded, and numpy puts their ids together.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SAFE = re.compile(r"(?= \S)")
_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, most: int = 12 << 20) -> PieceEncoder:
    """The worker's encoder for the vocabulary at ``path``."""
    if (path, most) not in _encoders:
        _encoders[path, most] = PieceEncoder(path, most)
    return _encoders[path, most]


def safe_chunks(text: str, size: int = 1 << 15) -> list[str]:
    """``text`` in chunks of ``size`` characters or more, cut only where no token can span the cut."""
    out, at = [], 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of texts after each of which ``end_id`` stands."""
    out = np.full(len(ids) + len(counts), end_id, dtype="<u4")
    own = np.ones(len(out), dtype=bool)
    own[np.cumsum(counts + 1) - 1] = False
    out[own] = ids
    return out, counts + 1


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs of ``sizes`` from ``starts`` on, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Remembered:
    """Pieces and their ids, in arrays. Beyond ``most`` bytes only the pieces of the last batch are kept."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.pieces = pa.array([], pa.string())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def look_up(self, pieces: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where in ``starts`` and ``sizes`` each of different ``pieces`` is; those not known are encoded first."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(at.is_null())
        known = len(self.pieces)
        if len(new):
            ids, sizes = encode(new.to_pylist())
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, ids))
        out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out[out < 0] = known + np.arange(len(new))
        if self.pieces.nbytes + 4 * len(self.ids) > self.most:
            self.ids = self.ids[runs(self.starts[out], self.sizes[out])]
            self.sizes = self.sizes[out]
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.pieces, out = pieces, np.arange(len(pieces))
        return out


class PieceEncoder:
    """Ids as unsigned 32-bit integers; about ``most`` bytes of pieces and ids are remembered in each generation."""

    def __init__(self, path: str, most: int) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.spaced = Remembered(most)  # what follows a space -> ids with that space
        self.first = Remembered(most)  # what begins a line -> ids
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
        self.sentence_end = np.zeros(len(self.width), dtype=bool)
        for token, i in vocab.items():
            self.width[i] = len(token)  # one character stands for one byte
            self.sentence_end[i] = token[-1:] in ".!?" or "Ċ" in token
        self.newline = self.direct("\n")

    def direct(self, text: str) -> np.ndarray:
        encoded = self.lib.encode_batch_fast(safe_chunks(text), add_special_tokens=False)
        return np.concatenate([np.array(e.ids, dtype="<u4") for e in encoded])

    def together(self, pieces: list[str], space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, end to end, and how many each has, from encodings of many joined at safe boundaries."""
        out, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            text = "".join([" " + p for p in part]) if space else "\n".join(part)
            (e,) = self.lib.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            ends = np.cumsum(self.width[ids])
            sizes = np.array([len(p) if p.isascii() else len(p.encode()) for p in part], dtype=np.int64) + 1
            stop = np.searchsorted(ends, np.cumsum(sizes) - (0 if space else 1), side="left") + 1
            start = np.concatenate(([0], stop[:-1] + (0 if space else 1)))
            out.append(ids if space else ids[runs(start, stop - start)])
            counts.append(stop - start)
        return np.concatenate(out), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, end to end, and how many each text has; a null counts as empty."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        pieces = words.flatten().dictionary_encode()
        code = pieces.indices.to_numpy()
        line_at, text_at = words.offsets.to_numpy(), lines.offsets.to_numpy()
        line_at, text_at = line_at - line_at[0], text_at - text_at[0]
        different = len(pieces.dictionary)
        edge = lambda a, b: pc.utf8_is_space(pc.utf8_slice_codeunits(pieces.dictionary, a, b)).to_numpy(zero_copy_only=False)
        empty = pc.equal(pieces.dictionary, "").to_numpy(zero_copy_only=False)
        begin, end = edge(0, 1) | empty, edge(-1, None) | empty
        # A text with a piece that is empty, or begins a line or piece with white space, or ends a line so, goes to the library whole.
        odd = begin[code]
        odd[line_at[1:] - 1] |= end[code[line_at[1:] - 1]]
        piece_at = line_at[text_at]
        odd_text = np.logical_or.reduceat(odd, piece_at[:-1]) if n else np.zeros(0, bool)
        kind = np.full(len(code), 2, dtype=np.int64)  # 2: after a space, 1: after a newline, 0: at the text's start
        kind[line_at[:-1]] = 1
        kind[piece_at[:-1]] = 0
        keep = np.repeat(~odd_text, np.diff(piece_at))
        slot = (code.astype(np.int64) * 3 + kind)[keep]
        used = np.zeros(3 * different, dtype=bool)
        used[slot] = True
        spaced, first = np.flatnonzero(used[2::3]), np.flatnonzero(used[0::3] | used[1::3])
        begins = self.first.look_up(pieces.dictionary.take(pa.array(first)), lambda x: self.together(x, False))
        places = self.spaced.look_up(pieces.dictionary.take(pa.array(spaced)), lambda x: self.together(x, True))
        # All known ids end to end: a newline's, those of pieces that begin lines, those of pieces after a space.
        flat = np.concatenate((self.newline, self.first.ids, self.spaced.ids))
        n_new, n_first = len(self.newline), len(self.first.ids)
        start, size = np.zeros(3 * different, dtype=np.int64), np.zeros(3 * different, dtype=np.int64)
        start[3 * spaced + 2], size[3 * spaced + 2] = n_new + n_first + self.spaced.starts[places], self.spaced.sizes[places]
        for k in (0, 1):
            start[3 * first + k], size[3 * first + k] = n_new + self.first.starts[begins], self.first.sizes[begins]
        starts, sizes = start[slot], size[slot]
        line = np.flatnonzero(slot % 3 == 1)  # a newline stands before these
        starts, gaps = np.insert(starts, line, 0), np.insert(sizes, line, n_new)
        ids = flat[runs(starts, gaps)]
        sizes[line] += n_new
        per_piece = np.zeros(len(code), dtype=np.int64)
        per_piece[keep] = sizes
        counts = np.add.reduceat(per_piece, piece_at[:-1]) if n else np.zeros(0, np.int64)
        if odd_text.any():  # put the others' ids between those of the texts left out
            parts, done = [], np.concatenate(([0], np.cumsum(counts)))
            last = 0
            for k in np.flatnonzero(odd_text).tolist():
                own = self.direct(texts[k].as_py()) if len(texts[k].as_py()) else np.zeros(0, "<u4")
                parts += [ids[done[last] : done[k]], own]
                counts[k], last = len(own), k + 1
            ids = np.concatenate([*parts, ids[done[last] :]])
        return ids, counts
