"""Token ids by the ``tokenizers`` library, from pieces that are encoded once per task.

A byte-level BPE never joins a white-space character to the visible character before it, nor ASCII punctuation (but
the apostrophe) to a letter or digit before it. So a text may be cut at these places, and the ids of the text are the
ids of its pieces in order. The bytes of a column are cut as a whole and each distinct piece is looked up once. Prose
repeats its words, so a bounded cache holds the ids of short pieces; the misses go to the library many in one text, whose
ids are told apart by the bytes that each stands for. Texts with other white space (which the rule does not cover) go to
the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wikiloom.llm.caches import own_cache

#: White space (in any reading of Unicode) other than blank, tab, line feed and carriage return.
OTHER_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
#: Pieces of more bytes are not cached.
LONGEST_CACHED = 48
#: So many pieces are one text for the library.
JOINED = 200
_SPACE, _WORD, _PUNCTUATION = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t\n\r")] = _SPACE
_KINDS[[b for b in range(128) if chr(b).isalnum()]] = _WORD
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _PUNCTUATION


def piece_starts(data: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of texts that follow one another; ``ends``: of the texts, ``whole``: those left uncut.

    A piece is a run of white space, then a word that ends before punctuation, or else all that is visible; what follows
    such a word up to white space is a piece too.
    """
    kind = _KINDS[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)  # the letters from À to ÿ
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _WORD
    first = np.zeros(len(data), bool)
    begins = np.r_[0, ends[:-1]]
    first[begins[begins < ends]] = True
    space = kind == _SPACE
    after = np.r_[True, space[:-1]]
    starts = first | (space & ~after)
    stops = (kind != _WORD) | first
    words = np.flatnonzero((kind == _WORD) & (first | after))
    stop = np.r_[np.flatnonzero(stops), len(data)][np.cumsum(stops, dtype=np.int32)[words]]  # the first one behind
    stop = stop[stop < len(data)]
    starts[stop[kind[stop] == _PUNCTUATION]] = True
    for i in np.flatnonzero(whole):
        starts[begins[i] + 1 : ends[i]] = False
    return np.flatnonzero(starts)


class PieceEncoder:
    """Encodes texts with one tokenizer file. ``cache_size`` bounds the cached pieces, ``batch_bytes`` a library call.

    Half of the cache holds the pieces seen last; when it is full it becomes the other half, from which a piece that is
    seen again comes back. So words stay and pieces that occur once go.
    """

    def __init__(self, path: str, cache_size: int = 160_000, batch_bytes: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.halves: dict[str, dict[bytes, bytes]] = {"new": {}, "old": {}}
        self.cache_size, self.batch_bytes = cache_size, batch_bytes
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        #: The bytes that each id stands for: in the vocabulary a character is a byte.
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(added[i].encode()) if i in added else len(token)

    def _batches(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, by the library."""
        batch: list[str] = []
        held = 0
        for text in [*texts, None]:
            if batch and (text is None or held + len(text) > self.batch_bytes):
                for e in self.library.encode_batch_fast(batch, add_special_tokens=False):
                    yield array("I", e.ids).tobytes()
                batch, held = [], 0
            if text is not None:
                batch.append(text)
                held += len(text)

    def _library(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each piece. Pieces that begin with white space and end without are joined: between them a text may be
        cut. Where an id nevertheless reaches over an end, each piece of that text is encoded by itself."""
        joined, alone = [], []
        for p in pieces:
            (joined if len(p) <= LONGEST_CACHED and _KINDS[p[0]] == _SPACE != _KINDS[p[-1]] else alone).append(p)
        groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        out: dict[bytes, bytes] = {}
        for group, ids in zip(groups, self._batches([b"".join(g).decode() for g in groups]), strict=True):
            reached = np.cumsum(self.lengths[np.frombuffer(ids, np.uint32)])
            ends = np.cumsum([len(p) for p in group])
            at = np.searchsorted(reached, ends)
            if reached[-1] != ends[-1] or (reached[at] != ends).any():
                alone += group
                continue
            cuts = [0, *(4 * (at + 1)).tolist()]
            out.update(zip(group, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        out.update(zip(alone, self._batches([p.decode() for p in alone]), strict=True))
        return out

    def encode_column(self, column: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts (null: empty) one after another, as little-endian unsigned 32-bit numbers, and the bytes
        among them up to the end of each text."""
        own_cache(self.halves, 2)
        if not self.halves:
            self.halves |= {"new": {}, "old": {}}
        column = pc.fill_null(column, "").cast(pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        ends = bounds[1:] - bounds[0]
        if not len(ends) or not ends[-1]:
            return memoryview(b""), np.zeros(len(ends), np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        starts = piece_starts(data, ends, pc.match_substring_regex(column, OTHER_SPACE).to_numpy(zero_copy_only=False))
        offsets = np.r_[starts, len(data)].astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = self._lookup(pieces.dictionary.to_pylist())
        ids = pa.array(known, pa.large_binary()).take(pieces.indices)
        reached = np.frombuffer(ids.buffers()[1], np.int64)[: len(starts) + 1]
        return memoryview(ids.buffers()[2]), reached[np.searchsorted(offsets, ends)]

    def _lookup(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, from the cache or the library."""
        new, old = self.halves["new"], self.halves["old"]
        ids = list(map(new.get, pieces))
        lacking = [i for i, x in enumerate(ids) if x is None]
        missing = []
        for i in lacking:
            if (x := old.get(pieces[i])) is None:
                missing.append(pieces[i])
            else:
                ids[i] = new[pieces[i]] = x
        found = self._library(missing)
        for i in lacking:
            if ids[i] is None:
                ids[i] = found[pieces[i]]
        new.update((p, x) for p, x in found.items() if len(p) <= LONGEST_CACHED)
        if len(new) > self.cache_size // 2:
            self.halves |= {"new": {}, "old": new}
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        group: list[str] = []
        held = 0
        for text in [*texts, None]:
            if group and (text is None or held > 4 * self.batch_bytes):
                ids, ends = self.encode_column(pa.array(group, pa.large_string()))
                start = 0
                for end in ends.tolist():
                    yield bytes(ids[start:end])
                    start = end
                group, held = [], 0
            if text is not None:
                group.append(text)
                held += len(text)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker, so that its cache serves them all."""
    return PieceEncoder(path)
