"""Encoding of texts by pieces, whose encodings are remembered."""

from __future__ import annotations

import gc
import threading
import time
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Begins the first piece of a text, and a piece that had neither a space nor a line feed before it.
_FIRST, _TIED = "\x02", "\x01"
#: Texts are cut before these, where a letter or a digit stands before them: pretokens never go over that border.
_MARKS = ".,;:!?"
_BORDER = f"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([{_MARKS}])"
#: Pieces remembered, how many of them are new before they are filed, and the length from which a piece is not remembered.
REMEMBERED, FRESH, LONG = 400_000, 50_000, 60
#: Seconds without work after which a worker forgets.
IDLE = 10
#: Pieces whose ids are gathered at a time.
GATHERED = 1 << 18


class Pieces:
    """Encodes texts by pieces.

    encode gives the encodings of a list of strings. Texts are cut at single spaces and line feeds, and between a letter or digit
    and a mark of _MARKS. A piece begins with its space or line feed, if it has one. The cuts are exact where a space or line
    feed stands between two characters that aren't white space; a text with any other, or with one of the characters that begin
    pieces, is encoded as a whole. So are all texts if a special token holds a character at which texts are cut.

    Pieces are numbered and looked up by Arrow and their ids gathered by numpy, so Python sees only pieces that are new. These
    are filed, as an array of strings and one of ids, whenever there are FRESH of them; beyond REMEMBERED, filed pieces that
    haven't been met since the last time are dropped. A worker that has nothing to encode for IDLE seconds forgets all of them,
    so that what other stages do in it has that memory.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED, fresh: int = FRESH, special: Iterable[str] = ()) -> None:
        self.encode, self.remembered, self.most_fresh = encode, remembered, fresh
        self.cuts = not any(c in t for t in special for c in f" \n{_MARKS}{_TIED}{_FIRST}")
        self.forgetful: list[Callable[[], None]] = [self.forget]
        self.used, self.watch = 0.0, None
        self.forget()

    def forget(self) -> None:
        self.filed = _Filed(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4"))
        self.fresh: dict[str, bytes] = {}

    def _touch(self) -> None:
        self.used = float("inf")  # nothing is forgotten while texts are encoded
        if self.watch is None:
            self.watch = threading.Thread(target=self._wait, daemon=True)
            self.watch.start()

    def _wait(self) -> None:
        while time.monotonic() - self.used < IDLE:
            time.sleep(1)
        self.watch = None
        for forget in self.forgetful:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()

    def _new(self, pieces: list[str]) -> list[bytes | None]:
        """Encodings of different pieces that aren't filed; None for those that can't be encoded by themselves."""
        fresh = self.fresh
        got = [*map(fresh.get, pieces)]
        spaced, other = [], []
        for k, ids in enumerate(got):
            if ids is not None:
                continue
            p = pieces[k]
            if p == _FIRST:
                got[k] = b""
            elif p and not p[-1].isspace():
                begin = p[0]
                if begin == _FIRST or begin == _TIED:
                    other.append((k, p[1:]))
                elif begin == "\n":
                    if not p[1].isspace():
                        other.append((k, p))
                elif not begin.isspace():
                    spaced.append(k)
        for at, texts in ((spaced, [" " + pieces[k] for k in spaced]), ([k for k, _ in other], [t for _, t in other])):
            for k, ids in zip(at, self.encode(texts)):
                got[k] = ids
                if len(pieces[k]) < LONG:
                    fresh[pieces[k]] = ids
        return got

    def _file(self) -> None:
        """Files the fresh pieces."""
        old, fresh = self.filed, self.fresh
        if len(old.pieces) + len(fresh) > self.remembered:
            old = old.kept(np.flatnonzero(old.met)[: self.remembered])
        sizes = np.fromiter((len(i) // 4 for i in fresh.values()), np.int64, len(fresh))
        pieces = pa.concat_arrays([old.pieces, pa.array([*fresh], pa.string())])
        self.filed = _Filed(pieces, np.concatenate([old.sizes, sizes]), np.concatenate([old.ids, np.frombuffer(b"".join(fresh.values()), "<u4")]))
        self.fresh = {}

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        given = pc.fill_null(given, "")
        if not len(given):
            return []
        self._touch()
        try:
            return self._of_all(given)
        finally:
            self.used = time.monotonic()

    def _of_all(self, given: pa.Array) -> list[bytes]:
        if not self.cuts:
            return self.encode(given.to_pylist())
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST), given, pa.scalar("")), "\n", " \n")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, _BORDER, f"\\1 {_TIED}\\2"), " ")
        pieces = lists.flatten().dictionary_encode()
        at, offsets, words = pieces.indices.to_numpy(), lists.offsets.to_numpy(), pieces.dictionary

        filed = self.filed
        place = pc.fill_null(pc.index_in(words, value_set=filed.pieces), -1).to_numpy().astype(np.int64)
        known, new = place >= 0, np.flatnonzero(place < 0)
        filed.met[place[known]] = True
        found = self._new(words.take(pa.array(new)).to_pylist())
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[known], starts[known] = filed.sizes[place[known]], filed.starts[place[known]]
        sizes[new] = np.fromiter((len(x) // 4 if x else 0 for x in found), np.int64, len(found))
        starts[new] = len(filed.ids) + np.cumsum(sizes[new]) - sizes[new]
        table = np.concatenate([filed.ids, np.frombuffer(b"".join(x for x in found if x), "<u4")])

        whole = pc.match_substring_regex(given, f"[{_TIED}{_FIRST}]").to_numpy(zero_copy_only=False)
        uneven = np.zeros(len(words), bool)
        uneven[new] = np.fromiter((x is None for x in found), bool, len(found))
        if uneven.any():
            whole = whole | (np.add.reduceat(uneven[at].astype(np.int64), offsets[:-1]) > 0)
        if len(self.fresh) >= self.most_fresh:
            self._file()
        out = _gathered(table, starts, sizes, at, offsets)
        rest = np.flatnonzero(whole).tolist()
        for k, ids in zip(rest, self.encode([given[k].as_py() for k in rest])):
            out[k] = ids
        return out


class _Filed:
    """Pieces with their ids: sizes and starts in one array, and which pieces were met."""

    def __init__(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.pieces, self.sizes, self.ids = pieces, sizes, ids
        self.starts = np.cumsum(sizes) - sizes
        self.met = np.zeros(len(sizes), bool)

    def kept(self, rows: np.ndarray) -> _Filed:
        sizes = self.sizes[rows]
        spots = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        return _Filed(self.pieces.take(pa.array(rows)), sizes, self.ids[spots])


def _gathered(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Ids of each text, whose pieces are at[offsets[k]:offsets[k + 1]]; some texts at a time, so that arrays stay small."""
    out: list[bytes] = []
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + GATHERED, "right")) - 1)
        own = at[offsets[k] : offsets[end]]
        lengths = sizes[own]
        ends = np.cumsum(lengths)
        spots = np.repeat(starts[own] - (ends - lengths), lengths)
        spots += np.arange(len(spots))
        raw = table[spots].tobytes()
        bounds = (4 * np.concatenate([[0], ends])[offsets[k : end + 1] - offsets[k]]).tolist()
        out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        k = end
    return out
