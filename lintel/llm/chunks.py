"""Texts cut at spaces into chunks that a tokenizer treats alone; each distinct chunk is tokenized once and kept."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lintel.llm.common import slices

#: Chunks whose ids a Python worker keeps.
KEPT = 300_000
_SLICE = 4 << 20


class ChunkEncoder:
    """Token ids of whole texts.

    solve: ids (as bytes of int32) for each of a list of chunks. space: what a space, and the
    beginning of a text, is in a chunk. whole: ids of a text that is not to be cut;
    apart: a pattern of texts for which that is so. squeeze: whether several spaces count as one
    and those at both ends as none; else a chunk is a run of spaces with the word after it, or the
    run that ends a text.
    """

    def __init__(self, solve: Callable[[list[str]], list[bytes]], whole: Callable[[str], list[int]], apart: str, space: str, squeeze: bool):
        self.solve, self.whole, self.apart, self.space, self.squeeze = solve, whole, apart, space, squeeze
        self.kept: dict[str, bytes] = {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        kept = self.kept
        new = [c for c in chunks if c not in kept]
        if new:
            if len(kept) + len(new) > KEPT:
                kept.clear()
                new = chunks
            kept.update(zip(new, self.solve(new), strict=True))
        return [kept[c] for c in chunks]

    def _runs(self, offsets: np.ndarray, codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words of texts with several spaces in a row, which have empty words between them, as chunks."""
        at, none = np.arange(len(codes)), codes == words.index("")
        start = np.repeat(offsets[:-1], np.diff(offsets))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(none, -1, at))[:-1]]) if len(at) else at
        run = at - np.maximum(last + 1, start)
        ends = np.zeros(len(codes), bool)
        ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
        keep = ~none if self.squeeze else ~none | ends
        if self.squeeze:
            run[:] = 0
        pairs, which = np.unique((run * len(words) + codes)[keep], return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        return offsets, which, [self.space * (p // len(words) + 1) + words[p % len(words)] for p in pairs.tolist()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]. A null text has none, like an empty one."""
        sizes, out = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        for _, part in slices(texts, _SLICE):
            part = pc.fill_null(part, "")
            apart = pc.or_(pc.match_substring_regex(part, self.apart), pc.equal(part, "")).to_numpy(zero_copy_only=False)
            cut = pc.if_else(pa.array(apart), "", part)
            lists = pc.split_pattern(cut, " ")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            coded = pc.dictionary_encode(lists.flatten())
            codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
            if "" in words:
                offsets, codes, words = self._runs(offsets, codes, words)
            else:
                words = [self.space + w for w in words]
            table = self._ids(words)
            length = np.fromiter(map(len, table), np.int64, len(table)) // 4
            flat, start = np.frombuffer(b"".join(table), np.int32), np.cumsum(length) - length
            n = length[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(start[codes] - ends[:-1], n) + np.arange(ends[-1])] if len(codes) else flat[:0]
            bounds = ends[offsets]
            if apart.any():
                pieces = np.split(ids, bounds[1:-1])
                for i in np.flatnonzero(apart):
                    text = part[int(i)].as_py()
                    pieces[i] = np.array(self.whole(text) if text else [], np.int32)
                ids, count = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
            else:
                count = np.diff(bounds)
            sizes.append(count)
            out.append(ids)
        return np.cumsum(np.concatenate(sizes)), np.concatenate(out)
