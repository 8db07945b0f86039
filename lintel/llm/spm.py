"""SentencePiece encoding and decoding as a weighted finite-state transducer: normaliser, pieces and byte fallback, composed with each input.

The normaliser is a chain of transducers, each of which reads characters and writes characters:
rules (the longest first), then spaces (squeezed, the prefix, and what stands for a space). They
are composed state by state, as inputs come to need it, to one with a single transition a
character. The pieces are a trie with an output at the end of each piece, and from there back to
its beginning; the byte fallback has, for each character that is no piece, an arc that writes its
bytes. Composed with a text they are a lattice: its states are places in the normalised text, its
arcs pieces and fallbacks. The tropical-semiring shortest path through it are the text's ids.

For a unigram model an arc weighs what its piece's score is below 0, and the path is Viterbi's. For
a BPE model, whose result is no sum of scores, the pieces are composed with a second transducer that
remembers the last piece: an arc from piece u to piece v weighs 0 if merging the string uv gives just
u, v, and infinity otherwise. A sequence of pieces is the BPE result of its string if and only if
that holds for all neighbours (merges never cross the border of pieces that stay apart, so each
pair goes through the same merges alone as in the whole). So exactly one path is of finite weight,
and each place in a text that it can be cut at has exactly one last piece.

Texts of a column share their words: a text is cut before each run of spaces, as no piece goes on
from another character into a space, and each distinct chunk is composed and solved once, many of
them by the same steps together.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.chunks import ChunkEncoder
from lintel.llm.common import ship

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
#: Below the least score of a piece: what a character that is no piece weighs in a unigram model.
_PENALTY = 10.0
#: Chunks of up to so many characters are solved together.
_TOGETHER = 40
#: Columns of the trie's table: frequent characters, those of Latin scripts first.
_DENSE = 256
_SLOT_BITS = 20


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, 4 or 8 bytes, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a precompiled normaliser: a double-array trie of byte strings, and what they become."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size :]
    rules: dict[str, str] = {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    stack = [(offset(units[0]), b"")]
    while stack:
        base, path = stack.pop()
        for c in range(1, 256):
            at = base ^ c
            if at >= len(units) or units[at] & (1 << 31 | 255) != c:
                continue
            u, here = units[at], path + bytes([c])
            if u >> 8 & 1:
                start = units[at ^ offset(u)] & 0x7FFFFFFF
                rules[here.decode("utf-8", "replace")] = texts[start : texts.index(b"\0", start)].decode("utf-8", "replace")
            stack.append((at ^ offset(u), here))
    return rules


class Rules:
    """The transducer of rewriting rules: its states are what has been read and may yet become a longer rule's left side."""

    start = ""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules
        self.open = {k[:n] for k in rules for n in range(1, len(k))}

    def _settle(self, text: str, ended: bool) -> tuple[str, str]:
        """(written, state): rules from the left, the longest first, until what is left may become a longer one."""
        out = ""
        while text:
            if not ended and text in self.open:
                return out, text
            n = next((n for n in range(len(text), 0, -1) if text[:n] in self.rules), 0)
            out, text = (out + self.rules[text[:n]], text[n:]) if n else (out + text[0], text[1:])
        return out, ""

    def step(self, state: str, char: str) -> tuple[str, str]:
        return self._settle(state + char, False)

    def end(self, state: str) -> str:
        return self._settle(state, True)[0]


class Spaces:
    """The transducer of spaces: states are the beginning, within a text, and, where spaces are squeezed, after some of them."""

    start = "beginning"

    def __init__(self, prefix: bool, squeeze: bool, space: str):
        self.prefix, self.squeeze, self.space = space * prefix, squeeze, space

    def step(self, state: str, char: str) -> tuple[str, str]:
        if char != " ":
            return (self.prefix if state == "beginning" else self.space if state == "after" else "") + char, "within"
        if self.squeeze:
            return "", "beginning" if state == "beginning" else "after"
        return (self.prefix if state == "beginning" else "") + self.space, "within"

    def end(self, state: str) -> str:
        return ""


class Composed:
    """One transducer that does what a and then b do; transitions are made when first needed, and kept."""

    def __init__(self, a, b):
        self.a, self.b, self.start = a, b, (a.start, b.start)
        self.known: dict[tuple, tuple[str, tuple]] = {}

    def _through(self, text: str, state) -> tuple[str, object]:
        out = ""
        for c in text:
            more, state = self.b.step(state, c)
            out += more
        return out, state

    def step(self, state: tuple, char: str) -> tuple[str, tuple]:
        if (found := self.known.get((state, char))) is None:
            written, one = self.a.step(state[0], char)
            out, two = self._through(written, state[1])
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[state, char] = found = out, (one, two)
        return found

    def end(self, state: tuple) -> str:
        out, two = self._through(self.a.end(state[0]), state[1])
        return out + self.b.end(two)


class Transducer:
    """A compiled model. weights: scores by id. `encode` and `decode` are for one text; ChunkEncoder and decode_many for columns."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.bpe = trainer.get(3, _UNIGRAM) == _BPE
        if trainer.get(3, _UNIGRAM) not in (_UNIGRAM, _BPE) or {_USER, _UNUSED} & set(self.kinds):
            raise ValueError("only unigram and BPE models without user-defined and unused pieces are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.rules = charsmap_rules(normaliser.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.vocabulary = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _NORMAL}
        self.unknown = self.kinds.index(_UNKNOWN)
        byte = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if self.byte_fallback else []
        self.longest = max(map(len, self.vocabulary), default=1)
        self.least = min((self.scores[i] for i in self.vocabulary.values()), default=0.0)
        space = SPACE if self.escape else " "
        #: No piece goes on from another character into a space: texts may be cut before spaces.
        self.cuttable = not any(re.search(f"[^{space}]{space}", p) for p in self.vocabulary)
        self.normaliser = Composed(Rules(self.rules), Spaces(self.prefix, self.squeeze, space))
        #: The byte fallback: what its arc for a character writes.
        self.fallback: dict[str, list[int]] = {}
        self._pairs: dict[int, bool] = {}
        self._slot_keys, self._slots = np.full(1 << _SLOT_BITS, -1, np.int64), np.zeros(1 << _SLOT_BITS, bool)
        self._compile()

    # The normaliser.

    def normalise(self, text: str) -> str:
        """What the normaliser writes when it reads the text."""
        if not self.rules and not self.squeeze:  # each character by itself
            return (" " * (self.prefix and text != "") + text).replace(" ", SPACE if self.escape else " ")
        out, step, state = [], self.normaliser.step, self.normaliser.start
        for c in text:
            more, state = step(state, c)
            out.append(more)
        return "".join(out) + self.normaliser.end(state)

    # One text's lattice and its shortest path.

    def merged(self, text: str) -> list[str]:
        """What merging gives: always the neighbours that make the best piece, of equal ones the first."""
        left, right, part = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1)), list(text)
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < len(text) and (n := self.vocabulary.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.scores[n], i, j, part[i] + part[j]))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not part[i] or not part[j] or part[i] + part[j] != piece or right[i] != j:
                continue
            part[i], part[j] = piece, ""
            right[i] = right[j]
            if right[i] < len(text):
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p]

    def _joins(self, u: int, v: int, char: str = "", before: str = "") -> bool:
        """Whether pieces u and v stay apart when their string is merged; u is -1 at the start, -2 for the character `before`; v is -2 for `char`."""
        if u == -2 or v == -2:
            a, b = (before if u == -2 else self.pieces[u] if u >= 0 else ""), char if v == -2 else self.pieces[v]
            return self.merged(a + b) == ([a, b] if a else [b])
        key = (u + 1) * len(self.pieces) + v
        if (known := self._pairs.get(key)) is None:
            a, b = self.pieces[u] if u >= 0 else "", self.pieces[v]
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            self._pairs[key] = known = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def path(self, text: str) -> list[int]:
        """Ids along the shortest path of a normalised text; -2 stands for a character that is no piece."""
        inf = float("inf")
        n = len(text)
        cost, last, back = [inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for at in range(n):
            if cost[at] == inf:
                continue
            if text[at] not in self.vocabulary:
                w = 0.0 if self.bpe else _PENALTY - self.least
                if self.bpe and not self._joins(last[at], -2, text[at], text[at - 1]):
                    w = inf
                if cost[at] + w < cost[at + 1]:
                    cost[at + 1], last[at + 1], back[at + 1] = cost[at] + w, -2, at
            node = 0
            for to in range(at, min(n, at + self.longest)):
                node = self.arcs.get((node, text[to]), -1)
                if node < 0:
                    break
                v = self.finals[node]
                if v < 0:
                    continue
                w = -self.scores[v] if not self.bpe else 0.0 if self._joins(last[at], v, before=text[at - 1]) else inf
                if cost[at] + w < cost[to + 1]:
                    cost[to + 1], last[to + 1], back[to + 1] = cost[at] + w, v, at
        out = []
        while n:
            out.append(last[n] if last[n] != -2 else -3 - ord(text[n - 1]))
            n = back[n]
        return out[::-1]

    def _ids(self, path: list[int]) -> list[int]:
        """A path's output: the byte fallback puts a character's bytes where it is no piece; without it neighbours become one unknown."""
        out: list[int] = []
        gone = False
        for v in path:
            if v >= 0:
                out.append(v)
            elif self.bytes:
                c = chr(-3 - v)
                if c not in self.fallback:
                    self.fallback[c] = [self.bytes[b] for b in c.encode("utf-8", "replace")]
                out.extend(self.fallback[c])
            elif not gone or self.bpe:
                out.append(self.unknown)
            gone = v < 0
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, as sentencepiece gives them."""
        text = self.normalise(text)
        space = SPACE if self.escape else " "
        chunks = re.findall(f"{space}*[^{space}]+|{space}+$", text) if self.cuttable else [text]
        return [i for c in chunks for i in self._ids(self.path(c))]

    # Many chunks at once.

    def _compile(self) -> None:
        """The trie: arcs for one text, and a table of nodes by the most frequent characters for many."""
        self.arcs: dict[tuple[int, str], int] = {}
        self.finals = [-1]
        count: dict[str, int] = {}
        for p, i in self.vocabulary.items():
            node = 0
            for c in p:
                count[c] = count.get(c, 0) + 1
                to = self.arcs.get((node, c))
                if to is None:
                    self.arcs[node, c] = to = len(self.finals)
                    self.finals.append(-1)
                node = to
            self.finals[node] = i
        dense = sorted(count, key=lambda c: (c > "\u024f" and c != SPACE, -count[c], c))[: _DENSE - 1]
        self.number = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(dense):
            self.number[ord(c)] = k + 1
        #: Characters of any piece; nothing is merged over another one.
        self.alphabet = np.zeros(0x110000, bool)
        self.alphabet[[ord(c) for c in count]] = True
        self.foreign = re.compile("([^" + "".join(map(re.escape, count)) + "]+)") if count else re.compile("(.+)", re.DOTALL)
        self.table = np.full((len(self.finals) + 1, _DENSE), len(self.finals), np.uint16 if len(self.finals) < 65535 else np.int32)
        for (node, c), to in self.arcs.items():
            if k := self.number[ord(c)]:
                self.table[node, k] = to
        self.final = np.array([*self.finals, -1], np.int32)

    def solve(self, chunks: list[str]) -> list[bytes]:
        """Ids of normalised chunks, as bytes of int32. Those of BPE are cut at characters of no piece, and each distinct part is solved once."""
        if not self.bpe:
            return [np.array(self._ids(self.path(c)), np.int32).tobytes() for c in chunks]
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        foreign = np.concatenate([[0], np.cumsum(~self.alphabet[chars])])
        ends = np.cumsum(sizes)
        cut = {int(k): self.foreign.split(chunks[k]) for k in np.flatnonzero(foreign[ends] > foreign[ends - sizes])}
        parts = list(dict.fromkeys([c for k, c in enumerate(chunks) if k not in cut] + [x for some in cut.values() for x in some[::2] if x]))
        ids = dict(zip(parts, self._solved(parts), strict=True))
        ids[""] = b""
        for some in cut.values():
            for x in some[1::2]:
                if x not in ids:
                    ids[x] = np.array(self._ids([-3 - ord(c) for c in x]), np.int32).tobytes()
        return [ids[c] if k not in cut else b"".join([ids[x] for x in cut[k]]) for k, c in enumerate(chunks)]

    def _solved(self, chunks: list[str]) -> list[bytes]:
        """Chunks of up to _TOGETHER frequent characters go through the same steps as in `path`, all of one length together; the others one by one."""
        out: list[bytes] = [b""] * len(chunks)
        alone = []
        by_length: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            (by_length.setdefault(len(c), []) if 0 < len(c) <= _TOGETHER else alone).append(k)
        for n, where in by_length.items():
            for at in range(0, len(where), 16384):
                part = where[at : at + 16384]
                chars = self.number[np.frombuffer("".join([chunks[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)]
                ok = (chars > 0).all(1)
                alone.extend(part[i] for i in np.flatnonzero(~ok))
                if ok.any():
                    good = [part[i] for i in np.flatnonzero(ok)]
                    for k, ids in zip(good, self._together(chars[ok]), strict=True):
                        if ids is None:
                            alone.append(k)
                        else:
                            out[k] = ids
        for k in alone:
            out[k] = np.array(self._ids(self.path(chunks[k])), np.int32).tobytes()
        return out

    def _join_many(self, keys: np.ndarray) -> np.ndarray:
        """_joins of (u + 1) * pieces + v, through a direct-mapped table of the pairs met last."""
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)
        joins = self._slots[slot]
        missing = np.flatnonzero(self._slot_keys[slot] != keys)
        if len(missing):
            own, which = np.unique(keys[missing], return_inverse=True)
            size = len(self.pieces)
            found = np.fromiter((self._joins(k // size - 1, k % size) for k in own.tolist()), bool, len(own))
            joins[missing] = found[which]
            self._slot_keys[slot[missing]] = keys[missing]
            self._slots[slot[missing]] = joins[missing]
        return joins

    def _together(self, chars: np.ndarray) -> list[bytes | None]:
        """BPE of rows of characters that the table has; None where a character is needed that is no piece."""
        rows, n = chars.shape
        nowhere = len(self.finals)
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        for at in range(n):
            own, node = np.arange(rows), np.zeros(rows, np.int64)
            for to in range(at, min(n, at + self.longest)):
                node = self.table[node, chars[own, to]]
                go = np.flatnonzero(node != nowhere)
                if not len(go):
                    break
                if len(go) < len(own):
                    own, node = own[go], node[go]
                piece = self.final[node]
                some = np.flatnonzero(piece >= 0)
                ends[to + 1].append((at, own[some], piece[some]))
        last = np.full((rows, n + 1), -9, np.int64)
        back = np.zeros((rows, n + 1), np.int32)
        last[:, 0] = -1
        size = len(self.pieces)
        for end in range(1, n + 1):
            for at, r, piece in ends[end]:
                before = last[r, at]
                there = np.flatnonzero(before > -9)
                if not len(there):
                    continue
                r, piece = r[there], piece[there]
                joins = self._join_many((before[there] + 1) * size + piece)
                r = r[joins]
                last[r, end], back[r, end] = piece[joins], at
        out: list[bytes | None] = []
        got = np.full((rows, n), -1, np.int32)
        place, at = np.full(rows, n), np.full(rows, n)
        while (open_ := np.flatnonzero(at > 0)).size:
            place[open_] -= 1
            got[open_, place[open_]] = last[open_, at[open_]]
            at[open_] = back[open_, at[open_]]
        whole = last[:, n] > -9
        for r in range(rows):
            out.append(got[r, place[r] :].tobytes() if whole[r] else None)
        return out

    def chunk_encoder(self) -> ChunkEncoder:
        """For columns of texts. A text is cut before runs of spaces; one that rules may change, or with a ▁ of its own, is done by itself."""
        space = SPACE if self.escape else " "
        return ChunkEncoder(self.solve, self.encode, "▁" if self.cuttable and not self.rules and self.prefix else "", space, self.squeeze)

    # Decoding.

    @cached_property
    def outputs(self) -> pa.Array:
        """What each id writes when decoding: a piece with spaces for ▁, a byte, nothing for controls, ` ⁇ ` for the unknown."""
        byte = {i: b for b, i in enumerate(self.bytes)}
        return pa.array([bytes([byte[i]]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))], pa.binary())

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their outputs as UTF-8 (what is not, is replaced); the prefix goes."""
        return self.decode_many(np.array([0, len(ids)]), np.array(ids, np.int64))[0].as_py()

    def decode_many(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """decode for a column."""
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.outputs.take(pa.array(ids))), b"")
        if self.prefix:
            whole = pc.replace_substring_regex(whole, r"\A ", "", max_replacements=1)
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([None if x is None else x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


_COMPILED: dict[int, tuple[Transducer, ChunkEncoder]] = {}


def compiled(model: bytes) -> tuple[Transducer, ChunkEncoder]:
    """One compiled model a Python worker, with what it has tokenized."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED.clear()
        t = Transducer(model)
        _COMPILED[key] = t, t.chunk_encoder()
    return _COMPILED[key]


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_tokens, ids, restored) for each row of docs, repeated ones too: the whole text's ids, and whether decoding them gives the text again.

    restored compares with the text as the normaliser leaves it. An empty text has no ids; a null
    text has null in all columns but doc_id. Other columns are ignored. The model is read on the driver (0.5 MB).
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches):
        t, encoder = compiled(shared.value)
        plain = not t.rules and not t.squeeze
        for b in batches:
            texts = b.column(1).cast(pa.string())
            for at in range(0, b.num_rows, 2000):
                part = texts.slice(at, 2000)
                offsets, ids = encoder.encode(part)
                gone = pa.array(part.is_null().to_numpy(zero_copy_only=False))
                expected = part if plain else pa.array([None if x is None else t.normalise(x).replace(SPACE, " ")[int(t.prefix) :] for x in part.to_pylist()], pa.string())
                restored = pc.equal(t.decode_many(offsets, ids), expected)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 2000), pc.if_else(gone, None, pa.array(np.diff(offsets).astype(np.int64))), pc.if_else(gone, None, lists), restored],
                    names=["doc_id", "n_tokens", "ids", "restored"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, restored boolean")


def decode_pieces(rows: DataFrame, ids: str = "ids", model_path: str = MODEL_PATH, out: str = "text") -> DataFrame:
    """rows with the text of their `ids` in the column `out`; null ids give a null text, no ids an empty one."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    @F.pandas_udf("string")
    def text(lists):
        import pandas as pd

        t, _ = compiled(shared.value)
        sizes = np.fromiter((0 if x is None else len(x) for x in lists), np.int64, len(lists))
        flat = np.concatenate([np.zeros(0, np.int64), *(x for x in lists if x is not None)]).astype(np.int64)
        texts = t.decode_many(np.concatenate([[0], np.cumsum(sizes)]), flat).to_pylist()
        return pd.Series([None if x is None else text for x, text in zip(lists, texts, strict=True)], dtype=object)

    return rows.withColumn(out, text(F.col(ids)))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
