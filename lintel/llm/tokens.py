"""Token ids as directly addressable codes: chunks by level with continuation bitmaps and rank directories (Brisaboa, Ladra, Navarro, 2013)."""

from __future__ import annotations

import base64
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import ship

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of each level's chunks; further levels are as wide as the last.
WIDTHS = (10, 6)
_MAGIC = b"DAC1"
_BLOCK = 512  # bits of a bitmap between two entries of its rank directory


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def encode_dac(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The bytes of a sequence of ids from 0 up to 2**31 - 1.

    "DAC1", the number of levels (4 bytes), the number of ids (8), and for each level the width
    and the number of its chunks (8 each); then, each padded to 8 bytes, for each level: chunks of
    `width` bits, least bit first; and, for all levels but the last, the bitmap of the chunks that
    go on and, for each 512 bits of it, how many go on before (8 bytes). The j-th chunk that goes
    on in one level does so with the j-th chunk of the next. No ids: one level without chunks.
    """
    rest = np.asarray(ids, np.int64)
    if len(rest) and (rest.min() < 0 or rest.max() >= 1 << 31):
        raise ValueError("ids are from 0 to 2**31 - 1")
    heads, body = [], []
    while True:
        width = widths[min(len(heads), len(widths) - 1)]
        heads.append(struct.pack("<QQ", width, len(rest)))
        bits = ((rest[:, None] >> np.arange(width)) & 1).astype(np.uint8)
        body.append(_pad(np.packbits(bits.ravel(), bitorder="little").tobytes()))
        more = rest >> width > 0
        if not more.any():
            break
        bitmap = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(np.pad(bitmap, (0, -len(bitmap) % (_BLOCK // 8))).reshape(-1, _BLOCK // 8)).sum(1, dtype=np.int64))])
        body += [_pad(bitmap.tobytes()), ones[:-1].astype("<u8").tobytes()]
        rest = rest[more] >> width
    return _MAGIC + struct.pack("<IQ", len(heads), len(ids)) + b"".join(heads) + body[0] + b"".join(body[1:])


class Dac:
    """Random access to the ids in the bytes of encode_dac: one chunk, and one count, a level; nothing else is decoded."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:4] != _MAGIC:
            raise ValueError("these are not directly addressable codes")
        levels, self.n = struct.unpack_from("<IQ", data, 4)
        heads = [struct.unpack_from("<QQ", data, 16 + 16 * k) for k in range(levels)]
        at, self.levels = 16 + 16 * levels, []
        for k, (width, n) in enumerate(heads):
            chunks, at = at, at + (-(-n * width // 64)) * 8
            bitmap = ranks = 0
            if k < levels - 1:
                bitmap, at = at, at + -(-n // 64) * 8
                ranks, at = at, at + -(-n // _BLOCK) * 8
            self.levels.append((width, n, chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        last = len(self.levels) - 1
        for k, (width, _, chunks, bitmap, ranks) in enumerate(self.levels):
            at = i * width
            word = int.from_bytes(self.data[chunks + at // 8 : chunks + (at + width + 7) // 8], "little")
            value |= (word >> at % 8 & (1 << width) - 1) << shift
            if k == last or not self.data[bitmap + i // 8] >> i % 8 & 1:
                return value
            shift += width
            block = i // _BLOCK
            ones = int.from_bytes(self.data[bitmap + block * _BLOCK // 8 : bitmap + i // 8 + 1], "little") & (1 << i - block * _BLOCK) - 1
            i = struct.unpack_from("<Q", self.data, ranks + 8 * block)[0] + ones.bit_count()
        raise AssertionError

    def decode(self) -> np.ndarray:
        """All ids."""
        value, where, shift = np.zeros(self.n, np.int64), np.arange(self.n), 0
        for k, (width, n, chunks, bitmap, _) in enumerate(self.levels):
            bits = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-n * width // 8), chunks), count=n * width, bitorder="little").reshape(n, width)
            value[where] |= (bits.astype(np.int64) << np.arange(width)).sum(1) << shift
            if k < len(self.levels) - 1:
                where = where[np.unpackbits(np.frombuffer(self.data, np.uint8, -(-n // 8), bitmap), count=n, bitorder="little").astype(bool)]
            shift += width
        return value


_ENCODERS: dict[int, object] = {}


def byte_bpe(ranks_file: bytes, pattern: str = PATTERN):
    """The tokenizer of a file of ranks: ids of a whole text, as an array. One a Python worker."""
    key = hash((ranks_file, pattern))
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS.clear()
        _ENCODERS[key] = lambda text: own.encode_to_numpy(text, disallowed_special=())
    return _ENCODERS[key]


def token_codes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = RANKS_PATH, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc_id, n_tokens, codes) for each row of docs: codes are the token ids of its text by encode_dac.

    Repeated rows each give one. An empty text has 0 tokens and the codes of none; a null text has
    null in both columns. Other columns are ignored. The ranks are read on the driver (0.8 MB).
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches):
        encode = byte_bpe(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = [None if x is None else encode(x) for x in b.column(1).slice(at, 256).to_pylist()]
                number = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                codes = pa.array([None if x is None else encode_dac(x, widths) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), number, codes], names=["doc_id", "n_tokens", "codes"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, codes binary")


def op2_token_codes(spark, sf_dir: str) -> DataFrame:
    return token_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
