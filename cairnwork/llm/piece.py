"""SentencePiece encoding and decoding with byte offsets into the original text.

The normaliser walks the text by the longest prefix that the model's compiled character map (a double
array trie and a table of replacements) knows, and records from which original byte each normalised
byte came. The library gives the ids; each piece covers a known number of normalised bytes, so its span
is read off that record. Byte-fallback pieces cover one byte each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import slices, utf8

SLICE_BYTES = 1 << 20
SPACE, MARK = b" ", "▁".encode()


class CharMap:
    """A compiled character map: u32 size of the trie, the trie's u32 units, NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.table = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and what replaces it."""
        units = self.units
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        best = None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.table[best[1] : self.table.index(b"\0", best[1])]


class Encoder:
    def __init__(self, path: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.lib.serialized_model_proto())
        self.spec = spec.normalizer_spec
        self.chars = CharMap(self.spec.precompiled_charsmap)
        lib = self.lib
        self.sizes = np.array([0 if lib.is_control(i) else 1 if lib.is_byte(i) else len(lib.id_to_piece(i).encode()) for i in range(len(lib))], np.int64)
        self.unknown = lib.unk_id()

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each place between its bytes the original byte offset."""
        if not text:
            return b"", np.zeros(1, np.int64)
        mark = MARK if self.spec.escape_whitespaces else SPACE
        if not self.chars.units and not self.spec.remove_extra_whitespaces:
            raw = np.frombuffer(text, np.uint8)
            origin = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(mark), 1))
            before = len(mark) if self.spec.add_dummy_prefix else 0
            return (mark if before else b"") + text.replace(SPACE, mark), np.concatenate((np.zeros(before, np.int64), origin, [len(raw)]))
        units: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            found = self.chars.longest(text, at)
            if found is None:
                size = 1
                while at + size < len(text) and text[at + size] & 0xC0 == 0x80:
                    size += 1
                found = size, text[at : at + size]
            units += [(found[1][j : j + 1], at) for j in range(len(found[1]))]
            at += found[0]
        if self.spec.remove_extra_whitespaces:
            kept: list[tuple[bytes, int]] = []
            for unit in units:
                if unit[0] != SPACE or (kept and kept[-1][0] != SPACE):
                    kept.append(unit)
            while kept and kept[-1][0] == SPACE:
                kept.pop()
            units = kept
        if self.spec.add_dummy_prefix and units:
            units.insert(0, (SPACE, units[0][1]))
        out = [(mark if b == SPACE else b, o) for b, o in units]
        origin = [o for b, o in out for _ in b]
        return b"".join(b for b, _ in out), np.array([*origin, len(text)], np.int64)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of each piece; control pieces are empty spans."""
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():
            pieces = self.lib.encode(text.decode("utf-8", "replace"), out_type=str)
            sizes[: len(pieces)] = [len(p.encode()) if i == self.unknown else s for p, i, s in zip(pieces, ids.tolist(), sizes.tolist(), strict=False)]
        origin = self.normalise(text)[1]
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(origin) - 1:
            raise ValueError("the pieces do not cover the normalised text: this model normalises in a way that spans can't follow")
        return origin[ends - sizes], origin[ends]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_pieces(docs: DataFrame, model_path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ids, starts, ends (bytes of the original text), decoded.

    The whole text is encoded as the library encodes it, with the end id only (``end``). Null counts as
    empty: it has the end id alone and decodes to the empty text. Rows that repeat get equal results.
    Input columns named ids, starts, ends or decoded are replaced.
    """
    names = ("ids", "starts", "ends", "decoded")
    carried = docs.drop(text_col, *names)
    columns = carried.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema] + ["ids array<int>, starts array<int>, ends array<int>, decoded string"])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            raw = utf8(batch.column(batch.num_columns - 1))
            for begin, stop in slices(raw, SLICE_BYTES):
                part = raw[begin:stop]
                found = own.lib.encode([t.decode("utf-8", "replace") for t in part], add_eos=end, num_threads=1)
                decoded = own.lib.decode(found, num_threads=1)
                ids = [np.asarray(x, np.int32) for x in found]
                spans = [own.spans(t, x) for t, x in zip(part, ids, strict=True)]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32))
                flat = [np.concatenate(x).astype(np.int32) for x in (ids, [s[0] for s in spans], [s[1] for s in spans])]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]
                kept = [batch.column(i).slice(begin, stop - begin) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *lists, pa.array(decoded, pa.string())], [*columns, *names])

    return docs.select(*columns, docs[text_col].alias("__text")).mapInArrow(encode, schema)


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for; null ids decode to the empty text."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        lib = encoder(model_path).lib
        return pd.Series([lib.decode([int(i) for i in x]) if x is not None else "" for x in ids], dtype=object)

    return rows.withColumn(out_col, decode(F.col(ids_col)))
