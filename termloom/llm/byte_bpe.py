"""Byte-level BPE through a sentencepiece model that is written straight from the rank table.

Every byte is mapped to one printable character; each rank becomes a piece of mapped characters with the score
``-rank``, so that sentencepiece's best-score-first merges are the lowest-rank-first merges of the rank table. The
normaliser is the identity, no space is added, removed or escaped. Each pre-token (a match of the split pattern) is
encoded on its own; decoding maps ids back to their bytes. The model is built on the driver and travels with the task
(its size is that of the vocabulary, about 1 MB), so executors read no file. Tokenizers are never trained here.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from termloom.llm.common import narrow, table

#: Distinct pre-tokens that a task remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks, which must run from 0 without a gap."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    out = [b""] * len(ranks)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def byte_characters() -> str:
    """256 characters, one for each byte, none of them a space or a control character."""
    return "".join(chr(0x100 + b) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model of type BPE: ``tokens[r]`` has id r and score -r; the unknown piece comes last."""
    import struct

    chars = byte_characters()
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    pieces = [_field(1, _field(1, "".join(map(chars.__getitem__, t)).encode()) + score(-float(r)) + _number(3, 1)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + score(0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(24, 0) + _number(40, len(tokens)) + b"".join(_varint(n << 3) + _varint(2**64 - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes; ``encode`` gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or sentencepiece_model(tokens))
        self.whole = {t: r for r, t in enumerate(tokens)}
        self.chars = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}

    def _pretoken(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        rank = self.whole.get(raw)
        ids = [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(self.chars))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        known, new = self.known, self._pretoken
        return b"".join([known.get(p) or new(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, token_ids])`` for every row, in one pass without a shuffle.

    A null text is encoded as the empty text: no tokens. Rows are independent, so null ids, repeated rows and ties
    give a row each; an empty table gives no rows; text of any length is encoded whole. ``token_ids`` (binary, unsigned
    32-bit little-endian) comes only with ``ids``.
    """
    model = sentencepiece_model(tokens)
    kind = dict(docs.dtypes)[id_col]
    arrow = narrow(docs, doc_id=id_col, text=text_col).selectExpr("doc_id", "cast(text as string) text")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokens, pattern, model)
        for batch in batches:
            encoded = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            cols = [
                batch.column(0),
                pa.array([len(e) // 4 for e in encoded], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(e)).hexdigest() for e in encoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(encoded, pa.binary())], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokens: list[bytes], ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary) added; a null id list decodes to null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in batch.column(batch.schema.get_field_index(ids_col))]
            out = [None if x is None else b"".join(map(tokens.__getitem__, memoryview(x).cast("I"))) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def default_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[list[bytes], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *default_vocabulary(), ids=False)
