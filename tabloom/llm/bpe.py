"""Operator 10, byte-level BPE through a sentencepiece model made from the vocabulary.

The ranks become a sentencepiece BPE model, written in its serialised form: piece i is token i
with its bytes mapped to printable characters and the score -i, so that the best pair to merge
is the one of lowest rank; the normaliser is the identity and no prefix is added. Each
pre-token is encoded on its own; a pre-token that is itself in the vocabulary is that token.
Decoding looks up the bytes of each id. The vocabulary's path is a parameter; every task reads
the file once.

Defined results: a null or empty text has no ids (their digests are those of no bytes); texts
of any length are encoded whole; rows are independent, so repeats and ties do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.pretokens import encode_texts, flat, texts_of
from tabloom.llm.process import once, trimmed
from tabloom.llm.shared import text_of
from tabloom.llm.words import slices

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NORMAL, UNKNOWN, BPE = 1, 2, 2
SLICE_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One field of a serialised message: a number, a float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, NORMAL))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN)))
    # model_type, vocab_size, then the ids of unk, bos, eos and pad.
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # name, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces.
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encode texts with the serialised model, decode ids with the vocabulary."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.pattern = regex.compile(pattern)
        self.names = pa.array([b"%d," % i for i in range(len(self.tokens))], pa.binary())
        self.bytes = pa.array(self.tokens, pa.binary())

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pretokens]
        out: list = [[r] if (r := self.ranks.get(p)) is not None else None for p in raw]
        odd = [i for i, ids in enumerate(out) if ids is None]
        mapped = [raw[i].decode("latin-1").translate(self.letters) for i in odd]
        for i, ids in zip(odd, self.model.encode(mapped, num_threads=1) if odd else ()):
            out[i] = ids
        return out

    def encode_whole(self, text: str) -> list[int]:
        return [i for ids in self.encode_pretokens(self.pattern.findall(text)) for i in ids]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        distinct = lambda split: flat(self.encode_pretokens([t.decode() for t in split.distinct]))
        return encode_texts(texts, distinct, self.encode_whole)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


def codec(path: str) -> Codec:
    """One codec in each Python worker."""
    return once(("codec", path), lambda: Codec(path))


def _pieces(table: pa.Array, ids: np.ndarray, upto: np.ndarray) -> list[memoryview]:
    """For each text, the joined entries of its ids; they lie side by side in one buffer."""
    taken = table.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)
    data = memoryview(taken.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(offsets[upto[:-1]].tolist(), offsets[upto[1:]].tolist())]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    def run(batches):
        coder = codec(path)
        for batch in slices(batches, limit=SLICE_BYTES):
            ids, counts = coder.encode(texts_of(batch.column("text")))
            upto = np.concatenate([[0], np.cumsum(counts)])
            named = _pieces(coder.names, ids, upto)  # each id with a comma; the last one goes
            plain = _pieces(coder.bytes, ids, upto)
            sha = lambda part: hashlib.sha256(part).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts.astype(np.int64)),
                    pa.array([sha(p[:-1]) for p in named], pa.string()), pa.array([sha(p) for p in plain], pa.string()),
                ],
                names=[part.split(" ")[0] for part in RESULT.split(", ")],
            )

    return trimmed(run)


def encode_and_decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(_digests(path), RESULT)


def _with_ids(path: str):
    def run(batches):
        coder = codec(path)
        for batch in slices(batches, limit=SLICE_BYTES):
            ids, counts = coder.encode(texts_of(batch.column("text")))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            keep = [i for i, name in enumerate(batch.schema.names) if name != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], column], names=[*[batch.schema.names[i] for i in keep], "ids"]
            )

    return trimmed(run)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The columns of `docs` and `ids`, the tokens of `text` (a column of that name gives way)."""
    rows = docs.drop("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_with_ids(path), f"{schema}, ids array<int>")
