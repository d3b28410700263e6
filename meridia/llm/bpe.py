"""Byte-level BPE: the tokenizers library over Arrow batches, and the way back.

A rank file (one base64 token and its rank a line) gives the vocabulary. Ranks say
which merge comes first: a token's merge is that of the two lower-ranked tokens that
byte pair encoding leaves of it just before its own rank. So the library's BPE model
is built from ranks alone, with bytes mapped to printable characters.

Texts are cut into chunks in front of single spaces. The pattern never crosses from
a character that isn't white space to one that is, so chunks encode separately; each
distinct chunk of a batch is encoded once and a bounded table keeps the latest ones.

Decoding maps ids back to bytes by the reversed byte table. A character whose bytes
are split over tokens is whole again once they are joined; ``Decoder`` holds back an
unfinished one when ids arrive piece by piece.

Edge cases: a null text counts as empty and has no ids; lone surrogates can't occur
in Spark's strings. Very long texts take memory in proportion to one batch. Rows are
encoded one by one, equal rows equally; an empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import sys
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from meridia.llm.common import lean

RANKS = "byte_bpe_50k.tiktoken"
#: Chunks that a worker remembers, and the longest that it does.
MOST_CHUNKS, LONGEST_CHUNK = 100_000, 64
#: Letters below this are the same in every version of Unicode.
COMMON = "\u0250"


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts of ``token`` that merges of lower rank leave."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= own:
            raise ValueError(f"no merge leads to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed in this machine's order, which has to be little-endian")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks = read_ranks(path)
        shown = byte_characters()
        text = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = [tuple(text[x] for x in _last_pair(token, ranks)) for token in sorted(ranks, key=ranks.get) if len(token) > 1]
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.tokenizer = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.shown = dict(enumerate(shown))
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Parts of ``text`` that encode separately; none is empty."""
        if not text:
            return []
        parts = text.split(" ")
        out = parts[:1]
        for part in parts[1:]:
            if (not part or part[0].isspace()) and (not out[-1] or out[-1][-1].isspace()):
                out[-1] += " " + part
            else:
                out.append(" " + part)
        return out if out[0] else out[1:]

    def _one_piece(self, piece: str) -> list[int]:
        """Ids of what the pattern leaves whole: bytes as characters, to the library's merges."""
        return [x.id for x in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]

    def _packed(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each chunk with its ids as little-endian 32-bit numbers.

        A space and common letters, with a stop or comma perhaps, need no pattern.
        """
        hard = []
        for c in chunks:
            word = c[1:] if c[0] == " " else c
            end = word[-1:] if word[-1:] in (".", ",") else ""
            word = word[:-1] if end else word
            if word.isalpha() and (word.isascii() or max(word) < COMMON):
                ids = self._one_piece(c[:-1]) + self._one_piece(end) if end else self._one_piece(c)
                yield c, array("I", ids).tobytes()
            else:
                hard.append(c)
        for c, x in zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True):
            yield c, array("I", x.ids).tobytes()

    def encode_packed(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        known, cut = self.known, [self.chunks(x) for x in texts]
        distinct = set(chain.from_iterable(cut))
        known.update(self._packed([c for c in distinct if c not in known]))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        if len(known) > MOST_CHUNKS:
            self.known = {c: known[c] for c in distinct if len(c) <= LONGEST_CHUNK}
        return out

    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def offsets(self, text: str, ids: Sequence[int] | None = None) -> np.ndarray:
        """Rows of (start, end): characters that each token (of ``ids``, if these are known) touches; parts of one character share it.

        Tokens lie one behind the other in the bytes of ``text``, so their ends are sums of
        lengths; a byte's character is the number of first bytes up to it.
        """
        ends = np.cumsum(self.lengths[np.asarray(self.encode(text) if ids is None else ids, np.int64)])
        first = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return np.stack([first[starts] - 1, first[ends - 1]], axis=1).astype(np.int32) if len(ends) else np.zeros((0, 2), np.int32)

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Decoder:
    """Text of ids that arrive piece by piece; holds back the bytes of an unfinished character."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.rest = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Sequence[int], last: bool = False) -> str:
        return self.rest.decode(self.bpe.decode_bytes(ids), last)


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None) -> ByteBpe:
    """Built once in each process, from the vocabulary file that every machine has."""
    return ByteBpe(path or public_tokenizers.path(RANKS))


def _batches(batches: Iterator[pa.RecordBatch], most_chars: int = 2_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts, at most ``most_chars`` of bytes at once, but one text at least."""
    for batch in batches:
        lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1).cast(pa.large_binary())] or [0]).cumsum()
        at = 0
        while at < batch.num_rows:
            before = lengths[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(lengths, before + most_chars, "right")))
            part = batch.slice(at, end - at)
            yield part.column(0), ["" if x is None else x for x in part.column(1).to_pylist()]
            at = end


def encode_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """key and ids of every text, with ``offsets`` also starts and ends in characters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for keys, texts in _batches(batches):
            encoded = bpe.encode_batch(texts)
            columns = [pa.array(encoded, pa.list_(pa.int32()))]
            if offsets:
                spans = [bpe.offsets(x, ids) for x, ids in zip(texts, encoded, strict=True)]
                columns += [pa.array([x[:, k] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", "ids", "starts", "ends"][: 1 + len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(work), schema).withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key and text of every list of ids; a null list gives an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(lean(work), f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """Number and digest of each text's ids, of their offsets, and of the bytes that they decode to; with ``ids``, these too.

    Offsets are digested as pairs of little-endian 32-bit numbers (start, end).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for keys, texts in _batches(batches):
            encoded = bpe.encode_packed(texts)
            counts = [len(x) // 4 for x in encoded]
            lists = [np.frombuffer(x, "<u4") for x in encoded]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [
                pa.array(counts, pa.int64()),
                pa.array([sha(x) for x in encoded], pa.string()),
                pa.array([sha(bpe.decode_bytes(x.tolist())) for x in lists], pa.string()),
                pa.array([sha(bpe.offsets(t, x).tobytes()) for t, x in zip(texts, lists, strict=True)], pa.string()),
            ]
            if ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(encoded), "<i4"))))
            yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "ids"][: 1 + len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(work), schema).withColumnRenamed("key", key)


def op6_byte_bpe(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
