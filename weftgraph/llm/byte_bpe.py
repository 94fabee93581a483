"""Byte-level BPE: texts to ids, ids to character offsets, and ids back to bytes."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.text_hash import chunks
from weftgraph.llm.tokens import Encoder, cut_byte_level

IDS = "<u4"
#: Bytes of text that a task encodes at a time.
AT_ONCE = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the others for the
    characters from 256 on, in order.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id; special tokens stand for their own text."""
    back = {c: b for b, c in enumerate(byte_characters())}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    vocabulary = spec["model"]["vocab"]
    out = [b""] * (max([*vocabulary.values(), *special]) + 1)
    for token, i in vocabulary.items():
        out[i] = special[i] if i in special else bytes(back[c] for c in token)
    for i, content in special.items():
        out[i] = content
    return out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids as binary, little-endian unsigned 32-bit numbers.

    ``path`` names a tokenizer file of the tokenizers library on every
    executor. No special token is added, and their texts are ordinary text.
    Null and empty texts have no ids; repeated rows each have a result; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Encoder(path, cut_byte_level, IDS)
        for batch in batches:
            for begin, end, _, _ in chunks(batch.column("text"), AT_ONCE):
                texts = batch.column("text").slice(begin, end - begin).to_pylist()
                ids = use.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), pa.array(ids, type=pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """Adds ``content``, the bytes of ``ids``; null ids give null, unknown ids fail the job."""
    schema = tokens.schema.simpleString()[7:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    if "content" in tokens.columns:
        raise ValueError(f"the input already has a column content: {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                content = [
                    None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, dtype=IDS).tolist()))
                    for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, type=pa.binary())], [*part.schema.names, "content"])

    return tokens.mapInArrow(run, f"{fields}, content binary")


def offsets(ids: np.ndarray, content: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of every token, in the text whose bytes are ``content``.

    A token that starts or ends inside a character covers the whole character,
    so the spans of tokens that share one overlap. ``lengths`` has the bytes of every id.
    """
    size = lengths[ids]
    ends = np.cumsum(size)
    character = np.cumsum((np.frombuffer(content, dtype=np.uint8) & 0xC0) != 0x80)
    return character[ends - size] - 1, character[ends - 1]


def character_offsets(ids: bytes, table: list[bytes]) -> list[tuple[int, int]]:
    """``offsets`` of one document's ids, as pairs."""
    numbers = np.frombuffer(ids, dtype=IDS)
    first, end = offsets(numbers, b"".join(map(table.__getitem__, numbers.tolist())), np.array([len(x) for x in table]))
    return list(zip(first.tolist(), end.tolist()))


def decode_parts(parts: Iterator[bytes], table: list[bytes]) -> Iterator[str]:
    """Text of each part of a document's ids; a character cut by a border comes with the later part.

    Bytes that are no UTF-8, also at the very end, become U+FFFD.
    """
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield reader.decode(b"".join(table[i] for i in np.frombuffer(part, dtype=IDS).tolist()))
    if rest := reader.decode(b"", final=True):
        yield rest


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids and of the bytes they decode to, and what offsets show.

    offsets_sha256 is that of all (first, end) character pairs as little-endian
    32-bit integers; n_split counts tokens that begin inside a character, which
    decoding has to put together. Null and empty texts have no tokens, and the
    digests of nothing; every row has a result, also repeated ones; other
    columns are ignored; an empty table gives no row. Ids, bytes and offsets of
    about ``AT_ONCE`` bytes of text are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, table = Encoder(path, cut_byte_level, IDS), token_bytes(path)
        lengths = np.array([len(x) for x in table])
        for batch in batches:
            for begin, end, _, _ in chunks(batch.column("text"), AT_ONCE):
                found = []
                for ids in use.encode([t or "" for t in batch.column("text").slice(begin, end - begin).to_pylist()]):
                    numbers = np.frombuffer(ids, dtype=IDS)
                    content = b"".join(map(table.__getitem__, numbers.tolist()))
                    first, stop = offsets(numbers, content, lengths)
                    split = int((first[1:] < stop[:-1]).sum())
                    pairs = np.stack([first, stop], axis=1).astype("<i4")
                    found.append((len(numbers), *(hashlib.sha256(x).hexdigest() for x in (ids, content, pairs.tobytes())), split))
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin),
                     *(pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long")
