"""Chat formatting at token level.

A turn is START, role, HEAD, text, END. Role and text are encoded as segments of their own, so no
merge crosses a boundary, and the three marks are reserved ids above the vocabulary, spliced in.
The loss mask follows from prefix sums of the segments' lengths: 1 for the ids of an assistant's
text, 0 for all else.

A control string that occurs in a role or text is escaped: one backslash goes in after its first
character. A control string that is already broken by backslashes there gets one more, so removing
one from each restores the text exactly. No text can thus contain a mark once it is printed.

format_turns() does the tokenizing before any shuffle. digest() deals the turns by conversation,
sorts them by turn and reads them back from ids and mask in one streaming pass per partition, with
running hashes: a conversation of any length needs the memory of one batch, never a list of its
turns.

Defined cases: null text and null role are empty; turns go by turn, then role, then text, nulls
first; repeated rows are turns of their own; a null conv_id is a conversation of its own; bytes that are not UTF-8 are read as U+FFFD; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import as_bytes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the tokenizer's own pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The template's own marks, and control strings of common chat templates.
MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

_OPEN = re.compile("|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _OPEN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}


class Codec:
    """Encodes segments, knows the reserved ids, and reads a turn back from ids and mask."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("segments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start, self.head, self.end = (max(ranks.values()) + 1 + i for i in range(len(MARKS)))

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        encode = self.encoding.encode_ordinary
        segments = [[self.start], encode(escape(role)), [self.head], encode(escape(text)), [self.end]]
        ends = np.cumsum([len(s) for s in segments])
        mask = np.zeros(ends[-1], np.int8)
        if role == "assistant":
            mask[ends[2] : ends[3]] = 1
        return np.concatenate([np.asarray(s, np.int32) for s in segments]), mask

    def read(self, ids: np.ndarray) -> tuple[str, str, int]:
        """Role, text and number of printed characters of one turn."""
        head = int(np.flatnonzero(ids == self.head)[0])
        if ids[0] != self.start or ids[-1] != self.end:
            raise ValueError("not a turn")
        role, text = (self.encoding.decode_bytes(x.tolist()).decode() for x in (ids[1:head], ids[head + 1 : -1]))
        return unescape(role), unescape(text), len(role) + len(text) + sum(map(len, MARKS))

    def under(self, ids: np.ndarray, mask: np.ndarray) -> str:
        return unescape(self.encoding.decode_bytes(ids[mask == 1].tolist()).decode())


def _shared(df: DataFrame, path: str):
    """The tokenizer's file, read once by the driver and broadcast (its size does not depend on the data)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


TURNS = "conv_id long, turn long, role string, text string, ids array<int>, mask array<tinyint>"


def _read(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]


def _format(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(blob.value))
        for batch in batches:
            turns = [codec.turn(r, t) for r, t in zip(_read(batch.column("role")), _read(batch.column("text")), strict=True)]
            offsets = pa.array(np.cumsum([0, *(len(i) for i, _ in turns)]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *(i for i, _ in turns)]))
            mask = pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int8), *(m for _, m in turns)]))
            roles, texts = (pa.array([None if t is None else t.decode("utf-8", "replace") for t in batch.column(c).to_pylist()], pa.string()) for c in ("role", "text"))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), roles, texts, ids, mask], ["conv_id", "turn", "role", "text", "ids", "mask"])

    return run


def format_turns(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, turn, role, text, ids, mask of every turn."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), as_bytes("role").alias("role"), as_bytes().alias("text"))
    return rows.mapInArrow(_format(_shared(conversations, tokenizer)), TURNS)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, codec: Codec, ids: np.ndarray, mask: np.ndarray) -> None:
        role, text, chars = codec.read(ids)
        self.turns += 1
        self.chars += chars
        self.all.update(f"{role}\n{text}\n".encode())
        if mask.any():
            loss = codec.under(ids, mask)
            self.loss_chars += len(loss)
            self.loss.update(loss.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now = Codec(read_ranks(blob.value)), None
        for batch in batches:
            done = []
            ids, mask = batch.column("ids"), batch.column("mask")
            for k, conv in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(codec, ids[k].values.to_numpy(), mask[k].values.to_numpy())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _DIGEST_SCHEMA.types, strict=True)], schema=_DIGEST_SCHEMA)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), _DIGEST_SCHEMA.types, strict=True)], schema=_DIGEST_SCHEMA)

    return run


def digest(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each conversation, read back from ids and mask alone."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return dealt.mapInArrow(_read_back(_shared(turns, tokenizer)), DIGEST)
