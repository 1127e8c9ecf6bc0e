"""Tokenizers behind one interface: whitespace words, UTF-8 bytes, and byte-pair files in an Arrow function."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOS = "<eos>"
#: Ids that follow the 256 byte ids.
BYTE_SPECIALS = {"<|im_start|>": 256, "<|im_end|>": 257, EOS: 258}
MAX_UINT16 = 65_535


def words(text: Column) -> Column:
    """The whitespace tokens of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\n]+"), lambda x: x != "")


def with_eos(tokens: Column, eos: Column | None = None) -> Column:
    """An end token after every document, empty ones too."""
    return F.concat(tokens, F.array(eos if eos is not None else F.lit(EOS)))


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as ids 0 to 255."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def byte_arrays(end: int | None = None) -> Callable[[Column], Column]:
    """The same in Arrow, with an end id after each text if one is given: the text's own bytes, widened, without a step for each."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids, offsets = widened(texts)
        if end is not None:
            ids, offsets = np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return encode


def byte_pieces(end: int) -> Callable[[Column, Column], Column]:
    """The same of stretches of texts, as bytes: the end id stands behind those that the second column says end their text."""

    @F.arrow_udf("array<int>")
    def encode(data: pa.Array, ended: pa.Array) -> pa.Array:
        ids, offsets = _ended(data, ended, end)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return encode


def byte_runs(end: int) -> Callable[[Column, Column], Column]:
    """The same of arrays of stretches, one behind the other."""

    @F.arrow_udf("array<int>")
    def encode(data: pa.Array, ended: pa.Array) -> pa.Array:
        ids, offsets = _ended(data.flatten(), ended.flatten(), end)
        ends = np.cumsum(pa.compute.list_value_length(data).fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(offsets[np.concatenate([[0], ends])].astype(np.int32)), pa.array(ids))

    return encode


def _ended(data: pa.Array, ended: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of stretches of bytes, with the end id behind those that end a text, and where each stretch's begin."""
    ids, offsets = widened(data)
    last = ended.to_numpy(zero_copy_only=False).astype(bool)
    return np.insert(ids, offsets[1:][last], end), offsets + np.concatenate([[0], np.cumsum(last)])


def widened(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row as ids, and where each text's begin, with the end of the last."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int32) if data is not None and data.size else np.zeros(0, np.int32)
    return ids, offsets - offsets[0]


def byte_count(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


#: Bytes of the texts of a call to the library, and ids of a call back: it makes a string and four places for each id.
CALL_BYTES = 1 << 18
CALL_IDS = 1 << 16
# tasks take all cores; threads of the library's own would only keep memory of theirs
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def runs(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches [first, end) of rows whose sizes are ``most`` together, or one row that is larger."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, end
        first = end


def _loaded(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    check_vocabulary(tokenizer.get_vocab_size(), 0)
    return tokenizer


@dataclass(frozen=True)
class _Of:
    """What is kept of an encoded text."""

    value: Callable
    kind: pa.DataType
    name: str


def _encoded(path: str, of: _Of) -> Callable[[Column], Column]:
    @F.arrow_udf(of.name)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _loaded(path)
        for texts in batches:
            out = [pa.array([], of.kind)]
            for first, end in runs(pa.compute.binary_length(texts), CALL_BYTES):
                found = tokenizer.encode_batch_fast(texts.slice(first, end - first).fill_null("").to_pylist(), add_special_tokens=False)
                out.append(pa.array([of.value(e) for e in found], of.kind))
                del found
            yield pa.concat_arrays(out)
            del out, texts
            pa.default_memory_pool().release_unused()

    return encode


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt out to all of them, for work that costs more than moving a row."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if len(rows.inputFiles()) < n else rows


def bpe_ids(path: str) -> Callable[[Column], Column]:
    """Ids of a tokenizers file, a batch of texts to a call."""
    return _encoded(path, _Of(lambda e: e.ids, pa.list_(pa.int32()), "array<int>"))


def bpe_count(path: str) -> Callable[[Column], Column]:
    """How many ids a text has; the ids themselves stay in the worker."""
    return _encoded(path, _Of(len, pa.int64(), "long"))


def bpe_text(path: str, skip_special: bool = False) -> Callable[[Column], Column]:
    """Text of ids."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _loaded(path)
        for ids in batches:
            out = [pa.array([], pa.string())]
            for first, end in runs(pa.compute.list_value_length(ids), CALL_IDS):
                out.append(pa.array(tokenizer.decode_batch(ids.slice(first, end - first).to_pylist(), skip_special_tokens=skip_special), pa.string()))
            yield pa.concat_arrays(out)
            del out, ids
            pa.default_memory_pool().release_unused()

    return decode


@dataclass(frozen=True)
class Tokenizer:
    """One interface for all: ids of a text column, text of an id column where ids have one, and the special ids."""

    ids: Callable[[Column], Column]
    text: Callable[[Column], Column] | None
    special: dict[str, int | None]


def byte_text(ids: Column) -> Column:
    """The text of byte ids; special ids have none."""
    return F.decode(F.unhex(F.array_join(F.transform(F.filter(ids, lambda x: x < 256), lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8")


def tokenizer(name: str) -> Tokenizer:
    """``bytes``, or the path of a tokenizers file, whose end, start and chat tokens are found by their usual names."""
    if name == "bytes":
        return Tokenizer(byte_ids, byte_text, special_ids(BYTE_SPECIALS[EOS], start=BYTE_SPECIALS["<|im_start|>"], end=BYTE_SPECIALS["<|im_end|>"]))
    find = _loaded(name).token_to_id
    eos, bos, pad = (next((i for t in names if (i := find(t)) is not None), None) for names in (("<|endoftext|>", EOS, "</s>"), ("<|startoftext|>", "<s>"), ("<pad>", "<|pad|>")))
    check_vocabulary(_loaded(name).get_vocab_size(), eos)
    return Tokenizer(bpe_ids(name), bpe_text(name), special_ids(eos, pad, bos, find("<|im_start|>"), find("<|im_end|>")))


def special_ids(eos: int, pad: int | None = None, bos: int | None = None, start: int | None = None, end: int | None = None) -> dict[str, int | None]:
    """Special ids with their fallbacks: pad falls back to the end id, chat marks to 0."""
    return {"eos": eos, "bos": bos, "pad": eos if pad is None else pad, "im_start": start or 0, "im_end": end or 0}


def check_vocabulary(size: int | None, eos: int | None) -> None:
    if size is None or size > MAX_UINT16:
        raise ValueError("the vocabulary must fit in 16 bits")
    if eos is None:
        raise ValueError("the tokenizer has no end token")
