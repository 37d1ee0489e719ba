"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A merge joins two neighbouring pieces into a token of the vocabulary. So if two bytes never stand
side by side inside any token, no merge ever reaches across them, and the text can be cut there:
the fragments encode independently and their ids, put one after the other, are the ids of the
whole. Words repeat, so most fragments of a batch are equal to others, and each distinct fragment is
encoded once. A cut is only certain if it does not change how the pre-tokenizer splits either side
either, so it is taken only where

* the two bytes are inside no token, the special tokens included,
* the right byte starts a character and is no apostrophe (contractions look at what follows one),
* the left character is no white space (runs of white space look at what follows them).

All of this needs a tokenizer without normalizer whose pre-tokenizer is the plain byte-level one;
others are refused.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm.arrow_text import distinct_fragments, hold_alone, ragged_take, row_blocks, text_bytes, tidy

#: Bytes of text that are encoded at once: the more, the more fragments in it are equal.
BLOCK = 2 << 20
#: Distinct fragments whose ids a worker keeps between batches.
KEPT_FRAGMENTS = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """One tokenizer file, its certain cuts, and the ids of the fragments met so far."""

    def __init__(self, path: str, kept: int = KEPT_FRAGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: certain cuts need a plain byte-level BPE without normalizer and prefix space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: an added token takes in what stands around it")
        letters = byte_letters()
        tokens = {i: bytes(letters[c] for c in word) for word, i in model["vocab"].items() if i not in added} | added
        self.token_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_length = np.array([len(x) for x in self.token_bytes], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

        self.certain = np.ones((256, 256), bool)
        for token in tokens.values():
            pair = np.frombuffer(token, np.uint8)
            self.certain[pair[:-1], pair[1:]] = False
        self.certain[[*range(9, 14), *range(28, 33)], :] = False  # left: white space
        self.certain[:, 0x80:0xC0] = False  # right: inside a character
        self.certain[:, ord("'")] = False
        self.certain = self.certain.reshape(-1)

        self.kept, self.known = kept, {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte, whether a certain cut lies before it."""
        cut = np.zeros(len(data), bool)
        if len(data) > 1:
            left, right = data[:-1], data[1:]
            cut[1:] = self.certain[(left.astype(np.uint16) << 8) | right]
            # the white space outside ASCII ends with these bytes, behind C2, 80, 81 or 9A
            wide = np.flatnonzero(cut[1:] & (left >= 0x80))
            odd = wide[wide > 0]
            odd = odd[np.isin(data[odd - 1], [0xC2, 0x80, 0x81, 0x9A])]
            cut[odd + 1] = False
        return cut

    def _learn(self, fragments: list[bytes]) -> None:
        encoded = self.tokenizer.encode_batch_fast([x.decode() for x in fragments], add_special_tokens=False)
        ids = [x.ids for x in encoded]
        first, more = len(self.known), sum(map(len, ids))
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(ids) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        lengths = np.array([len(x) for x in ids], np.int64)
        self.flat[self.used : self.used + more] = np.fromiter((i for x in ids for i in x), np.uint32, more)
        self.start[first : first + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(ids)] = lengths
        self.used += more
        self.known.update(zip(fragments, range(first, first + len(ids)), strict=True))

    def _encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their n + 1 row offsets, for rows that are short together."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = self.cuts(data)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        cut[0] = True
        starts = np.flatnonzero(cut)
        codes, fragments = distinct_fragments(data, starts)
        hold_alone(self)
        if len(self.known) > self.kept:
            self.forget()
        known = self.known
        new = [x for x in fragments if x not in known]
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        slots = np.fromiter((known[x] for x in fragments), np.int64, len(fragments))[codes]
        lengths = self.length[slots]
        ids = ragged_take(self.flat, self.start[slots], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.searchsorted(starts, offsets)]

    def _encode_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long text, window by window; windows end at certain cuts."""
        parts, start = [], 0
        while start < len(data):
            size = BLOCK
            while True:
                window = data[start : start + size]
                if start + size >= len(data):
                    break
                inner = np.flatnonzero(self.cuts(window))
                if len(inner):
                    window = window[: inner[-1]]
                    break
                size *= 2
            parts.append(self._encode_block(window, np.array([0, len(window)]))[0])
            start += len(window)
        return np.concatenate(parts)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows in turn: first row, row behind the last, their ids (uint32) and id offsets."""
        data, offsets = text_bytes(column)
        for row, end in row_blocks(offsets, BLOCK):
            block, at = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            if end == row + 1 and len(block) > BLOCK:
                ids = self._encode_long(block)
                yield row, end, ids, np.array([0, len(ids)])
            else:
                yield row, end, *self._encode_block(block, at)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        raw = ragged_take(self.token_flat, self.token_start[ids], self.token_length[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    """The tokenizer of ``path``, one in each worker process."""
    return ForcedBoundaryBpe(path)


def binary_rows(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are ``flat[offsets[i]:offsets[i + 1]]`` as little-endian bytes."""
    flat = np.ascontiguousarray(flat.astype(flat.dtype.newbyteorder("<"), copy=False))
    at = (offsets * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(flat)])


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every whole text.

    Returns one row per row of ``docs``: the id column, ``n_tokens`` (long) and ``ids`` (binary:
    unsigned 32-bit little-endian ids in order). Null and empty texts have no ids. A special
    token's string in a text is that token, as the tokenizers library has it by default. No
    shuffle: each batch of rows is encoded where it is read.
    """
    key = docs.schema[id_column]
    schema = T.StructType([key, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for row, end, ids, at in bpe.encode(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(row, end - row), pa.array(np.diff(at)), binary_rows(ids, at)], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Texts of token ids: the id column, ``n_tokens``, ``ids`` and ``decoded`` (string).

    ``ids`` is binary as from :func:`encode`; null counts as no ids.
    """
    schema = T.StructType([encoded.schema[id_column], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_buffer() or b"", "<u4")) if x.is_valid else b"" for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return encoded.select(id_column, "n_tokens", ids_column).mapInArrow(tidy(run), schema)
