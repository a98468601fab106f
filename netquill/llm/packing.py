"""Packing as vector bin packing.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. Each document's full
multiples of the token limit are sequences of their own; the remainders wait in a bounded buffer. An open
sequence takes, of the buffered remainders that fit all limits, the one with the largest dot product of its size
vector and the sequence's free capacity vector (both relative to the limits); when none fits, the largest one is
cut to fill what is left. Only a task's last sequence can be short; it is cut at powers of two, which need no
padding. Each task packs the rows it reads, so nothing is shuffled or gathered, and a task that runs again gives
the same sequences.

``loss_from`` names a column with the number of a row's first tokens that bear no loss (an instruction's prompt).

Cases: a null or empty text is only the end token; a null or negative ``loss_from`` counts as 0; texts of any
length are read whole; repeated rows are packed each; an empty table gives an empty table; only the named columns
are read, so others may clash.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netquill.llm.bpe_count import PATTERN, beyond_latin, byte_symbols, too_new

BUFFER = 4096


class Encoder:
    """Token ids as ``tokenizers`` gives them for a byte-level BPE file, by the faster merge loop of ``tiktoken``; texts
    with special strings or with characters that are letters for one library only go to ``tokenizers`` itself."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        byte = {c: i for i, c in enumerate(byte_symbols())}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self.fast = None
        if made == sorted(made) and all(c in byte for t in vocab for c in t):
            self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})
        new = too_new()
        self.new = regex.compile(f"[{new}]" if new else r"(?!)")
        self.added = added

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        odd = any(a in text for a in self.added) or (beyond_latin(text) and self.new.search(text))
        if self.fast is None or odd:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


@functools.cache
def loaded(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Packs one task's documents. ``out`` collects (doc, start, length, crc, doc tokens, sequence, offset). A piece is (doc, its
    identifiers, where they start in the document, the document's tokens); what is buffered holds no more than its own."""

    def __init__(self, tokens: int, segments: int, loss: int, first_id: int):
        self.limit = np.array([tokens, segments, loss], np.int64)
        self.next, self.out = first_id, []
        self.size = np.zeros((2 * BUFFER, 3), np.int64)
        self.held: list = []  # (piece, loss_from) of each buffered remainder

    def add(self, doc, ids: np.ndarray, loss_from: int) -> None:
        step = int(min(self.limit[0], self.limit[2]))  # a piece of so many tokens is within both limits
        full = len(ids) - len(ids) % step
        for at in range(0, full, step):
            piece = (doc, ids[at : at + step], at, len(ids))
            if step == self.limit[0]:
                self._emit([piece])
            else:
                self._hold(piece, loss_from)
        if full < len(ids):
            self._hold((doc, ids[full:], full, len(ids)), loss_from)
        if len(self.held) >= BUFFER:
            self.pack(BUFFER // 2)

    @staticmethod
    def _size(piece, loss_from: int) -> tuple[int, int, int]:
        _, ids, start, _ = piece
        return len(ids), 1, max(0, start + len(ids) - max(start, loss_from))

    def _hold(self, piece, loss_from: int) -> None:
        doc, ids, start, total = piece
        piece = (doc, ids.copy(), start, total)  # not the whole document's
        if len(self.held) == len(self.size):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.size[len(self.held)] = self._size(piece, loss_from)
        self.held.append((piece, loss_from))

    def _take(self, i: int):
        got, last = self.held[i], self.held.pop()
        if i < len(self.held):
            self.held[i] = last
            self.size[i] = self.size[len(self.held)]
        return got[0]

    def pack(self, leave: int) -> None:
        weight = 1.0 / self.limit
        while len(self.held) > leave:
            free, pieces = self.limit.copy(), []
            while self.held and free[0] and free[1]:
                size = self.size[: len(self.held)]
                fits = (size <= free).all(1)
                value = np.where(fits, size @ (free * weight * weight), -1.0)
                i = int(value.argmax())
                if value[i] < 0:
                    break
                free -= self.size[i]
                pieces.append(self._take(i))
            if self.held and free[0] and free[1] and free[2]:  # nothing fits: cut the largest
                i = int(self.size[: len(self.held), 0].argmax())
                n = int(min(free[0], free[2], self.size[i, 0] - 1))
                (doc, ids, start, total), loss_from = self.held[i]
                if n > 0:
                    pieces.append((doc, ids[:n], start, total))
                    rest = (doc, ids[n:], start + n, total)
                    self.held[i], self.size[i] = (rest, loss_from), self._size(rest, loss_from)
            self._emit(pieces)

    def finish(self) -> None:
        self.pack(0)

    def _emit(self, pieces: list) -> None:
        total = sum(len(ids) for _, ids, _, _ in pieces)
        if total < self.limit[0] and not self.held and total & (total - 1):  # the last one: cut at powers of two
            room, part = 1 << (total.bit_length() - 1), []
            for k, (doc, ids, start, n_doc) in enumerate(pieces):
                n = min(room, len(ids))
                part.append((doc, ids[:n], start, n_doc))
                room -= n
                if not room:
                    rest = ([(doc, ids[n:], start + n, n_doc)] if n < len(ids) else []) + pieces[k + 1 :]
                    break
            self._emit(part)
            return self._emit(rest)
        offset = 0
        for doc, ids, start, n_doc in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n_doc, self.next, offset))
            offset += len(ids)
        self.next += 1
        return None


def pack(df: DataFrame, tokenizer: str, tokens: int = 1024, segments: int = 128, loss: int | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece. ``segments``: pieces a sequence may
    hold; where texts are shorter than ``tokens`` / ``segments`` on average this limit, and not the tokens, ends sequences."""
    if min(tokens, segments, loss or tokens) < 1:
        raise ValueError("limits must be positive")
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), F.greatest(F.lit(0), F.coalesce(F.col(loss_from).cast("long"), F.lit(0))).alias("__from") if loss_from else F.lit(0).alias("__from"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode, kind = loaded(tokenizer), None
        packer = Packer(tokens, segments, loss or tokens, TaskContext.get().partitionId() << 33)

        def flush():
            rows, packer.out = packer.out, []
            cols = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], [id_col, *names])

        for batch in batches:
            kind = batch.column(0).type
            for doc, text, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(doc, np.append(encode(text), np.uint32(end_id)), skip)
            yield flush()
        if kind is not None:
            packer.finish()
            yield flush()

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))
