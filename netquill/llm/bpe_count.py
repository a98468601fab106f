"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a doubly linked list of byte symbols. Every adjacent pair that has a merge rank
goes on a heap; the pair of the lowest rank (leftmost on ties) is popped and merged until no ranked pair
is left. The count is the number of initial symbols minus the number of merges, so no identifier is ever
looked up. Counts of short pre-tokens are memoised in each Python worker, in a table of bounded size.

Cases: null and empty texts have 0 tokens; very long texts and pre-tokens cost O(n log n); repeated rows
each return a row; an empty table returns an empty table; columns besides the two named ones are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenisation pattern that byte-level tokenizers with use_regex apply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMO_WORDS = 1_000_000
MEMO_CHARS = 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


#: Whether a text has a character from U+0500 on, below which :func:`too_new` has none.
beyond_latin = re.compile("[\u0500-\U0010ffff]").search


def too_new() -> str:
    """A character class of the code points that the regex module calls letters or numbers and the tokenizers
    library, which has an older Unicode table, does not; empty if there are none."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    odd = []
    for i in range(0x500, 0x110000):
        c = chr(i)
        if unicodedata.category(c) == "Cn" and ((letter.match(c) and len(split("a" + c)) > 1) or (number.match(c) and len(split("1" + c)) > 1)):
            odd.append(i)
    spans: list[list[int]] = []
    for i in odd:
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


class HeapBpe:
    """Counts tokens as the byte-level BPE in a tokenizers .json file would."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only a byte-level BPE without normaliser or prefix space is supported")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.find = regex.compile(PATTERN).findall
        new = too_new()
        self.new = regex.compile(f"[{new}]") if new else None
        older = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\s[\p{L}\p{N}--[NEW]]]").replace(r"\p{L}+", r"[\p{L}--[NEW]]+").replace(r"\p{N}+", r"[\p{N}--[NEW]]+")
        self.find_older = regex.compile(older.replace("NEW", new), regex.V1).findall if new else self.find
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.memo: dict[str, int] = {}

    def pretoken(self, word: str) -> int:
        """Tokens of one pre-token."""
        sym: list[str | None] = [self.symbols[b] for b in word.encode("utf-8")]
        n, rank = len(sym), self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # one of the two has been merged since
            sym[i], sym[j] = left + right, None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := prv[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
            merges += 1
        return n - merges

    def _memoised(self, word: str) -> int:
        got = self.memo.get(word)
        if got is None:
            got = self.pretoken(word)
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def words(self, text: str) -> list[str]:
        if self.new is not None and beyond_latin(text) and self.new.search(text):
            return self.find_older(text)
        return self.find(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return sum(map(self._memoised, self.words(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(self._memoised(w) for part in parts for w in self.words(part))


@functools.cache
def loaded(path: str) -> HeapBpe:
    return HeapBpe(path)


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row. ``tokenizer``: path of the .json on every machine."""

    def run(batches):
        bpe = loaded(tokenizer)
        for batch in batches:
            text = batch.column(1)
            n = pa.array([bpe.count(t) for t in text.to_pylist()], pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
