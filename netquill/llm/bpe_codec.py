"""Byte-level BPE encoding and decoding by a shuffle of the distinct words.

A text is a sequence of pre-tokens ("words"), and equal words have equal identifiers, so each distinct word of all
documents is encoded once:

1. Documents are taken in chunks of about ``chunk_chars`` characters and exploded into words and their positions. A chunk
   says of every position which of its words stands there (packed: the two have few bits a word), and ships each of its words once, however often it stands there,
   to the bucket of the word's hash. There are as many buckets as the corpus has ``BUCKET_CHARS`` characters.
2. The words of a bucket are shuffled together, come sorted by bucket, and each distinct one is encoded once: the
   lowest-ranked adjacent pair is merged first, by a heap over a linked list. Only one bucket's words are remembered.
3. Identifiers go back to the chunks, whose positions are files dealt by the hash of the chunk and stay where they are; there
   the chunks are put together again. :func:`round_trip` decodes them there,
   each identifier joined with the broadcast table of tokens and bytes; :func:`decode` does it for any table of identifiers.

A chunk is one task's group and holds whole documents, so memory is bounded by ``chunk_chars`` or the longest text.

Cases: null and empty texts have no identifiers; texts of any length are encoded whole; repeated rows and identifiers each
give a row; null identifiers stay null; an empty table gives an empty table; only the two named columns are read, so others
may clash.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.llm.common import materialize, scratch

CHUNK_CHARS, BUCKET_CHARS = 16_000_000, 8_000_000
CUT_CHARS = 1_000_000
MOST_TOKENS = 2_000_000  # of a vocabulary, which every worker holds; ranks are below
SHORT = 40
_PACK = pa.Codec("zstd", 6)


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: lines of a token in base64 and its rank, which is its identifier."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if max(ranks.values(), default=0) >= MOST_TOKENS:
        raise ValueError(f"{path}: {len(ranks)} tokens; at most {MOST_TOKENS} can be copied to every worker")
    return ranks


def encode_word(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Identifiers of one pre-token: pairs are merged from the lowest rank up, the leftmost first, in O(n log n)."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n <= SHORT:  # few pairs: the lowest is looked for
        at = list(range(n + 1))
        rank = [ranks.get(word[i : i + 2], MOST_TOKENS) for i in range(n - 1)]
        while rank and (low := min(rank)) < MOST_TOKENS:
            i = rank.index(low)
            del at[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(word[at[i] : at[i + 2]], MOST_TOKENS)
            if i:
                rank[i - 1] = ranks.get(word[at[i - 1] : at[i + 1]], MOST_TOKENS)
        return [ranks[word[a:b]] for a, b in zip(at, at[1:], strict=False)]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a byte: its end, the part before it
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], alive[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _find_by_alphabet(pattern: str) -> Callable[[str], list[str]]:
    """The matches of ``pattern``; in texts of ASCII only by a pattern whose classes are spelled out, which is faster."""
    find = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")
    if "\\p" in plain or "[" in re.sub(r"\[[^\[\]]*\]", "", plain):  # a pattern with other classes
        return find
    find_plain = re.compile(plain).findall
    return lambda text: (find_plain if text.isascii() else find)(text)


@functools.cache
def newer_letters(pattern: str) -> str:
    """A character class of the code points that the regex module calls letters or numbers and the tiktoken library, which
    has an older Unicode table, does not; empty if there are none. Asked of the library with a token for each."""
    import tiktoken

    letter = regex.compile(r"\p{L}")
    unknown = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    odd = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", unknown)]
    if not odd:
        return ""
    ranks = {bytes([b]): b for b in range(256)}
    pair = lambda i: ("a" if letter.match(chr(i)) else "1") + chr(i)
    ranks |= {pair(i).encode(): 256 + k for k, i in enumerate(odd)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    spans: list[list[int]] = []
    for i in odd:
        if len(probe.encode_ordinary(pair(i))) > 1:
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def splitter(pattern: str, new: str) -> Callable[[str], list[str]]:
    """The function that splits a text into the pre-tokens that the tiktoken library sees. ``new``: :func:`newer_letters`."""
    find = _find_by_alphabet(pattern)
    if not new:
        return find
    has_new = re.compile(f"[{new}]").search  # a table, where the regex module would try one span after the other
    far = re.compile(f"[{new[:10]}-\\U0010ffff]").search  # from the first of them on
    older = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\s[\p{L}\p{N}--[NEW]]]").replace(r"\p{L}+", r"[\p{L}--[NEW]]+").replace(r"\p{N}+", r"[\p{N}--[NEW]]+")
    find_older = regex.compile(older.replace("NEW", new), regex.V1).findall
    return lambda text: (find_older if not text.isascii() and far(text) and has_new(text) else find)(text)


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces that begin with a blank after another character: no pre-token has white space after something
    else, so none is cut."""
    at = 0
    while len(text) - at > CUT_CHARS:
        cut = regex.compile(r"(?<=\S) ").search(text, at + CUT_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _PACK.compress(raw, asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return _PACK.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as four compressed planes of bytes."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return _pack(len(words).to_bytes(4, "little") + sizes + b"".join(words))


def unpack_words(packed: bytes) -> list[bytes]:
    raw = _unpack(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)])).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def explode_words(docs: DataFrame, pattern: str, buckets: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Of ``docs`` (id, text) for each chunk a row (chunk, ids, sizes, at, of): its documents, how many words each has, the number of
    the word at each position and the bucket of each number, both packed; and rows (chunk, bucket, words): its words of a bucket
    in the order of their numbers. Frequent words have small numbers."""
    kind, new = docs.schema[0].dataType.simpleString(), newer_letters(pattern)

    def run(batches):
        split, part, chunk = splitter(pattern, new), TaskContext.get().partitionId(), 0
        numbers, places, ids, sizes, chars = _Numbers(), [], [], [], 0

        def rows():
            at = np.concatenate([np.zeros(0, np.int64), *places])
            words = np.empty(len(numbers), object)
            words[:] = [w.encode() for w in numbers]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            words, bucket = words[order], bucket[order]
            by_bucket = np.argsort(bucket, kind="stable")
            some, starts = np.unique(bucket[by_bucket], return_index=True)
            parts = [pack_words(p.tolist()) for p in np.split(words[by_bucket], starts[1:])] if len(words) else []
            n = len(some)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + chunk] * (n + 1), pa.int64()), pa.array([ids] + [None] * n, pa.list_(id_type)), pa.array([sizes] + [None] * n, pa.list_(pa.int64())), pa.array([pack_numbers(number[at])] + [None] * n, pa.binary()),
                    pa.array([pack_numbers(bucket)] + [None] * n, pa.binary()), pa.array([None, *some.tolist()], pa.int64()), pa.array([None, *parts], pa.binary()),
                ],
                ["chunk", "ids", "sizes", "at", "of", "bucket", "words"],
            )

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for piece in _pieces(text or ""):
                    words = split(piece)
                    places.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    n += len(words)
                ids.append(i)
                sizes.append(n)
                chars += len(text or "") + 1
                if chars >= chunk_chars:
                    yield rows()
                    numbers, places, ids, sizes, chars, chunk = _Numbers(), [], [], [], 0, chunk + 1
        if ids:
            yield rows()

    return docs.mapInArrow(run, f"chunk long, ids array<{kind}>, sizes array<long>, at binary, of binary, bucket long, words binary")


def token_bytes(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(token, bytes): the table of tokens, as many as the vocabulary has."""
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", to: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes of each row's identifiers in column ``to``: exploded with their positions, joined with the table
    of tokens (its size is checked) and put together by position. No identifiers give no bytes; unknown ones raise. Null
    identifiers give null."""
    rows = materialize(encoded.withColumn("__row", F.monotonically_increasing_id()), "bpe-rows")
    spots = rows.select("__row", F.posexplode(ids_col).alias("__pos", "__token"))
    known = spots.join(F.broadcast(token_bytes(encoded.sparkSession, ranks).toDF("__token", "__bytes")), "__token", "left")
    piece = F.when(F.col("__bytes").isNull(), F.raise_error(F.lit("an identifier isn't in the vocabulary"))).otherwise(F.hex("__bytes"))
    joined = known.groupBy("__row").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", piece.alias("b")))), lambda x: x["b"]), "")).alias("__whole"))
    whole = F.when(F.col(ids_col).isNotNull(), F.coalesce("__whole", F.lit(b""))).alias(to)
    return rows.join(joined, "__row", "left").select(*encoded.columns, whole)


def encoded_words(spots: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(chunk, bucket, counts, tokens): how many identifiers each word of the rows (chunk, bucket, words) has, and which; both
    packed."""
    held = spots.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        now, known = None, {}
        for batch in batches:
            counts, tokens = [], []
            for bucket, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                ids = []
                for w in unpack_words(words):
                    if (got := known.get(w)) is None:
                        got = known[w] = encode_word(held.value, w)
                    ids.append(got)
                counts.append(pack_numbers(np.fromiter(map(len, ids), np.int64, len(ids))))
                tokens.append(pack_numbers(np.fromiter(itertools.chain.from_iterable(ids), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(tokens, pa.binary())], ["chunk", "bucket", "counts", "tokens"])

    dealt = spots.where("words IS NOT NULL").select("chunk", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk long, bucket long, counts binary, tokens binary")


def _gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the slices ``which`` of ``values`` one after the other, where each begins and the last ends)."""
    n = size[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])], ends


def reassembled(spots: DataFrame, words: DataFrame, ranks: dict[bytes, int], id_col: str) -> DataFrame:
    """(id, n_tokens, ids, bytes) of the documents of :func:`explode_words`: ``ids`` are little-endian unsigned 32-bit integers,
    ``bytes`` what the table of tokens makes of them."""
    id_kind = spots.schema["ids"].dataType.elementType.simpleString()
    heads = spots.where("sizes IS NOT NULL").select("chunk", "ids", "sizes", "at", "of")
    held = spots.sparkSession.sparkContext.broadcast(list(ranks.items()))

    def run(head: pa.Table, rest: pa.Table) -> pa.Table:
        table = dict((i, b) for b, i in held.value)
        rest = rest.sort_by("bucket")
        sizes = np.array(head.column("sizes")[0].as_py(), np.int64)
        counts, tokens = (np.concatenate([np.zeros(0, np.int64), *map(unpack_numbers, rest.column(c).to_pylist())]) for c in ("counts", "tokens"))
        place = np.argsort(unpack_numbers(head.column("of")[0].as_py()), kind="stable")  # the words come by bucket, then by number
        first, size = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        first[place], size[place] = np.cumsum(counts) - counts, counts
        values, ends = _gathered(tokens, first, size, unpack_numbers(head.column("at")[0].as_py()))
        edges = ends[np.concatenate([[0], np.cumsum(sizes)])]
        kinds, which = np.unique(values, return_inverse=True)  # joined with the table of tokens, each kind once
        pieces = [table[i] for i in kinds.tolist()]
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text, places = _gathered(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(n) - n, n, which)
        cut = lambda x, at: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ids = [c.flatten() for c in head.column("ids").chunks]
        return pa.table([pa.chunked_array(ids), pa.array(np.diff(edges)), pa.array(cut(values.astype("<u4"), edges), pa.binary()), pa.array(cut(text, places[edges]), pa.binary())], [id_col, "n_tokens", "ids", "bytes"])

    return heads.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(run, f"`{id_col}` {id_kind}, n_tokens long, ids binary, bytes binary")


def _bucketed(spots: DataFrame, buckets: int) -> DataFrame:
    """Written to the shared folder in files by the hash of the chunk, so that the positions needn't be shuffled to what comes back
    to them. The entry in the catalogue is taken out again at once; the files stay."""
    name, path = f"netquill_spots_{uuid.uuid4().hex}", scratch(spots.sparkSession, "bpe-spots")
    spots.write.bucketBy(buckets, "chunk").option("path", path).format("parquet").saveAsTable(name)
    table = spots.sparkSession.table(name)
    spots.sparkSession.sql(f"DROP TABLE {name}")
    return table


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, n_tokens, ids, bytes) of every row: its text's identifiers, packed as in :func:`reassembled`, and the bytes that these
    decode to."""
    ranks = load_ranks(ranks_path)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    chars = src.agg(F.coalesce(F.sum(F.char_length("__text")), F.lit(0))).first()[0]
    spots = _bucketed(explode_words(src, pattern, 1 + chars // BUCKET_CHARS, chunk_chars), 1 + 2 * chars // max(chunk_chars, CHUNK_CHARS))
    return reassembled(spots, encoded_words(spots, ranks), ranks, id_col)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row."""
    packed = round_trip(docs, ranks_path, pattern, id_col, text_col, chunk_chars)
    byte = lambda i, k: F.substring("ids", 4 * i + k, 1)
    number = lambda i: F.conv(F.hex(F.concat(*(byte(i, k) for k in (4, 3, 2, 1)))), 16, 10).cast("int")
    ids = F.when(F.col("n_tokens") > 0, F.transform(F.sequence(F.lit(0), F.col("n_tokens").cast("int") - 1), number)).otherwise(F.array().cast("array<int>"))
    return packed.select(id_col, ids.alias("ids"))
