"""Token ids of a corpus, written as canonical Huffman blocks.

1. Every text is tokenised once and its ids are stored.
2. Global counts of the ids give one code table (``huffman``).
3. Ids are encoded per document, sent to key ranges, sorted, and joined to
   independent blocks of whole documents with a bit offset every ``EVERY`` ids.

The files are Parquet: a table of blocks (range, block number, first id's number
inside the range, keys, counts, bits, checkpoint deltas) and a table of code
lengths. Spark's committer writes them, so a lost executor leaves no half
block. What the driver holds is one count per vocabulary entry, one boundary
and one total per range.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import stored
from hearth.llm.huffman import EVERY, LIMIT, Coder, code_lengths
from hearth.session import scratch_path

END_ID = 0
#: A block is closed when it holds as many ids.
BLOCK_IDS = 1 << 18
#: Ids are coded in groups of about so many (or of one document).
CODE_IDS = 1 << 19
#: Texts are tokenised in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Parts of texts that a Python worker remembers before it starts anew.
MAX_PARTS = 800_000
#: Long parts (of up to ``LONG_BYTES`` bytes) that it remembers likewise.
MAX_LONG = 20_000
#: Parts of up to so many 8-byte words are compared by their bytes, longer ones by a dictionary of at most ``LONG_BYTES``
#: each; texts with longer parts still are encoded whole.
WORDS, LONG_BYTES = 4, 4096
_LONG, _HUGE = 8 * WORDS + 1, 8 * WORDS + 2
#: Odd multipliers that mix a part's words to the number under which it is looked up.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: What keeps the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

# White space beside a space, or a space at either end: such a text is not cut at its spaces.
_UNSAFE = re.compile(r"\s \s?| \s|\A | \Z")
#: White space other than space and line feed, by str.isspace.
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
# Bytes of white space other than space and line feed, or with which a longer one begins.
_RARE_BYTE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3])
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
#: Second bytes of the letters U+00C0 to U+00FF (the first is 0xC3).
_LATIN = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
_MARK = np.isin(np.arange(256), list(b".,;:!?#*$%&|\n"))


class Encoder:
    """Ids of texts by a tokenizer file.

    A byte-level BPE without a normaliser cuts a text before every single space that stands
    between other characters, and between a letter or digit and one of the marks ``.,;:!?#*$%&|`` or a single
    line feed, whatever surrounds them. So texts are cut there, and a new part is encoded once. A whole group of texts is
    looked up at once by a 64-bit mix of each part's bytes; the bytes themselves are compared with those
    remembered, and a text with a part that differs is encoded whole, so no mix can give wrong ids.
    Other tokenizers, texts with unusual spacing and texts that hold an added token are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        pre = said.get("pre_tokenizer") or {}
        self.added = [t["content"].encode() for t in said["added_tokens"]]
        self.in_parts = (said.get("normalizer") is None and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
                         and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.names = [np.zeros(0, np.uint64) for _ in range(WORDS)] + [np.zeros(0, np.uint16)]
        self.long: dict[bytes, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after the other, ids per part)."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def _whole(self, data: np.ndarray) -> np.ndarray:
        return np.array(self.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids, np.uint32)

    def _usual(self, data: bytes) -> bool:
        if any(t in data for t in self.added):
            return False
        text = data.decode()
        if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
            return False
        return not any(c in text for c in _RARE_SPACE) or not _UNSAFE.search(text)

    def _parts(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, whether a space stands before) of the parts of texts that begin at ``begin``."""
        n = len(data)
        latin = np.zeros(n, bool)
        latin[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
        letter, mark = _LETTER[data], _MARK[data]
        last, first = letter | latin, letter.copy()  # a letter's last byte, and its first
        first[:-1] |= latin[1:]
        feed = data == 10
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (last[:-1] & mark[1:]) | (mark[:-1] & first[1:])
        # After a run of line feeds the last one would be split off; such a run stays with what follows.
        cut[2:n] &= ~(feed[1:-1] & feed[:-2])
        spaced = np.zeros(n + 1, bool)
        spaced[1:] = data == 32
        spaced[begin] = False
        cut |= spaced
        cut[begin] = True
        start = np.flatnonzero(cut[:n])
        after = np.r_[start[1:], n]
        return start, after - np.r_[spaced[start[1:]], spaced[n]], spaced[start]

    def _names(self, raw: bytes, data: np.ndarray, start: np.ndarray, stop: np.ndarray, spaced: np.ndarray) -> list[np.ndarray]:
        """What tells parts apart, one array per component: their bytes as words (a long part: its number in the
        dictionary), and their length (or that they are long) with whether a space stands before."""
        size = stop - start
        names = [np.zeros(len(start), np.uint64) for _ in range(WORDS)]
        held = np.frombuffer(raw + bytes(8), np.uint8)
        every = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
        short = size <= 8 * WORDS
        names[0] = every[start] & _FIRST[np.minimum(size, 8)] * short
        for i in range(1, WORDS):
            at = np.flatnonzero(short & (size > 8 * i))
            names[i][at] = every[start[at] + 8 * i] & _FIRST[np.minimum(size[at] - 8 * i, 8)]
        kind = np.where(short, size, _LONG)
        for i in np.flatnonzero(~short).tolist():
            if size[i] > LONG_BYTES:
                kind[i] = _HUGE
            else:
                names[0][i] = self.long.setdefault(raw[start[i]:stop[i]], len(self.long))
        return [*names, (2 * kind + spaced).astype(np.uint16)]

    @staticmethod
    def _mix(names: list[np.ndarray]) -> np.ndarray:
        key = (names[0] ^ names[0] >> np.uint64(29)) * _MIX[0]
        for name, by in zip(names[1:], _MIX[1:]):
            key += name.astype(np.uint64, copy=False) * by
        return key ^ key >> np.uint64(32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        ids, counts = self.encode_bytes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        return np.split(ids, np.cumsum(counts)[:-1])

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of the UTF-8 texts ``data[offsets[i]:offsets[i + 1]]``."""
        n, filled = len(offsets) - 1, np.flatnonzero(offsets[1:] > offsets[:-1])
        begin, end = offsets[:-1][filled], offsets[1:][filled]
        counts = np.zeros(n, np.int64)
        if not len(filled):
            return np.zeros(0, np.uint32), counts
        raw = data.tobytes()
        if self.in_parts:
            space = data == 32
            white = space | (data == 10)
            odd = _RARE_BYTE[data]
            odd[:-1] |= space[:-1] & white[1:]
            odd[1:] |= space[1:] & white[:-1]
            odd[begin] |= space[begin]
            odd[end - 1] |= space[end - 1]
            if any(t in raw for t in self.added):
                odd[begin] = True
            doubts = np.flatnonzero(np.add.reduceat(odd, begin, dtype=np.int64)).tolist()
            whole = {i for i in doubts if not self._usual(raw[begin[i]:end[i]])}
        else:
            return self._joined([self._whole(data[a:b]) for a, b in zip(begin, end)], counts, filled)
        if len(self.keys) > MAX_PARTS or len(self.long) > MAX_LONG:
            self._forget()

        start, stop, spaced = self._parts(data, begin)
        names = self._names(raw, data, start, stop, spaced)
        key = self._mix(names)
        unique, index, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        found = place < len(self.keys)
        found[found] = self.keys[place[found]] == unique[found]
        if not found.all():
            # Parts of texts that are encoded whole are learnt too; they do no harm.
            new, at = index[~found], place[~found]
            known = names[-1][new] >> 1 != _HUGE
            ids, size = self._encode_parts([(" " if s else "") + raw[a:b].decode() if k else "" for a, b, s, k in zip(
                start[new].tolist(), stop[new].tolist(), spaced[new].tolist(), known.tolist())])
            self.keys = np.insert(self.keys, at, unique[~found])
            self.names = [np.concatenate([old, name[new]]) for old, name in zip(self.names, names)]
            self.code = np.insert(self.code, at, len(self.size) + np.arange(len(new)))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, ids])
            place = np.searchsorted(self.keys, unique)
        first = np.searchsorted(start, begin)
        code = self.code[place][back]
        other = (names[-1] >> 1 == _HUGE) | (self.names[-1][code] != names[-1]) | (self.names[0][code] != names[0])
        # Equal lengths from here on: further words matter where there are any.
        for i in range(1, WORDS):
            at = np.flatnonzero((names[-1] >> 1 > 8 * i) & (names[-1] >> 1 < _LONG))
            other[at] |= self.names[i][code[at]] != names[i][at]
        whole |= set((np.searchsorted(first, np.flatnonzero(other), side="right") - 1).tolist())
        size = self.size[code]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[code] - (ends - size), size) + np.arange(int(ends[-1]))]
        cuts = np.r_[0, ends][np.r_[first, len(start)]]
        if whole:
            return self._joined([self._whole(data[begin[i]:end[i]]) if i in whole else ids[cuts[i]:cuts[i + 1]] for i in range(len(begin))], counts, filled)
        counts[filled] = np.diff(cuts)
        return ids, counts

    @staticmethod
    def _joined(lists: list[np.ndarray], counts: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts[filled] = [len(x) for x in lists]
        return np.concatenate(lists), counts


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def _with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """Each text's ids with the end id behind them."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of the consecutive stretches of ``data`` (bytes) that ``sizes`` tells."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _values(column: pa.Array, dtype: str) -> np.ndarray:
    """All values of a binary column's rows, one after the other."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(dtype)


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
             width: int = 2) -> DataFrame:
    """(key, text_hash, row_id, n_tokens, ids): each text's ids and the end id, in ``width`` bytes each. A
    null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            group = (offsets[:-1] - offsets[0]) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                ids, counts = encoder.encode_bytes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                part, counts = batch.slice(a, b - a), counts + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(counts, pa.int64()),
                     _binary(_with_ends(ids, counts - 1, end_id).astype(f"<u{width}").view(np.uint8), counts * width)],
                    [key, "text_hash", "row_id", "n_tokens", "ids"])

    rows = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row_id"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("text_hash", T.LongType()), T.StructField("row_id", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def id_counts(tokens: DataFrame, width: int = 2) -> np.ndarray:
    """Occurrences of each id. Counted per task, then summed; one number per id reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = _values(batch.column(0), f"<u{width}")
                for a in range(0, len(ids), CODE_IDS):
                    n = np.bincount(ids[a:a + CODE_IDS], minlength=len(total))
                    n[:len(total)] += total
                    total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def _blocks(batches: Iterator[pa.RecordBatch], key: str, block_ids: int) -> Iterator[pa.RecordBatch]:
    """Sorted encoded documents of one range to blocks."""
    held, size, number, first, schema, part = [], 0, 0, 0, None, None

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        # Every document begins at a byte; a delta list's sum is its bits without padding.
        columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
                   _as_list(t.column(key)), _as_list(t.column("n_tokens")),
                   pa.array([b"".join(t.column("bits").to_pylist())], pa.large_binary()).cast(pa.binary()),
                   pa.array([b"".join(t.column("deltas").to_pylist())], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["range", "block", "first", "n_tokens", "keys", "counts", "bits", "deltas"])

    for batch in batches:
        counts, start = batch.column("n_tokens").to_numpy(), 0
        if batch.num_rows and part is None:
            part = batch.column("range")[0].as_py()
        for i, n in enumerate(counts.tolist()):
            if size and size + n > block_ids:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield close()
                held, number, first, size, start = [], number + 1, first + size, 0, i
            size += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield close()


def _as_list(column: pa.ChunkedArray) -> pa.Array:
    values = column.combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def write_blocks(tokens: DataFrame, path: str, key: str = "doc_id", width: int = 2, limit: int = LIMIT,
                 block_ids: int = BLOCK_IDS) -> None:
    """Write ``tokens`` (from ``tokenize``, stored) in ascending key order below ``path``.

    Rows are ordered by (key, text hash, row id), null keys first, and ranges are cut in that order, so
    a key with a large part of all rows is spread over several ranges."""
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens, width), limit)
    used = np.flatnonzero(lengths)
    spark.range(1).select(F.lit(json.dumps([[int(i), int(lengths[i])] for i in used])).alias("lengths")).write.parquet(f"{path}/codes")

    order = [key, "text_hash", "row_id"]
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = (tokens.select(F.struct(*order).alias("o")).repartitionByRange(n_ranges, "o")
             .groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o")))
    # One boundary per range; a boundary's table is a JSON literal, compared as a struct.
    bounds = stored(least.select("o"), "ranges").select(F.to_json(F.collect_list("o"), {"ignoreNullFields": "false"}).alias("j")).first().j
    kind = T.ArrayType(least.schema["o"].dataType).simpleString()
    number = F.size(F.filter(F.from_json(F.lit(bounds), kind), lambda b: b <= F.struct(*order))) - 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            ends = np.cumsum(batch.column("n_tokens").to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(ends // CODE_IDS)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                counts = part.column("n_tokens").to_numpy()
                bits, sizes, deltas, marks = coder.encode(_values(part.column("ids"), f"<u{width}").astype(np.int64), counts)
                columns = {n: part.column(n) for n in ("range", *order, "n_tokens")}
                columns |= {"bits": _binary(bits, sizes), "deltas": _binary(deltas.astype("<u2").view(np.uint8), 2 * marks)}
                yield pa.RecordBatch.from_pydict(columns)

    kind_of = tokens.schema[key].dataType
    fields = [T.StructField("range", T.IntegerType()), *(tokens.schema[c] for c in (*order, "n_tokens")), T.StructField("bits", T.BinaryType()), T.StructField("deltas", T.BinaryType())]
    encoded = tokens.withColumn("range", number).mapInArrow(encode, T.StructType(fields))
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("keys", T.ArrayType(kind_of)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("deltas", T.BinaryType())])
    blocks = (encoded.repartitionById(n_ranges, "range").sortWithinPartitions(*order)
              .mapInArrow(lambda it: _blocks(it, key, block_ids), schema))
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_coder(spark: SparkSession, path: str) -> Coder:
    pairs = json.loads(spark.read.parquet(f"{path}/codes").first().lengths)
    lengths = np.zeros(max((i for i, _ in pairs), default=0) + 1, np.int64)
    for i, n in pairs:
        lengths[i] = n
    return Coder(lengths)


def segments(counts: np.ndarray, deltas: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """(bit offset, ids) of each checkpoint segment of a block."""
    per_doc = -(-counts // every)
    last = np.cumsum(per_doc) - 1
    sizes = np.full(int(per_doc.sum()), every, np.int64)
    sizes[last] = counts - (per_doc - 1) * every
    padded = deltas.copy()
    doc_bits = np.add.reduceat(deltas, last - per_doc + 1)
    padded[last] += -doc_bits % 8
    return np.cumsum(padded) - padded, sizes


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Decode the files below ``path``: key, start (ids of all documents before), n_tokens, ids_crc32 (of
    the ids as little-endian unsigned 32-bit integers) and, if asked for, ids."""
    blocks, coder = spark.read.parquet(f"{path}/blocks"), read_coder(spark, path)
    totals = {r["range"]: r.n for r in blocks.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    ranges = sorted(totals)
    before = dict(zip(ranges, accumulate([0, *(totals[r] for r in ranges)])))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                keys, counts = one["keys"].values, one["counts"].values.to_numpy()
                ids = coder.decode(one["bits"].as_py(), *segments(counts, np.frombuffer(one["deltas"].as_py(), "<u2").astype(np.int64))).astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                columns = [keys, pa.array(starts + one["first"].as_py() + before[one["range"].as_py()], pa.int64()),
                           pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    fields = [T.StructField(key, blocks.schema["keys"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    return blocks.mapInArrow(decode, T.StructType(fields))


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """Tokenise ``docs``, write the files (below ``path``, else the shared scratch folder) and read them back.

    Null and empty texts hold the end id only. Rows of equal key follow each other by text hash;
    wholly equal rows are interchangeable. An empty table gives empty files. Other columns are
    ignored."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-output")
    width = 2 if Encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    tokens = stored(tokenize(docs, tokenizer, key, text, end_id, width), "tokens")
    write_blocks(tokens, path, key, width)
    return read_tokens(spark, path, key)
