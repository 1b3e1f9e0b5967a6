"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to order ``order``, pretrained on the
training documents. A byte is predicted from the longest context the trie
holds; if that context never saw it, an escape is paid and the next shorter
context is asked, with the symbols of the longer one excluded. Escapes are
estimated by method D: a context with T occurrences of D symbols gives symbol
s the share (2n(s) - 1) / 2T and the escape D / 2T; with exclusion T and D are
those of the symbols that remain. Below order 0 the remaining byte values are
equally likely. A text is preceded by start marks and closed by an end symbol
(bytes that UTF-8 never uses).

The probability of a byte depends on the last ``order`` + 1 bytes (its *gram*)
only, so each distinct gram is resolved once:

1. ``_extract``: documents are dealt into *chunks* by a hash; a chunk yields its
   distinct grams and words with their training counts, in buckets by context
   and by word.
2. ``_resolve``: a bucket holds all grams that share their last three context
   bytes, so all nodes of order 3 and more above them; nodes of order 0 to 2
   come from one table of three-byte counts (at most 2^24 numbers). Each
   chunk gets back the probabilities of its grams and the counts of its words.
3. ``_score``: a chunk's documents meet the chunk's tables and are summed.

Nothing is broadcast that grows with the data; a chunk's tables are as large as
its own distinct grams and words.

``adaptive_score`` is the other mode: a trie that starts empty and learns as it
reads one text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import LOWER, UPPER, stored

END, START = 0xFE, 0xFF
ORDER = 5
#: Bytes of text of a chunk.
CHUNK_BYTES = 32 << 20

_LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Byte values that may be predicted: all but the start mark, with the end symbol in the place of a byte UTF-8 lacks.
ALPHABET = 255


def text_bytes(data: bytes, order: int) -> np.ndarray:
    return np.frombuffer(b"\xff" * order + data + b"\xfe", np.uint8)


def grams(data: bytes, order: int) -> np.ndarray:
    """Code of the last ``order`` + 1 bytes at each byte of the text and at its end."""
    b = text_bytes(data, order).astype(np.int64)
    out = np.zeros(len(b) - order, np.int64)
    for i in range(order + 1):
        out <<= 8
        out |= b[i:len(b) - order + i]
    return out


class LowOrders:
    """Counts of the (context, symbol) pairs of order 0 to 2, from the counts of three-byte grams."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        keep = counts > 0
        self.grams, self.counts = [], []
        for k in range(3):
            g, at = np.unique(codes[keep] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.grams.append(g)
            self.counts.append(np.bincount(at, counts[keep], len(g)).astype(np.int64))


def _find(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """values of ``keys`` (0 where a key is missing)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0)


def gram_scores(codes: np.ndarray, counts: np.ndarray, low: LowOrders, order: int) -> np.ndarray:
    """log10 probability of each gram's last byte after its others.

    ``codes``: distinct grams, among them every trained one whose last three context bytes occur;
    ``counts``: how often training saw each (0: only to be scored)."""
    g, n = [None] * (order + 1), [None] * (order + 1)
    for k in range(order + 1):
        if k < 3:
            g[k], n[k] = low.grams[k], low.counts[k]
        else:
            trained = counts > 0
            g[k], at = np.unique(codes[trained] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n[k] = np.bincount(at, counts[trained], len(g[k])).astype(np.int64)
    score = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)
    above_n = above_d = np.zeros(len(codes), np.int64)  # what the context above excludes here
    for k in range(order, -1, -1):
        context = g[k] >> 8
        node, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, n[k], len(node)).astype(np.int64)
        distinct = np.bincount(at, minlength=len(node))
        mine = (codes & ((1 << 8 * (k + 1)) - 1)) >> 8
        t, d = _find(node, total, mine), _find(node, distinct, mine)
        seen = _find(g[k], n[k], codes & ((1 << 8 * (k + 1)) - 1))
        rest_t, rest_d = t - above_n, d - above_d
        hit = open_ & (seen > 0)
        score[hit] += np.log10((2 * seen[hit] - 1) / (2 * rest_t[hit]))
        miss = open_ & (seen == 0) & (rest_d > 0)
        score[miss] += np.log10(rest_d[miss] / (2 * rest_t[miss]))
        open_ &= seen == 0
        if k:
            # Counts, one order down, of the symbols that this context knows.
            down = _find(g[k - 1], n[k - 1], g[k] & ((1 << 8 * k) - 1))
            sums = np.bincount(at, down, len(node)).astype(np.int64)
            above_n, above_d = _find(node, sums, mine), d
        else:
            score[open_] -= np.log10(np.maximum(ALPHABET - d[open_], 1))
    return score


def adaptive_score(data: bytes, order: int = ORDER) -> float:
    """log10 probability of one text by a trie that starts empty and learns each byte after coding it."""
    trie: dict[bytes, Counter] = {}
    text, score = text_bytes(data, order).tobytes(), 0.0
    for i in range(order, len(text)):
        s, excluded, coded = text[i], set(), False
        for k in range(order, -1, -1):
            node = trie.get(text[i - k:i])
            if node is None:
                continue
            rest = {x: c for x, c in node.items() if x not in excluded}
            total = sum(rest.values())
            if s in rest:
                score += math.log10((2 * rest[s] - 1) / (2 * total))
                coded = True
                break
            if rest:
                score += math.log10(len(rest) / (2 * total))
            excluded |= set(node)
        if not coded:
            score -= math.log10(max(ALPHABET - len(excluded), 1))
        for k in range(order + 1):
            trie.setdefault(text[i - k:i], Counter())[s] += 1
    return score


# Tables travel as compressed columns: one row per (chunk, bucket), not one per gram or word.

def _pack(*columns: bytes) -> bytes:
    head = np.array([len(c) for c in columns], "<i8").tobytes()
    return zstandard.compress(np.array([len(columns)], "<i8").tobytes() + head + b"".join(columns), 1)


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    sizes, at, out = np.frombuffer(raw[8:8 + 8 * n], "<i8"), 8 + 8 * n, []
    for size in sizes.tolist():
        out.append(raw[at:at + size])
        at += size
    return out


def _pack_ints(values: np.ndarray) -> bytes:
    """Sorted codes as byte planes of their differences."""
    return np.diff(values, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel(), dtype=np.int64)


def _gram_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a gram: by its last three context bytes."""
    context = (codes >> 8 & 0xFFFFFF).astype(np.uint64)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


class _Extract:
    """Distinct grams and words of one chunk with training counts."""

    def __init__(self, order: int):
        self.order = order
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, bool]] = []
        self.waiting, self.n_ends = 0, 0
        self.words: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def add(self, data: bytes, train: bool) -> None:
        self.held.append((grams(data, self.order), train))
        self.waiting += len(data) + 1
        self.words[train].update(data.split())
        self.n_ends += train
        if self.waiting > 4 << 20:
            self.fold()

    def fold(self) -> None:
        for train in (True, False):
            if own := [g for g, t in self.held if t == train]:
                g, n = np.unique(np.concatenate(own), return_counts=True)
                codes, at = np.unique(np.concatenate([self.codes, g]), return_inverse=True)
                self.counts = np.bincount(at, np.concatenate([self.counts, n * train]), len(codes)).astype(np.int64)
                self.codes = codes
        self.held, self.waiting = [], 0

    def rows(self, chunk: int, n_buckets: int) -> Iterator[tuple]:
        self.fold()
        three, at = np.unique(self.codes & 0xFFFFFF, return_inverse=True)
        yield "low", chunk, 0, _pack(_pack_ints(three), np.bincount(at, self.counts, len(three)).astype("<i8").tobytes())
        bucket = _gram_buckets(self.codes, n_buckets)
        for b in np.unique(bucket).tolist():
            m = bucket == b
            yield "gram", chunk, b, _pack(_pack_ints(self.codes[m]), self.counts[m].astype("<i8").tobytes())
        split: dict[int, list[bytes]] = {}
        train = self.words[True]
        for w in train.keys() | self.words[False].keys():
            split.setdefault(zlib.crc32(w) % n_buckets, []).append(w)
        for b, words in split.items():
            words.sort()
            yield "word", chunk, b, _pack(b" ".join(words), np.fromiter((train[w] for w in words), "<i8", len(words)).tobytes())
        yield "ends", chunk, 0, _pack(np.array([self.n_ends], "<i8").tobytes())


_BLOB = "kind string, chunk bigint, bucket bigint, data binary"


def _blobs(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for kind, chunk, bucket, data in rows:
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([chunk], pa.int64()), pa.array([bucket], pa.int64()), pa.array([data], pa.binary())],
                                         ["kind", "chunk", "bucket", "data"])


def _extract(docs: DataFrame, n_chunks: int, n_buckets: int, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, _Extract] = {}
        for batch in batches:
            for chunk, train, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "train", "data"))):
                state.setdefault(chunk, _Extract(order)).add(data.translate(_LOWER_TABLE), train)
        for chunk, x in state.items():
            yield from _blobs(x.rows(chunk, n_buckets))
    return docs.select("chunk", "train", "data").repartitionById(n_chunks, F.col("chunk").cast("int")).mapInArrow(run, _BLOB)


def _low_orders(parts: DataFrame) -> LowOrders:
    """Sums the three-byte counts; at most 2^24 of them, however large the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                codes, counts = _unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(_unpack_ints(codes), pa.int64()), pa.array(np.frombuffer(counts, "<i8"), pa.int64())], ["code", "n"])
    rows = (parts.filter("kind = 'low'").select("data").mapInArrow(run, "code bigint, n bigint")
            .groupBy("code").agg(F.sum("n").alias("n")).toArrow())
    return LowOrders(rows["code"].to_numpy(), rows["n"].to_numpy())


def _resolve(parts: DataFrame, n_buckets: int, low: LowOrders, order: int) -> DataFrame:
    """For each chunk and bucket its grams' scores and its words' counts; and per bucket how many
    distinct words training saw and how often (kind ``sizes``)."""
    def grams_of(chunks: list[int], blobs: list[bytes], bucket: int) -> Iterator[tuple]:
        tables = [(_unpack_ints(a), np.frombuffer(b, "<i8")) for a, b in map(_unpack, blobs)]
        codes, at = np.unique(np.concatenate([c for c, _ in tables]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([n for _, n in tables]), len(codes)).astype(np.int64)
        score = gram_scores(codes, counts, low, order).astype("<f4")
        ends = np.cumsum([len(c) for c, _ in tables])
        for chunk, (own, _), e in zip(chunks, tables, ends):
            yield "gram", chunk, bucket, _pack(_pack_ints(own), score[at[e - len(own):e]].tobytes())

    def words_of(chunks: list[int], blobs: list[bytes], bucket: int) -> Iterator[tuple]:
        total: Counter = Counter()
        tables = [(a.split(), np.frombuffer(b, "<i8")) for a, b in map(_unpack, blobs)]
        for words, counts in tables:
            for w, n in zip(words, counts.tolist()):
                total[w] += n
        for chunk, (words, _) in zip(chunks, tables):
            yield "word", chunk, bucket, _pack(b" ".join(words), np.fromiter((total[w] for w in words), "<i8", len(words)).tobytes())
        seen = [n for n in total.values() if n]
        yield "sizes", -1, bucket, _pack(np.array([len(seen), sum(seen)], "<i8").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[list, list]] = {}
        for batch in batches:
            for kind, chunk, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "bucket", "data"))):
                chunks, blobs = held.setdefault((kind, bucket), ([], []))
                chunks.append(chunk)
                blobs.append(data)
        for kind, bucket in list(held):
            chunks, blobs = held.pop((kind, bucket))
            yield from _blobs((grams_of if kind == "gram" else words_of)(chunks, blobs, bucket))

    return (parts.filter("kind IN ('gram', 'word')").repartitionById(n_buckets, F.col("bucket").cast("int"))
            .select("kind", "chunk", "bucket", "data").mapInArrow(run, _BLOB))


def _score(docs: DataFrame, resolved: DataFrame, order: int, n_all: int, n_distinct: int, n_ends: int, key_type: T.DataType) -> DataFrame:
    def run(texts: pa.Table, tables: pa.Table) -> pa.Table:
        codes, scores, counts = [], [], {}
        for kind, data in zip(tables["kind"].to_pylist(), tables["data"].to_pylist()):
            a, b = _unpack(data)
            if kind == "gram":
                codes.append(_unpack_ints(a))
                scores.append(np.frombuffer(b, "<f4").astype(np.float64))
            else:
                counts.update(zip(a.split(), np.frombuffer(b, "<i8").tolist()))
        codes, scores = np.concatenate(codes or [np.zeros(0, np.int64)]), np.concatenate(scores or [np.zeros(0)])
        rank = np.argsort(codes)
        codes, scores = codes[rank], scores[rank]
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for data in texts["data"].to_pylist():
            data = data.translate(_LOWER_TABLE)
            g, n = np.unique(grams(data, order), return_counts=True)
            at = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
            if (codes[at] != g).any():
                raise RuntimeError("a chunk's tables lack a gram of its texts: the documents changed between two passes")
            c = np.array([*map(counts.__getitem__, data.split()), n_ends], np.int64)
            out["n_tokens"].append(len(c))
            out["n_known"].append(int((c > 0).sum()))
            out["base_score"].append(float(np.log10(c + 1).sum() - len(c) * math.log10(n_all + n_distinct + 1)))
            out["score"].append(float((scores[at] * n).sum()))
        return pa.table({"_key": texts["_key"], "held_out": pa.array([not x for x in texts["train"].to_pylist()], pa.bool_()),
                         "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
                         "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    schema = T.StructType([T.StructField("_key", key_type)] + T._parse_datatype_string(
        "held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double").fields)
    tables = resolved.filter("kind != 'sizes'")
    return docs.groupBy("chunk").cogroup(tables.groupBy("chunk")).applyInArrow(run, schema)


def _chunked(docs: DataFrame, key: str, text: str, train: Column, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(_key, train, data, chunk), and the number of chunks. Rows are dealt by a hash of key and text;
    wholly equal rows that outgrow a chunk are spread over several by row number."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(train, F.lit(True)).alias("train"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data"), F.xxhash64(text).alias("hash"))
    sizes = rows.groupBy("_key", "hash").agg(F.sum(F.octet_length("data") + 1).alias("bytes"))
    sizes = stored(sizes.groupBy((F.col("bytes") > chunk_bytes).alias("hot"), F.when(F.col("bytes") > chunk_bytes, F.col("_key")).alias("k"),
                                 F.when(F.col("bytes") > chunk_bytes, F.col("hash")).alias("h")).agg(F.sum("bytes").alias("bytes")), "chunk-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    n = max(-(-total // chunk_bytes), spark.sparkContext.defaultParallelism)
    salt = F.lit(0)
    if not sizes.filter("hot").isEmpty():
        hot = sizes.filter("hot").select("k", "h", F.ceil(F.col("bytes") / chunk_bytes).alias("parts"))
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = rows.join(hot, rows["_key"].eqNullSafe(hot.k) & (rows.hash == hot.h), "left")
        salt = F.coalesce(F.pmod("row", "parts"), F.lit(0))
    chunk = F.pmod(F.xxhash64("_key", "hash", salt), F.lit(n)).alias("chunk")
    return rows.select("_key", "train", "data", chunk), n


def ppm_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``train``: whether a row is learnt from (null: yes). Texts are lower-cased A-Z; score is the PPM
    model's log10 probability of the UTF-8 bytes and the end; tokens are words split at ASCII white
    space and one end; base_score is their add-one unigram log10 probability. Null texts count as
    empty: one token, the end. Repeated rows each count in training. Without a training row every
    byte is equally likely and train_tokens is 0. Other columns are ignored; an empty table gives
    an empty table. ``order`` is at most 6 and at least 2."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    rows, n_chunks = _chunked(docs, key, text, train, chunk_bytes)
    # As many buckets of grams and words as chunks, so a bucket's tables stay as small however large the corpus is.
    n_buckets = max(1, n_chunks)
    parts = stored(_extract(rows, n_chunks, n_buckets, order), "ppm-parts")
    resolved = stored(_resolve(parts, n_buckets, _low_orders(parts), order), "ppm-tables")

    def sums(df: DataFrame, n: int) -> list[int]:
        """Element-wise sums of short number rows (one per bucket or chunk)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n, np.int64)
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    total += np.frombuffer(_unpack(data)[0], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], [f"n{i}" for i in range(n)])
        r = df.select("data").mapInArrow(run, ", ".join(f"n{i} bigint" for i in range(n))).agg(*(F.sum(f"n{i}") for i in range(n))).first()
        return [x or 0 for x in r]

    n_distinct, n_words = sums(resolved.filter("kind = 'sizes'"), 2)
    (n_ends,) = sums(parts.filter("kind = 'ends'"), 1)
    n_all, n_distinct = n_words + n_ends, n_distinct + (n_ends > 0)
    out = _score(rows, resolved, order, n_all, n_distinct, n_ends, docs.schema[key].dataType)
    return out.select(F.col("_key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")
