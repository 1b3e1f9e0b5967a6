"""Benchmark decontamination with one FM-index per shard of the training texts.

A shard is a stretch of a partition of at most about ``SHARD_BYTES`` of text
(or one longer document); nothing is shuffled. Its words become symbols, an
FM-index is built over them, and the windows of all benchmark items are
found by backward search; occurrences are located and merged into spans.

The index holds every word. With ``prune`` words that no item has become
breaks, and runs shorter than the shortest window are left out: no window can
lie there, so the index answers the same for these items and is much smaller.

The items are the stated query set; their size is checked against
``MAX_ITEM_BYTES`` before they are sent to the tasks. ``find_benchmark`` and ``remove_benchmark`` cut a larger set
into parts by a hash of the text, search part after part, and merge the spans and item lists of each document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import LOWER, UPPER, Masked, stored
from hearth.llm.fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 16 << 20
MAX_ITEM_BYTES = 64 << 20
#: Occurrences that are located at once.
LOCATE = 1 << 20

_WORD_BYTES = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
#: Lower-cases A-Z and turns every byte outside a word into a space.
_TO_WORDS = bytes(x if b in _WORD_BYTES else 0x20 for b, x in enumerate(bytes.maketrans(UPPER.encode(), LOWER.encode())))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return data.translate(_TO_WORDS).split()


class Phrases:
    """The distinct windows of the items, as rows of symbols."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item_id, data in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(data or b"")]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + window]), set()).add(item_id)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int64)
        for row, w in zip(self.symbols, owners):
            row[:len(w)] = w
        self.owners = [sorted(x for x in o if x is not None) for o in owners.values()]
        self.shortest = int(self.lengths.min(initial=window))


class Hits:
    """What one shard's search found: for each text its words, merged word spans and item ids."""

    def __init__(self, n_words: list[int], spans: dict[int, np.ndarray], items: dict[int, list]):
        self.n_words, self.spans, self.items = n_words, spans, items


def _shard_symbols(texts: list[bytes | None], phrases: Phrases, prune: bool):
    """Symbols of a shard with breaks, and per run: first symbol, text number, first word."""
    known = dict(phrases.vocabulary)
    n_words, parts, at, owner, first, length = [], [], [], [], [], 0
    for number, data in enumerate(texts):
        words = words_of(data) if data else []
        n_words.append(len(words))
        if not words:
            continue
        if prune:
            ids = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
            edge = np.flatnonzero(np.diff(np.r_[0, ids > 0, 0]))
            runs = edge.reshape(-1, 2)
            runs = runs[runs[:, 1] - runs[:, 0] >= phrases.shortest]
        else:
            ids = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words))
            runs = [(0, len(ids))]
        for a, b in runs:
            parts += [ids[a:b], np.zeros(1, np.int64)]
            at.append(length)
            owner.append(number)
            first.append(a)
            length += b - a + 1
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return symbols, np.array(at, np.int64), np.array(owner, np.int64), np.array(first, np.int64), n_words


def _merge(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of the half-open spans, as rows (start, end)."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return np.stack([start[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]], axis=1)


def search_shard(texts: list[bytes | None], phrases: Phrases, prune: bool = False) -> Hits:
    symbols, at, owner, first, n_words = _shard_symbols(texts, phrases, prune)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    if len(symbols) and len(phrases.lengths):
        index = FMIndex(symbols)
        low, high = index.search(phrases.symbols, phrases.lengths)
        counts = np.maximum(high - low, 0)
        found = np.flatnonzero(counts)
        # Occurrences are numbered through; a slice of them may begin or end inside a window's range.
        ends = np.cumsum(counts[found])
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, LOCATE):
            number = np.arange(a, min(a + LOCATE, total))
            which = np.searchsorted(ends, number, side="right")
            row = low[found][which] + number - (ends - counts[found])[which]
            place = index.locate(row)
            window = found[which]
            run = np.searchsorted(at, place, side="right") - 1
            start = first[run] + place - at[run]
            order = np.argsort(owner[run], kind="stable")
            text = owner[run][order]
            edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            for s, e in zip(edges, np.r_[edges[1:], len(text)]):
                part, doc = order[s:e], int(text[s])
                spans.setdefault(doc, []).append(_merge(start[part], start[part] + phrases.lengths[window[part]]))
                for w in np.unique(window[part]):
                    items.setdefault(doc, set()).update(phrases.owners[w])
    merged = {d: _merge(*np.concatenate(x).T) for d, x in spans.items()}
    return Hits(n_words, merged, {d: sorted(x) for d, x in items.items()})


def byte_spans(data: bytes, spans: np.ndarray) -> list[tuple[int, int]]:
    """Word spans as byte spans: from the first word's start to the last word's end."""
    words = [m.span() for m in _WORD.finditer(data)]
    return [(words[a][0], words[b - 1][1]) for a, b in spans]


def without_spans(data: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in byte_spans(data, spans):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def clean_texts(texts: list[bytes | None], phrases: Phrases, prune: bool = False) -> list[bytes | None]:
    """Texts without hit words. What a removal brings together is searched again until nothing is hit."""
    texts, check = list(texts), list(range(len(texts)))
    while check:
        hits = search_shard([texts[i] for i in check], phrases, prune)
        for j, spans in hits.spans.items():
            texts[check[j]] = without_spans(texts[check[j]], spans)
        check = [check[j] for j in hits.spans]
    return texts


def _shards(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroup batches to stretches of at most ``limit`` bytes of text (or one row)."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n + 1
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def collect_items(benchmark: DataFrame, key: str = "item_id", text: str = "text",
                  max_bytes: int = MAX_ITEM_BYTES) -> list[tuple]:
    """The items as (id, bytes), after a check of their size. Ids become strings."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)) + 16)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the items hold {size} bytes, more than {max_bytes}; find_benchmark searches them in parts")
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(key).cast("string"), F.col(text).cast("binary")).collect()
    return [(r[0], bytes(r[1])) for r in rows]


def _map_shards(docs: DataFrame, text: str, items: list[tuple], window: int, prune: bool, shard_bytes: int,
                f: Callable[[pa.Table, Phrases], pa.Table], schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        for shard in _shards(batches, "_bytes", shard_bytes):
            yield from f(shard, phrases).to_batches()
    return docs.withColumn("_bytes", F.col(text).cast("binary")).drop(text).mapInArrow(run, schema)


def _search(docs: DataFrame, items: list[tuple], key: str, text: str, window: int, prune: bool, shard_bytes: int) -> DataFrame:
    """key, row_id, n_words, items, and per merged span its words and bytes, for rows (key, row_id, text)."""
    def found(shard: pa.Table, phrases: Phrases) -> pa.Table:
        texts = shard.column("_bytes").to_pylist()
        hits = search_shard(texts, phrases, prune)
        spans = [[{"first": int(a), "last": int(b), "start": x, "end": y} for (a, b), (x, y) in zip(hits.spans[i], byte_spans(t, hits.spans[i]))]
                 if i in hits.spans else [] for i, t in enumerate(texts)]
        return pa.table({
            key: shard.column(key), "row_id": shard.column("row_id"), "n_words": pa.array(hits.n_words, pa.int64()),
            "items": pa.array([hits.items.get(i, []) for i in range(len(texts))], pa.list_(pa.string())),
            "found": pa.array(spans, pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])))})

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + T._parse_datatype_string(
        "row_id bigint, n_words bigint, items array<string>, found array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>").fields)
    return _map_shards(docs, text, items, window, prune, shard_bytes, found, schema)


def _told(hits: DataFrame, key: str) -> DataFrame:
    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    n_hit = F.aggregate("found", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return hits.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items",
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), spans.alias("spans"))


def find_hits(docs: DataFrame, items: list[tuple], key: str = "doc_id", text: str = "text", window: int = WINDOW,
              prune: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: key, n_words, n_hit (words inside an occurrence of any window), n_items, items
    (ids, sorted as strings), items_sha256 (of the comma-joined ids) and spans (merged hits as byte
    offsets of the UTF-8 text).

    Null and empty texts have no words and no hits; items without a word are never found; items with a
    null id mark words but are not listed; repeated rows are searched one by one; an empty table, or an
    empty item list, gives no hits. Other columns are ignored."""
    rows = docs.select(F.col(key).alias("_key"), F.lit(0).cast("bigint").alias("row_id"), F.col(text).alias("_text"))
    return _told(_search(rows, items, "_key", "_text", window, prune, shard_bytes), "_key").withColumnRenamed("_key", key)


def item_parts(benchmark: DataFrame, text: str = "text", max_bytes: int = MAX_ITEM_BYTES) -> list[DataFrame]:
    """``benchmark`` whole if it is within ``max_bytes``, else in parts by the text's hash, so that equal texts come together."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)) + 16)).first()[0] or 0
    if size <= max_bytes:
        return [benchmark]
    # Twice as many as would do if all parts were equal; collect_items checks each.
    parts = -(-2 * size // max_bytes)
    return [benchmark.filter(F.pmod(F.xxhash64(text), F.lit(parts)) == i) for i in range(parts)]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                   max_bytes: int = MAX_ITEM_BYTES, **options) -> DataFrame:
    """``find_hits`` for the items of a table of any size: its parts are searched one after the other, and
    each document's spans and items of all parts are united (a word that two parts hit counts once)."""
    parts = [collect_items(p, item_key, item_text, max_bytes) for p in item_parts(benchmark, item_text, max_bytes)]
    if len(parts) == 1:
        return find_hits(docs, parts[0], key, text, **options)
    options = {"window": WINDOW, "prune": False, "shard_bytes": SHARD_BYTES} | options
    rows = stored(docs.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("row_id"), F.col(text).alias("_text")), "decontam-rows")
    every = reduce(DataFrame.unionByName, [stored(_search(rows, items, "_key", "_text", **options), "decontam-hits") for items in parts])
    # A row's group has one entry per part.
    united = every.groupBy("row_id").agg(
        F.first("_key").alias("_key"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("found"))).alias("spans"))
    # Spans in order of their first word: one that begins within the last one's reach lengthens it.
    last = F.element_at
    found = F.aggregate("spans", F.expr("cast(array() as array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>)"), lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.get(done, F.size(done) - 1)["last"]),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            last(done, -1)["first"].alias("first"), F.greatest(last(done, -1)["last"], s["last"]).alias("last"),
            last(done, -1)["start"].alias("start"), F.greatest(last(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    return _told(united.withColumn("found", found), "_key").withColumnRenamed("_key", key)


def remove_hits(docs: DataFrame, items: list[tuple], text: str = "text", window: int = WINDOW, prune: bool = False,
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with every hit word removed from its text (n_chars, where there is one, counted anew).
    Texts without a hit stay as they are, null texts too; no row is lost; other columns, whatever they are called, stay."""
    own = Masked(docs)
    columns, column, count = own.df.columns, own.name[text], own.name.get("n_chars")

    def cleaned(shard: pa.Table, phrases: Phrases) -> pa.Table:
        texts = clean_texts(shard.column("_bytes").to_pylist(), phrases, prune)
        new = pa.array(texts, pa.binary()).cast(pa.string())
        out = {c: new if c == column else shard.column(c) for c in columns}
        if count and count != column:
            kind = out[count].type
            same = pc.equal(pa.chunked_array([pa.array(texts, pa.binary())]), shard.column("_bytes"))
            out[count] = pc.if_else(pc.fill_null(same, True), out[count], pc.utf8_length(new).cast(kind))
        return pa.table(out)

    return own.back(_map_shards(own.df, column, items, window, prune, shard_bytes, cleaned, own.df.schema))


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                     max_bytes: int = MAX_ITEM_BYTES, **options) -> DataFrame:
    """``remove_hits`` for the items of a table of any size. With several parts, rounds over all of them go on
    until one finds nothing: a removal may bring together words that another part holds."""
    parts = [collect_items(p, item_key, item_text, max_bytes) for p in item_parts(benchmark, item_text, max_bytes)]
    if len(parts) == 1:
        return remove_hits(docs, parts[0], text, **options)
    while True:
        for items in parts:
            docs = stored(remove_hits(docs, items, text, **options), "decontam-clean")
        rest = [find_hits(docs.select(F.lit(0).alias("k"), F.col(text).alias("t")), items, "k", "t", **options).filter("n_hit > 0") for items in parts]
        if all(r.isEmpty() for r in rest):
            return docs
