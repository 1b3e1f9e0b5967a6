"""SimHash near-duplicates with pivot distance tables.

Fingerprints are computed inside each row. Only distinct fingerprints are
compared. Two of them within ``max_bits`` differing bits agree on all but
``max_bits`` of ``max_bits + 3`` bit segments, so grouping them by every choice of
three segments brings each such pair together in some block. Inside a block the
Hamming distances to ``PIVOTS`` reference fingerprints are tabulated once; by
the triangle inequality a pair whose distances to any pivot differ by more
than ``max_bits`` is discarded, and the rest is verified. A block yields a
spanning forest of its links (at most one per member), never all its pairs.

Blocks hold distinct fingerprints that share about 38 of 64 bits, so a block is
bounded however large a group of copies is. Blocks over ``LARGE`` members
probe the fingerprints that differ in up to ``max_bits`` of the free bits
instead of scanning the table. Components are found by ``components``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import LOWER, UPPER, Masked, stored
from hearth.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PIVOTS = 24
LARGE = 3000
#: Bytes of text that are split into words at once.
CHUNK = 1 << 20

_LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(data: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes at a time."""
    start = 0
    while start < len(data):
        end = len(data)
        if start + size < end and (m := _SPACE.search(data, start + size)):
            end = m.start()
        yield data[start:end].split()  # bytes.split: exactly the white space of the contract
        start = end


def fingerprint(data: bytes, k: int = SHINGLE) -> int:
    """64-bit SimHash (unsigned) of lower-cased UTF-8 text; see ``fingerprint_column``."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_chunks(data.translate(_LOWER_TABLE)):
        words = tail + words
        digests = b"".join([xxhash.xxh64_digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(k)))])
        if digests:
            counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(digests) // 8
        tail = words[len(words) - k + 1:] if len(words) >= k else words
    if not total:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(tail), SEED)) if tail else 0
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes())


def fingerprint_column(text: Column, k: int = SHINGLE) -> Column:
    """Fingerprint as a signed bigint. A-Z are lower-cased; words are split at ASCII white space;
    shingles are ``k`` words joined by a space, repeats included; fewer words make one shingle, no
    word (null, empty) makes fingerprint 0. A bit is set if over half the shingles' hashes set it."""
    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        out = np.array([fingerprint(t, k) if t is not None else 0 for t in texts], np.uint64)
        return pd.Series(out.view(np.int64))
    return simhash(text.cast("binary"))


def masks(max_bits: int) -> list[int]:
    """One mask for each choice of three of ``max_bits + 3`` segments of the 64 bits."""
    n = max_bits + 3
    ends = [round(64 * i / n) for i in range(n + 1)]
    segments = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(ends)]
    return [sum(c) for c in itertools.combinations(segments, 3)]


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Fixed pseudo-random fingerprints, the same everywhere."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(n)], np.uint64)


def forest_by_table(fps: np.ndarray, max_bits: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs: a spanning forest of the links among distinct fingerprints."""
    distances = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    left, found = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x, close = queue.pop(), left
            for j in range(len(pivots)):
                if len(close) < 16:
                    break
                close = close[np.abs(distances[close, j] - distances[x, j]) <= max_bits]
            close = close[np.abs(distances[close] - distances[x]).max(axis=1, initial=0) <= max_bits]
            near = close[np.bitwise_count(fps[close] ^ fps[x]) <= max_bits]
            if len(near):
                found += [(x, int(y)) for y in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return found


def forest_by_probes(fps: np.ndarray, max_bits: int, mask: int, step: int = 2000) -> list[tuple[int, int]]:
    """The same for a large block: members agree on ``mask``, so neighbours differ in the free bits."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    flips = np.array([sum(c) for r in range(1, max_bits + 1) for c in itertools.combinations(free, r)], np.uint64)
    order = np.argsort(fps)
    ranked, seen, found = fps[order], np.zeros(len(fps), bool), []
    for first in range(len(fps)):
        if seen[first]:
            continue
        seen[first], front = True, [first]
        while front:
            part, front = np.array(front[:step]), front[step:]
            probe = ranked[part][:, None] ^ flips[None, :]
            at = np.minimum(np.searchsorted(ranked, probe), len(ranked) - 1)
            hit = (ranked[at] == probe) & ~seen[at]
            if hit.any():
                target, index = np.unique(at[hit], return_index=True)
                origin = part[np.nonzero(hit)[0][index]]
                seen[target] = True
                front += target.tolist()
                found += zip(origin.tolist(), target.tolist())
    return [(int(order[a]), int(order[b])) for a, b in found]


def _block_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (block, key): the links of each (block, key) group."""
    pivots, all_masks = reference_fingerprints(), masks(max_bits)

    def links(block: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (key[1:] != key[:-1])])
        ends = np.r_[starts[1:], len(fp)]
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            members = fp[s:e].view(np.uint64)
            pairs = (forest_by_table(members, max_bits, pivots) if e - s <= LARGE
                     else forest_by_probes(members, max_bits, all_masks[block[s]]))
            a += [fp[s + x] for x, _ in pairs]
            b += [fp[s + y] for _, y in pairs]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    held = []  # pieces of the last group, which may go on in the next batch; joined once
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(3)]
        if held and all(x[0] == x[-1] == h[-1] for x, h in zip(now[:2], held[-1])):
            held.append(now)
            continue
        now = [np.concatenate(x) for x in zip(*held, now)]
        last = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut and (out := links(*(x[:cut] for x in now))):
            yield out
        held = [[x[cut:] for x in now]]
    if held and (out := links(*(np.concatenate(x) for x in zip(*held)))):
        yield out


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links among the distinct fingerprints in column ``fp``, enough of them to connect
    whatever the links of at most ``max_bits`` differing bits connect."""
    keys = F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
                     for i, m in enumerate(masks(max_bits))))
    rows = fps.select("fp", F.inline(keys)).select("block", "key", "fp")
    return (rows.repartition("block", "key").sortWithinPartitions("block", "key")
            .mapInArrow(lambda it: _block_links(it, max_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(key, text_hash, fp, component_id) per row: the fingerprint, and the smallest key reachable over
    links of at most ``max_bits`` bits, the own included.

    Texts without a word share fingerprint 0 and are linked like any other. Equal texts share a
    fingerprint, so copies are never expanded into pairs. A row whose key is null takes part; its
    component_id is null only if no row of its component has a key. Other columns are ignored; an
    empty table gives an empty table."""
    rows = stored(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("text_hash"),
                              fingerprint_column(F.col(text), k).alias("fp")), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("_key").alias("least")), "simhash-distinct")
    member = stored(components(near_links(distinct.select("fp"), max_bits)), "simhash-members")
    joined = distinct.join(member, distinct.fp == member.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least")
    joined = stored(joined, "simhash-classes")
    smallest = stored(joined.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-smallest")
    label = stored(joined.select("fp", "component").join(smallest, "component").select("fp", "component", "component_id"), "simhash-labels")
    return rows.join(label, "fp").select(F.col("_key").alias(key), "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest key stays (null
    keys last, then the smallest text hash; of wholly equal rows one)."""
    own = Masked(docs)
    docs, key, text = own.df, own.name[key], own.name[text]
    found = near_duplicates(docs, key, text, **options)
    first = found.groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("text_hash").alias("h"))).alias("s"))
    rows = found.groupBy(F.col(key).alias("k"), F.col("text_hash").alias("h")).agg(F.count("*").alias("rows"))
    first = stored(first.select("s.k", "s.h"), "simhash-first")
    stay = stored(first.join(rows, first.k.eqNullSafe(rows.k) & (first.h == rows.h)).select(first.k, first.h, "rows"), "simhash-stay")
    on = docs[key].eqNullSafe(F.col("k")) & (F.xxhash64(docs[text]) == F.col("h"))
    if stay.filter("rows > 1").isEmpty():
        return own.back(docs.join(stay, on, "left_semi"))
    # Some survivors are repeated rows: of those only, one each is taken.
    twice = docs.join(stay.filter("rows > 1"), on, "left_semi").dropDuplicates([key, text])
    return own.back(docs.join(stay.filter("rows = 1"), on, "left_semi").unionByName(twice))
