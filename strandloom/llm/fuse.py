"""Exact deduplication behind static binary-fuse filters.

A snapshot's distinct digests are dealt to shards, and each shard gets an immutable
filter. An incoming batch's distinct digests are screened by their shard's filter;
those that may be known join the snapshot's exact buckets, the others form groups of
their own. The bytes of every group with more than one row are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise

#: Keys that a shard's filter holds on average.
SHARD_KEYS = 40_000
_U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser, different for each seed."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        h = (h ^ h >> _U(33)) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ h >> _U(33)) * _U(0xC4CEB9FE1A85EC53)
        return h ^ h >> _U(33)


class BinaryFuse:
    """Three-wise binary fuse filter with 8-bit fingerprints: no false negative, about 0.4 % false positives."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three cells of each hash, in consecutive segments."""
        first = ((h >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64) * segment
        low = _U(segment - 1)
        return np.stack([first + (h & low).astype(np.int64), first + segment + (h >> _U(13) & low).astype(np.int64), first + 2 * segment + (h >> _U(26) & low).astype(np.int64)])

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ h >> _U(32)) & _U(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peels cells that a single key is left in, then fills them in the reverse order."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1000):
            if seed and seed % 8 == 0:
                segments += max(1, segments // 20)
            h = mix(keys, seed)
            places = cls._places(h, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(places.ravel(), minlength=size)
            held = np.zeros(size, np.int64)  # xor of the keys in a cell; the only one where count is 1
            for row in places:
                np.bitwise_xor.at(held, row, np.arange(n))
            order: list[tuple[np.ndarray, np.ndarray]] = []
            left = n
            while left:
                single = np.flatnonzero(count == 1)
                if not len(single):
                    break
                own, at = np.unique(held[single], return_index=True)
                order.append((own, single[at]))
                for row in places[:, own]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(held, row, own)
                left -= len(own)
            if left:
                continue
            cells = np.zeros(size, np.uint8)
            prints = cls._prints(h)
            for own, at in reversed(order):
                p = places[:, own]
                # keys of one round may share cells, but never the cell that each of them fills
                value = prints[own] ^ cells[p[0]] ^ cells[p[1]] ^ cells[p[2]] ^ cells[at]
                cells[at] = value
            if cls(seed, segment, segments, cells).contains(keys).all():
                return cls(seed, segment, segments, cells)
        raise ValueError("no seed lets the keys be peeled")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys, self.seed)
        p = self._places(h, self.segment, self.segments)
        return self._prints(h) == self.cells[p[0]] ^ self.cells[p[1]] ^ self.cells[p[2]]

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.cells.tobytes()

    @classmethod
    def load(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(data, "<i8", 3).tolist()
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, offset=24))


def shard_count(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """shard and filter, from a column ``key`` (long) of distinct keys; a shard holds SHARD_KEYS of them on average."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "filter": [BinaryFuse.build(group["key"].to_numpy().view(np.uint64)).dump()]})

    return keys.select("key", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInPandas(run, "shard int, filter binary")


def screen(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct keys of an incoming batch with ``maybe``: whether the snapshot may hold them."""

    def run(group: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        maybe = BinaryFuse.load(held["filter"].iloc[0]).contains(group["key"].to_numpy().view(np.uint64)) if len(held) else np.zeros(len(group), bool)
        return pd.DataFrame({"key": group["key"], "maybe": maybe})

    dealt = keys.select("key", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, "key long, maybe boolean")


def normalised(text: Column) -> Column:
    """Text without the characters space, tab, line feed, vertical tab, form feed and carriage return; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _grouped(rows: DataFrame, *by: str) -> DataFrame:
    """Size and best row of each group: most code points, then the smallest id."""
    best = F.max(F.struct("n_cp", (-F.col("doc_id")).alias("neg_id")))
    return rows.groupBy(*by).agg(F.sum("size").alias("size"), best.alias("best")) if "size" in rows.columns else rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), best.alias("best"))


def exact_dedup(docs: DataFrame, incoming: Column, digest_bits: int = 256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows where ``incoming`` is false are the immutable snapshot, the others the new batch. Null texts count as
    empty, and empty texts are equal to each other. Of equal texts the one with the most code points, then the
    smallest doc_id stays; rows that share the doc_id that stays are all kept. An empty table gives an empty table;
    other columns are ignored. ``digest_bits`` shortens the digest that groups are found by, for tests of the byte
    check; the result doesn't depend on it.
    """
    norm = normalised(F.col("text"))
    sha = F.sha2(norm.cast("binary"), 256)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_cp"), sha.alias("text_sha256"), F.coalesce(incoming, F.lit(False)).alias("incoming"))
    base = materialise(base.withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4)), "digests")
    old = materialise(_grouped(base.filter(~F.col("incoming")), "digest").select("digest", "size", "best.n_cp", (-F.col("best.neg_id")).alias("doc_id"), F.xxhash64("digest").alias("key")), "snapshot")
    new = _grouped(base.filter("incoming"), "digest").select("digest", "size", "best.n_cp", (-F.col("best.neg_id")).alias("doc_id"), F.xxhash64("digest").alias("key"))
    shards = shard_count(old.count())
    seen = screen(new.select("key"), build_filters(old.select("key").distinct(), shards), shards)
    screened = materialise(new.join(seen.distinct(), "key"), "screened")
    # positives meet the snapshot's exact buckets; the rest of either side is a group of its own
    positive = screened.filter("maybe").select("digest", "size", "n_cp", "doc_id")
    bucket = _grouped(old.select("digest", "size", "n_cp", "doc_id").unionByName(positive), "digest")
    alone = _grouped(screened.filter("NOT maybe").select("digest", "size", "n_cp", "doc_id"), "digest")
    groups = bucket.unionByName(alone).select("digest", "size", (-F.col("best.neg_id")).alias("keep_id"))
    rows = materialise(base.select("doc_id", "digest", "text_sha256", "n_cp").join(groups, "digest"), "grouped")
    # byte check: all normalised texts of a group are equal if the least and the greatest are
    several = rows.filter("size > 1").select("doc_id", "digest").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).join(several, "doc_id")
    if digest_bits < 256:  # a row whose own digest differs belongs to another row of the same id
        texts = texts.filter(F.substring(F.sha2(F.col("norm").cast("binary"), 256), 1, digest_bits // 4) == F.col("digest"))
    unequal = materialise(texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest"), "unequal")
    fine = rows.join(unequal, "digest", "left_anti").select("doc_id", "keep_id", F.col("size").alias("group_size"), "text_sha256")
    # groups whose bytes differ fall apart into those of equal texts
    mixed = rows.join(unequal, "digest", "left_semi").select("doc_id", "n_cp", "text_sha256")
    parts = _grouped(mixed, "text_sha256").select("text_sha256", F.col("size").alias("group_size"), (-F.col("best.neg_id")).alias("keep_id"))
    apart = mixed.join(parts, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    out = fine.unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
