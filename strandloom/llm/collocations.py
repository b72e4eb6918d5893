"""Collocations by SON partitioning: complete mining of each shard, the union of what is frequent there, one exact count of all.

The documents are dealt to SHARDS shards, and a phrase that occurs SUPPORT times occurs SUPPORT / SHARDS times in one of
them, however uneven they are. With so small a support more than SUPPORT - 1 shards would lower the local one to a single
occurrence; a shard therefore grows with the corpus and is itself mined by many tasks: blocks of documents are counted in
memory, and ranges of hashes, as many as the corpus needs, add up what all blocks of a shard hold.

Mining works on 64-bit hashes of phrases: equal hashes can only add candidates. The union becomes a bit map of a bounded
size, which passes every candidate and, the fuller it is, the more phrases besides. The second pass counts as text
whatever the map lets through, all its occurrences, so that its counts are exact and the support decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.storage import materialise

#: Words of a phrase, occurrences, shards, share of a phrase's occurrences in a longer one that absorbs it, rows of a language.
MAX_WORDS, SUPPORT, SHARDS, ABSORB_PERCENT, TOP = 3, 10, 4, 50, 2000
#: Tokens that a task holds before it counts and emits them; bits of the map for each candidate, and the most bits of it (128 MB).
BLOCK_TOKENS, BITS_EACH, MOST_BITS = 1_500_000, 16, 2**30
#: Bytes of text, times the words of a phrase, for each range of hashes: a range has some 2,000,000 distinct phrases of blocks.
BYTES_OF_PART = 12_000_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz.......... ")
_U = np.uint64
_NO_LANGUAGE = "und"


class _Ids(dict):
    """Numbers of words in the order of their first use; 0 is the border of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def pieces(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, with b"." between pieces and at the end."""
    return (text or b"").translate(_FOLD).replace(b".", b" . ").split() + [b"."]


def grams(tokens: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``most`` words: the distinct phrases and their occurrences.

    A phrase of one word is the word's number; a longer one is the index of its beginning among the distinct phrases
    of one word less, and the number of its last word, in the upper and lower half of 64 bits.
    """
    at = np.full(len(tokens), -1, np.int64)
    for k in range(1, most + 1):
        if k == 1:
            places, keys = np.flatnonzero(tokens), tokens[tokens != 0]
        else:
            places = np.flatnonzero((at[: len(at) - k + 1] >= 0) & (tokens[k - 1 :] != 0))
            keys = (at[places] << 32) | tokens[places + k - 1]
        found, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.full(len(tokens), -1, np.int64)
        at[places] = back
        yield found, times


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashed(found: list[np.ndarray], words: np.ndarray, seed: int) -> list[np.ndarray]:
    """64-bit hashes of the phrases of each size, from the hashes of words by number."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for k, keys in enumerate(found):
            last = words[keys & 0xFFFFFFFF]
            before = out[k - 1][keys >> 32] if k else np.full(len(keys), seed, _U)
            out.append(_mixed(before * _U(0x9E3779B97F4A7C15) + last))
    return out


class _Block:
    """Token numbers of documents by key, until there are enough of them to count."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids, self.held, self.tokens = _Ids(), {}, 0

    def add(self, key: tuple, text: bytes | None) -> bool:
        words = pieces(text)
        self.held.setdefault(key, []).append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.tokens += len(words)
        return self.tokens >= BLOCK_TOKENS

    def counted(self) -> Iterator[tuple[tuple, list[np.ndarray], list[np.ndarray], list[np.ndarray], list[bytes]]]:
        """For each key: distinct phrases, occurrences and hashes by size, and the words by number."""
        words = list(self.ids)
        codes = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
        for key, parts in self.held.items():
            found, times = map(list, zip(*grams(np.concatenate(parts), self.most), strict=True))
            yield key, found, times, hashed(found, codes, xxhash.xxh64_intdigest(key[0].encode())), words
        self.clear()


def _phrases(found: list[np.ndarray], size: int, chosen: np.ndarray, words: list[bytes]) -> list[bytes]:
    """The chosen phrases of a size as text."""
    columns, at = [], chosen
    for k in range(size - 1, -1, -1):
        keys = found[k][at]
        columns.append([words[i] for i in (keys & 0xFFFFFFFF).tolist()])
        at = keys >> 32
    return [b" ".join(row) for row in zip(*reversed(columns), strict=True)]


def _mine(most: int, parts: int):
    """Phrases of each block by ranges of their hashes: a row for each range and shard, with the sorted hashes and the counts as bytes."""
    edges = np.array([-(-(k << 64) // parts) for k in range(1, parts)], _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(most)

        def emit() -> Iterator[pa.RecordBatch]:
            for key, _, times, codes, _ in block.counted():
                h, n = np.concatenate(codes), np.minimum(np.concatenate(times), 2**32 - 1).astype(np.uint32)
                order = np.argsort(h)
                h, n = h[order], n[order]
                cuts = np.r_[0, np.searchsorted(h, edges), len(h)]
                held = np.flatnonzero(cuts[1:] > cuts[:-1])
                for some in np.array_split(held, max(1, len(h) // 500_000)):
                    part = lambda x: pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), key[1], np.int32)), part(h), part(n)], ["part", "shard", "h", "n"])

        for batch in batches:
            for lang, shard, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block.add((lang, shard), text):
                    yield from emit()
        yield from emit()

    return run


def _frequent(least: int):
    """Hashes that some shard holds often enough, of rows of hash ranges sorted by range; one range is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        at = None

        def kept() -> pa.RecordBatch:
            found = [np.zeros(0, _U)]
            for rows in held.values():
                h, n = (np.concatenate(x) for x in zip(*rows, strict=True))
                order = np.argsort(h)
                h, n = h[order], n[order].astype(np.int64)
                starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                found.append(h[starts][np.add.reduceat(n, starts) >= least])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["h"])

        for batch in batches:
            for part, shard, h, n in zip(*batch.columns, strict=True):
                if part.as_py() != at:
                    yield kept()
                    at = part.as_py()
                held.setdefault(shard.as_py(), []).append((np.frombuffer(h.as_buffer(), _U).copy(), np.frombuffer(n.as_buffer(), np.uint32).copy()))
        yield kept()

    return run


def _count(most: int, shift: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bits = _Block(most), np.frombuffer(shared.value, np.uint8)

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang,), found, times, codes, words in block.counted():
                total = int(times[0].sum())
                rows = [([0], [b""], [total])] if total else []
                for k in range(most):
                    at = codes[k] >> _U(shift)
                    chosen = np.flatnonzero((bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1)
                    for i in range(0, len(chosen), 100_000):
                        part = chosen[i : i + 100_000]
                        rows.append(([k + 1] * len(part), _phrases(found, k + 1, part, words), times[k][part].tolist()))
                for size, phrase, n in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block.add((lang,), text):
                    yield from emit()
        yield from emit()

    return run


def _bit_map(candidates: DataFrame) -> tuple[bytes, int]:
    """A map of the leading bits of the candidates' hashes, and by how many bits a hash is shifted to find its place."""
    n = candidates.count()
    width = min(max(15, (BITS_EACH * n).bit_length()), MOST_BITS.bit_length() - 1)
    place = F.shiftrightunsigned("h", 64 - width) + 1
    rows = candidates.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    held = bytearray(2**width // 8)
    for row in rows.toLocalIterator():  # at most MOST_BITS in all
        at = (row["bucket"] - 1) * 4096
        held[at : at + 4096] = row["bits"]
    return bytes(held), 64 - width


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = MAX_WORDS, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """lang, size, phrase and n: every phrase of 1 to ``most`` words that occurs ``support`` times in its language.

    A row of size 0 for each language has the number of all its words. Occurrences lie within pieces and may overlap.
    """
    lang, raw = F.coalesce(F.col(lang_col).cast("string"), F.lit(_NO_LANGUAGE)).alias("lang"), F.col(text_col).cast("binary").alias("text")
    shard = F.pmod(F.xxhash64(F.col(id_col), F.lit(13)), F.lit(shards)).cast("int").alias("shard")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    mined = docs.select(lang, shard, raw).mapInArrow(_mine(most, -(-most * size // BYTES_OF_PART) or 1), "part int, shard int, h binary, n binary")
    local = mined.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent(-(-support // shards)), "h long")
    bits, shift = _bit_map(materialise(local, "candidates"))
    counted = docs.select(lang, raw).mapInArrow(_count(most, shift, docs.sparkSession.sparkContext.broadcast(bits)), "lang string, size int, phrase binary, n long")
    return counted.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n")).filter((F.col("n") >= support) | (F.col("size") == 0))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits; it is at most 1000000, as a is at most l and r."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = MAX_WORDS, support: int = SUPPORT, shards: int = SHARDS, absorb_percent: int = ABSORB_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language by their weakest cut.

    A null text is empty, a null language ``und`` (together with rows that say so), a null id an id like others. Repeated
    rows count as often as they stand. Ties of cuts go to the earliest one, ties of score to the more frequent phrase, then
    to the lesser one by bytes. Texts without words and empty tables give no rows; other columns are ignored.
    """
    held = materialise(frequent_phrases(docs, text_col, lang_col, id_col, most, support, shards), "phrases")
    f = lambda part, n: held.filter(f"size BETWEEN 1 AND {most - 1}").select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = held.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    scored = parts.join(f("left", "l"), ["lang", "left"]).join(f("right", "r"), ["lang", "right"])
    best = scored.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    # what a longer phrase holds lies in its beginning or end of one word less, or inside those, which are at least as frequent
    ends = F.array_distinct(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)")))
    around = held.filter("size > 2").select("lang", "n", F.explode(ends).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = best.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorb_percent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("part"))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(held.filter("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
