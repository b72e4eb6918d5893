"""Spelling variants: words at one edit, found by dense tiles of padded code points.

Of two words at one edit the first or the last half of the shorter one is intact in both. Words of a length and the next
one that share such a half form a bucket, large buckets are cut into blocks, and each pair of blocks is compared as a
whole: padded matrices of code points give the common prefix and, read from the end, the common suffix of every pair of
rows. Words that differ are at one edit exactly if both together reach the longer length minus one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise

#: Code points and occurrences of a word; a form occurs so many times as often; one of so many words of a document loses a letter.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES, DAMAGE = 6, 5, 5, 199
#: Words of a block; words that a task counts before it emits them; rows that it compares at once, and cells of their matrices.
BLOCK_WORDS, HELD_WORDS, HELD_ROWS, CELLS = 512, 300_000, 60_000, 4_000_000


def damaged(doc_id: int | None, word: str, divisor: int = DAMAGE) -> str:
    """The word without one code point if ``divisor`` divides h, the crc32 of ``<doc_id>:<word>``; the one at h modulo its length."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if h % divisor else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counts(least: int, divisor: int):
    run_of = re.compile(f"[a-z\u00c0-\u00ff]{{{least},}}")  # a shorter run can't give a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run_of.findall((raw or b"").lower().decode("utf-8", "replace"))).items():
                    if zlib.crc32(word.encode(), prefix) % divisor:
                        held[word] += n
                    elif len(short := damaged(doc_id, word, divisor)) >= least:
                        held[short] += n
                if len(held) >= HELD_WORDS:
                    yield packed()
        yield packed()

    return run


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST_LENGTH, count: int = LEAST_COUNT, divisor: int = DAMAGE) -> DataFrame:
    """word and n of the runs of letters of all texts, after the damage, with enough code points and occurrences."""
    counted = docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(_counts(least, divisor), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def matrix(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the start, padded with 0; the same from the end; and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = flat.astype(np.uint8) if len(flat) and flat.max() < 256 else flat
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fore, back = np.zeros((len(words), width), flat.dtype), np.zeros((len(words), width), flat.dtype)
    fore[row, column] = flat
    back[row, lengths[row] - 1 - column] = flat
    return fore, back, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which two matrices of equal width agree; a column of difference stands behind the last."""
    return np.concatenate([a != b, np.ones((*np.broadcast_shapes(a.shape, b.shape)[:-1], 1), bool)], -1).argmax(-1)


def _near(i: np.ndarray, j: np.ndarray, fore: np.ndarray, back: np.ndarray, length: np.ndarray, short: np.ndarray, from_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the row pairs (i, j) are at one edit and belong to this bucket: the shorter word has its length ``short``.

    What a bucket of first halves finds, the one of last halves leaves out.
    """
    fit = (np.minimum(length[i], length[j]) == short[i]) & (np.abs(length[i] - length[j]) <= 1)
    i, j = i[fit], j[fit]
    least, most = short[i], np.maximum(length[i], length[j])
    prefix = np.minimum(_common(fore[i], fore[j]), least)
    suffix = np.minimum(_common(back[i], back[j]), least)
    good = (prefix + suffix >= most - 1) & ~((most == least) & (prefix == least)) & ~(from_end[i] & (prefix >= least // 2))
    return i[good], j[good]


def tile_pairs(words: list[str], sizes: np.ndarray, short: np.ndarray, from_end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) at one edit in tiles of ``sizes`` rows that follow each other in ``words``.

    A tile has the length of its shorter words, whether its words share their last halves, and how many of its rows are
    of the first of two blocks, or -1 if it is one block. One comparison covers all tiles at once: the d-th one pairs each row
    with the d-th below it.
    """
    width = int(short.max(initial=0)) + 1
    fore, back, length = matrix(words, width)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = start + np.repeat(sizes, sizes)
    crossed, other = np.repeat(first >= 0, sizes), start + np.repeat(first, sizes)
    short, from_end = np.repeat(short, sizes), np.repeat(from_end, sizes)
    rows, step = np.arange(len(words)), max(1, CELLS // width)
    found = [(rows[:0], rows[:0])]
    for d in range(1, int(sizes.max(initial=0))):
        rows = rows[rows + d < end[rows]]
        paired = rows[~crossed[rows] | ((rows < other[rows]) & (rows + d >= other[rows]))]
        for at in range(0, len(paired), step):
            i = paired[at : at + step]
            found.append(_near(i, i + d, fore, back, length, short, from_end))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


_TILE = ["short", "from_end", "half", "x", "y"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows of tiles; the last tile of what is held waits for more rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def compared(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for name in _TILE:
            column = table[name].combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], table.num_rows]
        if not last:
            held = table.slice(starts[-1]).to_batches()
            starts, ends = starts[:-1], ends[:-1]
        short, from_end = (table[c].to_numpy()[starts] for c in ("short", "from_end"))
        one = table["x"].to_numpy()[starts] == table["y"].to_numpy()[starts]
        before = np.r_[0, np.cumsum(~table["second"].to_numpy())]
        firsts = np.where(one, -1, before[ends] - before[starts])
        at = 0
        while at < len(starts):  # as many tiles as fit in memory, of the widest one's width
            upto, widest = at, 0
            while upto < len(starts) and (upto == at or (ends[upto] - starts[at]) * max(widest, short[upto] + 1) <= CELLS):
                widest = max(widest, short[upto] + 1)
                upto += 1
            part = table.slice(starts[at], ends[upto - 1] - starts[at])
            i, j = tile_pairs(part["word"].to_pylist(), (ends - starts)[at:upto], short[at:upto], from_end[at:upto], firsts[at:upto])
            word, n = part["word"].combine_chunks(), part["n"].combine_chunks()
            here, there = pa.array(np.r_[i, j]), pa.array(np.r_[j, i])
            yield pa.RecordBatch.from_arrays([word.take(here), word.take(there), n.take(there)], ["word", "near", "near_n"])
            at = upto

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD_ROWS:
            yield from compared(False)
            rows = 0
    if held:
        yield from compared(True)


def near_words(words: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """word, near, near_n for each ordered pair of distinct words at one edit, of a table of distinct ``word`` with its ``n``.

    Blocks of a bucket are dealt by hash and meet in pairs, each pair a tile of its own, so that a bucket of any size is spread.
    """
    size = F.char_length("word")
    shorter = F.explode(F.array(size, size - 1)).alias("short")  # the word as the shorter one, and as the longer
    halves = words.select("word", "n", size.alias("length"), shorter).filter("short > 0").select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("from_end"))
    keyed = halves.withColumn("half", F.when(F.col("from_end"), F.expr("right(word, short - short div 2)")).otherwise(F.expr("left(word, short div 2)")))
    bucket = ["short", "from_end", "half"]
    sizes = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("length") == F.col("short")).alias("shorts")).filter("size > 1 AND shorts > 0")
    in_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(CELLS / 4) / F.col("short"))))
    blocks = keyed.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("size") / in_block).cast("long")).withColumn("i", F.pmod(F.xxhash64("word"), F.col("blocks")))
    # a block meets itself and each other one of the bucket
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))
    pairs = blocks.select(*bucket, "word", "n", "i", F.explode(met).alias("at")).select(*bucket, "at.x", "at.y", (F.col("i") != F.col("at.x")).alias("second"), "word", "n")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as a tile costs more than its bytes tell
    return pairs.repartition(tasks, *_TILE).sortWithinPartitions(*_TILE, "second").mapInArrow(_compare, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, times: int = FORM_TIMES, block: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a table of distinct ``word`` with its ``n``.

    The form is the most frequent word at one edit, of several the least in code points, if it occurs ``times`` times as
    often; the root is the last form in turn. Words without a form have none and are their own root; an empty table gives
    an empty one. ``times`` below 2 is a ValueError, as forms could then go round.
    """
    if times < 2:
        raise ValueError("times: 2 at least")
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= times * F.col("n")
    told = words.join(near, "word", "left").select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.minus")).alias("form_n"))
    told = materialise(told, "forms")
    reach, moved = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), True
    while moved:  # each round doubles the steps; a step multiplies the count, so that a few rounds reach every root
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reach = materialise(reach.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = not reach.filter("moved").isEmpty()
        reach = reach.drop("moved")
    return told.join(reach, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
