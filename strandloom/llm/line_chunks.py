"""Line deduplication by content-defined chunks of lines, in DataFrame functions alone.

A rolling hash over the hashes of the last WINDOW lines ends a chunk where it is
divisible by DIVISOR, so that an insertion moves only the boundaries beside it.
Chunks of two or more lines that occur more than once in the corpus are compared
byte by byte, and all but the first occurrence are removed. Where passages are asked
for, later occurrences of any run of lines of PASSAGE_WORDS words go too, a single line
among them, wherever chunks end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise

#: Lines in the rolling hash, and lines in a chunk on average.
WINDOW, DIVISOR = 2, 3
#: Words of a passage; a character of Han or kana counts as a word.
PASSAGE_WORDS = 50
_WORD = "[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]|[^\\x20\\x09-\\x0D\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]+"
_PRIME, _BASE = 2_147_483_647, 1_000_003


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def chunk_spans(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of (first line, number of lines), from 1, of the chunks of an array of lines."""
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))

    def spans(h: Column) -> Column:
        n = F.size(h)

        def rolled(i: Column) -> Column:
            value = F.lit(0).cast("long")
            for back in range(window - 1, -1, -1):
                line = F.when(i - back >= 1, F.get(h, i - back - 1)).otherwise(F.lit(0).cast("long"))
                value = (value * F.lit(_BASE).cast("long") + line) % F.lit(_PRIME).cast("long")
            return value

        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (rolled(i) % divisor == 0))
        def before(e: Column, k: Column) -> Column:
            return F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0))

        return let(ends, lambda e: F.transform(e, lambda end, k: F.struct((before(e, k) + 1).alias("first"), (end - before(e, k)).alias("n"))))

    return let(hashes, spans)


def passage_spans(lines: Column, words: int = PASSAGE_WORDS) -> Column:
    """Array of (first line, number of lines, key) of the shortest passages of so many words from each line on and up to each line.

    Any run of lines with as many words is the union of those of them that lie in it. Lines without a word are passed over.
    """
    told = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("k"), F.xxhash64(x).alias("h"), F.least(F.regexp_count(x, F.lit(_WORD)), F.lit(words)).alias("w"))), lambda x: x["w"] > 0)
    most = words + 1  # a sum of words and the lines in it are one number: sum * most + lines

    def reach(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: F.when(a >= words * most, a).otherwise(a + x["w"] * most + 1))

    def spans(t: Column) -> Column:
        def coded(found: Column, first) -> Column:  # place of the first line and number of lines as one number, or null
            return let(found, lambda a: F.when(a >= words * most, first(a % most).cast("long") * most + a % most))

        after = F.transform(t, lambda x, i: coded(reach(F.slice(t, i + 1, words)), lambda n: i))
        before = F.transform(t, lambda x, i: coded(reach(F.reverse(F.slice(t, F.greatest(i - (words - 2), F.lit(1)), F.least(i + 1, F.lit(words))))), lambda n: i + 1 - n))

        def span(c: Column) -> Column:
            at, n = F.floor(c / most).cast("int"), (c % most).cast("int")
            first = F.get(t, at)["k"]
            return F.struct(first.alias("first"), (F.get(t, at + n - 1)["k"] - first + 1).alias("n"), F.xxhash64(F.transform(F.slice(t, at + 1, n), lambda x: x["h"])).alias("key"))

        return F.transform(F.filter(F.array_union(after, before), lambda c: c.isNotNull()), span)

    return let(told, spans)


def with_text(lines: Column, spans: Column, *names: str) -> Column:
    """The named fields of each span and its lines' text as ``chunk``."""
    return F.transform(spans, lambda s: F.struct(*[s[x].alias(x) for x in names], F.array_join(F.slice(lines, s["first"], s["n"]), "\n").alias("chunk")))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", passages: bool = False) -> DataFrame:
    """The rows of ``docs``, all their columns, with the text that is left and n_lines_removed.

    The first occurrence of a chunk, by id and then place, stays. Chunks of one line, or without a character that
    is no white space, stay. With ``passages`` each line goes too that lies in a later occurrence of a run of lines,
    one or more, of PASSAGE_WORDS words; lines without a word are passed over in the comparison and go with the
    lines around them. Null texts stay null; rows without an id stay as they are; rows with equal id and text
    count as one document, and rows of one id with other texts as others. A document of which all lines go has an
    empty text. An empty table gives an empty one.
    """
    lines = F.split(F.col("t"), "\n", -1)
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("version"))
    several = lambda ls: F.filter(chunk_spans(ls), lambda s: s["n"] > 1)
    known = keyed.filter(F.col("id").isNotNull())
    chunks = (
        known.filter(F.col("t").contains("\n"))
        .select("id", "version", F.explode(let(lines, lambda ls: with_text(ls, several(ls), "first", "n"))).alias("span"))
        .filter(F.col("span.chunk").rlike("[^\\x20\\x09-\\x0D]"))
        .select("id", "version", "span.first", "span.n", F.xxhash64("span.chunk").alias("key"), F.lit(False).alias("passage"))
    )
    if passages:
        chunks = chunks.union(known.select("id", "version", F.explode(let(lines, lambda ls: passage_spans(ls))).alias("span")).select("id", "version", "span.*", F.lit(True).alias("passage")))
    chunks = materialise(chunks, "chunks")
    repeated = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    suspects = chunks.join(repeated, "key").groupBy("id", "version").agg(F.collect_list(F.struct("first", "n", "key", "passage")).alias("spans"))
    # byte comparison, of the suspects' text alone: equal key and equal bytes are one class; passages overlap and are compared by SHA-256
    texts = (
        keyed.select("id", "version", "t")
        .join(suspects, ["id", "version"])
        .select("id", "version", F.explode(let(lines, lambda ls: with_text(ls, F.col("spans"), "first", "n", "key", "passage"))).alias("span"))
        .select("id", "version", "span.*")
    )
    if passages:
        told = F.array_join(F.filter(F.split("chunk", "\n", -1), lambda x: x.rlike(_WORD)), "\n")
        texts = texts.withColumn("chunk", F.when(F.col("passage"), F.sha2(told, 256)).otherwise(F.col("chunk")))
    texts = materialise(texts.distinct(), "suspects")
    classes = texts.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "version", "first")).alias("stays")).filter("times > 1")
    removed = (
        texts.join(classes, ["key", "chunk"])
        .filter(F.struct("id", "version", "first") != F.col("stays"))
        .groupBy("id", "version")
        .agg(F.collect_list(F.struct("first", "n")).alias("gone"))
    )
    gone_at = F.array_distinct(F.flatten(F.transform(F.col("gone"), lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1))))
    joined = keyed.join(removed, ["id", "version"], "left").select("row", "t", gone_at.alias("gone_at"))
    left = let(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(ls)), F.col("gone_at")), lambda k: F.get(ls, k - 1)), "\n"))
    text = F.when(F.col("gone_at").isNull(), F.col("t")).otherwise(left)
    count = F.coalesce(F.size("gone_at"), F.lit(0)).cast("long").alias("n_lines_removed")
    return joined.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns], *[count] * ("n_lines_removed" not in docs.columns))
