"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents of n shingles are alike only if they share T of them. Each document's inverted
lists, in the order of rising document frequency, are divided: the L longest ones are set
aside, and the others are merged by a heap that skips what can't occur in T - L of them.
What occurs that often is probed for the long lists by binary search, and stays if it
reaches the overlap. Long pieces of a list are cut by ranges of their documents' hashes.
Documents of equal sets are one document to the search. For components alone, known links
come first: each list's most central document is tried with the others, and documents whose
component is one already are not sought again, so that a large group of copies costs a few
comparisons for each member.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise
from strandloom.llm.resident import resident
from strandloom.operators.graph import components

#: Shingles of a chunk of documents and of a shard of the shingle space about; ids of a table that may be broadcast.
CHUNK_TOKENS, SHARD_TOKENS, BROADCAST_IDS = 1_000_000, 1_000_000, 1_000_000
#: A query merges T // OCCURRENCES more lists than it must, and asks for as many occurrences; documents of a piece of a list about.
OCCURRENCES, PIECE = 16, 1024
_CHUNK_DOCS, _MANY, _WORDS = 60_000, 65_535, 200_000
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence where it has fewer words.

    Words are the runs between ASCII white space, with A-Z in lower case.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(resident("words", _WordHashes).__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ h[i : i + len(out)]) * _U(0x9E3779B97F4A7C15)
            out ^= out >> _U(29)
            out *= _U(0xBF58476D1CE4E5B9)
            out ^= out >> _U(32)
    return np.unique(out)


def needed(n: int, percent: int) -> int:
    """Shingles that a document of n must share with any other to reach the similarity."""
    return -(-percent * n // 100)


def occurrences(n: int, percent: int) -> int:
    """T - L for a document of n shingles: how often a document that is alike stands in the short lists at least."""
    return max(1, needed(n, percent) // OCCURRENCES)


def merge_skip(lists: list[list[int]], least: int) -> list[int]:
    """The ids that stand in ``least`` of the sorted lists or more, by a heap of their heads.

    A head that stands in too few lists takes others with it, up to least - 1 in all; these lists then jump, by
    binary search, to the head that is left: no id before it can occur often enough.
    """
    heads = [(own[0], i) for i, own in enumerate(lists) if own]
    heapify(heads)
    at, found = [0] * len(lists), []
    while len(heads) >= least:
        top, taken = heads[0][0], []
        while heads and heads[0][0] == top:
            taken.append(heappop(heads)[1])
        if len(taken) >= least:
            found.append(top)
            for i in taken:
                at[i] += 1
        else:
            while heads and len(taken) < least - 1:
                taken.append(heappop(heads)[1])
            if not heads:
                break
            for i in taken:
                at[i] = bisect_left(lists[i], heads[0][0], at[i])
        for i in taken:
            if at[i] < len(lists[i]):
                heappush(heads, (lists[i][at[i]], i))
    return found


def _chunk_name(k: int) -> str:
    return f"{TaskContext.get().partitionId()}-{k}"


def _split(tokens: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """Shards of sorted hashes, by their high half, with the part of each."""
    if not len(tokens):
        return []
    shard = ((tokens >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
    return [(int(shard[a]), slice(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


_PACKED = "shard int, chunk string, kind int, a binary, b binary"


def _postings(width: int, shards: int):
    """For each chunk of documents, each of its shingles once, dealt to shards.

    b holds the document in the chunk that has the shingle, or _MANY if several have it. A row of kind 1 holds the
    chunk's documents: ids, set sizes, digests, and how many of their shingles several documents of the chunk have.
    """

    def flush(docs: list, k: int) -> list[tuple]:
        chunk, ids, sizes, digests, tokens, owners, seen = _chunk_name(k), [], [], [], [], [], set()
        for i, (doc, s) in enumerate(docs):
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            ids.append(doc)
            sizes.append(len(s))
            digests.append(digest)
            if digest not in seen:  # a copy within the chunk adds nothing
                seen.add(digest)
                tokens.append(s)
                owners.append(np.full(len(s), i, np.uint16))
        all_tokens, all_owners = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(all_tokens, kind="stable")
        all_tokens, all_owners = all_tokens[order], all_owners[order]
        first = np.concatenate(([True], all_tokens[1:] != all_tokens[:-1])) if len(order) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        local = np.bincount(all_owners[size[group] > 1], minlength=len(docs)) if len(group) else np.zeros(len(docs), np.int64)
        keys, owner = all_tokens[first], np.where(size > 1, _MANY, all_owners[first]).astype(np.uint16)
        rows = [(s, chunk, 0, keys[at].astype("<u4").tobytes(), owner[at].tobytes()) for s, at in _split(keys, shards)]
        meta = np.array(sizes, "<i4").tobytes() + local.astype("<i4").tobytes() + b"".join(digests)
        return [*rows, (k % shards, chunk, 1, np.array(ids, "<i8").tobytes(), meta)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        held = k = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py(), width)
                docs.append((ids[i], s))
                held += len(s)
                if held >= CHUNK_TOKENS or len(docs) >= _CHUNK_DOCS:
                    yield _packed(flush(docs, k))
                    docs, held, k = [], 0, k + 1
        if docs:
            yield _packed(flush(docs, k))

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["shard", "chunk", "kind", "a", "b"])


def _count_repeats(group: pd.DataFrame) -> pd.DataFrame:
    """For a shard: how many shingles of each document stand in other chunks too, or several times in its own."""
    out = [(r.chunk, 1, r.a, r.b) for r in group[group["kind"] == 1].itertuples()]
    post = group[group["kind"] == 0]
    if len(post):
        keys = [np.frombuffer(x, "<u4") for x in post["a"]]
        at = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        key, owner = np.concatenate(keys), np.concatenate([np.frombuffer(x, np.uint16) for x in post["b"]])
        order = np.argsort(key, kind="stable")
        key, owner, at = key[order], owner[order], at[order]
        number = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
        several = np.bincount(number, 1 + (owner == _MANY))[number] > 1
        found, times = np.unique(at[several & (owner != _MANY)] * (_MANY + 1) + owner[several & (owner != _MANY)], return_counts=True)
        chunks = post["chunk"].tolist()
        edges = np.searchsorted(found, np.arange(len(keys) + 1) * (_MANY + 1))
        for i in range(len(keys)):
            part = slice(edges[i], edges[i + 1])
            if edges[i] < edges[i + 1]:
                out.append((chunks[i], 0, (found[part] % (_MANY + 1)).astype(np.uint16).tobytes(), times[part].astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["chunk", "kind", "a", "b"])


def _chunk_documents(group: pd.DataFrame) -> pd.DataFrame:
    """For a chunk: id, set size, digest and number of repeated shingles of each document."""
    meta = group[group["kind"] == 1].iloc[0]
    ids = np.frombuffer(meta["a"], "<i8")
    n = len(ids)
    repeated = np.frombuffer(meta["b"], "<i4", n, 4 * n).astype(np.int64)
    for r in group[group["kind"] == 0].itertuples():
        repeated[np.frombuffer(r.a, np.uint16)] += np.frombuffer(r.b, "<u4")
    digests = meta["b"][8 * n :]
    return pd.DataFrame({"doc": ids, "n": np.frombuffer(meta["b"], "<i4", n).astype(np.int64), "digest": [digests[16 * i : 16 * i + 16].hex() for i in range(n)], "repeated": repeated})


_SETS = "chunk string, doc long, n long, tokens binary"


def _sets(width: int):
    """Shingle sets of the candidates, in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = [shingles(t.as_py(), width) for t in part.column(1)]
                chunks = []
                for s in found:
                    chunks.append(_chunk_name(k))
                    held += len(s)
                    if held >= CHUNK_TOKENS:
                        held, k = 0, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(chunks), part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["chunk", "doc", "n", "tokens"])

    return run


def _requests(shards: int):
    """Each chunk's distinct shingles with their counts in it, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_chunk: dict[str, list] = {}
            for chunk, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_chunk.setdefault(chunk, []).append(np.frombuffer(tokens, np.uint64))
            for chunk, sets in by_chunk.items():
                keys, times = np.unique(np.concatenate(sets), return_counts=True)
                rows = [(s, chunk, 0, keys[at].tobytes(), times[at].astype("<u4").tobytes()) for s, at in _split(keys, shards)]
                if rows:
                    yield _packed(rows)

    return run


def _frequencies(group: pd.DataFrame) -> pd.DataFrame:
    """For a shard: the frequency of each chunk's shingles in all chunks, where it is over 1."""
    keys = [np.frombuffer(x, np.uint64) for x in group["a"]]
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, np.concatenate([np.frombuffer(x, "<u4") for x in group["b"]]))[number].astype(np.int64)
    out, at = [], 0
    for chunk, key in zip(group["chunk"], keys, strict=True):
        df = total[at : at + len(key)]
        at += len(key)
        if (df > 1).any():
            out.append((chunk, key[df > 1].tobytes(), df[df > 1].astype("<u8").tobytes()))
    return pd.DataFrame(out, columns=["chunk", "a", "b"])


_RANKED = "doc long, n long, lone long, prefix array<long>, tokens binary"


def _ranked(percent: int):
    """For a chunk: each document's short lists, and its shingles that other documents have."""

    def run(sets: pd.DataFrame, df: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(sets) and len(df):
            keys, first = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in df["a"]]), return_index=True)
            often = np.concatenate([np.frombuffer(x, "<u8") for x in df["b"]])[first]
            for r in sets.itertuples():
                own = np.frombuffer(r.tokens, np.uint64)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                shared, freq = own[hit], often[at[hit]]
                spare = len(shared) - needed(r.n, percent)  # the lists of length 1 come first and hold no other document
                if spare >= 0 and len(shared):
                    order = np.lexsort((shared, freq))[: spare + occurrences(r.n, percent)]
                    out.append((r.doc, r.n, r.n - len(shared), shared[order].view(np.int64), shared.tobytes()))
        return pd.DataFrame(out, columns=["doc", "n", "lone", "prefix", "tokens"])

    return run


def _verified(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that reach the similarity, by binary search of one's shingles in the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, ta, nb, tb in zip(batch["na"].to_pylist(), batch["ta"], batch["nb"].to_pylist(), batch["tb"], strict=True):
                x, y = np.frombuffer(ta.as_buffer(), np.uint64), np.frombuffer(tb.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = ranked.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = ranked.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "na", "ta", "b", "nb", "tb").mapInArrow(run, "a long, b long")


def _merged(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pairs:
        a, b = [], []
        for query, least, lists in zip(batch["a"].to_pylist(), batch["least"].to_pylist(), batch["lists"].to_pylist(), strict=True):
            found = merge_skip(lists, least)
            a += [query] * len(found)
            b += found
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _occurring(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of documents of different components that stand together in the short lists of a as often as they must.

    ``postings`` has token, doc, n, left, comp and weight, the size of the component. Of two documents the one of the
    lighter component, then of the smaller id, asks for the other, so that in a list that is nearly one component
    only the few others ask. Lists that hold one component are left out. A list goes to those who ask in pieces of
    PIECE documents about, by ranges of the documents' hash that are the same for all lists, and to those of a long
    list by ranges of theirs; of a piece they get only what size and place let reach the similarity.
    """
    lists = postings.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("len"), F.max(F.struct("weight", "comp")).alias("top"))
    held = materialise(postings.join(lists.filter("x <> y").select("token", "top", F.ceil(F.col("len") / PIECE).cast("int").alias("parts")), "token"), "open")
    ranges = held.agg(F.max("parts").alias("parts")).first()["parts"] or 1  # one number
    deal = lambda seed, parts: F.pmod(F.xxhash64("doc", F.lit(seed)), parts.cast("long")).cast("int")
    must = F.ceil(F.ceil(F.col("n") * percent / F.lit(100)) * percent / F.lit(100))  # of the smallest document that may be alike
    asking = held.filter(F.struct("weight", "comp") < F.col("top")).withColumn("least", F.greatest(F.lit(1), F.floor(must / F.lit(OCCURRENCES))).cast("long"))
    queries = asking.select("token", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("left").alias("left_a"), "least", F.struct("weight", "comp").alias("own"), deal(1, F.col("parts")).alias("part"))
    pieces = held.groupBy("token", "parts", deal(2, F.lit(ranges)).alias("range")).agg(F.sort_array(F.collect_list(F.struct("doc", "n", "left", "weight", "comp"))).alias("piece"))
    pieces = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", "part", "range", "piece")

    def fits(x):
        heavier = F.struct(x["weight"].alias("weight"), x["comp"].alias("comp")) > F.col("own")
        # behind its first common shingles a pair has enough left on both sides
        room = (F.least(x["left"], F.col("left_a")) + F.col("least") - 1) * (100 + percent) >= (F.col("na") + x["n"]) * percent
        return heavier & (x["n"] * percent <= F.col("na") * 100) & (F.col("na") * percent <= x["n"] * 100) & room

    met = queries.join(pieces, ["token", "part"]).select("a", "least", "range", F.transform(F.filter("piece", fits), lambda x: x["doc"]).alias("ids")).filter(F.size("ids") > 0)
    return met.groupBy("a", "least", "range").agg(F.collect_list("ids").alias("lists")).filter("size(lists) >= least").select("a", "least", "lists").mapInArrow(_merged, "a long, b long")


def _search(docs: DataFrame, width: int, percent: int) -> dict[str, DataFrame]:
    """The tables of the search: rows, known documents, classes of equal sets, ranked candidates and their short lists."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    size = rows.filter("doc IS NOT NULL").agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0  # one number
    shards = max(8, size // 6 // SHARD_TOKENS)
    packed = rows.filter("doc IS NOT NULL").mapInArrow(_postings(width, shards), _PACKED)
    counted = packed.groupBy("shard").applyInPandas(_count_repeats, "chunk string, kind int, a binary, b binary")
    known = materialise(counted.groupBy("chunk").applyInPandas(_chunk_documents, "doc long, n long, digest string, repeated long"), "documents")
    # equal sets are one document; a document that shares too few shingles with all others has no link
    classes = materialise(known.filter("n > 0").groupBy("digest", "n").agg(F.min("doc").alias("rep"), F.max("repeated").alias("repeated")), "classes")
    candidates = materialise(classes.filter(F.col("repeated") * 100 >= F.col("n") * percent).select(F.col("rep").alias("doc"), "n"), "candidates")
    stats = candidates.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")).first()
    ids = candidates.select("doc").distinct()
    texts = rows.join(F.broadcast(ids) if stats["rows"] <= BROADCAST_IDS else ids, "doc").select("doc", "text")
    sets = materialise(texts.mapInArrow(_sets(width), _SETS), "sets")
    shards = max(8, (stats["tokens"] or 0) // SHARD_TOKENS)
    asked = sets.select("chunk", "tokens").mapInArrow(_requests(shards), _PACKED)
    df = asked.groupBy("shard").applyInPandas(_frequencies, "chunk string, a binary, b binary")
    ranked = materialise(sets.groupBy("chunk").cogroup(df.groupBy("chunk")).applyInPandas(_ranked(percent), _RANKED).dropDuplicates(["doc", "tokens"]), "ranked")
    postings = ranked.select("doc", "n", (1 - F.col("lone") / F.col("n")).alias("central"), "lone", F.posexplode("prefix").alias("place", "token"))
    must = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    left = F.col("n") - F.col("lone") - F.col("place")
    # in the first lists of each document a pair that is alike meets once at least; in all of them as often as it must
    postings = materialise(postings.select("doc", "n", "central", "token", left.alias("left"), (F.col("place") <= F.col("n") - F.col("lone") - must).alias("first")), "postings")
    return {"rows": rows, "known": known, "classes": classes, "ranked": ranked, "postings": postings}


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links between class representatives, and the membership: (a, b) and (doc_id, class_id, n_shingles).

    Documents of equal sets are a class, named by its smallest doc_id; a and b are classes of different sets that
    reach the similarity, each pair once. Nulls, empty texts and repeated rows as in jaccard_components; documents
    without shingles are classes of their own and have no link.
    """
    found = _search(docs, width, percent)
    pairs = _occurring(found["postings"].withColumn("comp", F.col("doc")).withColumn("weight", F.lit(1).cast("long")), percent)
    links = _verified(pairs.distinct(), found["ranked"], percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    member = found["known"].join(found["classes"].select("digest", "n", "rep"), ["digest", "n"], "left")
    return links, member.select(F.col("doc").alias("doc_id"), F.coalesce("rep", "doc").alias("class_id"), F.col("n").alias("n_shingles")).distinct()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; a component's id is its
    smallest doc_id. Documents without words, null texts included, have no shingles and are a component each.
    Repeated rows give equal rows; rows of one id and other texts give a row each, and join their components as one
    document; rows without an id get their own null component. An empty table gives an empty one; other columns
    are ignored. Hashes of 64 bits stand for shingles.
    """
    found = _search(docs, width, percent)
    rows, known, classes, ranked, postings = (found[k] for k in ("rows", "known", "classes", "ranked", "postings"))
    first = postings.filter("first")
    # a pair that reaches the similarity has, from its first common shingle on, enough shingles left on both sides
    alike = F.least("left_a", "left_b") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent

    def sides(rows: DataFrame, x: str) -> DataFrame:
        return rows.withColumnsRenamed({"doc": x, "n": f"n{x}", "left": f"left_{x}", "comp": f"comp_{x}"})

    # each list's most central document is tried with all others of the list, which settles most groups of copies
    hubs = first.groupBy("token").agg(F.max(F.struct("central", "n", "doc", "left")).alias("hub"), F.count(F.lit(1)).alias("len")).filter("len > 1").select("token", "hub.doc", "hub.n", "hub.left")
    pairs = sides(first, "a").join(sides(hubs, "b"), "token").filter((F.col("a") != F.col("b")) & alike)
    links = materialise(_verified(pairs.select("a", "b").distinct(), ranked, percent), "links")
    for turn in range(2):  # then a document of the list's largest component with those outside it
        labelled = _labelled(first, links)
        main = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("len"), F.min(F.struct(F.xxhash64("doc", F.lit(turn)), "doc", "n", "left")).alias("one"))
        main = main.groupBy("token").agg(F.max(F.struct("len", "comp", "one")).alias("m"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("token", "m.comp", "m.one.doc", "m.one.n", "m.one.left")
        far = sides(labelled, "a").join(sides(main, "b"), "token").filter((F.col("comp_a") != F.col("comp_b")) & alike)
        links = materialise(links.unionByName(_verified(far.select("a", "b").distinct(), ranked, percent)), "links")
    # what is left: the search proper, for documents that no known link joins
    links = materialise(links.unionByName(_verified(_occurring(_labelled(postings, links), percent).distinct(), ranked, percent)), "links")
    joined = components(links)
    own = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.col("n"), F.coalesce("component", "rep").alias("component_id"))
    lone = known.filter("n = 0").select("doc", "n", F.col("doc").alias("component_id"))
    placed = known.filter("n > 0").join(own, ["digest", "n"]).select("doc", "n", "component_id").unionByName(lone)
    nameless = rows.filter("doc IS NULL").select("doc", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("component_id"))
    return placed.unionByName(nameless).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns, without those whose component has a smaller doc_id.

    Rows without an id or words stay; rows of one id stay or go together.
    """
    gone = jaccard_components(docs, width, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def _labelled(postings: DataFrame, links: DataFrame) -> DataFrame:
    """The postings with each document's component by the links, and the component's size."""
    joined = components(links)
    joined = joined.join(joined.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").withColumnRenamed("node", "doc")
    rows = postings.select("token", "doc", "n", "left").join(joined, "doc", "left")
    return materialise(rows.select("token", "doc", "n", "left", F.coalesce("component", "doc").alias("comp"), F.coalesce("size", F.lit(1)).cast("long").alias("weight")), "labelled")
