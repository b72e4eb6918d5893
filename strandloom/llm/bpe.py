"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding.
A token that ends at a byte is that one when the token before it, already known for
the shorter prefix, and it survive as neighbours when their bytes are merged alone.
Storing the last token of every prefix gives the encoding by walking backwards, lets
bytes be appended without touching what is stored, and lets an edit be re-encoded
only until the stored tokens agree again.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.resident import resident

#: Entries that a worker's piece cache holds in each of its two generations.
CACHE_PIECES = 250_000
#: Entries that a worker's table of neighbouring tokens holds before it starts anew.
CACHE_PAIRS = 300_000
#: Last bytes of a prefix by which the lengths of its possible last tokens are bounded.
SUFFIX = 4


class Vocabulary:
    """Ranks of a byte-level BPE and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Length of the longest token that ends in these SUFFIX bytes; other tokens are shorter than SUFFIX.
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) >= SUFFIX:
                end = token[-SUFFIX:]
                self.reach[end] = max(len(token), self.reach.get(end, 0))
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reachable: dict[int, bool] = {}
        self._edges: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """From the text of a .tiktoken file: a base64 token and its rank on each line."""
        ranks = {}
        for line in content.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks)

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain rank-ordered merging of a token's bytes, until no pair or only ``stop`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """Parts that stand at the token's right or left end while its bytes merge, each with the rank that consumes it."""
        found = self._edges.get((token, right))
        if found is None:
            found, data, consumed = [], self.tokens[token], math.inf
            while True:
                found.append((data, consumed))
                if len(data) == 1:
                    break
                consumed = self.ranks[data]
                data = self.merge(data, 2)[-1 if right else 0]
            found.reverse()
            self._edges[token, right] = found
        return found

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their joined bytes are merged.

        The parts that face each other change as merges go on; the tokens stay apart unless two facing parts form
        a token of lower rank than those that consume them. Of equal ranks the merge further left comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            a, b, i, j, known = self._edge(left, True), self._edge(right, False), 0, 0, True
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                joined = self.ranks.get(x + y)
                if joined is not None and joined < x_until and joined <= y_until:
                    known = False
                    break
                if i + 1 == len(a) and j + 1 == len(b):
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes yields the token."""
        known = self._reachable.get(token)
        if known is None:
            known = self._reachable[token] = self.merge(self.tokens[token]) == [self.tokens[token]]
        return known


class PrefixTable:
    """The last token of every prefix of one growing piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _fill(self, first: int, stop: int) -> None:
        """Last tokens of the prefixes of first to stop bytes, the shorter ones being known."""
        v, data, last = self.vocabulary, self.data, self.last
        find, pairs, reach = v.ranks.get, v.pairs.get, v.reach.get
        for end in range(first, stop + 1):
            start = end - reach(data[end - SUFFIX : end], SUFFIX - 1) if end >= SUFFIX else 0
            if start < 0:
                start = 0
            while True:
                token = find(data[start:end])
                if token is not None:
                    if start:
                        fits = pairs((last[start - 1], token))
                        if fits or fits is None and v.neighbours(last[start - 1], token):
                            break
                    elif v.reachable(token):
                        break
                start += 1
                if start == end:
                    raise ValueError("the vocabulary lacks a single byte")
            last.append(token)

    def append(self, data: bytes) -> None:
        """Adds bytes at the end; what is stored for the old prefixes stays exact."""
        first = len(self.data) + 1
        self.data += data
        self._fill(first, len(self.data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts ``data`` in the place of bytes start to stop and returns how many prefixes were computed anew.

        Prefixes before the edit stay. After it, once as many consecutive last tokens as the longest token has
        bytes agree with the old ones, all later ones agree too and are copied.
        """
        old_last, shift = self.last[stop:], start + len(data)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = self.last[:start]
        agreed = done = 0
        for end in range(start + 1, len(self.data) + 1):
            self._fill(end, end)
            done += 1
            if end > shift:
                agreed = agreed + 1 if self.last[-1] == old_last[end - shift - 1] else 0
                if agreed >= self.vocabulary.longest:
                    self.last += old_last[end - shift :]
                    break
        return done

    def ids(self) -> list[int]:
        """The encoding, read from the end by each prefix's last token."""
        found, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            found.append(token)
            at -= len(self.vocabulary.tokens[token])
        return found[::-1]


class _Pieces(dict):
    """Piece to ids, in two generations so that its memory is bounded."""

    def __init__(self, vocabulary: Vocabulary, limit: int):
        super().__init__()
        self._vocabulary, self._limit, self._old = vocabulary, limit, {}

    def _encode(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self._vocabulary.ranks.get(data)
        return (whole,) if whole is not None else tuple(PrefixTable(self._vocabulary, data).ids())

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._old.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= 64:  # a long piece is not worth keeping
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PrefixEncoder:
    """Encodes whole texts, each match of the pattern separately, and decodes ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self._pieces = _Pieces(vocabulary, CACHE_PIECES)
        self.names = {i: str(i) for i in vocabulary.tokens}

    def encode(self, text: str) -> list[int]:
        """Ids of the text, as a merging encoder without special tokens gives them."""
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def encoder_of(content: bytes, pattern: str) -> PrefixEncoder:
    """The worker's encoder for these ranks; built once for each worker."""
    return resident(("bpe", hashlib.sha256(content).digest(), pattern), lambda: PrefixEncoder(Vocabulary.parse(content), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, token count, digests of the ids and of the decoded bytes.

    A null text counts as empty and gives 0 tokens and the digests of the empty string; repeated rows give equal
    rows; an empty table gives an empty table; other columns of ``docs`` are ignored. With ``keep_ids`` the ids
    come along as an array. The ranks (about 1 MB, fixed by the vocabulary) are broadcast; texts never move.
    """
    with open(ranks_path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content.value, pattern)
        names, sha = encoder.names, hashlib.sha256
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, digests, decoded, kept = [], [], [], []
                for text in part.column(1):
                    ids = encoder.encode(text.as_py() or "")
                    counts.append(len(ids))
                    digests.append(sha(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(sha(encoder.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema)
