"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text.
A text is parsed greedily into the longest phrases that occur in the sample; the
cross-entropy estimate of a language is phrases * log2(sample length) / text length,
and the language with the lowest one wins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandloom.functions.sizes import small
from strandloom.llm.resident import resident

#: Bound of the labelled sample: languages (those with most labelled rows), rows of a language, characters of a row.
SAMPLE_LANGUAGES, SAMPLE_ROWS, PIECE_CHARS = 512, 64, 600
#: Letters of a block and of a part of a text; the blocks of a part advance together, and each is then read on from where the one before ends.
BLOCK, PART = 512, 512 * 4096
_SPACE, _OTHER = 1, 2


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton whose paths from state 0 are the substrings of ``codes``."""
    moves: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[end] + 1)
        p = end
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        end = new
    return moves


class Automaton:
    """A suffix automaton as two arrays: the move from state s by letter c lies at s + c, where one names s and the other its target.

    States are numbered so that no two moves share a cell, hence the array is little longer than the moves are many,
    however large the alphabet. ``root`` holds the moves from the first state, 0 where there is none.
    """

    def __init__(self, codes: list[int], letters: int):
        moves = suffix_automaton(codes)
        place = [0] * len(moves)
        used, taken = bytearray(2 * len(moves) + 4 * letters), bytearray(2 * len(moves) + 4 * letters)  # cells, states' numbers
        for c in moves[0]:
            used[c] = 1
        taken[0] = 1
        cursor, size = 1, 0
        for s in sorted(range(1, len(moves)), key=lambda s: -len(moves[s])):
            own = sorted(moves[s])
            if len(own) <= 1 < size:
                cursor = 1  # states of one move fill the gaps
            size = len(own)
            while True:
                if cursor + 2 * letters >= len(used):
                    used, taken = used + bytes(len(used)), taken + bytes(len(taken))
                at = cursor - own[0] if own else cursor
                if at > 0 and not taken[at] and not any(used[at + c] for c in own):
                    break
                cursor += 1
            place[s] = at
            taken[at] = 1
            for c in own:
                used[at + c] = 1
        self.owner = np.full(max(place) + letters + 1, -1, np.int32)
        self.target = np.zeros(len(self.owner), np.int32)
        for s, own in enumerate(moves):
            for c, target in own.items():
                self.owner[place[s] + c], self.target[place[s] + c] = place[s], place[target]
        self.root = np.zeros(letters + 1, np.int32)
        for c, target in moves[0].items():
            self.root[c] = place[target]
        self.bits = math.log2(max(2, len(codes)))

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether a phrase begins with each letter. A letter that the sample lacks is a phrase by itself."""
        cell = state + letter
        lost = self.owner.take(cell) != state
        return np.where(lost, self.root.take(letter), self.target.take(cell)), lost | (state == 0)


class CrossParser:
    """Automata of all languages. Every letter of the samples has a code of its own; all others share one."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        lowered = {k: samples[k].lower() for k in self.languages}
        own = sorted({ch for text in lowered.values() for ch in text if ch.isalpha()})
        self.code = np.full(0x110000, _SPACE, np.uint32 if len(own) > 65_000 else np.uint16)
        for point in range(0x110000):
            if chr(point).isalpha():
                self.code[point] = _OTHER
        for i, ch in enumerate(own):
            self.code[ord(ch)] = i + 3
        self.letters = len(own) + 3
        self.automata = [Automaton(self.codes(lowered[k]).tolist(), self.letters) for k in self.languages]
        self.bits = [a.bits for a in self.automata]

    def codes(self, lowered: str) -> np.ndarray:
        """Letter codes; what is no letter is one space, runs of it once."""
        points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        if len(codes) > 1:
            codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
        return codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) under each language (column), as one greedy parse of the whole text finds them."""
        out = np.zeros((len(texts), len(self.automata)), np.int64)
        for j, automaton in enumerate(self.automata):
            state = np.zeros(len(texts), np.int32)
            for start in range(0, max(map(len, texts), default=0), PART):  # texts beyond PART letters go on in further turns
                live = [i for i, c in enumerate(texts) if len(c) > start]
                found, state[live] = self._phrases(automaton, [texts[i][start : start + PART] for i in live], state[live])
                out[live, j] += found
        return out

    @staticmethod
    def _phrases(automaton: Automaton, texts: list[np.ndarray], enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each text, entered in the given states, and the states behind the texts.

        Blocks are first parsed side by side as if each began a phrase, then read on across their borders: the state
        behind a block is carried into the next one until it equals the state that the block's own parse has at the
        same letter; from there on both are one parse. Blocks of which no letter does so pass their new state on.
        """
        blocks = [-(-len(c) // BLOCK) for c in texts]
        first = np.concatenate(([0], np.cumsum(blocks)[:-1])).astype(int)
        count = sum(blocks)
        flat = np.zeros(count * BLOCK, np.int32)
        length = np.zeros(count, np.int64)
        for codes, at, n in zip(texts, first.tolist(), blocks, strict=True):
            flat[at * BLOCK : at * BLOCK + len(codes)] = codes
            length[at : at + n] = np.minimum(BLOCK, len(codes) - BLOCK * np.arange(n))
        order = np.argsort(-length, kind="stable")  # long blocks first, so that short ones leave the tail of the loop
        back = np.empty_like(order)
        back[order] = np.arange(count)
        columns = np.ascontiguousarray(flat.reshape(count, BLOCK)[order].T)
        active = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
        begins = np.zeros(count, np.int32)  # phrases that begin in the block, so far
        states = np.zeros((BLOCK, count), np.int32)
        before = np.zeros((BLOCK, count), np.int16)  # phrases that begin up to each letter
        state = np.zeros(count, np.int32)
        for i in range(BLOCK):
            n = active[i]
            if not n:
                break
            state[:n], new = automaton.step(state[:n], columns[i, :n])
            begins[:n] += new
            states[i, :n] = state[:n]
            before[i, :n] = begins[:n]
        own, alone = begins[back].astype(np.int64), state[back]
        found, last = own.copy(), alone.copy()
        heads = np.zeros(count, bool)
        heads[first] = True
        given = np.zeros(count, np.int32)
        given[first] = enter
        todo = np.flatnonzero(~heads | (given != 0))  # blocks that the parse of the text enters in a state of its own
        while len(todo):
            row = back[todo]
            carried = np.where(heads[todo], given[todo], last[todo - 1])
            begun, met = np.zeros(len(todo), np.int64), np.zeros(len(todo), bool)
            live = np.arange(len(todo))
            for i in range(BLOCK):
                live = live[length[todo[live]] > i]
                if not len(live):
                    break
                carried[live], new = automaton.step(carried[live], columns[i, row[live]])
                begun[live] += new
                same = carried[live] == states[i, row[live]]
                at = live[same]
                met[at] = True
                begun[at] += begins[row[at]] - before[i, row[at]]
                live = live[~same]
            found[todo] = begun
            behind = np.where(met, alone[todo], carried)
            moved = todo[behind != last[todo]] + 1
            last[todo] = behind
            todo = moved[(moved < count) & ~heads[np.minimum(moved, count - 1)]]
        return np.add.reduceat(found, first), last[first + np.array(blocks) - 1]

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; und and 0.0 without a letter."""
        codes = [self.codes((t or "").lower()) for t in texts]
        has = [bool((c != _SPACE).any()) for c in codes]
        if not self.languages or not any(has):
            return [("und", 0.0)] * len(texts)
        found = self.phrases(codes)
        entropy = found * np.array(self.bits) / np.array([max(1, len(c)) for c in codes])[:, None]
        out = []
        for ok, row in zip(has, entropy.tolist(), strict=True):
            best = min(range(len(row)), key=lambda j: (row[j], j))
            rest = min((x for j, x in enumerate(row) if j != best), default=2 * row[best])
            out.append((self.languages[best], min(1.0, max(0.0, 1.0 - row[best] / rest)) if rest else 0.0) if ok else ("und", 0.0))
        return out


def parser_of(samples: dict[str, str]) -> CrossParser:
    """The worker's parser for these samples; built once for each worker."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return resident(("language", key), lambda: CrossParser(samples))


def held_out():
    """The fold that learning never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_samples(docs: DataFrame) -> dict[str, str]:
    """Sample text of each language, from rows outside the held-out fold with text and lang.

    The sample is bounded by SAMPLE_LANGUAGES languages, SAMPLE_ROWS rows of each and PIECE_CHARS characters of a row,
    whatever the size of the table: languages with most labelled rows, ties by name; rows with the lowest hash of
    their id, and of each the piece at a place that the hash names. Rows are thinned by that hash during the scan,
    so no text is shuffled but the few that are candidates.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.col("lang") != "und") & (F.length("text") > 0))
    totals = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGUAGES).collect()  # a number for each language
    if not totals:
        return {}
    counts = small(docs.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in totals], "lang string, count long"))
    unit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    thinned = rows.select("lang", "doc_id", unit.alias("u"), "text").join(counts, "lang").filter(F.col("u") * F.col("count") < 3 * SAMPLE_ROWS)
    at = (F.lit(1) + F.floor(F.col("u") * 1e6) % F.greatest(F.lit(1), F.length("text") - PIECE_CHARS + 1)).cast("int")
    pieces = thinned.select("lang", "u", "doc_id", F.substring(F.col("text"), at, F.lit(PIECE_CHARS)).alias("piece"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "piece"))).filter(F.col("k") <= SAMPLE_ROWS)
    found: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "k").collect():  # SAMPLE_ROWS pieces of a language at most
        found.setdefault(row["lang"], []).append(row["piece"])
    return {k: " ".join(v) for k, v in found.items()}


def identify_languages(docs: DataFrame, samples: dict[str, str] | None = None, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, and with ``carry`` the whole row as ``row``.

    Only the text decides. A null or letterless text, or a table without labels, gives lang_pred und and score 0.
    The score is the share by which the best cross-entropy lies below the second best. Ties go to the language that
    sorts first. Repeated rows give equal rows, an empty table an empty one, other columns are ignored. Whole texts
    are parsed, each from its first letter to its last by one greedy parse.
    """
    samples = labelled_samples(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(shared.value)
        for batch in batches:
            column = batch["row"].field(place) if carry else batch["text"]
            start = 0
            while start < batch.num_rows:
                texts, chars, stop = [], 0, start
                while stop < batch.num_rows and chars < PART:
                    texts.append(column[stop].as_py())
                    chars += max(BLOCK, len(texts[-1] or ""))  # a short text takes a block, too
                    stop += 1
                found = parser.classify(texts)
                part = batch.slice(start, stop - start)
                columns = [part["doc_id"], part["held_out"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns + ([part["row"]] if carry else []), names=names)
                start = stop

    names = ["doc_id", "held_out", "lang_pred", "score"] + ["row"] * carry
    place = docs.columns.index("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.struct("*").alias("row") if carry else F.col("text").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, T.StructType(schema.fields + [rows.schema["row"]] * carry) if carry else schema)


def keep_identified(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text has a language; null and letterless texts go.

    Repeated rows stay as often as they come; an empty table gives an empty one; other columns, whatever their names,
    are kept. A table without labels identifies nothing, so none of its rows stays.
    """
    return identify_languages(docs, samples, carry=True).filter("lang_pred <> 'und'").select("row.*")
