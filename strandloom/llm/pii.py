"""Personal data by bootstrapped contextual extraction.

Fixed expressions find the base entities, which are the seeds; long hexadecimal strings
are the seeds of secrets, but seeds alone. Words, labels and punctuation around a mention
make its lexical patterns. Spark scores the graph of patterns and instances in rounds: a
pattern by the share of its instances that are known, an instance by the patterns that
hold it. Patterns of high confidence and support then name further mentions: identifiers
that no expression has found, and secrets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.storage import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = 4, 4  # the first kinds are found by expressions, the last by patterns alone
#: Rounds of scoring; confidence and distinct known instances that a pattern needs to discover; score that counts;
#: weight of an instance of which nothing is known yet in a pattern with a label, in which others hold than without one.
ROUNDS, CONFIDENCE, SUPPORT, COUNTS, UNKNOWN = 4, 0.9, 3, 0.5, 0.1
_LABELLED = "[:=#][^ ]*_"

# Fixed expressions of the base kinds; the lookbehind and the possessive repeats only save retries that must fail.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_CANDIDATE = re.compile(r"[0-9@:=]")
_HEX = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}", re.IGNORECASE)
_PIECE = re.compile(r"\w+|[^\w\s]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>|=#$%&*~"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the local part, @ and a domain with a dot, found from each @ outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the base entities, in code points, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(ch.isdigit() for ch in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _level(piece: str) -> str:
    return re.sub("[0-9]+", "0", piece.lower())[:40]


def shape(text: str) -> str:
    """Kinds of characters in runs, with the length of runs of letters and digits in steps: 555-0199 is 0:3-0:3."""
    runs = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]", text[:200])
    return "".join(r if not r.isalnum() or not r.isascii() else f"{'0' if r.isdigit() else 'x' if r.isalpha() else 'm'}:{len(r).bit_length()}" for r in runs)[:60]


def around(text: str, start: int, end: int, reach: int = 120) -> list[str]:
    """Patterns of a mention: the two words before it, the words on both sides, and its label with its shape.

    Digits and case are levelled; punctuation between the words and the mention belongs to a pattern. A label is the
    word before a colon, an equals or a number sign that stands just before the mention.
    """
    low = max(0, start - reach)
    left = [_level(m[0]) for m in _PIECE.finditer(text, low, start)]
    if low and left and not text[low - 1].isspace():
        left = left[1:]  # it may be the rest of a longer word
    right = _PIECE.search(text, end, end + reach)
    words, gap = [], []
    for piece in reversed(left):
        if piece[0].isalnum() or piece[0] == "_":
            words.append(piece)
            if len(words) == 2:
                break
        elif not words:
            gap.append(piece)
    words += ["^"] * (2 - len(words))
    between = "".join(reversed(gap))[-4:]
    found = [f"{words[1]} {words[0]} {between}_", f"{words[0]} {between}_ {_level(right[0]) if right else '$'}"]
    if any(x in between for x in ":=#"):
        found.append(f"{words[0]} {between}_ {shape(text[start:end])}")
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Places that may hold an identifier: tokens with three digits, an inner @ or a leading one, letters and digits mixed,
    neighbouring tokens of digits as one, and what stands behind a label.
    """
    out: list[tuple[int, int]] = []
    label = digits = False
    for m in _TOKEN.finditer(text):
        token = m[0]
        follows, label = label, token[-1] in ":=" or len(token) > 2 and token[-1] in "\"'" and token[-2] in ":="
        at = max(token.rfind("=\""), token.rfind(":\""), token.rfind("='"))
        if at > 0 and len(token) > at + 2:  # key="value"
            token, follows = token[at + 2 :], True
        if not (follows or _MARK.search(token)):
            digits = False
            continue
        core = token.strip(_EDGE)
        if '"' in core:
            core = core[: core.index('"')].rstrip(_EDGE)  # a quoted value ends with its quote
        if not core:
            digits, label = False, label or follows and token in "\"'"
            continue
        s = m.end() - len(token) + token.find(core)
        e = s + len(core)
        n = sum("0" <= ch <= "9" for ch in core)
        alone = bool(n) and n + sum(ch in "()-./+" for ch in core) == len(core)
        if alone and digits and out and text[out[-1][1] : s].strip("()") == " ":
            out[-1] = (out[-1][0], e)
        elif n >= 3 or "@" in core[1:-1] or core[0] == "@" and len(core) > 3 or n and len(core) >= 8 or follows and len(core) >= 6:
            out.append((s, e))
        elif alone:
            out.append((s, e))  # kept only if another one follows
        digits = alone
    return [(s, e) for s, e in out if " " in text[s:e] or sum("0" <= ch <= "9" for ch in text[s:e]) >= 3 or not text[s:e].strip("0123456789()-./+") == ""]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, instance, kind, patterns) of the base entities and of the places that may hold an identifier.

    The kind of a place is SECRET for a seed of secrets, -2 for what a base expression matches and its check refuses,
    which never becomes an entity, and else -1.
    """

    def instance(s: int, e: int) -> str:
        return text[s:e] if e - s <= 64 else hashlib.md5(text[s:e].encode()).hexdigest()

    out = [(s, e, instance(s, e), kind, around(text, s, e)) for s, kind, e in base]
    taken = sorted((s, e) for s, _, e in base)
    lows = [s for s, _ in taken]
    reach, highs = 0, []
    for _, e in taken:
        reach = max(reach, e)
        highs.append(reach)
    for s, e in candidates(text):
        k = bisect_left(lows, e)
        if k and highs[k - 1] > s:
            continue
        core = text[s:e]
        digits = re.sub("[^0-9]", "", core)
        refused = _IP.fullmatch(core) or 12 <= len(digits) <= 19 and _CARD.fullmatch(core)
        out.append((s, e, instance(s, e), -2 if refused else SECRET if _HEX.fullmatch(core) else -1, around(text, s, e)))
    return out


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans.

    Counts and digest are of the base entities; spans holds these and those that patterns have discovered, n_found
    of them, n_spans in all. A null text counts as empty; repeated rows give equal rows and count once as evidence; an empty table
    gives an empty one; other columns are ignored. Spans count code points, ends exclusive; ties sort by kind.
    """
    schema = (
        "doc_id long, version long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,stop:int>>, "
        "mentions array<struct<start:int,stop:int,instance:string,kind:int,patterns:array<string>>>"
    )
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
    mention = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.string()), ("kind", pa.int32()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"]
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, digests, bases, seen = [[], [], [], []], [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                marked = _CANDIDATE.search(text)
                base = base_spans(text) if marked else []
                for k in range(BASE):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest() if base else empty)
                bases.append([{"start": s, "kind": k, "stop": e} for s, k, e in base])
                found = mentions(text, base) if marked else []
                seen.append([{"start": s, "stop": e, "instance": i, "kind": k, "patterns": p} for s, e, i, k, p in found])
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(bases, pa.list_(span)), pa.array(seen, pa.list_(mention))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    found = materialise(rows.mapInArrow(run, schema), "mentions")
    each = found.select("doc_id", "version", F.explode("mentions").alias("m")).select("doc_id", "version", "m.*")
    patterns = discover(each.select("instance", "kind", F.explode("patterns").alias("pattern")))
    kind = lambda c: F.element_at(F.array(*[F.lit(x) for x in KINDS]), c + 1)
    fresh = (
        each.filter(f"kind = -1 OR kind = {SECRET}").select("doc_id", "version", "start", "stop", F.explode("patterns").alias("pattern")).distinct().join(patterns, "pattern")
        .groupBy("doc_id", "version", "start", "stop").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("neg_kind"))).alias("best"))
        .groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", (-F.col("best.neg_kind")).alias("kind"), "stop")).alias("extra"))
    )
    joined = found.alias("f").join(fresh.alias("x"), F.col("f.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("f.version") == F.col("x.version")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"], s["stop"])), ",")
    return joined.select("f.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_found"), F.size(spans).cast("long").alias("n_spans"))


def discover(evidence: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern, kind and confidence of the patterns that may discover mentions.

    ``evidence`` has instance, kind (below 0 unless a seed) and pattern, one row for each mention and pattern. An
    instance counts once for a pattern however often they meet. A pattern's confidence in a kind is the mean score of
    its instances, in which those of which nothing is known weigh UNKNOWN if the pattern has a label; what a check has
    refused (kind -2) speaks against it.
    """
    kinds = range(len(KINDS))
    seed = [F.max((F.col("kind") == k).cast("double")).alias(f"s{k}") for k in kinds] + [F.max(F.col("kind") == -2).alias("refused")]
    edges = materialise(evidence.groupBy("pattern", "instance").agg(*seed), "edges")
    scores = materialise(edges.groupBy("instance").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in kinds], F.max("refused").alias("refused")), "scores")
    links = edges.select("pattern", "instance")
    told = F.col("refused") | (F.greatest(*[f"s{k}" for k in kinds]) >= COUNTS)
    weight = F.when(told | ~F.col("pattern").rlike(_LABELLED), 1.0).otherwise(UNKNOWN)
    for turn in range(rounds):
        means = [(F.sum(weight * F.col(f"s{k}")) / F.sum(weight)).alias(f"c{k}") for k in kinds] + [F.sum((F.col(f"s{k}") >= COUNTS).cast("int")).alias(f"n{k}") for k in kinds]
        held = materialise(links.join(scores, "instance").groupBy("pattern").agg(*means), "patterns")
        if turn + 1 < rounds:
            sure = [F.when((F.col(f"n{k}") >= support) & (F.col(f"c{k}") >= COUNTS), F.col(f"c{k}")).otherwise(0.0).alias(f"c{k}") for k in kinds]
            given = links.join(held.select("pattern", *sure), "pattern").groupBy("instance").agg(*[F.max(f"c{k}").alias(f"c{k}") for k in kinds])
            raised = [F.when(F.col("refused"), F.col(f"s{k}")).otherwise(F.greatest(f"s{k}", f"c{k}")).alias(f"s{k}") for k in kinds]
            scores = materialise(scores.join(given, "instance").select("instance", *raised, "refused"), "scores")
    best = F.array_max(F.array(*[F.struct(F.when(F.col(f"n{k}") >= support, F.col(f"c{k}")).otherwise(0.0).alias("confidence"), F.lit(-k).alias("neg")) for k in range(len(KINDS))]))
    return held.select("pattern", best.alias("b")).filter(F.col("b.confidence") >= confidence).select("pattern", (-F.col("b.neg")).alias("kind"), F.col("b.confidence").alias("confidence"))
