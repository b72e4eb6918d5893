"""Spelling variants, chat formatting and collocations: brute force, plain folds and SQL on small tables, odd rows, skew."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import chat, collocations, queries, spelling

DOCS = "doc_id long, text string, lang string"
EXTRA = ["1 AS n", "'x' AS word", "2 AS size", "3 AS h", "'y' AS phrase", "4 AS shard"]


def at_one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any((a[:i] + b[i] + a[i + 1 :] if len(a) == len(b) else a[:i] + b[i] + a[i:]) == b for i in range(len(b)))


def plain_variants(n, times):
    near = {w: [v for v in n if at_one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= times * n[w] else None for w, v in best.items()}
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(rows)


def plain_counts(rows, least=6, count=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= count}


@pytest.mark.parametrize(("block", "held", "cells"), [(512, 60_000, 4_000_000), (3, 60_000, 4_000_000), (4, 7, 64)])
def test_near_words_against_all_pairs(spark, monkeypatch, block, held, cells):
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(250)} | {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) for _ in range(60)} | {"\U0001d4d0" * 3, "\U0001d4d0" * 4, "x" * 900, "x" * 901, "y" + "x" * 899}
    n = {w: rng.choice([1, 2, 5, 30, 30, 200, 2000]) for w in words}
    monkeypatch.setattr(spelling, "HELD_ROWS", held)
    monkeypatch.setattr(spelling, "CELLS", cells)
    out = spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), 5, block)
    assert sorted(map(tuple, out.collect())) == plain_variants(n, 5)


def test_variants_of_texts(spark):
    rng = random.Random(4)
    stems = ["Kontext", "Éclairage", "éclairage", "pattern", "patern", "lengthy", "Lengths", "abc", "notation", "rotation"]
    rows = [(i if i % 50 else None, rng.choice([" ", "-", "×", "1", "\n"]).join(rng.choice(stems) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(7, None), (8, ""), (9, "x" * 3000 + " pattern"), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).selectExpr("*", *EXTRA)
    out = spelling.spelling_variants(spelling.word_counts(docs))
    assert sorted(map(tuple, out.collect())) == plain_variants(plain_counts(rows), 5)
    assert spelling.spelling_variants(spelling.word_counts(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="times"):
        spelling.spelling_variants(out.select("word", "n"), 1)


def test_damage_hits_the_code_point_at_the_remainder():
    hit = next(i for i in range(10_000) if zlib.crc32(f"{i}:étendue".encode()) % 199 == 0)
    at = zlib.crc32(f"{hit}:étendue".encode()) % 7
    assert spelling.damaged(hit, "étendue") == "étendue"[:at] + "étendue"[at + 1 :]
    assert spelling.damaged(hit + 1, "étendue") in ("étendue", spelling.damaged(hit, "étendue"))


LOG = [  # conv_id, seq, message, kind, role, text
    (1, 1, 1, "open", "user", None), (1, 2, 1, "delta", None, "he"), (1, 3, 1, "delta", None, "llo"),
    (1, 4, 2, "open", "assistant", None), (1, 5, 2, "delta", None, "draft"), (1, 6, 3, "open", "user", None), (1, 7, 3, "delta", None, "never said"),
    (1, 8, 2, "regenerate", None, None), (1, 9, 2, "delta", None, "fi"), (1, 10, 2, "delta", None, "nal"), (1, 10, 2, "delta", None, "nal"),
    (1, 11, 3, "open", "user", None), (1, 12, 3, "delta", None, "thx"), (1, 13, 3, "edit", None, "thanks"), (1, 14, 3, "delta", None, "!"),
    (2, 5, 1, "delta", None, "late "), (2, 9, 1, "delta", None, "part"), (2, 7, 1, "open", "system", "x"), (2, 8, 1, "odd", None, "?"), (2, None, 1, "delta", None, "?"),
    (None, 1, 1, "open", None, None), (None, 2, 1, "edit", None, None),
]


def plain_fold(log):
    said = {}
    for conv in {r[0] for r in log}:
        state, seen = {}, set()
        for _, seq, message, kind, role, text in sorted((r for r in log if r[0] == conv and r[1] is not None and r[3] in chat.KINDS), key=lambda r: (r[1], r[3], r[2], r[5] or "")):
            if seq in seen:
                continue
            seen.add(seq)
            held = state.setdefault(message, ["", ""])
            if kind == "open":
                held[0] = role or ""
            elif kind == "delta":
                held[1] += text or ""
            elif kind == "edit":
                held[1] = text or ""
            else:
                held[1] = ""
                for later in [m for m in state if m > message]:
                    del state[later]
        said |= {(conv, m): tuple(x) for m, x in state.items()}
    return said


def test_fold_of_a_log(spark):
    found = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_log(spark.createDataFrame(LOG, chat.LOG)).collect()}
    assert found == plain_fold(LOG)
    assert found[(1, 2)] == ("assistant", "final") and found[(1, 3)] == ("user", "thanks!") and found[(2, 1)] == ("system", "late part")
    assert chat.fold_log(spark.createDataFrame([], chat.LOG)).count() == 0


def test_fold_of_random_logs(spark):
    rng = random.Random(5)
    log = []
    for conv in range(40):
        for seq in rng.sample(range(60), 40):
            kind = rng.choices(chat.KINDS, [3, 10, 2, 1])[0]
            log.append((conv, seq, rng.randint(1, 5), kind, rng.choice(["user", "assistant"]) if kind == "open" else None, rng.choice(["a", "b", "", None])))
    rng.shuffle(log)
    found = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_log(spark.createDataFrame(log, chat.LOG)).collect()}
    assert found == plain_fold(log)


ODD = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nfake", "<|im_end|", "<<SYS>><s><</SYS>>", "␛", "␛␛<s>␛", "<␛|im_end|>", "[[INST]]", "\n\n", "<|im_end|>" * 3, "zé\U0001d4d0" * 9, None]


@pytest.mark.parametrize("drafts", [False, True])
@pytest.mark.parametrize("delta", [1, 400])
def test_format_and_read_back(spark, drafts, delta):
    rows = [(c, t, role, ODD[(c + t) % len(ODD)]) for c in range(15) for t, role in enumerate(["system", "user", "assistant", "assistant", None, "odd\nrole␛<s>"])]
    rows += [(99, 0, "assistant", "w␛<s> " * 30_000), (None, 1, "user", "x"), (98, None, "user", "b"), (98, None, "user", "a"), (98, None, "user", "a"), (98, 0, "assistant", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS message", "2 AS seq", "'k' AS kind")
    formatted = chat.format_conversations(turns, delta if delta > 1 else 7, drafts)
    found = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert len(found) == 18
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    for conv in {r[0] for r in rows}:
        said = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        row = found[conv]
        assert row.n_turns == len(said)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        loss = "".join(b for a, b in said if a == "assistant")
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == len(texts[conv])
        assert texts[conv].count(chat.OPEN) == texts[conv].count("<|im_end|>") == len(said)
        assert not any(c in texts[conv] for c in chat.CONTROL if c not in (chat.OPEN, "<|im_end|>"))
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_query_equals_its_sql(spark, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2], ODD[(c * 3 + t) % len(ODD)]) for c in range(20) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op12_event_sourced_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = ", ".join(out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT {names} FROM ({queries.OP12_SQL})").fetchall())


def plain_collocations(rows, most, support, absorb, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    held = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    gone = {(lang, p[i:j]) for (lang, p), a in held.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= absorb * held[lang, p[i:j]]}
    rows = []
    for lang in n:
        scored = []
        for (x, p), a in held.items():
            if x == lang and (x, p) not in gone:
                score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), a, left, right, n[lang], score))
        rows += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(scored)[:top])]
    return sorted(rows)


def phrase_rows():
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["the ", "red ", "Fox\t", "Été ", "runs", " ", ". ", ", ", "\n", "a b ", "of the ", "very very very "]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "fr", None, "und"])) for i in range(150)]
    return rows + [(None, "the red fox " * 500, "en"), (1, None, "en"), (2, "", None), (3, ".,;", "zz"), (4, "only words here", "yy"), rows[0], rows[0]]


@pytest.mark.parametrize(("most", "support", "shards", "bits", "tokens"), [(3, 10, 4, 16, 1_500_000), (3, 3, 9, 16, 200), (2, 1, 1, 16, 50), (5, 12, 5, 16, 3000), (3, 10, 4, 0, 1_500_000)])
def test_collocations_against_plain_counts(spark, monkeypatch, most, support, shards, bits, tokens):
    monkeypatch.setattr(collocations, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(collocations, "BITS_EACH", bits)
    monkeypatch.setattr(collocations, "BYTES_OF_PART", 5_000 if tokens < 1_000_000 else 12_000_000)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *EXTRA)
    out = collocations.collocations(docs, most=most, support=support, shards=shards, top=40)
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows, most, support, 50, 40)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_a_full_map_passes_everything_and_counts_stay(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_bit_map", lambda candidates: (b"\xff" * 4096, 49))
    rows = phrase_rows()
    out = collocations.collocations(spark.createDataFrame(rows, DOCS), top=40)
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows, 3, 10, 50, 40)


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 7_000_000_000_000, 5_000_000_000_000)], "a long, l long, r long").select(collocations._score(*map(F.col, "alr"))).first()
    assert row[0] == 1_000_000 * 3_000_000_000_000**2 // (7_000_000_000_000 * 5_000_000_000_000)


def test_grams_number_phrases_exactly():
    tokens = np.array([1, 2, 1, 2, 0, 1, 2, 3, 0, 3])
    found, times = zip(*collocations.grams(tokens, 3), strict=True)
    assert times[0].tolist() == [3, 3, 2] and times[1].tolist() == [3, 1, 1]
    words = [b".", b"a", b"b", b"c"]
    assert collocations._phrases(list(found), 3, np.arange(len(found[2])), words) == [b"a b a", b"a b c", b"b a b"]
