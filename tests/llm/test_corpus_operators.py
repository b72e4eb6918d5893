"""Deduplication, joins, mixing and quality: brute force on small tables, odd rows, skew."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandloom.llm import cotrain, fuse, jaccard, line_chunks, mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["1 AS n", "'x' AS row", "2 AS key", "3 AS size", "4 AS digest", "5 AS chunk", "6 AS gone"]


def table_of(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).selectExpr("*", *EXTRA)


def oracle(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return con.execute(sql).fetchall()


def corpus(seed, n=60, lines=6):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, lines))), f"s{min(3, int(rng.expovariate(1)))}") for i in range(n)]
    copied = [(n + i, rng.choice([rows[i][1], rows[i][1].replace(" ", "  "), rows[i][1].upper()]), "s0") for i in range(n // 3)]
    odd = [(900, None, "s0"), (901, "", None), (902, " \t\n", "s1"), (903, "x\n" * 400 + "tail", "s1"), (904, None, None), (905, "\n\n\n", "s2")]
    return rows + copied + odd


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
def test_binary_fuse_has_no_false_negative(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    held = fuse.BinaryFuse.load(fuse.BinaryFuse.build(keys).dump())
    assert held.contains(keys).all()
    others = np.random.default_rng(99).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert held.contains(others).mean() < 0.02
    assert len(held.cells) < 1.4 * n + 64


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_groups(spark, bits):
    rows = corpus(1)
    out = fuse.exact_dedup(table_of(spark, rows), F.col("doc_id") % 3 == 1, bits)
    found = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect())
    assert found == sorted(oracle(queries.OP9_SQL, rows))


@pytest.mark.parametrize("incoming", ["true", "false"])
def test_exact_groups_without_a_snapshot_or_a_batch(spark, incoming):
    rows = corpus(2, 12)
    out = fuse.exact_dedup(table_of(spark, rows), F.expr(incoming))
    assert sorted((r.doc_id, r.keep_id) for r in out.collect()) == sorted(r[:2] for r in oracle(queries.OP9_SQL, rows))
    assert fuse.exact_dedup(table_of(spark, rows).limit(0), F.expr(incoming)).count() == 0


def test_line_chunks(spark):
    rows = corpus(3, 90, 12)
    out = line_chunks.dedup_lines(table_of(spark, rows))
    assert out.columns == [*table_of(spark, rows).columns, "n_lines_removed"]
    found = sorted(((r.doc_id, r.text, r.n_lines_removed) for r in out.collect()), key=repr)
    assert found == sorted(oracle(queries.OP10_SQL, rows), key=repr)
    assert sum(r[2] for r in found) > 0
    assert line_chunks.dedup_lines(table_of(spark, rows).limit(0)).count() == 0


def test_line_chunk_boundaries_resist_shifts(spark):
    body = [f"line {i} of the passage" for i in range(40)]
    rows = [(1, "\n".join(["own start", *body]), "s"), (2, "\n".join(["a", "b", "other start", *body, "end"]), "s")]
    out = {r.doc_id: r for r in line_chunks.dedup_lines(table_of(spark, rows)).collect()}
    assert out[1].n_lines_removed == 0 and out[2].n_lines_removed >= 25
    assert out[2].text.startswith("a\nb")


def test_line_chunks_of_repeated_rows_stay(spark):
    rows = [(1, "a\nb\nc\nd\ne\nf", "s")] * 2 + [(None, "a\nb\nc\nd\ne\nf", "s")]
    assert [r.n_lines_removed for r in line_chunks.dedup_lines(table_of(spark, rows)).collect()] == [0, 0, 0]


def plain_passages(rows, words):
    """Lines in later occurrences of runs of so many words, by document; blank lines inside a run go with it."""
    places, gone = {}, {}
    for i, text, _ in sorted(rows):
        told = [(k, x, len(x.split())) for k, x in enumerate(text.split("\n"), 1) if x.split()]
        for a in range(len(told)):
            for b in range(a, len(told)):
                if sum(x[2] for x in told[a : b + 1]) >= words:
                    if places.setdefault(tuple(x[1] for x in told[a : b + 1]), (i, a)) != (i, a):
                        gone.setdefault(i, set()).update(range(told[a][0], told[b][0] + 1))
    return gone


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(0, 30))) for _ in range(8)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))), "s") for i in range(60)]
    chunks = {r.doc_id: r.n_lines_removed for r in line_chunks.dedup_lines(table_of(spark, rows)).collect()}
    out = {r.doc_id: r for r in line_chunks.dedup_lines(table_of(spark, rows), passages=True).collect()}
    plain = plain_passages(rows, 50)
    assert sum(map(len, plain.values())) > 50
    for i, text, _ in rows:
        own = text.split("\n")
        assert max(len(plain.get(i, ())), chunks[i]) <= out[i].n_lines_removed <= len(plain.get(i, ())) + chunks[i]
        if not chunks[i]:
            assert out[i].text == "\n".join(x for k, x in enumerate(own, 1) if k not in plain.get(i, ()))


def test_planted_passages_of_one_to_five_lines_go(spark):
    rng = random.Random(9)
    fresh = iter(range(10**6))
    line = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    planted = [[line(55 // n + 1) for _ in range(n)] for n in (1, 2, 3, 4, 5) for _ in range(6)]
    docs = [[line(5) for _ in range(6)] for _ in range(30)]
    keep = {x for d in docs for x in d}
    for p in planted:
        for d in rng.sample(docs, 4):
            at = rng.choice([k for k in range(len(d) + 1) if k in (0, len(d)) or d[k] in keep or d[k - 1] in keep])
            d[at:at] = p
    rows = [(i, "\n".join(d), "s") for i, d in enumerate(docs)]
    left = [x for r in line_chunks.dedup_lines(table_of(spark, rows), passages=True).collect() for x in r.text.split("\n")]
    assert sorted(left) == sorted(keep | {x for p in planted for x in p})
    again = corpus_pipeline.line_dedup(spark, table_of(spark, rows), "").collect()
    assert sorted(x for r in again for x in r.text.split("\n")) == sorted(left)


def plain_components(rows, width, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def plain_links(rows, width, percent):
    """Links of different shingle sets, by the smallest id of each, from all pairs."""
    sets = {}
    for i, t, _ in sorted(rows, reverse=True):
        w = (t or "").encode().lower().split()
        if w:
            sets[frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])] = i
    return sorted((min(i, j), max(i, j)) for x, i in sets.items() for y, j in sets.items() if i < j and 100 * len(x & y) >= percent * len(x | y))


def test_merge_skip_against_counting():
    rng = random.Random(7)
    for _ in range(500):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 15))) for _ in range(rng.randint(0, 8))]
        least = rng.randint(1, 5)
        assert jaccard.merge_skip(lists, least) == [i for i in range(40) if sum(i in x for x in lists) >= least]


@pytest.mark.parametrize("width,percent,piece", [(3, 90, 1024), (5, 80, 7), (2, 50, 2)])
def test_jaccard_links_against_all_pairs(spark, width, percent, piece, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", piece)
    rng = random.Random(width)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.randint(2, 160))] for _ in range(8)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 900)}"
        rows.append((i, " ".join(words), "s"))
    links, member = jaccard.jaccard_links(table_of(spark, rows + [(500, None, "s"), (500, None, "s")]), width, percent)
    found = sorted(tuple(r) for r in links.collect())
    assert found == plain_links(rows, width, percent) and len(found) > 40
    assert member.count() == 161 and {r.class_id for r in member.collect()} >= {x for pair in found for x in pair}


def test_overlapping_passages_without_links_verify_little(spark, monkeypatch):
    """Documents of 12 of 40 common lines share much with many others, and are alike with none of them."""
    verified = []
    plain = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (verified.append(pairs.count()), plain(pairs, *rest))[1])
    per_row = []
    for n in (300, 900):
        rng = random.Random(3)
        lines = [" ".join(f"l{k}x{j}" for j in range(8)) for k in range(40)]
        rows = [(i, "\n".join(rng.sample(lines, 12)), "s") for i in range(n)]
        verified.clear()
        out = jaccard.jaccard_components(table_of(spark, rows), 3, 90).collect()
        assert all(r.doc_id == r.component_id for r in out)
        per_row.append(sum(verified) / n)
    assert max(per_row) < 8  # pairs that are probed, for each row, however many rows


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 50, 3)])
def test_jaccard_components(spark, width, percent, seed):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 90))) for _ in range(14)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
        rows.append((i, " ".join(words), "s"))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(200 + i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(40)), "s") for i in range(25)]
    rows += [(300, None, "s"), (301, "", "s"), (302, " \n", "s"), (303, "one", "s"), (304, "ONE", "s"), (305, "one two", "s")]
    out = jaccard.jaccard_components(table_of(spark, rows), width, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == plain_components(rows, width, percent)


def test_jaccard_without_rows_and_with_repeats(spark):
    rows = [(7, "a b c d e f g", "s"), (7, "a b c d e f g", "s"), (3, "a b c d e f g", "s")]
    out = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(table_of(spark, rows)).collect())
    assert out == [(3, 3), (7, 3), (7, 3)]
    assert jaccard.jaccard_components(table_of(spark, rows).limit(0)).count() == 0
    kept = jaccard.drop_near_copies(table_of(spark, rows))
    assert [r.doc_id for r in kept.collect()] == [3] and kept.columns == table_of(spark, rows).columns


def mixture_rows(seed, sources):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randint(0, 30))) if i % 17 else None, s) for i, s in enumerate(sources)]


@pytest.mark.parametrize("entropy,passes,budget", [(0.999, 1.5, 1.0), (0.999, 1.2, 1.0), (0.9, 9.0, 0.5), (0.98, 9.0, 2.5), (0.3, 2.0, 1.0)])
def test_mixture_against_sql(spark, entropy, passes, budget):
    rows = mixture_rows(5, ["big"] * 60 + ["mid"] * 20 + ["low"] * 9 + [None] * 5)
    sql = queries.OP4_SQL
    for old, new in ((mixing.BLOCK_TOKENS, 40), (f"{queries.MIX_ENTROPY} * ln", f"{entropy} * ln"), (f"<= {queries.MIX_PASSES}", f"<= {passes}"), (f"{queries.MIX_BUDGET} * pow", f"{budget} * pow"), (f"({queries.MIX_BUDGET} * (", f"({budget} * (")):
        assert str(old) in sql
        sql = sql.replace(str(old), str(new))
    out = mixing.mix_sources(table_of(spark, rows), entropy, passes, budget, block_tokens=40)
    found = sorted(((r.doc_id, r.source, r.mix_pass, r.mix_block, r.mix_rank) for r in out.collect()), key=repr)
    assert found == sorted(oracle(sql, rows), key=repr)


def test_mixture_meets_quotas(spark):
    rows = mixture_rows(6, ["big"] * 300 + ["mid"] * 60 + ["low"] * 9)
    df = table_of(spark, rows)
    totals = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("big", "mid", "low")}
    plan, alpha = mixing.plan_mixture(spark.createDataFrame(list(totals.items()), "src string, n long"), 0.9, 4.0, 0.8)
    quotas = {r.src: r.quota for r in plan.collect()}
    assert 0 < alpha < 1 and abs(sum(quotas.values()) - 0.8 * sum(totals.values())) < 3
    assert quotas["big"] < totals["big"] and quotas["low"] > totals["low"]  # thinned and repeated
    used = {}
    for r in mixing.mix_sources(df, 0.9, 4.0, 0.8, block_tokens=100).collect():
        used[r.source] = used.get(r.source, 0) + len((r.text or "").split())
    assert all(quotas[s] - 30 <= used[s] <= quotas[s] for s in totals)  # a row short of the quota at most


def test_mixture_uses_every_row_without_a_budget(spark):
    rows = mixture_rows(5, ["big"] * 60 + ["mid"] * 20 + ["low"] * 9 + [None] * 5)
    out = [r.doc_id for r in mixing.mix_sources(table_of(spark, rows), 0.97, 1.5, block_tokens=40).collect()]
    assert len(out) > len(rows) and set(out) == set(range(len(rows)))


def test_mixture_weights(spark):
    tokens = {"a": 8000, "b": 1000, "c": 1000}
    of = lambda t, *p: (lambda plan: ({r.src: r for r in plan[0].collect()}, plan[1]))(mixing.plan_mixture(spark.createDataFrame(list(t.items()), "src string, n long"), *p))
    plan, _ = of(tokens, 0.9, 100)
    assert -sum(r.weight * np.log(r.weight) for r in plan.values()) == pytest.approx(0.9 * np.log(3), abs=1e-6)
    plan, _ = of(tokens, 0.9, 1.5)
    assert (plan["b"].weight / 1000) / (plan["a"].weight / 8000) == pytest.approx(1.5, abs=1e-5)
    plan, alpha = of(tokens, 0.9, 1.5, 0.9)
    assert plan["b"].quota / 1000 == pytest.approx(1.5, abs=1e-2) and sum(r.quota for r in plan.values()) == 9000
    assert of(tokens, 0.1, 9.0)[1] == 1.0 and of({"a": 5}, 0.9, 2)[1] == 1.0
    assert of({"a": 5, "b": 0}, 0.9, 2)[0]["b"].quota == 0


def test_mixture_of_odd_tables(spark):
    rows = [(1, None, None), (2, "", "s"), (3, "a b", "s"), (3, "a b", "s")]
    assert sorted(r.doc_id for r in mixing.mix_sources(table_of(spark, rows)).collect()) == [1, 2, 3, 3]
    assert mixing.mix_sources(table_of(spark, rows).limit(0)).count() == 0
    assert mixing.mix_sources(table_of(spark, rows).limit(0), budget_share=1.0).count() == 0
    clash = mixing.mix_sources(table_of(spark, rows).selectExpr("*", "1 AS mix_pass", "2 AS tok", "3 AS src", "4 AS rank"))
    assert clash.columns[-4:] == ["mix_source", "mix_pass", "mix_block", "mix_rank"] and clash.count() == 4


def quality_table(n=800):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        words = [rng.choice("the old map shows a river near town".split()) for _ in range(rng.randint(20, 60))]
        text = " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)
        rows.append((i, text, "en", rng.choice(["news", "wiki"]) if good == (rng.random() < 0.9) else "spam", len(text), int(good)))
    return rows


def test_quality_on_held_out_labels(spark):
    rows = quality_table()
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 2], "doc_id long, quality int")
    model = cotrain.train(docs, labels)
    out = {r.doc_id: r for r in cotrain.score_quality(docs, model).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert sum(out[r[0]].kept == bool(r[5]) for r in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in out.values())


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert cotrain.train(docs, labels) is None
    assert [(r.score, r.kept) for r in cotrain.score_quality(docs, None).collect()] == [(None, True)] * 3
    rows = quality_table(200)
    model = cotrain.train(spark.createDataFrame([r[:5] for r in rows], SCHEMA), spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, quality int"))
    assert cotrain.score_quality(docs, model).count() == 3
    assert cotrain.score_quality(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": "the of and that with from have this".split(), "de": "der und nicht mit sich auf eine werden".split()}
    text = lambda k: "\n".join(" ".join(rng.choices(words[k], k=12)) for _ in range(4))
    rows = [(i, text(k), k, "big" if i % 3 else "small") for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[0][1] + " extra", "en", "small"), (101, rows[1][1], "de", "big"), (102, None, None, "big"), (103, "12 34", None, "small")]
    docs = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
    ids = [r.doc_id for r in seen.collect()]
    assert set(range(60)) <= set(ids) and not {101, 102, 103} & set(ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids)


def test_all_operators_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
