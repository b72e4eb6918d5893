"""Every stage of the pipeline on odd tables, and the stages that decide rows against plain versions."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["*", "1 AS n", "'x' AS row", "2 AS key", "3 AS rank", "'y' AS lang_pred", "4 AS component_id", "5 AS n_shingles", "6 AS mix_pass", "'z' AS mix_source", "7 AS n_lines_removed", "8 AS gone_id", "9 AS id", "'t' AS t"]


def odd_rows():
    rng = random.Random(12)
    words = "the of and that with from have this some other words here".split()
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=8)) for _ in range(n))
    rows = [(i, text(rng.randint(1, 5)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50, rows[3][1], "en", "s0"), (51, rows[3][1].replace("the", "thee", 1), "en", "s1"), rows[5], rows[5], (60, None, None, None), (61, "", "en", "s1"), (62, " \n\t\n", None, "s2"), (None, "some other words here of an unnamed row", "en", "s0"), (63, "12 + 34\n\n", "en", None)]
    rows += [(70, "word " * 6000 + "end", "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, k, s, None if t is None else len(t)) for i, t, k, s in odd_rows()], SCHEMA).selectExpr(*CLASH)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_empty_tables(spark, docs, tmp_path, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert rows and all((r.row, r.key, r.lang_pred, r.t) == ("x", 2, "y", "t") for r in rows)
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == docs.columns and empty.count() == 0


def test_what_each_stage_lets_through(spark, docs, tmp_path):
    ids = lambda k: sorted((r.doc_id for r in corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).collect()), key=lambda x: (x is None, x))
    told = [i for i, t, _, _ in odd_rows() if t and any(c.isalpha() for c in t)]
    assert ids(0) == sorted(told, key=lambda x: (x is None, x))  # letters decide; repeated rows stay as often as they come
    deduped = {r.doc_id: r.text for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()}
    assert deduped[3] == odd_rows()[3][1] and deduped[60] is None
    assert all(r.n_chars == len(r.text) for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect() if r.text is not None)


def test_near_copies_against_all_pairs(spark, docs, tmp_path):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rows = [(i, shingles(t)) for i, t, _, _ in odd_rows() if i is not None]
    first = {i: i for i, _ in rows}
    for _ in rows:  # components by repeated minima
        for i, a in rows:
            for j, b in rows:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    first[i] = first[j] = min(first[i], first[j])
    kept = sorted([i for i, _ in rows if first[i] == i] + [-1])
    got = corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == kept
    assert sum(r.doc_id == 5 for r in got) == 3


def test_mixture_uses_every_row_and_encoding_gives_a_row_for_each(spark, docs, tmp_path):
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} == {i for i, *_ in odd_rows()}
    assert sum(r.doc_id == 5 for r in mixed.collect()) >= 3
    encoded = corpus_pipeline.encode(spark, docs.select("doc_id", "text"), str(tmp_path))
    found = {r.doc_id: r.n_tokens for r in encoded.collect()}
    assert encoded.count() == len(odd_rows()) and found[60] == found[61] == 0 and found[70] > 6000
    assert corpus_pipeline.encode(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_worker_frees_the_encoder_before_the_next_operator_builds():
    import gc
    import weakref

    from strandloom.llm.bpe import PrefixEncoder, Vocabulary
    from strandloom.llm.resident import resident

    vocabulary = Vocabulary({bytes([i]): i for i in range(256)})
    gc.disable()  # no collection by chance
    try:
        held = weakref.ref(resident("encoder of this test", lambda: PrefixEncoder(vocabulary, r"\w+")))
        assert held().encode("ab") == [97, 98]
        resident("next of this test", lambda: held() is None)
        assert resident("next of this test", lambda: None) is True
        again = weakref.ref(PrefixEncoder(vocabulary, r"\w+"))
        assert again() is None  # nothing in it refers back to it
    finally:
        gc.enable()
