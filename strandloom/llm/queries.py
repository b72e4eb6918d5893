"""One query for each operator of the subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.storage import table
from strandloom.llm import bpe, chat, collocations, cotrain, fuse, html_text, jaccard, language, line_chunks, media, mixing, pii, spelling


def op1_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the 50k byte-level ranks."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing entropy."""
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as MPEG audio, read back and described."""
    return media.describe_media(media.store_media(table(spark, sf_dir, "documents")))


def op4_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' mixture: one row for each use of a document, without its text."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIX_ENTROPY, MIX_PASSES, MIX_BUDGET).drop("text", "mix_source")


#: Share of the greatest entropy, passes of a source, and tokens of the mixture over those of the corpus: small sources are repeated, large ones thinned.
MIX_ENTROPY, MIX_PASSES, MIX_BUDGET = 0.9999, 1.5, 1.0
_HASH = "CAST('0x' || substr(md5(concat_ws(':', {})), 1, 15) AS BIGINT)"
OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tok FROM documents
), s AS (SELECT src, sum(tok)::BIGINT AS n FROM d GROUP BY src),
p AS (SELECT src, n, n::DOUBLE / (SELECT sum(n) FROM s)::DOUBLE AS p FROM s WHERE n > 0),
b AS (
  SELECT 0 AS step, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0::DOUBLE AS lo2, 1::DOUBLE AS hi2
  UNION ALL
  SELECT step + 1, CASE WHEN h < goal THEN lo ELSE m END, CASE WHEN h < goal THEN m ELSE hi END, CASE WHEN g <= {MIX_PASSES} THEN lo2 ELSE m2 END, CASE WHEN g <= {MIX_PASSES} THEN m2 ELSE hi2 END
  FROM (
    SELECT step, lo, hi, lo2, hi2, (lo + hi) / 2 AS m, (lo2 + hi2) / 2 AS m2,
      (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p) AS h,
      (SELECT {MIX_ENTROPY} * ln(count(*)) FROM p) AS goal,
      (SELECT {MIX_BUDGET} * pow(min(p), (lo2 + hi2) / 2 - 1) / sum(pow(p, (lo2 + hi2) / 2)) FROM p) AS g
    FROM b WHERE step < {mixing.STEPS}
  )
), a AS (SELECT CASE WHEN (SELECT count(*) FROM p) < 2 THEN 1 ELSE round(greatest(hi, hi2), 9) END AS alpha FROM b WHERE step = {mixing.STEPS}),
w AS (SELECT src, n, pow(p, alpha) / (SELECT sum(pow(p, alpha)) FROM p, a) AS w FROM p, a),
q AS (SELECT src, n, CAST(round_even(w * ({MIX_BUDGET} * (SELECT sum(n) FROM w)), 0) AS BIGINT) AS quota FROM w),
k AS (
  SELECT src, quota // greatest(1, n) AS whole, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS rest, greatest(1, CAST(ceil(n / {mixing.BLOCK_TOKENS}) AS BIGINT)) AS blocks
  FROM (SELECT * FROM q UNION ALL SELECT src, n, 0 FROM s WHERE n = 0)
), t AS (SELECT d.*, whole, rest, {_HASH.format("17, src, doc_id")} AS rank, {_HASH.format("17, src, doc_id")} % blocks AS block FROM d JOIN k USING (src)),
u AS (SELECT src, block, rest, sum(tok) AS tok FROM t GROUP BY ALL),
v AS (SELECT src, block, tok, rest - (sum(tok) OVER (PARTITION BY src ORDER BY {_HASH.format("18, src, block")}, block) - tok) AS room FROM u),
x AS (SELECT t.*, coalesce(v.tok, 0) AS block_tok, coalesce(room, 0) AS room, sum(t.tok) OVER (PARTITION BY src, t.block ORDER BY rank, doc_id, t.tok) AS upto FROM t JOIN v USING (src, block)),
y AS (SELECT doc_id, source, block, CASE WHEN tok = 0 THEN greatest(1, whole) WHEN room > 0 AND (block_tok <= room OR upto <= room) THEN whole + 1 ELSE whole END AS uses FROM x),
z AS (SELECT doc_id, source, block AS mix_block, unnest(range(1, uses + 1)) AS mix_pass FROM y)
SELECT doc_id, source, mix_pass, mix_block, {_HASH.format("17, mix_pass, doc_id")} AS mix_rank FROM z
"""


def op5_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two co-trained views."""
    docs = table(spark, sf_dir, "documents")
    return cotrain.score_quality(docs, cotrain.train(docs, table(spark, sf_dir, "labels")))


def op8_divide_skip_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by three-word shingles and a similarity of 0.9."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_binary_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents: three quarters of the ids are the snapshot, the others the incoming batch."""
    return fuse.exact_dedup(table(spark, sf_dir, "documents"), F.pmod(F.col("doc_id"), F.lit(4)) == 3)


OP9_SQL = """
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_cp, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op10_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the multi-line chunks that an earlier place of the corpus holds."""
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM d WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
e AS (SELECT *, ((lag(h, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) * {line_chunks._BASE} + h) % {line_chunks._PRIME}) % {line_chunks.DIVISOR} = 0 OR k = n AS ends FROM h),
c AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
t AS (SELECT doc_id, c, min(k) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS chunk FROM c GROUP BY doc_id, c),
r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS place FROM t WHERE n > 1 AND regexp_matches(chunk, '[^\\x20\\x09-\\x0D]')),
a AS (SELECT c.*, coalesce(r.place, 1) > 1 AS gone FROM c LEFT JOIN r USING (doc_id, c)),
o AS (SELECT doc_id, string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY k) AS text, count(*) FILTER (gone) AS gone FROM a GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(o.gone, 0) AS n_lines_removed FROM d LEFT JOIN o USING (doc_id)
"""


def op11_prefix_suffix_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, one in 199 of which has lost a letter."""
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, streamed, revised, folded and rendered; what is read back."""
    marked = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(fixed)
    return chat.digests(chat.format_conversations(turns, drafts=True))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(role, '␛', '␛␛'), '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|<SYS>>|</SYS>>|s>|/s>)|(\[)(INST\]|/INST\])', '\1\3␛\2\4', 'g') AS r,
    regexp_replace(replace(text, '␛', '␛␛'), '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|<SYS>>|</SYS>>|s>|/s>)|(\[)(INST\]|/INST\])', '\1\3␛\2\4', 'g') AS x FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(x) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, {collocations.MAX_WORDS + 1})) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {collocations.SUPPORT}),
u AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, u.phrase, u.k, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, k, a, w, unnest(range(2, k)) AS m FROM c),
j AS (SELECT DISTINCT lang, a, array_to_string(w[o:o + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS o FROM i)),
o AS (SELECT lang, phrase, max(a) AS longer FROM j GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {collocations.ABSORB_PERCENT} * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= {collocations.TOP}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_prefix_bpe, op2_cross_parsing_language, op3_mpeg_audio, op4_temperature_mixture, op5_host_suffix_array, op6_bootstrapped_pii, op7_cotraining_quality, op8_divide_skip_jaccard, op9_binary_fuse_dedup, op10_line_chunk_dedup, op11_prefix_suffix_tiling, op12_event_sourced_chat, op13_son_collocations)}

ORACLE_SQL: dict[str, str] = {"op4_temperature_mixture": OP4_SQL, "op9_binary_fuse_dedup": OP9_SQL, "op10_line_chunk_dedup": OP10_SQL, "op12_event_sourced_chat": OP12_SQL, "op13_son_collocations": OP13_SQL}
