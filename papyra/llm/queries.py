"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import audio_features, bin_slack, chat_parts, co_training, elkan, lsh_forest, norm_topk, pfair, phrase_lists, prefix_join, seed_extend, token_planes, url_vocabulary


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


#: Target weights of the query's sources; all others have DEFAULT_WEIGHT.
WEIGHTS = {"src0": 3, "src1": 5, "src2": 2, "src3": 7}
DEFAULT_WEIGHT = 2
BLOCK_ROWS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.write_token_planes(table(spark, sf_dir, "documents"), tokenizer_path()).documents()


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio_features.store_media(table(spark, sf_dir, "documents"))
    return audio_features.store_features(media.read()).read().withColumn("feature", audio_features.feature()).drop("tensors", "spans")


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = co_training.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("content_score", "meta_score", "score")], "keep")


def op4_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.interleave(docs, WEIGHTS, DEFAULT_WEIGHT, BLOCK_ROWS)


def op6_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_vocabulary.filter_urls(table(spark, sf_dir, "pages"))


def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return seed_extend.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.linked(table(spark, sf_dir, "documents"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op10_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    chats = chat_parts.format_chats(rows.union(extra).withColumn("parts", chat_parts.text_parts(F.col("text"))))
    read = chats.select("conv_id", "formatted", chat_parts.read_turns(F.col("formatted")).alias("t"), chat_parts.loss_text(F.col("segments"), F.col("loss")).alias("loss"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.digest(elkan.cluster(table(spark, sf_dir, "embeddings")))


def op12_phrase_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_lists.collocations(table(spark, sf_dir, "documents"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def pfair_sql() -> str:
    """Blocks with release and deadline from the fluid mix of all sources, then one slot after another to the earliest deadline."""
    cases = " ".join(f"WHEN source = '{s}' THEN {w}" for s, w in WEIGHTS.items())
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key, CASE {cases} ELSE {DEFAULT_WEIGHT} END AS w FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST) - 1 AS ordinal FROM d),
s AS (SELECT key, w, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks FROM d GROUP BY 1, 2),
b AS (SELECT key, w, j, row_number() OVER (PARTITION BY w, j ORDER BY blocks DESC, key) - 1 AS r, count(*) OVER (PARTITION BY w, j) AS m FROM (SELECT *, unnest(range(blocks)) AS j FROM s)),
f AS (SELECT b.key, b.w, b.j, b.r, sum(least(s.w * (b.j * m + r), s.blocks * m * b.w)) // any_value(m * b.w) AS release, (sum(least(s.w * (b.j * m + r + 1), s.blocks * m * b.w)) + any_value(m * b.w) - 1) // any_value(m * b.w) AS due
  FROM b CROSS JOIN s GROUP BY 1, 2, 3, 4),
q AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY j, r) AS n FROM f),
c AS (SELECT list(struct_pack(w := w, x := x) ORDER BY w) AS classes FROM (SELECT w, list(struct_pack(release := release, due := due) ORDER BY n) AS x FROM q GROUP BY w)),
e AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(classes, lambda c: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS n FROM c
  UNION ALL
  SELECT slot, list_transform(done, lambda k, i: CASE WHEN i = pick THEN k + 1 ELSE k END), pick, done[pick] + 1 FROM (
    SELECT slot + 1 AS slot, done, CAST(list_min(list_transform(list_filter(list_transform(classes, lambda k, i: struct_pack(due := CASE WHEN k.x[done[i] + 1].release <= slot + 1 THEN k.x[done[i] + 1].due END, i := i)), lambda z: z.due IS NOT NULL), lambda z: z.due * 1000000 + z.i)) % 1000000 AS BIGINT) AS pick
    FROM e, c WHERE slot + 1 < (SELECT sum(blocks) FROM s)))
SELECT o.doc_id, o.source, CAST(o.ordinal AS BIGINT) AS ordinal, CAST(e.slot AS BIGINT) AS slot, CAST(o.ordinal % {BLOCK_ROWS} AS INT) AS in_block
FROM o JOIN q ON q.key = o.key AND q.j = o.ordinal // {BLOCK_ROWS} JOIN (SELECT slot, n, classes[pick].w AS w FROM e, c WHERE pick IS NOT NULL) e ON e.w = q.w AND e.n = q.n"""


BLANKS = r"[^\x20\x09-\x0D]+"

REPEATS_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{BLANKS}') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS pos FROM w),
x AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(words[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS nth FROM p),
r AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS gone FROM x WHERE nth > 1),
g AS (SELECT doc_id, list(gone) AS gone FROM r GROUP BY doc_id),
a AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS kept FROM u ANTI JOIN r ON u.doc_id = r.doc_id AND u.pos = r.gone GROUP BY u.doc_id)
SELECT a.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM a LEFT JOIN k USING (doc_id)"""

def links_sql(words: int, percent: int) -> str:
    """Components of the documents whose shingle sets are alike, every pair that shares a shingle counted."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANKS}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[pos:pos + {words - 1}], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {words - 2}, 2))) AS pos FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)"""


CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
e AS (SELECT *, length(replace(replace(role, '\\', '\\\\'), '|', '\\|')) + length(replace(replace(text, '\\', '\\\\'), '|', '\\|')) + 32 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (op1_token_planes, op2_audio_features, op3_co_training, op4_bin_slack, op5_pfair, op6_norm_topk, op7_url_vocabulary, op8_seed_extend, op9_prefix_join, op10_chat_parts, op11_elkan, op12_phrase_lists, op13_lsh_forest)
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_pfair": pfair_sql(),
        "op6_norm_topk": norm_topk.oracle_sql(),
        "op7_url_vocabulary": url_vocabulary.oracle_sql(),
        "op8_seed_extend": REPEATS_SQL,
        "op9_prefix_join": links_sql(3, 90),
        "op10_chat_parts": CHAT_SQL,
        "op11_elkan": elkan.oracle_sql(),
        "op12_phrase_lists": phrase_lists.oracle_sql(),
        "op13_lsh_forest": f"SELECT *, doc_id = component_id AS kept FROM ({links_sql(4, 80)})",
    }
