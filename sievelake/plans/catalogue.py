"""Named queries over the driver's tables, and DuckDB SQL that gives the same rows.

Stand-ins: ``documents`` are prompts and contents (order: doc_id; group: lang; pool: source), ``benchmark`` is the evaluation
set, ``labels`` are scores, user and assistant turns of ``conversations`` are prompt and answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_tools, numbers, patterns, repetition, scripts, text
from ..operators.storage import shared_path, stored
from ..operators import backends, cascade, contamination, joins, metrics, near_dup, prompt_writer, ratings, reports, sampling, vocabulary
from ..sources import jobs, readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Tables whose texts are worked on.
TEXTS = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out for heavy work on texts: small files come in fewer partitions than there are cores, and a file of one row group in one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.col("lang").alias("task"), "source", F.col("text").alias("prompt"), F.col("text").alias("content"))


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return contamination.checked_eval(b.select(F.col("item_id").alias("eval_index"), F.col("item_id").alias("eval_id"), F.col("text").alias("prompt")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.turn_pairs(table(spark, sf_dir, "conversations"))


def NORM(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(replace(lower(nfc_normalize({x})), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def SHA(x: str) -> str:
    return f"sha256(replace({NORM(x)}, ' ', ''))"


def WORDS(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def GRAMS(n: str) -> str:
    return f"CASE WHEN length({n}) < 4 THEN [{n}] ELSE list_distinct(list_transform(range(1, length({n}) - 2), lambda i: substr({n}, i, 4))) END"


PAIRS = """pairs AS (SELECT conv_id || '|' || turn AS id, conv_id, turn, text AS prompt, response FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nr = 'assistant')"""
EVAL_GRAMS = f"eg AS (SELECT item_id, unnest(gs) AS g, len(gs) AS m FROM (SELECT item_id, {GRAMS('n')} AS gs FROM (SELECT item_id, {NORM('text')} AS n FROM benchmark)))"
DOC_GRAMS = f"dg AS (SELECT doc_id, unnest(gs) AS g, len(gs) AS n FROM (SELECT doc_id, {GRAMS('n')} AS gs FROM (SELECT doc_id, {NORM('text')} AS n FROM documents)))"
HITS = f"""WITH {EVAL_GRAMS}, {DOC_GRAMS},
 o AS (SELECT doc_id, item_id, any_value(n) AS n, any_value(m) AS m, count(*) AS b FROM dg JOIN eg USING (g) GROUP BY ALL),
 r AS (SELECT doc_id, item_id, b / (n + m - b) AS j, b / m AS ce, b / n AS cc FROM o),
 h AS (SELECT * FROM r WHERE j > 0.4 OR ce > 0.6 OR cc > 0.6),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS k FROM h)"""


# ---- scalar functions ------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length({NORM('text')})::BIGINT AS n_norm, {SHA('text')} AS sha FROM documents")
def norm_sha(spark, sf):
    n = text.norm(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.char_length(n).cast("bigint").alias("n_norm"), text.sha(n).alias("sha"))


@query(f"SELECT doc_id, len({WORDS('text')})::BIGINT AS n_words, 3 * len({WORDS('text')})::BIGINT AS n_tokens FROM documents")
def word_counts(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.word_count(c).cast("bigint").alias("n_words"), text.token_estimate(c).cast("bigint").alias("n_tokens"))


@query(f"SELECT doc_id, len({GRAMS('n')})::BIGINT AS n_grams, len({GRAMS('u')})::BIGINT AS n_unspaced FROM (SELECT doc_id, n, replace(n, ' ', '') AS u FROM (SELECT doc_id, {NORM('text')} AS n FROM documents))")
def char_ngrams_size(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.norm(F.col("text")).alias("n"))
    return contamination.gram_counts(d.select("doc_id", "n", F.replace("n", F.lit(" "), F.lit("")).alias("u")), "doc_id", {"n_grams": "n", "n_unspaced": "u"})


@query(r"""SELECT doc_id, coalesce(length(regexp_replace(text, '[^ሀ-፿]|[^\p{L}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 0.0) AS ethiopic,
  coalesce(length(regexp_replace(text, '[^\p{Latin}]|[^\p{L}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 0.0) AS latin FROM documents""")
def script_ratio(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", scripts.ethiopic_share(c).alias("ethiopic"), scripts.latin_share(c).alias("latin"))


@query(r"""SELECT doc_id, regexp_matches(regexp_replace(text, '[\p{Latin}\p{Ethiopic}]', '', 'g'), '\p{L}') OR regexp_matches(text, '[ªº]') AS foreign_script,
  len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[ሀ-᎟]') AND regexp_matches(lower(w), '[a-z]'))) > 0 AS mixed_word,
  len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '^[^\p{L}]*[ሀ-᎟][^\p{L}]*$') AND regexp_matches(w, '\p{Ethiopic}')))::BIGINT AS particles FROM documents""")
def script_flags(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", scripts.has_foreign_script(c).alias("foreign_script"), scripts.has_mixed_word(c).alias("mixed_word"), scripts.detached_particles(c).cast("bigint").alias("particles"))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '(?i)^\s*(?:ጥያቄ|ጽሑፍ|ምንባብ|መልስ|question|passage|text|answer)\s*[:፡]') AS label,
  regexp_matches(text, '(?im)\*\*|^\s*#{1,6}\s|```|^\s*(?:here is\b|here''s\b|sure\b|certainly\b|of course\b|translation\s*:)') AS preamble,
  regexp_matches(text, 'አልችልም|አልተሰጠም|ስላልተካተተ|ስላልተሰጠ|ስላልተገለጸ|ስላልተጠቀሰ') AS refusal,
  regexp_matches(text, '(?i)translate\b|ተርጉም|ተርጉሙ') AS translate FROM conversations""")
def leak_patterns(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", patterns.starts_with_label(c).alias("label"), patterns.has_preamble_or_markdown(c).alias("preamble"), patterns.is_refusal(c).alias("refusal"), patterns.asks_to_translate(c).alias("translate"))


@query(rf"""SELECT doc_id, regexp_replace(text, '[ \t\xa0]{{2,}}', ' ', 'g') AS cleaned, regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g') AS tag,
  CASE WHEN length(replace(text, chr(10), ' ⏎ ')) > 300 THEN substr(replace(text, chr(10), ' ⏎ '), 1, 300) || '...' ELSE replace(text, chr(10), ' ⏎ ') END AS clipped,
  coalesce(try_cast(regexp_extract(text, '[0-9]{{1,9}}') AS DOUBLE), 0.0) AS number FROM documents""")
def text_tools(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.clean_spaces(c).alias("cleaned"), text.tag(F.col("source")).alias("tag"), text.clip(c).alias("clipped"), text.to_number(F.regexp_extract(c, "[0-9]{1,9}", 0)).alias("number"))


# ---- contamination ---------------------------------------------------------------------------------------------


@query(f"SELECT doc_id AS id, max_by(item_id, item_id) AS eval_id FROM (SELECT doc_id, {SHA('text')} AS h FROM documents) JOIN (SELECT item_id, {SHA('text')} AS h FROM benchmark) USING (h) GROUP BY doc_id")
def eval_exact_dup(spark, sf):
    return contamination.exact_hits(prompts(spark, sf), evals(spark, sf))


@query(HITS + " SELECT doc_id AS id, item_id AS eval_index, j AS jaccard, ce AS eval_in_prompt, cc AS content_in_eval FROM f WHERE k = 1")
def eval_near_dup(spark, sf):
    return contamination.near_hits(prompts(spark, sf), evals(spark, sf), content_is_prompt=True).drop("eval_id")


@query(HITS + f""" SELECT count(DISTINCT doc_id) AS leaks FROM (SELECT doc_id FROM r WHERE j > 0.4 OR ce > 0.6
  UNION ALL SELECT doc_id FROM documents WHERE {SHA('text')} IN (SELECT {SHA('text')} FROM benchmark))""")
def leak_count(spark, sf):
    return contamination.leaks(prompts(spark, sf), evals(spark, sf)).agg(F.count("*").alias("leaks"))


@query(HITS + " SELECT lang, count(*) AS n, count(k) AS contaminated FROM documents LEFT JOIN (SELECT doc_id, k FROM f WHERE k = 1) USING (doc_id) GROUP BY lang")
def contamination_by_lang(spark, sf):
    hits = contamination.near_hits(prompts(spark, sf), evals(spark, sf), content_is_prompt=True).select("id", F.lit(1).alias("hit"))
    return prompts(spark, sf).select("id", F.col("task").alias("lang")).join(hits, "id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("hit").alias("contaminated"))


# ---- duplicates ------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id AS seq, min(doc_id) OVER (PARTITION BY {SHA('text')}) AS first_seq FROM documents")
def train_exact_dup(spark, sf):
    d = prompts(spark, sf).select("seq", text.sha(text.norm(F.col("content"))).alias("h"))
    return near_dup.first_of_each(d, "h")


PAIR_SQL = f"""WITH {DOC_GRAMS},
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS s FROM dg a JOIN dg b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY 1, 2)"""


@query(PAIR_SQL + " SELECT a, b, s / (na + nb - s) AS jaccard FROM o WHERE s / (na + nb - s) > 0.8")
def train_near_dup_pairs(spark, sf):
    return near_dup.similar_pairs(prompts(spark, sf).select("id", F.col("content").alias("text")), fold=text.norm)


KEPT_SQL = PAIR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
 l AS MATERIALIZED (SELECT b AS node, list(a) AS near FROM o WHERE s / (na + nb - s) > 0.8 GROUP BY b),
 nodes AS MATERIALIZED (SELECT doc_id, near, row_number() OVER (ORDER BY doc_id) AS i FROM documents LEFT JOIN l ON node = doc_id),
 walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, false AS kept, []::BIGINT[] AS held
  UNION ALL SELECT n.i, n.doc_id, NOT coalesce(list_has_any(w.held, n.near), false),
   CASE WHEN coalesce(list_has_any(w.held, n.near), false) THEN w.held ELSE list_append(w.held, n.doc_id) END FROM walk w JOIN nodes n ON n.i = w.i + 1)
 SELECT doc_id, kept FROM walk WHERE i > 0"""


@query(KEPT_SQL)
def train_near_dup_kept(spark, sf):
    d = prompts(spark, sf).select("seq", text.norm(F.col("content")).alias("n"))
    d = stored(d.select("seq", text.sha(F.col("n")).alias("h"), "n"), "near_dup_rows")
    like = near_dup.similar_pairs(d.groupBy("h").agg(F.min_by("n", "seq").alias("text")).select(F.col("h").alias("id"), "text"))
    kept = near_dup.greedy_keep(d.select(F.col("seq").alias("node"), F.lit(True).alias("may_keep")), d.select(F.col("seq").alias("node"), F.col("h").alias("key")), like)
    return kept.select(F.col("node").alias("doc_id"), "kept")


# ---- cascades --------------------------------------------------------------------------------------------------


LATIN_POLICY = cascade.PromptPolicy(share=scripts.latin_share)


def cascade_input(spark, sf):
    p = prompts(spark, sf)
    return p.select("seq", "id", "task", F.lit(None).cast("string").alias("direction"), F.lit(None).cast("int").alias("band"), "prompt", "content", F.lit(None).cast("string").alias("passage"), F.lit(None).cast("string").alias("source_text"), F.array("content").alias("parts"))


def cascade_scores(spark, sf):
    s = table(spark, sf, "labels")
    return s.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), (F.col("quality") * 3 + 2).cast("string").alias("natural"), F.lit("5").alias("answerable"))


CASCADE_SQL = HITS.replace("WITH ", "WITH RECURSIVE ", 1) + rf""",
 p2 AS (SELECT a.doc_id AS a, b.doc_id AS b FROM dg a JOIN dg b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.8),
 near AS MATERIALIZED (SELECT b AS doc_id, list(a) AS near FROM p2 GROUP BY b),
 loc AS (SELECT doc_id, {SHA('text')} AS sha, CASE
  WHEN coalesce(length(regexp_replace(text, '[^\p{{Latin}}]|[^\p{{L}}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0), 0.0) < 0.8 THEN 'script_mismatch'
  WHEN regexp_matches(regexp_replace(text, '[\p{{Latin}}\p{{Ethiopic}}]', '', 'g'), '\p{{L}}') OR regexp_matches(text, '[ªº]') THEN 'foreign_script'
  WHEN len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[ሀ-᎟]') AND regexp_matches(lower(w), '[a-z]'))) > 0 THEN 'mixed_script_word'
  WHEN len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '^[^\p{{L}}]*[ሀ-᎟][^\p{{L}}]*$') AND regexp_matches(w, '\p{{Ethiopic}}'))) >= 2 THEN 'detached_particles'
  WHEN regexp_matches(text, '(?i)^\s*(?:ጥያቄ|ጽሑፍ|ምንባብ|መልስ|question|passage|text|answer)\s*[:፡]') THEN 'label_in_content' END AS reason FROM documents),
 ex AS (SELECT doc_id, max(item_id) AS item FROM loc JOIN (SELECT item_id, {SHA('text')} AS sha FROM benchmark) USING (sha) GROUP BY doc_id),
 low AS (SELECT doc_id FROM labels WHERE quality * 3 + 2 < 4),
 live AS MATERIALIZED (SELECT l.doc_id, l.sha, n.near, row_number() OVER (ORDER BY l.doc_id) AS i,
   CASE WHEN f.item_id IS NOT NULL THEN 'near_dup_eval' WHEN w.doc_id IS NOT NULL THEN 'low_prompt_quality' END AS late
  FROM loc l LEFT JOIN ex USING (doc_id) LEFT JOIN near n USING (doc_id) LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (doc_id) LEFT JOIN low w USING (doc_id) WHERE l.reason IS NULL AND ex.item IS NULL),
 walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::VARCHAR AS reason, []::BIGINT[] AS held, []::VARCHAR[] AS shas
  UNION ALL SELECT i, doc_id, reason, CASE WHEN reason IS NULL THEN list_append(held, doc_id) ELSE held END, CASE WHEN reason IS NULL THEN list_append(shas, sha) ELSE shas END FROM (
   SELECT n.i, n.doc_id, n.sha, w.held, w.shas, CASE WHEN list_contains(w.shas, n.sha) THEN 'exact_duplicate_train' WHEN n.late IS NOT NULL THEN n.late WHEN list_has_any(w.held, n.near) THEN 'near_dup_train' END AS reason
   FROM walk w JOIN live n ON n.i = w.i + 1)),
 done AS (SELECT doc_id, coalesce(l.reason, CASE WHEN ex.item IS NOT NULL THEN 'exact_duplicate_eval' END, w.reason) AS reason, ex.item FROM loc l LEFT JOIN ex USING (doc_id) LEFT JOIN (SELECT doc_id, reason FROM walk WHERE i > 0) w USING (doc_id))"""


@query(CASCADE_SQL + """ SELECT doc_id AS id, d.reason, CASE d.reason WHEN 'exact_duplicate_eval' THEN d.item WHEN 'near_dup_eval' THEN f.item_id END AS eval_id,
  CASE WHEN d.reason = 'near_dup_eval' THEN f.j END AS jaccard, CASE WHEN d.reason = 'near_dup_eval' THEN f.ce END AS eval_in_prompt, CASE WHEN d.reason = 'near_dup_eval' THEN f.cc END AS content_in_eval, NULL::INT AS words
  FROM done d LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (doc_id)""")
def filter_cascade_reasons(spark, sf):
    out = cascade.prompt_cascade(cascade_input(spark, sf), evals(spark, sf), cascade_scores(spark, sf), LATIN_POLICY)
    return out.select("id", "reason", "eval_id", "jaccard", "eval_in_prompt", "content_in_eval", "words")


@query(CASCADE_SQL + " SELECT reason, count(*) AS n, min(doc_id) AS first_seq FROM done WHERE reason IS NOT NULL GROUP BY reason")
def drop_counts(spark, sf):
    out = cascade.prompt_cascade(cascade_input(spark, sf), evals(spark, sf), cascade_scores(spark, sf), LATIN_POLICY)
    return reports.reasons(out)


LOCAL_RULES = r"""SELECT doc_id AS id, CASE
  WHEN coalesce(length(regexp_replace(text, '[^\p{Latin}]|[^\p{L}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 0.0) < 0.8 THEN 'script_mismatch'
  WHEN regexp_matches(regexp_replace(text, '[\p{Latin}\p{Ethiopic}]', '', 'g'), '\p{L}') OR regexp_matches(text, '[ªº]') THEN 'foreign_script'
  WHEN regexp_matches(text, '(?i)^\s*(?:ጥያቄ|ጽሑፍ|ምንባብ|መልስ|question|passage|text|answer)\s*[:፡]') THEN 'label_in_content'
  WHEN len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) < 0.7 * 55 OR len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) > 1.6 * 260 THEN 'passage_length' END AS reason FROM documents"""


@query(LOCAL_RULES)
def prompt_rules_local(spark, sf):
    d = cascade_input(spark, sf).withColumn("task", F.lit("comprehension")).withColumn("passage", F.col("content"))
    return d.select("id", cascade.first_reason(cascade.prompt_rules(LATIN_POLICY)).alias("reason"))


@query("SELECT doc_id AS id, lang, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id) WHERE quality * 3 + 2 < 4")
def low_quality_scored(spark, sf):
    s = cascade.last_scores(cascade_scores(spark, sf), ("natural", "answerable")).filter(text.to_number(F.col("natural")) < cascade.LEAST_PROMPT_SCORE)
    q = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("quality"))
    return prompts(spark, sf).select("id", F.col("task").alias("lang")).join(s.select("id"), "id").join(q, "id")


def answer_rows(spark, sf):
    p = pairs(spark, sf)
    score = F.when(F.col("conv_id") % 5 != 0, F.struct((F.lit(3) + F.col("conv_id") % 3).cast("string").alias("fluency"), F.lit("5").alias("accuracy"), F.lit("5").alias("task")))
    return p.select("id", F.lit("knowledge").alias("task"), F.lit(None).cast("string").alias("direction"), "conv_id", "prompt", "response", score.alias("scores"))


@query(rf"""WITH {PAIRS} SELECT id, CASE WHEN conv_id % 11 = 0 THEN 'prompt_no_longer_clean' WHEN conv_id % 5 = 0 OR 3 + conv_id % 3 < 4 THEN 'low_or_missing_score'
  WHEN trim(response) = '' THEN 'empty'
  WHEN regexp_matches(response, '(?im)\*\*|^\s*#{{1,6}}\s|```|^\s*(?:here is\b|here''s\b|sure\b|certainly\b|of course\b|translation\s*:)') THEN 'markdown_or_preamble'
  WHEN coalesce(length(regexp_replace(response, '[^\p{{Latin}}]|[^\p{{L}}]', '', 'g')) / nullif(length(regexp_replace(response, '[^\p{{L}}]', '', 'g')), 0), 0.0) < 0.8 THEN 'script_mismatch'
  WHEN 3 * len({WORDS('response')}) > 200 THEN 'answer_too_long' END AS reason,
  3 * len({WORDS('response')})::BIGINT AS answer_tokens, 3 * len({WORDS('prompt')})::BIGINT AS prompt_tokens FROM pairs""")
def response_cascade(spark, sf):
    rows = answer_rows(spark, sf)
    out = cascade.answer_cascade(rows, rows.filter("conv_id % 11 <> 0"), gate=f"[{scripts.ETHIOPIC}]", share=scripts.latin_share)
    return out.select("id", "reason", F.col("answer_tokens").cast("bigint").alias("answer_tokens"), F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"))


BARE = r"""v AS (SELECT doc_id, w FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\s+')), '.,;:!?()"''«»፡።፣፤፥፦፧') AS w FROM documents) WHERE w <> ''), c AS (SELECT w, count(*) AS n FROM v GROUP BY w)"""


@query(f"WITH {BARE} SELECT w AS word, n FROM c ORDER BY n DESC, w LIMIT 100")
def vocab_topk(spark, sf):
    return vocabulary.word_counts(table(spark, sf, "documents")).orderBy(F.desc("n"), "word").limit(100)


@query(f"""WITH {BARE}, k AS (SELECT w, unnest(range(2, length(w) - 1)) AS k FROM c WHERE n <= 1 AND length(w) >= 5 AND regexp_matches(w, '\\p{{L}}')),
  g AS (SELECT DISTINCT k.w FROM k JOIN c a ON a.w = substr(k.w, 1, k.k) AND a.n >= 5 JOIN c b ON b.w = substr(k.w, k.k + 1) AND b.n >= 5)
  SELECT DISTINCT doc_id AS id FROM v JOIN g USING (w)""")
def glued_words(spark, sf):
    d = table(spark, sf, "documents")
    return vocabulary.own_glued_rows(d.select(F.col("doc_id").alias("id"), "text"), r"\p{L}")


# ---- sampling --------------------------------------------------------------------------------------------------


def keyed(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), "lang", "source", F.col("n_chars"))


@query("SELECT id, lang FROM (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS k FROM documents) WHERE k <= CASE WHEN lang = 'en' THEN 25 ELSE 50 END")
def quota_trim(spark, sf):
    return sampling.quota(keyed(spark, sf), ("lang",), F.when(F.col("lang") == "en", 25).otherwise(50)).select("id", "lang")


@query("""WITH a AS (SELECT doc_id AS id, lang, source, md5('42-' || doc_id) AS h FROM documents),
  b AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, id) AS r, min(h) OVER (PARTITION BY lang, source) AS p FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, p, id) AS k FROM b) SELECT id, lang, source FROM c WHERE k <= 60""")
def round_robin_bands(spark, sf):
    return sampling.round_robin(keyed(spark, sf), ("lang",), "source", F.lit(60)).select("id", "lang", "source")


@query("""WITH g AS (SELECT lang, min(doc_id) AS f FROM documents GROUP BY lang),
  a AS (SELECT doc_id AS id, lang, f, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS k FROM documents JOIN g USING (lang))
  SELECT id, lang FROM a WHERE k <= ceil(50 / (SELECT count(*) FROM g)) ORDER BY f, k LIMIT 50""")
def stratified_sample(spark, sf):
    return sampling.stratified(keyed(spark, sf), "lang", 50).select("id", "lang")


@query("SELECT doc_id AS id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) <= 100 THEN 'val' ELSE 'train' END AS fold FROM documents")
def val_split(spark, sf):
    return sampling.split(keyed(spark, sf), 100).select("id", "fold")


@query("SELECT item_id AS eval_id, CASE WHEN s THEN 'distilled' ELSE 'base' END AS A_is, CASE WHEN s THEN 'base' ELSE 'distilled' END AS B_is FROM (SELECT item_id, ('0x' || substr(md5('11-' || item_id), 1, 1))::INT % 2 = 1 AS s FROM benchmark)")
def blind_ab(spark, sf):
    return sampling.blind(table(spark, sf, "benchmark").select(F.col("item_id").alias("eval_id")))


@query("SELECT id, lang FROM (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def first_k(spark, sf):
    return sampling.first_k(keyed(spark, sf), ("lang",), 5).select("id", "lang")


@query("SELECT doc_id AS id, lang, (k - 1) // 8 AS batch_id, (k - 1) % 8 AS i FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents)")
def micro_batches(spark, sf):
    return sampling.batches(keyed(spark, sf), 8, ("lang",)).select("id", "lang", "batch_id", F.col("i").cast("bigint").alias("i"))


@query("""WITH a AS (SELECT doc_id AS id, n_chars, (row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) - 1) // 64 AS c FROM documents),
  b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n_chars, id) - 1 AS r FROM a),
  d AS (SELECT c, b, row_number() OVER (ORDER BY md5('43-' || c || '-' || b)) - 1 AS batch_id FROM (SELECT DISTINCT c, r // 4 AS b FROM b))
  SELECT id, batch_id, r % 4 AS i FROM b JOIN d ON b.c = d.c AND r // 4 = d.b""")
def length_batches(spark, sf):
    return sampling.length_batches(keyed(spark, sf), 4, "n_chars").select("id", F.col("batch_id").cast("bigint").alias("batch_id"), F.col("i").cast("bigint").alias("i"))


# ---- aggregates ------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT lang, len({WORDS('text')}) AS n FROM documents), r AS (SELECT lang, list_sort(list(n)) AS v FROM w GROUP BY lang)
  SELECT lang, v[1]::BIGINT AS low, v[len(v)]::BIGINT AS high, v[least(len(v) - 1, floor(0.5 * len(v))::BIGINT) + 1]::BIGINT AS p50, v[least(len(v) - 1, floor(0.95 * len(v))::BIGINT) + 1]::BIGINT AS p95 FROM r""")
def length_stats_nearest_rank(spark, sf):
    d = table(spark, sf, "documents").select("lang", text.word_count(F.col("text")).cast("bigint").alias("n"))
    return d.groupBy("lang").agg(F.min("n").alias("low"), F.max("n").alias("high")).join(metrics.nearest_ranks(d, ("lang",), "n", {"p50": 50, "p95": 95}), "lang")


@query(f"SELECT lang, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, avg(n) AS mean FROM (SELECT lang, len({WORDS('text')})::DOUBLE AS n FROM documents) GROUP BY lang")
def length_stats_linear(spark, sf):
    d = table(spark, sf, "documents").select("lang", text.word_count(F.col("text")).cast("double").alias("n"))
    return d.groupBy("lang").agg(F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"), F.avg("n").alias("mean"))


@query("SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS n, count(quality) AS scored FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def kept_by_group_rollup(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.count("quality").alias("scored")).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n", "scored")


# Seconds are whole thousandths here: sums of integers are the same in any order.
@query("""SELECT event_type AS label, avg(ms) AS sec_per_answer_mean, quantile_cont(ms, 0.5) AS sec_per_answer_median, sum(n) / sum(ms) AS tokens_per_sec,
  sum(n)::BIGINT AS total_new_tokens, count(*) FILTER (WHERE n >= 256) AS n_hit_256 FROM (SELECT event_type, floor(value * 1000)::BIGINT AS ms, event_id % 300 AS n FROM events) GROUP BY event_type""")
def run_stats(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.floor(F.col("value") * 1000).alias("seconds"), (F.col("event_id") % 300).alias("new_tokens"))
    return metrics.run_stats(e, ("label",))


@query(f"SELECT lang, sum(3.0 * n) / sum(n) AS tokens_per_word, sum(3.0 * n) / sum(length(text)) AS tokens_per_char, sum(n_chars::DOUBLE * n) / sum(n) AS weighted FROM (SELECT lang, text, n_chars, len({WORDS('text')}) AS n FROM documents) GROUP BY lang")
def fertility_and_weighted_mean(spark, sf):
    d = table(spark, sf, "documents")
    n = text.word_count(F.col("text"))
    a = metrics.fertility(d, ("lang",), text.token_estimate(F.col("text")).cast("double"))
    return a.join(d.groupBy("lang").agg(metrics.weighted_mean(F.col("n_chars").cast("double"), n).alias("weighted")), "lang")


@query("SELECT count(*) AS n, sha256(string_agg(text, chr(0) ORDER BY item_id)) AS sha256 FROM benchmark")
def eval_digest(spark, sf):
    return reports.digest(evals(spark, sf), "eval_index", "prompt")


LOOPS = r"""w AS (SELECT conv_id, turn, role, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations),
  t AS (SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS bi,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS adj FROM w)"""


@query(f"""WITH {LOOPS} SELECT role, count(*) AS n, 100 * avg(CASE WHEN len(ws) < 12 THEN 0 WHEN 1 - len(list_distinct(tri)) / len(tri) > 0.3 THEN 1 ELSE 0 END) AS looping,
  100 * avg((adj > 0 OR len(bi) <> len(list_distinct(bi)))::INT) AS repeating, 100 * avg(regexp_matches(right(text, 250), '[•▪]\\s*\\S')::INT) AS bullets FROM t GROUP BY role""")
def repetition_rates(spark, sf):
    c = F.col("text")
    p = metrics.percent
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), p(repetition.is_looping(c)).alias("looping"), p(repetition.repeats(c)).alias("repeating"), p(patterns.has_bullet_tail(c)).alias("bullets"))


@query(f"""WITH {PAIRS}, n AS (SELECT id, {NORM('prompt')} AS p, {NORM('response')} AS r FROM pairs), u AS (SELECT *, replace(p, ' ', '') AS pu, replace(r, ' ', '') AS ru, list_filter(string_split(r, ' '), lambda x: x <> '') AS ws FROM n),
  g AS (SELECT *, {GRAMS('pu')} AS pg, {GRAMS('ru')} AS rg FROM u)
  SELECT id, len(list_intersect(rg, pg)) / len(rg) AS copied, len(ws) >= 5 AND contains(p, array_to_string(ws[1:5], ' ')) AS restated FROM g""")
def copy_and_restate(spark, sf):
    return pairs(spark, sf).select("id", repetition.copy_share(F.col("response"), F.col("prompt")).alias("copied"), repetition.restates(F.col("response"), F.col("prompt")).alias("restated"))


@query("""SELECT lang, least(1.0, 2 * sum(factorial((w + l)::INT) // (factorial(i::INT) * factorial((w + l - i)::INT)))::DOUBLE / pow(2, any_value(w + l))) AS p
  FROM (SELECT lang, w, l, unnest(range(0, least(w, l) + 1)) AS i FROM (
  SELECT lang, count(*) FILTER (WHERE doc_id % 40 = 1) AS w, count(*) FILTER (WHERE doc_id % 40 = 2) AS l FROM documents GROUP BY lang)) GROUP BY lang""")
def sign_tests(spark, sf):
    d = table(spark, sf, "documents")
    counts = d.groupBy("lang").agg(F.count_if(F.col("doc_id") % 40 == 1).alias("w"), F.count_if(F.col("doc_id") % 40 == 2).alias("l"))
    return counts.select("lang", numbers.sign_tests(F.col("w"), F.col("l")).alias("p"))


@query(rf"""WITH {PAIRS}, w AS (SELECT prompt, response AS text, list_filter(string_split_regex(response, '\s+'), lambda x: x <> '') AS ws, {NORM('prompt')} AS p, {NORM('response')} AS r FROM pairs),
  t AS (SELECT *, replace(p, ' ', '') AS pu, replace(r, ' ', '') AS ru, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS bi,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS adj, coalesce(length(regexp_replace(text, '[^ሀ-፿]|[^\p{{L}}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0), 0.0) AS ethiopic FROM w)
  SELECT 'chat' AS task, count(*) AS n, 100 * avg((ethiopic <= 0.1 AND regexp_matches(text, '[A-Za-z]'))::INT) AS right_script_pct, 100 * avg((trim(text) = '')::INT) AS empty_pct,
    100 * avg(CASE WHEN len(ws) < 12 THEN 0 WHEN 1 - len(list_distinct(tri)) / len(tri) > 0.3 THEN 1 ELSE 0 END) AS looping_pct, 100 * avg((adj > 0 OR len(bi) <> len(list_distinct(bi)))::INT) AS repeat_loose_pct,
    100 * avg((3 * len(ws) >= 256)::INT) AS hit_256_pct, avg(3 * len(ws)) AS mean_new_tokens FROM t""")
def generation_metrics(spark, sf):
    rows = pairs(spark, sf).select(F.lit("chat").alias("task"), F.col("response").alias("text"), F.lit("am->en").alias("direction"), text.token_estimate(F.col("response")).alias("new_tokens"))
    return metrics.generation_metrics(rows, ("task",))


@query()
def chrf_corpus(spark, sf):
    rows = pairs(spark, sf).select("id", (F.col("conv_id") % 4).alias("task"), F.col("response").alias("text"), F.col("prompt").alias("teacher"))
    return metrics.chrf(rows, ("task",))


# ---- joins, exports, ratings ------------------------------------------------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return joins.not_done(keyed(spark, sf).select("id"), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AS clean FROM documents")
def clean_semi(spark, sf):
    return joins.with_membership(keyed(spark, sf).select("id"), table(spark, sf, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id")))


@query("SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def score_last_wins(spark, sf):
    return joins.last_by(table(spark, sf, "conversations"), "conv_id", "turn", ["turn", "role", "text"])


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'new ' || item_id ELSE text END AS text FROM benchmark")
def teacher_update(spark, sf):
    b = table(spark, sf, "benchmark")
    return joins.updated(b, b.filter("item_id % 3 = 0").select("item_id", F.concat(F.lit("new "), F.col("item_id")).alias("text")), "item_id", "text")


@query("SELECT item_id AS eval_id, text AS base_output, reverse(text) AS distilled_output, item_id % 7 AS base_new_tokens FROM benchmark")
def predictions_fill(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("eval_id"), "text", F.lit(0.5).alias("seconds"), (F.col("item_id") % 7).alias("new_tokens"))
    template = b.select("eval_id", F.lit("").alias("base_output"), F.lit("").alias("distilled_output"), F.lit(None).cast("bigint").alias("base_new_tokens"))
    return joins.filled_predictions(template, b, b.withColumn("text", F.reverse("text")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE upper(text) = text) AS identical FROM benchmark")
def identical_outputs(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("eval_id"), "text")
    return joins.same_text(b, b.withColumn("text", F.upper("text")))


@query(f"WITH {PAIRS} SELECT id, prompt AS user_content, response AS assistant_content, conv_id FROM pairs")
def chat_format(spark, sf):
    out = sinks.chat_format(pairs(spark, sf), ("id", "conv_id"))
    return out.select("meta.id", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"), "meta.conv_id")


@query(f"WITH {PAIRS} SELECT prompt, response AS teacher_response, 'closed_book_knowledge' AS task, 'synthetic|prompts:writer|answers:teacher' AS source FROM pairs")
def submission_csv(spark, sf):
    return sinks.submission(answer_rows(spark, sf).withColumn("prompt_writer", F.lit("writer")).withColumn("teacher", F.lit("teacher")))


RATED = "SELECT c_custkey AS eval_id, c_mktsegment AS task, 1 + c_custkey % 5 AS fb, 1 + c_nationkey % 5 AS fd, 1 + (c_custkey // 3) % 5 AS cb, 1 + (c_nationkey * 7 + c_custkey) % 5 AS cd FROM customer"


@query(f"""SELECT coalesce(task, 'OVERALL') AS task, count(*) AS n, avg(fb) AS fluency_base, avg(fd) AS fluency_distilled, avg(cb) AS correct_base, avg(cd) AS correct_distilled,
  count(*) FILTER (WHERE cd > cb) AS wins_distilled, count(*) FILTER (WHERE cd = cb) AS ties, count(*) FILTER (WHERE cd < cb) AS wins_base FROM ({RATED}) GROUP BY ROLLUP (task)""")
def rating_summary(spark, sf):
    c = table(spark, sf, "customer")
    key = sampling.blind(c.select(F.col("c_custkey").alias("eval_id")))
    own = c.select(F.col("c_custkey").alias("eval_id"), (1 + F.col("c_custkey") % 5).alias("fb"), (1 + F.col("c_nationkey") % 5).alias("fd"), (1 + F.floor(F.col("c_custkey") / 3) % 5).alias("cb"), (1 + (F.col("c_nationkey") * 7 + F.col("c_custkey")) % 5).alias("cd")).join(key, "eval_id")
    pick = lambda side, m: F.when(F.col(f"{side}_is") == "base", F.col(f"{m}b")).otherwise(F.col(f"{m}d"))
    given = own.select("eval_id", *(pick(side, m[0]).alias(f"{m}_{side}") for m in ("fluency", "correct") for side in "AB"))
    return ratings.summary(ratings.by_model(ratings.complete(given), key, c.select(F.col("c_custkey").alias("eval_id"), F.col("c_mktsegment").alias("task"))))


@query("""WITH t AS (SELECT * FROM (VALUES ('knowledge', 60, 10, NULL, 0), ('comprehension', 833, 3, 4, 1), ('translation', 75, 8, NULL, 2), ('summarisation', 833, 3, 4, 3)) x(task, jobs, n, bands, o)),
  j AS (SELECT task, n, bands, unnest(range(0, CASE WHEN bands IS NULL THEN jobs ELSE jobs + 1 END)) AS i FROM t)
  SELECT task || '|' || i AS id, task, n::BIGINT AS n, i::BIGINT AS i, (i + i // 42) % 42 AS topic, (i % bands)::BIGINT AS band, CASE WHEN task = 'translation' THEN CASE WHEN i % 2 = 0 THEN 'EN2AM' ELSE 'AM2EN' END END AS direction FROM j""")
def writer_jobs(spark, sf):
    out = jobs.writer_jobs(spark)
    topics = [s for subs in jobs.DOMAINS.values() for s in subs]
    return out.select("id", "task", F.col("n").cast("bigint").alias("n"), F.col("i").cast("bigint").alias("i"), (F.array_position(F.array(*map(F.lit, topics)), F.col("sub")) - 1).alias("topic"), F.col("band").cast("bigint").alias("band"), "direction")


def SQL_LIST(texts: list[str]) -> str:
    quoted = [t.replace("'", "''") for t in texts]
    return "['" + "', '".join(quoted) + "']"


def COIN(label: str) -> str:
    return f"(('0x' || substr(md5('{jobs.SEED}-{label}-' || id), 1, 8))::BIGINT / 4294967296.0)"


@query(rf"""WITH {PAIRS}, c AS (SELECT id, regexp_replace(regexp_replace(response, '^\s+|\s+$', '', 'g'), '[ \t\xa0]{{2,}}', ' ', 'g') AS p, regexp_replace(regexp_replace(prompt, '^\s+|\s+$', '', 'g'), '[ \t\xa0]{{2,}}', ' ', 'g') AS q FROM pairs),
  d AS (SELECT *, {COIN('layout')} < {jobs.CONTEXT_SHARE['comprehension']} AS ctx, floor({COIN('wording')} * {len(jobs.INSTRUCTIONS['comprehension'])})::INT AS ki, floor({COIN('wording')} * {len(jobs.LAYOUTS['comprehension'])})::INT AS kl FROM c WHERE p <> '' AND q <> '')
  SELECT id, CASE WHEN ctx THEN {SQL_LIST(jobs.INSTRUCTIONS['comprehension'])}[ki + 1] || chr(10) || chr(10) || 'Context:' || chr(10) || p || chr(10) || chr(10) || q
    ELSE replace(replace({SQL_LIST(jobs.LAYOUTS['comprehension'])}[kl + 1], '{{q}}', q), '{{p}}', p) END AS prompt, 'comprehension-' || CASE WHEN ctx THEN 'ctx' || ki ELSE kl::VARCHAR END AS template_id FROM d""")
def rendered_prompts(spark, sf):
    rows = pairs(spark, sf).select("id", F.lit("comprehension").alias("task"), F.lit(None).cast("string").alias("direction"), F.struct(F.col("response").alias("passage"), F.col("prompt").alias("question"), F.lit(None).cast("string").alias("text")).alias("content"))
    return jobs.rendered(jobs.usable_content(rows, {"comprehension": ("passage", "question")})).select("id", "prompt", "template_id")


@query("SELECT doc_id AS n, doc_id + 1 AS row_number FROM (SELECT doc_id FROM documents)")
def file_order_numbers(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("n")).repartitionByRange(4, "n").sortWithinPartitions("n")
    return readers.numbered(d, "row_number")


@query("""SELECT conv_id, turn, '[{"conv_id": ' || conv_id || ', "role": ' || to_json(role) || ', "text": ' || to_json(text) || ', "turn": ' || turn || '}]' AS parsed FROM conversations""")
def parse_json_tolerant(spark, sf):
    wrapped = F.concat(F.lit("Here you are:\n```json\n["), F.to_json(F.struct("conv_id", "turn", "role", "text")), F.lit("]\n```"))
    return table(spark, sf, "conversations").select("conv_id", "turn", json_tools.parse_tolerant(wrapped).alias("parsed"))


@query(f"""WITH {PAIRS}, r AS (SELECT id, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS k FROM pairs WHERE (conv_id * 1000 + turn) % 7 <> 0)
  SELECT id, k // {backends.ANSWER_BATCH} AS batch_id, (k % {backends.ANSWER_BATCH})::INT AS i, 4.0::DOUBLE AS fluency, 5.0::DOUBLE AS accuracy, 5.0::DOUBLE AS task, 'stub:echo' AS judge FROM r""")
def judged_answers(spark, sf):
    rows = pairs(spark, sf).withColumn("seq", F.col("conv_id") * 1000 + F.col("turn")).withColumn("body", F.concat(F.lit("PROMPT: "), "prompt", F.lit("\nRESPONSE: "), "response")).select("seq", "id", "body")
    done = rows.filter("seq % 7 = 0").select("id")
    return backends.judged(rows, done, backends.StubBackend(), "body", ("fluency", "accuracy", "task"), backends.ANSWER_BATCH).select("id", "batch_id", "i", "fluency", "accuracy", "task", "judge")


@query(f"WITH {PAIRS} SELECT id, 'answer ' || substr(md5(prompt), 1, 8) AS response, 'stub:echo' AS teacher FROM pairs WHERE (conv_id * 1000 + turn) % 5 <> 0")
def stub_answers(spark, sf):
    p = pairs(spark, sf).withColumn("seq", F.col("conv_id") * 1000 + F.col("turn")).withColumn("task", (F.col("conv_id") % 4).cast("string")).select("seq", "id", "task", "prompt")
    return backends.answers(p, p.filter("seq % 5 = 0").select("id"), backends.StubBackend()).select("id", "response", "teacher")


@query("SELECT word, count(*) AS n FROM (SELECT trim(unnest(string_split_regex(text, '\\s+')), '.,;:!?()\"''«»፡።፣፤፥፦፧') AS word FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)) WHERE word <> '' GROUP BY word")
def union_vocab(spark, sf):
    both = table(spark, sf, "conversations").select("text").union(table(spark, sf, "benchmark").select("text"))
    return vocabulary.word_counts(both)


# ---- reports and the writer stage ---------------------------------------------------------------------------------


@query(rf"""WITH w AS (SELECT lang, len({WORDS('text')}) AS n FROM documents), r AS (SELECT lang, list_sort(list(n)) AS v FROM w GROUP BY lang)
  SELECT lang, len(v)::BIGINT AS n, v[1]::BIGINT AS prompt_min, v[least(len(v) - 1, floor(0.5 * len(v))::BIGINT) + 1]::BIGINT AS prompt_median, v[len(v)]::BIGINT AS prompt_max FROM r""")
def length_report(spark, sf):
    return reports.length_report(table(spark, sf, "documents").select("lang", "text"), "lang", {"prompt": F.col("text")})


@query(r"""SELECT lang, avg(floor(1000000 * coalesce(length(regexp_replace(text, '[^\p{Latin}]|[^\p{L}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 0.0))::BIGINT) AS latin FROM documents GROUP BY lang""")
def mean_script_share(spark, sf):
    # In millionths: sums of integers are the same in any order.
    return metrics.mean_shares(table(spark, sf, "documents"), ("lang",), {"latin": F.floor(1000000 * scripts.latin_share(F.col("text")))})


@query("""WITH t AS (SELECT * FROM (VALUES ('knowledge', 60, 10), ('comprehension', 834, 3), ('translation', 75, 8), ('summarisation', 834, 3)) x(task, jobs, n)),
  j AS (SELECT task, n, unnest(range(0, jobs)) AS i FROM t), k AS (SELECT task, i, unnest(range(0, n)) AS k FROM j)
  SELECT task || '|' || i || '#' || k AS id, task, 'stub:writer' AS prompt_writer FROM k WHERE i % 5 <> 0""")
def written_prompts(spark, sf):
    todo = jobs.writer_jobs(spark)
    found = prompt_writer.answered(todo, todo.filter("i % 5 = 0").select("id"), prompt_writer.StubWriter())
    return prompt_writer.prompt_rows(found, prompt_writer.StubWriter.name).select("id", "task", "prompt_writer")


# ---- files: written, read back and held against the tables ---------------------------------------------------------


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(spark, sf):
    d, path = table(spark, sf, "documents").select("doc_id", "text", "lang"), shared_path(spark, "jsonl")
    sinks.replace(d.limit(0), path)
    sinks.replace(d, path)
    return readers.read_jsonl(spark, path, d.schema)


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents")
def csv_round_trip(spark, sf):
    path = shared_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "text", "source"), path)
    return readers.read_csv(spark, path)


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id")
def appended_rows(spark, sf):
    path = shared_path(spark, "append")
    for name in ("documents", "labels"):
        sinks.append(table(spark, sf, name).select("doc_id"), path)
    return readers.read_jsonl(spark, path, "doc_id bigint").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT row_number() OVER (ORDER BY item_id) - 1 AS eval_index, 'E' || lpad(row_number() OVER (ORDER BY item_id)::VARCHAR, greatest(2, length(row_number() OVER (ORDER BY item_id)::VARCHAR))::INT, '0') AS eval_id,
  trim(text) AS prompt FROM benchmark""")
def eval_csv_rows(spark, sf):
    path = shared_path(spark, "eval")
    sinks.write_csv(table(spark, sf, "benchmark").orderBy("item_id").coalesce(1).select(F.col("text").alias(" Prompt ")), path)
    return readers.read_eval_csv(spark, path).select("eval_index", "eval_id", "prompt")


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS eval_index, trim(text) AS prompt FROM benchmark")
def eval_text_rows(spark, sf):
    path = shared_path(spark, "eval_text")
    held = table(spark, sf, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("rows"))
    held.select(F.array_join(F.transform("rows", lambda r: r["text"]), "\n-----\n")).write.text(path)
    rows = readers.read_eval_text(spark, f"{path}/part-*")
    return rows.select(F.col("eval_index").cast("bigint").alias("eval_index"), "prompt")


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_list_resume(spark, sf):
    path = shared_path(spark, "ids")
    table(spark, sf, "labels").select(F.col("doc_id").cast("string")).write.text(path)
    return joins.not_done(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")), readers.read_ids(spark, path))


@query("SELECT item_id AS eval_id, text, (item_id % 9)::BIGINT AS new_tokens FROM benchmark")
def nested_results(spark, sf):
    path = shared_path(spark, "results")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("eval_id"), "text", (F.col("item_id") % 9).alias("new_tokens"))
    rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("results")))).write.text(path)
    return readers.read_results(spark, f"{path}/part-*").select("eval_id", "text", "new_tokens")


@query(rf"""WITH {PAIRS} SELECT id, 'knowledge' AS task, '' AS direction, prompt, response AS teacher_response, 3 * len({WORDS('response')})::BIGINT AS answer_tokens, 'null' AS judge_scores FROM pairs WHERE conv_id % 5 = 0""")
def full_table(spark, sf):
    rows = answer_rows(spark, sf).filter("conv_id % 5 = 0")
    for c in ("domain", "subtopic", "template_id", "teacher", "prompt_writer"):
        rows = rows.withColumn(c, F.lit(c))
    rows = rows.withColumn("prompt_tokens", text.token_estimate(F.col("prompt"))).withColumn("answer_tokens", text.token_estimate(F.col("response")).cast("bigint"))
    return sinks.full_table(rows).select("id", "task", "direction", "prompt", "teacher_response", "answer_tokens", "judge_scores")


@query(f"WITH {PAIRS} SELECT id, prompt, response, '' AS verdict, '' AS remark FROM pairs")
def review_sheet(spark, sf):
    return sinks.review_sheet(pairs(spark, sf), ["id", "prompt", "response"], ["verdict", "remark"])
