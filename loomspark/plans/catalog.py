"""Registered queries: each applies library operators to whole tables, beside the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import quality as Q
from loomspark.functions import rewards as R
from loomspark.functions import text as X
from loomspark.operators import cases, curriculum, dedup, mining, prm, ranking, repair, retrieval, sampling, stats, templates, verify
from loomspark.operators.posting_index import PostingIndex
from loomspark.operators.resampling import flipped_sql, replicates_sql
from loomspark.plans import views as V
from loomspark.sources.work import Work

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def nine(*names: str) -> dict:
    return {n: F.round(n, 9) for n in names}


# --- dedup, splits, sampling ------------------------------------------------------------

FIRST_SQL = f"""firsts AS (SELECT doc_id, source, lang, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM
  (SELECT *, sha256({V.normal_sql('text')} || '||' || {V.normal_sql('source')}) AS key FROM documents)) WHERE rn = 1)"""


@query(f"WITH {FIRST_SQL} SELECT doc_id, source, key FROM firsts")
def dedup_normalized_keep_first(spark, d):
    docs = V.read(spark, d, "documents").withColumn("key", dedup.prompt_answer_key("text", "source"))
    return dedup.keep_first(docs.select("doc_id", "source", "key"), F.col("key"), "doc_id")


SPLIT_SQL = f"CASE WHEN {V.hash8_sql('source || \'||\' || text || \'||\' || doc_id')} % 1000 < 100 THEN 'holdout' WHEN {V.hash8_sql('source || \'||\' || text || \'||\' || doc_id')} % 1000 < 150 THEN 'val' ELSE 'train' END"


def split_documents(spark, d):
    key = F.concat_ws("||", "source", "text", F.col("doc_id").cast("string"))
    return V.read(spark, d, "documents").select("doc_id", "source", "text", sampling.hash_split(key).alias("split"))


@query(f"SELECT doc_id, {SPLIT_SQL} AS split FROM documents")
def hash_split_assign(spark, d):
    return split_documents(spark, d).select("doc_id", "split")


@query(f"WITH {FIRST_SQL} SELECT f.source, s.split, count(*) AS n FROM firsts f JOIN (SELECT doc_id, {SPLIT_SQL} AS split FROM documents) s USING (doc_id) GROUP BY ALL")
def hash_split_counts(spark, d):
    docs = V.read(spark, d, "documents").withColumn("key", dedup.prompt_answer_key("text", "source"))
    first = dedup.keep_first(docs, F.col("key"), "doc_id")
    key = F.concat_ws("||", "source", "text", F.col("doc_id").cast("string"))
    return first.withColumn("split", sampling.hash_split(key)).groupBy("source", "split").agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT sha256(lower({V.strip_sql('source')}) || '||' || {V.strip_sql('text')}) AS key, {SPLIT_SQL} AS split FROM documents),
o AS (SELECT key, count(DISTINCT split) AS n_splits FROM k GROUP BY key HAVING count(DISTINCT split) > 1) SELECT count(*) AS n_overlapping, coalesce(sum(n_splits), 0)::bigint AS n_places FROM o""")
def split_disjointness(spark, d):
    key = F.sha2(F.concat_ws("||", F.lower(X.strip("source")), X.strip("text")).cast("binary"), 256)
    return sampling.overlapping_keys(split_documents(spark, d), key).agg(F.count("*").alias("n_overlapping"), F.coalesce(F.sum("n_splits"), F.lit(0)).alias("n_places"))


@query(f"""SELECT conv_id, turn, {V.hash8_sql("'||' || text || '||||' || role || '||'")} / 4294967295::double < 0.7 AS deep FROM conversations""")
def reasoning_mode_bernoulli(spark, d):
    c = V.read(spark, d, "conversations").withColumnsRenamed({"text": "prompt", "role": "query"})
    return c.select("conv_id", "turn", X.reasoning_mode(c).alias("deep"))


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {V.shuffle_sql('doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 20")
def source_cap(spark, d):
    return sampling.cap_per_key(V.read(spark, d, "documents").select("doc_id", "source"), "source", 20, "doc_id")


CATEGORY = "CASE cast(substr(source, 4) AS int) % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'repo' ELSE 'reasoning' END"


def categorised(spark, d):
    number = F.substring("source", 4, 10).cast("int") % 3
    return V.read(spark, d, "documents").select("doc_id", F.when(number == 0, "code").when(number == 1, "repo").otherwise("reasoning").alias("category"))


@query(f"SELECT doc_id, {CATEGORY} AS category FROM documents")
def category_mix(spark, d):
    return sampling.mix_by_category(categorised(spark, d), "category", sampling.parse_weights(""), "doc_id")


@query(f"""WITH c AS (SELECT doc_id, {CATEGORY} AS category FROM documents), n AS (SELECT category, count(*) AS n, (SELECT count(*) // 4 FROM c) AS goal FROM c GROUP BY category),
q AS (SELECT category, n, goal, floor(goal * CASE category WHEN 'code' THEN 0.55 WHEN 'repo' THEN 0.30 ELSE 0.15 END)::int AS quota FROM n),
l AS (SELECT *, goal - sum(quota) OVER () AS left_over, row_number() OVER (ORDER BY category) AS place FROM q)
SELECT doc_id, category FROM (SELECT c.*, row_number() OVER (PARTITION BY category ORDER BY {V.shuffle_sql('doc_id')}, doc_id) AS rn FROM c) JOIN l USING (category)
WHERE rn <= quota + CASE WHEN place <= left_over THEN 1 ELSE 0 END""")
def category_mix_budget(spark, d):
    rows = categorised(spark, d)
    return sampling.mix_by_category(rows, "category", sampling.parse_weights("code:0.55,repo:0.30,reasoning:0.15"), "doc_id", budget=rows.count() // 4)


@query("SELECT doc_id, source, unnest(range(0, CASE WHEN p THEN 1 + (extra // n) + CASE WHEN rk <= extra % n THEN 1 ELSE 0 END ELSE 1 END))::int AS copy FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY sha256('3407|' || doc_id), doc_id) AS rk, round_even(1.5 * n, 0)::bigint AS extra FROM (SELECT doc_id, source, source IN ('src1', 'src2') AS p, count(*) FILTER (source IN ('src1', 'src2')) OVER () AS n FROM documents))")
def priority_upsample(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", "source")
    return sampling.upsample(docs, F.col("source").isin("src1", "src2"), 2.5, "doc_id").select("doc_id", "source", F.col("copy").cast("int"))


# --- corpus records ---------------------------------------------------------------------

@query(f"WITH {V.CORPUS} SELECT row_idx, text, substr(text, 1, strpos(text, '<|im_start|>assistant') + 21) AS prompt_part FROM corpus")
def template_chat_record(spark, d):
    return V.corpus(spark, d).select("row_idx", "text", X.prompt_prefix("text").alias("prompt_part"))


@query(f"SELECT doc_id, CASE WHEN length({V.strip_sql('text')}) > 200 THEN regexp_replace(substr({V.strip_sql('text')}, 1, 200), '\\s+$', '') || chr(10) || '...[truncated]' ELSE {V.strip_sql('text')} END AS short FROM documents")
def truncate_text(spark, d):
    return V.read(spark, d, "documents").select("doc_id", X.truncated("text", 200).alias("short"))


@query(f"WITH {V.CORPUS} SELECT row_idx, {V.strip_sql('answer')} AS answer, {V.strip_sql('answer')} AS by_tag FROM corpus WHERE {V.strip_sql('prompt')} <> ''")
def answer_extract(spark, d):
    c = V.corpus(spark, d).where(X.not_blank("prompt") & F.contains("text", F.lit("<answer>")) & F.contains("text", F.lit("</answer>")))
    return c.select("row_idx", X.answer_of("text").alias("answer"), X.tag_content("text", "answer").alias("by_tag"))


PATCHES = ["diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b", "--- a\n+++ b\n@@\n", "x\n@@ -1 @@\n+y", "no patch", "DIFF --GIT only", ""]


def patch_rows(spark, d):
    """One of a few literal patches, with a document's whole text after every second one."""
    texts = F.array(*[F.lit(p) for p in PATCHES])
    return V.read(spark, d, "documents").select("doc_id", F.concat(F.element_at(texts, (F.col("doc_id") % len(PATCHES) + 1).cast("int")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n"), F.col("text"))).otherwise("")).alias("patch"))


PATCH_SQL = "p AS (SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '" + p.replace("\n", "' || chr(10) || '") + "'" for i, p in enumerate(PATCHES)) + " END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || text ELSE '' END AS patch FROM documents)"


@query(f"""WITH {PATCH_SQL}, s AS (SELECT doc_id, {V.strip_sql('patch')} AS a, lower({V.strip_sql('patch')}) AS low FROM p),
f AS (SELECT *, a <> '' AND (contains(low, 'diff --git') OR (contains(a, chr(10) || '@@') AND (contains(a, chr(10) || '+') OR contains(a, chr(10) || '-'))) OR starts_with(low, '--- ')) AS is_patch FROM s)
SELECT doc_id, is_patch, is_patch AND (contains(low, 'diff --git') OR (contains(a, '--- ') AND contains(a, '+++ '))) AND contains(a, '@@') AS is_parseable,
round(CASE WHEN a = '' THEN -2.0 ELSE contains(low, 'diff --git')::int + 0.6 * contains(a, '@@')::int + 0.4 * (contains(a, chr(10) || '+') OR contains(a, chr(10) || '-'))::int + 0.2 * contains(low, 'index ')::int - 0.8 * (length(a) < 40)::int - 0.6 * (length(a) > 12000)::int END, 9)::double AS quality FROM f""")
def patch_shape_flags(spark, d):
    return patch_rows(spark, d).select("doc_id", Q.looks_like_patch("patch").alias("is_patch"), Q.patch_parseable("patch").alias("is_parseable"), F.round(Q.patch_quality("patch").cast("double"), 9).alias("quality"))


@query()
def answer_ast_flags(spark, d):
    """Rows only: whether a text is Python is for Python to say."""
    code = F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit("<answer>x = "), F.col("row_idx").cast("string"), F.lit("</answer>"))).otherwise(F.col("text"))
    return V.corpus(spark, d).select("row_idx", Q.answer_flags(code).alias("flags")).select("row_idx", "flags.*")


@query(f"""WITH {V.CORPUS}, f AS (SELECT *, {V.strip_sql('answer')} AS a FROM corpus)
SELECT count(*) AS total, count(*) FILTER ({V.strip_sql('prompt')} <> '') AS with_prompt, count(*) FILTER (a <> '') AS with_answer, count(DISTINCT {V.normal_sql('prompt')}) AS distinct_prompts,
round(coalesce(count(DISTINCT {V.normal_sql('prompt')}) / nullif(count(*), 0)::double, 0), 9) AS unique_ratio, round(coalesce(count(*) FILTER (a <> '') / nullif(count(*), 0)::double, 0), 9) AS answer_ratio FROM f""")
def quality_metrics(spark, d):
    c = V.corpus(spark, d).withColumns({"a": X.answer_of("text"), "normal": X.normalise_for_dedup("prompt")})
    m = c.agg(F.count("*").alias("total"), F.count_if(X.not_blank("prompt")).alias("with_prompt"), F.count_if(F.col("a") != "").alias("with_answer"), F.countDistinct("normal").alias("distinct_prompts"))
    ratio = lambda x: F.round(F.coalesce(F.try_divide(F.col(x), F.col("total")), F.lit(0.0)), 9)
    return m.withColumns({"unique_ratio": ratio("distinct_prompts"), "answer_ratio": ratio("with_answer")})


@query("WITH s AS (SELECT 'src' || i AS source FROM range(25) t(i)) SELECT s.source, count(d.doc_id) AS n FROM s LEFT JOIN documents d ON d.source = s.source GROUP BY s.source")
def source_counts_with_missing(spark, d):
    wanted = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    counts = V.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return wanted.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


TEST_TEXT = "CASE WHEN doc_id % 3 = 0 THEN 'def test_a():' || chr(10) || '  assert edge(' || doc_id || ')' || chr(10) || 'assert None' || chr(10) || chr(10) ELSE '' END || text"


@query(f"WITH src AS (SELECT doc_id, {TEST_TEXT} AS tests FROM documents), {V.quality_sql('src', 'doc_id', 'tests')} SELECT doc_id, nonempty_lines::int AS nonempty_lines, assert_count::int AS assert_count, test_fn_count::int AS test_fn_count, boundary_hits::int AS boundary_hits, property_hits::int AS property_hits, random_hits::int AS random_hits, quality_score, assert_count >= 2 AND nonempty_lines >= 3 AND quality_score >= 2.5 AS sufficient FROM measured")
def test_quality(spark, d):
    tests = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("def test_a():\n  assert edge("), F.col("doc_id").cast("string"), F.lit(")\nassert None\n\n"))).otherwise(""), "text")
    docs = V.read(spark, d, "documents").select("doc_id", Q.test_quality(tests).alias("q"))
    return docs.select("doc_id", "q.*", Q.sufficient("q").alias("sufficient")).withColumns(nine("quality_score"))


# --- best of n, pairs -------------------------------------------------------------------

def order():
    return ranking.candidate_order("score", "exec_time", "text", *V.TIES)


@query(f"WITH {V.CANDIDATES} SELECT prompt_id, text, score, exec_time, num_evaluated FROM (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS num_evaluated, row_number() OVER (PARTITION BY prompt_id ORDER BY {V.CANDIDATE_ORDER}) AS rn FROM candidates) WHERE rn = 1 AND score >= 1.99")
def best_of_n(spark, d):
    return ranking.best_of_n(V.candidates(spark, d), "prompt_id", order()).select("prompt_id", "text", "score", "exec_time", "num_evaluated")


def pairs(spark, d):
    return ranking.preference_pairs(V.candidates(spark, d), "prompt_id", order(), 3)


@query(f"WITH {V.PAIRS} SELECT prompt_id, chosen, rejected, chosen_score, rejected_score, round(score_gap, 9) AS score_gap, negative_rank::bigint AS negative_rank, num_evaluated, round(pair_weight, 9) AS pair_weight FROM pairs")
def preference_pairs(spark, d):
    return pairs(spark, d).withColumns(nine("score_gap", "pair_weight"))


def prepared(spark, d):
    p = pairs(spark, d)
    return p.select(F.col("prompt_id").cast("string").alias("prompt"), "chosen", "rejected", "score_gap", "rejected_score", (F.col("prompt_id") % 4 + 1).cast("int").alias("test_assert_count"), "negative_rank")


PREPARED = f"""{V.PAIRS}, fit AS (SELECT prompt_id::varchar AS prompt, chosen, rejected, score_gap, rejected_score, (prompt_id % 4 + 1)::int AS test_assert_count, negative_rank FROM pairs WHERE prompt_id % 4 + 1 >= 2),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt, chosen, rejected ORDER BY negative_rank) AS rn FROM fit) WHERE rn = 1)"""


@query(f"WITH {PREPARED} SELECT prompt, chosen, rejected, round(score_gap, 9) AS score_gap, rejected_score, test_assert_count FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score_gap DESC, rejected_score, test_assert_count DESC, length(rejected), negative_rank) AS place FROM once) WHERE place <= 6")
def prepare_pairs_top6(spark, d):
    return ranking.prepare_pairs(prepared(spark, d), "negative_rank").drop("negative_rank").withColumns(nine("score_gap"))


@query(f"""WITH {V.PAIRS}, w AS (SELECT *, greatest(0.1, pair_weight + prompt_id % 5) AS weight FROM pairs), m AS (SELECT weight AS med FROM (SELECT weight, row_number() OVER (ORDER BY weight) AS rn, count(*) OVER () AS n FROM w) WHERE rn = n // 2 + 1)
SELECT prompt_id, negative_rank::bigint AS negative_rank, unnest(range(1, 1 + round_even(least(4.0, greatest(1.0, weight / greatest(0.1, med))), 0)::int))::int AS copy FROM w, m""")
def gap_replication(spark, d):
    p = pairs(spark, d).select("prompt_id", "negative_rank", (F.col("pair_weight") + F.col("prompt_id") % 5).alias("weight"))
    return sampling.gap_copies(p, "weight").select("prompt_id", "negative_rank", F.col("copy").cast("int"))


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, CASE WHEN n >= 200 AND rn <= greatest(50, least(floor(n * 0.05)::int, n - 1)) THEN 'eval' ELSE 'train' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('3407|' || o_orderkey), o_orderkey) AS rn FROM orders), n")
def train_eval_split(spark, d):
    return sampling.train_eval_split(V.read(spark, d, "orders").select("o_orderkey"), 0.05, "o_orderkey")


@query(f"WITH {V.CANDIDATES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, text ORDER BY {V.CANDIDATE_ORDER}) AS k FROM candidates) WHERE k = 1) SELECT prompt_id, text, score, beam_rank::int AS beam_rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {V.CANDIDATE_ORDER}) AS beam_rank FROM b) WHERE beam_rank <= 2")
def beam_select(spark, d):
    return ranking.beam(V.candidates(spark, d), "prompt_id", "text", 2, order()).select("prompt_id", "text", "score", "beam_rank")


@query("""WITH w AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events),
i AS (SELECT *, best_before IS NULL OR value > best_before AS improved FROM w), g AS (SELECT *, sum(improved::int) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM i)
SELECT event_id, best_before, improved, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1)::int AS stale, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1 >= 3 AS stop FROM g""")
def stagnation_rounds(spark, d):
    e = V.read(spark, d, "events").select("event_id", "user_id", "value")
    return ranking.stagnation(e, "user_id", ["event_id"], "value", 3).select("event_id", "best_before", "improved", F.col("stale").cast("int"), "stop")


# --- hard examples, curriculum ----------------------------------------------------------

def hard(spark, d):
    return V.failures(spark, d).withColumn("hardness", F.round(Q.hardness("error_type", "rounds_used", "generated_candidates", "test_quality_score"), 9))


@query(f"WITH {V.FAILURES} SELECT event_id, error_type, hardness FROM (SELECT *, row_number() OVER (PARTITION BY prompt, tests ORDER BY event_id) AS rn FROM hard WHERE NOT pass_at_1 AND test_quality_score >= 1.0) WHERE rn = 1")
def hard_example_mining(spark, d):
    rows = hard(spark, d).where(~F.col("pass_at_1") & X.not_blank("prompt") & X.not_blank("tests") & (F.col("test_quality_score") >= 1.0))
    return dedup.keep_first(rows, dedup.task_key(F.col("prompt"), F.col("tests")), "event_id").select("event_id", "error_type", "hardness")


@query(f"""WITH {V.FAILURES}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt, tests ORDER BY event_id) AS rn FROM hard WHERE NOT pass_at_1 AND test_quality_score >= 1.0) WHERE rn = 1),
capped AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY hardness DESC, event_id) AS place, count(*) OVER () AS n FROM kept)
SELECT event_id, error_type, hardness FROM capped WHERE place <= greatest(1, floor(n * 0.2))""")
def mined_rounds(spark, d):
    """Hard examples of three rounds of logs, mined into a kept table, the last round first and one of them again."""
    logs, kept = hard(spark, d), mining.HardExamples(spark, Work(spark, "hard-examples").held(), "event_id")
    for k in (2, 0, 1, 0):
        kept.mine(logs.where(F.floor(F.col("event_id") / 50) % 3 == k), f"round-{k}")
    return kept.selected("error_type", 0.2, "hardness").select("event_id", "error_type", "hardness")


CAP_SQL = f"{V.FAILURES}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY hardness DESC, event_id) AS rn, count(*) OVER () AS n FROM hard) WHERE rn <= greatest(1, floor(n * 0.2)))"


@query(f"WITH {CAP_SQL} SELECT event_id, error_type, hardness FROM one")
def share_cap_error_type(spark, d):
    return sampling.share_cap(hard(spark, d), "error_type", 0.2, "hardness", "event_id").select("event_id", "error_type", "hardness")


@query(f"WITH {CAP_SQL}, two AS (SELECT *, row_number() OVER (PARTITION BY event_id % 3 ORDER BY hardness DESC, event_id) AS rn2, count(*) OVER () AS n2 FROM one) SELECT event_id, error_type, hardness FROM two WHERE rn2 <= greatest(1, floor(n2 * 0.3))")
def share_cap_two_pass(spark, d):
    one = sampling.share_cap(hard(spark, d), "error_type", 0.2, "hardness", "event_id").withColumn("third", F.col("event_id") % 3)
    return sampling.share_cap(one, "third", 0.3, "hardness", "event_id").select("event_id", "error_type", "hardness")


@query(f"""WITH {V.FAILURES}, a AS (SELECT event_id, prompt, error_type, hardness, 'new' AS source FROM hard WHERE event_id % 2 = 0), b AS (SELECT event_id, prompt, 'unknown' AS error_type, 0.0::double AS hardness, 'old' AS source FROM hard WHERE event_id % 2 = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT event_id, prompt, error_type, hardness, source FROM u ORDER BY {V.shuffle_sql('event_id')}, event_id LIMIT 2000""")
def merge_replay_aligned(spark, d):
    """The limit is the feature: a merged replay set of at most 2000 rows by hash order."""
    rows = hard(spark, d)
    columns = {"event_id": ("bigint", 0), "prompt": ("string", ""), "error_type": ("string", "unknown"), "hardness": ("double", 0.0), "source": ("string", "old")}
    new = templates.align_columns(rows.where("event_id % 2 = 0").withColumn("source", F.lit("new")), columns)
    old = templates.align_columns(rows.where("event_id % 2 = 1").select("event_id", "prompt"), columns)
    return sampling.shuffled_head(new.unionByName(old), 2000, "event_id")


@query(f"WITH {V.GRADED} SELECT doc_id, difficulty_score, macro_bucket FROM graded")
def difficulty_score(spark, d):
    return V.graded(spark, d).select("doc_id", "difficulty_score", "macro_bucket")


@query(f"WITH {V.GRADED}, c AS (SELECT list(difficulty_score ORDER BY difficulty_score) AS s, count(*) AS n FROM graded) SELECT doc_id, CASE WHEN difficulty_score <= s[n // 4 + 1] THEN 'easy' WHEN difficulty_score <= s[n // 2 + 1] THEN 'medium' WHEN difficulty_score <= s[3 * n // 4 + 1] THEN 'hard' ELSE 'expert' END AS tier FROM graded, c")
def curriculum_1d(spark, d):
    return curriculum.tiers(V.graded(spark, d).select("doc_id", "difficulty_score"), "difficulty_score").select("doc_id", "tier")


@query(f"WITH {V.GRADED}, c AS (SELECT macro_bucket, list(difficulty_score ORDER BY difficulty_score) AS s, count(*) AS n FROM graded GROUP BY macro_bucket) SELECT doc_id, CASE macro_bucket WHEN 'core_code' THEN 'core_' ELSE 'repo_' END || CASE WHEN difficulty_score <= s[n // 3 + 1] THEN 'easy' WHEN difficulty_score <= s[2 * n // 3 + 1] THEN 'mid' ELSE 'hard' END AS tier FROM graded JOIN c USING (macro_bucket)")
def curriculum_2d(spark, d):
    return curriculum.tiers_by_bucket(V.graded(spark, d).select("doc_id", "macro_bucket", "difficulty_score"), "macro_bucket", "difficulty_score").select("doc_id", "tier")


@query(f"WITH {V.GRADED}, c AS (SELECT list(test_quality_score ORDER BY test_quality_score) AS s, count(*) AS n FROM graded) SELECT doc_id, test_quality_score FROM graded, c WHERE test_quality_score >= s[floor(n * 0.2)::int + 1]")
def drop_low_quality(spark, d):
    return curriculum.drop_low_quality(V.graded(spark, d).select("doc_id", "test_quality_score"), "test_quality_score", 0.2, 50)


@query(f"WITH {V.GRADED} SELECT doc_id, prompt_length, test_quality_score, test_assert_count FROM graded ORDER BY prompt_length DESC, test_quality_score DESC, test_assert_count DESC, doc_id LIMIT (SELECT least(greatest(200, floor(count(*) * 0.15)::int), 1500, count(*)) FROM documents)")
def auto_hard_replay_topn(spark, d):
    """A top-n report: the limit is the feature."""
    return curriculum.hard_replay(V.graded(spark, d).select("doc_id", "prompt_length", "test_quality_score", "test_assert_count"), "doc_id")


@query(f"""WITH {V.GRADED}, b AS (SELECT macro_bucket, count(*) / (SELECT count(*) FROM graded)::double AS ratio FROM graded GROUP BY 1), r AS (SELECT *, (1500 - 30 * count(*) OVER ()) * ratio / sum(ratio) OVER () AS raw, 1500 - 30 * count(*) OVER () AS rest FROM b),
l AS (SELECT *, rest - sum(floor(raw)) OVER () AS left_over, row_number() OVER (ORDER BY raw - floor(raw) DESC, macro_bucket) AS place FROM r) SELECT macro_bucket, (30 + floor(raw) + CASE WHEN place <= left_over THEN 1 ELSE 0 END)::int AS steps FROM l""")
def stage_step_allocation(spark, d):
    """Counts of the few buckets come to the driver, as stage plans do."""
    counts = sorted((r[0], r[1]) for r in V.graded(spark, d).groupBy("macro_bucket").count().collect())
    total = sum(n for _, n in counts)
    steps = curriculum.allocate_steps([n / total for _, n in counts], 1500)
    return spark.createDataFrame([(b, s) for (b, _), s in zip(counts, steps)], "macro_bucket string, steps int")


# --- evaluation -------------------------------------------------------------------------

def sides(spark, d):
    logs = V.case_logs(spark, d)
    return logs.where("side = 'base'"), logs.where("side = 'post'")


@query(f"WITH {V.CASE_LOGS}, ids AS (SELECT DISTINCT lower(benchmark) AS benchmark, id FROM post WHERE benchmark IN ('click', 'error')) SELECT event_id, benchmark, id FROM base b WHERE EXISTS (SELECT 1 FROM ids i WHERE i.benchmark = b.benchmark AND i.id = b.id) OR b.benchmark NOT IN (SELECT benchmark FROM ids)")
def case_filter_semi(spark, d):
    base, post = sides(spark, d)
    return cases.filter_cases(base, cases.case_ids(post.where(F.col("benchmark").isin("click", "error")))).select("event_id", "benchmark", "id")


DIFF_SQL = f"""{V.CASE_LOGS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, mode, id ORDER BY event_id DESC) AS rn FROM post) WHERE rn = 1),
joined AS (SELECT b.benchmark, b.mode, b.id, p.pass_at_1::int::double - b.pass_at_1::int::double AS pass_diff, round(p.format_errors / 100.0 - b.format_errors / 100.0, 9)::double AS format_diff FROM base b JOIN last p ON b.benchmark = p.benchmark AND b.mode = p.mode AND b.id = p.id)"""


@query(f"WITH {DIFF_SQL} SELECT benchmark, id, pass_diff, format_diff FROM joined")
def align_diffs(spark, d):
    base, post = sides(spark, d)
    passed = cases.align_diffs(base, post, "pass", "event_id").withColumnRenamed("diff", "pass_diff")
    errors = cases.align_diffs(base, post, "format", "event_id").withColumnRenamed("diff", "format_diff")
    return passed.join(errors, cases.KEY).select("benchmark", "id", "pass_diff", F.round("format_diff", 9).alias("format_diff"))


OBJECTIVE_SQL = f"""{DIFF_SQL}, diffs AS (SELECT 'livecodebench' AS component, benchmark, id, pass_diff AS diff FROM joined WHERE benchmark = 'click' UNION ALL SELECT 'bigcodebench_instruct', benchmark, id, pass_diff FROM joined WHERE benchmark = 'view'
UNION ALL SELECT 'swebench_verified_subset', benchmark, id, pass_diff FROM joined WHERE benchmark = 'purchase' UNION ALL SELECT 'agentic_success', benchmark, id, pass_diff FROM joined UNION ALL SELECT 'format_quality', benchmark, id, -format_diff FROM joined)"""
WEIGHT_SQL = "CASE component WHEN 'livecodebench' THEN 0.35 WHEN 'bigcodebench_instruct' THEN 0.25 WHEN 'swebench_verified_subset' THEN 0.2 ELSE 0.1 END"


def objective(spark, d):
    base, post = sides(spark, d)
    return cases.paired_objective(base, post, base, post, "event_id", V.BENCHMARKS).withColumns(nine("diff"))


@query(f"WITH {OBJECTIVE_SQL} SELECT component, count(*) AS n, round(avg(diff), 9) AS mean FROM diffs GROUP BY component")
def paired_objective(spark, d):
    return objective(spark, d).groupBy("component").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 9).alias("mean"))


@query(f"WITH {OBJECTIVE_SQL} SELECT component, count(*) AS n, round(avg(diff), 9) AS mean FROM diffs GROUP BY component")
def bucketed_objective(spark, d):
    """As paired_objective, from logs that are saved bucketed once and then compared for each component without a shuffle."""
    work = Work(spark, "case-logs")
    root = work.held()
    base, post = (cases.save_log(log, f"{root.rpartition('/')[2].replace('-', '_')}_{name}", f"{root}/{name}", 16) for name, log in zip(("base", "post"), sides(spark, d)))
    diffs = cases.paired_objective(base, post, base, post, "event_id", V.BENCHMARKS)
    return diffs.groupBy("component").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 9).alias("mean"))


REPORT_SQL = "count(*) AS total, round(avg(pass_at_1::int), 9) AS pass_at_1, round(avg(pass_at_k::int), 9) AS pass_at_k, round(avg(format_errors / 100.0), 9)::double AS format_error_rate, round(avg(rounds_used), 9) AS avg_rounds"


@query(f"WITH {V.CASE_LOGS} SELECT benchmark, {REPORT_SQL} FROM base GROUP BY benchmark")
def bench_report(spark, d):
    return cases.benchmark_report(sides(spark, d)[0], "benchmark").withColumns(nine("pass_at_1", "pass_at_k", "format_error_rate", "avg_rounds"))


@query(f"WITH {V.CASE_LOGS}, g AS (SELECT * FROM (VALUES ('core', 'click'), ('core', 'view'), ('money', 'purchase'), ('money', 'view')) t(grp, benchmark)) SELECT grp, {REPORT_SQL} FROM base JOIN g USING (benchmark) GROUP BY grp UNION ALL SELECT 'global', {REPORT_SQL} FROM base")
def group_report(spark, d):
    return cases.group_report(sides(spark, d)[0], {"core": ["click", "view"], "money": ["purchase", "view"]}).withColumns(nine("pass_at_1", "pass_at_k", "format_error_rate", "avg_rounds"))


#: Replicates of the resampling queries.
SAMPLES = 1000
ENDS_SQL = lambda x, samples: f"max({x}) FILTER (r = {int(0.025 * (samples - 1)) + 1}) AS low, max({x}) FILTER (r = {int(0.975 * (samples - 1)) + 1}) AS high"


def interval_sql(name: str, key: str, samples: int, levels: int) -> str:
    """CTEs from ``name`` (cell, value) to ``name``_ci (cell, mean, low, high, n)."""
    ends = f"SELECT cell, {ENDS_SQL('mean', samples)} FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY mean) AS r FROM {name}_means) GROUP BY cell"
    return f"{replicates_sql(name, key, samples, levels)}, {name}_ci AS (SELECT cell, m.mean, CASE WHEN n = 1 THEN m.mean ELSE low END AS low, CASE WHEN n = 1 THEN m.mean ELSE high END AS high, n FROM ({ends}) JOIN (SELECT cell, sum(value * c) / sum(c) AS mean, sum(c)::bigint AS n FROM {name}_c GROUP BY cell) m USING (cell))"


@query(f"WITH {V.CASE_LOGS}, v AS (SELECT benchmark, pass_at_1::int::double AS value FROM base), {interval_sql('v', 'benchmark', SAMPLES, 1)} SELECT cell AS benchmark, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high, n FROM v_ci")
def bootstrap_ci(spark, d):
    values = sides(spark, d)[0].select("benchmark", F.col("pass_at_1").cast("double").alias("value"))
    return stats.bootstrap_ci(values, SAMPLES, "benchmark").withColumns(nine("mean", "low", "high"))


WEIGHTED = WEIGHT_SQL.replace("component", "cell")


#: Differences of format rates have some two hundred values.
@query(f"""WITH {OBJECTIVE_SQL}, v AS (SELECT component, round(diff, 9) AS value FROM diffs), {replicates_sql('v', 'component', SAMPLES, 8)},
r AS (SELECT *, row_number() OVER (ORDER BY mean) AS r FROM (SELECT rep, sum({WEIGHTED} * mean) AS mean FROM v_means GROUP BY rep)),
observed AS (SELECT sum({WEIGHTED} * mean) AS observed FROM (SELECT cell, sum(value * c) / sum(c) AS mean FROM v_c GROUP BY cell))
SELECT round(any_value(observed), 9)::double AS observed, round(low, 9)::double AS low, round(high, 9)::double AS high FROM observed, (SELECT {ENDS_SQL('mean', SAMPLES)} FROM r) GROUP BY low, high""")
def bootstrap_weighted_diff(spark, d):
    return stats.weighted_diff_ci(objective(spark, d), cases.COMPONENTS, SAMPLES).withColumns(nine("observed", "low", "high"))


FLIP_SQL = f"""{OBJECTIVE_SQL}, v AS (SELECT component, round(diff, 9) AS value FROM diffs), {flipped_sql('v', 'component', SAMPLES)},
observed AS (SELECT sum({WEIGHTED} * mean) AS observed FROM (SELECT cell, sum(value * c) / sum(c) AS mean FROM v_c GROUP BY cell)),
nulls AS (SELECT rep, sum({WEIGHTED} * mean) AS stat FROM v_flips GROUP BY rep),
tested AS (SELECT any_value(observed) AS observed, (count(*) FILTER (round(stat, 12) >= round(observed, 12)) + 1) / {SAMPLES + 1}.0 AS p_value FROM observed, nulls)"""


@query(f"WITH {FLIP_SQL} SELECT round(observed, 9)::double AS observed, round(p_value, 9)::double AS p_value FROM tested")
def sign_flip_pvalue(spark, d):
    return stats.sign_flip(objective(spark, d), cases.COMPONENTS, SAMPLES).withColumns(nine("observed", "p_value"))


#: Replicates of the gate's intervals.
GATE_SAMPLES = 200
#: Per run and group (each benchmark, and all as ``global``): intervals of the pass rate and of the rate of format errors.
GATE_SQL = ", ".join(
    f"{side}_groups AS (SELECT benchmark AS grp, * FROM {side} UNION ALL SELECT 'global', * FROM {side}), "
    f"{side}_pass AS (SELECT grp, pass_at_1::int::double AS value FROM {side}_groups), {interval_sql(f'{side}_pass', 'grp', GATE_SAMPLES, 1)}, "
    f"{side}_fmt AS (SELECT grp, format_errors / 100.0::double AS value FROM {side}_groups), {interval_sql(f'{side}_fmt', 'grp', GATE_SAMPLES, 7)}, "
    f"{side}_score AS (SELECT {', '.join(f'sum(CASE p.cell {chr(32).join(f"WHEN {chr(39)}{b}{chr(39)} THEN {w}" for b, w in (("click", 0.35), ("view", 0.25), ("purchase", 0.2), ("global", 0.1)))} ELSE 0 END * p.{x}) + 0.1 * (1 - any_value(f.{y})) AS {x}' for x, y in (('mean', 'mean'), ('low', 'high'), ('high', 'low')))} "
    f"FROM {side}_pass_ci p, (SELECT * FROM {side}_fmt_ci WHERE cell = 'global') f)"
    for side in ("base", "post"))


@query(f"""WITH {FLIP_SQL}, {GATE_SQL},
c AS (SELECT cell AS benchmark, p.mean + 1e-6 >= b.mean - 0.01 AND p.low + 1e-6 >= b.low - 0.02 AS pass_ok, pf.mean <= bf.mean + 0.01 AS format_ok
  FROM base_pass_ci b JOIN post_pass_ci p USING (cell) JOIN base_fmt_ci bf USING (cell) JOIN post_fmt_ci pf USING (cell) WHERE cell <> 'global'),
s AS (SELECT (SELECT mean FROM post_fmt_ci WHERE cell = 'global') AS post_format, b.*, p.mean AS p_mean, p.low AS p_low FROM base_score b, post_score p),
g AS (SELECT post_format, (p_mean - mean) / greatest(1e-6, mean) AS gain, (p_low - high) / greatest(1e-6, high) AS gain_low, p_value FROM s, tested)
SELECT array_to_string(list_filter([CASE WHEN post_format >= 0.02 THEN 'format_error_rate' END, CASE WHEN gain < 0.15 THEN 'relative_improvement' END, CASE WHEN gain_low < 0.05 THEN 'relative_improvement_lower_bound' END, CASE WHEN p_value > 0.05 THEN 'significance' END,
(SELECT string_agg('no_regression:' || benchmark, ',' ORDER BY benchmark) FROM c WHERE NOT (pass_ok AND format_ok))], lambda x: x IS NOT NULL), ',') AS failures, round(gain, 9)::double AS gain, round(gain_low, 9)::double AS gain_low, round(p_value, 9)::double AS p_value FROM g""")
def gate_checks(spark, d):
    """The acceptance gate from its inputs: composite scores with bootstrap intervals of both runs, the sign-flip test, and reports per benchmark."""
    def report(log):
        groups = log.withColumn("grp", F.col("benchmark")).unionByName(log.withColumn("grp", F.lit("global")))
        return cases.report_with_intervals(groups, "grp", GATE_SAMPLES)

    def scores(found):
        of = lambda group, metric: F.first(F.when(F.col("grp") == group, F.col(metric)), ignorenulls=True)
        one = found.agg(*[of(b, "pass_at_1_ci").alias(c) for c, b in V.BENCHMARKS.items()], of("global", "pass_at_1_ci").alias("agent"), of("global", "format_error_rate_ci").alias("format_rate"))
        return one.select(cases.primary_score(*V.BENCHMARKS, "agent", "format_rate").alias("score"), "format_rate")

    def means(found):
        return found.where("grp <> 'global'").select(F.col("grp").alias("benchmark"), F.col("pass_at_1_ci")[0].alias("pass_mean"), F.col("pass_at_1_ci")[1].alias("pass_low"), F.col("format_error_rate_ci")[0].alias("format_mean"))

    base, post = (report(log) for log in sides(spark, d))
    tested = stats.sign_flip(objective(spark, d), cases.COMPONENTS, SAMPLES)
    inputs = cases.gate_inputs(scores(base), scores(post), tested)
    failed = cases.gate_failures(inputs, cases.regression_checks(means(base), means(post)))
    return failed.select(F.array_join("failures", ",").alias("failures"), "gain", "gain_low", "p_value").withColumns(nine("gain", "gain_low", "p_value"))


@query(f"WITH {V.CANDIDATES} SELECT prompt_id, bool_and(score >= 1.99) AS all_passed, min(score) AS min_score, max(score) AS max_score, min(exec_time) FILTER (score >= 1.99) AS best_time, max(exec_time) AS max_time FROM candidates GROUP BY prompt_id")
def verifier_rollup(spark, d):
    runs = V.candidates(spark, d).withColumns({"round": F.col("l_linenumber"), "error_type": F.when(F.col("score") < 1.99, "assertion").otherwise("")})
    return cases.verifier_rollup(runs, "prompt_id").drop("best_error")


@query(f"WITH {V.CANDIDATES} SELECT prompt_id, arg_min(score >= 1.99, l_shipdate::varchar || text) AS pass_at_1, bool_or(score >= 1.99) AS pass_any_k, count(*) AS generated_candidates FROM candidates GROUP BY prompt_id")
def classic_pass_at_k(spark, d):
    c = V.candidates(spark, d).withColumns({"first": F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "text"), "ok": F.col("score") >= 1.99})
    return cases.classic_case(c, "prompt_id", "first", "ok")


@query("SELECT user_id, array_to_string(list_transform(list_sort(list(struct_pack(i := event_id, e := event_type, v := value)))[1:6], lambda h, i: '[Round ' || i || '] error=' || h.e || ' score=' || printf('%.3f', h.v) || ' stderr='), chr(10)) AS history, greatest(1, sum(cast(regexp_extract(props, '(\\d+)', 1) AS int)))::int AS budget FROM events GROUP BY user_id")
def history_render(spark, d):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = V.read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("error_type"), F.col("value").alias("score"), F.lit("").alias("stderr"), k.alias("k"))
    # the rounds that are shown are ranked first, so that no more of them are ever listed together
    shown = ranking.top_per_group(e, "user_id", [F.asc("event_id")], 6).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "error_type", "score", "stderr"))).alias("history"))
    budget = e.groupBy("user_id").agg(F.greatest(F.lit(1), F.sum("k")).cast("int").alias("budget"))
    return shown.join(budget, "user_id").select("user_id", templates.rendered_history("history").alias("history"), "budget")


# --- retrieval, token overlap, scorer ---------------------------------------------------

TERMS_SQL = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-zA-Z_][a-zA-Z0-9_]+'), lambda t: length(t) > 2)"
SYMBOLS_SQL = lambda x: f"list_distinct(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda s: regexp_full_match(s, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}')))"
BM25_SQL = f"""docs AS (SELECT doc_id AS doc, {TERMS_SQL("source || chr(10) || text")} AS terms, list_distinct({TERMS_SQL('source')}) AS path_terms, {SYMBOLS_SQL("source || chr(10) || text")} AS symbols FROM documents WHERE trim(text) <> ''),
lens AS (SELECT doc, len(terms) AS doc_len FROM docs), totals AS (SELECT count(*) AS n_docs, avg(doc_len) AS mean_len FROM lens),
asked AS (SELECT item_id AS query, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS_SQL('text')}) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
parts AS (SELECT query, doc, times * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / greatest(1.0, mean_len))) AS part FROM asked JOIN dfs USING (term) JOIN postings USING (term) JOIN lens USING (doc), totals
UNION ALL SELECT query, doc, 1.5 FROM asked JOIN (SELECT doc, unnest(path_terms) AS term FROM docs) USING (term)
UNION ALL SELECT item_id, doc, 0.8 FROM (SELECT item_id, unnest({SYMBOLS_SQL('text')}) AS s FROM benchmark) JOIN (SELECT doc, unnest(symbols) AS s FROM docs) USING (s)),
scores AS (SELECT query, doc, round(sum(part), 9) AS score FROM parts GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores WHERE score > 0)"""


def retrieved(spark, d):
    docs = V.read(spark, d, "documents")
    found = retrieval.retrieve(retrieval.index(docs, "doc_id", "source", "text"), V.read(spark, d, "benchmark"), "item_id", "text")
    return found, docs


@query(f"WITH {BM25_SQL} SELECT query, doc, round(score, 6) AS score FROM best WHERE rank <= 8")
def kept_index_top8(spark, d):
    """As bm25_top8, from a kept index that is made of half the documents, with other texts for some, and then brought up to all."""
    docs = V.read(spark, d, "documents").withColumn("signature", F.xxhash64("source", "text"))
    kept = PostingIndex(spark, Work(spark, "kept-index").held(), buckets=16)
    old = docs.where(F.col("doc_id") % 2 == 0).withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.upper("source")).otherwise(F.col("text"))).withColumn("signature", F.xxhash64("source", "text"))
    for state in (old, docs):
        kept.refresh(state, "doc_id", "source", "text", "signature")
    return kept.search(V.read(spark, d, "benchmark"), "item_id", "text").select("query", "doc", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL} SELECT query, doc, round(score, 6) AS score FROM best WHERE rank <= 8")
def bm25_top8(spark, d):
    return retrieved(spark, d)[0].select("query", "doc", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25_SQL}, blocks AS (SELECT query, rank, '[FILE] ' || source || chr(10) || text || chr(10) AS block FROM best JOIN documents ON doc_id = doc WHERE rank <= 8),
used AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM blocks)
SELECT query, {V.strip_sql("string_agg(substr(block, 1, 9000 - before), chr(10) ORDER BY rank)")} AS context, count(*) AS n_blocks FROM used WHERE before < 9000 GROUP BY query""")
def context_budget(spark, d):
    found, docs = retrieved(spark, d)
    rows = found.join(docs.select(F.col("doc_id").alias("doc"), "source", "text"), "doc")
    return retrieval.context_blocks(rows, "query", "rank", "source", "text")


@query(f"""WITH m AS (SELECT conv_id, turn, lower({V.strip_sql("regexp_replace(text, '\\s+', ' ', 'g')")}) AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, a.t AS pt, b.t AS rt FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
l AS (SELECT *, list_filter(string_split(pt, ' '), lambda x: x <> '') AS pl, list_filter(string_split(rt, ' '), lambda x: x <> '') AS rl FROM p),
o AS (SELECT conv_id, turn, len(pl) + len(rl) AS total, coalesce(list_sum(list_transform(list_distinct(list_intersect(pl, rl)), lambda t: least(len(list_filter(pl, lambda x: x = t)), len(list_filter(rl, lambda x: x = t))))), 0) AS shared FROM l)
SELECT conv_id, turn, round(coalesce(2.0 * shared / nullif(total, 0), 0), 9)::double AS f1 FROM o""")
def token_f1(spark, d):
    c = V.read(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.token_f1("text", "reference"), 9).alias("f1"))


FEATURE_SQL = f"feats AS (SELECT doc_id, ({V.hash8_sql('t')} % 1024)::int AS bucket, count(*) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]+')) AS t FROM documents) GROUP BY ALL)"


@query(f"WITH {FEATURE_SQL} SELECT doc_id, bucket, value FROM feats")
def prm_featurize(spark, d):
    return prm.featurise(V.read(spark, d, "documents"), "doc_id", "text", 1024)


def fixed_weights(spark):
    b = F.col("id").cast("int")
    return spark.range(1024).select(b.alias("bucket"), ((X.hash8(F.concat(F.lit("w"), F.col("id").cast("string"))) % 201 - 100) / 10000.0).alias("weight"))


@query(f"WITH {FEATURE_SQL}, w AS (SELECT i::int AS bucket, ({V.hash8_sql("'w' || i")} % 201 - 100) / 10000.0 AS weight FROM range(1024) t(i)), s AS (SELECT doc_id, sum(weight * value) AS dot FROM feats JOIN w USING (bucket) GROUP BY doc_id) SELECT d.doc_id, round(1 / (1 + exp(-(coalesce(dot, 0) + 0.25))), 6) AS score FROM documents d LEFT JOIN s USING (doc_id)")
def prm_predict(spark, d):
    return prm.predict(V.read(spark, d, "documents"), "doc_id", "text", fixed_weights(spark), 0.25, 1024).withColumn("score", F.round("score", 6))


@query(f"""WITH rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256('3407|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY h) - 1 AS idx FROM rows""")
def numbered_rows(spark, d):
    """All line items numbered in a seeded random order."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = V.read(spark, d, "lineitem").select(*key).withColumn("h", sampling.seeded(F.concat_ws("|", *[F.col(k).cast("string") for k in key])))
    return sampling.numbered(rows, ["h"]).drop("h")


@query()
def prm_train_exact(spark, d):
    """Rows only: sequential training."""
    rows = V.read(spark, d, "documents").join(V.read(spark, d, "labels").where("quality IS NOT NULL"), "doc_id").select("doc_id", "text", "quality")
    return prm.train(rows, "text", "quality", "doc_id")


@query()
def prm_train_logistic(spark, d):
    """Rows only: the optimum of an iterative fit. Fitted on all labelled documents, applied to all documents."""
    docs, labels = V.read(spark, d, "documents"), V.read(spark, d, "labels").where("quality IS NOT NULL")
    model = prm.fit_logistic(docs.join(labels, "doc_id"), "text", "quality")
    return prm.predict(docs, "doc_id", F.coalesce("text", F.lit("")), model.frame(spark), model.bias, mean=True)


# --- rewards ----------------------------------------------------------------------------

def completions(spark, d):
    """A conversation's turn and the next one as prompt and completion; every third completion is tagged."""
    c = V.read(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    kind = (F.col("conv_id") + F.col("turn")) % 3
    rows = c.join(after, ["conv_id", "turn"]).withColumnRenamed("text", "prompt")
    tagged = F.concat(F.lit("<reasoning>First, the test step because\nassert x edge case "), "reply", F.lit("</reasoning>"))
    answer = F.concat(F.lit("<answer>"), F.col("reply"), F.lit("</answer>"))
    return rows.select("conv_id", "turn", "prompt", F.when(kind == 0, F.concat(tagged, answer)).when(kind == 1, answer).otherwise(F.col("reply")).alias("text"), F.when(F.col("turn") % 2 == 0, "assert a\nassert b").otherwise("").alias("tests"))


COMPLETIONS = """c AS (SELECT a.conv_id, a.turn, a.text AS prompt, (a.conv_id + a.turn) % 3 AS kind, b.text AS reply, CASE WHEN a.turn % 2 = 0 THEN 'assert a' || chr(10) || 'assert b' ELSE '' END AS tests FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
completions AS (SELECT *, CASE kind WHEN 0 THEN '<reasoning>First, the test step because' || chr(10) || 'assert x edge case ' || reply || '</reasoning>' ELSE '' END || CASE WHEN kind < 2 THEN '<answer>' || reply || '</answer>' ELSE reply END AS text FROM c)"""


@query(f"WITH {COMPLETIONS} SELECT conv_id, turn, CASE kind WHEN 0 THEN 0.8 WHEN 1 THEN 0.4 ELSE -1.5 END::double AS reward FROM completions")
def format_reward(spark, d):
    return completions(spark, d).select("conv_id", "turn", F.round(R.format_reward("text", 20, 100), 9).alias("reward"))


WORDS_SQL = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {COMPLETIONS}, m AS (SELECT *, {WORDS_SQL('text')} AS n, 0.6 * least(1.0, {WORDS_SQL('prompt')} / 600.0) + 0.4 * least(1.0, CASE WHEN tests = '' THEN 0 ELSE 2 END / 8.0) AS cx FROM completions),
b AS (SELECT *, floor(280 + 620 * cx) AS soft, floor(700 + 1300 * cx) AS hard FROM m) SELECT conv_id, turn, round(CASE WHEN n < soft THEN 0.0 WHEN n < hard THEN -0.2 WHEN n < hard + 300 THEN -0.5 ELSE greatest(-2.0, -0.5 - (n - hard - 300) * 0.001) END, 9)::double AS reward FROM b""")
def length_penalty(spark, d):
    return completions(spark, d).select("conv_id", "turn", F.round(R.length_reward("prompt", "text", "tests"), 9).alias("reward"))


@query(f"WITH {COMPLETIONS} SELECT conv_id, turn, CASE WHEN kind = 0 THEN 0.2 ELSE 0.0 END::double AS reward FROM completions")
def self_verification(spark, d):
    return completions(spark, d).select("conv_id", "turn", R.self_check_reward("text").alias("reward"))


@query(f"""WITH {COMPLETIONS}, f AS (SELECT conv_id, turn, conv_id % 7 AS grp, substr(regexp_replace(lower({V.strip_sql("CASE WHEN kind < 2 THEN reply ELSE text END")}), '\\s+', ' ', 'g'), 1, 500) AS fp FROM completions),
n AS (SELECT *, row_number() OVER (PARTITION BY grp, fp ORDER BY conv_id, turn) - 1 AS seen FROM f) SELECT conv_id, turn, round(CASE WHEN seen = 0 THEN 0.08 ELSE -least(0.25, 0.10 + 0.05 * seen) END, 9)::double AS reward FROM n""")
def diversity_reward(spark, d):
    rows = completions(spark, d).select("conv_id", "turn", (F.col("conv_id") % 7).cast("string").alias("prompt"), "text")
    return rows.select("conv_id", "turn", F.round(R.diversity_reward("prompt", "text", F.struct("conv_id", "turn")), 9).alias("reward"))


ANY_SQL = lambda *ws: "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")::int"


#: A completion's parts, and the process reward's terms without the learned one.
PROCESS_SQL = f"""{COMPLETIONS}, r AS (SELECT *, CASE WHEN kind = 0 THEN {V.strip_sql("'First, the test step because' || chr(10) || 'assert x edge case ' || reply")} ELSE '' END AS reasoning, CASE WHEN kind < 2 THEN {V.strip_sql('reply')} ELSE '' END AS answer FROM completions),
m AS (SELECT *, lower(reasoning) AS low, {WORDS_SQL('reasoning')} AS n, {WORDS_SQL('answer')} AS na, len(list_intersect({SYMBOLS_SQL("prompt || chr(10) || tests")}, {SYMBOLS_SQL('reasoning')})) AS shared,
  len(list_filter(regexp_split_to_array(reasoning, '[\\r\\n]+'), lambda x: regexp_matches(x, '\\S'))) AS lines, len(list_distinct(list_filter(regexp_split_to_array(lower(reasoning), '\\s+'), lambda w: w <> ''))) AS kinds FROM r)"""
TERMS_SQL = f"""CASE WHEN reasoning = '' THEN -0.15 ELSE 0.2 * (n >= 30)::int + 0.1 * (n >= 70)::int - 0.15 * (n > 450)::int + 0.2 * {ANY_SQL('assert', 'test')} + 0.15 * {ANY_SQL('edge', 'boundary', 'corner')} + 0.1 * {ANY_SQL('complex', 'o(')}
  + 0.1 * {ANY_SQL('first', 'then', 'finally', 'step', 'plan')} + (tests <> '')::int * (0.1 * {ANY_SQL('assert', 'test')} + 0.1 * {ANY_SQL('regression', 'edge', 'boundary')})
  + 0.08 * (lines >= 2)::int + 0.07 * {ANY_SQL('because', 'therefore', 'so that', 'hence')} + 0.08 * {ANY_SQL('first', 'second', 'then', 'finally', 'step')} + 0.07 * (shared >= 2)::int - 0.12 * (kinds / greatest(1, n)::double < 0.35)::int END
  + CASE WHEN answer = '' THEN -0.2 WHEN na < 4 THEN -0.12 WHEN na <= 220 THEN 0.06 ELSE 0 END"""


@query(f"WITH {PROCESS_SQL} SELECT conv_id, turn, round(greatest(-0.5, least(1.0, {TERMS_SQL})), 9)::double AS reward FROM m")
def process_reward(spark, d):
    return completions(spark, d).select("conv_id", "turn", F.round(R.process_reward("prompt", "text", "tests"), 9).alias("reward"))


@query(f"""WITH {PROCESS_SQL}, w AS (SELECT i::int AS bucket, ({V.hash8_sql("'w' || i")} % 201 - 100) / 10000.0 AS weight FROM range(1024) t(i)),
dots AS (SELECT conv_id, turn, sum(weight) AS dot FROM (SELECT conv_id, turn, ({V.hash8_sql('t')} % 1024)::int AS bucket FROM
  (SELECT conv_id, turn, unnest(regexp_extract_all(lower('prompt=' || coalesce(prompt, '') || chr(10) || 'reasoning=' || reasoning || chr(10) || 'tests=' || tests || chr(10) || 'answer=' || answer), '[a-zA-Z_][a-zA-Z0-9_]+')) AS t FROM m)) JOIN w USING (bucket) GROUP BY ALL)
SELECT conv_id, turn, round(greatest(-0.5, least(1.0, {TERMS_SQL} + 0.6 * (1 / (1 + exp(-(coalesce(dot, 0) + 0.25))) - 0.5))), 6)::double AS reward FROM m LEFT JOIN dots USING (conv_id, turn)""")
def process_reward_learned(spark, d):
    """The process reward with a scorer's term: its model reads prompt, reasoning, tests and answer where the row is."""
    score = prm.scorer(fixed_weights(spark), 0.25, 1024)
    scored = completions(spark, d).withColumn("prm", score(R.process_record("prompt", "text", "tests")))
    return scored.select("conv_id", "turn", F.round(R.process_reward("prompt", "text", "tests", "prm"), 6).alias("reward"))


@query(f"""WITH {V.CANDIDATES}, s AS (SELECT *, score >= 1.99 AS ok, CASE WHEN score >= 1.99 THEN 1.0 WHEN score = 0.5 THEN 0.45 ELSE 0.1 END AS frac FROM candidates)
SELECT prompt_id, text, l_shipdate, l_quantity, l_extendedprice, round(greatest(-3.0, least(3.5, (CASE WHEN ok THEN 2.0 + CASE WHEN exec_time < 0.05 THEN 0.4 WHEN exec_time > 0.8 THEN -0.4 ELSE 0 END ELSE greatest(-0.2, 1.4 * frac) + CASE WHEN score = 0.5 THEN -0.4 ELSE -0.3 END END) * 1.01)), 9)::double AS reward FROM s""")
def execution_reward(spark, d):
    error = F.when(F.col("score") >= 1.99, "").when(F.col("score") == 0.5, "assertion").otherwise("runtime")
    c = V.candidates(spark, d).withColumn("error", error).withColumn("fraction", Q.score_fraction("score", "error"))
    reward = R.execution_reward(F.lit(True), F.lit(True), F.col("score") >= 1.99, "fraction", "exec_time", "error", 1, 100)
    return c.select("prompt_id", "text", "l_shipdate", "l_quantity", "l_extendedprice", F.round(reward, 9).alias("reward"))


@query(f"""WITH {V.FAILURES} SELECT event_id, CASE error_type {" ".join(f"WHEN '{k}' THEN '{p[0]}'" for k, p in repair.POLICIES.items())} ELSE '{repair.TYPE_POLICY[0]}' END AS policy,
CASE error_type {" ".join(f"WHEN '{k}' THEN {p[1]}" for k, p in repair.POLICIES.items())} ELSE 0.25 END::double AS temperature,
CASE error_type WHEN 'format' THEN least(12, greatest(greatest(1, rounds_used), 8)) WHEN 'syntax' THEN least(12, rounds_used + 1) WHEN 'timeout' THEN greatest(4, rounds_used - 1) ELSE greatest(1, rounds_used) END::int AS budget FROM failures""")
def repair_policies(spark, d):
    rows = V.failures(spark, d).withColumn("p", repair.repair_policy("error_type", F.lit("TypeError: x")))
    return rows.select("event_id", "p.policy", "p.temperature", repair.error_budget("error_type", "rounds_used").cast("int").alias("budget"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'security' WHEN 2 THEN 'security' WHEN 3 THEN 'security' WHEN 4 THEN 'syntax' ELSE '' END AS violation FROM documents")
def code_safety_flags(spark, d):
    """What a syntax tree says about programs of a few shapes that hold whole texts as literals."""
    shapes = ("import math\nx = {}", "import os\nx = {}", "eval({})", "x = {}.__class__", "def f({}:", "y = [{}]\ny.append(2)")
    docs = V.read(spark, d, "documents")
    literal = F.concat(F.lit("bytes.fromhex('"), F.hex(F.coalesce("text", F.lit("")).cast("binary")), F.lit("')"))
    code = F.replace(F.element_at(F.array(*[F.lit(c) for c in shapes]), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("{}"), literal)
    return docs.select("doc_id", verify.violations(code).alias("violation"))


@query(f"""WITH {V.CORPUS}, s AS (SELECT row_idx, prompt AS instruction, {V.strip_sql('answer')} AS output FROM corpus)
SELECT row_idx, '<|im_start|>system' || chr(10) || '{templates.SYSTEM_EVOL}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {V.strip_sql('instruction')} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<answer>' || chr(10) || output || chr(10) || '</answer><|im_end|>' AS text FROM s""")
def template_evol(spark, d):
    rows = V.corpus(spark, d).select("row_idx", F.col("prompt").alias("instruction"), F.col("answer").alias("output"))
    return templates.format_source(rows, "evol", "evol").select("row_idx", "text")


