"""Queries over embeddings: scores, ranks, routes, rules and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import nfkc_token
from ..operators import scoring as ops
from ..operators.reports import stage_funnel
from .base import query
from .fixtures import BASE, CANDS_SQL, PROMPTS_SQL, duck, prompts, scored_candidates, table
from .masks import ORDERED_SQL, judged_of

POLICY = ops.RoutePolicy(targets=("c3", "c1"), uncertain=("c5",), top_k=2, margin=0.05, minimum=0.3, cap=4)
RULES = [
    ops.VerifyRule("any", "Is it anything?", kind="any", threshold=0.2, true_label="something", false_label="nothing"),
    ops.VerifyRule("c1", "Is it a c1?", true_label="c1", false_label="other"),
    ops.VerifyRule("c3", "Is it a c3?", true_label="c3", false_label="other"),
]

SCORES_SQL = """
scores AS (SELECT image_id, source_index, class_order, class_id, prompt_index, round_even(greatest(least(
    list_reduce(list_prepend(0.0e0, list_transform(list_zip(CAST(c.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), lambda z: z[1] * z[2])), lambda a, b: a + b)
    / (sqrt(list_reduce(list_prepend(0.0e0, list_transform(CAST(c.embedding AS DOUBLE[]), lambda z: z * z)), lambda a, b: a + b)) * sqrt(list_reduce(list_prepend(0.0e0, list_transform(CAST(p.embedding AS DOUBLE[]), lambda z: z * z)), lambda a, b: a + b))), 1.0e0), -1.0e0), 6) AS score
  FROM cands c CROSS JOIN prompts p)
"""
RANKED_SQL = """
cls AS (SELECT image_id, source_index, class_order, class_id, max(score) AS score, CAST(-max([score, -prompt_index])[2] AS INT) AS winning_prompt_index FROM scores GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id, source_index ORDER BY score DESC, class_order) AS INT) AS rank FROM cls)
"""
ROUTES_SQL = """
tgt AS (SELECT image_id, source_index, arg_max(class_id, [score, CASE class_id WHEN 'c3' THEN -1 ELSE -2 END]) AS target, max(score) AS target_score, arg_max(rank, [score, CASE class_id WHEN 'c3' THEN -1 ELSE -2 END]) AS target_rank FROM ranked WHERE class_id IN ('c3', 'c1') GROUP BY ALL),
win AS (SELECT image_id, source_index, class_id AS winner, score AS top FROM ranked WHERE rank = 1),
rts AS (SELECT *, top - target_score AS delta, list_filter([CASE WHEN target_rank = 1 THEN 'target_top_1' END, CASE WHEN target_rank <= 2 THEN 'target_in_top_k' END,
   CASE WHEN top - target_score <= 0.05e0 + 1e-12 THEN 'target_within_score_margin' END, CASE WHEN target_score >= 0.3e0 THEN 'target_exceeded_minimum_score' END, CASE WHEN winner = 'c5' THEN 'explicitly_uncertain' END], lambda x: x IS NOT NULL) AS reasons
  FROM win LEFT JOIN tgt USING (image_id, source_index)),
routed AS (SELECT *, len(reasons) > 0 AS routed, coalesce(reasons[1], 'clear_negative') AS reason FROM rts),
placed AS (SELECT *, row_number() OVER (PARTITION BY image_id, routed ORDER BY target_score DESC NULLS LAST, source_index) AS place FROM routed),
capped AS (SELECT image_id, source_index, winner, top, target, target_score, routed, reason AS reason_before_cap, CASE WHEN NOT routed THEN 'not_routed' WHEN place > 4 THEN 'capped_out' ELSE 'retained' END AS outcome,
  CASE WHEN routed AND place > 4 THEN 'max_candidate_limit' ELSE reason END AS reason, routed AND place <= 4 AS verify, place, reasons FROM placed)
"""
SCORING = (PROMPTS_SQL, CANDS_SQL, SCORES_SQL)
ROUTING = (*SCORING, RANKED_SQL, ROUTES_SQL)

#: Raw answers, some with tabs and line ends around them.
ANSWERS = ["Yes", " no! ", "YES.", "maybe?", "No", "yes and no", "Yes\n", "\t no.\r\n"]
ANSWERS_SQL = "(['Yes', ' no! ', 'YES.', 'maybe?', 'No', 'yes and no', 'Yes' || chr(10), chr(9) || ' no.' || chr(13) || chr(10)])[(image_id * 10 + source_index) % 8 + 1]"


def token_sql(text: str) -> str:
    """Outer white space gone, final punctuation gone, white space before it gone."""
    space = r"[\x09-\x0D\x1C-\x20]"
    stripped = lambda t: f"regexp_replace({t}, '^{space}+|{space}+$', '', 'g')"
    return stripped(f"regexp_replace({stripped(f'lower({text})')}, '[.!?,;:]+$', '')")


def scores_of(spark, sf_dir):
    return ops.score_prompts(scored_candidates(spark, sf_dir), prompts(spark, sf_dir))


def ranked_of(spark, sf_dir):
    return ops.rank_classes(ops.class_max(scores_of(spark, sf_dir)))


def routes_of(spark, sf_dir):
    return ops.cap_routed(ops.route_reasons(ops.score_vector(ranked_of(spark, sf_dir)), POLICY), POLICY.cap)


def with_answers(matches):
    at = (F.col("image_id") * 10 + F.col("source_index")) % len(ANSWERS)
    return matches.withColumn("raw_answer", F.get(F.array(*[F.lit(a) for a in ANSWERS]), at.cast("int")))


@query("jon01_score_prompts", duck(*SCORING) + " SELECT image_id, source_index, class_id, prompt_index, score FROM scores")
def jon01(spark, sf_dir):
    return scores_of(spark, sf_dir).select("image_id", "source_index", "class_id", "prompt_index", "score")


@query("agg04_prompt_summary", duck(PROMPTS_SQL) + " SELECT class_order, class_id, count(*) AS prompts FROM prompts GROUP BY ALL")
def agg04(spark, sf_dir):
    return ops.prompt_summary(prompts(spark, sf_dir))


@query("agg05_class_max", duck(*SCORING, RANKED_SQL) + " SELECT * FROM cls")
def agg05(spark, sf_dir):
    return ops.class_max(scores_of(spark, sf_dir))


@query("agg06_score_vector", duck(*SCORING, RANKED_SQL) + " SELECT image_id, source_index, string_agg(class_id || '=' || printf('%.6f', score), ',' ORDER BY class_order) AS scores, arg_min(class_id, rank) AS winner FROM ranked GROUP BY ALL")
def agg06(spark, sf_dir):
    v = ops.score_vector(ranked_of(spark, sf_dir))
    text = F.transform("scores", lambda s: F.concat(s["class_id"], F.lit("="), F.call_function("format_number", s["score"], F.lit("0.000000"))))
    return v.select("image_id", "source_index", F.array_join(text, ",").alias("scores"), "winner")


@query("win03_rank_classes", duck(*SCORING, RANKED_SQL) + " SELECT image_id, source_index, class_id, score, rank FROM ranked")
def win03(spark, sf_dir):
    return ranked_of(spark, sf_dir).select("image_id", "source_index", "class_id", "score", "rank")


@query("top02_classes_in_top_k", duck(*SCORING, RANKED_SQL) + " SELECT image_id, source_index, class_id, rank FROM ranked WHERE rank <= 3")
def top02(spark, sf_dir):
    return ops.classes_in_top_k(ranked_of(spark, sf_dir), 3).select("image_id", "source_index", "class_id", "rank")


@query("scl04_route_reasons", duck(*ROUTING) + " SELECT image_id, source_index, winner, target, target_score, routed, reason, array_to_string(reasons, ',') AS reasons FROM routed")
def scl04(spark, sf_dir):
    r = ops.route_reasons(ops.score_vector(ranked_of(spark, sf_dir)), POLICY)
    return r.select("image_id", "source_index", "winner", "target", "target_score", "routed", "reason", F.array_join("reasons", ",").alias("reasons"))


@query("win04_cap_routed", duck(*ROUTING) + " SELECT image_id, source_index, target, target_score, outcome, reason, reason_before_cap FROM capped")
def win04(spark, sf_dir):
    return routes_of(spark, sf_dir).select("image_id", "source_index", "target", "target_score", "outcome", "reason", "reason_before_cap")


@query("top01_top_k_per_image", duck(*ROUTING) + " SELECT image_id, source_index, target, target_score, CAST(place AS INT) AS place FROM capped WHERE routed AND place <= 2")
def top01(spark, sf_dir):
    r = ops.route_reasons(ops.score_vector(ranked_of(spark, sf_dir)), POLICY)
    return ops.top_k_per_image(r, 2).select("image_id", "source_index", "target", "target_score", "place")


_VERIFIED_SQL = f"""
vq AS (SELECT *, {ANSWERS_SQL} AS raw_answer, CAST(row_number() OVER (PARTITION BY image_id ORDER BY source_index) AS INT) AS question_number FROM capped WHERE verify AND target IN ('c1', 'c3')),
vt AS (SELECT *, {token_sql('raw_answer')} AS tok FROM vq),
va AS (SELECT *, CASE tok WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' ELSE 'unmatched_answer' END AS status, CASE WHEN tok = 'yes' THEN target ELSE 'other' END AS new_label FROM vt)
"""


def verified_of(spark, sf_dir):
    return with_answers(ops.match_routed_rule(routes_of(spark, sf_dir), ops.rules_table(spark, RULES)))


@query("jon02_routed_rules", duck(*ROUTING, _VERIFIED_SQL) + " SELECT image_id, source_index, target, 'Is it a ' || target || '?' AS question FROM vq")
def jon02(spark, sf_dir):
    return verified_of(spark, sf_dir).select("image_id", "source_index", "target", "question")


@query("scl02_map_answers", duck(*ROUTING, _VERIFIED_SQL) + " SELECT image_id, source_index, raw_answer, status, new_label FROM va")
def scl02(spark, sf_dir):
    status, label = ops.map_answer()
    return verified_of(spark, sf_dir).select("image_id", "source_index", "raw_answer", status.alias("status"), label.alias("new_label"))


#: Casefolding differs from lower case in one letter of the given texts, and none of their letters has another compatibility form.
@query("scl01_normalized_tokens", f"SELECT conv_id, turn, {token_sql("replace(text, 'ß', 'ss')")} AS token FROM conversations")
def scl01(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nfkc_token("text").alias("token"))


@query("scl03_substring_answers", duck(*ROUTING, _VERIFIED_SQL) + """
SELECT image_id, source_index, CASE WHEN contains(lower(raw_answer), 'no') THEN 'false' WHEN contains(lower(raw_answer), 'yes') THEN 'true' ELSE 'unmatched_answer' END AS status,
  CASE WHEN contains(lower(raw_answer), 'no') THEN 'other' WHEN contains(lower(raw_answer), 'yes') THEN target ELSE winner END AS new_label FROM vq""")
def scl03(spark, sf_dir):
    status, label = ops.map_answer_substring("winner")
    return verified_of(spark, sf_dir).select("image_id", "source_index", status.alias("status"), label.alias("new_label"))


@query("scl16_verification_query", duck(*ROUTING, _VERIFIED_SQL) + """ SELECT image_id, source_index, '[TARGET QUESTION]' || chr(10) || 'Is it a ' || target || '?' || chr(10) || '[/TARGET QUESTION]' || chr(10)
  || 'The unblurred region inside the yellow boundary is the selected candidate. The blurred surroundings are context only. Answer exactly Yes or No.' AS text FROM vq""")
def scl16(spark, sf_dir):
    return verified_of(spark, sf_dir).select("image_id", "source_index", ops.verification_query().alias("text"))


@query("win11_question_numbers", duck(*ROUTING, _VERIFIED_SQL) + " SELECT image_id, source_index, question_number FROM vq")
def win11(spark, sf_dir):
    return ops.number_questions(verified_of(spark, sf_dir)).select("image_id", "source_index", "question_number")


@query("agg08_planned_questions", duck(*ROUTING, _VERIFIED_SQL) + " SELECT image_id, count(*) AS questions, count(*) > 3 AS refused FROM vq GROUP BY image_id")
def agg08(spark, sf_dir):
    return ops.planned_questions(verified_of(spark, sf_dir), 3)


@query("jon03_threshold_rules", duck(*ROUTING) + " SELECT image_id, source_index, winner, top AS winner_score, 'any' AS rule_name FROM capped WHERE top <= 0.2")
def jon03(spark, sf_dir):
    v = ops.score_vector(ranked_of(spark, sf_dir))
    return ops.match_threshold_rules(v, ops.rules_table(spark, RULES)).select("image_id", "source_index", "winner", "winner_score", "rule_name")


@query("jon04_label_rules", duck(*ROUTING) + f"""
SELECT image_id, source_index, winner, winner AS rule_name FROM capped WHERE winner IN ('c1', 'c3') AND NOT (top <= 0.2 AND {token_sql(ANSWERS_SQL)} IN ('yes', 'no'))""")
def jon04(spark, sf_dir):
    v, rules = ops.score_vector(ranked_of(spark, sf_dir)), ops.rules_table(spark, RULES)
    asked = with_answers(ops.match_threshold_rules(v, rules))
    settled = asked.filter(ops.map_answer()[0] != "unmatched_answer")
    return ops.match_label_rules(v, rules, settled).select("image_id", "source_index", "winner", "rule_name")


@query("agg03_stage_funnel", duck(*BASE, ORDERED_SQL, *ROUTING, _VERIFIED_SQL) + """
SELECT image_id, unnest(['raw', 'non_empty', 'after_geometry']) AS stage, unnest([count(*), count(*) FILTER (area > 0), count(*) FILTER (reason IS NULL)]) AS n FROM reasoned GROUP BY image_id
UNION ALL SELECT image_id, unnest(['scored', 'initially_routed', 'after_cap', 'verified', 'final']) AS stage, unnest([n, r, c, v, f]) AS n FROM (
  SELECT image_id, count(*) AS n, count(*) FILTER (routed) AS r, count(*) FILTER (verify) AS c, count(status) AS v, count(*) FILTER (status = 'true') AS f FROM capped LEFT JOIN (SELECT image_id, source_index, status FROM va) USING (image_id, source_index) GROUP BY image_id)""")
def agg03(spark, sf_dir):
    before = stage_funnel({"raw": F.lit(True), "non_empty": F.col("area") > 0, "after_geometry": F.col("reason").isNull()}, judged_of(spark, sf_dir))
    v = verified_of(spark, sf_dir).select("image_id", "source_index", ops.map_answer()[0].alias("status"))
    r = routes_of(spark, sf_dir).select("image_id", "source_index", "routed", "verify").join(v.hint("merge"), ["image_id", "source_index"], "left")
    after = stage_funnel({"scored": F.lit(True), "initially_routed": F.col("routed"), "after_cap": F.col("verify"), "verified": F.col("status").isNotNull(), "final": F.col("status") == "true"}, r)
    return before.unionByName(after)


@query("scl13_normalized_vectors", duck(CANDS_SQL) + """,
n AS (SELECT image_id, source_index, CAST(embedding AS DOUBLE[]) AS v FROM cands), s AS (SELECT *, sqrt(list_reduce(list_prepend(0.0e0, list_transform(v, lambda z: z * z)), lambda a, b: a + b)) AS z FROM n)
SELECT image_id, source_index, round_even(v[1] / z, 9) AS first, round_even(v[64] / z, 9) AS last, CAST(len(v) AS INT) AS n FROM s""")
def scl13(spark, sf_dir):
    c = scored_candidates(spark, sf_dir).withColumn("v", ops.l2_normalize("embedding"))
    return c.select("image_id", "source_index", F.bround(F.get("v", F.lit(0)), 9).alias("first"), F.bround(F.get("v", F.lit(63)), 9).alias("last"), F.size("v").alias("n"))
