"""Zero-shot scores: candidates against class prompts, ranking, routing under a cap, verification rules and answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_token

KEY = ["image_id", "source_index"]

#: Prompts that are sent round at once; more are dealt in blocks.
PROMPT_BLOCK = 4096

#: Most bytes of prompts' vectors in a block.
PROMPT_BYTES = 32 << 20


@dataclass(frozen=True)
class RoutePolicy:
    """Which candidates go to verification."""

    targets: tuple[str, ...]
    uncertain: tuple[str, ...] = ()
    top_k: int | None = None
    margin: float | None = None
    minimum: float | None = None
    cap: int | None = None


@dataclass(frozen=True)
class VerifyRule:
    """A question and what its answers mean; `any` rules apply up to a threshold, label rules to their label."""

    name: str
    question: str
    true_token: str = "yes"
    false_token: str = "no"
    true_label: str | None = None
    false_label: str | None = None
    threshold: float | None = None
    kind: str = field(default="label")


def doubles(col: str) -> Column:
    return F.transform(F.col(col), lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Left-to-right sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(col: str) -> Column:
    """x / |x|; null for a zero vector."""
    v = doubles(col)
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def cosine(a: str, b: str) -> Column:
    """Cosine in [-1, 1]; null if a vector is zero."""
    x, y = doubles(a), doubles(b)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(size > 0, F.greatest(F.least(dot(x, y) / size, F.lit(1.0)), F.lit(-1.0)))


def score_prompts(cands: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every candidate against every prompt, to six decimals half-even so that ties agree everywhere."""
    # Norms are worked out once a row, before vectors meet: a pair costs one dot product.
    norm = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    p = prompts.select("class_order", "class_id", "prompt_index", doubles("embedding").alias("p")).withColumn("p_norm", norm("p"))
    c = cands.select(*KEY, doubles("embedding").alias("c")).withColumn("c_norm", norm("c"))
    n, size = p.agg(F.count(F.lit(1)), F.sum(F.size("p") * 8 + F.octet_length("class_id") + 64)).first()
    tasks = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.repartition(tasks, *KEY)
    # Blocks of prompts that may be sent round, by number and bytes; every candidate meets every block.
    blocks = max(-(-n // PROMPT_BLOCK), -(-(size or 0) // PROMPT_BYTES))
    if blocks > 1:
        # A block is met in many places: candidates of a block are dealt by their own hash, and the block goes to each share.
        p = p.withColumns({"block": F.pmod(F.xxhash64("class_order", "prompt_index"), F.lit(blocks)).cast("int"), "share": F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))})
        dealt = c.withColumns({"share": F.pmod(F.xxhash64(*KEY), F.lit(tasks)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        both = dealt.join(p.hint("merge"), ["block", "share"])
    else:
        both = c.crossJoin(F.broadcast(p))
    size = F.col("c_norm") * F.col("p_norm")
    score = F.when(size > 0, F.greatest(F.least(dot(F.col("c"), F.col("p")) / size, F.lit(1.0)), F.lit(-1.0)))
    return both.select(*KEY, "class_order", "class_id", "prompt_index", F.bround(score, 6).alias("score"))


def class_max(scores: DataFrame) -> DataFrame:
    """Best prompt per class; ties to the lowest prompt index."""
    best = F.max(F.struct("score", (-F.col("prompt_index")).alias("minus")))
    return scores.groupBy(*KEY, "class_order", "class_id").agg(best.alias("b")).select(*KEY, "class_order", "class_id", F.col("b.score").alias("score"), (-F.col("b.minus")).alias("winning_prompt_index"))


def rank_classes(class_scores: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "class_order")
    return class_scores.withColumn("rank", F.row_number().over(order))


def classes_in_top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def score_vector(ranked: DataFrame) -> DataFrame:
    """All scores of a candidate in class order, with its winner."""
    vec = F.array_sort(F.collect_list(F.struct("class_order", "class_id", "score", "rank")))
    return ranked.groupBy(*KEY).agg(vec.alias("scores")).withColumn("winner", F.get(F.filter("scores", lambda s: s["rank"] == 1), F.lit(0))["class_id"])


def route_reasons(vectors: DataFrame, policy: RoutePolicy) -> DataFrame:
    """Reasons for which a candidate is routed, the first of them, and the target it is asked about."""
    targets = F.array(*[F.lit(t) for t in policy.targets])
    mine = F.filter("scores", lambda s: F.array_contains(targets, s["class_id"]))
    top = F.get(F.filter("scores", lambda s: s["rank"] == 1), F.lit(0))["score"]
    # Best-scoring target; ties go to the target list's order.
    best = F.array_max(F.transform(mine, lambda s: F.struct(s["score"].alias("score"), (-F.array_position(targets, s["class_id"])).alias("place"), s["class_id"].alias("class_id"), s["rank"].alias("rank"))))
    v = vectors.withColumns({"target": best["class_id"], "target_score": best["score"], "target_rank": best["rank"], "delta": top - best["score"]})
    found = [F.when(F.col("target_rank") == 1, "target_top_1")]
    if policy.top_k is not None:
        found.append(F.when(F.col("target_rank") <= policy.top_k, "target_in_top_k"))
    if policy.margin is not None:
        found.append(F.when(F.col("delta") <= policy.margin + 1e-12, "target_within_score_margin"))
    if policy.minimum is not None:
        found.append(F.when(F.col("target_score") >= policy.minimum, "target_exceeded_minimum_score"))
    if policy.uncertain:
        found.append(F.when(F.col("winner").isin(*policy.uncertain), "explicitly_uncertain"))
    v = v.withColumn("reasons", F.array_compact(F.array(*found)))
    return v.withColumns({"routed": F.size("reasons") > 0, "reason": F.coalesce(F.get("reasons", F.lit(0)), F.lit("clear_negative"))})


def cap_routed(routes: DataFrame, cap: int | None) -> DataFrame:
    """The best `cap` routed candidates per image stay; the rest keep their former reason beside max_candidate_limit."""
    order = Window.partitionBy("image_id", "routed").orderBy(F.col("target_score").desc_nulls_last(), "source_index")
    place = F.row_number().over(order)
    over = F.col("routed") & (F.col("place") > cap) if cap is not None else F.lit(False)
    outcome = F.when(~F.col("routed"), "not_routed").when(over, "capped_out").otherwise("not_applied" if cap is None else "retained")
    return routes.withColumn("place", place).withColumns({"outcome": outcome, "reason_before_cap": F.col("reason"), "reason": F.when(over, "max_candidate_limit").otherwise(F.col("reason")), "verify": F.col("routed") & ~over}).drop("place")


def top_k_per_image(routes: DataFrame, k: int) -> DataFrame:
    """Only the best k routed candidates: the filter on row_number lets Spark cut each partition first."""
    order = Window.partitionBy("image_id").orderBy(F.col("target_score").desc_nulls_last(), "source_index")
    return routes.filter("routed").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def rules_table(spark, rules: list[VerifyRule]) -> DataFrame:
    rows = [(k, r.name, r.kind, r.threshold, r.question, r.true_token, r.false_token, r.true_label, r.false_label) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_order int, rule_name string, kind string, threshold double, question string, true_token string, false_token string, true_label string, false_label string")


def measured(rules: DataFrame) -> int:
    """Bytes of a table of rules, about."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rules.schema.fields if f.dataType.simpleString() == "string"]
    return rules.agg(F.sum(sum(texts, F.lit(64)))).first()[0] or 0


def by_size(rules: DataFrame) -> DataFrame:
    """Rules that are sent round if they are few, and meet by a merge join otherwise."""
    return rules.hint("broadcast" if measured(rules) <= PROMPT_BYTES else "merge")


def match_routed_rule(routes: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of the chosen target, for candidates that are verified."""
    return routes.filter("verify").join(by_size(rules.filter("kind = 'label'")), F.col("target") == F.col("rule_name"))


def match_threshold_rules(vectors: DataFrame, rules: DataFrame) -> DataFrame:
    """The first `any` rule, in order, whose threshold the winner's score does not exceed.

    Only rules with a higher threshold than all before them can be a first one; these are sent round, and must fit.
    """
    earlier = F.max("threshold").over(Window.orderBy("rule_order").rowsBetween(Window.unboundedPreceding, -1))
    steps = rules.filter("kind = 'any' AND threshold IS NOT NULL").withColumn("earlier", earlier).filter("earlier IS NULL OR threshold > earlier").drop("earlier")
    if measured(steps) > PROMPT_BYTES:
        raise ValueError("too many threshold rules to be sent round")
    top = F.get(F.filter("scores", lambda s: s["rank"] == 1), F.lit(0))["score"]
    hit = vectors.withColumn("winner_score", top).join(F.broadcast(steps), F.col("winner_score") <= F.col("threshold"))
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("rule_order"))
    return hit.withColumn("n", first).filter("n = 1").drop("n")


def match_label_rules(vectors: DataFrame, rules: DataFrame, settled: DataFrame) -> DataFrame:
    """Label rules of the winners that no `any` rule has settled."""
    open_ones = vectors.join(settled.select(*KEY).hint("merge"), KEY, "left_anti")
    return open_ones.join(by_size(rules.filter("kind = 'label'")), F.col("winner") == F.col("rule_name"))


def normalize_token(col: str) -> Column:
    """Lower case, outer white space and final punctuation gone. For ASCII; functions.text.nfkc_token has the form for any text."""
    return plain_token(F.col(col))


def map_answer(answer: str = "raw_answer") -> tuple[Column, Column]:
    """Status and label by exact token: true first, and what matches neither counts as false."""
    t = normalize_token(answer)
    yes, no = t == normalize_token("true_token"), t == normalize_token("false_token")
    return F.when(yes, "true").when(no, "false").otherwise("unmatched_answer"), F.when(yes, F.col("true_label")).otherwise(F.col("false_label"))


def map_answer_substring(label: str, answer: str = "raw_answer") -> tuple[Column, Column]:
    """Status and label by substring: false first; without a match the label stays."""
    t = F.lower(F.col(answer))
    no, yes = F.contains(t, F.lower("false_token")), F.contains(t, F.lower("true_token"))
    return F.when(no, "false").when(yes, "true").otherwise("unmatched_answer"), F.when(no, F.coalesce("false_label", F.lit("negative"))).when(yes, F.coalesce("true_label", F.col(label))).otherwise(F.col(label))


#: Fixed value: what a question is asked with.
INSTRUCTION = "The unblurred region inside the yellow boundary is the selected candidate. The blurred surroundings are context only. Answer exactly Yes or No."


def verification_query(question: str = "question") -> Column:
    """The question in its marks, then the fixed instruction."""
    return F.concat(F.lit("[TARGET QUESTION]\n"), F.col(question), F.lit(f"\n[/TARGET QUESTION]\n{INSTRUCTION}"))


def number_questions(matches: DataFrame) -> DataFrame:
    return matches.withColumn("question_number", F.row_number().over(Window.partitionBy("image_id").orderBy("source_index")))


def planned_questions(matches: DataFrame, limit: int) -> DataFrame:
    """Questions per image, and whether the image is over the limit and so refused as a whole."""
    return matches.groupBy("image_id").agg(F.count(F.lit(1)).alias("questions")).withColumn("refused", F.col("questions") > limit)


def prompt_summary(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("class_order", "class_id").agg(F.count(F.lit(1)).alias("prompts"))
