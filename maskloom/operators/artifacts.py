"""Artifact delivery: admission under budgets, pages, trimming to a response size, manifests and ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    """Limits of one request's artifacts."""

    page_size: int = 16
    page: int = 1
    max_debug: int = 12
    single_bytes: int = 200_000
    total_bytes: int = 900_000
    response_count: int = 20
    candidates: tuple[int, ...] | None = None


#: Stages whose artifacts belong to one candidate.
CANDIDATE_STAGES = ("label", "verify")

#: Essential artifacts of a stage are not debug output.
ESSENTIAL_STAGES = ("picture",)


def artifact_identity(name: str = "name") -> dict[str, Column]:
    """Candidate and question numbers in a name, null if it has none."""
    number = lambda p: F.expr(f"try_cast(nullif(regexp_extract({name}, '{p}', 1), '') as int)")
    return {"candidate": number("CANDIDATE-([0-9]+)"), "question": number("QUESTION-([0-9]+)")}


#: Stages by what a name in lower case begins with or holds, first match first; else the first stage of all.
STAGE_PREFIXES = {"visualization/": "visualization"}
STAGE_PARTS = {"clip-candidate-view-": "clip", "blip3-verification-": "blip3"}
FIRST_STAGE = "sam2"


def artifact_stage(name: str = "name") -> Column:
    """The stage that an artifact's name tells, whatever the case of its letters."""
    c, stage = F.lower(F.col(name)), F.lit(FIRST_STAGE)
    for part, of in reversed(STAGE_PARTS.items()):
        stage = F.when(c.contains(part), of).otherwise(stage)
    for prefix, of in reversed(STAGE_PREFIXES.items()):
        stage = F.when(c.startswith(prefix), of).otherwise(stage)
    return stage


def logical_name_ok(name: str = "name") -> Column:
    """Relative, without backslash, empty, `.` or `..` segments."""
    c = F.col(name)
    return (F.length(c) > 0) & ~c.contains("\\") & ~F.exists(F.split(c, "/"), lambda s: s.isin("", ".", ".."))


def first_offers(offers: DataFrame) -> DataFrame:
    """The first offer of each name; later ones are repeats."""
    order = Window.partitionBy("request_id", "name").orderBy("offer_seq")
    return offers.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def admit(offers: DataFrame, budget: Budget, stages: tuple[str, ...] | None = None) -> DataFrame:
    """Greedy admission of each request's offers in order; a refused offer uses up nothing.

    Stages, then candidates, then the page select; only selected offers count towards pages and budgets.

    A fold over the ordered offers of a request, in Catalyst: the state is what has been taken so far, which no
    running sum gives. A request's ledger is bounded by what a client may be told, so it fits a row, and its offers come out of the
    row that they were folded in.
    """
    rest = [c for c in offers.columns if c not in ("request_id", "offer_seq")]
    wanted_of = [artifact_identity()["candidate"].alias("candidate_")] if budget.candidates is not None else []
    ordered = F.array_sort(F.collect_list(F.struct("offer_seq", *rest, *wanted_of)))
    per = offers.groupBy("request_id").agg(ordered.alias("offers"))
    start = F.struct(F.lit(0).alias("selected"), F.lit(0).alias("debug"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("count"), F.array().cast("array<struct<status:string,page:int>>").alias("out"))

    def step(a, x):
        staged = x["stage"].isin(*stages) if stages else F.lit(True)
        wanted = F.lit(True)
        if budget.candidates is not None:
            wanted = ~x["stage"].isin(*CANDIDATE_STAGES) | F.coalesce(x["candidate_"].isin(*budget.candidates), F.lit(False))
        chosen = staged & wanted
        debug = ~x["stage"].isin(*ESSENTIAL_STAGES)
        page = F.when(chosen, ((a["selected"] - a["selected"] % budget.page_size) / budget.page_size).cast("int") + 1)
        status = (
            F.when(~staged, "stage_excluded").when(~wanted, "candidate_excluded").when(page != budget.page, "page_excluded").when(debug & (a["debug"] >= budget.max_debug), "omitted_debug_limit")
            .when(x["raw_bytes"] > budget.single_bytes, "omitted_single_size").when(a["total"] + x["raw_bytes"] > budget.total_bytes, "omitted_total_size")
            .when(a["count"] >= budget.response_count, "omitted_count").otherwise("delivered")
        )
        taken = status == "delivered"
        return F.struct(
            (a["selected"] + chosen.cast("int")).alias("selected"), (a["debug"] + (taken & debug).cast("int")).alias("debug"), (a["total"] + F.when(taken, x["raw_bytes"]).otherwise(0)).alias("total"), (a["count"] + taken.cast("int")).alias("count"),
            F.concat(a["out"], F.array(F.struct(status.alias("status"), page.alias("page")))).alias("out"),
        )

    folded = per.select("request_id", F.explode(F.arrays_zip("offers", F.aggregate("offers", start, step, lambda a: a["out"]).alias("out"))).alias("x"))
    return folded.select("request_id", "x.offers.offer_seq", *[f"x.offers.`{c}`" for c in rest], "x.out.status", "x.out.page")


def admit_replacing(offers: DataFrame, most: int = 20, single_bytes: int = 200_000, total_bytes: int = 900_000) -> DataFrame:
    """Admission where a later offer of a name replaces the earlier one, if it fits in its place: request_id, offer_seq, status.

    A replacement takes no further place in the count, and frees the bytes of what it replaces; one that does not fit leaves
    the earlier artifact stored. A fold per request over a map of what is stored.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offer_seq", "name", "raw_bytes")))
    per = offers.groupBy("request_id").agg(ordered.alias("offers"))
    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("held"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<offer_seq:int,status:string>>").alias("out"))

    def step(a, x):
        before = F.try_element_at(a["held"], x["name"])
        total = a["total"] - F.coalesce(before, F.lit(0)) + x["raw_bytes"]
        status = F.when(before.isNull() & (F.size(a["held"]) >= most), "omitted_count").when(x["raw_bytes"] > single_bytes, "omitted_single_size").when(total > total_bytes, "omitted_total_size").when(before.isNull(), "stored").otherwise("replaced")
        taken = status.isin("stored", "replaced")
        others = F.map_filter(a["held"], lambda k, v: k != x["name"])
        held = F.when(taken, F.map_concat(others, F.map_from_arrays(F.array(x["name"]), F.array(x["raw_bytes"])))).otherwise(a["held"])
        return F.struct(held.alias("held"), F.when(taken, total).otherwise(a["total"]).alias("total"), F.concat(a["out"], F.array(F.struct(x["offer_seq"].alias("offer_seq"), status.alias("status")))).alias("out"))

    return per.select("request_id", F.inline(F.aggregate("offers", start, step, lambda a: a["out"])))


def base64_bytes(raw: str = "raw_bytes") -> Column:
    return F.expr(f"4 * (({raw} + 2) div 3)")


def page_of(offers: DataFrame, page_size: int, stages: tuple[str, ...]) -> DataFrame:
    """Page of each selected offer: positions count selected offers only."""
    order = Window.partitionBy("request_id").orderBy("offer_seq")
    return offers.filter(F.col("stage").isin(*stages)).withColumn("seq", F.row_number().over(order)).withColumn("page", F.expr(f"(seq - 1) div {page_size} + 1").cast("int"))


def trim_to_fit(ledger: DataFrame, base_bytes: int, max_bytes: int) -> DataFrame:
    """Drop delivered optional artifacts from the end until base plus encoded bytes fit.

    An optional artifact goes just if the essential ones and the optional ones up to it are too much.
    """
    size = F.when(F.col("status") == "delivered", base64_bytes()).otherwise(0)
    essential = F.col("stage").isin(*ESSENTIAL_STAGES)
    per = Window.partitionBy("request_id")
    kept = F.sum(F.when(essential, size).otherwise(0)).over(per)
    upto = F.sum(F.when(essential, 0).otherwise(size)).over(per.orderBy("offer_seq").rowsBetween(Window.unboundedPreceding, 0))
    gone = (F.col("status") == "delivered") & ~essential & (kept + upto + base_bytes > max_bytes)
    rows = ledger.withColumns({"kept": kept, "gone": gone})
    failed = (F.col("kept") + base_bytes) > max_bytes
    return rows.withColumns({"final_status": F.when(F.col("gone"), "omitted_response_limit").otherwise(F.col("status")), "request_failed": failed}).drop("kept", "gone")


#: The parts of a response beside its records.
_FRAME = '{"delivered":[],"omitted":[],"delivered_count":,"omitted_count":,"truncated":}'


def trim_to_encoded_size(ledger: DataFrame, max_bytes: int) -> DataFrame:
    """Drop delivered optional artifacts from the end, one by one, until the response as it is written out fits.

    The response is {"delivered": [{name, stage, raw_bytes, data}], "omitted": [{name, stage, raw_bytes, reason}], "delivered_count",
    "omitted_count", "truncated"}, compact JSON in UTF-8. Dropping an artifact removes its record with the data and adds one of
    its omission, which can be the longer one; counts change in length too. The length after each cut comes from running sums of
    both kinds of records, and the cut that keeps most among those that fit is taken, as dropping one by one would. Adds final_status,
    response_bytes and request_failed (even the essential artifacts are too much; all optional ones are dropped then).
    """
    facts = ["name", "stage", "raw_bytes"]
    delivered = F.col("status") == "delivered"
    optional = delivered & ~F.col("stage").isin(*ESSENTIAL_STAGES)
    told = lambda reason: F.octet_length(F.to_json(F.struct(*facts, reason.alias("reason")))).cast("long")
    carried = F.octet_length(F.to_json(F.struct(*facts))).cast("long") + len(',"data":""') + base64_bytes()
    rows = ledger.withColumns({"carried": carried, "told": F.when(delivered, told(F.lit("omitted_response_limit"))).otherwise(told(F.col("status"))), "optional": optional, "fixed": delivered & ~optional, "left_out": ~delivered})
    per = Window.partitionBy("request_id")
    upto = per.orderBy("offer_seq").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda what, of, w: F.sum(F.when(F.col(of), what).otherwise(0)).over(w)
    one = F.lit(1)
    rows = rows.withColumns({
        "kept_n": total(one, "optional", upto), "kept_bytes": total(F.col("carried"), "optional", upto), "cut_bytes": total(F.col("told"), "optional", upto), "all_n": total(one, "optional", per), "all_told": total(F.col("told"), "optional", per),
        "fixed_n": total(one, "fixed", per), "fixed_bytes": total(F.col("carried"), "fixed", per), "out_n": total(one, "left_out", per), "out_bytes": total(F.col("told"), "left_out", per),
    })

    def size(n, kept, cut):
        """Bytes of the response with n optional artifacts of `kept` bytes, the others told in `cut` bytes."""
        d, o = F.col("fixed_n") + n, F.col("out_n") + F.col("all_n") - n
        digits = F.length(d.cast("string")) + F.length(o.cast("string")) + F.when(o > 0, 4).otherwise(5)
        return F.lit(len(_FRAME)) + digits + F.col("fixed_bytes") + kept + F.col("out_bytes") + cut + F.greatest(d - 1, F.lit(0)) + F.greatest(o - 1, F.lit(0))

    with_this = size(F.col("kept_n"), F.col("kept_bytes"), F.col("all_told") - F.col("cut_bytes"))
    bare = size(F.lit(0), F.lit(0), F.col("all_told"))
    # Most kept first; the length that goes with it.
    best = F.max(F.when(F.col("optional") & (with_this <= max_bytes), F.struct(F.col("kept_n").alias("n"), with_this.alias("bytes")))).over(per)
    rows = rows.withColumns({"bare": bare, "best": best})
    gone = F.col("optional") & (F.col("kept_n") > F.coalesce("best.n", F.lit(0)))
    return rows.select(*ledger.columns, F.when(gone, "omitted_response_limit").otherwise(F.col("status")).alias("final_status"), F.coalesce("best.bytes", "bare").alias("response_bytes"), (F.col("best").isNull() & (F.col("bare") > max_bytes)).alias("request_failed"))


def ledger_summary(ledger: DataFrame, *more: Column) -> DataFrame:
    """Counts and byte estimates per request. more: further aggregates of a request's rows, in the same pass."""
    done = F.col("status") == "delivered"
    total = lambda v: F.coalesce(F.sum(F.when(done, v)), F.lit(0))
    return ledger.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(~F.col("status").endswith("_excluded")).alias("selected"), F.count_if(done).alias("delivered"), F.count_if(F.col("status").startswith("omitted")).alias("omitted"),
        total(F.col("raw_bytes")).alias("raw_total"), total(base64_bytes()).alias("base64_total"), total(F.col("raw_bytes") + 128 + F.length("name")).alias("zip_total"), *more,
    )


def artifact_manifest(artifacts: DataFrame) -> DataFrame:
    """Members with content digests, and one digest of the ordered list per request."""
    member = F.concat_ws("|", "name", F.col("raw_bytes").cast("string"), "sha256")
    per = artifacts.groupBy("request_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    return per.select("request_id", F.size("m").alias("members"), F.sha2(F.array_join("m", "\n"), 256).alias("digest"))


def manifest_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members that differ as (name, size, digest) multisets."""
    cols = ["request_id", "name", "raw_bytes", "sha256"]
    count = lambda df, n: df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    both = count(left, "in_left").join(count(right, "in_right").hint("merge"), cols, "full").na.fill(0, ["in_left", "in_right"])
    return both.filter("in_left <> in_right")


def manifests_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many members stand on one side only."""
    cols = ["request_id", "name", "raw_bytes", "sha256"]
    sides = left.select(*cols, F.lit(1).alias("more")).unionByName(right.select(*cols, F.lit(-1).alias("more")))
    return surplus(sides, cols)


def surplus(sides: DataFrame, cols: list[str]) -> DataFrame:
    """One row: members of the left (more = 1) and of the right (-1) beyond those that the other side has, by one count of both."""
    over = sides.groupBy(*cols).agg(F.sum("more").alias("more"))
    total = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("long")
    return over.groupBy().agg(total(F.col("more")).alias("only_left"), total(-F.col("more")).alias("only_right"))


def conflicting_offers(offers: DataFrame) -> DataFrame:
    """Names offered again with other facts."""
    return offers.groupBy("request_id", "name").agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("raw_bytes", "stage").alias("facts")).filter("facts > 1")
