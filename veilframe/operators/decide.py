"""Decisions: a purpose's proposals, and a log of what users decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.findings import looked_up
from veilframe.rules.tables import CERTAINTY, purposes


def proposed(findings: DataFrame, purpose: str, rules: DataFrame | None = None) -> DataFrame:
    """Undecided findings of band C with the purpose's proposal and its reason. rules (purpose,
    proposal_key, decision, reason) stand beside the given purposes; of two for one key theirs
    counts, so a user's purpose may be new or may change a given one."""
    given = purposes(findings.sparkSession)
    if rules is not None:
        rules = rules.select(*given.columns).dropDuplicates(["purpose", "proposal_key"])
        given = given.join(rules, ["purpose", "proposal_key"], "left_anti").unionByName(rules)
    rules = given.where(F.col("purpose") == purpose)
    rules = rules.select("proposal_key", F.col("decision").alias("to"), F.col("reason").alias("why"))
    rows = findings.join(rules, "proposal_key", "left")
    open_ = (F.col("band") == "C") & F.col("decision").isNull()
    takes = open_ & F.col("to").isNotNull()
    return rows.withColumns({
        "reason": F.when(open_, F.coalesce("why", F.lit(""))).otherwise(F.col("reason")),
        "proposed": F.col("proposed") | F.coalesce(takes, F.lit(False)),
        "proposed_by": F.when(takes, purpose).otherwise(F.col("proposed_by")),
        "default_decision": F.when(takes, F.col("to")).otherwise(F.col("default_decision")),
        "decision": F.when(takes, F.col("to")).otherwise(F.col("decision")),
    }).select(*findings.columns)


def decided(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings after a log of decisions (doc_id, step, op, target, decision): op is finding
    (target: page:seq), category (band C only), subject (a subject_key) or confirm (all
    proposals). For each finding the last step that fits counts."""
    own = F.concat_ws(":", "page", "seq")
    targets = findings.select(
        "doc_id", "page", "seq",
        F.explode(F.array(
            F.struct(F.lit("finding").alias("op"), own.alias("target")),
            F.struct(F.lit("category").alias("op"), F.when(F.col("band") == "C", F.col("category")).alias("target")),
            F.struct(F.lit("subject").alias("op"), F.col("subject_key").alias("target")),
        )).alias("t"),
    ).select("doc_id", "page", "seq", "t.op", "t.target").where("target is not null")
    last = targets.join(log, ["doc_id", "op", "target"]).groupBy("doc_id", "page", "seq").agg(F.max_by("decision", "step").alias("to"))
    confirmed = log.where("op = 'confirm'").select("doc_id", F.lit(True).alias("all")).distinct()
    rows = findings.join(last, ["doc_id", "page", "seq"], "left").join(confirmed, "doc_id", "left")
    changed = F.col("to").isNotNull()
    return rows.withColumns({
        "decision": F.coalesce("to", "decision"),
        "modified": F.when(changed, F.col("default_decision").isNotNull() & (F.col("default_decision") != F.col("to"))).otherwise(F.col("modified")),
        "confirmed": F.col("confirmed") | changed | (F.coalesce("all", F.lit(False)) & F.col("proposed")),
    }).select(*findings.columns)


def to_decide(findings: DataFrame) -> DataFrame:
    return findings.where("band = 'C' and decision is null")


def to_confirm(findings: DataFrame) -> DataFrame:
    return findings.where("proposed and not confirmed and not modified")


def certainty(findings: DataFrame) -> Column:
    """formal, contextual, statistical or manual."""
    grades = {d: grade for grade, names in CERTAINTY.items() for d in names}
    return (
        F.when(F.col("origin") == "manual", "manual")
        .when(F.col("origin") == "variant", "statistical")
        .when((F.col("detector") == "identity-page") & F.col("text").contains("machine-readable"), "formal")
        .otherwise(F.coalesce(looked_up(F.col("detector"), grades), F.lit("statistical")))
    )
