"""Grading case reports against ground truth.

Sets are handled in long form -- one row per (case, event id) -- so a case
citing millions of ids is as cheap as one citing five:

* the three id sets (report evidence, ground truth, distractors) are tagged
  and unioned, reduced per (case, id) -- the shuffle key includes the id, so
  a hot case is spread -- then counted per case, with partial aggregation
  before the shuffle;
* the per-case counts give hits (report ∩ truth), misses (truth − report),
  distractor hits (key evidence ∩ distractors), recall and Jaccard overlap.

The reference's overlap gate is recall: |report ∩ truth| / |truth| (empty
truth -> ``empty_truth_overlap``, 1.0 by default); Jaccard is also given.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcase.plans.sizing import broadcast_if_small

# The grading gates.
OVERLAP_GATE = 0.5
CONFIDENCE_GATE = 0.5
MAX_DISTRACTOR_HITS = 0


def jaccard(a: Column, b: Column) -> Column:
    """A5 on two array columns: |a ∩ b| / |a ∪ b|, both empty -> 1.0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_counts(report: DataFrame, truth: DataFrame, distractors: DataFrame) -> DataFrame:
    """Per case: n_report, n_truth, n_hits, n_key_distractor_hits.

    report: (case_id, event_id, is_key); truth and distractors: (case_id,
    event_id). Null ids are ignored; duplicates count once."""
    tagged = (
        report.where(F.col("event_id").isNotNull()).select(
            "case_id", "event_id", F.lit(1).alias("r"), F.col("is_key").cast("int").alias("k"),
            F.lit(0).alias("t"), F.lit(0).alias("d"))
        .unionByName(truth.where(F.col("event_id").isNotNull()).select(
            "case_id", "event_id", F.lit(0).alias("r"), F.lit(0).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("d")))
        .unionByName(distractors.where(F.col("event_id").isNotNull()).select(
            "case_id", "event_id", F.lit(0).alias("r"), F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("d")))
    )
    per_id = tagged.groupBy("case_id", "event_id").agg(
        F.max("r").alias("r"), F.max(F.coalesce("k", F.lit(0))).alias("k"), F.max("t").alias("t"),
        F.max("d").alias("d"))
    return per_id.groupBy("case_id").agg(
        F.sum("r").cast("bigint").alias("n_report"),
        F.sum("t").cast("bigint").alias("n_truth"),
        F.sum(F.col("r") * F.col("t")).cast("bigint").alias("n_hits"),
        F.sum(F.col("k") * F.col("d")).cast("bigint").alias("n_key_distractor_hits"))


def grade(cases: DataFrame, counts: DataFrame, empty_truth_overlap: float = 1.0) -> DataFrame:
    """G1-G5 per case. cases: (case_id, confidence, termination_reason,
    has_report). A case without report fails, it is not an error."""
    c = cases.join(counts, "case_id", "left")
    n_r, n_t, n_h = (F.coalesce(F.col(x), F.lit(0)) for x in ("n_report", "n_truth", "n_hits"))
    n_dh = F.coalesce(F.col("n_key_distractor_hits"), F.lit(0))
    recall = F.when(n_t == 0, F.lit(float(empty_truth_overlap))).otherwise(n_h / n_t)
    union = n_r + n_t - n_h
    jac = F.when(union == 0, F.lit(1.0)).otherwise(n_h / union)
    overlap_ok = recall >= OVERLAP_GATE
    distractor_ok = n_dh <= MAX_DISTRACTOR_HITS
    conf_ok = F.coalesce(F.col("confidence") >= CONFIDENCE_GATE, F.lit(False))
    return c.select(
        "case_id", n_r.alias("n_report"), n_t.alias("n_truth"), n_h.alias("n_hits"),
        (n_t - n_h).alias("n_misses"), n_dh.alias("n_key_distractor_hits"),
        recall.alias("overlap_recall"), jac.alias("overlap_jaccard"),
        overlap_ok.alias("overlap_ok"), distractor_ok.alias("distractor_ok"), conf_ok.alias("confidence_ok"),
        (F.coalesce(F.col("has_report"), F.lit(False)) & (F.col("termination_reason") == "submitted")
         & overlap_ok & distractor_ok & conf_ok).alias("passed"))


def evidence_context(evidence: DataFrame, events: DataFrame, k: int = 3,
                     broadcast_max_rows: int = 2_000_000) -> DataFrame:
    """Up to ``k`` lines before and after each cited (file, line).

    Each citation is exploded to its 2k neighbour positions and equi-joined to
    the events on (file, line). When the wanted positions are provably few
    (case-file citations) they are broadcast and the store is only scanned;
    otherwise both sides shuffle on a key that is unique per event, so there
    is no hot key. No window over the whole log. Lists are ordered by line and
    hold redacted messages.
    evidence: (evidence_id, file, line) -> (evidence_id, context_before,
    context_after) as arrays of msg."""
    offs = F.array(*[F.lit(o) for o in list(range(-k, 0)) + list(range(1, k + 1))])
    want = evidence.select("evidence_id", "file", F.col("line").alias("cited"), F.explode(offs).alias("off")) \
        .withColumn("line", F.col("cited") + F.col("off"))
    want = broadcast_if_small(want, broadcast_max_rows if k > 0 else 0)
    got = events.select("file", "line", "msg").join(want, ["file", "line"])
    ctx = got.groupBy("evidence_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("off") < 0, F.struct("line", "msg")))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("off") > 0, F.struct("line", "msg")))).alias("a"))
    out = evidence.select("evidence_id").join(ctx, "evidence_id", "left")
    return out.select("evidence_id",
                      F.coalesce(F.transform("b", lambda x: x["msg"]), F.array().cast("array<string>")).alias("context_before"),
                      F.coalesce(F.transform("a", lambda x: x["msg"]), F.array().cast("array<string>")).alias("context_after"))
