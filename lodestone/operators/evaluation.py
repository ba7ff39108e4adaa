"""Evaluation of answers: cases and samples, rates by turn, traffic of tools, submissions, and the citation policy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ledger import citation_status, ledgers

# Fixed value: the least likeness of a damaged id to the one it is taken for.
ID_LIKENESS = 0.75
# Turns whose refusals are judged.
JUDGED_REFUSALS = ("ANSWERABLE", "UNANSWERABLE")


def metric_means(scores: DataFrame) -> DataFrame:
    """``metric, mean, n`` of ``metric, value``, null values aside; a name loses its ``Evaluator`` and its case."""
    name = F.lower(F.replace("metric", F.lit("Evaluator"), F.lit(""))).alias("metric")
    return scores.where("value is not null").groupBy(name).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def only_cases(corpus: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows whose ``id`` is among ``ids``; all without such a table."""
    return corpus if ids is None else corpus.join(ids.select("id"), "id", "left_semi")


def only_pictured(samples: DataFrame) -> DataFrame:
    """Samples whose ``source_type`` speaks of images."""
    return samples.where(F.contains("source_type", F.lit("image")))


def attach_relevant(cases: DataFrame, samples: DataFrame) -> DataFrame:
    """``cases`` with ``relevant_uris`` of the sample with their ``question``; of several not skipped the last ``seq`` counts."""
    last = samples.where(~F.coalesce("skip", F.lit(False))).groupBy("question").agg(F.max_by("uris", "seq").alias("relevant_uris"))
    return cases.join(last, "question", "left")


def resume_plan(corpus: DataFrame, meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """``corpus`` with ``action, old_id``: skip a uri whose document has chunks, replace one without, import the others."""
    whole = meta.join(chunks.select(F.col("document_id").alias("id")), "id", "left_semi").select("uri", F.lit(True).alias("_whole")).distinct()
    bare = meta.join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti").groupBy("uri").agg(F.max("id").alias("_bare"))
    both = corpus.join(whole, "uri", "left").join(bare, "uri", "left")
    action = F.when(F.col("_whole"), "skip").when(F.col("_bare").isNotNull(), "replace").otherwise("import")
    return both.withColumns({"action": action, "old_id": F.when(action == "replace", F.col("_bare"))}).drop("_whole", "_bare")


def turn_rates(turns: DataFrame) -> DataFrame:
    """Rates of a conversation from ``conv_id, turn, passed, label, refused, cited_ap``, and ``keys``, a map of verdicts by turn.

    Turns are numbered from 1. A null verdict is an error of the judge and not counted; refusals count for the labels of
    ``JUDGED_REFUSALS`` only. ``cited_ap`` is null for turns without relevant documents, ``cited_map`` if all are.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("string")
    refused = F.when(F.col("label").isin(*JUDGED_REFUSALS), F.col("refused"))
    key = lambda name, v: F.struct(F.concat(F.lit("turn_"), nth, F.lit(f"_{name}")).alias("k"), v.cast("string").alias("v"))
    told = turns.withColumns({"_refused": refused, "_keys": F.filter(F.array(key("pass", F.col("passed")), key("refused", refused), key("cited_ap", F.col("cited_ap"))), lambda s: s["v"].isNotNull())})
    lacking = F.col("label") == "UNANSWERABLE"
    per = told.groupBy("conv_id").agg(
        F.count_if("passed").alias("turns_passed"), F.count("passed").alias("turns_judged"), F.count("*").alias("turns_total"), F.count("cited_ap").alias("cited_eligible"),
        F.round(F.avg("cited_ap"), 6).alias("cited_map"), F.count_if(lacking & F.col("_refused")).alias("true_refusals"), F.count_if(~lacking & F.col("_refused")).alias("false_refusals"),
        F.count_if(lacking & F.col("_refused").isNotNull()).alias("unanswerable_turns"), F.map_from_entries(F.flatten(F.collect_list("_keys"))).alias("keys"),
    )
    return per.withColumn("turn_pass_rate", F.round(F.coalesce(F.try_divide("turns_passed", "turns_judged"), F.lit(0.0)), 6))


def tool_traffic(parts: DataFrame, namespace: str, tools: list[str]) -> DataFrame:
    """``run, n_search_calls, n_rejected_searches, n_failed_tools, n_requests`` from the parts of the messages of a run.

    Parts are ``run, message, side, kind, tool, outcome``: side response or request, kind call, retry, return or other. A
    message without parts has one row with a null kind.
    """
    search, own = F.col("tool") == f"{namespace}_search", (F.col("side") == "request") & F.col("tool").isin(*tools)
    failed = own & (F.col("kind") == "return") & (F.col("outcome") == "failed")
    return parts.groupBy("run").agg(
        F.count_if((F.col("side") == "response") & (F.col("kind") == "call") & search).alias("n_search_calls"), F.count_if(failed & search).alias("n_rejected_searches"),
        F.count_if(failed | (own & (F.col("kind") == "retry"))).alias("n_failed_tools"), F.count_distinct(F.when(F.col("side") == "response", F.col("message"))).alias("n_requests"),
    )


def submission_rows(predictions: DataFrame, retrieved: DataFrame, subset: str, prediction: Column, k: int = 3) -> DataFrame:
    """``id, subset, context_id, prediction``: of ``retrieved`` (``question, context_id, rank``) the first ``k``, one as a plain value.

    Questions without results have an empty list, or null where ``k`` is 1.
    """
    ranked = retrieved.withColumn("_rn", F.row_number().over(Window.partitionBy("question").orderBy("rank", "context_id"))).where(F.col("_rn") <= k)
    lists = ranked.groupBy("question").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "context_id"))), lambda s: s["context_id"]).alias("_ids"))
    ids = F.get("_ids", F.lit(0)) if k == 1 else F.coalesce("_ids", F.array().cast(lists.schema["_ids"].dataType))
    return predictions.join(lists, "question", "left").select("id", F.lit(subset).alias("subset"), ids.alias("context_id"), prediction.alias("prediction"))


def nearest_ids(cited: DataFrame, likeness: float = ID_LIKENESS) -> DataFrame:
    """``cited`` with ``resolved``: ``chunk_id`` if it is among its run's ``known`` ids, else the one most like it, else itself.

    Likeness is the ratio of matching blocks, which no expression computes, so ids that are not known go through Arrow
    batches; a run's known ids are what it retrieved.
    """

    @F.pandas_udf("string")
    def nearest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import get_close_matches

        for ids, known in parts:
            found = [i if i is None or k is None else (get_close_matches(i, [x for x in k if x is not None], 1, likeness) or [i])[0] for i, k in zip(ids, known, strict=True)]
            yield pd.Series(found, dtype=object)

    exact = F.coalesce(F.array_contains("known", F.col("chunk_id")), F.lit(False))
    odd = F.when(~exact, F.col("chunk_id"))  # the worker sees nulls where nothing is to be done
    return cited.withColumn("resolved", F.coalesce(nearest(odd, F.when(~exact, F.col("known"))), "chunk_id"))


def citation_policy(events: DataFrame, asked: DataFrame, can_cite: DataFrame) -> DataFrame:
    """``conv, question, action, violated`` for the question in progress of each conversation that ends.

    An undeclared answer is redirected once, if the tool to cite is there (``can_cite``: ``conv``) and the question was not
    asked before (``asked``: ``conv, question``); where the tool is gone it is a violation at once. After the run each one
    that is still undeclared is ``violated``. Without evidence after the question, and nothing cited before, nothing is owed.
    """
    fresh = ledgers(events).groupBy("conv").agg(F.max(F.col("epoch")).alias("_epoch"))
    cites = events.groupBy("conv").agg(F.max((F.col("kind") == "declare") & (F.size(F.coalesce("chunk_ids", F.array().cast("array<string>"))) > 0)).alias("_cites"))
    state = citation_status(events).join(fresh, "conv").join(cites, "conv")
    owed = (F.col("status") == "missing") & (F.coalesce(F.col("_epoch") > F.col("question"), F.lit(False)) | F.col("_cites"))
    state = state.join(asked.select("conv", "question", F.lit(True).alias("_asked")).distinct(), ["conv", "question"], "left")
    state = state.join(can_cite.select("conv", F.lit(True).alias("_can")).distinct(), "conv", "left")
    action = F.when(~owed | F.col("_asked").isNotNull(), "none").when(F.col("_can"), "redirect").otherwise("violation")
    return state.select("conv", "question", action.alias("action"), owed.alias("violated"))
