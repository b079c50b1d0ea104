"""From documents to reported segments in one plan: split, attribute, score, ask, refine, gate, format."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import attribution, quality
from folio.operators.sequential import split_segments
from folio.session import shared_dir

#: Texts of one batch to their speakers; as many as texts, or the batch is AMBIGUOUS.
Scorer = Callable[[list[str]], list[str]]


def ambiguous(texts: list[str]) -> list[str]:
    """The scorer that is there without a model."""
    return ["AMBIGUOUS"] * len(texts)


def ask(lines: DataFrame, scorer: Scorer, tries: int = 4, rows: int = 20) -> DataFrame:
    """conv_id, turn, answer, error: lines through a scorer, a few at a time; one that fails is asked again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), rows):
                part = b.iloc[i : i + rows]
                found, error = None, None
                for _ in range(tries):
                    try:
                        found = scorer(part["text"].tolist())
                    except Exception as e:  # a scorer is outside: its failures are marked, and end nothing
                        error = f"INFERENCE_ERROR: {e}"
                    if found is not None and len(found) == len(part):
                        error = None
                        break
                    found = None
                yield part[["conv_id", "turn"]].assign(answer=found or ambiguous(part["text"]), error=error)

    return lines.select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, answer string, error string")


def lines_of(docs: DataFrame) -> DataFrame:
    """Documents as turns of dialogue: their parts, numbered."""
    parts = split_segments(docs.select("doc_id", "text").where(F.trim("text") != ""))
    return parts.select(F.col("doc_id").alias("conv_id"), F.col("part_no").cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("unknown").alias("speaker"), F.col("part").alias("text"))


def structured(lines: DataFrame, names: DataFrame, scorer: Scorer = ambiguous) -> DataFrame:
    """Lines with speaker, confidence and method. Rules first; only what they leave pending is asked."""
    ruled = attribution.C["rule_attribution"].on(utterances=lines, names=names).join(lines.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    answers = ask(ruled.where("status = 'PENDING_AI'"), scorer)
    joined = ruled.join(answers, ["conv_id", "turn"], "left")
    speaker = F.coalesce("answer", "speaker")
    return joined.select("conv_id", "turn", "text", speaker.alias("speaker"), "confidence", F.when(F.col("answer").isNotNull(), "scorer").otherwise(F.col("rule")).alias("method"), "error")


def as_segments(lines: DataFrame) -> DataFrame:
    own = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return lines.select("conv_id", "turn", F.lit("user").alias("role"), own.alias("segment_id"), "speaker", "text", "confidence")


def refined(lines: DataFrame, names: DataFrame, rounds: int = 2, enough: float = 98.0) -> DataFrame:
    """Up to two rounds of refinement, as long as a conversation scores less than enough; then UNFIXABLE."""
    for k in range(rounds):
        segments = as_segments(lines)
        scores = quality.C["document_quality_score"].on(segments=segments, names=names).where(F.col("score") < enough).select("conv_id")
        better = attribution.C["refine_ambiguous"].on(segments=segments, names=names).join(scores, "conv_id", "left_semi").where("before <> speaker").select("conv_id", "turn", F.col("speaker").alias("better"))
        lines = lines.join(better, ["conv_id", "turn"], "left").withColumn("speaker", F.coalesce("better", "speaker")).drop("better")
        if k + 1 < rounds:
            shared_dir(lines.sparkSession)
            lines = lines.checkpoint()
    return lines.withColumn("speaker", F.when(F.col("speaker") == "AMBIGUOUS", "UNFIXABLE").otherwise(F.col("speaker")))


def report(lines: DataFrame, names: DataFrame) -> DataFrame:
    return quality.C["document_quality_score"].on(segments=as_segments(lines), names=names)
