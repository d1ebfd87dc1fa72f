"""Methods as objects with fit and transform, their registry, and the run over methods and repetitions.

Corpora are group keys (masking, topic), so one job fits all of them at once and nothing learned in one reaches another.
Cases: case_id, masking, topic, split, pair, known_author, unknown_author, known, unknown, y_true.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from averis.functions import text as T
from averis.functions.names import METHODS
from averis.operators import linear
from averis.operators import metrics as M
from averis.operators import scorers as S
from averis.operators.vectorize import cosine
from averis.session import store

CORPUS = ["masking", "topic"]
DETERMINISTIC = frozenset({"coav", "stylospeaker", "mlsr", "mstyledistance"})

Scorer = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Method:
    """``scorer(cases, run)`` adds a column ``score``; ``decision`` is ``eer``, ``accuracy`` (fixed ends), ``accuracy_data``
    (ends from the data), ``calibrated`` or a fixed number."""

    name: str
    scorer: Scorer
    decision: str | float = "eer"

    def fit(self, scored: DataFrame) -> DataFrame | float:
        train = scored.where("split = 'train'")
        if self.decision == "eer":
            return M.eer_threshold(train, CORPUS)
        if self.decision in ("accuracy", "accuracy_data"):
            return M.accuracy_threshold(train, CORPUS, (-1.0, 1.0) if self.decision == "accuracy" else None)
        if self.decision == "calibrated":
            f = S.calibrate(train, CORPUS)
            return f.select(*CORPUS, "w", "b")
        return float(self.decision)

    def transform(self, scored: DataFrame, fitted: DataFrame | float) -> DataFrame:
        if isinstance(fitted, float):
            return scored.withColumn("y_pred", (F.col("score") >= fitted).cast("int"))
        if self.decision == "calibrated":
            d = scored.join(fitted, CORPUS, "left")
            return d.withColumn("y_pred", (F.col("w") * F.col("score") + F.col("b") >= 0).cast("int")).drop("w", "b")
        return M.decide(scored, fitted, CORPUS, strict=str(self.decision).startswith("accuracy")).withColumnRenamed("y_hat", "y_pred").drop("threshold")


def _compression(cases: DataFrame, run: int) -> DataFrame:
    return cases.withColumn("score", S.coav(F.col("known"), F.col("unknown")))


def _likelihood(references: int, order: int) -> Scorer:
    def score(cases: DataFrame, run: int) -> DataFrame:
        k = cases.select("case_id", F.concat_ws("|", *CORPUS).alias("group"), F.col("known_author").alias("ka"), F.col("unknown_author").alias("ua"), T.token_sentences("known").alias("known"), T.token_sentences("unknown").alias("unknown"))
        pool = k.select("group", F.col("ka").alias("author"), "known").distinct().select("group", "author", F.explode("known").alias("sentence"))
        return cases.join(S.lambda_g(k, pool, references=references, order=order, seed=run), "case_id", "left")
    return score


def _embedding(cases: DataFrame, run: int) -> DataFrame:
    """Frozen encoder vectors in the columns known_vector and unknown_vector."""
    return cases.withColumn("score", cosine(F.col("known_vector"), F.col("unknown_vector")))


def build(name: str, scorer: Scorer | None = None, references: int = 100, order: int = 10) -> Method:
    """The configured method of a registry key. Encoder methods read vector columns. ``scorer`` takes the place of its own."""
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; one of {', '.join(METHODS)}")
    known: dict[str, tuple[Scorer, str | float]] = {
        "coav": (_compression, "eer"), "lambdag": (_likelihood(references, order), "calibrated"), "mlsr": (_embedding, "eer"), "mstyledistance": (_embedding, "eer"),
        "siambert": (_embedding, "accuracy"), "rsp": (_embedding, "accuracy_data"), "css": (_embedding, 0.0), **{k: (f, 0.5) for k, f in linear.SCORERS.items()},
    }
    default, decision = known[name]
    return Method(name, scorer or default, decision)


def run(cases: DataFrame, methods: list[Method], runs: int = 1) -> tuple[DataFrame | None, list[tuple[str, int, str]]]:
    """Predictions of all methods and repetitions, and what failed as (method, run, reason); deterministic methods run once."""
    out, failed = None, []
    for m in methods:
        for r in range(1, (1 if m.name in DETERMINISTIC else runs) + 1):
            try:
                scored = store(m.scorer(cases, r).select("case_id", *CORPUS, "split", "pair", "y_true", "score"), "scored")
                p = m.transform(scored, m.fit(scored)).select("topic", "masking", F.lit(m.name).alias("method"), F.lit(r).alias("run"), "split", "pair", "y_true", "y_pred", "score", F.lit(1).alias("aligned"))
                p = store(p, "predictions")
            except Exception as e:  # noqa: BLE001  a method that fails must not take the others with it; it is reported
                failed.append((m.name, r, str(e).splitlines()[0][:300]))
                continue
            out = p if out is None else out.unionByName(p)
    return out, failed
