"""Sinks: result tables in parquet or CSV, case trees as rows, aligned text and LaTeX matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_results(df: DataFrame, path: str, digits: int = 4, fmt: str = "parquet") -> None:
    """Append rows, doubles rounded to ``digits``."""
    doubles = {c: F.round(F.col(c), digits) for c, t in df.dtypes if t in ("double", "float")}
    w = df.withColumns(doubles).write.mode("append")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path))


def partitioned_cases(df: DataFrame, path: str) -> None:
    """Cases by masking, topic and split, so that readers prune by directory."""
    df.write.mode("overwrite").partitionBy("masking", "topic", "split").parquet(path)


def matrix_text(pvalues: list[tuple[str, str, str]], accuracies: dict[str, float]) -> str:
    """Symmetric star matrix in fixed width, methods by name; the report of a few methods, made on the driver."""
    names = sorted(accuracies)
    width = max(map(len, names), default=0) + 2
    star = {frozenset((a, b)): s for a, b, s in pvalues}
    rows = ["".ljust(width) + "".join(n.rjust(width) for n in names)]
    rows += [a.ljust(width) + "".join(("-" if a == b else star.get(frozenset((a, b)), "")).rjust(width) for b in names) for a in names]
    return "\n".join([*rows, "", "accuracies: " + ", ".join(f"{n}={accuracies[n]:.3f}" for n in names)]) + "\n"


def matrix_latex(pvalues: list[tuple[str, str, str]], accuracies: dict[str, float]) -> str:
    """Upper triangle, best method first."""
    names = sorted(accuracies, key=lambda n: (-accuracies[n], n))
    star = {frozenset((a, b)): s for a, b, s in pvalues}
    body = []
    for i, a in enumerate(names):
        cells = ["" if j < i else "-" if j == i else star.get(frozenset((a, b)), "") for j, b in enumerate(names)]
        body.append(" & ".join([f"{a} ({accuracies[a]:.3f})", *cells]) + r" \\")
    head = " & ".join(["", *(rf"\rotatebox{{90}}{{{n}}}" for n in names)]) + r" \\"
    return "\n".join([r"\begin{tabular}{l" + "c" * len(names) + "}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"]) + "\n"


def paired_inputs(pairs: DataFrame, path: str) -> None:
    """Gold and both systems' answers of each pair of methods, one directory per pair."""
    yn = lambda c: F.when(F.col(c) == 1, "Y").otherwise("N")
    pairs.select("a", "b", "pair", yn("gold").alias("gold"), yn("s1").alias("s1"), yn("s2").alias("s2")).write.mode("overwrite").partitionBy("a", "b").option("header", "true").csv(path)
