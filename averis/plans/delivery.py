"""Problem 2: redelivered rows of test_runs and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from averis.functions.names import method_key, pair_key, split_key
from averis.operators.dedup import deduplicated, redelivered
from averis.session import table


def run_keys() -> list:
    return [F.col("topic"), F.col("masking"), method_key("model"), F.col("run")]


def prediction_keys() -> list:
    return [*run_keys(), split_key("split"), pair_key("pair")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        redelivered(table(spark, sf_dir, name), keys, "row_id").select(F.lit(name).alias("tab"), "row_id")
        for name, keys in (("test_runs", run_keys()), ("predictions", prediction_keys()))
    ]
    return parts[0].unionByName(parts[1])


def p2_test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "test_runs"), run_keys(), "row_id")


def p2_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "predictions"), prediction_keys(), "row_id").select("row_id", "topic", "masking", "model", "run", "split", "pair", "y_true", "y_pred", "score")


_METHOD = "CASE lower(trim(model)) " + " ".join(
    f"WHEN '{b}' THEN '{a}'"
    for a, b in (("coav", "coav"), ("siambert", "siambert"), ("fevec", "fevec-de"), ("dv", "dv-bin-de"), ("css", "css"), ("mlsr", "multilingualstylerepresentation"), ("mstyledistance", "mstyledistance"), ("stylospeaker", "stylospeaker"), ("rsp", "rsp"), ("lambdag", "lambdag"))
) + " ELSE lower(trim(model)) END"
_SPLIT = "CASE lower(trim(split)) WHEN 'training' THEN 'train' WHEN 'testing' THEN 'test' ELSE lower(trim(split)) END"
#: Blanks as Unicode has them; DuckDB's \\s is ASCII only.
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PAT = rf"^(?:\[[A-Za-z]\]{_WS}*)?(.+?){_WS}+vs\.?{_WS}+(.+?){_WS}*$"


def sql_side(c: str, n: int) -> str:
    return f"trim(regexp_replace(regexp_extract(nfc_normalize({c}), '{_PAT}', {n}), '{_WS}+', ' ', 'g'))"


def sql_pair(c: str) -> str:
    return f"CASE WHEN {sql_side(c, 1)} <> '' THEN {sql_side(c, 1)} || chr(1) || {sql_side(c, 2)} ELSE {c} END"


def _sql(names: tuple[str, ...], found: bool) -> str:
    one = {
        "test_runs": f"SELECT *, max(row_id) OVER (PARTITION BY topic, masking, {_METHOD}, run) AS kept FROM test_runs",
        "predictions": f"SELECT *, max(row_id) OVER (PARTITION BY topic, masking, {_METHOD}, run, {_SPLIT}, {sql_pair('pair')}) AS kept FROM predictions",
    }
    if found:
        return " UNION ALL ".join(f"SELECT '{n}' AS tab, row_id FROM ({one[n]}) WHERE row_id < kept" for n in names)
    cols = "* EXCLUDE (kept)" if names[0] == "test_runs" else "row_id, topic, masking, model, run, split, pair, y_true, y_pred, score"
    return f"SELECT {cols} FROM ({one[names[0]]}) WHERE row_id = kept"


QUERIES = {"p2_found": p2_found, "p2_test_runs": p2_test_runs, "p2_predictions": p2_predictions}
SQL = {"p2_found": _sql(("test_runs", "predictions"), True), "p2_test_runs": _sql(("test_runs",), False), "p2_predictions": _sql(("predictions",), False)}
