"""Receipts of work that came with a run, as JSON: what is wrong with them, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.runtime import spread

# How a commit is written, what an integration's status may be, and by how much a balance may be off.
COMMIT, STATUSES, SLACK = r"^[0-9a-f]{7,64}$", ("succeeded", "degraded", "failed"), 1e-9
LISTS = ("tests", "artifact_paths", "evidence_urls", "blockers")


def _at(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _kind(v: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...> and so on; VOID of a null, or of nothing."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column) -> Column:
    """A text, or null of anything else."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    x = F.try_variant_get(v, "$", "double")
    return F.when(_kind(v).rlike(r"^(BIGINT|DOUBLE|DECIMAL|FLOAT)") & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _no_texts(v: Column) -> Column:
    """Neither nothing nor an array of texts."""
    return (_kind(v) != "VOID") & F.coalesce(F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: _kind(x) != "STRING"), F.lit(True))


def _issues(df: DataFrame, keys: list[str], path: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    said = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.concat(path, F.lit(field)).alias("path"))) for code, field, bad in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*said))).alias("i")).select(*keys, "i.code", "i.path")


def receipt_issues(receipts: DataFrame, json_col: str = "receipt", keys: list[str] | None = None) -> DataFrame:
    """(keys, code, path): what breaks the form of a receipt. A null JSON is no receipt and has no issue.

    Receipts are dealt out over tasks, as their rules take far longer than reading them.
    """
    keys = keys or ["run_id"]
    own = spread(receipts.where(F.col(json_col).isNotNull()).select(*keys, F.col(json_col).alias("_j"))).select(*keys, F.try_parse_json("_j").alias("_v"))
    own = own.select("*", _kind(F.col("_v")).startswith("OBJECT").alias("_there"))
    v, there = F.col("_v"), F.col("_there")
    blank = lambda x: F.coalesce(F.trim(_text(x)) == "", F.lit(True))
    rules = [("invalid_receipt", "", ~there), ("missing_agent", "agent", there & blank(_at(v, "agent"))), ("missing_task_id", "task_id", there & blank(_at(v, "task_id")))]
    rules.append(("invalid_commit", "commit", there & (_kind(_at(v, "commit")) != "VOID") & ~F.coalesce(_text(_at(v, "commit")).rlike(COMMIT), F.lit(False))))
    rules.append(("invalid_next", "next", there & ~_kind(_at(v, "next")).isin("VOID", "STRING")))
    rules += [("invalid_list", c, there & _no_texts(_at(v, c))) for c in LISTS]
    items = F.try_variant_get(v, "$.integrations", "array<variant>")
    rules.append(("invalid_integrations", "integrations", there & (_kind(_at(v, "integrations")) != "VOID") & items.isNull()))
    found = _issues(own, keys, F.lit(""), rules)
    each = own.where(there).select(*keys, F.posexplode(items).alias("_i", "_x"))
    each = each.select("*", _kind(F.col("_x")).startswith("OBJECT").alias("_whole"), _at(F.col("_x"), "usage").alias("_usage"), _text(_at(F.col("_x"), "observed_at")).alias("_observed"))
    x, whole, observed, usage = (F.col(c) for c in ("_x", "_whole", "_observed", "_usage"))
    wrong = ~_kind(usage).startswith("OBJECT") | F.coalesce(_text(_at(usage, "unit")) == "", F.lit(True))
    before, after, delta = (_number(_at(usage, c)) for c in ("before", "after", "delta"))
    wrong = wrong | before.isNull() | after.isNull() | delta.isNull() | (F.abs((after - before) - delta) > SLACK)
    rules = [("invalid_integration", "", ~whole)] + [(f"missing_{c}", f".{c}", whole & F.coalesce(_text(_at(x, c)) == "", F.lit(True))) for c in ("provider", "capability", "observed_at")]
    rules.append(("invalid_observed_at", ".observed_at", whole & (observed != "") & observed.try_cast("timestamp").isNull()))
    rules.append(("invalid_status", ".status", whole & ~F.coalesce(_text(_at(x, "status")).isin(*STATUSES), F.lit(False))))
    rules.append(("invalid_external_request_id", ".external_request_id", whole & ~_kind(_at(x, "external_request_id")).isin("VOID", "STRING")))
    rules.append(("inconsistent_usage", ".usage", whole & (_kind(usage) != "VOID") & wrong))
    rules.append(("invalid_list", ".evidence_urls", whole & _no_texts(_at(x, "evidence_urls"))))
    return found.unionAll(_issues(each, keys, F.concat(F.lit("integrations["), F.col("_i").cast("string"), F.lit("]")), rules))


def with_receipts(runs: DataFrame, json_col: str = "receipt", keys: list[str] | None = None) -> DataFrame:
    """runs with agent, task_id, commit and integrations (how many) of the receipts that have no issue; null of the others."""
    keys = keys or ["run_id"]
    bad = receipt_issues(runs, json_col, keys).select(*keys, F.lit(True).alias("_bad")).distinct()
    own = runs.join(bad, keys, "left")
    v = F.when(F.col("_bad").isNull(), F.try_parse_json(F.col(json_col)))
    count = F.coalesce(F.size(F.try_variant_get(v, "$.integrations", "array<variant>")), F.lit(0))
    return own.withColumns({"agent": F.trim(_text(_at(v, "agent"))), "task_id": F.trim(_text(_at(v, "task_id"))), "commit": _text(_at(v, "commit")), "integrations": F.when(v.isNotNull(), count)}).drop("_bad")
