"""What a run did, taken while it runs: rows, errors, conflicts and failed rules of each stage, without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from goldrec.operators.validation import RULES, Rule


class Reports:
    """Metrics of the stages that it has watched; they are there once an action over the watched rows is done."""

    def __init__(self) -> None:
        self._stages: dict[str, Observation] = {}

    def watch(self, stage: str, rows: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
        """rows, observed: how many there are, and by the columns that they have: errors, conflicts, mean score, invalid
        records, issues, and for every rule the records in which it found something."""
        metrics = {"rows": F.count(F.lit(1))}
        if "error_type" in rows.columns:
            metrics["errors"] = F.count_if(F.col("error_type").isNotNull())
        if stage == "merge":
            metrics["conflicts"] = F.sum(F.size(F.filter("merge_report", lambda r: r.conflict)))
        if stage == "confidence":
            metrics["mean_score"] = F.avg("confidence.score")
        if stage == "validation":
            metrics |= {"invalid": F.count_if(~F.col("is_valid")), "issues": F.sum(F.size("issues"))}
            metrics |= {f"failed_{r.name}": F.count_if(F.exists("issues", lambda x: x.rule_name == r.name)) for r in (RULES if rules is None else rules)}  # noqa: B023
        self._stages[stage] = Observation(stage)
        return rows.observe(self._stages[stage], *(m.alias(n) for n, m in metrics.items()))

    def get(self) -> dict[str, dict]:
        """Stage -> its metrics; waits for the action that fills them."""
        return {stage: seen.get for stage, seen in self._stages.items()}
