"""Dotted metric names: templates with variables, compiled on the driver to patterns that columns are matched with."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scope templates, in the order in which they are tried.
SCOPES = {
    "JOBMANAGER_JOB_WITH_APPID": "flink.jm._t_application_id.<application_id>._t_host.<host>._t_job_id.<job_id>._t_job_name.<job_name>",
    "JOBMANAGER_WITH_APPID": "flink.jm._t_application_id.<application_id>._t_host.<host>",
    "JOBMANAGER_JOB": "flink.jm._t_host.<host>._t_job_id.<job_id>._t_job_name.<job_name>",
    "JOBMANAGER": "flink.jm._t_host.<host>",
    "TASKMANAGER_JOB_LATENCY": "flink.tm._t_host.<host>._t_tm_id.<tm_id>._t_job_id.<job_id>._t_job_name.<job_name>.latency.source_id.<operator_id>.operator_id.<operator_id>.operator_subtask_index.<subtask_index>",
    "TASKMANAGER_JOB": "flink.tm._t_host.<host>._t_tm_id.<tm_id>._t_job_id.<job_id>._t_job_name.<job_name>",
    "TASKMANAGER": "flink.tm._t_host.<host>._t_tm_id.<tm_id>",
    "OPERATOR": "flink.operator._t_host.<host>._t_tm_id.<tm_id>._t_job_id.<job_id>._t_job_name.<job_name>._t_operator_id.<operator_id>._t_operator_name.<operator_name>._t_subtask_index.<subtask_index>",
    "TASK": "flink.task._t_host.<host>._t_tm_id.<tm_id>._t_job_id.<job_id>._t_job_name.<job_name>._t_task_id.<task_id>._t_task_name.<task_name>._t_task_attempt_id.<task_attempt_id>._t_task_attempt_num.<task_attempt_num>._t_subtask_index.<subtask_index>",
}
UNKNOWN = "UNKNOWN"
#: Patterns of variables; any other is the shortest text that fits.
PATTERNS = {"subtask_index": r"(\d+)?", "tm_id": "([a-zA-Z0-9_]+)?", "job_id": "([a-zA-Z0-9_]+)?"}
JOB_MANAGER = ("JOBMANAGER_JOB_WITH_APPID", "JOBMANAGER_WITH_APPID", "JOBMANAGER_JOB", "JOBMANAGER")
_VARIABLE = re.compile(r"<([a-zA-Z_]+)>")


def pattern(template: str) -> str:
    """The template as an anchored pattern; the last group is the metric's own name."""
    parts = _VARIABLE.split(template)
    body = "".join(PATTERNS.get(p, "(.*?)") if i % 2 else p.replace(".", r"\.") for i, p in enumerate(parts))
    return f"^{body}\\.(.*)$"


def variables(template: str) -> list[str]:
    return _VARIABLE.findall(template)


def classify(name: Column, scopes: dict[str, str] = SCOPES) -> Column:
    """The first scope that matches, else UNKNOWN."""
    out = F.lit(UNKNOWN)
    for scope, template in reversed(scopes.items()):
        out = F.when(name.rlike(pattern(template)), F.lit(scope)).otherwise(out)
    return out


def extract(name: Column, scope: Column, variable: str, scopes: dict[str, str] = SCOPES) -> Column:
    """A variable of the name under its scope (of a repeated one the first); null where the scope has none."""
    out = F.lit(None).cast("string")
    for s, template in scopes.items():
        if variable in variables(template):
            out = F.when(scope == s, F.regexp_extract(name, pattern(template), variables(template).index(variable) + 1)).otherwise(out)
    return out


def metric_name(name: Column, scope: Column, scopes: dict[str, str] = SCOPES) -> Column:
    out = F.lit(None).cast("string")
    for s, template in scopes.items():
        out = F.when(scope == s, F.regexp_extract(name, pattern(template), len(variables(template)) + 1)).otherwise(out)
    return out


def application_of(task_manager: Column) -> Column:
    """application_<n-4>_<n-3> of the parts between underscores; null for fewer than four."""
    parts = F.split(task_manager, "_")
    return F.when(F.size(parts) >= 4, F.concat(F.lit("application_"), F.element_at(parts, -4), F.lit("_"), F.element_at(parts, -3)))
