"""Workflows: a manifest of tasks, and sequences of steps (when, loop_over, next_sequence, set, method, save_as) over a context.

The context holds scalars and DataFrames, on the driver; a DataFrame that is stored is also a temporary view. Steps call registered
functions, which work on DataFrames; nothing here reads rows.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_PLACE = re.compile(r"\{\{\s*(.*?)\s*\}\}")
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: operator.is_, ast.IsNot: operator.is_not,
}
_CALLS: dict[str, Callable] = {"len": len, "str": str, "int": int, "float": float, "bool": bool, "min": min, "max": max}


def evaluate(text: str, names: dict[str, Any]) -> Any:
    """The value of an expression: names, members, subscripts, arithmetic, comparisons, and/or/not and a few functions; no other code."""

    def of(n: ast.AST) -> Any:
        match n:
            case ast.Expression():
                return of(n.body)
            case ast.Constant():
                return n.value
            case ast.Name():
                return names[n.id]
            case ast.Attribute() if not n.attr.startswith("_"):
                v = of(n.value)
                return v[n.attr] if isinstance(v, dict) else getattr(v, n.attr)
            case ast.Subscript():
                return of(n.value)[of(n.slice)]
            case ast.List() | ast.Tuple():
                return [of(x) for x in n.elts]
            case ast.BinOp() if type(n.op) in _BINARY:
                return _BINARY[type(n.op)](of(n.left), of(n.right))
            case ast.UnaryOp():
                v = of(n.operand)
                return not v if isinstance(n.op, ast.Not) else -v
            case ast.BoolOp():
                v: Any = isinstance(n.op, ast.And)
                for x in n.values:
                    v = of(x)
                    if bool(v) != isinstance(n.op, ast.And):
                        break
                return v
            case ast.Compare():
                left = of(n.left)
                for op, right in zip(n.ops, map(of, n.comparators)):
                    if not _COMPARE[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.IfExp():
                return of(n.body) if of(n.test) else of(n.orelse)
            case ast.Call() if isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
                return _CALLS[n.func.id](*map(of, n.args))
        raise ValueError(f"not allowed: {text!r}")

    return of(ast.parse(text, mode="eval"))


def render(value: Any, names: dict[str, Any]) -> Any:
    """``value`` with its ``{{ }}`` filled in; a place that is the whole text keeps its type. An expression that fails is False."""
    if isinstance(value, dict):
        return {k: render(v, names) for k, v in value.items()}
    if isinstance(value, list):
        return [render(v, names) for v in value]
    if not isinstance(value, str):
        return value

    def one(text: str) -> Any:
        try:
            return evaluate(text, names)
        except Exception:
            return False

    whole = _PLACE.fullmatch(value)
    return one(whole.group(1)) if whole else _PLACE.sub(lambda m: str(one(m.group(1))), value)


class Workflow:
    """Runs sequences of steps with registered functions."""

    def __init__(self, spark: SparkSession, sequences: dict[str, list[dict]], methods: dict[str, Callable]) -> None:
        self.spark, self.sequences, self.methods = spark, sequences, methods

    def run(self, name: str, context: dict[str, Any]) -> dict[str, Any]:
        """The context after the sequence; ``context`` itself is changed."""
        for step in self.sequences[name]:
            self._step(step, context)
        return context

    def _step(self, step: dict, context: dict[str, Any]) -> None:
        if "when" in step and not render(_braced(step["when"]), context):
            return
        if "loop_over" in step:
            inner = {k: v for k, v in step.items() if k not in ("loop_over", "when")}
            for item in render(_braced(step["loop_over"]), context) or []:
                self._step(inner, context | {"item": item})  # what a turn writes stays in it
            return
        if "next_sequence" in step:
            self.run(step["next_sequence"], context)
        elif "method" in step:
            got = self.methods[step["method"]](**render(step.get("args", {}), context))
            if name := step.get("save_as"):
                self.store(name, got, context)
        elif "set" in step:
            context[step["set"]] = render(step.get("value"), context)

    def store(self, name: str, value: Any, context: dict[str, Any]) -> None:
        context[name] = value
        if isinstance(value, DataFrame):
            context[f"{name}_df"] = value
            value.createOrReplaceTempView(name)

    def lint(self) -> list[str]:
        """What is wrong with the sequences: ``set`` without value, ``method`` and ``next_sequence`` at once, unknown names."""
        out = []
        for name, steps in self.sequences.items():
            for i, s in enumerate(steps):
                where = f"{name}[{i}]"
                if "set" in s and "value" not in s:
                    out.append(f"{where}: set without value")
                if "method" in s and "next_sequence" in s:
                    out.append(f"{where}: method and next_sequence")
                if "next_sequence" in s and s["next_sequence"] not in self.sequences:
                    out.append(f"{where}: unknown sequence {s['next_sequence']}")
                if "method" in s and s["method"] not in self.methods:
                    out.append(f"{where}: unknown method {s['method']}")
        return out


def _braced(text: Any) -> Any:
    return f"{{{{ {text} }}}}" if isinstance(text, str) and "{{" not in text else text


def manifest(spark: SparkSession, data: dict) -> DataFrame:
    """``(execution_id, msisdn, sequence, payload)``: the tasks of a manifest."""
    import json

    rows = [(str(data.get("execution_id", "")), str(t["msisdn"]), t["sequence"], json.dumps(t.get("payload") or {})) for t in data.get("tasks", [])]
    return spark.createDataFrame(rows, "execution_id string, msisdn string, sequence string, payload string")


def orchestrate(spark: SparkSession, data: dict, flow: Workflow) -> DataFrame:
    """``(execution_id, msisdn, sequence, ok, result)``: one row per task of a manifest, in order. Each task runs its sequence in a context of its own,
    the members of its payload as variables; a task that fails is a row with the error, and the others go on.

    Tasks are driver-side control flow over distributed frames; their results are texts (a frame's is its number of rows).
    """
    rows = []
    for task in data.get("tasks", []):
        context = {"msisdn": str(task["msisdn"]), "collector": []} | dict(task.get("payload") or {})
        try:
            context = flow.run(task["sequence"], context)
            got = context.get("result")
            rows.append((str(data.get("execution_id", "")), context["msisdn"], task["sequence"], True, str(got.count()) if isinstance(got, DataFrame) else None if got is None else str(got)))
        except Exception as e:  # noqa: BLE001
            rows.append((str(data.get("execution_id", "")), str(task["msisdn"]), task["sequence"], False, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "execution_id string, msisdn string, sequence string, ok boolean, result string")
