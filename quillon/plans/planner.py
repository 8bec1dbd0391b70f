"""Execution plans of selected skills: strategy, dependencies, steps, stages and run control."""
from __future__ import annotations

import os
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
STEPS, TIMEOUT_MS, PARALLEL, RETRIES = 5, 30_000, 3, 2


def strategy(selection: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, strategy) of every task; selection has (task_id, name, role, category)."""
    per = selection.groupBy("task_id").agg(F.count("*").alias("n"), F.bool_or(F.col("role") == "supporting").alias("supporting"), F.countDistinct("category").alias("kinds"))
    hard = (F.length("task") > 500) | F.col("task").contains("and") | F.col("task").contains("then")
    chosen = (
        F.when(F.coalesce("n", F.lit(0)) <= 1, "sequential").when(F.col("supporting"), "hybrid")
        .when((hard | (F.col("n") > PARALLEL)) & (F.col("kinds") == F.col("n")), "parallel").otherwise("sequential")
    )
    return tasks.select("task_id", "task").join(per, "task_id", "left").select("task_id", chosen.alias("strategy"))


def steps(selection: DataFrame) -> DataFrame:
    """(task_id, step, name, depends_on, timeout_ms): supporting steps wait for the first, others for the one before."""
    w = Window.partitionBy("task_id").orderBy("rank")
    rows = selection.withColumn("step", F.row_number().over(w) - 1).filter(F.col("step") < STEPS)
    waits = F.when(F.col("step") == 0, F.lit(None)).when(F.col("role") == "supporting", F.first("name").over(w)).otherwise(F.lag("name").over(w))
    return rows.select("task_id", "step", "name", "role", waits.alias("depends_on"), F.lit(TIMEOUT_MS).alias("timeout_ms"))


def summary(selection: DataFrame) -> DataFrame:
    """(task_id, summary): names and roles in order."""
    s = selection.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "role"))).alias("s"))
    names = F.array_join(F.transform("s", lambda x: x["name"]), ", ")
    roles = F.array_join(F.transform("s", lambda x: F.concat(x["name"], F.lit(" ("), x["role"], F.lit(")"))), ", ")
    return s.select("task_id", F.format_string("%d skill(s): %s. Roles: %s.", F.size("s"), names, roles).alias("summary"))


def invalid(plan: DataFrame) -> DataFrame:
    """Steps whose dependency is neither earlier in the plan nor the step itself."""
    earlier = plan.select(F.col("task_id").alias("of"), F.col("step").alias("at"), F.col("name").alias("known"))
    met = F.col("task_id").eqNullSafe(F.col("of")) & (F.col("depends_on") == F.col("known")) & (F.col("at") <= F.col("step"))
    return plan.filter("depends_on is not null").join(earlier, met, "left_anti").select("task_id", "step", "name", "depends_on")


def step_stages(rows: pd.DataFrame) -> pd.DataFrame:
    """(task_id, name, stage) of the steps of one plan; rows of one name are one step that waits for all they name."""
    waits: dict = {}
    for name, on in zip(rows["name"], rows["depends_on"]):
        waits.setdefault(name, set()).update([] if pd.isna(on) else [on])
    after: dict = {}
    for name, on in waits.items():
        for x in on:
            after.setdefault(x, []).append(name)
    left = {name: len(on) for name, on in waits.items()}
    stage, ready, depth = {}, [name for name, n in left.items() if not n], 0
    while ready:
        following = []
        for name in ready:
            stage[name] = depth
            for x in after.get(name, ()):
                left[x] -= 1
                if not left[x]:
                    following.append(x)
        ready, depth = following, depth + 1
    return pd.DataFrame({"task_id": rows["task_id"].iloc[0], "name": list(waits), "stage": pd.array([stage.get(n) for n in waits], "Int32")})


def stages(plan: DataFrame) -> DataFrame:
    """(task_id, stage, names, kind): steps by the length of their chain, however long; each plan is worked out in one piece."""
    plan.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    schema = T.StructType([plan.schema["task_id"], plan.schema["name"], T.StructField("stage", T.IntegerType())])
    level = plan.select("task_id", "name", "depends_on").groupBy("task_id").applyInPandas(step_stages, schema)
    # Steps on a cycle, or waiting for a missing one, have no stage.
    grouped = level.groupBy("task_id", "stage").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n"))
    return grouped.select("task_id", "stage", "names", F.when(F.col("n") > 1, "parallel-group").otherwise("single").alias("kind"))


def cut_off(results: DataFrame) -> DataFrame:
    """Steps that a sequential run reaches: up to the first failure. A task of any length is spread: its first failure is one number."""
    failed = results.filter("status <> 'success'").groupBy(F.col("task_id").alias("_task")).agg(F.min("step").alias("first"))
    reached = results.join(failed, F.col("task_id").eqNullSafe(F.col("_task")), "left").filter("first is null or step <= first")
    return reached.select(*results.columns)


def overall(ok: Column) -> Column:
    return F.when(F.coalesce(F.bool_and(ok), F.lit(True)), "success").otherwise("partial_failure")


def backoff_ms(retry: Column) -> Column:
    return (100 * F.pow(F.lit(2), retry - 1)).cast("long")


class Tools:
    """Named functions; those disabled or unknown cannot be called."""

    def __init__(self):
        self.tools: dict[str, Callable] = {}
        self.disabled: set[str] = set()
        self.required: dict[str, tuple[str, ...]] = {}
        self.calls: dict[str, list[int]] = {}

    def register(self, name: str, tool: Callable, required: tuple[str, ...] = ()) -> None:
        self.tools[name], self.required[name] = tool, required

    def unregister(self, name: str) -> None:
        for held in (self.tools, self.required, self.calls):
            held.pop(name, None)
        self.disabled.discard(name)

    def enable(self, name: str) -> None:
        self.disabled.discard(name)

    def disable(self, name: str) -> None:
        self.disabled.add(name)

    def call(self, name: str, **args):
        if name not in self.tools or name in self.disabled:
            raise KeyError(name)
        if missing := [k for k in self.required[name] if k not in args]:
            raise TypeError(f"{name}: missing {', '.join(missing)}")
        count = self.calls.setdefault(name, [0, 0])
        count[0] += 1
        try:
            return self.tools[name](**args)
        except Exception:
            count[1] += 1
            raise

    def specifications(self) -> list[dict]:
        return [{"name": n, "required": list(self.required[n]), "enabled": n not in self.disabled} for n in sorted(self.tools)]

    def stats(self) -> dict:
        """Number and names of the tools, and calls and failures of those called."""
        return {"count": len(self.tools), "names": sorted(self.tools), "calls": {n: tuple(c) for n, c in sorted(self.calls.items())}}

    def register_sql(self, spark, name: str, returns: str, table: bool = False) -> None:
        """Offer a tool to SQL under its name: a scalar function of one column, or a table function that yields rows."""
        tool = self.tools[name]
        if not table:
            spark.udf.register(name, F.pandas_udf(lambda x: x.map(tool), returns))
            return

        class Rows:
            def eval(self, *args):
                yield from tool(*args)

        spark.udtf.register(name, F.udtf(Rows, returnType=returns))


def run_step(tools: Tools, step: dict, context: dict, retries: int = RETRIES, timeout_ms: int = TIMEOUT_MS) -> dict:
    """Call a step's tool on the driver. Failures are tried again after a growing pause; an overdue call is left behind."""
    timeout = (step.get("timeout_ms") or timeout_ms) / 1000
    for attempt in range(retries + 1):
        # A thread of its own: an overdue call cannot be stopped, only no longer waited for.
        pool = ThreadPoolExecutor(1)
        began = time.monotonic()
        try:
            output = pool.submit(tools.call, step["name"], **{**context, **step.get("args", {})}).result(timeout)
            return {"name": step["name"], "status": "success", "output": output, "retries": attempt, "ms": int(1000 * (time.monotonic() - began))}
        except TimeoutError:
            error = f"no result after {timeout:g} s"
        except Exception as e:  # a tool's failure is a result
            error = str(e)
        finally:
            pool.shutdown(wait=False)
        if attempt < retries:
            time.sleep(0.1 * 2**attempt)
    return {"name": step["name"], "status": "failed", "error": error, "retries": retries, "ms": int(1000 * (time.monotonic() - began))}


def run_steps(tools: Tools, plan: list[dict], parallel: int = 1, retries: int = RETRIES, mode: str | None = None, context: dict | None = None, timeout_ms: int = TIMEOUT_MS) -> list[dict]:
    """Run a plan's steps (name, args, depends_on) on the driver; the mode is sequential, parallel or hybrid.

    Sequential stops at the first failure, and each step gets the outputs before it as `context`. Parallel runs
    all steps side by side. Hybrid runs, round by round, the steps whose dependencies have run: those without
    any side by side, the others in order with the outputs of earlier ones; steps on a cycle never run.
    """
    mode = mode or ("parallel" if parallel > 1 else "sequential")
    kept, results = dict(context or {}), []
    shared = lambda step: {"context": dict(kept)} if step.get("wants_context") else {}
    one = lambda step: run_step(tools, step, shared(step), retries, timeout_ms)

    def in_order(steps: list[dict], stop: bool) -> None:
        for step in steps:
            results.append(one(step))
            if results[-1]["status"] == "success":
                kept[step["name"]] = results[-1]["output"]
            elif stop:
                return

    def side_by_side(steps: list[dict]) -> None:
        with ThreadPoolExecutor(max(parallel, PARALLEL + 2)) as pool:
            results.extend(pool.map(one, steps))

    if mode == "sequential":
        in_order(plan, True)
    elif mode == "parallel":
        side_by_side(plan)
    else:
        ran, left = set(), list(plan)
        while ready := [x for x in left if all(d in ran for d in x.get("depends_on") or ())]:
            side_by_side([x for x in ready if not x.get("depends_on")])
            in_order([x for x in ready if x.get("depends_on")], False)
            ran |= {x["name"] for x in ready}
            left = [x for x in left if x not in ready]
    return results
