"""Running code against tests. Off unless asked for: results are usually an input table.

The checks and limits below keep honest code honest; they are no security boundary. Run
them only where the workers themselves are in a container made for it.
"""

from __future__ import annotations

import ast
import re
import resource
import subprocess
import sys
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.sources.work import Work

# Modules that code may import, and names that it may not call.
ALLOWED_IMPORTS = {"math", "itertools", "functools", "collections", "heapq", "bisect", "re", "string", "typing", "dataclasses", "statistics", "fractions", "decimal", "random", "json"}
FORBIDDEN_CALLS = {"eval", "exec", "compile", "open", "__import__", "getattr", "setattr", "delattr", "globals", "locals", "input", "breakpoint"}
FORBIDDEN_MODULES = {"os", "sys", "subprocess", "socket", "pathlib", "shutil", "ctypes", "multiprocessing", "threading", "asyncio", "signal"}
# Fixed value: the mark before counts of an instrumented run.
COUNT_TAG = "__ASSERT_COUNTS__"
#: Between code and tests, so that code which seeds or draws when it is loaded doesn't change the tests' numbers.
SEEDING = "import random as _random_\n_random_.seed({seed})"


def violation(code: str) -> str:
    """'' for code that may run, 'syntax' or 'security' otherwise."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return "syntax"
    except Exception:
        return "security"
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names) if any(n.name.split(".")[0] not in ALLOWED_IMPORTS for n in names):
                return "security"
            case ast.ImportFrom(module=str(m)) if m.split(".")[0] not in ALLOWED_IMPORTS:
                return "security"
            case ast.Call(func=ast.Name(id=name)) if name in FORBIDDEN_CALLS:
                return "security"
            case ast.Call(func=ast.Attribute(value=ast.Name(id=name))) if name in FORBIDDEN_MODULES:
                return "security"
            case ast.Attribute(attr=attr) if attr.startswith("__"):
                return "security"
    return ""


@F.arrow_udf(T.StringType())
def violations(code: pa.Array) -> pa.Array:
    return pa.array([violation(c or "") for c in code.to_pylist()], pa.string())


def limits(seconds: float) -> None:
    # Limits of a run.
    for what, most in ((resource.RLIMIT_CPU, max(1, int(seconds))), (resource.RLIMIT_AS, 512 << 20), (resource.RLIMIT_FSIZE, 1 << 20), (resource.RLIMIT_NOFILE, 32)):
        resource.setrlimit(what, (most, most + 1 if what == resource.RLIMIT_CPU else most))


def run(code: str, seconds: float = 2.0) -> dict:
    """score, exec_time, stdout, stderr and error_type of one run."""
    # Scores of outcomes.
    bad = violation(code)
    if bad:
        return {"score": 0.0 if bad == "syntax" else -1.0, "exec_time": 0.0, "stdout": "", "stderr": bad, "error_type": bad}
    began = time.perf_counter()
    try:
        done = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, text=True, timeout=seconds, preexec_fn=lambda: limits(seconds), env={})
    except subprocess.TimeoutExpired:
        return {"score": -0.5, "exec_time": seconds, "stdout": "", "stderr": "timeout", "error_type": "timeout"}
    except OSError as e:
        return {"score": 0.0, "exec_time": 0.0, "stdout": "", "stderr": str(e), "error_type": "sandbox_fatal"}
    if done.returncode == 0:
        score, error = 2.0, ""
    else:
        score, error = (0.5, "assertion") if "AssertionError" in done.stderr else (0.1, "runtime")
    return {"score": score, "exec_time": time.perf_counter() - began, "stdout": done.stdout, "stderr": done.stderr, "error_type": error}


class CountAsserts(ast.NodeTransformer):
    """assert becomes two counters, so that one failure doesn't hide the others."""

    def visit_Assert(self, node: ast.Assert):
        test = ast.unparse(node.test)
        counted = ast.parse(f"_total_ += 1\ntry:\n    _passed_ += bool({test})\nexcept Exception:\n    pass").body
        return [ast.copy_location(n, node) for n in counted]


def instrumented(tests: str) -> str:
    """Tests that count; '' if they can't be counted at module level."""
    try:
        tree = ast.parse(tests)
    except SyntaxError:
        return ""
    if any(isinstance(n, ast.Assert) for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.Lambda, ast.ClassDef)) for n in ast.walk(f)):
        for f in ast.walk(tree):
            if isinstance(f, ast.FunctionDef):
                f.body.insert(0, ast.Global(names=["_total_", "_passed_"]))
    return ast.unparse(ast.fix_missing_locations(CountAsserts().visit(tree)))


def counted(code: str, tests: str, seconds: float) -> tuple[int, int]:
    """(passed, total) asserts."""
    body = instrumented(tests)
    if not body:
        return 0, 0
    # whatever ends the tests, the counts up to there are printed
    block = "\n".join("    " + line for line in body.split("\n"))
    out = run(f"{code}\n{SEEDING.format(seed=0)}\n_total_ = _passed_ = 0\ntry:\n{block}\nexcept Exception:\n    pass\nfinally:\n    print('{COUNT_TAG}', _passed_, _total_)", seconds)["stdout"]
    found = re.search(rf"{COUNT_TAG} (\d+) (\d+)", out)
    return (int(found[1]), int(found[2])) if found else (0, 0)


def verify(code: str, tests: str, rounds: int = 1, seconds: float = 2.0, retry: float = 1.5) -> list[dict]:
    """One result per seed; a timeout is tried again with more time and kept if better."""
    out = []
    for seed in range(max(1, rounds)):
        whole = f"{code}\n{SEEDING.format(seed=seed)}\n{tests}"
        result = run(whole, seconds)
        if result["error_type"] == "timeout" and retry > 1:
            again = run(whole, max(seconds * retry, seconds + 0.25))
            result = again if again["score"] > result["score"] else result
        out.append(result | {"round": seed})
    return out


#: Programs of a task, each of which may run for seconds.
TASK_PROGRAMS = 32


def run_verifier(df: DataFrame, key: str, code: str, tests: str, rounds: int = 1, seconds: float = 2.0, allow_execution: bool = False) -> DataFrame:
    """key, round, score, exec_time, error_type, assert_passed, assert_total of each row's runs.

    A run is fixed by code, tests and seed, so each different pair of code and tests runs once, whatever rows have it; pairs
    are dealt over as many tasks as there are cores, or more, and their results are written before they meet the rows.
    """
    if not allow_execution:
        raise PermissionError("code is only run where the caller allows it, inside a container")

    def work(batches):
        for batch in batches:
            for c, t in zip(*(col.to_pylist() for col in batch.columns)):
                passed, total = counted(c, t, seconds)
                rows = [(c, t, r["round"], r["score"], r["exec_time"], r["error_type"], passed, total) for r in verify(c, t, rounds, seconds)]
                names = ["code", "tests", "round", "score", "exec_time", "error_type", "assert_passed", "assert_total"]
                types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), types)], names=names)

    saved = Work(df.sparkSession, "verifier")
    rows = df.select(F.col(key).cast("string").alias("key"), F.coalesce(code, F.lit("")).alias("code"), F.coalesce(tests, F.lit("")).alias("tests"))
    programs = saved.save(rows.select("code", "tests").distinct(), "programs")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, programs.count() // TASK_PROGRAMS)
    kind = "code string, tests string, round int, score double, exec_time double, error_type string, assert_passed int, assert_total int"
    results = saved.save(programs.repartition(tasks).mapInArrow(work, kind), "results")
    return rows.join(results, ["code", "tests"]).drop("code", "tests").withColumnRenamed("key", key)
