"""Readers, writers and streams."""

import json

import pytest

from loomspark.sources import readers, sinks
from loomspark.streaming import case_logs


def test_json_lines(spark, tmp_path):
    good = {"benchmark": "b", "id": "1", "pass_at_1": False, "prompt": "p", "tests": "t"}
    (tmp_path / "log.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps(good | {"id": "2"}) + "\n")
    assert sorted(r.id for r in readers.read_jsonl(spark, [f"file://{tmp_path}/log.jsonl", f"file://{tmp_path}/none"]).collect()) == ["1", "2"]
    assert readers.read_jsonl(spark, []).count() == 0
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, f"file://{tmp_path}/log.jsonl").collect()
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl_strict(spark, f"file://{tmp_path}/none")


def test_tables_by_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "i int, split string")
    sinks.save_table(df, f"file://{tmp_path}/t")
    back = spark.read.parquet(f"file://{tmp_path}/t")
    assert readers.choose_split(back).first().i == 1 and readers.choose_split(back, ("nope",)).first().i == 2
    assert readers.first_readable(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/t"], 1).count() == 1
    with pytest.raises(ValueError):
        readers.first_readable(spark, [f"file://{tmp_path}/none"])
    found, missing = readers.tolerant({"a": lambda: df, "b": lambda: 1 / 0}, 1)
    assert list(found) == ["a"] and missing == ["b"]
    with pytest.raises(RuntimeError):
        readers.tolerant({"b": lambda: 1 / 0})


def test_manifests_weights_and_caches(spark, tmp_path):
    sinks.save_manifest(spark, f"file://{tmp_path}/m/x.json", {"é": 1})
    assert json.loads((tmp_path / "m/x.json").read_text()) == {"é": 1} and readers.read_json(spark, f"file://{tmp_path}/m/x.json").count() == 1
    sinks.save_run_manifest(spark, f"file://{tmp_path}/run.txt", {"seed": 1})
    assert "seed=1\n" in (tmp_path / "run.txt").read_text()
    sinks.save_weights(spark.createDataFrame([(-1, 0.5), (3, 1.0)], "bucket int, weight double"), f"file://{tmp_path}/w", 1024)
    weights, bias, buckets = sinks.load_weights(spark, f"file://{tmp_path}/w")
    assert (weights.count(), bias, buckets) == (1, 0.5, 1024)
    built = []
    for _ in range(2):
        assert sinks.cached_table(spark, f"file://{tmp_path}/cache", "sig", lambda: built.append(1) or spark.range(3)).count() == 3
    assert built == [1]


def test_repository(spark, tmp_path):
    for name, body in (("a.py", "x = 1"), ("b/c.md", "text"), (".git/d.py", "no"), ("e.bin", "no"), ("f.txt", "  ")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "g.txt").write_bytes(b"ok\xff!")
    assert {r.path: r.body for r in readers.repository(spark, f"file://{tmp_path}").collect()} == {"a.py": "x = 1", "b/c.md": "text", "g.txt": "ok!"}


def test_cases(spark):
    mbpp = spark.createDataFrame([("7", "add", ["assert 1", "assert 2"])], "task_id string, text string, test_list array<string>")
    assert readers.cases(mbpp, "mbpp").first().tests == "assert 1\nassert 2"
    human = spark.createDataFrame([("h", "p", "def check(f): pass", "f")], "task_id string, prompt string, test string, entry_point string")
    assert readers.cases(human, "human_eval").first().tests.endswith("\ncheck(f)")
    live = spark.createDataFrame([("q", "p", "f", [("1, 2", "3")]), ("r", "", "f", [])], "question_id string, prompt string, entry_point string, private_test_cases array<struct<input:string,output:string>>")
    assert [r.tests for r in readers.cases(live, "livecodebench").collect()] == ["assert f(1, 2) == 3"]
    swe = spark.createDataFrame([("i", "broken", "diff")], "instance_id string, problem_statement string, patch string")
    assert readers.cases(swe, "swebench_verified_subset").first().mode == "patch"
    with pytest.raises(ValueError):
        readers.cases(swe, "unknown")
    hold = spark.createDataFrame([(0, "p", "t", "test"), (1, "", "t", "test"), (2, "p", "t", "test"), (3, "p", "t", "train")], "i int, prompt string, tests string, split string")
    assert [r.id for r in readers.holdout_cases(hold, 3, "i").orderBy("i").collect()] == ["private_holdout_0", "private_holdout_2"]


def test_flags(spark):
    script = "python3 -u a.py --x 1 \\\n --y=2\npython b.py --z; python c.py\npython3 a.py --x --w"
    scripts = spark.createDataFrame([(1, script), (2, None), (3, "")], "id int, script string")
    assert {(r.id, r.program, r.flag) for r in readers.command_flags(scripts, "script").collect()} == {(1, "a.py", f) for f in ("--x", "--y", "--w")} | {(1, "b.py", "--z")}
    sources = spark.createDataFrame([("a.py", "p.add_argument('--x', type=int)\np.add_argument(\n  \"-y\", \"--y\")"), ("b.py", "")], "program string, source string")
    assert {tuple(r) for r in readers.declared_flags(sources, "program", "source").collect()} == {("a.py", "--x"), ("a.py", "--y")}
    drift = readers.flag_drift(scripts, "script", sources, "program", "source").collect()
    assert {(r.program, r.flag, r.n, r.declared) for r in drift} == {("a.py", "--x", 2, True), ("a.py", "--y", 1, True), ("a.py", "--w", 1, False), ("b.py", "--z", 1, False)}



def test_stream(spark, tmp_path):
    row = {"benchmark": "b", "id": "1", "pass_at_1": False, "prompt": "p", "tests": "t"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r) for r in (row, row, row | {"prompt": "q"}, row | {"pass_at_1": True, "prompt": "z"})))
    logs = case_logs.stream_case_logs(spark, f"file://{tmp_path}/in")
    query = case_logs.distinct_failures(logs).writeStream.format("memory").queryName("failures").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("failures").count() == 2


def test_repository_source_enters_no_ignored_folder(spark, tmp_path, monkeypatch):
    from loomspark.sources import repository as repo

    for name in ("a.py", "b/c.py", "b/node_modules/d.py", ".git/e.py", ".mypy_cache/f.py", "b/g/h.PY", "b/g/i.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("é" * 5000)
    want = {"a.py", "b/c.py", "b/g/h.PY"}
    for tasks in (1, 3, 64):
        listed = []
        walked = repo.Walk.list
        monkeypatch.setattr(repo.Walk, "list", lambda self, folder: listed.append(folder) or walked(self, folder))
        reader = repo.RepositoryReader({"path": str(tmp_path), "ignored": "node_modules,.git,.*_cache", "extensions": ".py", "tasks": str(tasks)})
        found = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(0).to_pylist()]
        monkeypatch.undo()
        assert sorted(found) == sorted(want)
        assert not any("node_modules" in f or ".git" in f or "_cache" in f for f in listed)
    files = repo.list_files(spark, f"file://{tmp_path}", ("node_modules", ".git", ".*_cache"), (".py",))
    assert {(r.path, r.n_bytes) for r in files.collect()} == {(p, 10_000) for p in want}
    read = []
    system = repo.pf.LocalFileSystem()

    class Counting:
        def open_input_file(self, path):
            f = system.open_input_file(path)
            return type("F", (), {"__enter__": lambda s: s, "__exit__": lambda s, *a: f.close(), "read": lambda s, n: read.append(n) or f.read(n)})()

    monkeypatch.setattr(repo, "opened", lambda root: (Counting(), str(tmp_path)))
    one = spark.createDataFrame([("a.py",)], "path string")
    monkeypatch.setattr(type(one), "mapInArrow", lambda self, f, schema: list(f([__import__("pyarrow").RecordBatch.from_pydict({"path": ["a.py"]})])))
    assert repo.read_bodies(one, str(tmp_path), 100)[0].column(1).to_pylist() == ["é" * 100] and read == [400]


def test_signature_ignores_the_order_of_files(spark):
    rows = [(f"p{i}", i, 2 * i) for i in range(20)]
    frame = lambda r: spark.createDataFrame(r, "path string, n_bytes long, changed long")
    assert sinks.repository_signature(frame(rows)) == sinks.repository_signature(frame(rows[::-1]).repartition(3))
    assert sinks.repository_signature(frame(rows)) != sinks.repository_signature(frame([*rows[:-1], ("p19", 19, 39)]))
