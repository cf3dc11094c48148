"""File semantics, datum algebra and incremental runs, by the fixtures' literal expectations."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.functions.paths import duration_seconds, valid_name, valid_path
from weirflow.operators import dag, datums, globs, incremental, triggers, view
from weirflow.plans.control import Engine, per_datum
from weirflow.plans.inputs import Input, InvalidInput, Pipeline, compile_input, sides, validate
from weirflow.sources.egress import EgressError, egress
from weirflow.sources.store import Store, StoreError
from weirflow.streaming.ingest import push_operations, size_trigger_stream


def contents(df):
    return {r["path"]: r["content"] for r in df.collect()}


def names(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_view_semantics(spark):
    log = [("x", 1, "append", "foo"), ("x", 2, "append", "bar"), ("y", 3, "append", "a"), ("y", 4, "delete", ""), ("z", 5, "overwrite", "new"), ("w", 6, "append", "old"), ("w", 7, "delete", ""), ("w", 8, "append", "new"), ("e", 9, "append", "")]
    ops = spark.createDataFrame(log, "path string, seq long, kind string, content string")
    assert contents(view.resolve_view(ops)) == {"x": "foobar", "z": "new", "w": "new", "e": ""}


def test_view_against_replay(spark):
    rng = random.Random(42)
    log = [(f"p{rng.randrange(6)}", k, rng.choice(["append", "append", "overwrite", "delete"]), rng.choice("abc")) for k in range(300)]
    want = {}
    for path, _, kind, content in log:
        if kind == "delete":
            want.pop(path, None)
        else:
            want[path] = content if kind == "overwrite" else want.get(path, "") + content
    assert contents(view.resolve_view(spark.createDataFrame(log, "path string, seq long, kind string, content string"))) == want


def test_split(spark):
    texts = spark.createDataFrame([("d", "HDR2\nr1\nr2\nr3")], "path string, text string")
    assert contents(view.split_records(texts, "\n", header_records=True)) == {f"d/{k}": f"HDR2\nr{k + 1}" for k in range(3)}
    with pytest.raises(ValueError):
        view.split_records(texts, "")


def test_prefix_listing(spark):
    files = spark.range(20_000).select(F.col("id").cast("string").alias("path"))
    count = lambda p: files.filter(F.col("path").startswith(view.listing_prefix(p))).count()
    assert (count("1*"), count("5*"), count("9*")) == (11_111, 1_111, 1_111)


@pytest.mark.parametrize(("pattern", "path", "want"), [("/*", "a", True), ("/*", "a/b", False), ("**", "a/b", True), ("a/**", "a/b", True), ("a/**", "a/b/c", False), ("[^a]x", "bx", True), ("[^a]x", "ax", False), (r"\*", "*", True), (r"\*", "a", False), ("[a", "a", False), ("", "", True), ("a?c", "abc", True), ("a?c", "a/c", False)])
def test_globs(spark, pattern, path, want):
    assert names(spark, path).filter(globs.matches(F.col("path"), pattern)).count() == want


def test_inner_join_fixture(spark):
    a, b = names(spark, *[f"file-0.{k:04b}" for k in range(16)]), names(spark, *[f"file-1.{k:04b}" for k in range(16)])
    ka, kb = (datums.keyed(f, globs.capture_key(F.col("path"), g, "$1")) for f, g in ((a, "/file-?.(11*)"), (b, "/file-?.(*0)")))
    assert {r["key"] for r in datums.join([("a", ka), ("b", kb)]).collect()} == {"1100", "1110"}


def test_outer_member_fixture(spark):
    r0, r1 = names(spark, *map(str, range(8)), "foo"), names(spark, *map(str, range(8)), "bar")
    k = [("a", datums.keyed(r0, globs.capture_key(F.col("path"), "/(*)", "$1"))), ("b", datums.keyed(r1, globs.capture_key(F.col("path"), "/(*)", "$1")))]
    assert datums.join(k).count() == 8
    assert [r["path"] for r in datums.outer_leftovers(k, "a").collect()] == ["foo"]


def test_group_fixture(spark):
    # names are right-aligned in a field of four; blanks count as characters
    f = names(spark, *[f"file.{k:b}".replace("file.", "file.") if len(f"{k:b}") == 4 else f"file.{k:b}".replace("file.", "file." + " " * (4 - len(f"{k:b}"))) for k in range(16)])
    g = datums.group([("a", datums.keyed(f, globs.capture_key(F.col("path"), "/file.(?)(?)(?)(?)", "$3")))])
    assert sorted(r["n_files"] for r in g.collect()) == [2, 6, 8]


def test_cross_and_union(spark):
    five = names(spark, *[f"file-{k}" for k in range(5)])
    assert datums.cross([("a", five), ("b", five)]).select("datum_id").distinct().count() == 25
    a = spark.createDataFrame([("file-0", "0"), ("file-1", "1")], "path string, content string")
    assert contents(datums.union([a, a.filter("path = 'file-0'")])) == {"file-0": "00", "file-1": "1"}


def test_size_trigger(spark):
    rows = [("p", k, 100) for k in range(50)]
    fires = triggers.size_trigger(spark.createDataFrame(rows, "pipeline string, seq long, size long"), 1000)
    assert fires.agg(F.sum("fires")).first()[0] == 5


def test_closure_random_graphs(spark):
    rng = random.Random(42)
    edges = list({(f"n{a}", f"n{rng.randrange(a + 1, 13)}") for a in (rng.randrange(12) for _ in range(18))}) + [("n3", "n3")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {tuple(r) for r in dag.closure(df, spark.createDataFrame([("n0",), ("n5",)], "node string")).collect()}
    want = set()
    for seed in ("n0", "n5"):
        todo, seen = [seed], {seed}
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(seed, x) for x in seen - {seed}}
    assert got == want


def test_topological():
    assert dag.topological([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], []) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        dag.topological([("a", "b"), ("b", "a")], [])


def test_names_and_durations():
    assert valid_name("a-b") and not valid_name("a/b") and not valid_name(".a") and not valid_path("a//b") and not valid_path("../a")
    assert duration_seconds("@every 1h30m") == 5400 and duration_seconds("500ms") == 0.5


def test_page_bounds():
    assert incremental.check_page(20, 1, 10) == 2
    with pytest.raises(IndexError):
        incremental.check_page(20, 2, 10)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    c1 = s.start_commit("r")
    s.put_file(c1, "x", "foo")
    s.put_file(c1, "x", "foo")
    s.finish_commit(c1)
    c2 = s.start_commit("r")
    s.put_file(c2, "x", "bar", "overwrite")
    s.put_file(c2, "y", "fresh")
    s.finish_commit(c2)
    assert (s.get_file(c1, "x"), s.get_file(c2, "x"), s.repo_size("r")) == ("foofoo", "bar", 8)
    with pytest.raises(StoreError):
        s.put_file(c2, "x", "late")
    bad = s.start_commit("r")
    s.put_file(bad, "y/z", "2")
    with pytest.raises(StoreError):
        s.finish_commit(bad)
    again = Store.load(spark, str(tmp_path))
    assert again.heads == s.heads and again.get_file(c2, "y") == "fresh" and again.history(c2) == [c1, c2]
    s.delete_commit(c2)
    assert s.heads["r", "master"] == c1
    s.put_tag("t", "a")
    s.put_tag("t", None)
    s.put_tag("u", "b")
    assert [tuple(r) for r in s.tag_table().collect()] == [("u", "b")]


def copy(rows):
    return rows.select("datum_id", "path", "content")


def counts(j):
    return j.counts["processed"], j.counts["recovered"], j.counts["failed"], j.counts["skipped"]


def test_incremental_chain(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("p", Input("in"), copy, "v1"))
    e.create_pipeline(Pipeline("q", Input("p"), copy, "v1"))

    def commit(*files, delete=()):
        c = e.store.start_commit("in")
        for path, text in files:
            e.store.put_file(c, path, text, "overwrite")
        for path in delete:
            e.store.delete_file(c, path)
        e.finish_commit(c)
        return c

    first = commit(("a", "1"), ("b", "2"))
    commit(("c", "3"))
    mine = [j for j in e.jobs if j.pipeline == "p"]
    assert [counts(j) for j in mine] == [(2, 0, 0, 0), (1, 0, 0, 2)]
    commit(delete=("a",))
    head = e.store.heads["q", "master"]
    assert contents(e.store.view(head)) == {"b": "2", "c": "3"}
    assert {j.pipeline for j in e.flush([first])} == {"p", "q"}


def test_failures_and_recovery(spark, tmp_path):
    def fail_some(pdf):
        if pdf["content"].iloc[0] != "ok":
            raise ValueError("bad")
        return pdf[["path", "content"]]

    def mend(pdf):
        if pdf["content"].iloc[0] == "worse":
            raise ValueError("worse")
        return pdf[["path", "content"]]

    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("p", Input("in"), per_datum(fail_some, on_error=mend)))
    c = e.store.start_commit("in")
    for path, text in (("file1", "ok"), ("file2", "worse"), ("file3", "bad")):
        e.store.put_file(c, path, text)
    e.finish_commit(c)
    assert counts(e.jobs[0]) == (1, 1, 1, 0) and e.jobs[0].state == "failure"
    assert set(contents(e.store.view(e.jobs[0].output))) == {"file1", "file3"}


def test_diamond(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.transaction([Pipeline("d", Input(cross=(Input("b"), Input("c"))), copy), Pipeline("b", Input("a"), copy), Pipeline("c", Input("a"), copy)])
    for k in range(2):
        c = e.store.start_commit("a")
        e.store.put_file(c, f"f{k}", str(k))
        e.finish_commit(c)
    # d's job before c has a head finds no datums and makes no commit
    assert [sum(j.pipeline == n and j.output is not None for j in e.jobs) for n in "bcd"] == [2, 2, 2]


def put(e, repo, branch="master", **files):
    c = e.store.start_commit(repo, branch)
    for path, text in files.items():
        e.store.put_file(c, path, text, "overwrite")
    return c


def test_queued_jobs_read_their_own_commits(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("p", Input("a"), copy))
    e._draining = True  # both commits finish while another job runs
    first, second = put(e, "a", x="1"), put(e, "a", y="2")
    e.finish_commit(first)
    e.finish_commit(second)
    e._draining = False
    e._drain()
    assert [contents(e.store.view(j.output)) for j in e.jobs] == [{"x": "1"}, {"x": "1", "y": "2"}]
    assert e.store.commits[e.jobs[0].output].provenance == [first]


def test_union_and_branches_carry_contents(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("u", Input(union=(Input("a"), Input("b"), Input("a", branch="dev", name="d"))), copy))
    for c in (put(e, "a", x="1"), put(e, "b", x="2", y="3"), put(e, "a", "dev", x="4")):
        e.finish_commit(c)
    assert contents(e.store.view(e.store.heads["u", "master"])) == {"x": "124", "y": "3"}
    j = e.run("u", [e.store.heads["a", "dev"]])
    assert j.manual and counts(j) == (0, 0, 0, 2)
    with pytest.raises(InvalidInput):
        e.run("u", [e.store.heads["u", "master"]])


def test_transaction_is_undone(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.finish_commit(put(e, "a", x="1"))
    with pytest.raises(InvalidInput):
        e.transaction([Pipeline("p", Input("a"), copy), Pipeline("q", Input("p", glob="*", join_on="x"), copy)])
    assert not e.pipelines and not e.jobs and "p" not in e.store.repos
    with pytest.raises(InvalidInput):
        e.transaction([Pipeline("p", Input("a"), copy)], {"p": 1})


def test_stop_start_cancel_stats(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("p", Input("a"), copy, stats=True))
    e.finish_commit(put(e, "a", x="1", y="2"))
    (j,) = e.jobs
    assert e.inspect_datum(j.job_id, "x")["state"] == "success" and sorted(contents(e.store.view(j.stats))) == ["000000", "000001"]
    e.stop("p")
    e.start("p")
    assert len(e.jobs) == 1  # nothing came meanwhile
    e.stop("p")
    e.finish_commit(put(e, "a", z="3"))
    e.start("p")
    assert len(e.jobs) == 2 and counts(e.jobs[1]) == (1, 0, 0, 2)
    e._draining = True
    e.finish_commit(put(e, "a", w="4"))
    e.cancel(e.jobs[2].job_id)
    e._draining = False
    e._drain()
    assert e.jobs[2].state == "killed" and e.jobs[2].output is None
    e.delete_job(e.jobs[2].job_id)
    assert len(e.jobs) == 2


def test_timeouts(spark, tmp_path):
    import time

    def slow(pdf):
        if pdf["path"].iloc[0] == "x":
            time.sleep(60)
        return pdf[["path", "content"]]

    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("p", Input("a"), per_datum(slow, timeout=0.5)))
    e.create_pipeline(Pipeline("q", Input("a"), per_datum(slow), job_timeout=6))
    began = time.time()
    e.finish_commit(put(e, "a", x="1", y="2"))
    p, q = ({j.pipeline: j for j in e.jobs}[n] for n in "pq")
    assert counts(p) == (1, 0, 1, 0) and contents(e.store.view(p.output)) == {"y": "2"}
    assert q.state == "killed" and "job timeout" in q.reason and time.time() - began < 55


def test_input_algebra(spark):
    files = lambda repo, branch: spark.createDataFrame([(f"file-{k}", "h", 1) for k in range(2)], "path string, hash string, size long")
    cross = compile_input(Input(cross=(Input(union=(Input("a"), Input("b"))), Input(union=(Input("c"), Input("d"))))), files)
    assert cross.select("datum_id").distinct().count() == 4 and cross.filter("size <> 2").count() == 0
    with pytest.raises(InvalidInput):
        validate(Input(cross=(Input("a", name="x"), Input("b", name="x"))))


def test_egress_scheme(spark):
    with pytest.raises(EgressError):
        egress(names(spark, "a"), "ftp://host/x")


def test_push(spark):
    rows = [("u", "refs/heads/master", "r1", "a", "1"), ("u", "refs/heads/dev", "r2", "b", "2")]
    got = push_operations(spark.createDataFrame(rows, "url string, ref string, revision string, path string, content string"), "master", {"u": "repo"})
    assert contents(got) == {"a": "1", ".git/HEAD": "r1"}


def test_size_trigger_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{k % 3}", k, (k * 37) % 500) for k in range(200)], "pipeline string, seq long, size long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = size_trigger_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 1000).writeStream.format("memory").queryName("fires").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in triggers.size_trigger(rows, 1000).filter("fires > 0").select("pipeline", "seq", "fires").collect()}
    assert {tuple(r) for r in spark.table("fires").collect()} == want


def test_history_in_blocks(spark):
    rng = random.Random(7)
    log = [(rng.choice("pq"), k, k // 3, rng.choice(["append", "append", "overwrite", "delete"]), rng.choice("abc")) for k in range(90)]
    ops = spark.createDataFrame(log, "path string, seq long, commit_no long, kind string, content string")
    commits = spark.range(40).withColumnRenamed("id", "commit_no")
    want, held, todo = {}, None, [o for o in log if o[0] == "p"]
    for c in range(40):
        while todo and todo[0][2] <= c:
            _, _, _, kind, text = todo.pop(0)
            held = None if kind == "delete" else text if kind == "overwrite" else (held or "") + text
        if held is not None:
            want[c] = len(held)
    for block in (1, 7, 4096):
        assert {r["commit_no"]: r["size"] for r in view.file_history(ops, "p", commits, block=block).collect()} == want


def test_split_headers(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    c = s.start_commit("r")
    s.put_split(c, "d", "H1\na\nb", "\n", header=True)
    s.put_split(c, "d", "H1\nc", "\n", header=True)
    assert contents(s.view(c)) == {"d/0": "H1\na", "d/1": "H1\nb", "d/2": "H1\nc"}
    s.put_split(c, "d", "H2\nw\nx\ny\nz", "\n", header=True)
    assert contents(s.view(c)) == {"d/0": "H2\na", "d/1": "H2\nb", "d/2": "H2\nc", "d/3": "H2\nz"}
    for text, delimiter in (("x", "\n"), ("x\ny", "")):
        with pytest.raises(StoreError):
            s.put_split(c, "d", text, delimiter, header=True)


def test_size_triggers_commit_snapshots(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("p", Input(cross=(Input("b"), Input("a", trigger_bytes=10))), standby=True))
    assert [s.branch for s in sides(e.pipelines["p"].input)] == ["master", "p-1"] and e.pipelines["p"].state == "standby"
    e.finish_commit(put(e, "a", x="123456"))
    assert ("a", "p-1") not in e.store.heads and e.ledgers["p", "p-1"] == 6
    c = put(e, "a", y="1" * 15)
    e.finish_commit(c)
    head = e.store.heads["a", "p-1"]
    assert e.ledgers["p", "p-1"] == 1 and len(e.store.history(head)) == 2 and sorted(contents(e.store.view(head))) == ["x", "y"]
    c = e.store.start_commit("a")
    e.store.delete_file(c, "y")
    e.store.put_file(c, "z", "1" * 9)
    e.finish_commit(c)
    assert sorted(contents(e.store.view(e.store.heads["a", "p-1"]))) == ["x", "y", "z"]
    assert e.pipelines["p"].state == "standby" and len([k for k in e.store.commits.values() if k.repo == "spec"]) == 1
    e.delete_pipeline("p")
    assert not e.ledgers


def test_garbage_secrets_and_reset(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.create_pipeline(Pipeline("p", Input("a")))
    first, second = put(e, "a", x="1"), put(e, "a", x="2")
    e.finish_commit(first)
    e.finish_commit(second)
    e.store.put_secret("s", {"k": "v"})
    again = Store.load(spark, str(tmp_path))
    assert again.secret("s") == {"k": "v"}
    e.store.delete_secret("s")
    assert not e.store.list_secrets() and e.store.corrupt_catalog().isEmpty()
    dropped = put(e, "a", x="3", y="4")
    tagged = e.store.view(dropped).filter("path = 'y'").select(F.sha2("content", 256)).first()[0]
    e.store.commits.pop(dropped)
    e.store.put_tag("t", tagged)
    e._queue.append(j := type(e.jobs[0])("j", "p", ()))
    e.jobs.append(j)
    with pytest.raises(InvalidInput):
        e.collect_garbage()
    e.cancel("j")
    assert e.collect_garbage() == 2 and e.collect_garbage() == 0  # the first run's records and x of the dropped commit
    assert contents(e.store.view(e.store.heads["p", "master"])) == {"x": "2"}
    e.store.materialize(second, str(tmp_path / "out"))
    assert contents(spark.read.parquet(str(tmp_path / "out"))) == {"x": "2"}
    with pytest.raises(InvalidInput):
        e.delete_repo("p")
    with pytest.raises(InvalidInput):
        e.reset()
    e.reset(yes=True)
    assert not e.pipelines and not e.store.repos and not Store.load(spark, str(tmp_path)).commits


def test_put_url(spark, tmp_path):
    import http.server
    import threading

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path == "/moved" else 200)
            self.send_header("Location", "/")
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    s = Store(spark, str(tmp_path))
    c = s.start_commit("r")
    s.put_url(c, "x", at + "/")
    assert s.get_file(c, "x") == "body"
    for url, most in ((at + "/moved", 99), (at + "/", 3), ("ftp://127.0.0.1/x", 99), ("http://169.254.1.1/", 99), ("http://0.0.0.0/", 99)):
        with pytest.raises(StoreError):
            s.put_url(c, "x", url, most)
    server.shutdown()


def test_numbering_of_many_rows(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    got = datums.numbered(rows, "k").select("row_no", "k", F.crc32("text")).toPandas().sort_values("row_no")
    assert got["row_no"].tolist() == list(range(200_000)) and got["k"].is_monotonic_increasing


def test_numbering_puts_nulls_last(spark):
    rows = spark.createDataFrame([(None, 1), (2, None), (1, 7), (2, 5), (None, None)], "a long, b long")
    want = [(1, 7), (2, 5), (2, None), (None, 1), (None, None)]
    assert [(r["a"], r["b"]) for r in datums.numbered(rows, ["a", "b"]).orderBy("row_no").collect()] == want
    assert [r["row_no"] for r in datums.numbered(rows.withColumn("p", F.lit(0)), ["a", "b"], "p").orderBy("row_no").collect()] == list(range(5))
    assert datums.numbered(rows.limit(0), ["a", "b"]).count() == 0
