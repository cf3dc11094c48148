"""Each stage of the corpus pipeline against brute force, on small tables with nulls, repeated rows and clashing names."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from weirflow.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n string, component_id int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared = [" ".join(word() for _ in range(9)) for _ in range(3)]
    out = []
    for k in range(90):
        lines = [" ".join(word() for _ in range(12)) for _ in range(rng.randint(1, 6))]
        if k % 2:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        out.append((k, "\n".join(lines), "en", None if k % 7 == 0 else "s", 5, "n", k))
    for k in range(10):  # near and exact copies
        w = out[k][1].split(" ")
        out.append((100 + k, " ".join([*w[:-1], "end"] if k % 2 else w), "en", "s", 5, "n", k))
    return [*out, out[3], (3, "short text", "en", "s", 5, "n", 0), (4, None, "en", "s", 5, "n", 0), (200, "", None, None, None, None, None), (None, out[5][1], "en", "s", 5, "n", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, rows[8][1]), (2, " ".join(f"z{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def got(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_quality_stage(spark, rows, docs, sf):
    out = pipeline.quality_rules(spark, docs, sf)
    assert out.columns == COLUMNS
    # no line is in over 50 documents of a host here, so only the rules for single documents count
    assert got(out) == Counter((r[0], r[1]) for r in rows if r[0] is not None and len((r[1] or "").split()) >= 20)
    assert out.filter("n_chars <> length(text)").count() == 0


def test_line_stage(spark, rows, docs, sf):
    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            held[line].add(r[0])
    gone = lambda i, x: i is not None and len(x) >= 20 and len(held[x] - {None}) >= 3 and max(held[x] - {None}) != i
    out = pipeline.line_dedup(spark, docs, sf)
    assert out.columns == COLUMNS and got(out) == Counter((r[0], "\n".join(x for x in (r[1] or "").split("\n") if not gone(r[0], x))) for r in rows)


def test_join_stage(spark, rows, docs, sf):
    texts = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            texts[r[0]].append(r[1])
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and any(s and 100 * len(s & t) >= 75 * len(s | t) for s in map(sets, texts[a]) for t in map(sets, texts[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = pipeline.ngram_jaccard_join(spark, docs, sf)
    want = Counter((i, min(t, key=lambda x: (x is None, x or ""))) for i, t in texts.items() if root(i) == i)
    assert out.columns == COLUMNS and got(out) == want and len(want) < len(texts)


def test_benchmark_stage(spark, rows, docs, sf):
    bench = [sets(rows[8][1]), sets(" ".join(f"z{k}" for k in range(20)))]
    bad = {r[0] for r in rows if r[0] is not None and any(100 * len(sets(r[1]) & b) >= 75 * len(b) for b in bench)}
    out = pipeline.benchmark_decontamination(spark, docs, sf)
    assert out.columns == COLUMNS and got(out) == Counter((r[0], r[1]) for r in rows if r[0] not in bad) and 8 in bad


def test_run(spark, rows, sf):
    import public_tokenizers

    e, docs = tokens.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
    out = pipeline.run(spark, sf).collect()
    n = Counter()
    for r in out:
        n[r["doc_id"]] += r["length"]
    assert n == {i: len(e.whole(t or "")) // 4 + 1 for i, t in kept.items()}


def test_stages_of_an_empty_table(spark, docs, sf):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
