"""The engine's queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.paths import basename, human_size, identifier, memory_bytes, version_key
from .operators import catalog, dag, datums, globs, incremental, triggers, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- relations that stand for the store's tables, in both dialects ----


def ops(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "overwrite").when(F.col("event_type") == "error", "delete").otherwise("append")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u/"), (F.col("user_id") % 50).cast("string")).alias("path"), kind.alias("kind"), F.concat("event_type", F.lit(";")).alias("content"), F.floor(F.col("event_id") / 100).cast("long").alias("commit_no"))


OPS = """ops AS (SELECT event_id AS seq, 'u/' || CAST(user_id % 50 AS VARCHAR) AS path,
  CASE event_type WHEN 'signup' THEN 'overwrite' WHEN 'error' THEN 'delete' ELSE 'append' END AS kind, event_type || ';' AS content, event_id // 100 AS commit_no FROM events)"""


def live(source: str) -> str:
    return f"""live AS (SELECT o.* FROM {source} o LEFT JOIN (SELECT path, max(seq) AS reset FROM {source} WHERE kind <> 'append' GROUP BY path) r USING (path)
  WHERE o.kind <> 'delete' AND (r.reset IS NULL OR o.seq >= r.reset))"""


VIEW = "SELECT path, string_agg(content, '' ORDER BY seq) AS content, count(*) AS n_parts FROM live GROUP BY path"


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"), "lang", "source", "doc_id")


FILES = "files AS (SELECT concat_ws('/', lang, source, CAST(doc_id AS VARCHAR) || '.txt') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS hash, lang, source, doc_id FROM documents)"


def fa(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string"), F.lit("."), F.translate("o_orderpriority", " ", "_")).alias("path"), "o_orderkey", "o_custkey")


def fb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("item-"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("path"))


FAB = """fa AS (SELECT 'ord-' || CAST(o_orderkey AS VARCHAR) || '.' || replace(o_orderpriority, ' ', '_') AS path, o_orderkey, o_custkey FROM orders),
fb AS (SELECT 'item-' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS path FROM lineitem),
ka AS (SELECT regexp_extract(path, '^ord-(.*)\\..*$', 1) AS key, path FROM fa), kb AS (SELECT regexp_extract(path, '^item-(.*)\\..*$', 1) AS key, path FROM fb)"""
GLOB_A, GLOB_B = "/ord-(*).*", "/item-(*).*"


def stages(spark: SparkSession, d: str) -> list[DataFrame]:
    """A four-stage provenance chain: regions, nations, customers, orders."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return [
        table(spark, d, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")),
        table(spark, d, "customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")),
        table(spark, d, "orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")),
    ]


EDGES = """edges AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation
  UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR) FROM orders),
reach AS (SELECT src AS seed, dst AS node FROM edges UNION SELECT r.seed, e.dst FROM reach r JOIN edges e ON e.src = r.node)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.create_map(*[F.lit(x) for kv in (("signup", "running"), ("purchase", "success"), ("error", "failed"), ("view", "skipped"), ("click", "recovered")) for x in kv]), F.col("event_type"))
    e = table(spark, d, "events")
    inputs = F.array(F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string")))
    return e.select(F.col("event_id").alias("job_id"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("pipeline"), F.coalesce(state, F.lit("queued")).alias("state"), F.col("ts").alias("started"), (F.col("event_id") % 4).cast("long").alias("version"), inputs.alias("inputs"), F.floor("value").cast("long").alias("ms"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("datum_id"))


JOBS = """jobs AS (SELECT event_id AS job_id, 'p' || CAST(user_id % 10 AS VARCHAR) AS pipeline,
  CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'recovered' ELSE 'queued' END AS state,
  ts AS started, event_id % 4 AS version, ['a' || CAST(event_id % 7 AS VARCHAR), 'b' || CAST(event_id % 5 AS VARCHAR)] AS inputs, CAST(floor(value) AS BIGINT) AS ms, 'd' || CAST(event_id AS VARCHAR) AS datum_id FROM events)"""


# ---- views ----


@query("view_resolve", f"WITH {OPS}, {live('ops')} {VIEW}")
def view_resolve(spark, d):
    return view.resolve_view(ops(spark, d))


@query("view_at_commit", f"WITH {OPS}, upto AS (SELECT * FROM ops WHERE commit_no <= 3), {live('upto')} {VIEW}")
def view_at_commit(spark, d):
    return view.resolve_view(ops(spark, d).filter("commit_no <= 3"))


@query("view_empty_barrier", f"WITH {OPS}, after AS (SELECT * FROM ops WHERE commit_no > (SELECT max(commit_no) FROM ops WHERE commit_no % 40 = 1)), {live('after')} {VIEW}")
def view_empty_barrier(spark, d):
    o = ops(spark, d)
    return view.resolve_view(view.after_barrier(o, o.select("commit_no", (F.col("commit_no") % 40 == 1).alias("empty")).distinct()))


@query("list_files", f"WITH {FILES} SELECT path, size, hash FROM files")
def list_files(spark, d):
    return files(spark, d).select("path", "size", "hash")


@query("list_view_files", f"WITH {OPS}, {live('ops')}, v AS ({VIEW}) SELECT path, CAST(length(content) AS BIGINT) AS size, sha256(content) AS hash FROM v")
def list_view_files(spark, d):
    return view.list_files(view.resolve_view(ops(spark, d)))


@query("list_files_prefix", f"WITH {FILES} SELECT path, size FROM files WHERE starts_with(path, 'en/src1')")
def list_files_prefix(spark, d):
    return files(spark, d).filter(F.col("path").startswith(view.listing_prefix("/en/src1*"))).select("path", "size")


@query("get_file", f"WITH {OPS}, {live('ops')} SELECT path, content FROM ({VIEW}) WHERE path = 'u/7'")
def get_file(spark, d):
    return view.resolve_view(ops(spark, d).filter("path = 'u/7'")).select("path", "content")


@query("repo_size", f"WITH {FILES} SELECT source AS repo, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM files GROUP BY source")
def repo_size(spark, d):
    return files(spark, d).groupBy(F.col("source").alias("repo")).agg(F.sum("size").alias("size"), F.count("*").alias("n_files"))


_HISTORY = f"""WITH {OPS}, one AS (SELECT * FROM ops WHERE path = 'u/7'), c AS (SELECT DISTINCT commit_no FROM ops),
upto AS (SELECT c.commit_no AS cno, o.* EXCLUDE (commit_no) FROM c JOIN one o ON o.commit_no <= c.commit_no),
kept AS (SELECT *, max(CASE WHEN kind <> 'append' THEN seq END) OVER (PARTITION BY cno) AS reset FROM upto),
h AS (SELECT cno AS commit_no, string_agg(content, '' ORDER BY seq) AS content FROM kept WHERE kind <> 'delete' AND (reset IS NULL OR seq >= reset) GROUP BY cno)
SELECT commit_no, CAST(length(content) AS BIGINT) AS size, sha256(content) AS hash FROM h"""


@query("file_history", _HISTORY)
def file_history(spark, d):
    o = ops(spark, d)
    return view.file_history(o, "u/7", o.select("commit_no").distinct())


@query("file_history_limit", _HISTORY + " ORDER BY commit_no DESC LIMIT 5")
def file_history_limit(spark, d):
    o = ops(spark, d)
    return view.file_history(o, "u/7", o.select("commit_no").distinct(), limit=5)


@query("commit_diff_removed", f"WITH {OPS}, a AS (SELECT DISTINCT path FROM ops WHERE commit_no <= 2), b AS (SELECT DISTINCT path FROM ops WHERE commit_no = 3) SELECT path FROM a EXCEPT SELECT path FROM b")
def commit_diff_removed(spark, d):
    o = ops(spark, d)
    return view.removed_paths(o.filter("commit_no <= 2").select("path").distinct(), o.filter("commit_no = 3").select("path").distinct())


_SIZED = "SELECT path, CAST(length(content) AS BIGINT) AS size, sha256(content) AS hash FROM ({v})"


@query("commit_delta", f"""WITH {OPS}, o1 AS (SELECT * FROM ops WHERE commit_no <= 4), o2 AS (SELECT * FROM ops WHERE commit_no <= 5),
l1 AS (SELECT o.* FROM o1 o LEFT JOIN (SELECT path, max(seq) AS reset FROM o1 WHERE kind <> 'append' GROUP BY path) r USING (path) WHERE o.kind <> 'delete' AND (r.reset IS NULL OR o.seq >= r.reset)),
l2 AS (SELECT o.* FROM o2 o LEFT JOIN (SELECT path, max(seq) AS reset FROM o2 WHERE kind <> 'append' GROUP BY path) r USING (path) WHERE o.kind <> 'delete' AND (r.reset IS NULL OR o.seq >= r.reset)),
v1 AS ({_SIZED.format(v=VIEW.replace('live', 'l1'))}), v2 AS ({_SIZED.format(v=VIEW.replace('live', 'l2'))})
SELECT v2.path, CAST(CASE WHEN v1.hash IS NULL THEN v2.size WHEN v1.hash <> v2.hash THEN greatest(v2.size - v1.size, 0) ELSE 0 END AS BIGINT) AS delta FROM v2 LEFT JOIN v1 USING (path)""")
def commit_delta(spark, d):
    o = ops(spark, d)
    at = lambda n: view.list_files(view.resolve_view(o.filter(F.col("commit_no") <= n)))
    return view.commit_delta(at(4), at(5))


@query("type_conflicts", "WITH p AS (SELECT lang || '/' || source AS path FROM documents UNION SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) FROM documents) SELECT DISTINCT a.path FROM p a JOIN p b ON starts_with(b.path, a.path || '/')")
def type_conflicts(spark, d):
    docs = table(spark, d, "documents")
    folder = F.concat("lang", F.lit("/"), "source")
    paths = docs.select(folder.alias("path")).unionByName(docs.select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string")).alias("path")))
    return view.type_conflicts(paths.filter("path is not null"))


@query("copy_subtree", f"WITH {FILES} SELECT 'copy/de' || substr(path, 3) AS path, size, hash, 'append' AS kind FROM files WHERE starts_with(path, 'de/')")
def copy_subtree(spark, d):
    return view.copied(files(spark, d), "de", "copy/de").select("path", "size", "hash", "kind")


_SPLIT = "split AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(text, chr(10)) AS p FROM documents), parts AS (SELECT path, CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS p FROM split)"


@query("split_upload", f"WITH {_SPLIT} SELECT path || '/' || CAST(unnest(range(0, len(p))) AS VARCHAR) AS path, unnest(p) AS content FROM parts")
def split_upload(spark, d):
    return view.split_records(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "\n")


@query("split_upload_append", f"WITH {_SPLIT} SELECT path || '/' || CAST(unnest(range(0, len(p))) + CAST(path AS BIGINT) % 3 AS VARCHAR) AS path, unnest(p) AS content FROM parts")
def split_upload_append(spark, d):
    docs = table(spark, d, "documents")
    return view.split_records(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), "\n", existing=docs.select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 3).cast("int").alias("n")))


@query("split_header_change", f"WITH {_SPLIT} SELECT path || '/' || CAST(unnest(range(0, len(p) - 1)) AS VARCHAR) AS path, p[1] || chr(10) || unnest(p[2:]) AS content FROM parts WHERE len(p) > 1")
def split_header_change(spark, d):
    return view.split_records(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "\n", header_records=True)


_CHILDREN = """held AS (SELECT CAST(o_custkey AS VARCHAR) AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_custkey % 2 AS h, o_orderpriority AS rec FROM orders)"""


@query("split_header_rewrite", f"WITH {_CHILDREN} SELECT parent || '/' || CAST(k AS VARCHAR) AS path, 'h1' || chr(10) || rec AS content FROM held WHERE h = 0")
def split_header_rewrite(spark, d):
    o = table(spark, d, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    held = o.select(F.concat_ws("/", F.col("o_custkey").cast("string"), k.cast("string")).alias("path"), F.concat(F.lit("h"), (F.col("o_custkey") % 2).cast("string"), F.lit("\n"), "o_orderpriority").alias("content"))
    uploads = o.select(F.col("o_custkey").cast("string").alias("path"), F.lit("h1\nnew").alias("text")).distinct()
    return view.changed_headers(held, uploads, "\n")


# ---- globs and datums ----


@query("glob_files", f"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, '[^/]*/src1[^/]*/[^/]*5\\.txt')")
def glob_files(spark, d):
    return files(spark, d).filter(globs.matches(F.col("path"), "/*/src1*/*5.txt")).select("path")


@query("glob_question_class", f"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, '[d-f][^/]/src[^3]/[0-9][^/]\\.txt')")
def glob_question_class(spark, d):
    return files(spark, d).filter(globs.matches(F.col("path"), "/[d-f]?/src[^3]/[0-9]?.txt")).select("path")


@query("glob_dirs", f"WITH {FILES} SELECT lang || '/' || source AS datum, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY 1")
def glob_dirs(spark, d):
    f = files(spark, d)
    return globs.scan(f, "/*/*").join(f.select("path", "size"), "path").groupBy("datum").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))


@query("glob_root", f"WITH {FILES} SELECT '' AS datum, count(*) AS n_files FROM files")
def glob_root(spark, d):
    return globs.scan(files(spark, d), "/").groupBy("datum").agg(F.count("*").alias("n_files"))


@query("capture_key_multi", "SELECT page_id, regexp_extract(url, '^.*/(.*)-(.*)$', 2) || regexp_extract(url, '^.*/(.*)-(.*)$', 1) AS key FROM pages WHERE regexp_full_match(url, '.*/(.*)-(.*)')")
def capture_key_multi(spark, d):
    return table(spark, d, "pages").select("page_id", globs.capture_key(F.col("url"), "*/(*)-(*)", "$2$1").alias("key")).filter("key is not null")


def _named(spark, d, name, column, prefix):
    return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(column).cast("string")).alias("path"))


@query("cross_datums", "SELECT 'a=r' || CAST(r_regionkey AS VARCHAR) || '+b=n' || CAST(n_nationkey AS VARCHAR) AS datum_id FROM region CROSS JOIN nation")
def cross_datums(spark, d):
    return datums.cross([("a", _named(spark, d, "region", "r_regionkey", "r")), ("b", _named(spark, d, "nation", "n_nationkey", "n"))]).select("datum_id")


@query("cross_three_sides", "SELECT 'a=r' || CAST(r_regionkey AS VARCHAR) || '+b=n' || CAST(n_nationkey AS VARCHAR) || '+c=s' || CAST(s_suppkey AS VARCHAR) AS datum_id FROM region CROSS JOIN nation CROSS JOIN supplier")
def cross_three_sides(spark, d):
    return datums.cross([("a", _named(spark, d, "region", "r_regionkey", "r")), ("b", _named(spark, d, "nation", "n_nationkey", "n")), ("c", _named(spark, d, "supplier", "s_suppkey", "s"))]).select("datum_id")


def _ab(spark, d):
    return datums.keyed(fa(spark, d), globs.capture_key(F.col("path"), GLOB_A, "$1")), datums.keyed(fb(spark, d), globs.capture_key(F.col("path"), GLOB_B, "$1"))


@query("join_datums", f"WITH {FAB} SELECT ka.key, ka.path AS a, kb.path AS b FROM ka JOIN kb USING (key)")
def join_datums(spark, d):
    a, b = _ab(spark, d)
    return datums.join([("a", a), ("b", b)])


@query("join_three_members", "SELECT CAST(o_custkey AS VARCHAR) AS key, 'c' || CAST(c_custkey AS VARCHAR) AS a, 'o' || CAST(o_orderkey AS VARCHAR) AS b, 'p' || CAST(p_partkey AS VARCHAR) AS c FROM orders JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = o_custkey")
def join_three_members(spark, d):
    member = lambda t, k, p, i: table(spark, d, t).select(F.col(k).cast("string").alias("key"), F.concat(F.lit(p), F.col(i).cast("string")).alias("path"))
    return datums.join([("a", member("customer", "c_custkey", "c", "c_custkey")), ("b", member("orders", "o_custkey", "o", "o_orderkey")), ("c", member("part", "p_partkey", "p", "p_partkey"))])


@query("join_outer_only", f"WITH {FAB} SELECT key, path FROM ka WHERE key NOT IN (SELECT regexp_extract(path, '^item-(.*)\\..*$', 1) FROM fb WHERE path NOT LIKE '%7._')")
def join_outer_only(spark, d):
    a, b = _ab(spark, d)
    return datums.outer_leftovers([("a", a), ("b", b.filter("path not like '%7._'"))], "a")


@query("group_datums", f"WITH {FILES} SELECT source AS key, count(*) AS n_files, string_agg(path, ',' ORDER BY path) AS files FROM files GROUP BY source")
def group_datums(spark, d):
    return datums.group([("f", datums.keyed(files(spark, d), globs.capture_key(F.col("path"), "/*/(*)/*", "$1")))])


@query("group_multi_member", f"WITH {FAB}, every AS (SELECT key, 0 AS m, path FROM ka UNION ALL SELECT key, 1, path FROM kb) SELECT key, count(*) AS n_files, string_agg(path, ',' ORDER BY m, path) AS files FROM every GROUP BY key")
def group_multi_member(spark, d):
    a, b = _ab(spark, d)
    return datums.group([("a", a), ("b", b)])


@query("group_of_join", f"WITH {FAB} SELECT regexp_extract(ka.path, '^.*\\.(.).*$', 1) AS group_key, count(*) AS n_pairs, count(*) * 2 AS n_files FROM ka JOIN kb USING (key) WHERE regexp_extract(ka.path, '^.*\\.(.).*$', 1) = regexp_extract(kb.path, '^.*\\.(.)$', 1) GROUP BY 1")
def group_of_join(spark, d):
    a, b = _ab(spark, d)
    keys = [F.regexp_extract("a", r"^.*\.(.).*$", 1), F.regexp_extract("b", r"^.*\.(.)$", 1)]
    return datums.group_of_join(datums.join([("a", a), ("b", b)]), ["a", "b"], keys)


@query("union_merge", "WITH u AS (SELECT 'k/' || CAST(n_regionkey AS VARCHAR) AS path, n_name AS content, 0 AS b, CAST(n_nationkey AS BIGINT) AS o FROM nation UNION ALL SELECT 'k/' || CAST(r_regionkey AS VARCHAR), r_name, 1, 0 FROM region) SELECT path, string_agg(content, '' ORDER BY b, o) AS content, count(*) AS n_parts FROM u GROUP BY path")
def union_merge(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("k/"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_name").alias("content"), F.col("n_nationkey").alias("ord"))
    return datums.union([n, table(spark, d, "region").select(F.concat(F.lit("k/"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("content"))])


@query("union_of_cross", "WITH x AS (SELECT r_name, n_name, r_regionkey, n_nationkey FROM region CROSS JOIN nation), u AS (SELECT 'a/' || CAST(r_regionkey AS VARCHAR) AS path, r_name AS content, 0 AS b FROM x UNION ALL SELECT 'b/' || CAST(n_nationkey AS VARCHAR), n_name, 0 FROM x) SELECT path, string_agg(content, '') AS content, count(*) AS n_parts FROM u GROUP BY path")
def union_of_cross(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("path"), F.col("r_name").alias("content"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.col("n_name").alias("content"))
    return datums.union([datums.cross_paths(("a", r), ("b", n))])


@query("union_nested", "WITH u AS (SELECT 'in/' || CAST(s_nationkey AS VARCHAR) AS path, s_name AS content, 0 AS b, s_suppkey AS o FROM supplier UNION ALL SELECT 'in/' || CAST(n_nationkey AS VARCHAR), n_name, 1, 0 FROM nation) SELECT path, string_agg(content, '' ORDER BY b, o) AS content, count(*) AS n_parts FROM u GROUP BY path")
def union_nested(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("in/"), F.col("s_nationkey").cast("string")).alias("path"), F.col("s_name").alias("content"), F.col("s_suppkey").alias("ord"))
    return datums.union([s, table(spark, d, "nation").select(F.concat(F.lit("in/"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("content"))])


@query("chunk_by_number", f"WITH {FILES}, r AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS row_no, count(*) OVER () AS n FROM files) SELECT path, row_no, CAST(row_no // CAST(ceil(n / 7.0) AS BIGINT) AS BIGINT) AS chunk FROM r")
def chunk_by_number(spark, d):
    return datums.chunk_by_number(files(spark, d).select("path"), 7).select("path", "row_no", "chunk")


@query("chunk_by_bytes", f"""WITH RECURSIVE {FILES}, f AS (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY path) AS k FROM files),
c(source, k, held, n, chunk) AS (SELECT source, k, size, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM f WHERE k = 1
  UNION ALL SELECT f.source, f.k, CASE WHEN c.held + f.size > 20000 THEN f.size ELSE c.held + f.size END, CASE WHEN c.held + f.size > 20000 THEN 1 ELSE c.n + 1 END, CASE WHEN c.held + f.size > 20000 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN f ON f.source = c.source AND f.k = c.k + 1)
SELECT source, chunk, max(n) AS n_files, arg_max(held, k) AS size FROM c GROUP BY source, chunk""")
def chunk_by_bytes(spark, d):
    return datums.chunk_by_bytes(files(spark, d), 20000, "source")


@query("datum_hash", f"WITH {FILES} SELECT source AS datum_id, sha256(string_agg('in' || chr(0) || path || chr(0) || hash || chr(0), '' ORDER BY path)) AS hash, count(*) AS n_files FROM files GROUP BY source")
def datum_hash(spark, d):
    return datums.datum_hash(files(spark, d), "source", "in")


# ---- incremental runs ----

_DEDUP = "dedup AS (SELECT CAST(doc_id AS VARCHAR) AS datum_id, CASE WHEN toxic = 1 THEN 'recovered' ELSE 'success' END AS outcome, CASE WHEN quality = 0 THEN 'other' ELSE sha256(text) END AS hash FROM labels JOIN documents USING (doc_id))"


def _dedup(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.select(F.col("doc_id").cast("string").alias("datum_id"), F.when(F.col("toxic") == 1, "recovered").otherwise("success").alias("outcome"), F.when(F.col("quality") == 0, "other").otherwise(F.sha2("text", 256)).alias("hash"))


@query("dedup_skip", f"WITH {FILES}, {_DEDUP} SELECT CAST(doc_id AS VARCHAR) AS datum_id, coalesce(e.hash = f.hash, false) AS skipped FROM files f LEFT JOIN (SELECT * FROM dedup WHERE outcome = 'success') e ON e.datum_id = CAST(f.doc_id AS VARCHAR)")
def dedup_skip(spark, d):
    return incremental.skip_test(files(spark, d).select(F.col("doc_id").cast("string").alias("datum_id"), "hash"), _dedup(spark, d)).select("datum_id", "skipped")


@query("dedup_reprocess", f"WITH {FILES} SELECT CAST(doc_id AS VARCHAR) AS datum_id, false AS skipped FROM files")
def dedup_reprocess(spark, d):
    return incremental.skip_test(files(spark, d).select(F.col("doc_id").cast("string").alias("datum_id"), "hash"), _dedup(spark, d), reprocess=True).select("datum_id", "skipped")


_MERGE = """fresh AS (SELECT o_orderkey AS ord, 'm/' || CAST(o_custkey % 100 AS VARCHAR) AS path, CAST(o_orderkey AS VARCHAR) || ';' AS content FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0),
carried AS (SELECT o_orderkey AS ord, 'm/' || CAST(o_custkey % 100 AS VARCHAR) AS path, CAST(o_orderkey AS VARCHAR) || ';' AS content, CASE WHEN o_orderkey % 5 = 0 THEN 'v1' ELSE 'v2' END AS th FROM orders WHERE o_orderkey % 3 <> 0)"""


def _merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("datum_ord"), F.concat(F.lit("m/"), (F.col("o_custkey") % 100).cast("string")).alias("path"), F.concat(F.col("o_orderkey").cast("string"), F.lit(";")).alias("content"), "o_custkey", F.when(F.col("o_orderkey") % 5 == 0, "v1").otherwise("v2").alias("transform_hash"))
    return o.filter("datum_ord % 3 = 0 and o_custkey % 2 = 0"), o.filter("datum_ord % 3 <> 0")


@query("merge_outputs", f"WITH {_MERGE}, every AS (SELECT ord, path, content FROM fresh UNION ALL SELECT ord, path, content FROM carried WHERE NOT (th <> 'v2' AND path IN (SELECT path FROM fresh))) SELECT path, string_agg(content, '' ORDER BY ord) AS content, count(*) AS n_parts FROM every GROUP BY path")
def merge_outputs(spark, d):
    return incremental.merge_outputs(*_merge(spark, d), "v2")


@query("merge_outputs_stale", f"WITH {_MERGE}, every AS (SELECT ord, path, content FROM fresh UNION ALL SELECT ord, path, content FROM carried WHERE path NOT IN (SELECT path FROM fresh)) SELECT path, string_agg(content, '' ORDER BY ord) AS content, count(*) AS n_parts FROM every GROUP BY path")
def merge_outputs_stale(spark, d):
    return incremental.merge_outputs(*_merge(spark, d), "v3")


@query("job_counters", f"WITH {JOBS} SELECT pipeline, count(*) FILTER (state = 'success') AS processed, count(*) FILTER (state = 'recovered') AS recovered, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped FROM jobs GROUP BY pipeline")
def job_counters(spark, d):
    return incremental.job_counters(jobs(spark, d), "pipeline")


@query("job_progress", f"""WITH {JOBS}, x AS (SELECT *, state IN ('success', 'recovered', 'failed', 'skipped') AS done, CASE WHEN state <> 'skipped' AND ms > 0 THEN ms END AS ran FROM jobs)
SELECT pipeline, count(*) AS total, count(*) FILTER (done) AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'running') AS running, count(*) FILTER (NOT done AND state <> 'running') AS queued, CAST(floor(sum(ran) / count(ran)) AS BIGINT) AS avg_ms FROM x GROUP BY pipeline""")
def job_progress(spark, d):
    return incremental.job_progress(jobs(spark, d), "pipeline")


@query("job_counts_by_state", f"WITH {JOBS} SELECT pipeline, state, count(*) AS n FROM jobs GROUP BY pipeline, state")
def job_counts_by_state(spark, d):
    return catalog.counts_by_state(jobs(spark, d))


_PAGE = f"WITH {JOBS}, r AS (SELECT pipeline, datum_id, state, row_number() OVER (PARTITION BY pipeline ORDER BY CASE state WHEN 'failed' THEN 0 WHEN 'recovered' THEN 1 WHEN 'success' THEN 2 ELSE 3 END, datum_id) - 1 AS pos FROM jobs) SELECT pipeline, datum_id, state, pos FROM r WHERE pos // 10 = "


@query("datum_page", _PAGE + "0")
def datum_page(spark, d):
    return incremental.datum_page(jobs(spark, d), 0, 10, "pipeline").select("pipeline", "datum_id", "state", "pos")


@query("datum_page_last", _PAGE + "3")
def datum_page_last(spark, d):
    return incremental.datum_page(jobs(spark, d), 3, 10, "pipeline").select("pipeline", "datum_id", "state", "pos")


@query("failure_reasons", f"WITH {JOBS} SELECT pipeline, right(string_agg('datum ' || datum_id || ' failed: ms ' || CAST(ms AS VARCHAR), '; ' ORDER BY datum_id), 4000) AS reason FROM jobs WHERE state = 'failed' GROUP BY pipeline")
def failure_reasons(spark, d):
    return incremental.failure_reason(jobs(spark, d).withColumn("reason", F.concat(F.lit("ms "), F.col("ms").cast("string"))), "pipeline")


@query("stats_records", f"WITH {JOBS} SELECT lpad(CAST(row_number() OVER (ORDER BY job_id) - 1 AS VARCHAR), 6, '0') AS path, CAST(json_object('datum_id', datum_id, 'state', state, 'ms', ms) AS VARCHAR) AS record FROM jobs")
def stats_records(spark, d):
    rows = datums.numbered(jobs(spark, d).select("job_id", "datum_id", "state", "ms"), "job_id")
    return rows.select(F.lpad(F.col("row_no").cast("string"), 6, "0").alias("path"), F.to_json(F.struct("datum_id", "state", "ms"), {"ignoreNullFields": "false"}).alias("record"))


@query("worker_round_robin", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS BIGINT) AS worker FROM orders")
def worker_round_robin(spark, d):
    return datums.assign_workers(table(spark, d, "orders").select("o_orderkey"), 7, "o_orderkey").select("o_orderkey", "worker")


# ---- provenance and scheduling ----

_PAIRS = "c AS (SELECT event_id AS seq, 'p' || CAST(user_id % 10 AS VARCHAR) AS pipeline, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, 'c' || CAST(event_id AS VARCHAR) AS commit_id FROM events)"


def _commits(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("pipeline"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("side"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commit_id"))


@query("pair_heads", f"WITH {_PAIRS} SELECT pipeline, seq, last_value(CASE WHEN side = 'a' THEN commit_id END IGNORE NULLS) OVER w AS head_a, last_value(CASE WHEN side = 'b' THEN commit_id END IGNORE NULLS) OVER w AS head_b FROM c WINDOW w AS (PARTITION BY pipeline ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def pair_heads(spark, d):
    return dag.pair_heads(_commits(spark, d), ["a", "b"])


@query("pair_consistent", "SELECT l_orderkey AS pairing FROM (SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey % 3) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey HAVING max(n) = 1")
def pair_consistent(spark, d):
    return dag.consistent_pairings(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pairing"), F.col("l_returnflag").alias("source"), (F.col("l_suppkey") % 3).alias("leaf")))


@query("pair_duplicates", f"WITH {JOBS} SELECT pipeline, array_to_string(list_sort(list_distinct(inputs)), ',') AS inputs, count(*) AS n FROM jobs WHERE state IN ('queued', 'running') GROUP BY 1, 2 HAVING count(*) > 1")
def pair_duplicates(spark, d):
    return dag.same_inputs(jobs(spark, d), ["queued", "running"])


@query("provenance_closure", f"WITH RECURSIVE {EDGES} SELECT seed, node FROM reach")
def provenance_closure(spark, d):
    return dag.layered_closure(stages(spark, d))


@query("subvenants", f"WITH RECURSIVE {EDGES} SELECT node AS commit_id FROM reach WHERE seed = 'n3'")
def subvenants(spark, d):
    r = dag.layered_closure(stages(spark, d))
    return dag.subvenants(r.groupBy(F.col("node").alias("commit_id")).agg(F.collect_list("seed").alias("provenance")), "n3")


@query("flush_set", f"WITH RECURSIVE {EDGES} SELECT seed, count(*) AS n FROM reach WHERE seed LIKE 'r%' GROUP BY seed")
def flush_set(spark, d):
    return dag.layered_closure(stages(spark, d)).filter("seed like 'r%'").groupBy("seed").agg(F.count("*").alias("n"))


@query("flush_intersection", f"WITH RECURSIVE {EDGES} SELECT node FROM reach WHERE seed = 'r1' INTERSECT SELECT node FROM reach WHERE seed = 'n1'")
def flush_intersection(spark, d):
    return dag.flush_intersection(dag.layered_closure(stages(spark, d)), ["r1", "n1"])


@query("latest_per_pipeline", f"WITH {JOBS} SELECT pipeline, arg_max(job_id, started) AS job_id FROM jobs GROUP BY pipeline")
def latest_per_pipeline(spark, d):
    return dag.latest_per(jobs(spark, d), "pipeline", ["started"], "job_id")


@query("cascade_delete_survivors", f"WITH {OPS}, c AS (SELECT DISTINCT path AS repo, commit_no FROM ops), k AS (SELECT * FROM c WHERE commit_no % 3 <> 0) SELECT repo, commit_no, coalesce(lag(commit_no) OVER (PARTITION BY repo ORDER BY commit_no), -1) AS parent_no FROM k")
def cascade_delete_survivors(spark, d):
    c = ops(spark, d).select(F.col("path").alias("repo"), "commit_no").distinct()
    return dag.survivors(c, c.filter("commit_no % 3 = 0")).withColumn("parent_no", F.coalesce("parent_no", F.lit(-1).cast("long")))


@query("backlog_chain", f"WITH {OPS}, c AS (SELECT DISTINCT path AS repo, commit_no FROM ops) SELECT repo, commit_no FROM c WHERE commit_no > 5")
def backlog_chain(spark, d):
    return dag.backlog(ops(spark, d).select(F.col("path").alias("repo"), "commit_no", F.lit(5).alias("mark")).distinct(), "mark").select("repo", "commit_no")


# ---- catalog ----


@query("list_jobs_filtered", f"WITH {JOBS} SELECT job_id, pipeline, state FROM jobs WHERE pipeline = 'p3' AND state IN ('failed', 'success')")
def list_jobs_filtered(spark, d):
    return catalog.list_jobs(jobs(spark, d), "p3", ["failed", "success"]).select("job_id", "pipeline", "state")


@query("list_jobs_history", f"WITH {JOBS} SELECT job_id, j.pipeline, version FROM jobs j JOIN (SELECT pipeline, max(version) AS m FROM jobs GROUP BY pipeline) v ON v.pipeline = j.pipeline WHERE version >= m - 1")
def list_jobs_history(spark, d):
    j = jobs(spark, d)
    return catalog.within_history(j, j.select("pipeline", "version").distinct(), 1).select("job_id", "pipeline", "version")


@query("list_jobs_inputs", f"WITH {JOBS} SELECT job_id FROM jobs WHERE list_contains(inputs, 'a1') AND list_contains(inputs, 'b2')")
def list_jobs_inputs(spark, d):
    return catalog.list_jobs(jobs(spark, d), inputs=["a1", "b2"]).select("job_id")


@query("pipeline_version_ancestor", f"WITH {JOBS}, v AS (SELECT DISTINCT pipeline, version FROM jobs) SELECT pipeline, max(version) - 2 AS version FROM v GROUP BY pipeline HAVING list_contains(list(version), max(version) - 2)")
def pipeline_version_ancestor(spark, d):
    return catalog.version_ancestor(jobs(spark, d).select("pipeline", "version").distinct(), 2)


_LOGS = "logs AS (SELECT event_id AS pos, 'p' || CAST(user_id % 10 AS VARCHAR) AS pipeline, event_type AS datum, ts AS t, props AS line FROM events)"


def _logs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("pipeline"), F.col("event_type").alias("datum"), F.col("ts").alias("t"), F.col("props").alias("line"))


@query("logs_since", f"WITH {_LOGS} SELECT pos, line FROM logs WHERE pipeline = 'p1' AND t >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def logs_since(spark, d):
    cut = table(spark, d, "events").agg((F.max("ts") - F.expr("interval 7 days")).alias("cut"))
    return catalog.filter_logs(_logs(spark, d).join(F.broadcast(cut)), pipeline="p1", since=F.col("cut")).select("pos", "line")


@query("logs_by_datum", f"WITH {_LOGS} SELECT pos, line FROM logs WHERE pipeline = 'p2' AND datum = 'error'")
def logs_by_datum(spark, d):
    return catalog.filter_logs(_logs(spark, d), pipeline="p2", datum="error").select("pos", "line")


@query("logs_global_order", "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_no, conv_id, turn, role FROM conversations")
def logs_global_order(spark, d):
    # the SQL leaves rows of the same turn in any order; here their role decides
    return datums.numbered(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn", "role"]).select("row_no", "conv_id", "turn", "role")


@query("gc_unreferenced", "SELECT DISTINCT sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0) AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)")
def gc_unreferenced(spark, d):
    docs = table(spark, d, "documents")
    sha = lambda df: df.select(F.sha2("text", 256).alias("sha"))
    return catalog.unreferenced(sha(docs).distinct(), [sha(docs.filter("doc_id % 3 <> 0")), sha(table(spark, d, "benchmark"))])


@query("tag_lookup", "WITH t AS (SELECT 't' || CAST(doc_id % 20 AS VARCHAR) AS name, doc_id AS seq, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS ref FROM documents) SELECT name, ref FROM t JOIN (SELECT name, max(seq) AS seq FROM t GROUP BY name) USING (name, seq) WHERE ref IS NOT NULL")
def tag_lookup(spark, d):
    t = table(spark, d, "documents").select(F.concat(F.lit("t"), (F.col("doc_id") % 20).cast("string")).alias("name"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 7 != 0, F.sha2("text", 256)).alias("ref"))
    return catalog.latest_tags(t)


@query("metrics_latency", "SELECT event_type AS op, CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'success' END AS outcome, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms FROM events GROUP BY 1, 2")
def metrics_latency(spark, d):
    return catalog.latency_metrics(table(spark, d, "events").select(F.col("event_type").alias("op"), F.when(F.col("event_id") % 9 == 0, "error").otherwise("success").alias("outcome"), F.floor("value").cast("long").alias("ms")))


@query("node_mem_perc", "SELECT s_suppkey AS node, CAST(s_suppkey % 50 AS BIGINT) AS used, CAST(s_suppkey % 60 AS BIGINT) AS total, CASE WHEN s_suppkey % 60 > 0 THEN CAST(floor(100.0 * (s_suppkey % 50) / (s_suppkey % 60)) AS BIGINT) ELSE -1 END AS mem_perc FROM supplier")
def node_mem_perc(spark, d):
    return catalog.memory_percent(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 50).alias("used"), (F.col("s_suppkey") % 60).alias("total"))).fillna(-1, ["mem_perc"])


@query("host_pick", "SELECT 'l' || CAST(s_nationkey AS VARCHAR) AS label, min(s_name) AS host FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def host_pick(spark, d):
    s = table(spark, d, "supplier")
    label = F.concat(F.lit("l"), F.col("s_nationkey").cast("string"))
    return catalog.pick_host(s.select(F.col("s_name").alias("name"), F.array(label).alias("labels"), (F.col("s_acctbal") > 0).alias("live")), s.select(label.alias("label")).distinct())


@query("path_functions", f"WITH {FILES} SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '[^A-Za-z0-9_]', '_', 'g') AS ident FROM files")
def path_functions(spark, d):
    return files(spark, d).select("path", basename(F.col("path")).alias("base"), identifier(F.col("path")).alias("ident"))


@query("memory_units", "SELECT p_partkey, CAST(p_size * 1048576 AS BIGINT) AS bytes, CASE WHEN p_size * 1 < 1024 THEN CAST(p_size AS VARCHAR) || 'B' END AS human FROM part")
def memory_units(spark, d):
    return table(spark, d, "part").select("p_partkey", memory_bytes(F.concat(F.col("p_size").cast("string"), F.lit("MiB"))).alias("bytes"), human_size(F.col("p_size").cast("long")).alias("human"))


@query("version_order", "SELECT max([p_size, p_partkey % 10])[1] AS major, max([p_size, p_partkey % 10])[2] AS minor FROM part")
def version_order(spark, d):
    v = version_key(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string")))
    return table(spark, d, "part").agg(F.max(v).alias("v")).select(F.col("v")[0].cast("long").alias("major"), F.col("v")[1].cast("long").alias("minor"))


# ---- triggers and schedules ----

_TRIG = "t AS (SELECT source AS pipeline, doc_id AS seq, CAST(octet_length(encode(text)) AS BIGINT) AS size, sum(CAST(octet_length(encode(text)) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents)"


def _trig(spark, d):
    return triggers.size_trigger(files(spark, d).select(F.col("source").alias("pipeline"), F.col("doc_id").alias("seq"), "size"), 30000)


@query("size_trigger_fires", f"WITH {_TRIG} SELECT pipeline, seq, CAST(total // 30000 - (total - size) // 30000 AS BIGINT) AS fires FROM t WHERE total // 30000 > (total - size) // 30000")
def size_trigger_fires(spark, d):
    return _trig(spark, d).filter("fires > 0").select("pipeline", "seq", "fires")


@query("size_trigger_snapshot", f"WITH {_TRIG} SELECT pipeline, CAST(sum(total // 30000 - (total - size) // 30000) AS BIGINT) AS fires, CAST(sum(size) % 30000 AS BIGINT) AS ledger FROM t GROUP BY pipeline")
def size_trigger_snapshot(spark, d):
    return _trig(spark, d).groupBy("pipeline").agg(F.sum("fires").alias("fires"), F.max_by("ledger", "seq").alias("ledger"))


@query("cron_ticks", "WITH b AS (SELECT date_trunc('day', min(ts)) AS s, date_trunc('day', max(ts)) AS e FROM events) SELECT strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS name FROM (SELECT unnest(generate_series(s, e, INTERVAL 6 HOUR)) AS t FROM b)")
def cron_ticks(spark, d):
    b = table(spark, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.date_trunc("day", F.col("a").cast("timestamp")).alias("start"), F.date_trunc("day", F.col("b").cast("timestamp")).alias("end"))
    return triggers.cron_ticks(b, 6 * 3600).select("name")


@query("cron_ticks_overwrite", "SELECT strftime(date_trunc('day', max(ts)), '%Y-%m-%dT%H:%M:%SZ') AS name FROM events")
def cron_ticks_overwrite(spark, d):
    b = table(spark, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.date_trunc("day", F.col("a").cast("timestamp")).alias("start"), F.date_trunc("day", F.col("b").cast("timestamp")).alias("end"))
    return triggers.cron_ticks(b, 24 * 3600).agg(F.max("name").alias("name"))


@query("egress_roundtrip", f"WITH {FILES} SELECT path, size, hash FROM files")
def egress_roundtrip(spark, d):
    from .sources.egress import egress, read_back

    return read_back(spark, egress(files(spark, d).select("path", "size", "hash")))
