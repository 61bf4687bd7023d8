"""Registered queries over the fixed tables and their DuckDB equivalents.

Every query reads whole tables. Small inline tables (rules, layers, goldens) are the
operators' parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import migrating, paths, scanning, text
from quarry.functions.replacing import replace_udf
from quarry.operators import changes, config_layers, content, documents, graph, hooks, index, locations, patching, policy, pysource, reexports, related, search, transcripts
from quarry.operators.shared import fresh_path
from quarry.plans import goldens
from quarry.session import table
from quarry.streaming import expiry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EXAMPLES: dict[str, Query] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a query under its function's name, with its oracle where SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def example(f: Query) -> Query:
    """Inline goldens, which the tests run; they read no table, so they are no registered queries."""
    EXAMPLES[f.__name__] = f
    return f


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce("text", F.lit("")))


# -- content ---------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.hashed(table(spark, sf_dir, "documents"), "text", "doc_id")


_SLICE = """
WITH l AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts,
             len(string_split(t, chr(10))) - CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 1 ELSE 0 END AS n
           FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, {fields} FROM (
  SELECT doc_id, n, t, CASE WHEN least(n, {e}) <= {s} THEN '' ELSE array_to_string(list_slice(parts, {s} + 1, least(n, {e})), chr(10))
     || CASE WHEN least(n, {e}) < n OR ends_with(t, chr(10)) THEN chr(10) ELSE '' END END AS content, least(n, {e}) AS last FROM l)
"""


@query(_SLICE.format(s=1, e=3, fields="content, CAST(1 AS BIGINT) AS returned_start, CAST(greatest(1, last) AS BIGINT) AS returned_end, last < n AS has_more"))
def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _text(table(spark, sf_dir, "documents")).select("doc_id", content.line_slice(F.col("text"), 1, 3).alias("s"))
    return d.select("doc_id", "s.content", "s.returned_start", "s.returned_end", "s.has_more")


@query()
def byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _text(table(spark, sf_dir, "documents")).select("doc_id", content.line_slice(F.col("text"), 0, 100, 1024).alias("s"))
    return d.select("doc_id", "s.content", "s.truncated", "s.has_more")


@query(
    """
WITH l AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS parts, len(string_split(t, chr(10))) - CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 1 ELSE 0 END AS n FROM l)
SELECT doc_id, sha256(t) AS sha256, CAST(strlen(t) AS BIGINT) AS size, CAST(n AS BIGINT) AS n_lines,
  CASE WHEN n = 0 THEN '' ELSE array_to_string(list_slice(parts, 1, least(n, 2)), chr(10)) || CASE WHEN n > 2 OR ends_with(t, chr(10)) THEN chr(10) ELSE '' END END AS content,
  n > 2 AS has_more, 'text' AS kind FROM c
"""
)
def inspect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _text(table(spark, sf_dir, "documents"))
    cap = content.capabilities(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), content.is_binary(F.col("text")), F.lit(None).cast("int"))
    d = d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), content.line_count(F.col("text")).alias("n_lines"), content.line_slice(F.col("text"), 0, 2).alias("s"), cap.alias("c"))
    return d.select("doc_id", "sha256", "size", "n_lines", "s.content", "s.has_more", "c.kind")


_LANGUAGE_CASE = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items()) + " END"


@query(
    f"""
WITH e AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/](\\.[^./]*)$', 1)) AS ext FROM pages)
SELECT page_id, coalesce(ext, '') AS ext, coalesce({_LANGUAGE_CASE}, 'none') AS language,
  CASE WHEN ext IN ('.json', '.jsonc', '.toml', '.yaml', '.yml') THEN 'document' WHEN {_LANGUAGE_CASE} IS NOT NULL THEN 'source' ELSE 'text' END AS kind FROM e
"""
)
def capabilities_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("u"), content.is_binary(F.coalesce("html", F.lit(""))).alias("b"))
    c = content.capabilities(F.col("u"), F.col("b"), F.lit(None).cast("int"))
    return p.select("page_id", F.coalesce(paths.extension(F.col("u")), F.lit("")).alias("ext"), c.alias("c")).select("page_id", "ext", F.coalesce("c.language", F.lit("none")).alias("language"), "c.kind")


@query("SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[\\x{0000}-\\x{FFFF}]', '', 'g')) AS BIGINT) AS utf16, md5(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')) AS plain FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _text(table(spark, sf_dir, "documents"))
    return d.select("doc_id", text.utf16_length(F.col("text")).alias("utf16"), F.md5(text.normalize_newlines(F.col("text")).cast("binary")).alias("plain"))


# -- documents -------------------------------------------------------------------------


@query("SELECT event_id, props->>'/k' AS k FROM events")
def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", documents.fixed_pointer(F.col("props"), "/k").alias("k"))


@query(
    """
SELECT event_id, '' AS pointer, 0 AS "start", CAST(length(props) AS INTEGER) AS "end", props AS value FROM events WHERE json_valid(props)
UNION ALL SELECT event_id, '/k', CAST(strpos(props, ':') + 1 AS INTEGER), CAST(length(props) - 1 AS INTEGER), CAST(json_extract(props, '/k') AS VARCHAR) FROM events WHERE json_valid(props)
"""
)
def json_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every value of ``props`` stands, and what stands there."""
    found = locations.located(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "props", F.explode("values").alias("v"))
    return found.select("event_id", "v.*", F.expr("substring(props, v.start + 1, v.end - v.start)").alias("value"))


@query("SELECT event_id, CASE WHEN json_type(props, '/k') IS NULL THEN 'missing' WHEN json_type(props, '/k') = 'NULL' THEN 'null' ELSE 'value' END AS k_state, 'missing' AS absent_state FROM events")
def json_pointer_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", documents.null_state(F.col("props"), "k").alias("k_state"), documents.null_state(F.col("props"), "absent").alias("absent_state"))


@query("SELECT event_id, CAST(json_extract(props, '/k') AS VARCHAR) AS value, TRUE AS present FROM events")
def document_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", documents.query_udf("props", F.lit(".json"), F.lit("/k")).alias("r"))
    return e.select("event_id", "r.value", "r.present")


# -- transcripts -----------------------------------------------------------------------


@query(
    """
WITH a AS (SELECT user_id, min((epoch_us(ts), event_id)) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id),
b AS (SELECT a.user_id, v, min((epoch_us(ts), event_id)) FILTER (event_type = 'click' AND (epoch_us(ts), event_id) > v) AS c FROM a JOIN events e ON a.user_id = e.user_id GROUP BY a.user_id, v),
d AS (SELECT b.user_id, count(*) FILTER (event_type = 'purchase' AND (epoch_us(ts), event_id) > c) > 0 AS ok FROM b JOIN events e ON b.user_id = e.user_id GROUP BY b.user_id)
SELECT user_id, coalesce(ok, FALSE) AS in_order FROM d
"""
)
def ordered_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type"))), lambda x: x.event_type)
    wanted = F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))
    return e.groupBy("user_id").agg(seq.alias("s")).select("user_id", transcripts.ordered_subsequence(wanted, F.col("s")).alias("in_order"))


#: Sessions made of the conversations: an assistant turn is a call, its output is the user turn after it.
_SCORED = """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (SELECT c.session, c.turn, o.text AS output, o.turn IS NOT NULL AS answered FROM t c LEFT JOIN t o ON o.session = c.session AND o.turn = c.turn + 1 AND o.role <> 'assistant' WHERE c.role = 'assistant'),
loose AS (SELECT o.session, count(*) AS n FROM t o WHERE o.role <> 'assistant' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.session = o.session AND c.turn = o.turn - 1 AND c.role = 'assistant') GROUP BY 1),
per AS (SELECT session, count(*) AS batches, count(*) FILTER (answered) AS answered, coalesce(sum(length(output) + length(regexp_replace(output, '[\\x{{0000}}-\\x{{FFFF}}]', '', 'g'))) FILTER (answered), 0) AS chars,
  count(*) FILTER (NOT answered OR output = '') AS faults FROM calls GROUP BY 1),
alls AS (SELECT DISTINCT session FROM t)
SELECT {fields} FROM alls a LEFT JOIN per p ON p.session = a.session LEFT JOIN loose l ON l.session = a.session
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    call = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("custom_tool_call").alias("type"), F.col("turn").cast("string").alias("call_id"), F.lit("mcp__tools__search").alias("name"), F.to_json(F.struct(F.left(F.coalesce("text", F.lit("")), F.lit(40)).alias("query"))).alias("input")).alias("payload")))
    answer = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("custom_tool_call_output").alias("type"), (F.col("turn") - 1).cast("string").alias("call_id"), F.coalesce("text", F.lit("")).alias("output")).alias("payload")))
    line = F.when(F.col("role") == "assistant", call).otherwise(answer)
    return c.groupBy(F.col("conv_id").cast("string").alias("session")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n").alias("text"))


@query(
    _SCORED.format(
        fields="""a.session, coalesce(batches, 0) AS batches, coalesce(batches, 0) AS unscored_batches, CAST(coalesce(chars, 0) AS BIGINT) AS output_chars, CAST(0 AS BIGINT) AS mutation_calls, coalesce(batches, 0) AS invocations,
  CAST(0 AS DOUBLE) AS batch_density, CASE WHEN batches > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS calls_per_turn, CASE WHEN answered > 0 THEN 'search=' || answered ELSE '' END AS tool_calls,
  coalesce(faults, 0) + coalesce(n, 0) AS n_errors, coalesce(faults, 0) + coalesce(n, 0) = 0 AS passed"""
    )
)
def transcript_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = transcripts.score(_sessions(spark, sf_dir), goldens.cases(spark))
    return s.select("session", "batches", "unscored_batches", "output_chars", "mutation_calls", "invocations", "batch_density", "calls_per_turn", "tool_calls", F.size("errors").cast("long").alias("n_errors"), "passed")


@query(
    """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT 'missing output for call ID: ' || c.turn AS error, session FROM t c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM t o WHERE o.session = c.session AND o.turn = c.turn + 1 AND o.role <> 'assistant')
UNION ALL SELECT 'unmatched output ID: ' || (o.turn - 1), session FROM t o WHERE role <> 'assistant' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.session = o.session AND c.turn = o.turn - 1 AND c.role = 'assistant')
UNION ALL SELECT 'empty output for call ID: ' || c.turn, c.session FROM t c JOIN t o ON o.session = c.session AND o.turn = c.turn + 1 WHERE c.role = 'assistant' AND o.role <> 'assistant' AND o.text = ''
"""
)
def transcript_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without an output, outputs without a call, and empty outputs."""
    recs = transcripts.records(transcripts.lines(_sessions(spark, sf_dir)))
    return transcripts.errors(recs, transcripts.calls(recs), transcripts.outputs(recs))


@query(
    """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, role, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations),
u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY session ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM t)
SELECT session, CAST(line AS INTEGER) AS line, CASE WHEN asked IS NULL THEN '' ELSE CAST(conv_id * 100 + asked AS VARCHAR) END AS eval_ids FROM u WHERE role = 'assistant'
"""
)
def bind_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation that is active at each call: the one that the last user message names."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("eval:"), (F.col("conv_id") * 100 + F.col("turn")).cast("string"))
    item = lambda *fields: F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(*fields).alias("payload")))
    call = item(F.lit("custom_tool_call").alias("type"), F.col("turn").cast("string").alias("call_id"), F.lit("mcp__tools__search").alias("name"), F.lit("{}").alias("input"))
    message = item(F.lit("message").alias("type"), F.col("role").alias("role"), said.alias("content"))
    line = F.when(F.col("role") == "assistant", call).otherwise(message)
    sessions = c.groupBy(F.col("conv_id").cast("string").alias("session")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n").alias("text"))
    calls = transcripts.calls(transcripts.records(transcripts.lines(sessions)))
    return calls.select("session", F.col("line").cast("int").alias("line"), F.array_join(F.transform("eval_ids", lambda x: x.cast("string")), ",").alias("eval_ids"))


_ORDERED = """
a AS (SELECT user_id, min((epoch_us(ts), event_id)) FILTER (event_type = 'click') AS v FROM events GROUP BY user_id),
b AS (SELECT a.user_id, v, min((epoch_us(ts), event_id)) FILTER (event_type = 'purchase' AND (epoch_us(ts), event_id) > v) AS c FROM a JOIN events e ON a.user_id = e.user_id GROUP BY a.user_id, v),
o AS (SELECT b.user_id, count(*) FILTER (event_type = 'view' AND (epoch_us(ts), event_id) > c) > 0 AS ok FROM b JOIN events e ON b.user_id = e.user_id GROUP BY b.user_id)
"""


@query(
    f"""
WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS used FROM events WHERE event_type <> 'error' OR event_id % 7 = 0 GROUP BY user_id),
events AS (SELECT * FROM events WHERE event_type <> 'error' OR event_id % 7 = 0), {_ORDERED},
m AS (SELECT u.user_id, array_to_string(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(used, x)), ', ') AS missing, list_contains(used, 'error') AS bad, coalesce(ok, FALSE) AS ok FROM u JOIN o ON o.user_id = u.user_id)
SELECT CAST(user_id AS VARCHAR) AS session, CASE WHEN missing <> '' THEN 'missing tools: ' || missing WHEN bad THEN 'forbidden tools: error' WHEN NOT ok THEN 'tools out of order' END AS problem,
  CAST(CASE WHEN missing = '' AND NOT bad AND ok THEN 2 ELSE 0 END AS BIGINT) AS assertions FROM m
"""
)
def case_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required and forbidden tools and their order, users as sessions and events as calls; a seventh of the errors is seen."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error' OR event_id % 7 = 0")
    call = F.array(F.struct(F.col("event_type").alias("tool"), F.col("props").alias("input"), F.lit(False).alias("concurrent")))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    bound = e.select(F.col("user_id").cast("string").alias("session"), at.alias("line"), call.alias("invocations"), F.array(F.lit(1).cast("long")).alias("eval_ids"), F.lit(False).alias("failed"), F.lit("x").alias("output"))
    cases = spark.createDataFrame([(1, ["click", "purchase", "view"], ["error"], ["a", "b"])], "id int, required_tools array<string>, forbidden_tools array<string>, assertions array<string>")
    return transcripts.evaluate(bound, cases).select("session", "problem", "assertions")


@query("SELECT CAST(user_id AS VARCHAR) AS session, coalesce(min((epoch_us(ts), event_id)) FILTER (event_type = 'signup') < min((epoch_us(ts), event_id)) FILTER (event_type = 'purchase'), FALSE) AS hashed_first FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0")
def hash_before_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    inv = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), at.alias("number"), F.col("event_type").alias("tool"))
    return transcripts.hashed_first(inv, hashes=("signup",), mutations=("purchase",))


@query(
    """
WITH c AS (SELECT d.doc_id AS id, d.source AS surface, CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'variant' ELSE 'none' END AS category, d.doc_id % 5 AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
p AS (SELECT surface, count(*) AS n, list(DISTINCT category) AS got FROM c GROUP BY 1)
SELECT 'unknown surface: ' || surface AS problem FROM (SELECT DISTINCT surface FROM c WHERE surface NOT IN ('web', 'books'))
UNION ALL SELECT 'fewer than 3 cases: ' || surface FROM p WHERE n < 3
UNION ALL SELECT surface || ' has no case of category ' || x FROM (SELECT surface, got, unnest(['positive', 'variant', 'negative']) AS x FROM p) WHERE NOT list_contains(got, x)
UNION ALL SELECT 'fewer than 3 assertions: ' || id FROM c WHERE n < 3
"""
)
def suite_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a case table; documents as cases and sources as surfaces."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    category = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "variant").otherwise("none")
    cases = d.select(F.col("doc_id").alias("id"), F.col("source").alias("surface"), category.alias("category"), F.array_repeat(F.lit("a"), (F.col("doc_id") % 5).cast("int")).alias("assertions"))
    return transcripts.suite_problems(cases, ["web", "books"])


@example
def transcript_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = transcripts.score(goldens.sessions(spark), goldens.cases(spark))
    return s.withColumn("errors", F.array_join("errors", "; "))


# -- policy and configuration ------------------------------------------------------------


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/site/"), F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")).alias("path"))


_PATH_SQL = "(SELECT page_id, '/site/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages)"


@query(
    f"""
WITH p AS {_PATH_SQL},
c AS (
  SELECT page_id, path, 'site' AS rule_id, 'allow' AS policy, 2 * 10000 AS s, 0 AS k, 0 AS o FROM p WHERE starts_with(path, '/site/')
  UNION ALL SELECT page_id, path, 'french', 'request', 20000, 1, 1 FROM p WHERE starts_with(path, '/site/') AND regexp_matches(path, '^/site/(.+/)?fr/[^/]*$')
  UNION ALL SELECT page_id, path, 'english', 'deny', 20000, 2, 2 FROM p WHERE starts_with(path, '/site/') AND regexp_matches(path, '^/site/(.+/)?en/[^/]*$') AND NOT regexp_matches(path, '^/site/m\\.[^/]*/')
)
SELECT page_id, arg_max(policy, (s, k, -o)) AS policy, arg_max(rule_id, (s, k, -o)) AS rule_id, CAST(max(s) AS BIGINT) AS specificity FROM c GROUP BY page_id
"""
)
def policy_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        policy.Rule("site", "/site", "allow", "request"),
        policy.Rule("french", "/site", "request", "deny", includes=("**/fr/*",)),
        policy.Rule("english", "/site", "deny", "deny", includes=("**/en/*",), excludes=("m.*/**",)),
    ]
    p = _page_paths(spark, sf_dir)
    d = policy.decide(p.select("path", F.lit("read").alias("operation")), rules, policy.Baseline(("/site",)))
    return p.join(d, "path").select("page_id", "policy", "rule_id", "specificity")


@query(
    f"""
SELECT page_id, CASE WHEN starts_with(path, '/site/m.') AND regexp_matches(path, '^/site/m\\.') THEN '/site' WHEN starts_with(path, '/site/') THEN '/site' END AS root,
  CASE WHEN regexp_matches(path, '/en/[^/]*$') THEN 'english' WHEN starts_with(path, '/site/') THEN 'any' END AS formatter FROM {_PATH_SQL}
"""
)
def longest_prefix_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy.longest_root(_page_paths(spark, sf_dir), "path", ["/", "/site", "/site/unused"])
    f = policy.first_formatter(p, "path", [("off", (), ("**",), False), ("english", (), ("**/en/*",), True), ("any", (".html",), ("**",), True)])
    return f.select("page_id", "root", "formatter")


@query("SELECT count(DISTINCT n_regionkey) AS roots, (SELECT count(DISTINCT c) FROM (SELECT string_agg(CAST(n_nationkey % 3 AS VARCHAR), ',' ORDER BY n_nationkey % 3) AS c FROM nation GROUP BY n_regionkey)) <= 1 AS equal FROM nation")
def conflicting_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all roots have the same rules; regions as roots and their nations as rules."""
    n = table(spark, sf_dir, "nation")
    return config_layers.conflicts(n.select(F.col("n_regionkey").alias("root"), (F.col("n_nationkey") % 3).cast("string").alias("rule")))


@query(
    """
WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier), d AS (SELECT k FROM a EXCEPT ALL SELECT k FROM b), e AS (SELECT k FROM b EXCEPT ALL SELECT k FROM a)
SELECT (SELECT count(*) FROM d) + (SELECT count(*) FROM e) = 0 AS equal
"""
)
def policy_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset equality of two tables that hold the same values, but not as often."""
    return changes.same_multiset(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


_LAYERS = """
(SELECT 'nation.' || n_nationkey AS leaf, 'default' AS layer, 0 AS layer_ord, n_name AS value FROM nation
 UNION ALL SELECT 'nation.' || n_nationkey, 'global', 1, CASE WHEN n_regionkey % 2 = 0 THEN upper(n_name) || '-g' END FROM nation
 UNION ALL SELECT 'nation.' || n_nationkey, 'project', 2, CASE WHEN n_regionkey = 1 THEN n_name || '-p' END FROM nation)
"""


@query(f"SELECT leaf, arg_max(value, layer_ord) AS value, arg_max(layer, layer_ord) AS provenance FROM {_LAYERS} WHERE value IS NOT NULL GROUP BY leaf")
def layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    leaf = F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("leaf")
    layer = lambda name, order, value: n.select(leaf, F.lit(name).alias("layer"), F.lit(order).alias("layer_ord"), value.alias("value"))
    leaves = layer("default", 0, F.col("n_name")).unionByName(layer("global", 1, F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.upper("n_name"), F.lit("-g"))))).unionByName(layer("project", 2, F.when(F.col("n_regionkey") == 1, F.concat("n_name", F.lit("-p")))))
    return config_layers.merge(leaves).select("leaf", "value", "provenance")


@query(
    """
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderpriority <> '1-URGENT'
           UNION ALL SELECT -o_orderkey - 1, o_totalprice FROM orders WHERE o_orderpriority = '5-LOW')
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'new' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM orders b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.o_totalprice IS DISTINCT FROM a.v OR a.o_orderkey IS NULL OR b.o_orderkey IS NULL
"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    after = o.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", price.alias("v")).unionByName(o.where("o_orderpriority = '5-LOW'").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_totalprice").alias("v")))
    return changes.snapshot_diff(o.select("o_orderkey", F.col("o_totalprice").alias("v")), after, "o_orderkey", "v")


# -- graph -----------------------------------------------------------------------------

_EDGES = """(SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the supplier of every line to that of the order's next line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"))
    return e.where("dst IS NOT NULL").distinct()


def _start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("node"))


def _levels(edges: str, start: str, depth: int) -> str:
    """CTEs of a breadth-first search written out level by level."""
    parts = [f"e AS {edges}", f"s0 AS ({start})"]
    seen = "SELECT NULL::BIGINT AS node WHERE FALSE"
    for i in range(1, depth + 1):
        parts.append(f"s{i} AS (SELECT DISTINCT e.dst AS node FROM e JOIN s{i - 1} p ON e.src = p.node WHERE e.dst NOT IN (SELECT node FROM ({seen})))")
        seen += f" UNION ALL SELECT node FROM s{i}"
    return "WITH " + ", ".join(parts)


def _reach_sql(edges: str, depth: int) -> str:
    union = " UNION ALL ".join(f"SELECT node, CAST({i} AS INTEGER) AS depth FROM s{i}" for i in range(1, depth + 1))
    return f"{_levels(edges, 'SELECT max(s_suppkey) AS node FROM supplier', depth)} {union}"


_REVERSED = f"(SELECT dst AS src, src AS dst FROM {_EDGES})"


@query(_reach_sql(_EDGES, 3))
def deps_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), _start(spark, sf_dir), 3)


@query(_reach_sql(_REVERSED, 3))
def reverse_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(graph.reversed_edges(_edges(spark, sf_dir)), _start(spark, sf_dir), 3)


@query(f"SELECT src, dst, dst % 5 = 0 AS external FROM {_EDGES}")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 5 != 0").select(F.col("s_suppkey").alias("node"))
    return graph.tagged(_edges(spark, sf_dir), known)


@query()
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive SQL would make all pairs that reach each other; a test has brute force."""
    return graph.cycles(_edges(spark, sf_dir))


#: From each order to the customer's next, and to the next of the 64 keys it is among: as sparse as the orders are many.
_ORDERS = """(SELECT DISTINCT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders
UNION ALL SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) FROM orders) WHERE dst IS NOT NULL)"""


def _next_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr("o_orderkey AS src", "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst").where("dst IS NOT NULL")


@query(
    """
WITH g AS (SELECT o_custkey, min(o_orderkey) AS component, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey HAVING count(*) > 1)
SELECT component, o_orderkey AS node FROM orders JOIN g USING (o_custkey)
"""
)
def cycles_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders are a chain; those of every third customer end where they begin."""
    ends = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("src"), F.min("o_orderkey").alias("dst")).where("src <> dst")
    return graph.cycles(_next_orders(spark, sf_dir).unionByName(ends.select("src", "dst")))


def _order_trace_sql(hops: int) -> str:
    ends = "f AS (SELECT min(o_orderkey) AS a FROM orders), n AS (SELECT min(dst) AS n FROM e, f WHERE src = a), c AS (SELECT o_custkey FROM orders, n WHERE o_orderkey = n), g AS (SELECT a, max(o_orderkey) AS b FROM f, orders JOIN c USING (o_custkey) GROUP BY a)"
    parts = [f"e AS MATERIALIZED {_ORDERS}", ends, "s0 AS (SELECT a AS node, [a] AS path FROM g)"]
    seen = "SELECT NULL::BIGINT AS node WHERE FALSE"
    for i in range(1, hops + 1):
        parts.append(f"s{i} AS MATERIALIZED (SELECT e.dst AS node, min(list_append(p.path, e.dst)) AS path FROM e JOIN s{i - 1} p ON e.src = p.node WHERE e.dst NOT IN (SELECT node FROM ({seen}) WHERE node IS NOT NULL) GROUP BY e.dst)")
        seen += f" UNION ALL SELECT node FROM s{i}"
    union = " UNION ALL ".join(f"SELECT path, {i} AS n FROM s{i} WHERE node = (SELECT b FROM g)" for i in range(1, hops + 1))
    parts.append(f"w AS (SELECT path FROM ({union}) ORDER BY n LIMIT 1), o AS (SELECT path, TRUE AS found FROM w UNION ALL SELECT [a, b], FALSE FROM g WHERE NOT EXISTS (SELECT 1 FROM w))")
    return f"WITH {', '.join(parts)} SELECT CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS position, unnest(path) AS node, found FROM o"


@query(_order_trace_sql(16))
def trace_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path over sparse edges, from the first order to the last of a customer that one of its next orders is of."""
    orders = table(spark, sf_dir, "orders")
    near = orders.selectExpr("o_orderkey AS src", "lead(o_orderkey) OVER (PARTITION BY o_orderkey DIV 64 ORDER BY o_orderkey) AS dst").where("dst IS NOT NULL")
    edges = _next_orders(spark, sf_dir).unionByName(near).distinct()
    first = orders.agg(F.min("o_orderkey").alias("start"))
    then = edges.join(F.broadcast(first), F.col("src") == F.col("start")).agg(F.min("dst").alias("o_orderkey"))
    customer = orders.join(F.broadcast(then), "o_orderkey").select("o_custkey")
    goal = orders.join(F.broadcast(customer), "o_custkey").agg(F.max("o_orderkey").alias("goal"))
    return graph.shortest_path(edges, first.join(F.broadcast(goal), F.lit(True)), 16)


@query(
    """
WITH RECURSIVE d AS (SELECT p_partkey AS m, p_brand AS n FROM part),
x AS (SELECT p.p_partkey AS m, 'x' || (p.p_partkey % 7) AS n, q.p_partkey AS sm, q.p_brand AS sn FROM part p JOIN part q ON q.p_partkey = p.p_partkey - 1 WHERE p.p_partkey % 4 = 1),
e AS (SELECT m, n, sm, sn FROM x UNION ALL SELECT p_partkey, NULL, p_partkey // 2, NULL FROM part WHERE p_partkey % 3 <> 1 AND p_partkey > 1 UNION ALL SELECT p_partkey, NULL, p_partkey - 2, NULL FROM part WHERE p_partkey % 8 = 0),
own AS (SELECT m, n FROM d UNION SELECT m, n FROM x),
s AS (
  SELECT m, n, m AS om, n AS ename, 0 AS hops FROM d
  UNION
  SELECT m, n, om, ename, min(hops) FROM (
    SELECT e.m, coalesce(e.n, s.n) AS n, s.om, s.ename, s.hops + 1 AS hops FROM s JOIN e ON e.sm = s.m AND (e.sn IS NULL OR e.sn = s.n)
    WHERE s.hops < 16 AND (e.n IS NOT NULL OR (e.m, s.n) NOT IN (SELECT m, n FROM own))) GROUP BY ALL),
r AS (SELECT m, n, om, ename, CAST(min(hops) AS INTEGER) AS hops FROM s GROUP BY m, n, om, ename)
SELECT m AS module, n AS name, om AS origin, ename AS origin_name, hops, count(*) OVER (PARTITION BY m, n) > 1 AS ambiguous FROM r
"""
)
def surface_reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules that define their brand, and take on names of the part before and all names of two others."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    before = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_partkey").alias("source"), F.col("p_brand").alias("source_name"))
    named = part.where("p_partkey % 4 = 1").join(before, "p_partkey").selectExpr("p_partkey AS module", "concat('x', p_partkey % 7) AS name", "source", "source_name")
    halves = part.where("p_partkey % 3 <> 1 AND p_partkey > 1").selectExpr("p_partkey AS module", "CAST(NULL AS STRING) AS name", "p_partkey DIV 2 AS source", "CAST(NULL AS STRING) AS source_name")
    lower = part.where("p_partkey % 8 = 0").selectExpr("p_partkey AS module", "CAST(NULL AS STRING) AS name", "p_partkey - 2 AS source", "CAST(NULL AS STRING) AS source_name")
    return reexports.surface(part.selectExpr("p_partkey AS module", "p_brand AS name"), named.unionByName(halves).unionByName(lower), None)


def _capped_sql(edges: str) -> str:
    return f"WITH f AS (SELECT DISTINCT dst AS node FROM {edges} WHERE src = (SELECT max(s_suppkey) FROM supplier)) SELECT node, count(*) OVER () AS total FROM f ORDER BY node LIMIT 200"


@query(_capped_sql(_REVERSED))
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped(graph.reach(graph.reversed_edges(_edges(spark, sf_dir)), _start(spark, sf_dir), 1).select("node"), 200, "node")


@query(_capped_sql(_EDGES))
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped(graph.reach(_edges(spark, sf_dir), _start(spark, sf_dir), 1).select("node"), 200, "node")


def _trace_sql(hops: int) -> str:
    parts = [f"e AS {_EDGES}", "g AS (SELECT max(s_suppkey) AS a, max(s_suppkey) - 9 AS b FROM supplier)", "s0 AS (SELECT a AS node, [a] AS path FROM g)"]
    seen = "SELECT node FROM s0"
    for i in range(1, hops + 1):
        parts.append(f"s{i} AS (SELECT e.dst AS node, min(list_append(p.path, e.dst)) AS path FROM e JOIN s{i - 1} p ON e.src = p.node WHERE e.dst NOT IN ({seen}) GROUP BY e.dst)")
        seen += f" UNION ALL SELECT node FROM s{i}"
    union = " UNION ALL ".join(f"SELECT path FROM s{i} WHERE node = (SELECT b FROM g)" for i in range(1, hops + 1))
    return f"WITH {', '.join(parts)}, p AS ({union}), x AS (SELECT coalesce((SELECT path FROM p LIMIT 1), (SELECT [a, b] FROM g)) AS path, (SELECT count(*) FROM p) > 0 AS found) SELECT CAST(unnest(range(len(path))) AS INTEGER) AS position, unnest(path) AS node, found FROM x"


@query(_trace_sql(12))
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _start(spark, sf_dir).select(F.col("node").alias("start"), (F.col("node") - 9).alias("goal"))
    return graph.shortest_path(_edges(spark, sf_dir), ends)


@query(
    _reach_sql(_EDGES, 2).replace("SELECT node, CAST(1 AS INTEGER) AS depth FROM s1 UNION ALL SELECT node, CAST(2 AS INTEGER) AS depth FROM s2", "")
    + ", "
    + _levels(_REVERSED, "SELECT max(s_suppkey) AS node FROM supplier", 2)[5:].replace("e AS", "f AS").replace("FROM e JOIN s", "FROM e2 JOIN s").replace("e.dst", "e2.dst").replace("e.src", "e2.src").replace("FROM e2", "FROM f e2").replace("s0", "t0").replace("s1", "t1").replace("s2", "t2")
    + """
SELECT 'callees' AS section, node, CAST(1 AS INTEGER) AS depth FROM s1 UNION ALL SELECT 'callees', node, 2 FROM s2
UNION ALL SELECT 'callers', node, 1 FROM t1 UNION ALL SELECT 'callers', node, 2 FROM t2
UNION ALL SELECT 'dependents', node, 1 FROM t1 UNION ALL SELECT 'dependents', node, 2 FROM t2
UNION ALL SELECT 'tests', node, 1 FROM t1 WHERE node % 2 = 1 UNION ALL SELECT 'tests', node, 2 FROM t2 WHERE node % 2 = 1
"""
)
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    tests = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("node"))
    return graph.impact(e, e, _start(spark, sf_dir), tests)


@query(f"WITH RECURSIVE e AS {_EDGES}, r AS (SELECT max(s_suppkey) AS node FROM supplier UNION SELECT e.dst FROM r JOIN e ON r.node = e.src), d AS (SELECT DISTINCT e.dst AS node FROM e JOIN r ON e.src = r.node) SELECT node FROM d")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), _start(spark, sf_dir)).select("node")


@query(
    """
SELECT doc_id, tokens, used FROM (SELECT source, doc_id, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens,
  CAST(sum(CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM documents) WHERE used <= 8000
"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    return graph.pack(d, 8000, "source", order="doc_id").select("doc_id", "tokens", "used")


@query("SELECT c_custkey AS node, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 200")
def capped_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first 200, with the exact total."""
    return graph.capped(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node")), 200, "node")


# -- search ----------------------------------------------------------------------------

_QUERY = "the license agreement of this"
_BM25 = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM documents),
n AS (SELECT d.doc_id, coalesce(x.n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id) x ON d.doc_id = x.doc_id),
s AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ({", ".join(f"'{w}'" for w in _QUERY.split())}) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
b AS (SELECT f.doc_id, sum(ln(1 + (s.docs - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * n.n / s.mean))) AS score FROM f JOIN d ON f.term = d.term JOIN n ON n.doc_id = f.doc_id, s GROUP BY f.doc_id)
"""


@query(_BM25 + "SELECT doc_id, round(score, 5) AS score FROM b ORDER BY round(score, 5) DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of a query, a top-k report."""
    s = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _QUERY)
    return s.select("doc_id", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def _refreshed_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index of an older state of the documents, brought up to the table: a tenth changed, a tenth new, a tenth gone."""
    now = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    older = now.where("doc_id % 10 <> 1").selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN concat('license of an older text ', left(text, 40)) ELSE text END AS text", "lang")
    older = older.unionByName(now.where("doc_id % 10 = 2").selectExpr("doc_id + 1000000000000 AS doc_id", "concat(text, ' license agreement') AS text", "lang"))
    found = index.build(older, fresh_path(spark), "doc_id", "text", "lang")
    index.refresh(found, now, "doc_id", "text", "lang")
    return found


@query(_BM25 + "SELECT doc_id, round(score, 5) AS score FROM b ORDER BY round(score, 5) DESC, doc_id LIMIT 10")
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents from a stored index after a refresh."""
    return index.search(_refreshed_index(spark, sf_dir), _QUERY).select(F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


@query(
    _BM25
    + ", l AS (SELECT b.doc_id, score FROM b JOIN documents USING (doc_id) WHERE lang IN ('de', 'fr')) SELECT doc_id, round(score, 5) AS score FROM l ORDER BY round(score, 5) DESC, doc_id LIMIT 10"
)
def index_topk_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among documents of two languages; the statistics are those of all."""
    return index.search(_refreshed_index(spark, sf_dir), _QUERY, languages=["de", "fr"]).select(F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


@query("WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS n FROM documents) SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words, round(avg(n), 6) AS mean, CAST(2 AS BIGINT) AS segments FROM t")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that a refresh keeps by changes, against those of the table."""
    return _refreshed_index(spark, sf_dir).statistics().select("docs", "words", F.round("mean", 6).alias("mean"), "segments")


@query("SELECT term, CAST(count(*) AS BIGINT) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM documents) GROUP BY term")
def index_document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term's document count after a refresh."""
    return _refreshed_index(spark, sf_dir).document_counts()


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id."""
    return list(table(spark, sf_dir, "embeddings").agg(F.min_by("embedding", "vec_id")).first()[0])


_COSINE = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))))"


@query(f"SELECT e.vec_id, round({_COSINE}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) p ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(search.cosine(F.col("embedding"), _probe(spark, sf_dir)), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def _vector_index(spark: SparkSession, sf_dir: str) -> related.VectorIndex:
    return related.build(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), fresh_path(spark), ("vec_id",), "embedding")


@query(
    f"""
SELECT query, vec_id, score FROM (
  SELECT p.vec_id AS query, e.vec_id, round({_COSINE}, 4) AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS n
  FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) p) WHERE n <= 10
"""
)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector from the stored index, by its exact fallback."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id AS query", "embedding AS vector")
    return related.search_all(_vector_index(spark, sf_dir), asked, exact=True).select("query", "vec_id", F.round("score", 4).alias("score"))


@query()
def vector_index_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from coded vectors of the probed lists; recall is tested against brute force."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").selectExpr("vec_id AS query", "embedding AS vector")
    return related.search_all(_vector_index(spark, sf_dir), asked).select("query", "vec_id", F.round("score", 4).alias("score"))


@query()
def related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents nearest to the one that holds the first line of document 0; tested against brute force."""
    chunked = related.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return related.find_related(related.build(related.embedded(chunked), fresh_path(spark), ("file", "start", "end")), 0, 1)


@query(
    _BM25
    + f""", v AS (SELECT e.vec_id AS doc_id, {_COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) p),
bs AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM b),
vs AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM v)
SELECT coalesce(bs.doc_id, vs.doc_id) AS doc_id, round(0.5 * coalesce(bs.score, 0) + 0.5 * coalesce(vs.score, 0), 5) AS score FROM bs FULL JOIN vs ON bs.doc_id = vs.doc_id ORDER BY score DESC, 1 LIMIT 10
"""
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _QUERY)
    dense = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), search.cosine(F.col("embedding"), _probe(spark, sf_dir)).alias("score"))
    return search.hybrid(lexical, dense, "doc_id", 0.5).select("doc_id", F.round("score", 5).alias("score"))


_LINES = "(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


@query(f"SELECT sha256(line) AS code, line, count(*) AS n FROM {_LINES} WHERE length(line) >= 8 GROUP BY line HAVING count(*) > 1")
def squeeze_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.legend(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, TRUE AS same FROM documents")
def squeeze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _text(table(spark, sf_dir, "documents")).select("doc_id", "text")
    codes = search.legend(d, "doc_id", "text")
    back = search.unsqueeze(search.squeeze(d, "doc_id", "text", codes), "doc_id", codes)
    return d.join(back.withColumnRenamed("text", "back"), "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


@query(
    """
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(10), ' '), '[.!?]+(\\s|$)'),
  lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))), lambda n: n > 0) AS n FROM documents)
SELECT doc_id, CAST(len(n) AS BIGINT) AS sentences, CAST(coalesce(list_sum(n), 0) AS BIGINT) AS words, CAST(len(list_filter(n, lambda x: x > 20)) AS BIGINT) AS over_soft, CAST(len(list_filter(n, lambda x: x > 25)) AS BIGINT) AS over_hard FROM s
"""
)
def prose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prose(_text(table(spark, sf_dir, "documents")), "doc_id", "text")


# -- state -----------------------------------------------------------------------------


@query(
    """
WITH RECURSIVE e AS (SELECT user_id, event_id, strlen(coalesce(props, '')) AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, size <= 400 AS accepted, CASE WHEN size <= 400 THEN size ELSE 0 END AS bytes, CASE WHEN size <= 400 THEN 1 ELSE 0 END AS items FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, bytes + size <= 400 AND items < 32, CASE WHEN bytes + size <= 400 AND items < 32 THEN bytes + size ELSE bytes END, CASE WHEN bytes + size <= 400 AND items < 32 THEN items + 1 ELSE items END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, CAST(bytes AS BIGINT) AS used_bytes, CAST(items AS BIGINT) AS used_items, accepted FROM r
"""
)
def storage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("size", F.octet_length(F.coalesce("props", F.lit(""))).cast("long"))
    return expiry.quota(e.select("user_id", "event_id", "ts", "size"), "user_id", "size", "ts", "event_id", max_bytes=400).select("user_id", "event_id", "used_bytes", "used_items", "accepted")


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 1800000000 AS expires_us, count(*) AS events FROM r GROUP BY user_id, run
"""
)
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = expiry.sessions(table(spark, sf_dir, "events"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("user_id", us("started").alias("started_us"), us("expires").alias("expires_us"), "events")


@query(
    """
SELECT user_id, max(event_id) AS generation, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS config, arg_max(event_type <> 'error', event_id) AS healthy FROM events GROUP BY user_id
"""
)
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("generation"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("config"))
    return expiry.registry_batch(e, "user_id")


@query("SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id OFFSET 8")
def lru_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users but the eight touched last, as a cache of eight entries would evict them."""
    return expiry.least_recent(table(spark, sf_dir, "events"), "user_id", "ts", 8).select("user_id", F.unix_micros(F.col("last_touch").cast("timestamp")).alias("last_us"))


# -- replace, hooks, sources -------------------------------------------------------------


@query(
    """
SELECT doc_id, CASE WHEN n = 1 THEN md5(replace(t, needle, 'THE ')) END AS replaced, CASE WHEN n = 1 THEN 'exact' END AS method, CASE WHEN n > 1 THEN 'ambiguous' END AS error
FROM (SELECT doc_id, t, needle, (length(t) - length(replace(t, needle, ''))) // length(needle) AS n FROM (SELECT doc_id, t, substr(t, 1, 12) AS needle FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)) WHERE length(trim(needle, ' ' || chr(10) || chr(9))) > 0)
"""
)
def exact_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve code points of each text replaced; where they come again the place is ambiguous."""
    d = _text(table(spark, sf_dir, "documents")).select("doc_id", text.normalize_newlines(F.col("text")).alias("t")).withColumn("needle", F.substring("t", 1, 12)).where("length(trim(BOTH ' \n\t' FROM needle)) > 0")
    r = d.select("doc_id", replace_udf()("t", "needle", F.lit("THE ")).alias("r"))
    return r.select("doc_id", F.md5(F.col("r.content").cast("binary")).alias("replaced"), "r.method", "r.error")


@example
def cascade_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = goldens.replacements(spark)
    return g.select("name", replace_udf()("content", "search", "replacement").alias("r")).select("name", "r.*")


@example
def hook_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.decide(goldens.events(spark), "event", allow=("reader",), block=("danger",)).select("name", "denied", "rule")


@example
def shell_mutates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goldens.shell(spark).select("command", scanning.shell_mutates_udf("command").alias("mutates"))


@example
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pysource.symbol_map(goldens.sources(spark)).select("path", "kind", "name", "start", "end", "public")


@example
def preflight_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, files, importers = goldens.batch(spark)
    return changes.preflight(batch, files, importers)


# -- patches, roots, names -----------------------------------------------------------------


@query(
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
n AS (SELECT doc_id, raw, t, substr(t, 1, 12) AS needle FROM d WHERE length(trim(substr(t, 1, 12), ' ' || chr(10) || chr(9))) > 0),
c AS (SELECT doc_id, doc_id % 10 = 3 AS stale, t, needle, (length(t) - length(replace(t, needle, ''))) // length(needle) AS n FROM n)
SELECT doc_id, CASE WHEN NOT stale AND n = 1 THEN sha256(replace(t, needle, 'THE ') || CASE WHEN ends_with(replace(t, needle, 'THE '), chr(10)) THEN '' ELSE chr(10) END || 'END') END AS after,
  CASE WHEN NOT stale AND n = 1 THEN 'exact,append' END AS methods, CAST(CASE WHEN NOT stale AND n > 1 THEN 1 END AS INTEGER) AS failed_rule,
  CASE WHEN stale THEN 'stale_or_missing_hash' WHEN n > 1 THEN 'ambiguous' END AS error FROM c
"""
)
def patch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules for every text, its first twelve code points replaced and a line appended; a tenth states a hash that is not the file's."""
    d = _text(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    needle = F.substring(text.normalize_newlines(F.col("content")), 1, 12)
    expected = F.when(F.col("path").cast("long") % 10 == 3, F.lit("0")).otherwise(F.col("sha256")).alias("expected_sha256")
    parts = F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), needle.alias("search"), F.lit("THE ").alias("replace")), F.struct(F.lit(2).alias("ordinal"), F.lit("").alias("search"), F.lit("END").alias("replace")))).alias("r")
    rules = d.where(F.length(F.trim(F.regexp_replace(needle, "[\n\t]", " "))) > 0).select("path", parts, expected).select("path", "r.*", F.lit("aider_block").alias("strategy"), F.lit(None).cast("int").alias("expected_matches"), "expected_sha256")
    p = patching.preview(rules, d)
    return p.select(F.col("path").cast("long").alias("doc_id"), "after", F.array_join("methods", ",").alias("methods"), "failed_rule", "error")


@query(
    """
WITH r AS (SELECT DISTINCT l_orderkey AS batch, 'supplier/' || l_suppkey AS path FROM lineitem)
SELECT batch, path, row_number() OVER (PARTITION BY batch ORDER BY path) - 1 AS place, lag(batch) OVER (PARTITION BY path ORDER BY batch) AS waits_for FROM r
"""
)
def lock_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches, suppliers as the files they lock."""
    return patching.lock_queue(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("path")))


@query(
    """
WITH f AS (SELECT user_id, event_type, min((epoch_us(ts), event_id)) AS first_at FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS kinds FROM f GROUP BY user_id
"""
)
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct event types of each user, in order of their first event."""
    got = patching.distinct_in_order(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")
    return got.select("user_id", F.array_join("values", ",").alias("kinds"))


_ROOTS = f"""
p AS (SELECT page_id, page_id % 50 AS session, path FROM {_PATH_SQL}),
h AS (SELECT session, '/site/' || split_part(arg_min(path, page_id), '/', 3) AS root FROM p GROUP BY session),
r AS (SELECT session, '/other' AS root, 0 AS place FROM h UNION ALL SELECT session, root, 1 FROM h UNION ALL SELECT session, '/site/m', 2 FROM h)
"""


@query(
    f"""
WITH {_ROOTS}, m AS (SELECT DISTINCT r.session, r.root FROM r JOIN p ON p.session = r.session AND p.session % 7 <> 0 AND (p.path = r.root OR starts_with(p.path, r.root || '/')))
SELECT session, root FROM m UNION ALL SELECT session, '/other' FROM h WHERE session NOT IN (SELECT session FROM m)
"""
)
def selected_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages asked for by fifty sessions; a seventh of them ask by relative paths, which choose no root."""
    p = _page_paths(spark, sf_dir).withColumn("session", F.col("page_id") % 50)
    host = p.groupBy("session").agg(F.concat(F.lit("/site/"), F.element_at(F.split(F.min_by("path", "page_id"), "/"), 3)).alias("host"))
    roots = host.select("session", F.posexplode(F.array(F.lit("/other"), F.col("host"), F.lit("/site/m"))).alias("place", "root"))
    asked = p.select("session", F.when(F.col("session") % 7 == 0, F.expr("substring(path, 2)")).otherwise(F.col("path")).alias("path"))
    return policy.selected_roots(roots, asked)


@query("SELECT event_id // 3 AS call, bool_and(value > 2 AND event_type <> 'error') AS proven FROM events GROUP BY 1")
def rename_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as renames in calls of three; errors go elsewhere, small values are not done, odd ids are reported by resolved names."""
    e = table(spark, sf_dir, "events").withColumn("call", F.floor(F.col("event_id") / 3).cast("long")).withColumn("k", F.col("event_id").cast("string"))
    requests = e.select("call", F.concat(F.lit("./a"), "k").alias("source"), F.concat(F.lit("x/../b"), "k").alias("destination"))
    file = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("/w/a"), "k")).otherwise(F.concat(F.lit("./a"), "k"))
    results = e.select("call", file.alias("file"), F.concat(F.when(F.col("event_type") == "error", F.lit("/w/c")).otherwise(F.lit("/w/b")), "k").alias("destination_path"), (F.col("value") > 2).alias("renamed"))
    return changes.rename_proof(requests, results, "/w")


_MODULE = "'m' || ({0} % 7) || '.P' || ({0})"


@query(
    f"""
WITH RECURSIVE t AS (SELECT p_partkey AS k, 1 AS depth FROM part WHERE p_partkey // 2 = 3
  UNION ALL SELECT p.p_partkey, t.depth + 1 FROM t JOIN part p ON p.p_partkey // 2 = t.k)
SELECT {_MODULE.format("k")} AS type, depth FROM t
"""
)
def implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types below P3, parts as types and half their number as their base."""
    name = lambda k: F.concat(F.lit("m"), (k % 7).cast("string"), F.lit(".P"), k.cast("string"))
    bases = table(spark, sf_dir, "part").where("p_partkey > 1").select(name(F.col("p_partkey")).alias("type"), name(F.floor(F.col("p_partkey") / 2).cast("long")).alias("base"))
    return graph.subtypes(bases, "P3")


@query(
    """
WITH s AS (SELECT DISTINCT c_mktsegment || '.N' || c_nationkey AS name, 'N' || c_nationkey AS tail FROM customer),
c AS (SELECT DISTINCT 'o' || o_orderkey AS caller, CASE WHEN o_custkey % 2 = 1 THEN 'N' || c_nationkey ELSE c_mktsegment || '.N' || c_nationkey END AS callee FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7),
f AS (SELECT caller, callee, callee = 'N7' AND (SELECT count(*) FROM s WHERE tail = 'N7') > 1 AS ambiguous FROM c)
SELECT caller, callee, ambiguous, (SELECT count(*) FROM f) AS total FROM f ORDER BY caller, callee LIMIT 200
"""
)
def callers_by_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 callers of N7, orders as callers; half of them write the name without its segment. A capped report."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(".N"), F.col("c_nationkey").cast("string")).alias("name"))
    calls = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("caller"), F.when(F.col("o_custkey") % 2 == 1, F.regexp_extract("name", "[^.]*$", 0)).otherwise(F.col("name")).alias("callee"))
    return graph.callers_of(calls, c.select("name"), "N7")


@query()
def approval_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests and answers of approvals; a test has brute force."""
    return expiry.grants(_approvals(spark, sf_dir))


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    answers = F.array(*map(F.lit, expiry.ANSWERS))
    action = F.when(F.col("event_type").isin("error", "signup"), F.get(answers, (F.col("event_id") % 4).cast("int"))).otherwise(F.lit("request"))
    grant = F.concat(F.lit("g"), (F.floor(F.col("value")) % 40).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session"), F.floor(F.col("event_id") / 500).cast("string").alias("invocation"), grant.alias("grant"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), action.alias("action"))


@query(
    """
SELECT n_nationkey, 'version = 2 # ' || n_name || chr(10) || '[formatting]' || chr(10) || 'fallback = "none"' || chr(10) || '[files.patch]' || chr(10)
  || 'aider_matchers = ["exact", "whitespace", "relative-indentation", "diff-match-patch"]' || chr(10) || '# kept' || chr(10) || '[safety]' || chr(10) || chr(10)
  || '[[paths]]' || chr(10) || 'id = "legacy-os-temp"' || chr(10) || 'path = "/tmp"' || chr(10) || 'policies = { read = "allow", write = "allow", delete = "allow" }' || chr(10)
  || 'follow_symlinks = ' || CASE WHEN n_regionkey = 1 THEN 'true' ELSE 'false' END || chr(10) || 'includes = ["**/*"]' || chr(10) || 'excludes = [".git/**"]' || chr(10) AS source, TRUE AS changed FROM nation
"""
)
def config_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of version 1 that differ in a comment and in a safety setting."""
    follow = F.when(F.col("n_regionkey") == 1, F.lit("true")).otherwise(F.lit("false"))
    source = F.concat(F.lit("version = 1 # "), "n_name", F.lit('\n[formatting]\nfallback = "none"\n[files.patch]\n# kept\n[safety]\nfollow_symlinks = '), follow, F.lit("\n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", migrating.migrate_udf(source, F.lit("/w/c.toml")).alias("m")).select("n_nationkey", "m.source", "m.changed")


@query("SELECT user_id, event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'unknown tool: ' || event_type ELSE event_type || ' lacks z' END AS problem FROM events WHERE event_type IN ('error', 'signup', 'view')")
def tool_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: two kinds are not in the catalogue, one lacks a key it needs."""
    inv = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("number"), F.col("event_type").alias("tool"), F.col("props").alias("input"))
    found = transcripts.catalogue_problems(inv, {"click": ["k"], "purchase": [], "view": ["k", "z"]})
    return found.select(F.col("session").alias("user_id"), F.col("number").alias("event_id"), "problem")
