"""Transcript scoring: parse records, bind outputs to calls, group by evaluation, check, aggregate.

Input is one row per line of a session. Records are bound by joins and aggregates on
(session, call_id); the order of records within a session is a window over its line
numbers. The tool prefix and the evaluation marker are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.scanning import embedded_mutates_udf, nested_calls_udf, shell_mutates_udf, strip_comments_all_udf, target_count_udf
from quarry.functions.text import canonical_histogram, utf16_length
from quarry.operators import assertions
from quarry.operators.assertions import has_key
from quarry.operators.shared import stored

# Tools that keep state, mutations that are counted, and required input keys of each tool.
STATEFUL = ("file_chattr", "file_delete", "file_patch", "file_rename", "file_write", "find_related", "index", "search")
MUTATIONS = ("file_patch", "file_write", "file_rename")
TOOL_KEYS = {
    "callees": ["target"], "callers": ["target"], "context": ["target"], "deps": ["file"], "digest": ["paths"],
    "document_query": ["filePath", "selectors"], "file_hash": ["filePaths"], "file_read": ["files"],
    "find_related": ["path", "line"], "impact": ["target"], "implements": ["paths", "target"], "map": ["paths"],
    "policy_check": ["checks"], "reverse_deps": ["file"], "run": ["pattern"], "search": ["query"],
    "show": ["path", "symbols"], "squeeze": ["path"], "trace": ["from", "to"],
}


@dataclass(frozen=True)
class Names:
    """What a session calls things."""

    prefix: str = "mcp__tools__"
    marker: str = "eval:"
    executor: str = "exec"


def lines(sessions: DataFrame, session: str = "session", text: str = "text") -> DataFrame:
    """``session, line, value`` of the lines that are not empty, numbered from 1 after empty ones are dropped."""
    kept = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x != "")
    return sessions.select(F.col(session).alias("session"), F.posexplode(kept).alias("line", "value")).withColumn("line", F.col("line") + 1)


def _text_items(v: Column, path: str) -> Column:
    """Items of a value as variants: of an array its elements, else the value alone."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.startswith(F.schema_of_variant(got), F.lit("ARRAY")), F.try_variant_get(v, path, "array<variant>")).otherwise(F.array(got))


def records(rows: DataFrame) -> DataFrame:
    """Parsed fields of each line; ``bad`` marks text that is no JSON object."""
    v = F.try_parse_json("value")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant"))
    string = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(F.col("v"), path, "string"))
    r = rows.withColumn("v", v)
    message = F.when(kind("$.payload.content") == "STRING", F.try_variant_get(F.col("v"), "$.payload.content", "string")).when(
        F.startswith(kind("$.payload.content"), F.lit("ARRAY")), F.array_join(F.transform(F.try_variant_get(F.col("v"), "$.payload.content", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), "\n")
    )
    output = F.array_join(
        F.transform(_text_items(F.col("v"), "$.payload.output"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")) & F.try_variant_get(x, "$.text", "variant").isNotNull(), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))).otherwise(F.coalesce(F.to_json(x), F.lit('""')))),
        "\n",
    )
    given = F.try_variant_get(F.col("v"), "$.payload.input", "variant")
    return r.select(
        "session",
        "line",
        (F.col("v").isNull() | F.is_variant_null("v")).alias("bad"),
        F.try_variant_get("v", "$.type", "string").alias("type"),
        F.try_variant_get("v", "$.payload.type", "string").alias("item"),
        string("$.payload.call_id").alias("call_id"),
        string("$.payload.name").alias("name"),
        F.try_variant_get("v", "$.payload.role", "string").alias("role"),
        string("$.payload.cwd").alias("cwd"),
        F.try_variant_get("v", "$.payload.workspace_roots", "array<string>").alias("workspace_roots"),
        F.coalesce(message, F.lit("")).alias("message"),
        F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string")).otherwise(F.coalesce(F.to_json(given), F.lit("{}"))).alias("input"),
        output.alias("output"),
        (F.coalesce(F.try_variant_get("v", "$.payload.isError", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get("v", "$.payload.output.isError", "boolean"), F.lit(False))).alias("failed"),
    )


def calls(recs: DataFrame, names: Names = Names()) -> DataFrame:
    """Calls with their invocations and evaluation ids, in order; ``repeat`` marks later ones of one id."""
    item = (F.col("type") == "response_item") & ~F.col("bad")
    marker = F.lit(f"{names.marker}([0-9]+)")
    ids = lambda c: F.transform(F.regexp_extract_all(c, marker, F.lit(1)), lambda x: x.cast("long"))
    # An empty array is "no marker"; null leaves the last user message in force.
    own = F.when(item & (F.col("item") == "message") & (F.col("role") == "user"), ids(F.col("message")))
    w = Window.partitionBy("session").orderBy("line")
    active = F.coalesce(F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.array().cast("array<bigint>"))
    c = recs.withColumn("active", active).where(item & (F.col("item") == "custom_tool_call") & F.col("call_id").isNotNull() & F.col("name").isNotNull())
    direct = F.startswith("name", F.lit(names.prefix))
    c = c.withColumn("nested", F.when(F.col("name") == names.executor, nested_calls_udf(names.prefix)(F.when(F.col("name") == names.executor, F.col("input")))))
    one = F.array(F.struct(F.expr(f"substring(name, {len(names.prefix) + 1})").alias("tool"), F.col("input").alias("input"), F.lit(False).alias("concurrent")))
    invocations = F.when(direct, one).when(F.col("name") == names.executor, F.col("nested")).otherwise(F.slice(one, 1, 0))
    c = c.withColumn("invocations", invocations)
    # The first call of an id that has invocations is the one that counts; any call makes the id known.
    useful = F.size("invocations") > 0
    earlier = F.coalesce(F.max(useful).over(Window.partitionBy("session", "call_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return c.select("session", "line", "call_id", "input", direct.alias("direct"), "invocations", F.array_distinct(F.concat("active", ids(F.col("input")))).alias("eval_ids"), useful.alias("counts"), earlier.alias("repeat"))


def outputs(recs: DataFrame) -> DataFrame:
    """Outputs; ``nth`` counts those of one call id."""
    w = Window.partitionBy("session", "call_id").orderBy("line")
    found = recs.where((F.col("type") == "response_item") & (F.col("item") == "custom_tool_call_output") & F.col("call_id").isNotNull() & ~F.col("bad"))
    return found.select("session", "line", "call_id", "output", "failed", F.row_number().over(w).alias("nth"))


def bound(sessions_calls: DataFrame, sessions_outputs: DataFrame) -> DataFrame:
    """The calls that count, each with its first output (null if none)."""
    first = sessions_outputs.where("nth = 1").select("session", "call_id", "output", "failed", F.lit(True).alias("answered"))
    return sessions_calls.where("counts AND NOT repeat").join(first, ["session", "call_id"], "left")


def excused(call_ids: Column, tools: Column, output: Column, rename_case: int = 92) -> Column:
    """A rename that fails because its destination exists, in the case that asks for it."""
    return F.array_contains(call_ids, F.lit(rename_case).cast("long")) & F.exists(tools, lambda t: t.tool == "file_rename") & F.regexp_like(output, F.lit("(?i)destination.*exist|already exists"))


def errors(recs: DataFrame, all_calls: DataFrame, outs: DataFrame, names: Names = Names()) -> DataFrame:
    """``session, error`` of everything that breaks a transcript's integrity."""
    b = bound(all_calls, outs)
    prompt = ~F.col("bad") & (F.col("type") == "response_item") & (F.col("item") == "message") & (F.col("role") == "user")
    marked = F.size(F.array_distinct(F.transform(F.regexp_extract_all("message", F.lit(f"{names.marker}([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))))
    say = lambda df, *parts: df.select("session", F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("error"))
    known = all_calls.select("session", "call_id").distinct()
    bad_output = b.where(F.col("failed") & ~excused(F.col("eval_ids"), F.col("invocations"), F.col("output")))
    found = [
        say(recs.where("bad"), "line ", F.col("line").cast("string"), ": invalid JSON"),
        say(recs.where(prompt & (marked > 1)), "user evaluation prompt carries multiple eval markers; evidence must be isolated per case"),
        say(all_calls.where("repeat"), "duplicate call ID: ", F.col("call_id")),
        say(outs.where("nth > 1"), "duplicate output ID: ", F.col("call_id")),
        say(b.where("answered IS NULL"), "missing output for call ID: ", F.col("call_id")),
        say(outs.where("nth = 1").join(known, ["session", "call_id"], "left_anti"), "unmatched output ID: ", F.col("call_id")),
        say(bad_output, "failed call ID: ", F.col("call_id")),
        say(b.where("answered AND length(output) = 0"), "empty output for call ID: ", F.col("call_id")),
        say(b.where("size(eval_ids) > 1"), "call ", F.col("call_id"), " carries multiple eval markers; evidence must be isolated per case"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def invocations(sessions_calls: DataFrame) -> DataFrame:
    """One row per invocation of the calls that count, with a running number over the session."""
    rows = sessions_calls.where("counts AND NOT repeat").select("session", "line", "call_id", F.posexplode("invocations").alias("place", "i")).select("session", "line", "call_id", "place", "i.tool", "i.input", "i.concurrent")
    number = F.row_number().over(Window.partitionBy("session").orderBy("line", "place")) - 1
    return rows.withColumn("number", number).withColumn("targets", target_count_udf("input"))


def hashed_first(inv: DataFrame, hashes: tuple[str, ...] = ("file_hash",), mutations: tuple[str, ...] = MUTATIONS) -> DataFrame:
    """``session, hashed_first`` of the sessions that mutate: whether a hash comes before the first mutation."""
    at = lambda tools: F.min(F.when(F.col("tool").isin(*tools), F.col("number")))
    return inv.groupBy("session").agg(at(hashes).alias("_h"), at(mutations).alias("_m")).where("_m IS NOT NULL").select("session", F.coalesce(F.col("_h") < F.col("_m"), F.lit(False)).alias("hashed_first"))


def meaningful(tool: Column, text: Column) -> Column:
    """Whether a call's input names all keys that its tool needs."""
    out: Column = F.lit(True)
    for name, keys in TOOL_KEYS.items():
        need: Column = F.lit(True)
        for k in keys:
            need = need & has_key(text, k)
        out = F.when(tool == name, need).otherwise(out)
    return out


def ordered_subsequence(wanted: Column, have: Column) -> Column:
    """Whether ``wanted`` is a subsequence of ``have``, each matched at its earliest place."""
    return F.aggregate(have, F.lit(0), lambda n, x: F.when(F.get(wanted, n).eqNullSafe(x) & (n < F.size(wanted)), n + 1).otherwise(n)) == F.size(wanted)


def evaluate(sessions_bound: DataFrame, cases: DataFrame, declared: DataFrame | None = None, names: Names = Names(), access: assertions.Access = assertions.Access()) -> DataFrame:
    """``session, eval_id, problem`` (the first, null if clean), ``assertions`` shown.

    ``cases``: id, required_tools, forbidden_tools, assertions (arrays), and if wanted files
    (array) and expected_output. ``declared``: roots as ``roots`` gives them. Checked are, in
    this order: tools and their inputs, their order, paths, files, expected output, each
    assertion, and that no call failed.
    """
    empty = F.array().cast("array<string>")
    one = sessions_bound.where("size(eval_ids) = 1").withColumn("eval_id", F.element_at("eval_ids", 1))
    placed = F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "invocations"))), lambda x: x.invocations)), lambda i, n: F.struct(n.alias("number"), i.tool.alias("tool"), i.input.alias("input"), i.concurrent.alias("concurrent")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "output"))), lambda x: F.coalesce(x.output, F.lit(""))), "\n")
    failed = F.bool_or(F.coalesce(F.col("failed") & ~excused(F.col("eval_ids"), F.col("invocations"), F.col("output")), F.lit(True)))
    g = one.groupBy("session", "eval_id").agg(placed.alias("_raw"), text.alias("_out"), failed.alias("any_failed"))
    if declared is None:
        g = g.withColumn("_roots", empty)
    else:
        per = declared.groupBy("session").agg(F.array_sort(F.collect_set("root")).alias("_roots"))
        g = g.join(per, "session", "left").withColumn("_roots", F.coalesce("_roots", empty))
    have = lambda name, kind: F.col(name).cast(kind) if name in cases.columns else F.lit(None).cast(kind)
    c = cases.select(F.col("id").cast("long").alias("eval_id"), "required_tools", "forbidden_tools", F.coalesce("assertions", empty).alias("_asserted"), F.coalesce(have("files", "array<string>"), empty).alias("_files"), have("expected_output", "string").alias("_expected"))
    j = g.join(c, "eval_id", "left")
    j = j.withColumn("_plain", strip_comments_all_udf(F.transform("_raw", lambda x: x.input)))
    j = j.withColumn("_calls", F.zip_with("_raw", "_plain", lambda x, p: F.struct(x.number.alias("number"), x.tool.alias("tool"), p.alias("input"), x.concurrent.alias("concurrent")))).withColumn("used", F.transform("_raw", lambda x: x.tool))
    source = F.array_join("_plain", "\n")
    j = j.withColumn("_mutates", embedded_mutates_udf(source) | shell_mutates_udf(source))
    blank = lambda x: F.regexp_like(x, F.lit(r"^\s*(\{\})?\s*$"))
    j = j.withColumn("_sound", F.forall("_calls", lambda x: F.when(blank(x.input), x.tool == "config_status").otherwise(meaningful(x.tool, x.input) & assertions.meaningful_change(x, names.prefix))))
    shown = lambda a: assertions.holds(a, F.col("_calls"), F.col("_out"), F.col("required_tools"), F.col("forbidden_tools"), F.col("_mutates"), F.coalesce(F.get("_roots", F.lit(0)), F.lit("/")), F.col("_sound"), names.prefix)
    # Words of seven letters and more of what is expected, where no tool is required.
    words = F.filter(F.split(F.lower("_expected"), r"\W+"), lambda w: F.length(w) >= 7)
    outside = assertions.path_problems(F.col("_calls"), F.col("_roots"), access) if declared is not None else empty
    j = j.withColumn("_outside", outside).withColumn("_unshown", F.filter("_asserted", lambda a: ~shown(a)))
    untargeted = F.filter("_files", lambda f: ~F.exists("_plain", lambda p: F.contains(p, f)))
    unproven = F.filter("_files", lambda f: ~F.contains("_out", f))
    concurrent = (F.size("required_tools") > 1) & F.exists("_calls", lambda x: x.concurrent & F.array_contains("required_tools", x.tool))
    problem = (
        F.when(F.col("required_tools").isNull(), F.concat(F.lit("unknown eval ID: "), F.col("eval_id").cast("string")))
        .when(F.size(F.array_except("required_tools", "used")) > 0, F.concat(F.lit("missing tools: "), F.array_join(F.array_except("required_tools", "used"), ", ")))
        .when(F.size(F.array_intersect("forbidden_tools", "used")) > 0, F.concat(F.lit("forbidden tools: "), F.array_join(F.array_intersect("forbidden_tools", "used"), ", ")))
        .when(~F.col("_sound"), F.lit("input lacks required keys"))
        .when(concurrent, F.lit("required tool sequence is concurrent and cannot be proven"))
        .when(~ordered_subsequence(F.col("required_tools"), F.col("used")), F.lit("tools out of order"))
        .when(F.size("_outside") > 0, F.get("_outside", F.lit(0)))
        .when(F.size(untargeted) > 0, F.concat(F.lit("input does not target required file: "), F.get(untargeted, F.lit(0))))
        .when(F.size(unproven) > 0, F.concat(F.lit("output does not prove file result: "), F.get(unproven, F.lit(0))))
        .when(F.col("_expected").isNotNull() & ~shown(F.col("_expected")), F.concat(F.lit("expected output not proven: "), F.col("_expected")))
        .when((F.size("required_tools") == 0) & F.col("_expected").isNotNull() & ~F.exists(words, lambda w: F.contains(F.lower("_out"), w)), F.lit("output does not prove expected transport behavior"))
        .when(F.size("_unshown") > 0, F.concat(F.lit("assertion not proven: "), F.get("_unshown", F.lit(0))))
        .when(F.col("any_failed"), F.lit("a call failed or has no output"))
    )
    return j.select("session", "eval_id", problem.alias("problem"), F.when(problem.isNull(), F.size("_asserted")).otherwise(F.lit(0)).cast("long").alias("assertions"))


def score(sessions: DataFrame, cases: DataFrame, names: Names = Names(), strict: bool = False, access: assertions.Access = assertions.Access()) -> DataFrame:
    """One row of metrics per session."""
    # What several metrics read is made once: a session's text is parsed once, a call bound and a case judged once.
    recs = stored(records(lines(sessions)))
    all_calls, outs = stored(calls(recs, names)), outputs(recs)
    b = stored(bound(all_calls, outs))
    inv = invocations(all_calls)
    judged = stored(evaluate(b, cases, roots(recs), names, access))
    problems = errors(recs, all_calls, outs, names).unionByName(judged.where("problem IS NOT NULL").select("session", F.concat(F.lit("eval "), F.col("eval_id").cast("string"), F.lit(": "), F.col("problem")).alias("error")))
    if strict:
        wanted = recs.select("session").distinct().crossJoin(F.broadcast(cases.select(F.col("id").cast("long").alias("eval_id"))))
        unmet = wanted.join(judged.select("session", "eval_id"), ["session", "eval_id"], "left_anti")
        problems = problems.unionByName(unmet.select("session", F.concat(F.lit("missing eval ID: "), F.col("eval_id").cast("string")).alias("error")))
    per_call = b.groupBy("session").agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.size("eval_ids") == 0).alias("unscored_batches"), F.coalesce(F.sum(F.when(F.col("answered"), utf16_length(F.col("output")))), F.lit(0)).alias("output_chars"))
    answered = inv.join(b.where("answered").select("session", "call_id"), ["session", "call_id"], "left_semi").groupBy("session", "tool").agg(F.count(F.lit(1)).alias("n"))
    tools = answered.groupBy("session").agg(canonical_histogram(F.collect_list(F.struct(F.col("tool").alias("key"), "n"))).alias("tool_calls"), F.coalesce(F.sum(F.when(F.col("tool").isin(*MUTATIONS), F.col("n"))), F.lit(0)).alias("mutation_calls"))
    read_only = F.col("concurrent") & ~F.col("tool").isin(*STATEFUL) & ~((F.col("tool") == "run") & F.regexp_like("input", F.lit(r"(?:[\"']write[\"']|\bwrite)\s*:\s*true")))
    per_invocation = inv.groupBy("session").agg(F.count(F.lit(1)).alias("invocations"), F.avg((F.col("targets") > 1).cast("double")).alias("batch_density"), F.count_if(read_only).alias("parallel_read_only_calls"))
    codes = b.select("session", F.explode(F.regexp_extract_all("output", F.lit(r"[\"']code[\"']\s*:\s*[\"']([^\"']+)[\"']"), F.lit(1))).alias("key")).groupBy("session", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("session").agg(canonical_histogram(F.collect_list(F.struct("key", "n"))).alias("error_codes"))
    evals = judged.groupBy("session").agg(F.count(F.lit(1)).alias("evaluated_cases"), F.sum("assertions").alias("verified_assertions"))
    errs = problems.groupBy("session").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    out = recs.select("session").distinct()
    for part in (per_call, tools, per_invocation, codes, evals, errs):
        out = out.join(part, "session", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "session", *(zero(c) for c in ("batches", "unscored_batches", "output_chars", "mutation_calls", "parallel_read_only_calls", "evaluated_cases", "verified_assertions", "invocations")),
        F.coalesce("batch_density", F.lit(0.0)).alias("batch_density"),
        F.coalesce(F.col("invocations") / F.col("batches"), F.lit(0.0)).alias("calls_per_turn"),
        F.coalesce("tool_calls", F.lit("")).alias("tool_calls"), F.coalesce("error_codes", F.lit("")).alias("error_codes"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), F.col("errors").isNull().alias("passed"),
    )


def roots(recs: DataFrame) -> DataFrame:
    """``session, root``: working directories that a session declared."""
    c = recs.where((F.col("type") == "turn_context") & ~F.col("bad"))
    return c.select("session", F.explode(F.concat(F.array_compact(F.array("cwd")), F.coalesce("workspace_roots", F.array().cast("array<string>")))).alias("root")).distinct()


def suite_problems(cases: DataFrame, surfaces: list[str]) -> DataFrame:
    """``problem`` rows of a case table: repeated ids, unknown or thin surfaces, missing categories, few assertions."""
    dup = cases.groupBy("id").count().where("count > 1").select(F.concat(F.lit("duplicate id: "), F.col("id").cast("string")).alias("problem"))
    unknown = cases.where(~F.col("surface").isin(*surfaces)).select(F.concat(F.lit("unknown surface: "), F.col("surface")).alias("problem")).distinct()
    per = cases.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.collect_set("category").alias("got"))
    thin = per.where("n < 3").select(F.concat(F.lit("fewer than 3 cases: "), F.col("surface")).alias("problem"))
    missing = per.select("surface", F.explode(F.array_except(F.array(*map(F.lit, ("positive", "variant", "negative"))), F.col("got"))).alias("c")).select(F.concat(F.col("surface"), F.lit(" has no case of category "), F.col("c")).alias("problem"))
    few = cases.where(F.size("assertions") < 3).select(F.concat(F.lit("fewer than 3 assertions: "), F.col("id").cast("string")).alias("problem"))
    return dup.unionByName(unknown).unionByName(thin).unionByName(missing).unionByName(few)


def catalogue_problems(inv: DataFrame, tools: dict[str, list[str]] = TOOL_KEYS) -> DataFrame:
    """``session, number, problem`` of calls of tools that the catalogue (name to required keys) lacks, or that lack a key."""
    rows = inv.sparkSession.createDataFrame([(name, keys) for name, keys in tools.items()], "tool string, _keys array<string>")
    met = inv.join(F.broadcast(rows), "tool", "left")  # as many rows as there are tools
    lacks = F.filter("_keys", lambda k: ~F.regexp_like("input", F.concat(F.lit("(?:[\"']"), k, F.lit("[\"']|\\b"), k, F.lit(")\\s*:"))))
    problem = F.when(F.col("_keys").isNull(), F.concat(F.lit("unknown tool: "), F.col("tool"))).when(F.size(lacks) > 0, F.concat(F.col("tool"), F.lit(" lacks "), F.array_join(lacks, ", ")))
    return met.select("session", "number", problem.alias("problem")).where("problem IS NOT NULL")
