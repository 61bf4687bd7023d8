"""Decisions on tool events: policy lists, direct tools, executors, shells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scanning import embedded_mutates_udf, shell_mutates_udf

DIRECT = ("apply_patch", "edit", "multiedit", "notebookedit", "write", "str_replace_editor", "create_file")
EXECUTORS = ("exec", "functions.exec")
SHELLS = ("bash", "shell", "exec_command", "run_terminal_cmd", "terminal", "local_shell", "powershell")


def named(tool: Column, names: tuple[str, ...] | list[str]) -> Column:
    """Whether the name, or its part after the last dot, is among ``names``; case does not count."""
    low = F.lower(tool)
    wanted = [n.lower() for n in names]
    return low.isin(*wanted) | F.element_at(F.split(low, r"\."), -1).isin(*wanted) if wanted else F.lit(False)


def command_of(event: Column) -> Column:
    """The command text of an event's JSON input: the string itself, or the first of five keys."""
    v = F.try_parse_json(event)
    raw = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant") for k in ("tool_input", "toolInput", "toolArgs", "input", "args")))
    text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))
    keyed = F.coalesce(*(F.try_variant_get(raw, f"$.{k}", "string") for k in ("cmd", "command", "script", "source", "code")))
    return F.struct(F.coalesce(text, keyed, F.lit("")).alias("command"), text.isNotNull().alias("plain"))


def tool_name(event: Column) -> Column:
    v = F.try_parse_json(event)
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in ("tool_name", "toolName", "name")), F.lit(""))


def decide(events: DataFrame, event: str = "event", allow: tuple[str, ...] = (), block: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """``events`` with ``denied`` and ``rule``, the first that applies."""
    parsed = events.withColumn("_tool", tool_name(F.col(event))).withColumn("_command", command_of(F.col(event)))
    tool, command = F.col("_tool"), F.col("_command.command")
    parsed = parsed.withColumn("_shell", shell_mutates_udf(command)).withColumn("_nested", embedded_mutates_udf(command))
    executor = F.lower(tool).isin(*EXECUTORS)
    direct_inside = F.regexp_like(command, F.lit(r"(?i)\btools\.(" + "|".join(DIRECT) + r")\s*\("))
    rule = (
        F.when(F.lit(not enabled), F.lit("disabled"))
        .when(named(tool, block), F.lit("blocked"))
        .when(named(tool, allow), F.lit("allowed"))
        .when(named(tool, DIRECT), F.lit("direct"))
        .when(executor & (direct_inside | F.col("_nested")), F.lit("nested"))
        .when(executor & F.col("_command.plain"), F.lit("none"))
        .when((executor | named(tool, SHELLS)) & F.col("_shell"), F.lit("shell"))
        .otherwise(F.lit("none"))
    )
    return parsed.withColumn("rule", rule).withColumn("denied", F.col("rule").isin("blocked", "direct", "nested", "shell")).drop("_tool", "_command", "_shell", "_nested")
