"""Shell commands whose output tends to be long: which command a hook's payload holds, and what to expect of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A command's signs, the kind of its output (none: to be found from the output), and what it is.
NOISY = [
    (r"\b(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?test\b", "test", "a test suite"),
    (r"\bnode\s+--test\b", "test", "a test run"),
    (r"\b(?:jest|vitest|mocha|pytest|go\s+test|cargo\s+test|dotnet\s+test)\b", "test", "a test run"),
    (r"\b(?:npm|pnpm|yarn|bun)\s+(?:install|ci)\b", "log", "an install log"),
    (r"\b(?:make|cmake|gradle|mvn|webpack|tsc|cargo\s+build)\b|\brun\s+build\b", "log", "a build log"),
    (r"\bgit\s+(?:diff|log|show)\b", "diff", "git output that is often long"),
    (r"\b(?:docker|kubectl)\s+logs\b", "log", "container logs"),
    (r"\b(?:cat|type)\s+\S+\.(?:log|txt|json|csv|xml)\b", None, "a file that may be large"),
    (r"(?s)\b(?:curl|wget)\b.*https?://", "json", "a network response"),
    (r"\b(?:ls|dir)\s+(?:-\w*R\b|/s\b)", None, "a recursive listing"),
]
# Signs that the output is reduced or thrown away already.
HANDLED = r"(?i)\blathe\b|--silent\b|\s-q\b|>\s*/dev/null|>\s*NUL"
# Where hooks put the command in their payload, in the order in which they are looked at.
PLACES = ["$.tool_input.command", "$.toolInput.command", "$.input.command", "$.params.command", "$.arguments.command", "$.command", "$.tool_input.script", "$.input.script"]


def command_of(payload: Column) -> Column:
    """The command of a JSON payload: the first place that holds one; an empty text where none does."""
    found = [F.get_json_object(payload, p) for p in PLACES]
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in found], F.lit(""))


def advice(command: Column) -> Column:
    """struct<kind, why> for a command with long output; null for others and for those that are handled already."""
    out = None
    for pattern, kind, why in NOISY:
        made = F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(why).alias("why"))
        out = F.when(command.rlike(pattern), made) if out is None else out.when(command.rlike(pattern), made)
    return F.when(~F.coalesce(command, F.lit("")).rlike(HANDLED), out)
