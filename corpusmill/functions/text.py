"""Text functions on statements, proofs and judge replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remove_comments(c: Column) -> Column:
    """Without block comments (/- -/ and /- --/) and without line comments."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/-.*?(?:-/|--/)", ""), r"--[^\n]*", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def insert_informal(statement: Column, informal: Column, word: str = "theorem") -> Column:
    """Put /- informal -/ before the first line with the word; unchanged if there is none or the text is already there."""
    text = F.trim(F.substring_index(informal, "The final answer is", 1))
    ls = lines(statement)
    at = F.array_position(F.transform(ls, lambda x: x.contains(word)), F.lit(True)).cast("int")
    made = F.array_join(F.concat(F.slice(ls, 1, at - 1), F.array(F.concat(F.lit("/- "), text, F.lit(" -/"))), F.slice(ls, at, F.size(ls))), "\n")
    return F.when((at == 0) | statement.contains(text), statement).otherwise(made)


def remove_sorry(c: Column) -> Column:
    """Text before the first sorry, and a newline."""
    return F.concat(F.substring_index(c, "sorry", 1), F.lit("\n"))


def split_header(c: Column, start: str = "import ") -> tuple[Column, Column]:
    """(leading import and blank lines, the rest)."""
    ls = lines(c)
    rest = F.array_position(F.transform(ls, lambda x: ~(x.startswith(start) | (F.trim(x) == ""))), F.lit(True)).cast("int")
    cut = F.when(rest == 0, F.size(ls)).otherwise(rest - 1)
    return F.array_join(F.slice(ls, F.lit(1), cut), "\n"), F.array_join(F.slice(ls, cut + 1, F.size(ls)), "\n")


def snippet(c: Column, line: Column, column: Column, end_line: Column, end_column: Column) -> Column:
    """Text between two (line, column) positions; lines count from 1, columns from 0, the end is exclusive."""
    ls = F.slice(lines(c), line, end_line - line + 1)
    one = F.substring(F.try_element_at(ls, F.lit(1)), column + 1, end_column - column)
    first = F.substring(F.try_element_at(ls, F.lit(1)), column + 1, F.length(c))
    last = F.substring(F.try_element_at(ls, F.lit(-1)), F.lit(1), end_column)
    many = F.array_join(F.concat(F.array(first), F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 2, F.lit(0))), F.array(last)), "\n")
    return F.when(end_line == line, one).otherwise(many)


def first_fence(c: Column) -> Column:
    """Contents of the first fenced block, or ''."""
    return F.regexp_extract(c, r"(?s)```[a-zA-Z0-9]*\n(.*?)```", 1)


def all_fences(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)```[a-zA-Z0-9]*\n(.*?)```"), F.lit(1)), "\n")


def before_last_fence(c: Column) -> Column:
    return F.when(c.contains("```"), F.regexp_extract(c, r"(?s)^(.*)```", 1)).otherwise(c)


def judge_line_status(c: Column) -> Column:
    """From the last line that has a verdict; case matters, Correct is looked for before Incorrect."""
    said = F.filter(lines(c), lambda x: x.contains("Correct") | x.contains("Incorrect"))
    last = F.try_element_at(said, F.lit(-1))
    return F.when(last.contains("Correct"), "Correct").when(last.contains("Incorrect"), "Incorrect").otherwise("Status not found")


def judge_boxed_status(c: Column) -> Column:
    """A boxed verdict, else the last status line, else a sentence."""
    boxed = F.regexp_extract(c, r"(?i)\\boxed\{(?:\\text\{)?\s*(correct|incorrect)", 1)
    status = F.regexp_extract(F.try_element_at(F.filter(lines(c), lambda x: x.rlike(r"(?i)status\W+(correct|incorrect)")), F.lit(-1)), r"(?i)status\W+(correct|incorrect)", 1)
    sentence = F.regexp_extract(c, r"(?i)\bis (correct|incorrect)\b", 1)
    found = F.when(boxed != "", boxed).when(status != "", status).when(sentence != "", sentence)
    return F.coalesce(F.initcap(found), F.lit("Status not found"))


def critic_verdict(c: Column, field: str = "is_correct") -> Column:
    """A boolean field of a JSON reply, else found by pattern, else null."""
    got = F.coalesce(F.get_json_object(c, f"$.{field}"), F.nullif(F.lower(F.regexp_extract(c, rf'(?i)"?{field}"?\s*[:=]\s*"?(true|false)', 1)), F.lit("")))
    return F.when(got == "true", True).when(got == "false", False)


def indent(c: Column, pad: str) -> Column:
    """Every line, as newlines part them, behind pad."""
    return F.concat(F.lit(pad), F.replace(c, F.lit("\n"), F.lit("\n" + pad)))


def indentation(c: Column) -> Column:
    return F.length(c) - F.length(F.ltrim(c))


def round_trip(parts: Column, whole: Column, sep: str = "") -> Column:
    return F.array_join(parts, sep) == whole


def unescape_list(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def steps_have_sorry(steps: Column) -> Column:
    return F.exists(steps, lambda s: s.contains("sorry") | s.contains("admit"))


def version_of(c: Column) -> Column:
    """3, 4 or null from the text's own markers, older ones first."""
    old = c.rlike(r"(?m)^\s*begin\b") | c.rlike(r"\bimport (?:data|analysis|algebra|tactic)\.")
    new = c.rlike(r":= by\b") | c.rlike(r"\bimport Mathlib\b")
    return F.when(old, 3).when(new, 4)


def user_prompt(natural: Column, names: Column, source: Column, has_header: bool = True, include_source: bool = False) -> Column:
    """Instruction for a formaliser; theorem names and source only if there are any."""
    # fixed values: the words of the prompt that models were trained on
    head = F.lit("Mathematical Problem in Natural Language:\n") if has_header else F.lit("")
    parts = [head, natural, F.when(F.size(names) > 0, F.concat(F.lit("\nUse the following theorem names: "), F.array_join(names, ", "), F.lit("."))).otherwise(F.lit(""))]
    if include_source:
        parts.append(F.when(source.isNotNull(), F.concat(F.lit("\nSource: "), source)).otherwise(F.lit("")))
    return F.concat(*parts)


def template(text: str, **fields: Column) -> Column:
    """str.format with columns; {{ and }} stand for braces."""
    from string import Formatter

    return F.concat(*[x for literal, name, _, _ in Formatter().parse(text) for x in (F.lit(literal), *([F.coalesce(fields[name].cast("string"), F.lit("None"))] if name else []))])
