"""Scanners over formal text that need a cursor: bracket depth, split points, negation. Plain functions, and Arrow UDFs over them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "([{⟨", ")]}⟩"
HEAD = re.compile(r"\b(theorem|lemma|example)\b")


def without_comments(text: str) -> str:
    return re.sub(r"--[^\n]*", "", re.sub(r"/-.*?(?:-/|--/)", "", text, flags=re.DOTALL))


def braces_to_parentheses(text: str) -> str:
    """Curly binders as round ones."""
    return text.replace("{", "(").replace("}", ")")


def top_level_colon(text: str, start: int = 0) -> int:
    """Place of the first colon outside brackets that isn't part of :=, or -1."""
    depth = 0
    for i in range(start, len(text)):
        c = text[i]
        if c in OPEN:
            depth += 1
        elif c in CLOSE:
            depth -= 1
        elif c == ":" and depth == 0:
            if text[i + 1 : i + 2] == "=":
                return -1
            return i
    return -1


def top_level_assign(text: str, start: int = 0) -> int:
    """Place of the first := outside brackets that no let or have owns, or -1."""
    depth, owed = 0, 0
    for m in re.compile(r":=|\b(?:let|have)\b|[()\[\]{}⟨⟩]").finditer(text, start):
        t = m[0]
        if t in OPEN:
            depth += 1
        elif t in CLOSE:
            depth -= 1
        elif t in ("let", "have"):
            owed += 1
        elif owed:
            owed -= 1
        elif depth == 0:
            return m.start()
    return -1


def split_indexes(text: str | None) -> list[int]:
    """Places right after the := (and a by that follows) that ends each theorem's statement."""
    out = []
    for m in HEAD.finditer(text or ""):
        if out and m.start() < out[-1]:
            continue
        at = top_level_assign(text, m.end())
        if at >= 0:
            by = re.compile(r":=\s*by\b").match(text, at)
            out.append(by.end() if by else at + 2)
    return sorted(set(out))


def splitable(text: str | None) -> bool:
    return len(split_indexes(text)) == 1


def split_proof(text: str | None) -> tuple[str, str] | None:
    """(input, output) at the last split place; the output starts with its newline."""
    at = split_indexes(text)
    if not at:
        return None
    head, tail = text[: at[-1]], text[at[-1] :]
    extra = len(tail) - len(tail.lstrip("\n"))
    return (head + "\n", tail[1:]) if extra else (head, tail)


def split_proof_by_line(text: str | None) -> tuple[str, str] | None:
    """At the last line of the last theorem's statement that ends in := by or :=."""
    lines = (text or "").split("\n")
    heads = [i for i, x in enumerate(lines) if HEAD.search(x)]
    for i in range(heads[-1] if heads else len(lines), len(lines)):
        if re.search(r":=\s*(?:by)?\s*$", lines[i]):
            return "\n".join(lines[: i + 1]), "\n".join(lines[i + 1 :])
    return None


def components(text: str | None) -> dict | None:
    """lib, name, binders, conclusion, proof of the first named theorem; None if it has no such shape."""
    m = re.search(r"\b(?:theorem|lemma)\s+([^\s:({\[]+)", text or "")
    if not m:
        return None
    end = top_level_assign(text, m.end())
    colon = top_level_colon(text[: end if end >= 0 else len(text)], m.end())
    if end < 0 or colon < 0:
        return None
    return {"lib": text[: m.start()], "name": m[1], "binders": text[m.end() : colon].strip(), "conclusion": text[colon + 1 : end].strip(), "proof": text[end:].strip()}


def negate(text: str | None, keep_header: bool = True) -> str | None:
    """The first theorem's negation: all binders moved under a universal quantifier, the whole negated."""
    c = components(text)
    if not c:
        return None
    b = braces_to_parentheses(c["binders"])
    inner = f"∀ {b}, {c['conclusion']}" if b else c["conclusion"]
    return f"{c['lib'] if keep_header else ''}theorem {c['name']}_negated : ¬ ({inner}) := by sorry"


def negate_partial(text: str | None) -> str | None:
    """Only the conclusion negated, binders kept."""
    c = components(text)
    return None if not c else " ".join(x for x in (f"{c['lib']}theorem {c['name']}_negated", c["binders"], f": ¬ ({c['conclusion']}) := by sorry") if x)


def contradict(text: str | None) -> str | None:
    """The conclusion replaced by False."""
    c = components(text)
    return None if not c else " ".join(x for x in (f"{c['lib']}theorem {c['name']}_contradicted", c["binders"], ": False := by sorry") if x)


def context_of(text: str, line: int) -> dict:
    """Header, context, comment and statement of the theorem that starts at or before a line (from 1)."""
    lines = text.split("\n")
    at = max([i for i in range(min(line, len(lines))) if HEAD.search(lines[i])], default=0)
    top = 0
    while top < len(lines) and (lines[top].startswith("import ") or not lines[top].strip()):
        top += 1
    first = at
    while first > top and lines[first - 1].strip().startswith(("--", "/-")) or (first > top and lines[first - 1].strip().endswith("-/")):
        first -= 1
    rest = "\n".join(lines[at:])
    cut = split_indexes(rest)
    return {"header": "\n".join(lines[:top]), "context": "\n".join(lines[top:first]), "comment": "\n".join(lines[first:at]), "statement": rest[: cut[0]] if cut else rest}


def truncate_tactic(text: str | None) -> str | None:
    """The first tactic: up to the first newline or fence outside a block comment."""
    if text is None:
        return None
    i, depth = 0, 0
    while i < len(text):
        if text.startswith("/-", i):
            depth, i = depth + 1, i + 2
        elif text.startswith("-/", i) and depth:
            depth, i = depth - 1, i + 2
        elif depth == 0 and (text.startswith("```", i) or text[i] == "\n" and text[:i].strip()):
            return text[:i]
        else:
            i += 1
    return text


def longest_common_run(a: list, b: list) -> int:
    """Length of the longest run of tokens that both have."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def diverse(texts: list[str], n: int) -> list[str]:
    """Greedy choice: the first, then always the text whose largest common run with those chosen is least."""
    left = list(dict.fromkeys(texts))
    if len(left) <= 1 or n < 1:
        return left[:1]
    words = {t: t.split() for t in left}
    chosen, left = left[:1], left[1:]
    runs = dict.fromkeys(left, 0)
    while left and len(chosen) < n:
        last = words[chosen[-1]]
        for t in left:
            runs[t] = max(runs[t], longest_common_run(words[t], last))
        pick = min(left, key=runs.__getitem__)
        left.remove(pick)
        chosen.append(pick)
    return chosen


def rebuild(steps: list[dict]) -> str:
    """Code from steps with positions (line from 1, column from 0): gaps become newlines and spaces, comments come before their step."""
    out, line, column = "", 1, 0
    for s in steps:
        if s.get("comment"):
            out += s["comment"] + "\n"
        gap = s["line"] - line
        out += "\n" * gap + " " * (s["column"] - (0 if gap > 0 else column)) if gap >= 0 else "\n"
        out += s["tactic"]
        parts = s["tactic"].split("\n")
        line, column = s["line"] + len(parts) - 1, (s["column"] if len(parts) == 1 else 0) + len(parts[-1])
    return out


def loose_span(text: str, part: str) -> tuple[int, int] | None:
    """Where part stands in text if white space is ignored."""
    places = [i for i, c in enumerate(text) if not c.isspace()]
    at = "".join(text[i] for i in places).find(bare := "".join(part.split()))
    return None if at < 0 or not bare else (places[at], places[at + len(bare) - 1] + 1)


def segment_logprobs(tokens: list[str], logprobs: list[float], tactics: list[str]) -> list[float]:
    """Sum of the log-probabilities of the tokens that make up each tactic, taken greedily in order."""
    out, i = [], 0
    for t in tactics:
        got, total = "", 0.0
        while i < len(tokens) and len(got.strip()) < len(t.strip()):
            got, total, i = got + tokens[i], total + float(logprobs[i]), i + 1
        out.append(total)
    return out


def settle_spaces(parts: list[str]) -> list[str]:
    """Trailing white space of each part moves to the next; a blank part passes it on whole."""
    out, carry = [], ""
    for p in parts:
        p = carry + p
        body = p.rstrip(" \t\n\r")
        out.append(body)
        carry = p[len(body) :]
    if out:
        out[-1] += carry
    return out


def column(f: Callable, kind: str) -> Callable[..., Column]:
    """A scalar function as an Arrow-batched UDF; null in, null out."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x)).astype(object)

    return run
