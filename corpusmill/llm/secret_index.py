"""Secret scanning over a trigram inverted index, in DataFrame functions only.

Every rule's regular expression yields a Boolean trigram query: an OR over the strings that some mandatory part
of the expression can spell, each an AND of its trigrams. The index holds postings (trigram, document) of the
trigrams that the queries name; evaluating the queries on it leaves each rule its candidate documents, and only
those are run through the expression. A rule whose expression has no mandatory trigram scans every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, persisted

# The parser of the standard library, for the structure of an expression.
_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """pattern: one expression, valid for Python and Java, without flags. length: (group, least number of characters); shorter matches are dropped after matching."""

    kind: str
    pattern: str
    length: tuple[int, int] = (0, 1)


def either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
#: The base rules in their order of kinds, then those that the method adds.
BASE = (
    Rule("assign", f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", (2, 6)),
    Rule("access", "AKIA[A-Z0-9]{16,}"),  # as AKIA[A-Z0-9]+ of 20 or more: a later start in a run is shorter still
    Rule("hex", "[0-9a-f]{24,}"),  # as [0-9a-f]+ of 24 or more, likewise
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED
#: A private key as a whole, for its removal: to its END line if that comes next, else over armour headers and base64 (to the text's end, if it is cut off there).
KEY = (
    "-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:"
    "[^-]*+(?:-(?!----)[^-]*+){0,400}+-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    "|(?:\\s*+[A-Z][A-Za-z-]{2,19}: [^\\n]{0,200}+\\n){0,20}+(?:(?:\\\\r)?+[\\s\\\\]*+[A-Za-z0-9+/]{16,}+={0,2}+){0,1000}+"
    "(?:[\\s\\\\]*+[A-Za-z0-9+/]{1,63}+(?:={1,2}+|(?=\\n)|(?![\\s\\S])))?+(?:[\\s\\\\]*+=[A-Za-z0-9+/]{4})?+)"
)
REMOVED = tuple(Rule(r.kind, KEY) if r.kind == "pem" else r for r in RULES)
#: Strings that one part may spell before it counts as any; trigrams kept of one string.
MOST_STRINGS, MOST_TRIGRAMS = 64, 5

Query = tuple[tuple[frozenset[str], ...], ...]


def _spells(node) -> set[str] | None:
    """All strings, lower-cased, that a node can match; None where they are too many."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out: set[str] = set()
        for o, a in arg:
            if str(o) == "LITERAL":
                out.add(chr(a).lower())
            elif str(o) == "RANGE" and a[1] - a[0] < 16:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op == "SUBPATTERN":
        return _spell_all(arg[-1])
    if op == "BRANCH":
        parts = [_spell_all(b) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op == "MAX_REPEAT" and arg[1] != _parser.MAXREPEAT and arg[1] <= 4:
        one = _spell_all(arg[2])
        if one is None:
            return None
        out, now = set(), {""}
        for k in range(int(arg[1]) + 1):
            if k >= arg[0]:
                out |= now
            now = {a + b for a in now for b in one}
            if len(now) > MOST_STRINGS:
                return None
        return out
    return None


def _spell_all(nodes) -> set[str] | None:
    now = {""}
    for n in nodes:
        s = _spells(n)
        if s is None:
            return None
        now = {a + b for a in now for b in s}
        if len(now) > MOST_STRINGS:
            return None
    return now


def trigram_query(pattern: str) -> Query:
    """AND of ORs of trigram sets that every match of the pattern satisfies, over lower-cased text; empty if the pattern has no mandatory trigram."""
    runs: list[set[str]] = [{""}]
    for node in _parser.parse(pattern):
        s = _spells(node)
        if s is None:
            runs.append({""})
        else:
            joined = {a + b for a in runs[-1] for b in s}
            if len(joined) > MOST_STRINGS:
                runs.append(s)
            else:
                runs[-1] = joined
    query = []
    for run in runs:
        if run and all(len(x) >= 3 for x in run):
            grams = sorted({tuple(dict.fromkeys(x[i : i + 3] for i in range(len(x) - 2)))[:MOST_TRIGRAMS] for x in run})
            sets = {frozenset(g) for g in grams}
            query.append(tuple(sorted((g for g in sets if not any(o < g for o in sets)), key=sorted)))
    return tuple(query)


def named_trigrams(rules=RULES) -> list[str]:
    return sorted({t for r in rules for alternatives in trigram_query(r.pattern) for g in alternatives for t in g})


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id) for the trigrams that the rules' queries name. Null texts have no postings."""
    # the lambda's argument is bound once, so that a text is lower-cased once and not for every trigram
    present = F.transform(F.array(F.lower("text")), lambda low: F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in named_trigrams(rules)])))
    return docs.select("doc_id", F.explode(F.element_at(present, 1)).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): a bit for each rule whose query the postings of the document satisfy. Postings of a document meet by a map-side combined bit-or of the trigrams' numbers."""
    names = named_trigrams(rules)
    if len(names) > 126:
        raise ValueError("more than 126 trigrams are named; lower MOST_TRIGRAMS")
    number = {t: (f"w{i // 63}", 1 << (i % 63)) for i, t in enumerate(names)}
    words = sorted({w for w, _ in number.values()}) or ["w0"]
    cases = {w: F.lit(0).cast("long") for w in words}
    by_word = {w: F.create_map(*[F.lit(x) for t, (v, bit) in number.items() if v == w for x in (t, bit)]) for w in words} if names else cases
    met = index.groupBy("doc_id").agg(*[F.bit_or(F.coalesce(F.try_element_at(by_word[w], F.col("trigram")).cast("long"), F.lit(0).cast("long"))).alias(w) for w in words])
    bits = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        query = trigram_query(r.pattern)
        if not query:
            continue
        holds = F.lit(True)
        for alternatives in query:
            some = F.lit(False)
            for grams in alternatives:
                every = F.lit(True)
                for w in words:
                    if mask := sum(number[t][1] for t in grams if number[t][0] == w):
                        every = every & (F.col(w).bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
                some = some | every
            holds = holds & some
        bits = bits.bitwiseOR(F.when(holds, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return met.select("doc_id", bits.alias("rules")).where("rules != 0")


SPAN = "struct<s:int,e:int,kind:int>"


def bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def blocks_of(values: Column) -> Column:
    """The values in blocks of about the root of their number, so that what is built value by value is built of short arrays."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(1), F.size(values), size), lambda k: F.slice(values, k, size))).otherwise(F.array(F.slice(values, 1, 0)))


def running(values: Column, step) -> Column:
    """For each value what step has made of 0 and the values before it; step must be associative."""

    def scan(block: Column, of) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(block, start, lambda acc, x: F.struct(step(acc["at"], of(x)).cast("int").alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))

    def joined(inner: Column) -> Column:
        before = scan(inner, lambda x: x["at"])["all"]
        return F.flatten(F.zip_with(inner, before, lambda x, at: F.transform(x["all"], lambda v: step(at, v).cast("int"))))

    return bound(F.transform(bound(values, blocks_of), lambda block: scan(block, lambda x: x)), joined)


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of a rule in a text, leftmost and not overlapping, in code points, end exclusive. Gaps and matches alternate from the text's start (\\G), so their lengths add up to positions."""
    whole = f"\\G((?s:.*?))({rule.pattern})"
    group, least = rule.length
    gaps, found = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    sizes = found if group == 0 else F.regexp_extract_all(text, F.lit(whole), F.lit(2 + group))

    def lengths(x: Column) -> Column:
        return F.transform(x, F.length)

    named = F.arrays_zip(lengths(gaps).alias("g"), lengths(found).alias("m"), lengths(sizes).alias("v"))

    def placed(parts: Column) -> Column:
        before = running(F.transform(parts, lambda x: x["g"] + x["m"]), lambda a, x: a + x)
        spans = F.zip_with(parts, before, lambda x, at: F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["m"]).alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")))
        return F.transform(F.filter(spans, lambda x: x["v"] >= least), lambda x: F.struct(x["s"], x["e"], x["kind"]))

    return bound(named, placed).cast(f"array<{SPAN}>")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with a column spans: array of (s, e, kind), by start, then kind (kind: the rule's number).

    Null text: no spans. Rows with a null doc_id, and repeated rows, are scanned like others (rows that share a
    doc_id share candidates, which are a superset; every match is verified on the row's own text). Long texts are
    scanned whole. The documents are joined with the candidates by broadcast where those are measurably few.
    """
    # written, since they are counted before they are joined
    bits = persisted(candidates(postings(docs, rules), rules)).withColumnRenamed("doc_id", "_candidate").withColumnRenamed("rules", "_rules")
    joined = join_sized(docs, bits, F.col("doc_id").eqNullSafe(F.col("_candidate")), "left", 16)
    empty = F.array().cast(f"array<{SPAN}>")
    parts = []
    for k, r in enumerate(rules):
        text = F.col("text")
        asked = F.coalesce(F.col("_rules"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << k).cast("long")) != 0 if trigram_query(r.pattern) else F.lit(True)
        parts.append(F.when(text.isNotNull() & asked & text.rlike(r.pattern), spans_of(text, r, k)).otherwise(empty))
    return joined.withColumn("spans", F.array_sort(F.concat(*parts), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["kind"] - b["kind"]))).drop("_candidate", "_rules")


def span_list(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules=RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; the first `base` rules are the base."""
    found = scan(docs.select("doc_id", F.col("text").cast("string")), rules)
    own = F.filter("spans", lambda x: x["kind"] < base)

    def of_kind(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{rules[k].kind}") for k in range(base)]
    return found.select("doc_id", *counts, F.sha2(span_list(own, rules), 256).alias("base_sha256"), span_list(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules=REMOVED, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text, private keys as a whole, replaced by mark (overlapping spans as one); n_chars, where there is one, follows the text. All other columns, whatever their names, stay."""
    found = scan(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), rules)
    ends = running(F.transform("spans", lambda x: x["e"]), lambda a, x: F.greatest(a, x))
    cuts = F.filter(F.zip_with("spans", ends, lambda x, at: F.struct(at.alias("from"), x["s"].alias("s"))), lambda x: x["s"] >= x["from"])

    def block(cut: Column) -> Column:
        """The kept text before each of a block's marks, cut from the block's own part of the text."""
        first = cut[0]["from"]
        part = F.substring(F.col("text"), first + 1, F.element_at(cut, -1)["s"] - first)
        return bound(part, lambda t: F.array_join(F.transform(cut, lambda x: F.concat(F.substring(t, x["from"] - first + 1, x["s"] - x["from"]), F.lit(mark))), ""))

    rest = F.substring(F.col("text"), F.array_max(F.transform("spans", lambda x: x["e"])) + 1, F.length("text"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform(bound(cuts, blocks_of), block), ""), rest)).otherwise(F.col("text"))
    found = found.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return found.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
