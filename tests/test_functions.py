"""Hand-written cases of the operators, with nulls, ties and empty groups."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import feedback, lean
from corpusmill.functions import text as T
from corpusmill.operators import aggregate as A
from corpusmill.operators import external as X
from corpusmill.operators import joins as J
from corpusmill.operators import relational as R
from corpusmill.operators import sets as S
from corpusmill.operators import trees as TR
from corpusmill.plans import pipelines as P


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_proofs_to_statements_counts_null_once_and_takes_first_by_order(spark):
    p = spark.createDataFrame([(1, "b", 2, True), (1, "a", 1, True), (1, None, 3, False), (1, None, 4, None), (2, "z", 1, False)], "statement_id long, formal_proof string, sample_id int, is_valid boolean")
    got = {r["statement_id"]: r for r in A.proofs_to_statements(p).collect()}
    assert (got[1]["n_proofs"], got[1]["n_correct_proofs"], got[1]["one_formal_proof"]) == (3, 2, "a")
    assert (got[2]["n_proofs"], got[2]["n_correct_proofs"], got[2]["one_formal_proof"]) == (1, 0, "")


def test_votes(spark):
    v = spark.createDataFrame([(1, "A", 0), (1, "A", 1), (1, "B", 2), (2, "B", 0), (2, "A", 1), (3, None, 0)], "item int, vote string, turn int")
    assert dict(map(tuple, A.strict_majority(v, "item", "vote").collect())) == {1: "A", 2: "Inconclusive", 3: "Status not found"}
    assert {r["item"]: r["status"] for r in A.plurality(v, "item", "vote", "turn").collect()} == {1: "A", 2: "B"}


def test_metrics_with_zero_denominators(spark):
    df = spark.createDataFrame([(False, False), (None, True)], "t boolean, p boolean")
    r = A.classification_metrics(df, F.col("t"), F.col("p")).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["accuracy"], r["conclusive"]) == (1, 0.0, 0.0, 0.0, 1.0, 0.5)


def test_anti_keeps_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r["k"] for r in J.anti(a, b, "k").collect()] == [None]


def test_left_with_suffix_and_nest(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, u string")
    b = spark.createDataFrame([(1, "q")], "id int, u string")
    assert J.left_with_suffix(a, b, "id").columns == ["id", "u", "u_verified"]
    nested = {r["id"]: r["n"] for r in J.nest(a, b.withColumnRenamed("u", "v"), "id", ["v"], "n").collect()}
    assert nested[2] == [] and nested[1][0]["v"] == "q"


def test_contains_join_short_and_odd_passages(spark):
    t = spark.createDataFrame([(1, "say the quick brown fox jumps over it"), (2, "no"), (3, None)], "i int, t string")
    p = spark.createDataFrame([(1, "quick brown fox jumps over"), (2, "no"), (3, "-x"), (4, None)], "j int, p string")
    assert {(r["i"], r["j"]) for r in J.contains_join(t, p, "t", "p").collect()} == {(1, 1), (2, 2)}


def test_global_rank_is_a_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = S.global_rank(df, [F.col("k")], "r", 7).collect()
    assert all(x["k"] == x["r"] for x in got) and len(got) == 1000


def test_near_dedup_keeps_one_of_a_cluster(spark):
    base = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(1, base), (2, base + " x"), (3, base), (4, "all other words here now then"), (5, None), (6, "")], "id int, t string")
    assert sorted(r["id"] for r in S.near_dedup(df, "id", "t").collect()) == [1, 4, 5, 6]


def test_hash_sampling_is_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert S.hash_sample(df, "k", 10, "s").collect() == S.hash_sample(df.repartition(7), "k", 10, "s").collect()


def test_feedback_cases(spark):
    cases = [('{"error":null,"response":{"env":0}}', (False, True, True)), ('{"error":null,"response":{"messages":[{"severity":"error","data":"x"}]}}', (True, False, False)), ("{\"error\":null,\"response\":{\"messages\":[{\"severity\":\"warning\",\"data\":\"declaration uses 'sorry'\"}]}}", (False, False, True)), ('{"error":"timeout","response":null}', (True, False, False)), ("{broken", (True, False, False)), (None, (True, False, False))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r["i"]: tuple(r["f"]) for r in df.select("i", feedback.reply_flags(F.col("c")).alias("f")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}
    assert one(spark, feedback.inner_has_error(F.col("c")), c='{"error":null}') is True
    assert one(spark, feedback.inner_has_error(F.col("c")), c='{"env":0}') is False


def test_text_functions(spark):
    assert one(spark, T.remove_comments(F.col("c")), c="a /- x\ny -/ b -- c\nd") == "a  b \nd"
    assert one(spark, T.insert_informal(F.col("c"), F.lit("say. The final answer is 2")), c="import M\ntheorem x") == "import M\n/- say. -/\ntheorem x"
    assert one(spark, T.insert_informal(F.col("c"), F.lit("say")), c="def x") == "def x"
    assert one(spark, T.remove_sorry(F.col("c")), c="a := by sorry") == "a := by \n"
    assert one(spark, T.judge_boxed_status(F.col("c")), c="x \\boxed{\\text{Correct}} Status: Incorrect") == "Correct"
    assert one(spark, T.judge_line_status(F.col("c")), c="Incorrect\nfinally Correct") == "Correct"
    assert one(spark, T.snippet(F.col("c"), F.lit(1), F.lit(2), F.lit(3), F.lit(1)), c="abc\nmid\nxyz") == "c\nmid\nx"
    assert one(spark, T.first_fence(F.col("c")), c="a\n```lean\nb\n```") == "b\n"


def test_lean_scanners():
    assert lean.split_proof("theorem a : 1 = 1 := by\n  rfl") == ("theorem a : 1 = 1 := by\n", "  rfl")
    assert lean.split_indexes("theorem d (x : ℕ) : let y := x; y = x := by\n rfl") == [44 - 1]
    assert not lean.splitable("theorem g : 1 = 1 := by rfl\ntheorem h : 2 = 2 := by rfl")
    assert lean.negate("theorem b {x : ℝ} (h : x > 0) : x ≠ 0 := by simp") == "theorem b_negated : ¬ (∀ (x : ℝ) (h : x > 0), x ≠ 0) := by sorry"
    assert lean.negate("example : 1 = 1 := by rfl") is None and lean.negate(None) is None
    assert lean.contradict("theorem c : 1 = 1 := by rfl") == "theorem c_contradicted : False := by sorry"
    assert lean.longest_common_run("a b c d".split(), "x b c y".split()) == 2
    assert lean.diverse(["a b c", "a b c d", "x y z"], 2) == ["a b c", "x y z"]
    assert lean.settle_spaces(["a ", " ", "b\n"]) == ["a", "", "  b\n"]
    assert lean.truncate_tactic("simp\nrest") == "simp" and lean.truncate_tactic("/- a\nb -/ x\ny") == "/- a\nb -/ x"
    assert lean.loose_span("a b  c", "bc") == (2, 6)


def test_trees():
    import json

    tree = [{"node": {"stx": {"pp": "a"}}, "children": [{"node": {"stx": {"pp": "<failed to pretty print>"}}, "children": [{"node": {"stx": {"pp": "b"}}, "children": []}]}]}]
    assert [(n[0], n[1], n[2]) for n in TR.flatten_infotree(json.dumps(tree))] == [(0, -1, "a"), (1, 0, "b")]
    steps = [{"tactic": "a", "goals_before": ["x"], "goals_after": ["x"]}, {"tactic": "b", "goals_before": ["x"], "goals_after": []}, {"tactic": "c", "goals_before": [], "goals_after": ["z"]}]
    assert [s["tactic"] for s in TR.merge_equal_goals(steps)] == ["ab", "c"]
    assert TR.parse_outline("Lemma 1: a\n  more\n└── Claim 1.1: b")[1][:2] == ("1.1", "1")


def test_walk_equals_recursive_sql(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("c", "d", 1)], "parent string, child string, ord long")
    e.createOrReplaceTempView("walk_edges")
    want = spark.sql("WITH RECURSIVE t(node, depth) AS (SELECT 'a', 0 UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN walk_edges e ON e.parent = t.node) SELECT * FROM t")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in TR.walk(e, roots).collect()} == {tuple(r) for r in want.collect()}


def test_deep_trees(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1) for i in range(200)] + [("n7", "leaf", 2)], "parent string, child string, ord long")
    down = {r["node"]: (r["depth"], len(r["path"])) for r in TR.walk(e, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert len(down) == 202 and down["n200"] == (200, 200) and down["leaf"] == (8, 8)
    up = {r["at"]: r["steps"] for r in TR.up_to_root(e, spark.createDataFrame([("n200",)], "node string")).collect()}
    assert up == {f"n{i}": 200 - i for i in range(201)}
    distances = TR.distance_to_proof(e, spark.createDataFrame([("n200",), ("leaf",)], "node string"))
    assert {r["node"]: r["distance"] for r in distances.collect()} == {f"n{i}": 8 - i if i < 8 else 200 - i for i in range(201)} | {"leaf": 0}
    assert [r["node"] for r in TR.shortest_path(e, distances, "n0").orderBy("step").collect()] == [f"n{i}" for i in range(8)] + ["leaf"]


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "y", 1), (None, "z", 1)], "parent string, child string, ord long")
    node = "node string"
    assert TR.walk(e, spark.createDataFrame([("x",)], node)).count() == 2
    assert {r["node"]: r["distance"] for r in TR.distance_to_proof(e, spark.createDataFrame([("c",)], node)).collect()} == {"c": 0, "b": 1, "a": 2}
    with pytest.raises(ValueError, match="cycle"):
        TR.walk(e, spark.createDataFrame([("a",)], node))


def test_minhash_pairs_of_a_large_cluster(spark):
    import random

    random.seed(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(3):
            words[random.randrange(200)] = f"x{i}_{random.random()}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[0][1]), (201, "alone in the world of words here"), (202, ""), (203, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    exact = {frozenset((r["src"], r["dst"])) for r in S.jaccard_pairs(df, "id", "text").collect()}
    got = {frozenset((r["src"], r["dst"])): r["jaccard"] for r in S.minhash_pairs(df, "id", "text", cell=50).collect()}
    assert len(exact) > 7000 and len(set(got) & exact) >= 0.99 * len(exact) and set(got) - exact == {frozenset((0, 200))}
    kept = {r["id"] for r in S.near_dedup(df, "id", "text").collect()}
    assert kept == {0, 201, 202, 203}


def test_jaccard_pairs_meet_by_rare_shingles(spark, monkeypatch):
    """Texts that share a common passage alone are no candidates; pairs equal all pairs, however many shingles are counted."""
    import random

    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*passage, *(f"u{i}_{j}" for j in range(80))])) for i in range(60)]
    rows += [(100 + i, " ".join([w if rng.random() > 0.02 * (i % 3) else f"v{i}" for w in t.split()])) for i, t in rows]
    rows += [rows[0], (300, rows[1][1]), (301, ""), (302, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    grams = {}
    for i, t in rows:
        w = (t or "").split()
        grams.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None, i)
    sets = [(i, g) for g, i in grams.items() if g]
    want = sorted((a, b) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= 0.7)
    made, real = [], S.stored
    for counted in (4000, 3):
        monkeypatch.setattr(S, "COUNTED", counted)
        monkeypatch.setattr(S, "stored", lambda x: made.append(real(x)) or made[-1])
        assert want and sorted((r["src"], r["dst"]) for r in S.jaccard_pairs(df, "id", "text").collect()) == want
        assert made[-1].columns == ["src", "dst"] and (counted == 3 or made[-1].count() < 3 * len(want))


@pytest.mark.parametrize("bounds", [{}, {"most_run": 8, "slice_bytes": 4000, "cell": 6}])
def test_jaccard_pairs_send_sets_once(spark, monkeypatch, bounds):
    """Unrelated texts that share prefix elements are ruled out by sketches; no pair's sets are joined to the pair."""
    import random

    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"u{i}_{j}" for j in range(60))])) for i in range(40)]
    near = [f"n{i}" for i in range(100)]
    rows += [(100 + i, " ".join([w if rng.random() > 0.02 else f"x{i}" for w in near])) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string")
    grams = {}
    for i, t in rows:
        grams.setdefault(frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)), i)
    sets = [(i, g) for g, i in grams.items()]
    want = sorted((a, b, round(len(x & y) / len(x | y), 9)) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= 0.7)
    made, real = [], S.stored
    monkeypatch.setattr(S, "COUNTED", 0)  # no order by a sample, as for shingles that it misses
    monkeypatch.setattr(S, "stored", lambda x: made.append(real(x)) or made[-1])
    got = S.jaccard_pairs(df, "id", "text", **bounds)
    assert want and sorted((r["src"], r["dst"], round(r["jaccard"], 9)) for r in got.collect()) == want
    assert made[-1].columns == ["src", "dst"] and made[-1].count() <= len(want)
    assert not [x for x in made if {"x", "y", "s"} & set(x.columns)]


def test_external_never_loses_rows(spark):
    df = spark.createDataFrame([(1, "p"), (2, None)], "id int, t string")

    def broken(prompts, n):
        raise TimeoutError("down")

    got = X.explode_completions(X.generate(df, "t", 2, broken), "id").collect()
    assert len(got) == 2 and all(r["error"] == "down" and r["formal_proof"] is None for r in got)
    assert {r["id"]: r["has_error"] for r in X.verify(df, "t", lambda p: ['{"error":null,"response":{"env":0}}'] * len(p)).collect()} == {1: False, 2: True}
    rows = X.best_first("thm", 30)
    assert rows == X.best_first("thm", 30) and rows[0][1] == "0"


def test_failed_calls_are_tried_again():
    calls = []

    def flaky(items):
        calls.append(list(items))
        if len(calls) < 3:
            raise TimeoutError("busy")
        return [x.upper() for x in items]

    assert X.persistent(flaky, ["a", "b"], pause=0) == [("A", None), ("B", None)] and len(calls) == 3

    def picky(items):
        if "bad" in items:
            raise ValueError("no")
        return items[:-1] if "short" in items and len(items) > 1 else items

    assert X.persistent(picky, ["a", "bad", "b"], pause=0) == [("a", None), (None, "no"), ("b", None)]
    assert X.persistent(picky, ["short", "a"], pause=0) == [("short", None), ("a", None)]
    tried = []

    def down(items):
        tried.append(len(items))
        raise OSError

    assert X.persistent(down, ["x"] * 50, pause=0) == [(None, "OSError")] * 50 and tried == [50] * 3 + [1] * 9
    assert X.persistent(down, []) == []


def test_local_model(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(20)], "id int, t string")

    def load():
        def model(prompts):
            if "> t7" in prompts:
                raise ValueError("t7")
            return [p + "!" for p in prompts]

        return model

    got = {r["id"]: (r["output"], r["error"]) for r in X.infer(df, "t", load, 4, "> {}").collect()}
    assert got[3] == (None, None) and got[7] == (None, "t7") and all(got[i] == (f"> t{i}!", None) for i in range(20) if i not in (3, 7))


def test_calls_are_paid_once(spark, tmp_path):
    def model(prompts, n):
        for p in prompts:
            with open(tmp_path / "calls", "a") as f:
                f.write(p + "\n")
        return [[p] * n for p in prompts]

    out = X.generate(spark.createDataFrame([(str(i),) for i in range(30)], "t string"), "t", 2, model)
    assert out.count() == out.where("size(completions) = 2").count() == 30
    assert sorted((tmp_path / "calls").read_text().split()) == sorted(map(str, range(30)))


def test_indent(spark):
    assert one(spark, T.indent(F.col("c"), "  "), c="a\n\nb\r\nc\u2028d\n") == "  a\n  \n  b\r\n  c\u2028d\n  "


def test_negated_union(spark):
    s = spark.createDataFrame([("a", "theorem a : 1 = 1 := by rfl", False), ("b", "def x := 1", False)], "statement_id string, formal_statement string, is_negation boolean")
    assert P.negated(s).count() == 3 and P.negated(s, keep=True).count() == 4


def test_range_join_bins_agree(spark):
    p = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    r = spark.createDataFrame([(0, 5, 40), (1, 90, 95), (2, 50, 50)], "k long, s long, e long")
    assert sorted(map(tuple, J.range_join(p, r, ["k"], "x", "s", "e").collect())) == sorted(map(tuple, J.range_join(p, r, ["k"], "x", "s", "e", 10).collect()))


def test_max_similarity_paths_agree(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(10)], "id int, embedding array<float>")
    a = {r["id"]: round(r["max_cosine"], 6) for r in J.max_similarity(v, v.where("id > 6")).collect()}
    b = {r["id"]: round(r["max_cosine"], 6) for r in J.max_similarity(v, v.where("id > 6"), most_bytes=0).collect()}
    assert a == b


def test_filters_and_shards(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "x")], "id int, t string")
    assert [r["id"] for r in R.filter_chain(df, "t", [("char_length", {"low": 1}), ("line_count", {})]).collect()] == [1]
    shards = S.row_shards(spark.range(10), [F.col("id")], 4).groupBy("shard_id").count().collect()
    assert sorted(map(tuple, shards)) == [("00000", 4), ("00001", 4), ("00002", 2)]
    assert S.key_shards(spark.range(0), "id", 3).count() == 0


#: Short statements in the shapes that the scanners must take: places of the splits (the last such marks), name, binders, conclusion.
SHAPES = [
    ("import Mathlib\n\ntheorem a (x : ℕ) (h : x > 0) : x ≠ 0 := by\n  omega", ":= by", "a", "(x : ℕ) (h : x > 0)", "x ≠ 0"),
    ("theorem b {x y : ℝ} (h : x < y) : ¬ y ≤ x := by\n  linarith", ":= by", "b", "{x y : ℝ} (h : x < y)", "¬ y ≤ x"),
    ("theorem c : 1 + 1 = 2 := by norm_num", ":= by", "c", "", "1 + 1 = 2"),
    ("theorem d (x : ℕ) : let y := x; y = x := by\n  rfl", ":= by", "d", "(x : ℕ)", "let y := x; y = x"),
    ("lemma e (p q : Prop) : (p ↔ q) → (q ↔ p) := fun h => h.symm", ":=", "e", "(p q : Prop)", "(p ↔ q) → (q ↔ p)"),
    ("theorem f : ∀ x : ℕ, ∃ y : ℕ, y > x := by\n  intro x\n  exact ⟨x + 1, by omega⟩", ":= by", "f", "", "∀ x : ℕ, ∃ y : ℕ, y > x"),
    ("theorem i (f : ℕ → ℕ) (hf : ∀ x, f x = (x : ℕ) * 2) :\n    f 2 = 4 := by\n  simp [hf]", ":= by", "i", "(f : ℕ → ℕ) (hf : ∀ x, f x = (x : ℕ) * 2)", "f 2 = 4"),
]


def test_scanners_take_every_shape():
    for code, mark, name, binders, conclusion in SHAPES:
        assert lean.split_indexes(code) == [code.rindex(mark) + len(mark)] and lean.splitable(code), code
        c = lean.components(code)
        assert (c["name"], c["binders"], c["conclusion"]) == (name, binders, conclusion) and c["lib"] + code[len(c["lib"]) :] == code
        assert code[lean.top_level_colon(code, code.index(name + " ")) + 1 :].strip().startswith(conclusion[:3])
        head, tail = lean.split_proof(code)
        assert (head + tail).replace("\n", "") == code.replace("\n", "") and head.rstrip().endswith((":= by", ":="))
        assert f"{name}_negated {binders}".strip() in lean.negate_partial(code) and lean.negate_partial(code).endswith(f": ¬ ({conclusion}) := by sorry")
        assert lean.contradict(code).endswith(": False := by sorry") and f"{name}_contradicted" in lean.contradict(code)
        assert (f"∀ {binders.replace('{', '(').replace('}', ')')}, " in lean.negate(code)) == bool(binders)
    two = "theorem g : 1 = 1 := by rfl\ntheorem h : 2 = 2 := by rfl"
    assert lean.split_indexes(two) == [23, 51] and not lean.splitable(two) and lean.components(two)["name"] == "g"
    assert lean.split_indexes("example : 1 = 1 := by rfl") == [21] and lean.components("example : 1 = 1 := by rfl") is None
    assert lean.split_indexes("def k := 3") == [] == lean.split_indexes(None) and lean.split_proof("def k := 3") is None and lean.contradict("def k := 3") is None


def test_scanners_of_lines_and_steps():
    text = "import A\nimport B\n\nopen Nat\n\n-- about\n/- more -/\ntheorem t (x : ℕ) :\n    x = x := by\n  rfl"
    assert lean.split_proof_by_line(text) == (text[: text.index("\n  rfl")], "  rfl") and lean.split_proof_by_line("theorem c : 1 = 1 := by rfl") is None and lean.split_proof_by_line(None) is None
    assert lean.context_of(text, 10) == {"header": "import A\nimport B\n", "context": "open Nat\n", "comment": "-- about\n/- more -/", "statement": "theorem t (x : ℕ) :\n    x = x := by"}
    assert lean.top_level_colon("(a : b) c") == -1 == lean.top_level_colon("x := y : z") and lean.top_level_colon("[a : b] : c") == 8
    steps = [{"tactic": "simp", "line": 1, "column": 2, "comment": None}, {"tactic": "rw [a,\n b]", "line": 3, "column": 2, "comment": None}, {"tactic": "<;> x", "line": 4, "column": 4, "comment": None}]
    assert lean.rebuild(steps) == "  simp\n\n  rw [a,\n b] <;> x"
    assert lean.segment_logprobs(["si", "mp", "\n", "rf", "l"], [-1.0, -2.0, -4.0, -8.0, -16.0], ["simp", "rfl"]) == [-3.0, -28.0]
    assert lean.longest_common_run(list("abcdef"), list("zbcdy")) == 3 and lean.longest_common_run([], ["a"]) == 0
    assert lean.loose_span("a b", "c") is None and lean.loose_span("x  y\nz", "y z") == (3, 6) and lean.loose_span("x", " ") is None
    assert lean.truncate_tactic(None) is None and lean.truncate_tactic("\nsimp\nx") == "\nsimp" and lean.truncate_tactic("simp```") == "simp"
    assert lean.diverse([], 2) == [] and lean.diverse(["a", "a", "b"], 5) == ["a", "b"]


def test_search_takes_the_best_node_first():
    asked = []
    tactics = {"goal": [("a", -0.1), ("b", -0.5), ("bad", -0.01)], "s_a": [("a", -2.0), ("b", -3.0)], "s_b": [("a", -0.1), ("again", -0.1)], "s_b2": [("done", -0.3)]}
    moves = {("goal", "a"): ("s_a", "open"), ("goal", "b"): ("s_b", "open"), ("goal", "bad"): ("x", "failed"), ("s_a", "a"): ("s_c", "open"), ("s_a", "b"): ("s_c", "open"), ("s_b", "a"): ("s_b2", "open"), ("s_b", "again"): ("s_b2", "open"), ("s_b2", "done"): ("qed", "proved")}

    def policy(state):
        asked.append(state)
        return tactics[state]

    rows = X.best_first("goal", 10, policy, lambda state, tactic: moves[state, tactic])
    assert asked == ["goal", "s_a", "s_b", "s_b2"]  # -0.1, then -0.5 before -2.1, then -0.6
    assert [r[3] for r in rows] == [None, "a", "b", "bad", "a", "a", "done"] and rows[-1][5] == "proved"  # equal children merge to the likelier
    assert rows[-1][4] == pytest.approx(-0.9) and rows[3][5] == "failed"
    asked.clear()
    assert len(X.best_first("goal", 1, policy, lambda state, tactic: moves[state, tactic])) == 4 and asked == ["goal"]
    assert X.best_first("goal", 5, lambda s: [], lambda s, t: None) == [("goal", "0", None, None, 0.0, "open", 0)]


def test_cache_calls_only_for_new_keys(spark, tmp_path):
    store, asked = str(tmp_path / "store"), []

    def call(df):
        asked.append(sorted(r["k"] for r in df.collect()))
        return df.withColumn("answer", F.concat(F.lit("a"), "k"))

    df = spark.createDataFrame([("1",), ("2",)], "k string")
    assert {r["answer"] for r in X.cached(df, store, "k", call).collect()} == {"a1", "a2"}
    more = df.union(spark.createDataFrame([("3",)], "k string"))
    assert {r["answer"] for r in X.cached(more, store, "k", call).collect()} == {"a1", "a2", "a3"}
    assert asked == [["1", "2"], ["3"]] and X.cached(more, store, "k", call).count() == 3


def test_pipelines_by_value(spark):
    code = "theorem t{} : {} = {} := by rfl"
    s = spark.createDataFrame([(str(i), code.format(i, i, i), False) for i in range(4)], "statement_id string, formal_statement string, is_negation boolean")
    store = spark.createDataFrame([("0", 3), ("neg_1", 1), ("2", 2)], "statement_id string, proof_count long")
    right = '{"error":null,"response":{"env":0}}'
    proofs, record = P.proof_generation(s, store, 2, 2, lambda p, n: [[f"{x}#{i}" for i in range(n)] for x in p], lambda p: [right if x.endswith("#0") else "{" for x in p])
    assert sorted((r["statement_id"], r["is_valid"]) for r in proofs.collect()) == [("2", False), ("2", True), ("3", False), ("3", True)]
    assert {r["statement_id"]: r["proof_count"] for r in record.collect()} == {"0": 3, "neg_1": 1, "2": 3, "3": 1}
    pool = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k int, t string")
    rounds = P.bootstrap_round(pool, pool.where("k < 3"), "k", "t", 100, "s", lambda p: [right if x in ("t5", "t7") else '{"error":"no","response":null}' for x in p])
    assert sorted(r["k"] for r in rounds.collect()) == [0, 1, 2, 5, 7]
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "a | b c d e f g"), (4, "x")], "id int, t string")
    assert sorted(r["id"] for r in P.filtered_and_deduped(docs, "id", "t", [("char_length", {"low": 5}), ("without_word", {"word": "|"})]).collect()) == [1]
    judged = P.candidate_build(s.withColumn("uuid", F.lit(1)), spark.createDataFrame([("0",)], "statement_id string"), 3, lambda texts, vote: ["Status: Correct" if "t1" in t or ("t2" in t and vote == 0) else "Status: Incorrect" for t in texts])
    assert [r["statement_id"] for r in judged.collect()] == ["1"]
    m = P.judge_evaluation(docs, "id", "t", F.col("id") < 3, 3, lambda texts, vote: ["Status: Correct" if "one" in t or "a" in t else "no idea" for t in texts]).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["conclusive"]) == (2, 0, 1, 0, 0.75)


def test_listing_and_folders(spark, tmp_path):
    from corpusmill.sources import tables

    for d, texts in (("x", {"a.txt": "1", "b.txt": "2"}), ("y", {"a.txt": "3"})):
        (tmp_path / d / "deep").mkdir(parents=True)
        for name, t in texts.items():
            (tmp_path / d / name).write_text(t)
    (tmp_path / "y" / "deep" / "c.lean").write_text("theorem")
    assert sorted(r["path"].rpartition("/")[2] for r in tables.list_files(spark, str(tmp_path), "*.lean").collect()) == ["c.lean"]
    got = {r["folder"]: (r["a.txt"], r["b.txt"]) for r in tables.read_folders(spark, str(tmp_path), ("a.txt", "b.txt")).collect()}
    assert got == {"x": ("1", "2"), "y": ("3", None)}


def test_outlines_and_infotrees(spark):
    df = spark.createDataFrame([(1, "Lemma 1: a\n  more\n└── Claim 1.1: b"), (2, None), (3, "no heading")], "k int, t string")
    assert [tuple(r) for r in TR.outline_nodes(df, "k", "t").orderBy("id").collect()] == [(1, "1", None, "Lemma", "a\nmore"), (1, "1.1", "1", "Claim", "b")]
