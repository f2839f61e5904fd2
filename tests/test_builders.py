import random
import re

import pytest
from pyspark.sql import functions as F

from turnmill.functions import chat, latex
from turnmill.functions import text as X
from turnmill.operators import analysis, builders, compose, pairs, quality, scoring, selection
from turnmill.staging import stage

TURNS = "array<struct<speaker:string,content:string>>"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tagged_reader_keeps_open_messages_and_leading_lines(spark):
    text = "<|im_start|>system\n\nkept<|im_end|>\n<|im_start|>user\nhi\n\n<|im_end|>\n<|im_start|>assistant\nnever closed"
    assert [tuple(m) for m in one(spark, chat.read_tagged(F.lit(text)))] == [("system", "\nkept"), ("user", "hi"), ("assistant", "never closed")]
    other = "<start_of_turn>user\nq<end_of_turn>\n<start_of_turn>model\na"
    assert [tuple(m) for m in one(spark, chat.read_tagged(F.lit(other)))] == [("user", "q"), ("assistant", "a")]
    assert one(spark, chat.read_tagged(F.lit("no tags"))) == []


def test_error_and_large_rates_warn_before_they_fail(spark):
    def of(error, large, n):
        rows = [(0, "error", "A")] * error + [(0, "large", "A")] * large + [(0, "agreement", "A")] * (n - error - large)
        df = spark.createDataFrame(rows, "task_id int, termination_reason string, final_answer string")
        return {r["check"]: r["status"] for r in quality.trajectory_checks(df, 1, n).collect()}

    assert [of(*x)["error_rate"] for x in ((0, 0, 80), (1, 0, 80), (5, 0, 80))] == ["PASS", "WARN", "FAIL"]
    assert [of(*x)["large_rate"] for x in ((0, 0, 80), (0, 1, 80), (0, 17, 80))] == ["PASS", "WARN", "FAIL"]


def test_repeats_and_mixing_count_trajectories(spark):
    df = spark.createDataFrame([(["Alice: a", "Bob: a", "Alice: a"],), (["Alice: x Bob: y", "Alice: Bob: z"],), (["", ""],), (["u", "v"],)], "conversation array<string>")
    got = {r["check"]: (r["status"], r["value"]) for r in quality.conversation_checks(df).collect()}
    assert got == {"name_mixing": ("WARN", 1.0), "duplicate_rate": ("FAIL", 0.25)}


def test_selection_checks(spark):
    schema = "selected boolean, rank int, reward double, effective_reward double, correct_score double"

    def of(rows):
        return {r["check"]: r["status"] for r in quality.selection_checks(spark.createDataFrame(rows, schema), 0.6).collect()}

    alone = of([(True, 0, 1.0, -9.0, 1.0)])  # nothing else has mean 0; the threshold is on the raw reward
    assert alone == {"selected_count": "PASS", "reward_lift": "PASS", "correctness_lift": "PASS", "threshold": "PASS", "rank_order": "PASS"}
    gap = of([(True, 0, 1.0, 1.0, 1.0), (True, 7, 2.0, 2.0, 1.0), (False, None, 0.5, 0.5, 1.0)])
    assert gap["rank_order"] == "FAIL" and gap["correctness_lift"] == "WARN"
    assert of([(True, k, 9.0 - (k - (k >= 10_000)) / 1e4, 1.0, 1.0) for k in (0, 9_999, 10_000, 20_001)])["rank_order"] == "PASS"
    assert of([(True, 9_999, 1.0, 1.0, 1.0), (True, 10_000, 1.5, 1.0, 1.0)])["rank_order"] == "FAIL"


def test_missing_answers_are_like_no_other(spark):
    df = spark.createDataFrame([(1, 0, None, 0.0, 1), (1, 1, None, 0.0, 1), (1, 2, "b", 1.0, 1), (1, 3, " B", 1.0, 1), (2, 0, None, 0.0, 1), (2, 1, "x", 0.0, 1)], "task_id int, pos int, final_answer string, correct_score double, token_count int")
    got = {r["task_id"]: (r["answer_key"], r["votes"]) for r in analysis.consensus(df, ["task_id"]).collect()}
    assert got == {1: ("b", 2), 2: (None, 1)}
    numbers = spark.createDataFrame([(1, 0, "it is 5", 1.0, 1), (1, 1, "5 apples", 1.0, 1), (1, 2, "6", 0.0, 1)], df.schema)
    assert analysis.consensus(numbers, ["task_id"], "gsm8k").first()["votes"] == 2
    maths = spark.createDataFrame([(1, 0, "\\frac{1}{2}", 1.0, 1), (1, 1, "0.5", 1.0, 1), (1, 2, "2", 0.0, 1)], df.schema)
    assert analysis.consensus(maths, ["task_id"], "math").first()["votes"] == 2


def test_maths_are_scored_by_value(spark):
    rows = [(1, ["Alice: a", "Bob: b"], 50, [1.0, 1.0], [gold], False, said, "math") for gold, said in (("\\frac{1}{2}", "0.5"), ("50%", "1/2"), ("x+1", "x + 1"), ("2", "3"), ("2", None))]
    df = spark.createDataFrame(rows, "task_id int, conversation array<string>, token_count int, losses array<double>, answers array<string>, answer_is_list boolean, final_answer string, score_type string")
    assert [r["correct_score"] for r in scoring.score(df).collect()] == [1.0, 1.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("a,b,same", [("x+1", "1+x", True), ("2\\sqrt{3}", "\\sqrt{12}", True), ("1e3", "1000", True), ("(x+1)^2", "x^2+2x+1", True), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt2}{2}", True), ("2^{10}", "1024", True), ("\\frac{x+1}{2x+2}", "\\frac12", True), ("\\sqrt[3]{8}", "2", True), ("-2^2", "-4", True), ("3\\pi", "\\pi \\cdot 3", True), ("x-1", "1-x", False), ("1/3", "0.333", False), ("1/0", "2", False), ("(1,2)", "(1, 2)", True), ("(1,2)", "(2,1)", False), ("9" * 5000, "9" * 5000, True), ("9^{9^9}", "9^{9^{9}}", False), ("(" * 390, "(" * 390, True), ("a^", "a^", True), ("\\frac{", "\\frac {", True), ("", "0", False)])
def test_expressions_that_are_the_same(a, b, same):
    assert latex.equivalent(a, b) == latex.equivalent(b, a) == same


def test_canonical_sums_agree_with_values():
    rnd, make = random.Random(3), lambda rnd, d: rnd.choice([str(rnd.randrange(9)), "x", f"\\frac{{{rnd.randrange(9)}}}{{{rnd.randrange(1, 9)}}}", f"\\sqrt{{{rnd.randrange(20)}}}"]) if d == 0 else f"({make(rnd, d - 1)}{rnd.choice(['+', '-', '*'])}{make(rnd, d - 1)})"
    terms = [make(rnd, rnd.randrange(4)) for _ in range(300)]

    def value(text, x):
        text = re.sub(r"\\frac\{(\d+)\}\{(\d+)\}", r"(\1/\2)", re.sub(r"\\sqrt\{(\d+)\}", r"(\1**0.5)", text))
        return eval(text, {"x": x})  # made above

    for a, b in zip(terms, terms[1:] + terms[:1]):
        same = all(abs(value(a, x) - value(b, x)) < 1e-9 * max(1, abs(value(a, x))) for x in (0.7, 1.9, -3.3))
        assert latex.equivalent(a, b) == same, (a, b)
        assert latex.equivalent(a, f"{a} + 0") and latex.equivalent(f"2*{a}", f"{a}+{a}") and not latex.equivalent(a, f"{a} + 1")


@pytest.mark.parametrize("a,b", [("1/3", "0.333"), ("2/6", "1/3"), ("-0.5", "-\\frac{1}{2}"), ("1,000", "1000"), ("1/0", "2"), ("", "0"), ("a b", "ab"), ("\\dfrac{3}{4}", "75\\%"), ("x", None), ("$7$", "7.0")])
def test_equality_of_columns_is_the_pluggable_one(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(latex.maths_equal(F.col("a"), F.col("b")).alias("x")).first()["x"] == latex.equivalent(a, b)


def test_pairs_become_prompt_and_completions(spark):
    rows = [(1, "s1", "Bob", "SA", "SB", [("Alice", "hello")], "yes", "no", 0.9, 0.1, 0.8), (2, "s0", "Alice", "SA", "SB", [], "up", "down", 0.9, 0.1, 0.8)]
    df = spark.createDataFrame(rows, f"task_id int, state_id string, speaker string, system_first string, system_second string, prefix_turns {TURNS}, chosen string, rejected string, chosen_value double, rejected_value double, distance double")
    got = {r["speaker"]: r for r in builders.pair_datasets(df).collect()}
    assert got["Bob"]["prompt"] == "<|system|>\nSB</s>\n<|user|>\nhello</s>\n<|assistant|>\n" and got["Bob"]["chosen"] == "yes</s>\n" and got["Bob"]["split"] == "train"
    merged = {r["speaker"]: r["prompt"] for r in builders.pair_rows(df, merge_system=True).collect()}
    assert merged == {"Bob": "<|user|>\nSB\n\nhello</s>\n<|assistant|>\n", "Alice": "<|user|>\nSA</s>\n<|assistant|>\n"}


def test_branches_share_the_task_s_most_tokens(spark):
    trajectory = "struct<branch_id:int,conversation:array<string>,token_count:int,losses:array<double>,answers:array<string>,answer_is_list:boolean,final_answer:string,score_type:string>"
    branch = lambda k, n: (k, ["Alice: a", "Bob: b"], n, [1.0], ["x"], False, "x", "exact-match")
    states = spark.createDataFrame([(1, "a", "Alice", [], [branch(0, 100), branch(1, 50)]), (1, "b", "Bob", [("Alice", "a")], [branch(0, 200)])], f"task_id int, state_id string, speaker string, prefix_turns {TURNS}, branches array<{trajectory}>")
    scored = builders.score_branches(builders.branches_of(states))
    assert {(r["state_id"], r["branch_id"]): r["token_score"] for r in scored.collect()} == {("a", 0): -0.25, ("a", 1): -0.125, ("b", 0): -0.5}
    assert sorted((r["state_id"], [b["branch_id"] for b in r["branches"]]) for r in builders.nest_states(scored).collect()) == [("a", [0, 1]), ("b", [0])]


def test_chat_tasks(spark):
    messages = [("user", "q"), ("assistant", "a")]
    kind = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(messages, messages, [("user", "q"), ("assistant", "z")])], f"messages {kind}, chosen {kind}, rejected {kind}")
    empty = "<|system|>\n</s>\n"
    assert builders.chat_task(df, "sft").first()["text"] == empty + "<|user|>\nq</s>\n<|assistant|>\na</s>\n"
    assert builders.chat_task(df, "generation", False).first()["text"].endswith("a</s>\n<|assistant|>\n")
    dpo = builders.chat_task(df, "orpo").first()
    assert (dpo["text_prompt"], dpo["text_chosen"], dpo["text_rejected"]) == (empty + "<|user|>\nq</s>\n", "<|assistant|>\na</s>\n", "<|assistant|>\nz</s>\n")
    assert builders.chat_task(df, "rm").first()["text_rejected"] == empty + "<|user|>\nq</s>\n<|assistant|>\nz</s>\n"
    for task, frame in (("ppo", df), ("rm", df.drop("chosen")), ("dpo", df.withColumn("chosen", F.lit("x")))):
        with pytest.raises(ValueError):
            builders.chat_task(frame, task)


def test_reply_labels():
    own, other = [7, 7], [8, 8]
    assert chat.reply_labels([1, 8, 8, 2, 7, 7, 3, 4, 8, 8, 5, 7, 7, 6], own, other) == [-100] * 6 + [3, 4] + [-100] * 5 + [6]
    assert chat.reply_labels([1, 7, 7, 3, 8, 8, 5], own, other) == [-100, -100, -100, 3, -100, -100, -100]
    assert chat.reply_labels([1, 2], own, other) == [1, 2]


def test_labels_follow_the_addressed_speaker(spark):
    df = spark.createDataFrame([([9, 7, 3, 8, 4],), ([10, 7, 3, 8, 4],), (None,)], "ids array<int>")
    got = [r["x"] for r in df.select(chat.label_replies(F.col("ids"), [7], [8], [9], [10]).alias("x")).collect()]
    assert got == [[-100, -100, 3, -100, -100], [-100, -100, -100, -100, 4], None]


def test_losses_and_framing(spark):
    df = spark.createDataFrame([(["abc", "large", "d"],), ([],)], "conversation array<string>")
    assert [r["losses"] for r in scoring.with_losses(df, lambda texts: [len(t) for t in texts], batch=1).collect()] == [[22.0, 20.0], []]
    assert one(spark, chat.frame_for_loss(F.lit("x"), True)) == "<|user|>\n</s>\n<|assistant|>\nx</s>\n"


def test_rouge_and_multisets(spark):
    pairs = [("a b c", "a c"), ("a", "..."), ("", "x"), ("x y x", "x x y"), (None, None)]
    got = [r["x"] for r in spark.createDataFrame(pairs, "g string, p string").coalesce(1).select(X.rouge_l(F.col("g"), F.col("p")).alias("x")).collect()]
    assert [round(x, 6) for x in got] == [0.8, 0.0, 0.0, 1.0, 0.0]
    assert one(spark, X.shared_count(F.array(*map(F.lit, "aabbc")), F.array(*map(F.lit, "abbbd")))) == 3


@pytest.mark.parametrize(
    "gold,said,union,m,n",
    [
        ("the cat sat. a dog ran", "a dog sat. the cat ran", 6, 6, 6),  # {the, cat, ran} from crossing sentences, then {a, dog} and {sat}
        ("a b c d. x y", "d c b a", 1, 6, 4),  # going back in the gold text where both ways are as long
        ("red red blue", "red blue red", 1, 2, 2),  # of two ways as long, that which goes back in the gold text first: red, red
        ("one. . two", "two", 1, 3, 1),  # a part of white space is an empty word
        ("...", "x", 0, 0, 1),
    ],
)
def test_rouge_of_several_sentences(gold, said, union, m, n):
    precision, recall = (union / m, union / n) if m else (0, 0)
    want = 2 * precision * recall / (precision + recall + 1e-8) if union else 0.0
    assert abs(X.summary_rouge_l(gold, said) - want) < 1e-12


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("share", [0.1, 0.25, 0.6, 0.9])
def test_unlike_selected_as_by_brute_force(spark, share):
    rnd = random.Random(int(share * 100))
    base = ["".join(rnd.choice("abé ") for _ in range(n)) for n in (0, 1, 2, 5, 9, 9, 20, 33, 34, 60)]

    def some():
        out = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            if out and rnd.random() < 0.5:
                out.pop(rnd.randrange(len(out)))
            else:
                out.insert(rnd.randrange(len(out) + 1), rnd.choice("abé "))
        return "".join(out)

    rows = [(k, rnd.randrange(3) or None, some() if k % 17 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "id int, g int, content string")
    alike = lambda a, b: None not in (a[1], b[1], a[2], b[2]) and a[1] == b[1] and edit_distance(a[2], b[2]) / (max(len(a[2]), len(b[2])) + 1) < share
    got = {r["id"] for r in pairs.unlike_selected(df, df, ["g"], share, earlier="id").collect()}
    assert got == {a[0] for a in rows if not any(b[0] < a[0] and alike(a, b) for b in rows)}
    picked = df.where("id % 7 = 0")
    got = {r["id"] for r in pairs.unlike_selected(df, picked, ["g"], share).collect()}
    assert got == {a[0] for a in rows if not any(b[0] % 7 == 0 and alike(a, b) for b in rows)}


def test_ranges_split_ties_and_keys_with_a_common_beginning(spark, monkeypatch):
    monkeypatch.setattr(selection, "stage", lambda df, name: staged.append(stage(df, name)) or staged[-1])
    rows = spark.range(0, 20_000, 1, 4).select("id", F.lit(1.0).alias("reward"), F.format_string("document-%08d", "id").alias("name"))
    for numbered in (lambda: selection.with_place(rows, "reward", ["id"]), lambda: selection.numbered(rows, "reward", [], [], "place", "total"), lambda: selection.numbered(rows, "name", [], [], "place", "total")):
        staged = []
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = numbered().select("place").distinct().count()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sizes = [r["count"] for r in staged[0].groupBy("_nth_part").count().collect()]
        assert got == 20_000 and len(sizes) == 4 and max(sizes) < 2 * 5_000


def test_passages_that_begin_and_end_inside_words(spark):
    texts = ["xxone two  Three fouryy", "one two four", "Short passage here", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", None, "", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    bench = spark.createDataFrame([("ONE two three four",), ("rt pass",), ("0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w1",), ("",), (None,)], "text string")
    assert sorted(r["id"] for r in compose.decontaminate(df, bench).collect()) == [1, 4, 5, 6]
    assert compose.decontaminate(df, bench.limit(0)).count() == len(texts)
    assert compose.decontaminate(df.withColumn("_passage", F.lit(1)), bench).columns == ["id", "text", "_passage"]


def test_islands_of_all_across_spans(spark):
    values = ["a"] * 7 + ["b"] + ["a"] * 5 + [None] * 3 + ["c"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "at int, v string").repartition(3)
    for spans in (1, 3, 20):
        got = [r["island"] for r in compose.islands(df, "v", "at", spans=spans).orderBy("at").collect()]
        assert got == [1] * 7 + [2] + [3] * 5 + [4] * 3 + [5]


def test_numbering_by_text_numbers_and_nulls(spark):
    rows = [(k % 3, None if k == 5 else f"{k * 37 % 50:03d}", k * 1.5) for k in range(50)]
    df = spark.createDataFrame(rows, "g int, s string, x double").repartition(4)
    for key in ("s", "x"):
        got = selection.numbered(df, key, [], ["g"], "n", "total").collect()
        for g in range(3):
            own = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
            assert [r["n"] for r in own] == list(range(len(own))) and {r["total"] for r in own} == {len(own)}
            values = [r[key] for r in own if r[key] is not None]
            assert values == sorted(values) and (own[-1][key] is None or len(values) == len(own))


def test_comparison_and_first_rows(spark):
    df = spark.createDataFrame([("A", " a\\", 1.0, 10, "agreement"), ("B", None, None, None, "large")], "answer string, final_answer string, correct_score double, token_count int, termination_reason string")
    got = analysis.compare_exact(df).first()
    assert (got["raw_exact_correct"], got["reward_qualified_correct"], got["median_tokens"], got["parsed_answer"]) == (1, 1, 5.0, 1)
    runs = {r["metric"]: (r["baseline"], r["post"]) for r in analysis.compare_runs(df, df.limit(0)).collect()}
    assert runs["trajectories"] == (2.0, 0.0) and runs["termination large"] == (1.0, 0.0)
    rows = spark.range(10).withColumn("k", F.col("id"))
    assert sorted(r["id"] for r in selection.first_rows(rows, "k", 3).collect()) == [0, 1, 2]
    assert compose.project(rows, ["k"], {"k": "key"}).columns == ["key"]


@pytest.mark.parametrize("chars", [8 << 20, 8])
def test_short_passages_against_a_plain_search(spark, monkeypatch, chars):
    monkeypatch.setattr(compose, "BROADCAST_CHARS", chars)
    rnd = random.Random(7)
    some = lambda n: " ".join("".join(rnd.choice("abéß字") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(n)))
    texts = [some(8) for _ in range(120)] + [None, "", "  ", "x" * 50_000, "😀abcdefghijk 😀"]
    passages = ["ab", "bbbb", "字字", "a b", "b a é", "ab ab", "字 a", "é a b ß", "ß 字字 a", "bcdefghij", "😀a", "k 😀", "x" * 60, None, " "]
    for chosen in (passages, passages[:3], passages[3:6], passages[6:9], ["zzz"]):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        bench = spark.createDataFrame([(p,) for p in chosen], "text string")
        plain = lambda t: " ".join(t.split()).lower()
        wanted = {k for k, t in enumerate(texts) if t is None or not any(p and p.strip() and plain(p) in plain(t) for p in chosen)}
        assert {r["id"] for r in compose.decontaminate(df, bench).collect()} == wanted


def test_a_frequent_short_passage_meets_by_words(spark):
    df = spark.range(0, 4_000, 1, 4).select("id", F.concat(F.lit("the "), F.when(F.col("id") % 4 == 0, "then the cat").otherwise("dog"), F.lit(" w"), F.col("id")).alias("text"))
    bench = spark.createDataFrame([("the cat",), ("thexx",), ("n the c",)], "text string")
    got = compose.decontaminate(df, bench)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 3_000
    assert compose.decontaminate(df, spark.createDataFrame([("the",)], "text string")).count() == 0


def test_prefixes_of_a_long_chain_and_of_broken_trees(spark, monkeypatch):
    chain = [(0, k, k - 1 if k else None, k, f"c{k}") for k in range(1_000)]
    odd = [(1, 0, None, 0, "r"), (1, 1, 0, 1, "a"), (1, 2, 1, 2, None), (1, 9, 8, 1, "orphan"), (1, 10, 9, 2, "below it"), (1, 20, 21, 5, "ring"), (1, 21, 20, 6, "ring"), (1, 30, 0, 3, "too deep")]
    edges = spark.createDataFrame(chain + odd, "task_id int, node_id int, parent_id int, depth int, content string")
    rounds = []
    monkeypatch.setattr(builders, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    got = {(r["task_id"], r["node_id"]): r["prefix"] for r in builders.node_prefixes(edges).collect()}
    assert len(rounds) <= 11
    assert got == {(0, k): [f"c{j}" for j in range(1, k + 1)] for k in range(1_000)} | {(1, 0): [], (1, 1): ["a"], (1, 2): ["a", None]}
    assert builders.node_prefixes(edges, 1).count() == 4 and builders.node_prefixes(edges.limit(0)).count() == 0


def plain_labels(ids, own, other, ignore=-100):
    starts = lambda m: [k for k in range(len(ids) - len(m) + 1) if ids[k : k + len(m)] == m]
    replies, others, labels = [k + len(own) for k in starts(own)], starts(other), list(ids)
    if replies and others and others[0] > replies[0]:
        others = [0, *others]
    spans = [(a if k else 0, b) for k, (a, b) in enumerate(zip(others, replies))]
    if len(replies) < len(others):
        spans.append((others[-1], len(ids)))
    for a, b in spans:
        for k in range(a, b):
            labels[k] = ignore
    return labels


def test_labels_of_many_rows_against_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [[rnd.randrange(1, 6) for _ in range(rnd.randrange(30))] for _ in range(400)] + [[], None, [1, 2], [2, 1], [1], [3, None, 1, 2, None, 4]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id int, ids array<int>").repartition(3)
    got = {r["id"]: r["x"] for r in df.select("id", chat.label_replies(F.col("ids"), [1, 2], [3], [4], [5, 5]).alias("x")).collect()}
    for k, ids in enumerate(rows):
        is_bob = ids is not None and any(ids[j : j + 2] == [5, 5] for j in range(len(ids)))
        assert got[k] == (None if ids is None else plain_labels(ids, *(([3], [1, 2]) if is_bob else ([1, 2], [3]))))
    assert df.limit(0).select(chat.label_replies(F.col("ids"), [1, 2], [3], [4], [5]).alias("x")).collect() == []
    with pytest.raises(ValueError):
        chat.label_replies(F.col("ids"), [], [3], [4], [5])
