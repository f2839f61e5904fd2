from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnmill.functions import chat, latex
from turnmill.functions import text as X
from turnmill.operators import compose, replay


def each(spark, column, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r[1] for r in df.select("k", column(F.col("t"))).orderBy("k").collect()]


def test_scalars(spark):
    assert each(spark, X.parse_tag, ["<A>x</A> then <A>y</A>", "none", "<A>open", None]) == ["y", None, None, None]
    assert each(spark, X.normalize_answer, ["x = 1,000", "\\text{5} dollars", "$\\frac12$", "\\sqrt2", "\\boxed{7}", "an 3 units"]) == ["1000", "5", "\\frac{1}{2}", "\\sqrt{2}", "7", "3"]
    assert each(spark, X.first_number, ["is -3.5 or 4", "none"]) == ["-3.5", "none"]
    assert each(spark, X.f1_text, ["Amsterdam", " m = x"]) == ["amsterda", "x"]
    assert each(spark, X.strip_speaker, [" Alice : Hi ", "Bob:x", "Carol: x"]) == ["hi", "x", "carol: x"]
    assert each(spark, X.strip_speaker_bold, ["** Alice: Hi", None]) == ["Hi", ""]
    assert each(spark, lambda c: X.trim_at(c, ["Bob:", "Alice:"]), ["hi  Bob: x Alice:", "hi ", "Bob:"]) == ["hi", "hi ", ""]
    assert each(spark, X.docstring, ['a """ doc """ b', 'a """x""" b """ y """', "'''z'''", "none"]) == ["doc", "y", "z", None]
    assert each(spark, X.is_mojibake, ["ok\t", "\x01", "�"]) == [False, True, True]
    assert each(spark, X.prompt_body, ["x<p>a\nb</p><p>c</p>", "no"]) == ["a\nb", ""]
    assert each(spark, X.drop_name_instruction, ['a\n6. You must begin your response with "${name}:".\nb\n', "c"]) == ["a\nb", "c"]
    assert each(spark, lambda c: X.add_speaker(c, F.lit("Bob"), F.lit("debate")), ["hi", " Bob: hi", "Bobby"]) == ["Bob:hi", " Bob: hi", "Bobby"]
    assert each(spark, lambda c: X.fill_template(c, name=F.lit("A$1")), ["${name} ${other}"]) == ["A$1 ${other}"]
    assert each(spark, lambda c: X.edit_share(c, F.lit("héllo")), ["hello"]) == [1 / 6]


def f1(a, b):
    a, b = (x.lower().strip().strip("m=").strip("m =").split() for x in (a, b))
    tp = sum((Counter(a) & Counter(b)).values())
    return 2 * tp / (len(a) + len(b)) if tp else 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab m=\n", max_size=20), st.text("ab m=\n", max_size=20)), min_size=1, max_size=30))
def test_token_f1(spark, rows):
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string").select("k", X.token_f1(F.col("a"), F.col("b"))).orderBy("k").collect()
    assert [round(r[1], 9) for r in got] == [round(f1(*r), 9) for r in rows]


def test_boxed_and_equal():
    assert latex.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c") == "\\frac{1}{2}"
    assert latex.last_boxed("\\boxed 5$ x") == "5" and latex.last_boxed("\\fbox{3}") == "3"
    assert latex.last_boxed("\\boxed{open") is None and latex.last_boxed("none") is None and latex.last_boxed(None) is None
    for a, b, same in [("\\frac{1}{2}", "0.5", True), ("1/2", "\\dfrac{2}{4}", True), ("50\\%", "0.5", True), ("1,000", "1000", True), ("x+1", "x + 1", True), ("x", "y", False), ("-\\frac{1}{2}", "-.5", True), ("1/0", "2", False), (None, "1", False)]:
        assert latex.equivalent(a, b) is same, (a, b)


def test_chat(spark):
    m = [("system", "SYS"), ("user", "A1"), ("assistant", "B"), ("assistant", "C")]
    df = spark.createDataFrame([([dict(role=r, content=c) for r, c in m],), ([],)], f"m {chat.MESSAGE}")
    merged = [[tuple(x) for x in r[0]] for r in df.select(chat.adapt(F.col("m"), True)).collect()]
    assert merged == [[("user", "SYS\n\nA1"), ("assistant", "B\n\nC")], []]
    plain = [[tuple(x) for x in r[0]] for r in df.select(chat.adapt(F.col("m"))).collect()]
    assert plain[0] == [("system", "SYS"), ("user", "A1"), ("assistant", "B\n\nC")]
    text = df.select(chat.render_chatml(F.col("m")).alias("t")).first()["t"]
    back = each(spark, chat.read_tagged, [text, "<start_of_turn>user\nhi<end_of_turn><start_of_turn>model\nyo<end_of_turn>"])
    assert [tuple(x) for x in back[0]] == m and [tuple(x) for x in back[1]] == [("user", "hi"), ("assistant", "yo")]
    assert [r[0][0]["role"] for r in df.select(chat.with_system(F.slice("m", 2, 9))).collect()] == ["system", "system"]
    mask = spark.range(1).select(chat.loss_mask(F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit(2), F.lit(1)))).first()[0]
    assert mask == [-100, -100, 1]


def test_mixing(spark):
    frames = [spark.range(100).withColumn("src", F.lit(k)) for k in range(3)]
    mixed = compose.mix_frames(list(zip(frames, (0.5, 0.3, 0.2))), "id", "42", "train")
    assert mixed.count() == 100 and compose.mix_frames(list(zip(frames, (0.5, 0.3, 0.2))), "id", "42", "test").count() == 300
    assert compose.mix_frames(list(zip(frames, (0.7, 0.4))), "id", "42", "train").count() == 110
    for bad in (lambda: compose.mix_frames([(frames[0], -1.0)], "id", "42", "train"), lambda: compose.mix_frames([(frames[0], 1.0)], "id", "42", "other")):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(compose, "BROADCAST_CHARS", 8)
    df = spark.createDataFrame([(1, "has The  needle x"), (2, "clean"), (3, "other pin")], "id int, text string")
    bench = spark.createDataFrame([("the needle",), ("PIN",), (" ",), (None,)], "text string")
    assert [r["id"] for r in compose.decontaminate(df, bench).collect()] == [2]
    assert compose.decontaminate(df, bench.limit(0)).count() == 3


def test_replay(spark):
    df = spark.createDataFrame([(0, 0, 1.0, ["hello world", "x"]), (0, 1, 0.0, ["hello worle", "y"]), (0, 2, 0.5, ["other"])], "task_id int, rollout int, reward double, contents array<string>")
    got = {r["content"]: (r["value"], r["visits"], r["depth"]) for r in replay.replay_tree(df).collect()}
    assert got == {"": (0.5, 3, 0), "hello world": (0.5, 2, 1), "x": (1.0, 1, 2), "y": (0.0, 1, 2), "other": (0.5, 1, 1)}
    answers = spark.createDataFrame([(0, 0, "a b"), (0, 1, "c"), (0, 2, "C"), (0, 3, "b a")], "task_id int, pos int, final_answer string")
    assert sorted(r["pos"] for r in replay.cluster_by_f1(answers).collect()) == [0, 3]
