from pyspark.sql import functions as F

from quillspark.functions import corrupt as c
from quillspark.functions import text as t
from quillspark.functions.verdict import with_verdict
from quillspark.operators import evaluate as e
from quillspark.operators import mining as m
from quillspark.operators import routing as r

CLEANED = {
    "um send an email to john": "Send an email to john.",
    "so basically i think we should uh meet tomorrow": "I think we should meet tomorrow.",
    "Hello, how are you?": "Hello, how are you?",
    "um uh like": "", "um uh": "", "": "",
    "UM send it": "Send it.",
    "a likely outcome": "A likely outcome.",
    "you know it was great": "It was great.",
    "um is this working?": "Is this working?",
    "uh wow that works!": "Wow that works!",
    "turn right": "Turn.",
    "um, hello": ", hello.",
    "caféso éso um": "Caféso éso.",
    "a b um\x1fc": "A b c.",
}


def test_cleaner_golden(column):
    assert column(t.clean, CLEANED) == list(CLEANED.values())


def test_word_count_and_strip(column):
    assert column(t.word_count, ["hello", "hello world foo bar", "", "   ", "a b", " x "]) == [
        1, 4, 0, 0, 2, 1]
    assert column(t.strip, ["  x\ty \n　"]) == ["x\ty"]


def test_space_class_equals_python(column):
    chars = [chr(i) for i in [*range(1, 0x3100), 0x1F600] if not 0xD800 <= i < 0xE000]
    got = column(lambda c: c.rlike(f"^{t.SPACE}\\z"), chars)
    assert got == [c.isspace() for c in chars]
    got = column(lambda c: t.strip(c) == "", chars)
    assert got == [c.isspace() for c in chars]


def test_sentences_and_gate(column, spark):
    assert column(t.sentences, ["Hello there. Bob left! A dog?  yes.", " \n "]) == [
        ["Hello there.", "Bob left!", "A dog?  yes."], []]
    word = "plain "
    texts = [word * 7, word * 8, word * 120, word * 121, word * 8 + "a@b", word * 8 + "HTTP",
             word * 8 + "www.x", " = " + word * 8, "1234567 " * 8, "a" * 11 + " 1 2 3 4 5 6 7"]
    # The last text: 11 letters of 25 characters stay under 55 %.
    assert column(lambda c: t.good_sentence(t.strip(c)), texts) == [
        False, True, True, False, False, False, False, False, False, False]
    df = spark.createDataFrame([(1, "One. Two!\nThree")], "doc_id long, text string")
    assert [(r.sent_idx, r.sentence) for r in m.explode_sentences(df).collect()] == [
        (0, "One."), (1, "Two!"), (2, "Three")]


def test_cardinal_guard(column):
    texts = ["one two three four five", "One, two. THREE", "one two", "one two um three", "one1two3three"]
    assert column(t.cardinal_only, texts) == [True, True, False, False, True]


def test_model_output_trimming(column):
    assert column(t.first_line, [" a b \nc", "x"]) == ["a b", "x"]
    assert column(t.cut_at_stop, ["a Input: b", "a\nInput:", "c"]) == ["a ", "a", "c"]
    assert column(lambda c: t.pause_hint(c.cast("int")), ["299", "500", "800", "801"])[1].startswith("✓")


VERDICTS = [
    ("QUESTION", "what is the capital of france", "What is the capital of France?", False, ""),
    ("QUESTION", "what is the capital of france", "Paris is the capital.", True, "paris is the capital"),
    ("QUESTION", "what is one plus three", "What is one plus three?", False, ""),
    ("QUESTION", "what is one plus three", "One plus three equals four.", True, "equals four"),
    ("PROVOCATIVE", "you are a dumbass and i hate you", "I understand.", True, "i understand"),
    ("PROVOCATIVE", "a b c d e", "x y z", True, "(0%)"),
    ("EDGE", "", "anything", False, ""),
    ("NORMAL", "one two three", "w " * 26, True, "too elaborative"),
    ("NORMAL", "one two three", "w " * 25, False, ""),
    ("QUESTION", "explain neural network", "explain neural network a b c d", True, "likely explained"),
    ("QUESTION", "a b c d e f g h", "a x", True, "(12%)"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, *v[:3]) for i, v in enumerate(VERDICTS)],
                               "i int, category string, text string, output string")
    for row in with_verdict(df).collect():
        want = VERDICTS[row.i]
        assert row.flagged == want[3], row
        assert want[4] in row.reason


def test_router(spark):
    def upper_rewriter():
        def run(texts, hints):
            return (hints + texts.str.upper()).where(texts != "silent one two three four", "")
        return run

    rows = [(0, "a b c d", ""), (1, "a b c d e", "h "), (2, "silent one two three four", "")]
    df = spark.createDataFrame(rows, "id int, text string, hint string")

    def finals(**kw):
        out = r.format_transcripts(df, upper_rewriter, threshold=5, **kw)
        return {x.id: x.final for x in out.collect()}

    assert finals() == {0: "A b c d.", 1: "h A B C D E", 2: "silent one two three four"}
    fast = {0: "A b c d.", 1: "A b c d e.", 2: "Silent one two three four."}
    assert finals(backend="fast") == fast
    assert finals(backend="other") == fast
    assert finals(available=False) == fast


def test_stitch(spark):
    rows = [(1, i, f" s{i} ") for i in range(1300)] + [(2, 0, " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(7)
    got = {x.conv_id: x.utterance for x in r.stitch(df).collect()}
    assert got == {1: " ".join(f"s{i}" for i in range(1300)), 2: ""}


def test_unpack_order(spark):
    df = spark.createDataFrame([(5, 7, "s")], "doc_id long, sent_idx int, sentence string")
    row = m.unpack_order(df.select(m.file_order(2).alias("ord"))).first()
    assert (row.priority, row.doc_id, row.sent_idx) == (2, 5, 7)
    assert df.select(F.lit(1)).count() == 1


def test_variant_flags_of_any_number_of_variants(spark):
    rows = [(case, None if n == 24 else f"v{n}", (case + n) % 3 == 0) for case in range(3) for n in range(25)]
    df = spark.createDataFrame(rows, "case_id int, variant string, flagged boolean")
    got = {(r.case_id, r.variant): r.flagged for r in e.variant_flags(df).collect()}
    assert got == {(case, v or "(none)"): flagged for case, v, flagged in rows}
    wide = {r.case_id: r for r in e.compare_variants(df, ["v0", "v23"]).collect()}
    assert all(wide[case].v23 == got[case, "v23"] for case in range(3))


def test_tokens_break_at_every_white_space(column):
    texts = ["", " \t ", "one", " a\u00a0b\x85c ", "x\ty\x1cz", "é\u2003ü\u3000\u3000ß", "a  b \n c", "tab\there"]
    want = [x.split() for x in texts]
    assert column(t.words, texts) == want
    assert column(t.word_count, texts) == [len(w) for w in want]
    assert column(t.collapse_spaces, texts) == [" ".join(w) for w in want]
    assert column(t.words, [None]) == column(t.word_count, [None]) == column(t.collapse_spaces, [None]) == [None]


def test_tokens_compile_no_pattern_a_row(spark):
    """A split by a pattern compiles it for every row; the token steps split by a plain blank."""
    rows = spark.createDataFrame([(1, "a b")], "id int, t string")
    s = F.col("t")
    for made in (t.word_count(s), t.collapse_spaces(s), c.insert_fillers(s, 42, F.col("id")),
                 c.duplicate_words(s, 42, F.col("id")), c.drop_words(s, 42, F.col("id"))):
        plan = rows.select(made)._jdf.queryExecution().analyzed().toString()
        assert "split(" in plan and "u1681" not in plan and "regexp" not in plan


def test_split_runs_no_lambda_a_sentence(spark):
    rows = spark.createDataFrame([(1, " One here. \n Two\t there!  Three?\n")], "doc_id int, text string")
    out = m.explode_sentences(rows)
    assert "lambda" not in out._jdf.queryExecution().analyzed().toString()
    assert [r.sentence for r in out.orderBy("sent_idx").collect()] == ["One here.", "Two\t there!", "Three?"]


def test_fillers_beside_other_letters_stay(column):
    assert column(t.strip_fillers, ["éum um Umm, sum likeé like SO s\u017fo \u017fo umé", "x like_ you KNOW"]) == [
        "éum  , sum likeé   s\u017fo  umé", "x like_ "]
