"""Quality rules against a plain Python count."""

import re

from alertsift.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    repeated = {k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        len(w) < 10 or 100 * len(repeated) > 20 * len(w),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
CLEAN = "the cat sat on the mat and it was glad to be there with us"


def test_counts_equal_brute_force(spark):
    texts = [
        None, "", " \t\n\x0b\x0c\r", "one", "a b c d e", "a b c d e f", "a a a a a a", "a b c d e a b c d e x",
        "a b c d e f g a b c d e f g", "x\nx\n\nx\n \n \n", "é ü\x1fñ \xa0z 😀", CLEAN, "# * $ % & | < > a b c d",
        " ".join(str(k % 700) for k in range(2000)), "w " * 30, "p q r s t u v\n" * 3,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.judge(df).collect():
        assert tuple(row[n] for n in NAMES) == brute(texts[row.doc_id]), texts[row.doc_id]


def test_long_text_and_verdicts(spark):
    long = " ".join(f"w{k} the of" for k in range(60_000))
    texts = [long, CLEAN, "#%& *** $$$ |||| " * 5 + CLEAN, "zz qq xx vv bb nn mm kk jj hh gg ff " * 1 + " ".join(f"k{i}z" for i in range(60))]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, True, False, False]
    assert rows[2].failed_rules == ["symbols"] and rows[3].failed_rules == ["stop_words"]


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, CLEAN, "x"), (1, CLEAN, "x")], "doc_id long, text string, Kept string")
    out = quality.judge(df)
    assert out.count() == 2 and [c.lower() for c in out.columns].count("kept") == 1
    assert out.first()["kept"] is True
    assert quality.judge(df.limit(0)).count() == 0
