"""Literal cases for the cleaning rules, properties of random texts, and comparison with the SQL side."""

import random
import unicodedata

from pyspark.sql import functions as F

from sieveline.functions import text as X
from tests.by_sql import cleaned_by_sql, random_texts


def test_html(one):
    assert one(X.strip_html, ["<b>hi</b>", "a < b", "<a\nhref>x", "<>", None]) == [" hi ", "a < b", " x", "<>", None]


def test_email(one):
    got = one(X.strip_email, ["me a.b@mail.example.com.", "é@x.com ok", "a@b", "x@y.c", "%@a.bc"])
    assert got == ["me  .", "  ok", "a@b", "x@y.c", "%@a.bc"]


def test_url(one):
    got = one(X.strip_url, ["see www.example.com/x).", "(https://a.b/c?d=e)", "xwww.a.b", "http:// x"])
    assert got == ["see  ).", "( )", "xwww.a.b", "http:// x"]


def test_phone_takes_year_ranges_and_long_numbers(one):
    got = one(X.strip_phone, ["2015-2019", "20152019", "+1 (415) 555-2671", "12345", "１２３４５６", "10+ years"])
    assert got == [" ", " ", " ", "12345", " ", "10+ years"]


def test_repeated_lines(one):
    long_line = "y" * 41
    got = one(
        X.drop_repeated_lines,
        [
            "Resume\nA\n a \nB\n\nA\n\nend",
            "CV\nPage\nCurriculum Vitae",
            f"{long_line}\n{long_line}",
            "a\r\nb\x0bc\x0cd\x1ce\x85f\u2028g\u2029h\x1di\x1ej",
            "tail\n",
            "",
            "\n",
            "x\n  \nX",
        ],
    )
    assert got == [
        "A\nB\n\n\nend",
        "",
        f"{long_line}\n{long_line}",
        "a\nb\nc\nd\ne\nf\ng\nh\ni\nj",
        "tail",
        "",
        "",
        "x\n",
    ]


def test_whitespace(one):
    got = one(X.collapse_whitespace, ["\u00a0a\u00a0\u00a0b\t\tc\n\n\n\nd  e\u2003", "\x1fz\x1f", "a\n \n\nb"])
    assert got == ["a b c\n\nd e", "z", "a\n \n\nb"]


def test_clean(one):
    raw = "<b>Resume</b>\nMe: a.b@mail.example.com, www.example.com\nSKILLS\nskills\n2015-2019  Worked"
    assert one(X.clean_text, [raw, None, "  "]) == ["me: ,\nskills\nworked", "", ""]


def test_cap(one):
    assert one(lambda c: X.cap_text(c, 3), [" abcd", "a  b", None, "  "]) == ["abc", "a", "", ""]


def test_years(one):
    texts = ["10+ years, 3 years", "100 years", "5 Years", "7  +  years", "2years", "x3 years", "١٢ years", "", None]
    assert one(X.years_experience, texts) == [10, 0, 5, 7, 2, 0, 12, 0, 0]


def test_noise_counts(one):
    row = one(X.noise_counts, ["<i>a@b.com</i> www.x.y 1234567 http://q.r/s"])[0]
    assert row.asDict() == {"n_html": 2, "n_email": 1, "n_url": 2, "n_phone": 1}


def test_blank(one):
    assert one(X.is_blank, [None, "", " \u3000\x1c\n", " a"]) == [True, True, True, False]


PIECES = [
    "Résumé", "resume", "CV", "page", "Page ", "skills", "Skills:", "<b>", "</b>", "<", ">", "a.b@c.de", "é@ß.com",
    "@", "http://", "https://x.y/z)", "www.q.r", "www.", "123", "4567", "+44", "(020)", "-", "٣٤٥", "555", "½", "_",
    " ", "  ", "\t", "\n", "\n", "\n\n\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u2028", "\u3000",
    ".", ",", "10 years", "Straße", "日本", "x" * 41, "%", "'", "\\", "\u200b", "e\u0301",
]


# Pieces on which the ASCII classes of the SQL side and the Unicode rules agree.
ASCII_PIECES = [p for p in PIECES if p.isascii() and not set(p) & set("\x0b\x1c\x1f")] + ["Resume", "curriculum vitae", "a-b_c@d-e.org", "+1 415-555-2671", "(x)", "years"]


def test_clean_equals_sql_on_random_texts(one):
    texts = random_texts(3000, 7, ASCII_PIECES)
    for text, got, want in zip(texts, one(X.clean_text, texts), cleaned_by_sql(texts)):
        assert got == want, repr(text)


def test_cleaned_texts_are_in_normal_form(one):
    """Whatever comes in: nothing to trim, no tabs, no double blanks, no wide gaps, lower case."""
    for got in one(X.clean_text, random_texts(3000, 8, PIECES)):
        assert got == got.strip() == got.lower()
        assert not any(x in got for x in ("\t", "\r", "\x0b", "\u00a0", "  ", "\n\n\n"))


def test_repeated_lines_go_and_order_stays(one):
    lines = [f"line {i}" for i in range(30)] + ["x" * 50]
    rng = random.Random(4)
    for _ in range(50):
        picked = [rng.choice(lines) for _ in range(60)]
        got = one(X.drop_repeated_lines, ["\n".join(picked)])[0].split("\n")
        long = [x for x in picked if len(x) > 40]
        assert [x for x in got if len(x) <= 40] == list(dict.fromkeys(x for x in picked if len(x) <= 40))
        assert [x for x in got if len(x) > 40] == long


def test_spaces_and_digits_are_complete():
    assert sorted(X.SPACE_CHARS) == [chr(c) for c in range(0x110000) if chr(c).isspace()]
    zeros = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Nd" and unicodedata.decimal(chr(c)) == 0]
    assert zeros == X.DIGIT_ZEROS


def test_no_python_worker_in_text_plans(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = docs.select(X.clean_text(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
