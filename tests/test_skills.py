import pytest
from pyspark.sql import functions as F

from sieveline.functions import skills as K
from sieveline.ontology import STANDARD, Ontology
from sieveline.operators.terms import BLOCK_CHARS, skills_by_automata, term_blocks, term_table
from sieveline.sources import artifacts, files


def test_substring_matching_and_aliases(one):
    got = one(
        lambda c: K.skills_in(c, STANDARD),
        ["I know HTML", "interest", "React Native dev", "scikit learn, SQL", "", None, "nothing"],
    )
    assert got == [
        ["html", "machine learning"],
        ["rest api"],
        ["react", "react native"],
        ["scikit-learn", "sql"],
        [],
        [],
        [],
    ]


def test_normalize(one):
    got = one(lambda c: K.normalize_skill(c, STANDARD), ["\u00a0ML\n", "Python", None, "scikit learn"])
    assert got == ["machine learning", "python", "", "scikit-learn"]


def test_evidence_and_top(spark):
    rows = [(0, ["python", "pandas", "sql"]), (1, []), (2, None), (3, ["docker", "swift"])]
    df = spark.createDataFrame(rows, "i int, s array<string>").withColumn("e", K.domain_evidence(F.col("s"), STANDARD))
    out = df.select("i", "e", K.top_domains(F.col("e"), 2).alias("top")).orderBy("i").collect()
    assert [(e["domain"], e["n_overlap"], e["score"]) for e in out[0]["e"]] == [
        ("Data Science", 2, 1.0),
        ("Web Development", 1, 0.5),
        ("DevOps", 0, 0.0),
        ("Mobile Development", 0, 0.0),
        ("Cybersecurity", 0, 0.0),
    ]
    assert out[0]["e"][0]["matched"] == ["pandas", "python"]
    # Without skills every score is 0 and ontology order decides.
    assert [t["domain"] for t in out[1]["top"]] == ["Data Science", "Web Development"]
    assert [t["domain"] for t in out[2]["top"]] == ["Data Science", "Web Development"]
    assert [t["domain"] for t in out[3]["top"]] == ["DevOps", "Mobile Development"]


def test_quotes_in_ontology(one):
    odd = Ontology({"It's": ["o'reilly", "back\\slash"]}, {"o'r": "o'reilly"})
    assert one(lambda c: K.skills_in(c, odd), ["an O'Reilly book, back\\slash"]) == [["back\\slash", "o'reilly"]]


def test_ontology_json(spark, tmp_path):
    (tmp_path / "o.json").write_text(
        '{"version": "1",\n "domains": {"B": {"skills": ["Y", "x"]}, "A": {"skills": ["Y"]}, "C": {}},\n'
        ' "skill_aliases": {"yy": "Y"}}'
    )
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.json").write_text("{}")
    domains, aliases = files.read_ontology_tables(spark, str(tmp_path / "o.json"))
    assert artifacts.load_ontology(domains, aliases) == Ontology({"B": ["Y", "x"], "A": ["Y"], "C": []}, {"yy": "Y"})
    assert sorted(r[0] for r in files.all_skills(domains).collect()) == ["x", "y"]
    assert artifacts.load_ontology(*files.read_ontology_tables(spark, str(tmp_path / "empty"))) == Ontology()


TEXTS = ["uses mlops and C++", "react native, rest", "scikit learn", "", None, "sq", "HTML" * 3, "penetration testing siem"]


def standard_terms(spark):
    rows = [(s,) for members in STANDARD.domains.values() for s in members] + [(None,)]
    return term_table(spark.createDataFrame(rows, "skill string"), spark.createDataFrame(list(STANDARD.aliases.items()), "alias string, canonical string"))


@pytest.mark.parametrize("size", [1, 60, BLOCK_CHARS])
def test_automata_equal_the_row_form(spark, size):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, clean_text string")
    terms = standard_terms(spark)
    assert sorted(map(tuple, terms.collect())) == STANDARD.terms()
    plain = {r[0]: r[1] for r in df.select("doc_id", K.skills_in(F.col("clean_text"), STANDARD)).collect()}
    if size == 60:
        assert len(list(term_blocks(terms, size))) > 5
    assert {r["doc_id"]: r["skills"] for r in skills_by_automata(df, terms, size=size).collect()} == plain


@pytest.mark.parametrize("size", [40, BLOCK_CHARS])
def test_null_and_repeated_keys_keep_their_own_skills(spark, size):
    df = spark.createDataFrame([(None, "sql"), (None, "docker"), (1, "aws"), (1, "aws"), (1, "nothing")], "_text int, t string")
    found = skills_by_automata(df, standard_terms(spark), "_text", "t", size)
    assert found.columns == ["_text", "skills"]
    assert sorted((r[0] or 0, r[1]) for r in found.collect()) == [(0, ["docker"]), (0, ["sql"]), (1, []), (1, ["aws"]), (1, ["aws"])]


def test_no_terms_and_no_texts(spark):
    none = spark.createDataFrame([], "needle string, skill string")
    df = spark.createDataFrame([(1, "sql")], "doc_id int, clean_text string")
    assert [tuple(r) for r in skills_by_automata(df, none).collect()] == [(1, [])]
    assert skills_by_automata(df.where("false"), standard_terms(spark)).collect() == []


def test_a_term_may_stand_for_several_skills_and_lie_in_another(spark):
    terms = spark.createDataFrame([("ab", "x"), ("ab", "y"), ("zabz", "z"), ("b", "ß"), ("日本", "j")], "needle string, skill string")
    df = spark.createDataFrame([(1, "ZABZ"), (2, "xx日本b"), (3, "a b")], "doc_id int, clean_text string")
    assert {r[0]: r[1] for r in skills_by_automata(df, terms).collect()} == {1: ["x", "y", "z", "ß"], 2: ["j", "ß"], 3: ["ß"]}


def test_texts_do_not_move(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, clean_text string")
    plan = skills_by_automata(df, standard_terms(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_many_terms_in_blocks(spark):
    """A hundred thousand terms: each text names one of them, and finds it and the terms inside it."""
    n = 100_000
    terms = spark.range(n).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("e")).alias("needle"))
    terms = terms.withColumn("skill", F.col("needle"))
    texts = spark.range(0, n, 997).select("id", F.concat(F.lit("uses t"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("e x")).alias("t"))
    found = skills_by_automata(texts, terms, "id", "t", 700_000).collect()
    assert len(found) == len(range(0, n, 997))
    assert all(r["skills"] == [f"t{r['id']:08d}e"] for r in found)
