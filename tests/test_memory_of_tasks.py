"""What a task holds and sends on stays bounded."""

from types import SimpleNamespace

import pyarrow as pa
from sieveline.operators import terms
from sieveline.sources.csv_splits import csv_records


def test_lines_of_a_csv_are_not_shuffled_by_range(spark, tmp_path):
    """Only records that cross a range meet in another task; whole ones never move."""
    rows = [(str(i), "line\n" * 40 + f'"{i}"', "x") for i in range(300)]
    options = {"header": True, "escape": '"', "quoteAll": True}
    spark.createDataFrame(rows, "ID string, Resume_str string, Category string").coalesce(1).write.options(**options).csv(f"{tmp_path}/c")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = csv_records(spark, f"{tmp_path}/c")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["_number"], r["ID"], r["Resume_str"]) for r in got.collect()) == [(int(i), i, t) for i, t, _ in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # One branch has no exchange at all, and no window runs over lines.
    whole, met = plan.split("MapInArrow")[0], plan
    assert "Aggregate" not in whole and "Window" not in met and met.count("Aggregate") == 1


def test_skills_leave_a_task_in_small_batches_without_their_texts(spark):
    held = SimpleNamespace(value=[("sql", "sql")])
    batch = pa.RecordBatch.from_pydict(
        {"_key": pa.array(range(3000)), "_text": pa.array(["knows sql" * 50] * 3000), "_found": pa.array([[]] * 3000, pa.list_(pa.string()))}
    )
    out = list(terms._scan(held, ["_key", "_found"])(iter([batch])))
    assert max(b.num_rows for b in out) <= terms.ROWS_OUT and sum(b.num_rows for b in out) == 3000
    assert all(b.schema.names == ["_key", "_found"] for b in out) and out[-1].column("_found")[0].as_py() == ["sql"]
    docs = spark.createDataFrame([(1, "sql"), (2, None)], "doc_id int, clean_text string")
    found = terms.skills_by_automata(docs, spark.createDataFrame([("sql", "sql")], "needle string, skill string"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1 and "_text" not in plan[plan.index("MapInArrow") :].split("\n")[0].split("],")[-1]
    assert sorted(map(tuple, found.collect())) == [(1, ["sql"]), (2, [])]
