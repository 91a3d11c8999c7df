import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from check_oracle import digest
from helpers import awkward, components, shingles, table
from quarry.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_sql_twins(spark):
    con = duckdb.connect()
    for t in ("documents",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in Q.ORACLE.items():
        assert digest(entry.queries()[name](spark, SF).toPandas())[:3] == digest(con.sql(sql).df())[:3]


def test_stages_follow_their_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "pieces":
            assert docs.columns == list(pipeline.COLUMNS)
    assert len(kept["language"]) >= 198                               # clean documents stay
    assert set(kept["lines"]) == set(kept["language"])
    assert all(r["n_chars"] == len(r["text"]) for r in kept["lines"].values())
    want = components({k: shingles(r["text"]) for k, r in kept["lines"].items()})
    assert set(kept["copies"]) == {k for k in want if want[k] == k}
    assert set(kept["benchmarks"]) <= set(kept["copies"]) and set(kept["pieces"]) == set(kept["benchmarks"])


def test_language_stage_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    other = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
             "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心",
             "qxzv wkqj zzxq vbnq xjkw qqwz hjkq zxcv bnmq wqpx jkzx qvkx"]
    clean = ["the", "This.", "yes", "niño", "de la"]
    rows = table(spark, list(enumerate(other + clean, 10**9))).select(*pipeline.COLUMNS[:2], F.lit(None).cast("string").alias("lang"), *pipeline.COLUMNS[3:])
    kept = {r["doc_id"] for r in pipeline.language(spark, docs.unionByName(rows), SF).collect()}
    assert {k for k in kept if k >= 10**9} == {10**9 + len(other) + k for k in range(len(clean))}
    assert len(kept) >= docs.count() + len(clean) - 2


def test_stage_cases(spark):
    columns = list(pipeline.COLUMNS)
    docs = awkward(spark).select(*columns)
    for name, stage in pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert pipeline.lines(spark, docs, SF).count() == docs.count()
    assert pipeline.benchmarks(spark, docs, SF).count() == docs.count()
    assert {r["doc_id"] for r in pipeline.copies(spark, docs, SF).collect()} == {1, 2, 3, None, 4, 5, 6}
    assert pipeline.language(spark, docs.limit(0), SF).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: every row is judged by its own text."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    copy = " ".join(f"word{k}" for k in range(40))
    rows = table(spark, [(None, copy), (None, copy), (7, copy + " more"), (8, item), (8, "a text of its own that leaks nothing at all"),
                         (None, item), (9, "another clean text")]).select(*pipeline.COLUMNS)
    kept = [r["text"] for r in pipeline.copies(spark, rows, SF).collect()]
    assert sum(t.startswith(copy) for t in kept) == 1 and kept.count(item) == 1 and len(kept) == 4
    left = sorted((r["doc_id"] or 0, r["text"]) for r in pipeline.benchmarks(spark, rows, SF).collect())
    assert left == [(0, copy), (0, copy), (7, copy + " more"), (8, "a text of its own that leaks nothing at all"), (9, "another clean text")]
