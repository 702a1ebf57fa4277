"""Odd rows and empty tables through every operator, SQL statements, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
import plain
from buyerlens.llm import contamination, language_model, licenses, lines, mixing, quality, queries, repeats, rules, simhash, toxicity
from buyerlens.llm.text import held_out_plain
from tools import check_oracle

SF = "/root/testdata/sf0.001"
BENCH = "item_id long, text string, score double"
OPERATORS = {
    "toxicity": lambda d, l, b: toxicity.toxicity(d, l),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
    "keep_one": lambda d, l, b: simhash.keep_one(d),
    "quality": lambda d, l, b: quality.classify(d, l),
    "keep_good": lambda d, l, b: quality.keep_good(d, l, cut=0.0),
    "repeats": lambda d, l, b: repeats.remove_repeats(d),
    "lines": lambda d, l, b: lines.drop_recurring_lines(d),
    "rules": lambda d, l, b: rules.quality_rules(d, l),
    "licenses": lambda d, l, b: licenses.license_scan(d),
    "leaks": lambda d, l, b: contamination.leaks(d, b),
    "drop_leaks": lambda d, l, b: contamination.drop_leaks(d, b),
    "mix": lambda d, l, b: mixing.mix(d),
    "language_model": lambda d, l, b: language_model.pseudo_likelihood(d),
}


def empty_like(df):
    return df.sparkSession.createDataFrame([], df.schema)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs, labels = plain.odd_frame(spark), plain.odd_labels(spark)
    bench = spark.createDataFrame([(1, plain.PROSE, 1.0), (1, plain.PROSE, 2.0), (None, "x", None), (2, None, None), (3, "", None)], BENCH)
    rows = OPERATORS[name](docs, labels, bench).collect()
    if name == "keep_one":
        assert len(rows) < 20 and len(rows[0]) == len(docs.columns)
    elif name == "drop_leaks":
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, t, *_ in plain.odd_rows() if plain.PROSE not in (t or ""))
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, *_ in plain.odd_rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    docs, labels = plain.odd_frame(spark), plain.odd_labels(spark)
    bench = spark.createDataFrame([], BENCH)
    assert OPERATORS[name](empty_like(docs), empty_like(labels), bench).count() == 0
    full = OPERATORS[name](docs, empty_like(labels), bench).count()
    assert full == 20 or name == "keep_one"


def test_repeats_and_components_of_odd_rows(spark):
    docs = [(d, t) for d, t, *_ in plain.odd_rows()]
    got = repeats.remove_repeats(plain.odd_frame(spark), kept_text=False).collect()
    assert plain.sorted_rows(got) == plain.sorted_rows(plain.repeats(docs))
    got = simhash.near_duplicates(plain.odd_frame(spark)).collect()
    assert plain.sorted_rows(got) == plain.sorted_rows(plain.components(docs))


@pytest.mark.parametrize("name", queries.ORACLE)
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check_oracle.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check_oracle.rows_of(cols, cur.fetchall())


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, now, SF).toPandas()
        before = now.toPandas()
        assert list(made.columns) == docs.columns
        text = dict(zip(before.doc_id, before.text))
        if name == "SimHash near-dedup":
            want = {c for _, _, c in plain.components(list(text.items()))}
            assert sorted(made.doc_id) == sorted(want)
        elif name == "line dedup":
            assert sorted(made.doc_id) == sorted(before.doc_id)
            assert (made.n_chars == made.text.str.len()).all() and made.n_chars.sum() < before.n_chars.sum()
        else:
            assert set(made.doc_id) <= set(before.doc_id) and len(made) < len(before)
            assert all(text[d] == t for d, t in zip(made.doc_id, made.text))
        now = spark.createDataFrame(made, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in now.collect())
    run = corpus_pipeline.run(spark, SF).collect()
    assert plain.sorted_rows((r.doc_id, r["size"], r.taken) for r in run) == plain.sorted_rows((r.doc_id, r["size"], r.taken) for r in last)


def test_line_stage_drops_lines_of_one_token(spark):
    rows = [(d, f"Les.\nown{d} text of {d * 'x'}\n文字行没有空格\nno{d}\n", "en", "s", 1) for d in range(1, 6)]
    made = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, plain.COLUMNS), SF).collect()
    assert {r.doc_id: r.text for r in made} == {
        d: t if d == 1 else f"own{d} text of {d * 'x'}\nno{d}\n" for d, t, *_ in rows
    }


def test_quality_stage_keeps_clean_documents(spark):
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and held_out_plain(r.doc_id)]
    assert sum(d in kept for d in good) >= 0.9 * len(good)
