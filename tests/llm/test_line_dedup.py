from collections import Counter

from checks.compare import rows_of_spark, rows_of_sql
from spillwatch.llm import line_dedup, queries

from . import brute


def found(docs, **kw):
    return Counter(tuple(r) for r in line_dedup.digest(line_dedup.dedup_lines(docs, **kw)).collect())


def test_query_agrees_with_sql(spark, duck, sf_dir):
    name = "op5_line_dedup"
    assert rows_of_spark(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.ORACLE[name])


def test_hot_line_spread_over_partitions_nulls_and_ties(make_docs):
    hot, warm = "This line stands in very many documents, " * 2, "another line that five documents hold, exactly five"
    rows = [(k, f"own line of {k}\n  {hot.upper()}\t\n{warm if k < 5 else 'x'}\n{hot}") for k in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "short\nshort"), (204, "é" * 39), (205, warm[:-1])]
    assert found(make_docs(rows)) == Counter(brute.line_dedup(rows))


def test_repeated_rows_count_once(make_docs):
    line = "a line of more than forty characters, in few documents"
    rows = [(1, line), (1, line), (2, line), (2, line), (3, line), (4, line)]
    assert found(make_docs(rows)) == Counter(brute.line_dedup(rows))
    rows.append((5, line))
    assert found(make_docs(rows)) == Counter(brute.line_dedup(rows))


def test_null_number_is_the_smallest(make_docs):
    line = "a line of more than forty characters, in few documents"
    kept = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(make_docs([(None, line), (1, line)]), min_docs=2).collect()}
    assert kept == {None: "", 1: line}


def test_empty_table_and_untouched_columns(make_docs):
    assert found(make_docs([])) == Counter()
    out = line_dedup.dedup_lines(make_docs([(1, "x")]))
    assert out.select("row.*").columns == make_docs([]).columns


def test_bitmaps_round_trip():
    raw = line_dedup.pack_bitmap(19, [0, 7, 18])
    assert [k for k, keep in enumerate(line_dedup.unpack_bitmap(raw, 19)) if not keep] == [0, 7, 18]
