import duckdb
import pytest

from sievewright.llm import queries


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in queries.SQL:
        con = duckdb.connect()
        for t in ("text_corpus", "qa_candidates", "label_aliases", "sample_targets", "sft_rows", "documents", "eval_items", "source_targets"):
            con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
        found = con.execute(queries.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_columns(spark, data):
    want = {
        "p1_found": ["id"], "p3_found": ["coarse_taxon", "question_type"], "p4_found": ["category_key_a", "category_key_b"], "p5_found": ["id"],
        "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id", "lang_found"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, data).columns == columns
