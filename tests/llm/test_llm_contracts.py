"""The opN queries against plain versions over whole small tables."""
import hashlib
import os
import zlib

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from calibra.llm.registry import LLM_ORACLE_SQL, LLM_QUERIES

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def result(spark, name, sf=brute.SF):
    return LLM_QUERIES[name](spark, sf).toArrow().to_pylist()


def test_op1_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{brute.SF}/documents.parquet')")
    columns = ["doc_id", "source", "epoch", "mix_block", "n_tokens"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({LLM_ORACLE_SQL['op1_source_mix']})").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in result(spark, "op1_source_mix"))
    assert got == want
    assert {r[0] for r in got} == {i for i, _ in brute.documents()}


def test_op2_agrees_with_declared_languages(spark):
    got = result(spark, "op2_language_id")
    t = pq.read_table(f"{brute.SF}/documents.parquet", columns=["doc_id", "lang"])
    lang = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist()))
    docs = [r for r in got if r["kind"] == "document"]
    assert len(docs) == len(lang) and len(got) == len(lang) + pq.read_metadata(f"{brute.SF}/pages.parquet").num_rows
    assert np.mean([r["lang"] == lang[r["doc_id"]] for r in docs]) > 0.99
    assert np.mean([r["accepted"] for r in got]) > 0.99


def test_op3_ids_equal_the_plain_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = {r["doc_id"]: r for r in result(spark, "op3_token_store")}
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    docs = sorted(brute.documents())
    for (i, _), e in zip(docs, tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False)):
        ids = [*e.ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_op4_components(spark):
    want = brute.near_dups(brute.documents(), 2)
    got = result(spark, "op4_near_dedup")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(want)


def test_op5_base_spans(spark):
    got = {r["doc_id"]: r for r in result(spark, "op5_personal_data")}
    for i, text in brute.documents():
        want, r = brute.personal(text), got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in brute.PATTERNS] == [sum(x.startswith(k) for x in want) for k in brute.PATTERNS]
        assert set(want) <= set(filter(None, r["spans"].split(",")))


def test_op7_finds_what_full_alignment_finds(spark):
    t = pq.read_table(f"{brute.SF}/benchmark.parquet")
    items = [(i, brute.words(x)) for i, x in zip(t["item_id"].to_pylist(), t["text"].to_pylist())]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in result(spark, "op7_decontaminate")}
    want = {}
    for d, text in brute.documents():
        w = brute.words(text)
        have = set(w)
        for i, item in items:
            limit = int(0.2 * len(item) + 1e-9)
            if sum(x in have for x in item) >= len(item) - limit and (distance := brute.edit_distance(item, w)) <= limit:
                want[d, i] = distance
    assert got == want and want


def test_op8_links(spark):
    t = pq.read_table(f"{brute.SF}/embeddings.parquet")
    want = brute.vector_links(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), t["label"].to_pylist())))
    got = result(spark, "op8_vector_join")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_op9_base_scores_and_a_better_model(spark):
    want = brute.base_lm(brute.documents())
    got = {r["doc_id"]: r for r in result(spark, "op9_lm_score")}
    for i, held, n, known, total, base in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op10_lines(spark):
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in result(spark, "op10_line_dedup"))
    assert got == sorted(brute.drop_lines(brute.documents()))


def test_pipeline_rows(spark):
    """Stage by stage against plain versions of what each may and must drop."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    columns = docs.columns
    kept = [dict(brute.documents())]
    for name, stage in p.STAGES[:-1]:
        docs = p.cut(stage(spark, docs, brute.SF), "teststage")
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").toLocalIterator()})
    assert len(kept[1]) == len(kept[0])
    want = brute.near_dups(list(kept[1].items()), 5)
    assert set(kept[2]) == {i for i, (_, c) in want.items() if i == c}
    t = pq.read_table(f"{brute.SF}/benchmark.parquet")
    items = [brute.words(x) for x in t["text"].to_pylist()]
    bad = {d for d, text in kept[2].items() for item in items
           if len(set(item) - set(brute.words(text))) <= int(0.2 * len(item) + 1e-9) and brute.edit_distance(item, brute.words(text)) <= int(0.2 * len(item) + 1e-9)}
    assert set(kept[3]) == set(kept[2]) - bad
    assert set(kept[4]) == set(kept[3])
    copies = docs.groupBy("doc_id").count().toArrow().to_pylist()
    assert {r["count"] for r in copies} <= {1, 2, 3}
    out = p.STAGES[-1][1](spark, docs, brute.SF).toArrow().to_pylist()
    assert len(out) == sum(r["count"] for r in copies)
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
