"""Vector codes, token alignment and packing against plain versions, and their edge cases."""
import math
import zlib

import brute
import numpy as np
import public_tokenizers as public
import pyarrow.parquet as pq
import pytest

from calibra.llm import align as al
from calibra.llm import codes as vc
from calibra.llm import packing as pk
from calibra.llm import segments as sg
from calibra.llm import textbytes as tb
from calibra.llm.registry import LLM_QUERIES

EXTRA = "part string, block string, at string, ids string, n string, label2 string, of string, of_salt string, salt string, rank string, base string, kind string"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox"), (2, None), (3, ""), (4, " "), (5, "  two  spaces  and end "), (6, "\n\t mixed \r\n lines\n\n"), (7, LONG),
    (8, "café   naïve  x 　 你好 \U0001f600́ y"), (9, "mark ▁ here"), (10, "<|endoftext|> a<|endoftext|>b <s> <0x41> </s>"),
    (11, "x" * 5000), (None, "The quick brown fox"), (1, "The quick brown fox"), (12, "a\x00b \x1c c \x85 d"), (13, "don't we'll I'm 12345 3.14!? ..."),
    (14, "a  b   c   d"), (15, "   z"), (16, "   z "), (17, "é "), (18, "!  "),
]


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    names = sg.byte_names()
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))

    def a(text):
        return [(i, bytes(names[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]

    def b(text):
        pieces = [(i, sp.id_to_piece(i)) for i in sp.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    return a, b


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return df.toArrow().to_pylist()


def texts(spark, given=TEXTS):
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(i, t, *["q"] * n) for i, t in given], f"doc_id long, text string, {EXTRA}")


def vectors(spark, given):
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(i, v, x, *["q"] * n) for i, v, x in given], f"vec_id long, embedding array<double>, label int, {EXTRA}")


# --- operator 11

def test_op11_equals_plain_rounds(spark):
    t = pq.read_table(f"{brute.SF}/embeddings.parquet")
    want, digest = brute.vector_codes(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), t["label"].to_pylist())))
    got = rows(LLM_QUERIES["op11_vector_codes"](spark, brute.SF))
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want and len(got) == len(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def plain_assign(points, books):
    out = []
    for p in range(len(points)):
        d = ((points[p][:, None, :] - books[p][None, :, :]) ** 2).sum(2)
        out.append(d.argmin(1))
    return np.array(out)


@pytest.mark.parametrize("seed", range(6))
def test_trees_assign_like_full_comparison(seed):
    rng = np.random.default_rng(seed)
    n, width, entries = int(rng.integers(1, 900)), int(rng.integers(1, 6)), int(rng.integers(1, 65))
    span = int(rng.choice([2, 30, 4000]))
    points = rng.integers(-span, span, (vc.PARTS, n, width))
    points[:, : n // 3] = points[:, :1]                      # a third are copies
    books = rng.integers(-span, span, (vc.PARTS, entries, width))
    books[:, entries // 2:] = books[:, : entries - entries // 2]     # ties between entries
    tree = vc.grow(points)
    start, end, entry = vc.assign(points, tree, books)
    sort = np.argsort(start)
    assert start[sort][0] == 0 and end[sort][-1] == vc.PARTS * n and (start[sort][1:] == end[sort][:-1]).all()
    got = np.empty(vc.PARTS * n, np.int64)
    got[tree["tree_order"]] = np.repeat(entry[sort], (end - start)[sort])
    assert (got.reshape(vc.PARTS, n) == plain_assign(points, books)).all()


def test_cover_tree_properties():
    rng = np.random.default_rng(5)
    points = rng.normal(0, 300, (vc.PARTS, 600, 4)).astype(np.int64)
    tree = vc.grow(points)
    flat, order = points.reshape(-1, 4), tree["tree_order"]
    inner = 0
    for k in range(len(tree["node_start"])):
        s, e, reach = tree["node_start"][k], tree["node_end"][k], tree["node_reach"][k]
        d = ((flat[order[s:e]] - flat[order[s]]) ** 2).sum(1)
        assert d.max() == reach                                            # covering, with the exact radius
        first, many = tree["node_child"][k], tree["node_children"][k]
        if many:
            inner += 1
            kids = np.arange(first, first + many)
            assert tree["node_start"][kids[0]] == s and tree["node_end"][kids[-1]] == e        # nesting
            centres = flat[order[tree["node_start"][kids]]]
            gaps = ((centres[:, None] - centres[None]) ** 2).sum(2)[~np.eye(many, dtype=bool)]
            assert (gaps > reach // 4).all() and (tree["node_reach"][kids] <= reach // 4).all()     # separation
    assert inner > 50


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(7)
    centres = rng.integers(-20_000, 20_000, (8, 4))
    points = np.array([centres[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, (2000, 4)) for _ in range(vc.PARTS)])
    books = np.array([centres for _ in range(vc.PARTS)])
    start, _, _ = vc.assign(points, vc.grow(points), books)
    assert len(start) < vc.PARTS * 2000 / 20


def test_vector_code_edges(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(0, 1, 32)], i % 3 if i % 5 else None) for i in range(40)]
    given = good + [(100, None, 1), (101, [*good[0][1][:-1], None], 1), (102, [*good[0][1][:-1], math.inf], 1), (103, [math.nan] * 32, None)]
    codes, books = vc.compress(vectors(spark, given).repartition(3))
    got = rows(vc.with_label_error(codes))
    want, digest = brute.vector_codes(given)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want and len(got) == 40
    assert books[32].shape == (16, 40, 2) and vc.books_digest(books[32], 32) == digest
    # repeated and null ids, copies, other lengths, empty vectors, components beyond the bound
    odd = good[:3] + good[:3] + [(None, good[4][1], None), (None, good[4][1], None), (7, [], 1), (8, [1.5, -0.25, 3.0], 1), (9, [1e300, -1e300, 0.0], 1)]
    got = rows(vc.with_label_error(vc.compress(vectors(spark, odd).repartition(2))[0]))
    assert len(got) == len(odd)
    assert [r["code"] for r in got if r["vec_id"] == 7] == ["00" * 16] and [r["error"] for r in got if r["dim"] == 3] == [0, 0]
    assert len({r["code"] for r in got if r["vec_id"] is None}) == 1
    assert rows(vc.with_label_error(vc.compress(vectors(spark, []))[0])) == []
    with pytest.raises(ValueError):
        vc.compress(vectors(spark, good), entries=300)


def test_vector_codes_do_not_depend_on_the_layout(spark):
    t = spark.read.parquet(f"{brute.SF}/embeddings.parquet")
    results = [sorted((r["vec_id"], r["code"], r["error"]) for r in rows(vc.compress(t.repartition(k))[0])) for k in (1, 5)]
    assert results[0] == results[1]


# --- operator 12

def test_op12_equals_alignment_of_whole_texts(spark):
    want = brute.aligned(brute.documents(), *tokenizers())
    got = rows(LLM_QUERIES["op12_token_alignment"](spark, brute.SF))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
    assert sum(r["n_links"] for r in got) > 0


def test_alignment_edges(spark, tmp_path):
    a, b = al.default_tokenizers()
    for given in (TEXTS, []):
        texts(spark, given).coalesce(1).write.parquet(f"{tmp_path}/{len(given)}/documents.parquet")
        got = rows(al.op12_token_alignment(spark, f"{tmp_path}/{len(given)}"))
        want = brute.aligned(given, *tokenizers())
        key = lambda r: (r[0] is None, *[x for x in r if x is not None])
        assert sorted((tuple(r.values()) for r in got), key=key) == sorted(want, key=key)
    none = [w for w in brute.aligned(TEXTS, *tokenizers()) if w[0] in (2, 3, 9)]
    assert [w[1:] for w in none] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_alignment_blocks_give_the_same_counts(spark, monkeypatch):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    counts = lambda aligned: sorted(tuple(r.values()) for r in rows(al.pair_counts(aligned)))
    one = counts(al.align(docs.coalesce(1), *al.default_tokenizers()))
    many = counts(al.align(docs.repartition(7), *al.default_tokenizers()))
    assert one == many and len(one) > 100


def test_coalesce_and_overlaps():
    a_end, b_end = np.array([2, 5, 6, 9]), np.array([1, 2, 4, 6, 7, 9])
    group = al.coalesce(a_end, b_end)
    assert group.tolist() == [0, 1, 1, 2, 0, 0, 1, 1, 2, 2]
    left, right = al.overlaps(a_end, b_end)
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (3, 5)]
    none = np.zeros(0, np.int64)
    assert len(al.coalesce(none, none)) == 0 and len(al.overlaps(none, none)[0]) == 0


def test_segments_are_coded_like_whole_texts():
    coder = sg.byte_level(open(public.path("byte_bpe_50k.json"), encoding="utf-8").read(), False)
    assert not coder.whole and not sg.piece_model(open(public.path("piece_bpe_32k.model"), "rb").read()).whole
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    import pyarrow as pa

    given = [t or "" for _, t in [*TEXTS, *brute.documents()]]
    ids, counts = coder.rows(*tb.text_bytes(pa.array(given)))
    stop = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(given):
        assert ids[stop[i]:stop[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:60])


# --- operator 13

def check_packing(got, docs, capacity=pk.CAPACITY):
    """Every id in one piece, sequences gapless, and no padding at all."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sorted([*plain.encode(t or "", add_special_tokens=False).ids, 1] for _, t in docs)
    by_doc, used = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at & (at - 1) == 0
    assert set(used) == set(range(len(used)))
    assert sum(r["length"] for r in got) == sum(map(len, want))
    return by_doc, want


def test_op13_packs_every_id_once(spark):
    docs = brute.documents()
    got = rows(LLM_QUERIES["op13_sequence_packing"](spark, brute.SF))
    by_doc, _ = check_packing(got, docs)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for i, text in docs:
        ids, at = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_edges(spark):
    got = rows(pk.pack(texts(spark).repartition(3), pk.default_tokenizer()))
    by_doc, want = check_packing(got, TEXTS)
    assert [r["length"] for r in by_doc[2]] == [1] and by_doc[3][0]["ids"] == [1]
    joined = []
    for i, parts in by_doc.items():
        if i not in (1, None):
            joined.append([x for r in sorted(parts, key=lambda r: r["start"]) for x in r["ids"]])
    assert all(x in want for x in joined) and len(by_doc[1]) >= 2
    one = {r["sequence_id"]: r["ids"] for r in rows(pk.sequences(spark.createDataFrame(got, pk.PIECES)))}
    assert all(len(x) == pk.CAPACITY or len(x) & (len(x) - 1) == 0 for x in one.values())
    assert sorted(x for ids in one.values() for x in ids) == sorted(x for ids in want for x in ids)
    assert rows(pk.pack(texts(spark, []), pk.default_tokenizer())) == []
    many = rows(pk.pack(texts(spark, [(i, "") for i in range(5000)]).repartition(4), pk.default_tokenizer()))
    check_packing(many, [(i, "") for i in range(5000)])


@pytest.mark.parametrize("seed", range(20))
def test_plans_waste_nothing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([4, 16, 64, 256, 2048]))
    lengths = rng.integers(1, capacity, int(rng.integers(1, 2000)))
    if seed % 3 == 0:
        lengths[: len(lengths) // 3] = lengths[0]
    values, counts = np.unique(lengths, return_counts=True)
    plan = pk.plan_packs(dict(zip(values.tolist(), counts.tolist())), capacity)
    item, start, length, sequence, offset = pk.place(plan, np.repeat(values, counts), np.concatenate([np.arange(c) for c in counts]))
    size = np.repeat(values, counts)
    assert (np.bincount(item, length) == size).all()
    total = int(size.sum())
    assert len(np.unique(sequence)) == total // capacity + bin(total % capacity).count("1")
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    new = np.append(True, s[1:] != s[:-1])
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all()
    filled = np.bincount(s, n).astype(int)
    assert all(x == capacity or x & (x - 1) == 0 for x in filled.tolist())


def test_steps_are_bounded_by_the_capacity():
    small = {length: 1000 for length in range(1, 2048)}
    large = {length: n * 1_000_003 for length, n in small.items()}
    assert len(pk.plan_packs(large, 2048)["rank"]) < 3 * len(pk.plan_packs(small, 2048)["rank"]) < 100_000


def test_new_queries_are_registered():
    import __spark_entry__ as entry

    assert [sum(n.startswith(f"op{i}_") for n in entry.queries()) for i in (11, 12, 13)] == [1, 1, 1]
