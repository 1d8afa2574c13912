"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import decontaminate as dc
from calibra.llm import language_id as li
from calibra.llm import line_dedup as ld
from calibra.llm import lm_score as lm
from calibra.llm import mixing as mx
from calibra.llm import near_dedup as nd
from calibra.llm import pii
from calibra.llm import secrets as sc
from calibra.llm import token_store as ts
from calibra.llm import vector_join as vj
from calibra.session import fresh_path

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
A, B = "one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven thirteen"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, body string, n string, sig string,"
          " tokens string, block string, epoch string, rep string, comp string, base string, spans string, words string, value string")
DOCS = [
    (1, A), (2, A), (3, B), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, "short"), (9, "SHORT"), (10, A.upper()),
    (11, "mail a.b@c.de or +1 (555) 123-4567, host 10.0.0.1 card 4111 1111 1111 1111\n" + "x" * 30),
    (None, A), (None, None), (12, "x" * 30 + "\n" + "x" * 30 + "\n\n"), (13, "X" * 30 + "  \n"), (13, "X" * 30 + "  \n"),
    (14, "café Été naïve <|endoftext|> a<|startoftext|>b"), (15, "\U0001f600 你好 ́x  y z"),
]


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else f"src{k % 2}", 0, *["q"] * 13) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return df.toArrow().to_pylist()


def test_near_dedup(docs, nothing):
    got = rows(nd.near_duplicates(docs, shingle_words=2))
    assert len(got) == len(DOCS)
    named = [(i, t) for i, t in DOCS if i is not None]
    want = brute.near_dups(named, 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True, True]
    kept = rows(nd.keep_one(docs, shingle_words=2))
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, *sorted(i for i, (_, c) in want.items() if i == c)]
    assert rows(nd.near_duplicates(nothing)) == [] and rows(nd.keep_one(nothing)) == []


def test_near_dedup_limit_is_exact(spark):
    base = [f"w{i}" for i in range(9)]      # 9 single-word shingles; 8 of 10 shared is the limit
    texts = [(1, " ".join(base)), (2, " ".join([*base[:8], "z"])), (3, " ".join([*base[:7], "y", "x"]))]
    got = rows(nd.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle_words=1))
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute.near_dups(texts, 1).items()} == {1: 1, 2: 1, 3: 3}


def test_union_sketch_keeps_what_the_binomial_tail_allows(spark):
    k = 64
    need = nd.required_overlap(k, 0.8)
    reps, pairs = [], []
    for hits in (need - 1, need, k):     # of the 64 smallest values of the union so many are in both sketches
        own = k - hits
        a, b = [*range(hits + own // 2)], [*range(hits), *range(hits + own // 2, k)]
        a, b = ([*x, *range(at, at + k - len(x))] for x, at in ((a, 1000), (b, 2000)))
        reps += [(2 * hits, 1000, a), (2 * hits + 1, 1000, b)]
        pairs.append((2 * hits, 2 * hits + 1))
    got = nd._estimated(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(reps, "id long, n long, sketch array<long>"), k, 0.8)
    assert {r["a"] // 2 for r in rows(got)} == {need, k} and need == 33


def test_token_store(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, file = fresh_path(spark, "test-tokens"), public_tokenizers.path("word_bpe_49k.json")
    ts.write_tokens(docs, path, file)
    plain = Tokenizer.from_file(file)
    want = sorted(((i if i is not None else -1, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in DOCS), key=lambda x: (x[0], x[1]))
    got = rows(ts.read_tokens(spark, path))
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got), key=lambda x: (x[0], x[1])) == want
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"] or -1) for r in got)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:]))
    digest = rows(ts.token_digest(spark, path))
    assert sorted(r["ids_crc32"] for r in digest) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want)
    found = ts.lookup(spark, path, [3, 99])
    assert [r["doc_id"] for r in rows(found)] == [3]
    assert "PushedFilters: [In(doc_id, [3,99])]" in found._jdf.queryExecution().toString()
    empty = fresh_path(spark, "test-tokens")
    ts.write_tokens(nothing, empty, file)
    assert rows(ts.token_digest(spark, empty)) == []


def test_pieces_equal_the_whole_text():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    plain, pieces = Tokenizer.from_file(file), ts.PieceEncoder(open(file).read())
    alphabet = st.sampled_from(list("abzAZ09'.,!-<|> \n\t") + ["é", "É", "ß", "×", "÷", "́", " ", "ς", "Σ", "İ", "«", "你", " ", "'s", "'LL", "<|", "ǆ"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(alphabet, max_size=14).map("".join), min_size=1, max_size=4))
    def check(texts):
        raw = [t.encode() for t in texts]
        offs = np.cumsum([0] + [len(x) for x in raw])
        ids, counts = pieces.encode(np.frombuffer(b"".join(raw), np.uint8), offs)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]

    check()


def test_lines(docs, nothing):
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in rows(ld.dedup_lines(docs)) if r["doc_id"] is not None)
    x = [r for r in got if r[0] in (11, 12, 13)]
    assert x == [(11, 2, 1), (12, 4, 2), (13, 2, 0), (13, 2, 0)]
    assert [r[1:] for r in got if r[0] in (4, 5)] == [(1, 0), (1, 0)]
    assert rows(ld.dedup_lines(nothing)) == []


def test_line_runs_compact_and_settle(spark):
    runs = ld.LineRuns(spark, min_docs=3, fanout=2)
    for batch in ([(9, 1)], [(8, 1), (8, 2)], [(7, 1), (7, 2), (7, 3)], [(6, 1), (6, 3)], [(5, 1)]):
        runs.add(spark.createDataFrame([(h, h, i) for i, h in batch], "hi long, lo long, id long"))
    assert len(runs.paths()) <= 3 and len(runs.levels) > 1
    assert [(r["hi"], r["top"]) for r in rows(runs.duplicated())] == [(1, 9)]
    held = runs._merged(runs._read(runs.paths())).where("hi = 1").first()["docs"]
    assert held == 3      # later holders of a settled line were not written


def test_lm(docs, nothing):
    got = rows(lm.lm_scores(docs, min_state=1e-3, min_arc=1e-3, block_tokens=5000))
    assert len(got) == len(DOCS) and all(math.isfinite(r["score"]) for r in got)
    named = [(i, t) for i, t in DOCS]
    tokens = [(i, brute.words(t) + [None]) for i, t in named]
    assert sorted(r["n_tokens"] for r in got) == sorted(len(w) for _, w in tokens)
    whole = {r["doc_id"]: r for r in rows(lm.lm_scores(docs, min_state=1e-3, min_arc=1e-3))}
    for r in got:      # cutting a long text into blocks changes nothing
        if r["doc_id"] == 7:
            assert r["score"] == pytest.approx(whole[7]["score"], rel=1e-9) and r["base_score"] == pytest.approx(whole[7]["base_score"], rel=1e-9)
    assert rows(lm.lm_scores(nothing)) == []


def test_lm_equals_a_plain_backoff_model(spark):
    """All n-grams seen twice are arcs, also rare ones of a larger corpus and those of other blocks."""
    rng = np.random.default_rng(2)
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1]
    free = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 != 1]
    filler = [f"f{i}" for i in range(3000)]
    texts = [(free[i], " ".join(rng.choice(filler, 1000))) for i in range(300)]
    texts += [(free[300 + i], "some quartz lantern glows") for i in range(2)] + [(held[0], "quartz lantern glows"), (held[1], "lantern f1 quartz")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(lm.lm_scores(df, block_tokens=20_000))}
    tokens = {i: [*brute.words(t), None] for i, t in texts}
    counts = [Counter() for _ in range(4)]
    for i in free:
        w = [None, *tokens.get(i, [])]
        for n in (1, 2, 3):
            counts[n].update(tuple(w[k - n + 1:k + 1]) for k in range(1, len(w)) if k - n + 1 >= 0)
    total, arcs = sum(counts[1].values()), {}
    for n in (2, 3):
        for g, c in counts[n].items():
            if c >= 2:
                arcs.setdefault(g[:-1], {})[g[-1]] = (c - 0.75) / counts[n - 1][g[:-1]]

    def chance(context, word):
        if not context:
            return (counts[1][word,] + 0.5) / (total + 0.5 * (len(counts[1]) + 1))
        own = arcs.get(context, {})
        return own.get(word, 0.0) + (1 - sum(own.values())) * chance(context[1:], word)

    for i in [*held[:2], free[300], free[0]]:
        w = [None, *tokens[i]]
        want = sum(math.log10(max(chance(tuple(w[max(0, k - 2):k]), w[k]), 1e-12)) for k in range(1, len(w)))
        assert got[i]["score"] == pytest.approx(want, rel=1e-6)
    assert got[held[0]]["score"] > got[held[0]]["base_score"] + 5


def test_more_arcs_than_words(spark):
    """Few words in all orders: a block has far more bigram arcs than words."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice(list("abcdefghij"), 400))) for i in range(40)]
    got = rows(lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string")))
    assert len(got) == 40 and all(math.isfinite(r["score"]) for r in got)
    whole = {r["doc_id"]: r["score"] for r in got}
    for r in rows(lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string"), block_tokens=900)):
        assert r["score"] == pytest.approx(whole[r["doc_id"]], rel=1e-9)


def test_automaton_sums_to_one():
    words = np.sort(np.array([lm.END.view(np.int64), 11, 22, 33]))
    auto = lm.Automaton(words, np.array([5.0, 9.0, 4.0, 2.0]))
    a, b = 0, 1
    auto.arcs.append(np.array([a * 4 + b, b * 4 + a]))
    auto.counts.append(np.array([4.0, 3.0]))
    s = lm.Scorer(auto, total=25, distinct=6, discount=0.75)
    uni = (np.array([5, 9, 4, 2, 3, 2]) + 0.5) / s.norm
    rest = 0.5 / s.norm
    assert uni.sum() + rest == pytest.approx(1)
    gain, left = s.gain[0][0], 10 ** s.fail[0][a]
    assert gain + left == pytest.approx(1)


def test_personal_data(docs, nothing):
    got = rows(pii.personal_spans(docs))
    assert len(got) == len(DOCS)
    spans = {r["doc_id"]: [f"{pii.KINDS[x['k']]}:{x['start']}:{x['end']}" for x in r["base"]] for r in got}
    assert all(spans[i] == brute.personal(t) for i, t in DOCS if i is not None) and len(spans[11]) == 4
    assert rows(pii.personal_spans(nothing)) == []


def test_contexts_find_unseen_identifiers(spark):
    seen = [(i, f"{'abcdefghij'[i]} filler text. staff contact: u{i}x@site.org thanks a lot") for i in range(8)]
    new = [(100, "more text. staff contact: user42_site thanks"), (101, "nothing like that: user42_site here")]
    got = {r["doc_id"]: [(x["k"], x["start"], x["end"]) for x in r["spans"]]
           for r in rows(pii.personal_spans(spark.createDataFrame(seen + new, "doc_id long, text string")))}
    at = new[0][1].index("user42_site")
    assert got[100] == [(0, at, at + 11)] and got[101] == [] and len(got[0]) == 1


def test_discovered_identifiers_back_new_contexts(spark):
    seen = [(i, f"{'abcdefghij'[i]} filler text. staff contact: u{i}x@site.org thanks a lot") for i in range(8)]
    first = [(20 + i, f"{'klm'[i]} filler text. staff contact: member{i}_site thanks") for i in range(3)]
    second = [(30 + i, f"{'nop'[i % 3]} filler text. reach desk: member{i % 3}_site today") for i in range(9)]
    new = [(100, "other text. reach desk: guest7_site today"), (101, "other text. no desk guest7_site today")]
    got = {r["doc_id"]: [(x["k"], x["start"], x["end"]) for x in r["spans"]]
           for r in rows(pii.personal_spans(spark.createDataFrame(seen + first + second + new, "doc_id long, text string")))}
    at = new[0][1].index("guest7_site")
    assert got[100] == [(0, at, at + 11)] and got[101] == []
    assert all(len(got[i]) == 1 for i in [*range(8), *range(20, 23), *range(30, 39)])


def test_identifiers_of_several_words_and_any_length():
    def found(text):
        return [text[s:e] for k, s, e in pii.mentions(text, pii.base_spans(text)) if k < 0]

    assert found("call (020) 7946 0958, or (555) 123-4567. Ref: 7 x9 12\n34") == ["(020) 7946 0958", "(555) 123-4567", "7", "x9", "12", "34"]
    assert found("id: " + "a1" * 50 + " (see 42) [1] 5, 6 (020 7946 0958)") == ["a1" * 50, "42", "[1] 5", "6", "020 7946 0958"]
    assert found("no identifier here") == []


def test_contexts_find_numbers_with_spaces(spark):
    seen = [(i, f"{'abcdefghij'[i]} filler. staff phone: +44 20 7946 {1000 + i} thanks") for i in range(8)]
    new = [(100, "more text. staff phone: 020 7946 0958 thanks"), (101, "more text. staff phone: (555) 123-4567"), (102, "more. staff phone: " + "7" * 70)]
    got = {r["doc_id"]: [(x["k"], x["start"], x["end"]) for x in r["spans"]]
           for r in rows(pii.personal_spans(spark.createDataFrame(seen + new, "doc_id long, text string")))}
    for i, text in new:
        whole = {100: "020 7946 0958", 101: "(555) 123-4567", 102: "7" * 70}[i]
        assert got[i] == [(3, text.index(whole), text.index(whole) + len(whole))]


def test_base_patterns_match_plain_search():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.sampled_from(["a", "@", ".", "-", "é", " ", "\n", "+", "1", "23", "255", "256", "(", "4111111111111111", "b@c.d", "%_"]), max_size=24).map("".join))
    def check(text):
        assert [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(text)] == brute.personal(text)

    check()


def test_decontaminate(spark, docs, nothing):
    items = [(1, A), (2, None), (3, ""), (4, "too short"), (5, LONG[:200]), (5, LONG[:200])]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = rows(dc.benchmark_matches(docs, items))
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 1), (7, 5), (7, 5), (10, 1)]
    assert {r["doc_id"]: r["distance"] for r in got if r["item_id"] == 1}[3] == 1
    left = rows(dc.decontaminate(docs, items))
    assert len(left) == len(DOCS) - 6 and list(left[0]) == docs.columns
    assert rows(dc.benchmark_matches(nothing, items)) == [] and rows(dc.benchmark_matches(docs, items.limit(0))) == []


def test_lsh_recall_at_the_limit():
    """Items with as many random word edits as the limit allows, inside other text."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"v{i}" for i in range(4000)])
    items, texts = [], []
    for i in range(300):
        words = list(rng.choice(vocabulary, rng.integers(15, 60)))
        items.append((i, " ".join(words).encode()))
        for _ in range(int(0.2 * len(words))):
            at, kind = int(rng.integers(len(words))), rng.integers(3)
            words[at:at + (kind != 1)] = [] if kind == 2 else [str(rng.choice(vocabulary))]
        texts.append(" ".join([*rng.choice(vocabulary, 50), *words, *rng.choice(vocabulary, 50)]).encode())
    keys = dc.ItemKeys(items, 0.8, 8)
    raw = b"".join(texts)
    _, _, _, h, first = dc.tb.words(np.frombuffer(raw, np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    found = {(t, r) for t, r, *_ in keys.matches(h, first)}
    assert sum((i, i) in found for i in range(300)) / 300 >= 0.95 and all(t == r for t, r in found)


@pytest.mark.parametrize("n", [*range(1, 17), 20, 29, 40, 60, 120])
def test_recall_in_every_length_class(n):
    """Verbatim copies and copies with as many edits as allowed, inside other text."""
    rng = np.random.default_rng(n)
    vocabulary = np.array([f"v{i}" for i in range(200_000)])
    items, texts, limit = [], [], int(0.2 * n + 1e-9)
    for i in range(60):
        words = list(rng.choice(vocabulary, n))
        items.append((i, " ".join(words).encode()))
        for _ in range(limit if i % 2 else 0):
            at, kind = int(rng.integers(len(words))), rng.integers(3)
            words[at:at + (kind != 1)] = [] if kind == 2 else [str(rng.choice(vocabulary))]
        texts.append(" ".join([*rng.choice(vocabulary, 50), *words, *rng.choice(vocabulary, 50)]).encode())
    keys = dc.ItemKeys(items, 0.8, dc.MIN_WORDS)
    _, _, _, h, first = dc.tb.words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    found = {(t, r) for t, r, *_ in keys.matches(h, first)}
    assert all((i, i) in found for i in range(60))


def test_semi_global_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(0, 30))
        distance, start, end = dc.semi_global(item, text)
        assert distance == brute.edit_distance(list(item), list(text)) and 0 <= start <= end <= len(text)


def test_vectors_of_any_size(spark):
    """Vectors whose square leaves the range of doubles are compared like all others."""
    data = [(1, [1e-200, 0.0]), (2, [1e-200, 0.0]), (3, [1e200, 0.0]), (4, [2e200, 1e199]), (5, [0.0, 5e-324]), (6, [0.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame([(i, 1, v) for i, v in data], "vec_id long, label long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(vj.vector_links(df))}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (0, 6), 7: (1, 5)}


def test_language_columns_of_any_name(spark):
    names = ["__lang", "__posterior", "__host", "__declared", "__top", "column_0"]
    df = spark.createDataFrame([(i, f"the cat sat on the mat and it was number {i} of them all", "en", "a.example", "kept") for i in range(30)],
                               "doc_id long, text string, lang string, source string, extra string")
    plain = {r["doc_id"] for r in rows(li.keep_identified(df))}
    more = li.keep_identified(df.select("*", *[F.col("extra").alias(n) for n in names]))
    assert more.columns == [*df.columns, *names]
    got = rows(more)
    assert {r["doc_id"] for r in got} == plain and all(r[n] == "kept" for r in got for n in names)


def test_entropy_out_of_reach_is_an_error(spark):
    df = spark.createDataFrame([("a", 100), ("b", 90), ("c", 80)], "source string, size long")
    totals = df.withColumn("share", F.col("size") / 270.0)
    with pytest.raises(ValueError):
        mx.find_exponent(totals, "entropy", 0.1)


def test_vectors(spark):
    near = [0.1, 0.2, 0.3]
    data = [(1, near, 0), (2, near, 0), (3, [0.1, 0.2, 0.31], 0), (4, near, 1), (5, near, None), (6, None, 0), (7, [0.0] * 3, 0),
            (8, [float("nan"), 1.0, 2.0], 0), (9, [None, 1.0, 2.0], 0), (10, [float("inf"), 0.0, 0.0], 0), (11, [], 0),
            (12, [1.0, 0.0], 0), (13, [-0.1, -0.2, -0.3], 0), (14, [10.0, 20.0, 30.0], 0), (15, [1e-30, 2e-30, 3e-30], 0)]
    df = spark.createDataFrame([(i, v, x, "q", "q", "q") for i, v, x in data],
                               "vec_id long, embedding array<float>, label int, id string, vec string, weight string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(vj.vector_links(df))}
    assert got == brute.vector_links([(i, v and [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x in data])
    assert rows(vj.vector_links(df.limit(0))) == []
    again = rows(vj.vector_links(df.union(df.where("vec_id = 1")).withColumn("vec_id", F.when(F.col("vec_id") != 4, F.col("vec_id")))))
    assert sum(r["vec_id"] is None and r["component_id"] is None and r["kept"] for r in again) == 1


def test_language(spark, docs, nothing):
    extra = spark.read.parquet(f"{brute.SF}/documents.parquet")
    all_docs = extra.unionByName(docs.select(extra.columns))
    got = rows(li.identify(spark, all_docs))
    assert len(got) == all_docs.count()
    assert all(not r["accepted"] and r["lang"] == "und" for r in got if r["doc_id"] in (4, 5, 6) and r["posterior"] is not None
               and r["text_lang"] == "und")
    kept = rows(li.keep_identified(all_docs))
    assert list(kept[0]) == extra.columns and sum(r["accepted"] for r in got) == len(kept)
    assert rows(li.identify(spark, nothing, nothing.selectExpr("doc_id as page_id", "text as url", "text as html"))) == []
    none = rows(li.identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))))
    assert len(none) == len(DOCS) and not any(r["accepted"] for r in none)
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.example.com/x", "<html lang='fr'><p>"), (3, "", "")], "page_id long, url string, html string")
    assert len(rows(li.identify(spark, extra, pages))) == extra.count() + 3


def test_declared_language_and_host_decide_what_text_cannot(spark):
    extra = spark.read.parquet(f"{brute.SF}/documents.parquet")
    pages = spark.createDataFrame([(i, "http://x.example.de/p", "<html lang='de'><body></body></html>" if i < 3 else "<html lang='de'>a</html>")
                                   for i in range(6)], "page_id long, url string, html string")
    got = [r for r in rows(li.identify(spark, extra, pages)) if r["kind"] == "page"]
    assert [r["accepted"] for r in sorted(got, key=lambda r: r["page_id"])][:3] == [False] * 3


def test_mixing(spark, docs, nothing):
    sized = mx.sized(docs)
    plan = mx.mixing_plan(sized)
    got = rows(mx.mixture(sized, plan))
    assert {r["id"] for r in got} == {i for i, _ in DOCS}
    assert rows(mx.mixture(mx.sized(nothing), mx.mixing_plan(mx.sized(nothing)))) == [] and rows(mx.mix(nothing)) == []
    assert mx.mix(docs).columns == docs.columns


@pytest.mark.parametrize("target,value", [("repetition", 1.5), ("entropy", 1.0)])
def test_exponent(spark, target, value):
    sizes = {"a": 900, "b": 90, "c": 10}
    data = [(i, s, 1) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "id long, source string, tokens long")
    a = mx.find_exponent(mx.source_totals(df), target, value, highest=4.0)
    p = np.array([0.9, 0.09, 0.01])
    w = p ** a / (p ** a).sum()
    reached = (w / p).max() / (w / p).min() if target == "repetition" else -(w * np.log(w)).sum()
    assert reached == pytest.approx(value, abs=1e-6)
    a = mx.find_exponent(mx.source_totals(df), target, value, budget=500.0, total=1000.0, highest=4.0)
    w = p ** a / (p ** a).sum()
    budgeted = rows(mx.mixture(df, mx.mixing_plan(df, target, value, budget=500.0, highest=4.0)))
    counts = {s: sum(r["source"] == s for r in budgeted) for s in sizes}
    assert all(abs(counts[s] - 500 * w[i]) <= 1 for i, s in enumerate(sizes))


def test_secrets(spark, docs, nothing):
    assert rows(sc.scan(nothing)) == []
    assert all(r["secret"] in (True, False) for r in rows(sc.scan(docs)))


def test_forest_removes_false_positives(spark):
    """Held-out accuracy: half of the labelled findings train, the other half is judged."""
    rng = np.random.default_rng(3)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    texts, truth = [], {}
    for i in range(240):
        if i % 2:
            value, text = hexa(32), "token = "
        else:
            value, text = f"{rng.choice(['chapter', 'section', 'version'])}-{rng.choice(['seven', 'eleven', 'draft'])}-{int(rng.integers(10, 9999))}", "see the "
        truth[value] = i % 2
        texts.append((i, f"some words before {text}{value} and more after", "src"))
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    known = spark.createDataFrame([(v, t) for k, (v, t) in enumerate(truth.items()) if k % 4 < 2], "value string, label int")
    got = [r for r in rows(sc.scan(df, labels=known)) if r["label"] is None]
    assert len(got) > 100 and np.mean([r["secret"] == bool(truth[r["value"]]) for r in got]) > 0.95


def test_rare_secrets_train_beside_many_harmless_values(spark, monkeypatch):
    monkeypatch.setattr(sc, "SAMPLE", 40)
    rng = np.random.default_rng(4)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    texts = [(i, f"see 2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}T{i:05d}Z there", "src") for i in range(3000)]
    secrets = [(3000 + i, f"the password = {hexa(32)} is set", "src") for i in range(5)]
    got = rows(sc.scan(spark.createDataFrame(texts + secrets, "doc_id long, text string, source string")))
    assert len(got) == 3005 and all(r["secret"] == (r["doc_id"] >= 3000) for r in got)


def test_kept_and_mixed_columns_of_any_name(spark):
    names = ["kept_id", "KEPT_ID_", "mixed_id", "mixed_copies", "__kept_id", "__mixed_id"]
    df = spark.createDataFrame([(i, f"text {i} of many with some words {i * 7} more {i * 3}", "a" if i % 3 else "b") for i in range(12)],
                               "doc_id long, text string, source string")
    more = df.select("*", *[F.lit(n).alias(n) for n in names])
    for result in (nd.keep_one(more), mx.mix(more)):
        assert result.columns == [*df.columns, *names]
        got = rows(result)
        assert {r["doc_id"] for r in got} == set(range(12)) and all(r[n] == n for r in got for n in names)


def test_different_texts_of_one_id_stay(spark):
    data = [(1, A), (1, "quite another text that no other document has"), (1, A), (2, B), (3, None), (3, ""), (3, None)]
    for parts in (1, 5):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(parts)
        got = rows(nd.keep_one(df))
        assert sorted((r["doc_id"], r["text"] or "", r["text"] is None) for r in got if r["doc_id"] != 2) == sorted(
            [(1, A, False), (1, data[1][1], False), (3, "", True), (3, "", False)])


def test_hot_keys_are_few_and_dealt(spark):
    """Keys with two of ``share`` rows are found, those with less than one are not; the salted join equals a plain one."""
    data = [(k, -k, i) for k, n in ((1, 900), (2, 300), (3, 40), (4, 3)) for i in range(n)] + [(100 + i, i, i) for i in range(500)]
    hashed = spark.createDataFrame(data, "hi long, lo long, id long").repartition(7)
    hot = {r["khi"]: r["parts"] for r in rows(ld.hot_keys(hashed, 16))}
    assert {1, 2} <= set(hot) <= {1, 2} and hot[1] > hot[2] > 1
    keys = spark.createDataFrame([(1, -1, 899), (2, -2, 10), (4, -4, 2), (9, 9, 9)], "hi long, lo long, top long")
    got = [(r["id"], r["key"]) for r in rows(ld.doomed_lines(hashed, keys))]
    name = lambda hi: f"{hi:016X}{(1 << 64) - hi:016X}"
    assert sorted(got) == sorted([(i, name(1)) for i in range(899)] + [(i, name(2)) for i in range(10)] + [(i, name(4)) for i in range(2)])


def test_values_behind_credential_names(spark):
    texts = ["the password=hunter here", "password: swordfish now", "api_key = abc and", "'token' => zz9", "passwd := q", "no password here", "token = = x",
             "secret:", "a token : ", None]
    df = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {(r["id"], r["value"]) for r in rows(sc.findings(df))}
    assert {(0, "hunter"), (1, "swordfish"), (2, "abc"), (3, "zz9"), (4, "q")} <= got
    assert not {i for i, _ in got} & {5, 7, 8, 9}


def test_secrets_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(6)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    values = [hexa(32) for _ in range(40)]
    texts = [(i, f"{'token =' if i % 3 else 'see the'} {values[i % 40]} and 2024-01-{i % 28 + 1:02d}T{i:05d} go", f"src{i % 4}") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    one, other = ({(r["doc_id"], r["word_index"]): (r["label"], r["probability"]) for r in rows(sc.scan(df.repartition(n)))} for n in (1, 7))
    assert one == other
