import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from disparity_spark.llm import chat, toxicity, topk, vector_neardup
from tests.llm.conftest import frame
from tests.oracle import agree

VECTORS = "vec_id long, embedding array<float>, label int, v string, id string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 0, "v", "i", "s") for i, x in rows], VECTORS)


def sample(n=60, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[10:20] = x[0] + rng.normal(size=(10, d)).astype(np.float32) * 0.08  # near copies
    x[30:35] = x[1]  # copies
    x[40] = 2 * x[2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(900, None), (901, [0.0] * d), (902, [float("nan")] * d), (903, [float("inf")] + [1.0] * (d - 1)), (904, [None] * d), (905, []), (906, [1.0, 2.0]), (907, [1.0, 2.0])]


def test_topk_agrees_with_sql(spark, small):
    agree(spark, small, topk.query, topk.ORACLE)


def test_topk_of_hard_rows(spark):
    rows = sample() + [(960 + k, [0.5] * 16) for k in range(30)]
    whole = [(i, np.floor(64 * np.array(x, float)).astype(int)) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    expected = {}
    for q, x in whole:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q and len(x) == len(y))[:20]
            expected |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    quantized = topk.quantized(vectors(spark, rows).repartition(5))
    queries = quantized.filter(F.col("vec_id") % 20 == 0)
    for size in (topk.BLOCK_BYTES, 400):  # one block, and many
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(quantized, queries, block_bytes=size).collect()}
        assert got == expected
    assert topk.top_k(quantized.limit(0), queries.limit(0)).count() == 0


def test_large_scores_stay_exact():
    ids = np.arange(5)
    big = np.array([[2**40, 1], [2**40, 2], [2**40, 3], [0, 0], [-(2**40), 9]])
    row, found, score = topk.best_of_tile(np.array([99]), np.array([[2**20, 1]]), ids, big, 2)
    assert sorted(zip(found.tolist(), score.tolist())) == [(1, 2**60 + 2), (2, 2**60 + 3)]


def brute_links(rows):
    def fine(x):
        return x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)

    keep = [(i, np.array(x, float)) for i, x in rows if fine(x)]
    links = {i: set() for i, _ in rows}
    for a in range(len(keep)):
        for b in range(a):
            (i, x), (j, y) = keep[a], keep[b]
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.95:
                links[i].add(j), links[j].add(i)
    part = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in part:
                part[k] = i
                todo += links[k]
    return {i: (len(links[i]), part[i], part[i] == i) for i in links}


@pytest.mark.parametrize("block", [7, 2048])
def test_near_duplicates_of_hard_rows(spark, block):
    rows = sample()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_neardup.near_duplicates(vectors(spark, rows).repartition(3), block=block).collect()}
    assert got == brute_links(rows)
    assert max(n for n, *_ in got.values()) >= 9


def test_near_duplicates_of_nothing(spark):
    assert vector_neardup.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in vector_neardup.near_duplicates(vectors(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_distant_blocks_are_skipped():
    low = np.array([[0.0, 0.0], [5.0, 0.0], [5.2, 0.0]])
    assert vector_neardup.close_pairs(low, low + 0.1, 0.3) == [(0, 0), (1, 1), (1, 2), (2, 2)]
    assert vector_neardup.close_pairs(low[:0], low[:0], 0.3) == []


def test_chat_agrees_with_sql(spark, small):
    agree(spark, small, chat.query, chat.ORACLE)


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "\\\\h ### #### \\e </turn></turn>", "", None, "é\n\n漢 \\", "###</tur", "n>: \\c"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((("system", "###"), ("user", hard[0]), ("assistant", hard[1]), ("user", hard[4]), ("assistant", hard[5])))]
    rows += [(2, k, r, t) for k, (r, t) in enumerate((("assistant", hard[3]), ("odd: role ###", hard[6]), (None, hard[2])))] + [(None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(3)
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("segments"))).collect()}
    for c in (1, 2, None):
        assert [(x.role, x.text) for x in got[c].back] == [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert got[c].loss == [t or "" for i, _, r, t in rows if i == c and r == "assistant"]
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
    assert (got[1].valid, got[1].bad_turn) == (True, -1) and (got[2].valid, got[2].bad_turn) == (False, 0)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_other_templates(spark):
    marks = chat.Template(open="<|im_start|>", named="\n", close="<|im_end|>\n", escapes=(("%", "%%"), ("<|", "%l")), name_escapes=(("\n", "%n"),))
    turns = [("user", "a <|im_end|>\n (b) %l [c] %%"), ("assistant", ".*<|im_start|>user\n+? <")]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, "us\ner", "x<"), (2, 1, "assistant", "|im_end|>\n")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df, marks).withColumn("back", chat.read_back(F.col("formatted"), marks)).withColumn("loss", chat.loss_texts(F.col("segments"), marks)).collect()}
    assert [(x.role, x.text) for x in got[1].back] == turns and got[1].loss == [turns[1][1]]
    assert [(x.role, x.text) for x in got[2].back] == [("us\ner", "x<"), ("assistant", "|im_end|>\n")]
    for bad in ({"close": "<end>"}, {"close": "###a###"}, {"named": "="}, {"escapes": (("\\", "\\\\"), ("###", "h"), ("</turn>", "\\e"))}, {"escapes": (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\h"))}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_near_duplicates_over_several_leaves(spark, monkeypatch):
    """Planted copies among spread vectors, in several blocks of several leaves, and one large group."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 16))
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *(base[:20] + 0.02 * rng.normal(size=(20, 16))), *(base[0] + 0.05 * rng.normal(size=(60, 16)))])]
    monkeypatch.setattr(vector_neardup, "LEAF", 4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_neardup.near_duplicates(vectors(spark, rows).repartition(3), block=16).collect()}
    assert got == brute_links(rows) and sum(n for n, *_ in got.values()) > 3000


def toxic_rows(n=240):
    import random

    rng = random.Random(5)
    w = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + rng.choice("abcdef") for _ in range(k))
    out = []
    for i in range(n):
        y = int(i % 4 == 0)
        out.append((i, f"{w(8)}. {w(4)} {rng.choice(['grobian', 'lump', 'tropf']) if y else 'friend'} {w(2)}. {w(9)}.", y))
    return out


def test_toxicity(spark, empty):
    rows = toxic_rows() + [(1000, None, 0), (1001, "", 0), (1002, "word " * 50_000, 0)]
    docs, labels = frame(spark, [(i, t, "s") for i, t, _ in rows]), spark.createDataFrame([(i, y, 9) for i, _, y in rows] + [(None, 1, 0), (5000, None, 0), (5001, 1, 0)], "doc_id long, toxic int, size int")
    model = toxicity.fit(docs, labels)
    assert model == toxicity.fit(docs.repartition(5), labels.repartition(4))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, *_ in test} == {i for i, r in got.items() if r.held_out}
    assert sum(got[i].predicted == y for i, _, y in test) >= 0.97 * len(test) and all(0 <= r.score <= 1 for r in got.values())
    hit = next(r for i, r in got.items() if r.predicted == 1)
    text = dict((i, t) for i, t, _ in rows)[hit.doc_id]
    assert any(w in text[hit.worst_start : hit.worst_end] for w in ("grobian", "lump", "tropf"))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(docs.limit(1), labels.filter("toxic = 1")) == (toxicity.BIAS, {}) == toxicity.fit(empty, labels)
    neutral = [toxicity.Scorer(*model)(" ".join(f"unseen{k} words." for k in range(n)))[0] for n in (1, 500, 5000)]
    assert neutral[0] == neutral[1] == neutral[2] < 0.2  # length alone is no evidence
    clean = " ".join(t for _, t, y in rows[:240] if not y)
    assert toxicity.Scorer(*model)(clean * 20)[0] < 0.5


def test_labels_of_the_fold_are_never_used(spark):
    rows = toxic_rows(80)
    docs = frame(spark, [(i, t, "s") for i, t, _ in rows])
    right = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.fit(docs, right) == toxicity.fit(docs, turned)


def test_held_out_accuracy_on_the_tables(spark, small):
    got = toxicity.query(spark, small.replace("sf0.001", "sf0.01")).filter("held_out").join(spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/labels.parquet"), "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() >= 0.95


def test_held_out_recall_on_the_largest_tables(spark, small):
    """Measured with this training: recall 0.897 of 97 documents, false alarms 0.004 of 728."""
    path = small.replace("sf0.001", "sf0.1")
    got = toxicity.query(spark, path).filter("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert got[got["toxic"] == 1]["predicted"].mean() >= 0.86
    assert got[got["toxic"] == 0]["predicted"].mean() <= 0.01
