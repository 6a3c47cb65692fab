"""Exact dedup, spelling variants and hard negatives against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import exact_dedup, hard_negatives, spelling

INF, NAN = float("inf"), float("nan")


# exact dedup ---------------------------------------------------------------------------

DOCS = "doc_id long, text string, digest string, n long, keep_id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in rows], DOCS)


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, seen = hashlib.sha256(text.encode()).digest(), set()
        for i in ids:
            out.append((i, keep, len(ids), i == keep and i not in seen, sha))
            seen.add(i)
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_every_row_learns_who_stays(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(60)}") for i in range(300)] + [(1000 + i, "hot copy") for i in range(150)]
    rows += [(None, None), (None, ""), (5000, ""), (5001, "x" * 300_000), (5002, "x" * 300_000), (5002, "x" * 300_000), (None, "alone"), (None, "alone"), (6000, "Ä\u0000 "), (6001, "ä\u0000 ")]
    for batches in (1, 2, 5):
        got = exact_dedup.deduplicate(documents(spark, rows), batches=batches).collect()
        assert ordered((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == ordered(plain_groups(rows))
    assert exact_dedup.deduplicate(documents(spark, []), batches=2).count() == 0


def test_hot_digests_are_spread(spark, monkeypatch):
    monkeypatch.setattr("marketloom.llm.skew.LEAST", 20)
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(900)]
    got = exact_dedup.deduplicate(documents(spark, rows)).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == ordered(plain_groups(rows))


def test_index_outlives_the_session_object(spark, tmp_path):
    """New rows meet what earlier batches left, also after reopening and after compaction."""
    path = str(tmp_path / "index")
    first = [(1, "a"), (2, "a"), (3, None), (4, "b"), (4, "b")]
    index = exact_dedup.DigestIndex(spark, path, buckets=4)
    kept = exact_dedup.unseen(documents(spark, first), index)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert ordered((r.doc_id, r.text, r.digest, r.n) for r in kept.collect()) == ordered([(2, "a", "clash", 7), (3, None, "clash", 7), (4, "b", "clash", 7)])
    again = exact_dedup.DigestIndex(spark, path, buckets=99)
    assert again.buckets == 4 and again.entries().count() == 3
    second = [(10, ""), (11, "c"), (12, "b"), (None, "d")]
    assert sorted(r.text for r in exact_dedup.unseen(documents(spark, second), again).collect()) == ["c", "d"]
    assert exact_dedup.unseen(documents(spark, second), again).count() == 0
    again.compact(buckets=2)
    last = exact_dedup.DigestIndex(spark, path)
    assert last.buckets == 2 and last.entries().count() == 5
    assert exact_dedup.unseen(documents(spark, first + second + [(20, "e")]), last).count() == 1


def test_index_side_of_the_anti_join_is_not_shuffled(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    pairs = exact_dedup._digests(documents(spark, [(i, f"t{i}") for i in range(50)]), "doc_id", "text")
    index.add(pairs, "doc_id")
    new = pairs.groupBy("digest").count().join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    right = plan[plan.index("SortMergeJoin"):].split("Sort [digest")[-1]
    assert "Bucketed: true" in right and "Exchange" not in right


# spelling ------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows, noise=199, least=6):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def plain_variants(counts, factor=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_words_are_counted_over_whole_texts(spark):
    rng = random.Random(5)
    letters = "abcdeZÀéÿ×"
    rows = [(rng.choice([None, i]), " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(rng.randrange(60))) + rng.choice([".", "1x", "łabcdef"])) for i in range(120)]
    rows += [(7, None), (8, ""), (9, "longest" * 30_000), (9, "longest" * 30_000), (10, "Straßen " * 4000)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string")
    for noise in (199, 3):
        got = {r.word: r.n for r in spelling.count_words(frame, noise=noise).collect()}
        assert got == plain_words(rows, noise)
    assert spelling.count_words(frame.limit(0)).count() == 0


@pytest.mark.parametrize("least", [1000, 3])
def test_variants_match_all_pairs(spark, monkeypatch, least):
    """Words of few letters, so that bigrams repeat and many words are one edit apart; with ``least`` 3 nearly all keys are spread."""
    monkeypatch.setattr("marketloom.llm.skew.LEAST", least)
    rng = random.Random(11)
    counts = {}
    for _ in range(350):
        word = "".join(rng.choice("abé" if rng.random() < 0.5 else "abcdefghÿ") for _ in range(rng.randrange(6, 10)))
        counts[word] = rng.choice([5, 6, 30, 31, 160, 900])
        at = rng.randrange(len(word))
        edited = rng.choice([word[:at] + word[at + 1 :], word[:at] + "a" + word[at:], word[:at] + "é" + word[at + 1 :]])
        if len(edited) >= 6:
            counts.setdefault(edited, rng.choice([5, 30, 5000]))
    counts |= {"a" * n: 5**(n - 4) for n in range(6, 12)}  # a chain of forms, one bigram over and over
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.group_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(counts)


def test_no_words_no_variants(spark):
    frame = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(frame).count() == 0
    alone = spark.createDataFrame([("single", 9)], "word string, n long")
    assert [tuple(r) for r in spelling.group_variants(alone).collect()] == [("single", None, "single", 9, 0, None)]


# hard negatives ------------------------------------------------------------------------


def plain_negatives(rows, every=10, positives=5, negatives=3, share=(50, 95)):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            item = (label, [int(np.floor(256 * x)) for x in v])
            good[i] = min(good.get(i, item), item)
    out = set()
    for a, (own, av) in good.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(av, v)) for i, (_, v) in good.items() if i != a and len(v) == len(av)}
        best = sorted((i for i in score if good[i][0] == own), key=lambda i: (-score[i], i))[:positives]
        for p in best:
            fits = [i for i in score if good[i][0] != own and share[0] * score[p] <= 100 * score[i] <= share[1] * score[p]]
            for r, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:negatives], 1):
                out.add((a, p, r, i, score[p], score[i]))
    return out


def mined(frame, **more):
    got = hard_negatives.mine(frame, F.col("id") % 10 == 0, F.col("label"), **more).collect()
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}


NEGATIVES = "vec_id long, embedding array<float>, label long, id long, anchor string"


def test_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(400, 12)).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(data)]
    rows += [(400 + i, data[10].tolist(), int(i % 2)) for i in range(130)]  # one vector with two labels
    rows += [(600 + i, [0.5] * 7, i % 2) for i in range(20)] + [(700 + i, [float(i % 3), -1.0], i % 2) for i in range(30)]  # ties, other lengths
    rows += [(800, None, 1), (801, [0.0] * 12, 1), (802, [NAN] * 12, 1), (810, [None] + [1.0] * 11, 1), (811, [], 1), (812, [1.0] * 12, None), (None, [1.0] * 12, 1), (813, [-INF] * 12, 0), (820, [3.0] * 5, 0), rows[5], rows[6]]
    rows += [(9, [2.0] * 12, 0)]  # an id with two vectors
    frame = spark.createDataFrame([(i, v, y, 1, "clash") for i, v, y in rows], NEGATIVES)
    want = plain_negatives(rows)
    assert len(want) > 100
    assert mined(frame) == want
    monkeypatch.setattr(hard_negatives, "GROUP", 7)  # many small tasks, the same rows
    monkeypatch.setattr(hard_negatives, "STRIPE", 1)
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    assert mined(frame) == want
    assert mined(frame, positives=2, negatives=1, share=(20, 90)) == plain_negatives(rows, positives=2, negatives=1, share=(20, 90))


def test_few_and_no_rows(spark):
    empty = spark.createDataFrame([], NEGATIVES)
    assert mined(empty) == set()
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.5], 2)]
    assert mined(spark.createDataFrame([(i, v, y, 1, "c") for i, v, y in rows], NEGATIVES)) == plain_negatives(rows)
    assert mined(spark.createDataFrame([(0, [1.0], 1, 1, "c")], NEGATIVES)) == set()
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [3e9], 1, 1, "c")], NEGATIVES))


def test_bounds_hold_and_rule_rows_out(spark):
    """Bounds enclose every exact score, and most rows need none."""
    rng = np.random.default_rng(4)
    q = np.floor(256 * rng.normal(size=(3000, 16))).astype(np.int64)
    frame = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(q)], "id long, label long, vector array<long>")
    edges = hard_negatives.cell_edges(frame)
    low, high = edges[16]
    rows = hard_negatives.approximation_file(frame, edges).collect()
    ids = [i for r in rows for i in r.ids]
    cells = np.concatenate([np.frombuffer(bytes(r.cells), np.uint8).reshape(-1, 16) for r in rows]) + np.arange(16) * hard_negatives.CELLS
    for anchor in q[:20]:
        a, b = hard_negatives._bounds(cells, hard_negatives._tables(anchor, low, high))
        exact = q[ids] @ anchor
        assert (a <= exact).all() and (exact <= b).all()
        assert hard_negatives._reaching(a, b, 5).sum() < 300
