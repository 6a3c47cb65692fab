"""Cases that earlier versions of search, packing and surrogates got wrong."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import ann, chat, packing, pii
from marketloom.llm.queries import tokenizer_path


def found(spark, rows, every=50, **more):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % every == 0, k=5, **more).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def exact(rows, q, k=5):
    good = dict(rows)
    own = np.array(good[q])
    score = {i: float(np.array(v) @ own / np.sqrt(np.array(v) @ np.array(v)) / np.sqrt(own @ own)) for i, v in good.items() if i != q and len(v) == len(own)}
    return sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]


def test_outliers_small_groups_and_other_lengths_get_all_their_rows(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=32)
    rows = [(i, (middle + 0.2 * rng.normal(size=32)).tolist()) for i in range(1, 2000) if i % 50]
    rows += [(0, (-middle).tolist())]  # opposite to all
    corner = rng.normal(size=32) * 3
    rows += [(2000 + i * 50, (corner - 2 * middle + 0.01 * rng.normal(size=32)).tolist()) for i in range(3)]
    rows += [(3000 + i * 50, rng.normal(size=7).tolist()) for i in range(4)] + [(4000, [1.0, 2.0])]
    got = found(spark, rows)
    for q in (0, 2000, 2050, 2100):
        assert len(got[q]) == 5
        assert len({i for i, _ in got[q]} & set(exact(rows, q))) >= 4, q
    for q in (3000, 3050, 3100, 3150):
        assert [i for i, _ in got[q]] == exact(rows, q)  # three candidates each
    assert 4000 not in got


def test_short_answers_are_made_whole(spark, monkeypatch):
    """Without any graph the exact scan answers."""
    monkeypatch.setattr(ann, "search", lambda queries, *_: queries.select("query", F.array("query").alias("nodes"), F.array(F.lit(1.0)).alias("scores")))
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(200 + i, [1.0] * 6) for i in range(20)]
    got = found(spark, rows, every=20)
    for q in (0, 20, 100, 200):
        assert [i for i, _ in got[q]] == exact(rows, q)


def test_recall_of_the_registered_setting(spark):
    rng = np.random.default_rng(12)
    data = rng.normal(size=(20_000, 64))
    centres = rng.normal(size=(40, 64))
    data[:6000] = centres[rng.integers(0, 40, 6000)] + 0.3 * data[:6000]  # clusters beside noise
    data[7000:7003] = 5 * rng.normal(size=64) + 0.01 * data[7000:7003]
    got = found(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 20_000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += len({i for i, _ in got[q]} & set(np.argsort(-score)[:5].tolist()))
        assert len(got[q]) == 5
    assert hits / 2000 >= 0.98, hits / 2000


SPACES = [" ", " ", "　", "\u0085", " ", "\t", "\n", "\r\n", " ", "  "]


def test_ids_do_not_depend_on_neighbours():
    """Columns of texts full of all kinds of white space: each text's ids are those it has alone."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(4)
    parts = SPACES * 2 + ["q", "end.", "x1", "é", "'s", "12", "!", "日本", "​", "<|endoftext|>"]
    texts = ["q.  ", "end.  \nx"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    at = 0
    while at < len(texts):  # columns of many lengths
        n = rng.choice([1, 2, 3, 50, 700])
        tokenizer = packing.ChunkTokenizer(tokenizer_path()) if rng.random() < 0.2 or at == 0 else tokenizer
        for first, end, ids, offsets in tokenizer.encode(pa.array(texts[at : at + n])):
            got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
            assert got == want[at + first : at + end]
        at += n


def test_packing_is_near_the_lower_bound(spark):
    """Equal lengths, ties and mixed ones: few more sequences than tokens ask for."""
    rng = random.Random(6)
    rows = [(i, " ".join(["tie"] * (40 if i % 3 else rng.randrange(1, 400)))) for i in range(1500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), capacity=512).collect()
    total, used = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert used <= 1.02 * -(-total // 512) + 1


TITLES = sorted(set(pii.FEMALE + pii.MALE + pii.NEUTRAL))


def test_every_title_may_be_a_given_name(spark):
    rows = [(i, f"Mr {t} Smith met her. Later {t} Smith left, and Mr {t} Smith stayed; {t} Smith wrote.") for i, t in enumerate(TITLES)]
    rows += [(100 + i, f"Mrs {t} {t} and Dr {t} Jones. {t} Jones and {t}.") for i, t in enumerate(TITLES)]
    frame = spark.createDataFrame([(*r, "Smith", 3) for r in rows], "doc_id long, text string, entity string, n int")
    got = {r.doc_id: r.text for r in pii.pseudonymise(frame, key="k").collect()}
    assert set(got) == {i for i, _ in rows}
    for text in got.values():
        assert "Smith" not in text and "Jones" not in text
    don = got[TITLES.index("Don")]
    name = re.match(r"Mr (\w+ \w+) met her", don)[1]
    assert don.count(name) == 4  # all four mentions are one person


def test_surrogates_stay_distinct_over_a_corpus(spark):
    rng = random.Random(2)
    mails = [f"u{i}@d{i % 7}.example.org" for i in range(300)]
    phones = [f"717-555-{i:04d}" for i in range(300)]
    rows = [(i, f"{mails[i]} or {rng.choice(mails)}, call {phones[i]}.") for i in range(300)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    new = {}
    for i, text in rows:
        for old, made in zip(re.findall(r"[\w.]+@[\w.]+\w|\d{3}-\d{3}-\d{4}", text), re.findall(r"[\w.]+@[\w.]+\w|\d{3}-\d{3}-\d{4}", got[i]), strict=True):
            assert new.setdefault(old, made) == made  # one entity, one surrogate
    assert len(set(new.values())) == len(new) == 600 and not set(new) & set(new.values())


def test_long_turns_are_read_back_in_little_memory():
    import tracemalloc

    said = ("\\### <turn> </turn> <b> \\\\ \n" * 40_000, "x" * 2_000_000)
    turns = [("us\ner", said[0]), ("assistant", said[1]), ("", "")]
    rendered, _ = chat.render(turns)
    tracemalloc.start()
    assert chat.parse(rendered) == turns
    assert tracemalloc.get_traced_memory()[1] < 12 * len(rendered)
    with pytest.raises(ValueError):
        chat.parse(rendered[:-3])


@pytest.mark.parametrize("same", ["id", "row"])
def test_samples_stay_bounded_where_ids_or_rows_repeat(spark, same):
    from pyspark.sql import functions as F

    from marketloom.llm.sampling import bounded_sample

    text = F.concat(F.lit("text "), F.col("id") % (4000 if same == "id" else 1))
    for key in (F.lit(7), F.lit(None).cast("long")):
        rows = spark.range(4000).select(key.alias("k"), text.alias("x"), F.lit("en").alias("l"))
        rows = rows.unionByName(spark.range(100, 200).select(F.col("id").alias("k"), F.lit("other").alias("x"), F.lit("de").alias("l")))
        rows = rows.unionByName(spark.range(50).select(F.col("id").alias("k"), F.lit("none").alias("x"), F.lit(None).cast("string").alias("l")))
        got = [tuple(r) for r in bounded_sample(rows, "l", 200).collect()]
        again = [tuple(r) for r in bounded_sample(rows.repartition(7), "l", 200).collect()]
        assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(set(got))
        en = sum(r[2] == "en" for r in got)
        assert 120 < en < 280 if same == "id" else en <= 1
        assert sum(r[2] == "de" for r in got) == 100 and all(r[2] for r in got)
    assert bounded_sample(rows.limit(0), "l", 200).count() == 0


def test_a_common_item_is_joined_as_it_is_broadcast(spark):
    """Over a thousand texts hold one item, so its seeds and texts are dealt to salts."""
    from marketloom.llm import decontaminate

    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(25))) for i in range(4)]
    rows = [(i, f"start {i} {items[0][1]} end {i}") for i in range(2500)] + [(3000 + i, f"{items[1][1]} {items[2][1]} {i}") for i in range(20)] + [(4000 + i, f"clean text {i} of few words") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    both = [sorted(tuple(r) for r in decontaminate.contamination(docs, benchmark, broadcast_words=n).collect()) for n in (10_000, 0)]
    assert both[0] == both[1]
    assert {(d, i) for d, i, *_ in both[0]} >= {(i, 0) for i in range(2500)} | {(3000 + i, k) for i in range(20) for k in (1, 2)}
    assert all(d < 4000 for d, *_ in both[0])
