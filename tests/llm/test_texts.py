"""Language, quality, lines, near-duplicates and decontamination against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, language_id, line_dedup, near_dedup, quality, textcore

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 0.5, "n") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (None, "a row without an id here"), (5, "x" * 50_000), (5, "x" * 50_000), (6, "Émile ÄÖ"), (7, "1 2 3 !?")]


def test_segments_match_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tÉ") for _ in range(rng.randrange(30))) for _ in range(200)] + [""]
    column = pa.array(texts, pa.large_string())
    for limit in (1, 64, 1 << 20):
        got = []
        for _, _, data, offsets in textcore.blocks(column, limit):
            hashes, cut = textcore.words(data, offsets)
            got += [hashes[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
        want = [[w.lower() if w.isascii() else w.replace("A", "a").replace("B", "b") for w in t.split()] for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        assert len({h for g in got for h in g}) == len({w for x in want for w in x})


def test_language(spark):
    rng = random.Random(2)
    languages = {"aa": ["zul", "dra", "kom"], "bb": ["ñez", "cion", "que"]}
    make = lambda lang: " ".join("".join(rng.choice(languages[lang]) for _ in range(2)) for _ in range(30))
    rows = [(i, make("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(120)]
    model = language_id.train([r[1] for r in rows[:80]], [r[2] for r in rows[:80]], bits=12)
    test = frame(spark, [(r[0], r[1]) for r in rows[80:]] + ODD)
    got = language_id.identify(test, model).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[r[0]].lang_pred == r[2] and 0 <= by[r[0]].score <= 1 for r in rows[80:])
    assert len(got) == 40 + len(ODD)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted for i in (1, 2, 3, 7))
    assert language_id.identify(test.limit(0), model).count() == 0
    none = language_id.train([], [])
    assert {r.lang_pred for r in language_id.identify(test, none).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(3)
    good = [words(rng, 60) + "." for _ in range(150)]
    bad = [words(rng, 60).upper().replace(" ", "!! ") for _ in range(150)]
    rows = list(enumerate(x for pair in zip(good, bad) for x in pair))
    docs = frame(spark, rows + [(None, "z"), (1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0, "clash") for i, _ in rows if i % 5] + [(None, 1, 0, ""), (3, None, 0, "")], "doc_id long, quality int, toxic int, text string")
    model = quality.fit_quality_model(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 2 == 0) for i, _ in rows if i % 5 == 0]) > 0.95
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs, model, keep=True).columns == [*docs.columns, "quality_score"]
    # the sum-of-squares identity against all pairs
    for _, _, offsets, ids, x in quality.features(pa.array([rows[0][1]], pa.large_string()), np.array([5.0]), model.bits):
        pairs = sum(x[i] * x[j] * (model.v[ids[i]] @ model.v[ids[j]]) for i, j in itertools.combinations(range(len(ids)), 2))
        assert quality._raw(model.w0, model.w, model.v, offsets, ids, x)[0][0] == pytest.approx(model.w0 + (model.w[ids] * x).sum() + pairs)
    empty = quality.fit_quality_model(docs, labels.limit(0))
    assert {round(r.score, 3) for r in quality.score(docs, empty).collect()} == {0.5}


STRIP = " \t\n\x0b\x0c\r"


def plain_lines(rows, least=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(STRIP).translate(lower)
    holders = {}
    rank = lambda i: float("inf") if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 20), (3, 5)])
def test_lines(spark, sizes):
    rng = random.Random(4)
    pool = ["  Shared LINE number %d é " % i for i in range(25)] + ["short", "", "\tÀ tab-led line \r", "à tab-led line", "ééééééééé", "éééééééééé"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(i, "The hot line is everywhere\nown line %d of text" % i) for i in range(60, 160)] + ODD + [(60, rows[1][1])]
    got = line_dedup.dedup_lines(frame(spark, rows), keys_per_shard=sizes[0], probes_per_group=sizes[1])
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in got.collect()), key=str)
    assert got == plain_lines(rows)
    kept = line_dedup.dedup_lines(frame(spark, rows), keep=True)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and kept.count() == len(rows)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(5)
    hi = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    lo = np.where(np.arange(len(hi)) % 2, hi, np.uint64(7))  # equal halves need places too
    function = line_dedup.PerfectHash.build(hi, lo)
    assert sorted(function.index(hi, lo).tolist()) == list(range(len(hi)))
    again = line_dedup.PerfectHash.unpacked(*function.packed())
    assert (again.index(hi, lo) == function.index(hi, lo)).all()


def plain_near(rows, k, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_LEFT", 2)
    monkeypatch.setattr(near_dedup, "_MAIN", 3)
    rng = random.Random(6)
    base = words(rng, 120).split()
    rows = [(i, words(rng, 40)) for i in range(100, 130)]
    for i in range(130, 190):  # chains of near copies around the threshold
        copy = base[:]
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    rows += [(i, rows[5][1].upper()) for i in range(220, 240)] + [(50, "two words"), (51, "TWO  words")] + ODD
    rng.shuffle(rows)
    for k in (4, 5):
        got = near_dedup.near_duplicates(frame(spark, rows), k=k).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_near(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    left = near_dedup.survivors(frame(spark, rows), k=5).collect()
    want = {c for _, n, c in plain_near(rows, 5)}
    assert {r.doc_id for r in left} == want | {None} and len(left) == len(want | {None})
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = near_dedup.superminhash(np.concatenate([a, b, a[::-1], a[:3]]), np.array([0, 300, 600, 900, 903]), 256)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.12
    assert (s[0] == s[2]).all()
    assert (np.sort(s[3] >> np.uint64(56)) <= 255).all()


def test_tiles():
    t = decontaminate.tiles(list(range(20)), [*range(12, 20), 99, *range(0, 12)], 5)
    assert sorted(n for _, _, n in t) == [8, 12]
    assert decontaminate.tiles([1, 2, 3], [1, 2], 3) == []
    assert sum(n for _, _, n in decontaminate.tiles([1] * 12, [1] * 7, 5)) == 7
    rng = random.Random(8)
    for _ in range(50):  # tiles are true, disjoint and leave no longer match
        p, x = ([rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(2))
        found = decontaminate.tiles(p, x, 3)
        seen_p, seen_x = set(), set()
        for a, b, n in found:
            assert p[a : a + n] == x[b : b + n] and n >= 3
            assert not seen_p & set(range(a, a + n)) and not seen_x & set(range(b, b + n))
            seen_p |= set(range(a, a + n))
            seen_x |= set(range(b, b + n))
        for a in range(len(p) - 2):
            for b in range(len(x) - 2):
                free = not seen_p & {a, a + 1, a + 2} and not seen_x & {b, b + 1, b + 2}
                assert not (free and p[a : a + 3] == x[b : b + 3])


@pytest.mark.parametrize("bound", [1000, 0])
def test_decontamination(spark, bound):
    rng = random.Random(9)
    items = [(i, words(rng, 40, 5000).capitalize() + ".") for i in range(5)] + [(5, None), (6, ""), (7, "Tiny item"), (None, words(rng, 30, 5000))]
    w = items[0][1].lower().rstrip(".").split()
    rows = [(10, words(rng, 80, 5000)), (11, words(rng, 50, 5000) + " " + items[1][1].upper() + " tail"), (12, " ".join(w[20:] + ["gap"] + w[:20])), (13, " ".join(w[:10])), (14, "has a TINY, item inside"), (15, items[8][1]), *ODD]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(frame(spark, rows), benchmark, broadcast_words=bound).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(11, 1), (12, 0), (14, 7), (15, None)}
    kept = decontaminate.remove_contaminated(frame(spark, rows), benchmark, broadcast_words=bound)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in {11, 12, 14, 15}), key=str)
    assert decontaminate.contamination(frame(spark, rows), benchmark.limit(0)).count() == 0
    assert decontaminate.contamination(frame(spark, rows).limit(0), benchmark).count() == 0


def plain_contamination(rows, items, least=5, share=0.5):
    """Every text tiled with every item, word by word."""
    import re

    def split(text):
        text = re.sub(r"([\u4e00-\u9fff\u3040-\u30ff])", r" \1 ", (text or "").lower())
        return [code.setdefault(w, len(code)) for w in re.findall(r"[^\W_]+", text)]

    code: dict[str, int] = {}
    out = []
    for d, t in rows:
        for i, x in items:
            p, w = split(x), split(t)
            if p and w:
                covered = sum(n for _, _, n in decontaminate.tiles(p, w, min(least, len(p))))
                if covered >= share * len(p):
                    out.append((d, i, covered, len(p)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1000, 0])
def test_decontamination_by_brute_force(spark, bound):
    """Both ways of meeting the benchmark: typographic marks, scripts without spaces, null and repeated ids, clean ones among them."""
    rng = random.Random(12)
    items = [(i, words(rng, 30, 60)) for i in range(6)] + [(6, "foo \u2014 bar"), (7, "\u201cThe quick\u201d brown fox\u2019s jump over lazy dogs"), (8, "天気がとても良いので散歩に行きました"), (2, words(rng, 12, 60)), (None, "one two three four five six")]
    rows = []
    for i in range(40):  # pieces of items, reordered, among words of the same small vocabulary
        w = items[rng.randrange(6)][1].split()
        a = rng.randrange(5, 25)
        rows.append((i % 9, " ".join(words(rng, 10, 60).split() + w[a:] + ["gap"] + w[: rng.randrange(a)])))
    rows += [(5, "a clean row with that id"), (None, "clean and without an id"), (None, items[0][1]), (None, items[0][1]), (60, "see foo - bar there"), (61, "THE quick brown fox's jump, over \u2018lazy\u2019 dogs."), (62, "今日は天気がとても良いので散歩に行きました。"), (63, None), (64, ""), (65, items[10][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), benchmark, broadcast_words=bound)
    want = plain_contamination(rows, items)
    assert sorted(((r.doc_id, r.item_id, r.covered, r.item_words) for r in got.collect()), key=str) == want
    assert {6, 7, 8} <= {i for _, i, _, _ in want}
    bad = {t for d, t in rows for x in want if x[0] == d and plain_contamination([(d, t)], items)}
    kept = decontaminate.remove_contaminated(frame(spark, rows), benchmark, broadcast_words=bound).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(((d, t) for d, t in rows if t not in bad), key=str)


def test_hashes_of_alike_words(spark):
    """Words on which hashes modulo a power of two collide stay different: in word hashes, sets and links."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for x, y in ((a, b), (a * 3, b * 3)):  # the longer ones are hashed one by one
        hashes, _ = textcore.words(*textcore.string_bytes(pa.array([f"{x} {y}"])))
        assert len(set(hashes.tolist())) == 2
    got = near_dedup.near_duplicates(frame(spark, [(1, a), (2, b), (3, "x " + a)])).collect()
    assert all(r.kept for r in got)


def test_near_copies_without_ids(spark):
    """Classes known by rows without ids alone link to others, and one row of a group stays."""
    rng = random.Random(13)
    w = words(rng, 100, 5000).split()
    near = " ".join(w[:50] + ["other"] + w[51:])
    lone = words(rng, 30, 5000)
    rows = [(7, " ".join(w)), (None, near), (None, near), (None, lone), (None, lone), (None, None), (8, "")]
    got = near_dedup.near_duplicates(frame(spark, rows), k=5).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("7", "7", True), ("None", "7", False), ("None", "7", False), ("None", "None", True), ("None", "None", True), ("None", "None", True), ("8", "8", True)])
    left = near_dedup.survivors(frame(spark, rows), k=5).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted([("7", rows[0][1]), ("None", lone), ("None", ""), ("8", "")])


def test_spread_join(spark, monkeypatch):
    """Hot and null keys are dealt to salts; the rows are those of a plain join."""
    from marketloom.llm import skew

    monkeypatch.setattr(skew, "LEAST", 5)
    monkeypatch.setattr(skew, "_MOST_KEYS", 10)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)] + [(i, None) for i in range(200, 260)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi"):
        made = skew.spread_join(left, right, "k", how)
        plain = left.join(right, "k", how)
        assert made.columns == plain.columns
        assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))


def test_language_rejects(spark):
    """Scores follow accuracy, and the accepted predictions reach the target on texts not seen."""
    rng = random.Random(14)
    common = ["la", "de", "re", "no", "ta", "mi"]
    own = {"aa": ["zul", "kom"], "bb": ["ñez", "que"]}
    make = lambda lang, n, share: " ".join("".join(rng.choice(own[lang] if rng.random() < share else common) for _ in range(2)) for _ in range(n))
    rows = [("aa" if i % 2 else "bb", rng.randrange(1, 12)) for i in range(900)]
    texts = [make(lang, n, 0.25) for lang, n in rows]
    model = language_id.train(texts[:600], [r[0] for r in rows[:600]], bits=12, target_precision=0.97)
    got = [r for r in language_id.identify(frame(spark, list(enumerate(texts[600:]))), model).collect()]
    right = {r.doc_id: r.lang_pred == rows[600 + r.doc_id][0] for r in got}
    accepted = [right[r.doc_id] for r in got if r.accepted]
    assert 0 < len(accepted) < len(got) and np.mean(accepted) >= 0.9 > np.mean([right[r.doc_id] for r in got if not r.accepted])
    assert abs(np.mean([r.score for r in got]) - np.mean(list(right.values()))) < 0.08


def test_whole_tables_at_small_scale(spark):
    """The registered queries and their SQL give the same rows."""
    import duckdb

    from marketloom.llm.oracles import ORACLES
    from marketloom.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, "/root/testdata/sf0.001").select(want.columns).collect()
        norm = lambda rows: sorted(str(tuple(None if x is None else x for x in r)) for r in rows)
        assert norm(got) == norm(want.fetchall()), name
