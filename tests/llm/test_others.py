"""Search, archives, packing, surrogates, chat formatting and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import ann, chat, packing, pii, warc
from marketloom.llm.queries import tokenizer_path

INF, NAN = float("inf"), float("nan")


def test_nearest(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 16))
    rows = [(i, v.astype(float).tolist(), "x") for i, v in enumerate(data)]
    rows += [(600 + i, data[3].tolist(), "x") for i in range(12)]  # copies and ties
    odd = [(700, None), (701, [0.0] * 16), (702, [NAN] + [1.0] * 15), (703, [INF] + [1.0] * 15), (704, [None] + [1.0] * 15), (705, []), (None, [1.0] * 16)]
    rows += [(i, v, "x") for i, v in odd] + [rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=5, beam=120, expand=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v) for i, v, _ in rows if i is not None and i < 700}
    hits = total = 0
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        cos = lambda i: float(good[i] @ good[q] / np.sqrt((good[i] @ good[i]) * (good[q] @ good[q])))
        best = sorted((-round(cos(i), 12), i) for i in good if i != q)[:5]
        found = [x[1:] for x in sorted(found)]
        assert len(found) == 5 and all(abs(cos(i) - s) < 1e-12 for i, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += len({i for i, _ in found} & {i for _, i in best})
        total += 5
        if q == 600:
            assert [i for i, _ in found] == [3, 601, 602, 603, 604]
    assert hits / total >= 0.9
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(frame.filter("vec_id < 3"), F.lit(True))
    assert few.count() == 6


def test_nearest_goes_on_until_done(spark):
    """A narrow beam on vectors without clusters: the search lasts until the beam is expanded, not for a fixed number of hops."""
    data = np.random.default_rng(5).normal(size=(2500, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0, k=5, degree=10, beam=40, expand=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    best = {q: set(np.argsort(-(unit @ unit[q]))[1:6].tolist()) for q in range(0, 2500, 50)}
    recall = sum(len(got[q] & best[q]) for q in best) / (5 * len(best))
    assert recall >= 0.77, recall


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_warc(spark, tmp_path, compression):
    same = "<p>same é</p>"
    rows = [(i, f"http://e/{i}", f"<p>{i}</p>" * i) for i in range(30)] + [(100 + i, None, same) for i in range(9)] + [(50, "u\r\nWARC-Type: x", same), (60, "u", None), (61, "u", ""), (None, "u", same), (62, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    folder = str(tmp_path / "a")
    warc.archive_pages(pages(spark, rows), folder, compression=compression)
    got = {r.page_id: r for r in warc.read_archive(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        first = min(x[0] for x in rows if x[0] is not None and (x[2] or "") == (html or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.payload_digest(body))
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
    heads = spark.read.format("warc").option("payload", "false").load(folder)
    plan = heads.filter("record_type = 'revisit'")
    assert plan.count() == sum(r.record_type == "revisit" for r in got.values()) and plan.filter("payload is not null").count() == 0
    large = spark.read.format("warc").load(folder)
    assert large.filter("record_id like '<urn:page:1%' and record_type in ('response')").count() == sum(str(i).startswith("1") and r.record_type == "response" for i, r in got.items())
    none = str(tmp_path / "b")
    warc.archive_pages(pages(spark, []), none)
    assert warc.read_archive(spark, none).count() == 0


def test_warc_splits(spark, tmp_path, monkeypatch):
    options = {"path": str(tmp_path / "c")}
    monkeypatch.setattr(warc, "SPLIT", 2000)
    import pyarrow as pa

    names = ["record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "http_length", "payload"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"<urn:page:{i}>" for i in range(50)]), *[pa.array(["response"] * 50)] * 5, pa.array([300] * 50), pa.array([b"x" * 300] * 50)], names=names)
    for kind in ("", "gzip"):
        writer = warc.WarcWriter({**options, "path": options["path"] + kind, "compression": kind})
        writer.commit([writer.write(iter([batch]))])
        reader = warc.WarcReader({"path": options["path"] + kind, "partition_bytes": "1"})
        parts = reader.partitions()
        assert len(parts) > 3
        assert sum(b.num_rows for p in parts for b in reader.read(p)) == 50


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    alphabet = ["the ", "word", "  ", "\n", " a", "é", " \u00a0x", "123", "!?", "\u3000", " <|endoftext|> ", "'s ", "\t", "ñez "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " ".join(["long text"] * 900)), (None, "no id"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = packing.pack(docs, tokenizer_path(), capacity=64, items_per_group=50, with_ids=True).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = packing.piece_starts(len(ids), 64) + [len(ids)]
        assert all(b - a == 64 for a, b in zip(cuts[1:-1], cuts[2:])) and cuts[1] - cuts[0] <= 64
        want += [(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids)) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_vector_best_fit():
    lengths = np.array([5, 4, 4, 3, 3, 1])
    assert packing.vector_best_fit(lengths, (10, 10, 100))[0].max() == 1
    for bounds in ((10, 2, 100), (10, 10, 30), (10, 1, 100)):
        for measure in ("norm", "dot"):
            bins, offsets = packing.vector_best_fit(lengths, bounds, (1.0, 1.0, 1.0), measure)
            for b in set(bins):
                own = lengths[bins == b]
                assert own.sum() <= bounds[0] and len(own) <= bounds[1] and (own**2).sum() <= bounds[2]


def test_surrogates(spark):
    texts = [
        (1, "Mail ana.lopez@mail.example.com or ANA.LOPEZ@MAIL.EXAMPLE.COM!! and bob@x.org"), (2, "call +1 (717) 555-0202, or 717-555-0203, card 4111 1111 1111 1111 = 4111111111111111"),
        (3, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" at 84.26.86.227.'), (4, "Mrs. Anna Schmidt met Mr. Karl Weber; Mrs Anna Schmidt left. Госпожа Анна Петрова"), (5, None), (6, ""), (7, "clean text, version 3.0 of 2024"),
        (None, "write to bob@x.org"), (1, "Mail ana.lopez@mail.example.com or ANA.LOPEZ@MAIL.EXAMPLE.COM!! and bob@x.org"), (8, "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789"), (9, "x" * 30000 + " 10.0.0.1"),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in texts], "doc_id long, text string, entity string")
    got = pii.pseudonymise(docs, key="k", found_col="n")
    assert got.columns == ["doc_id", "text", "entity", "n"]
    rows = [(r.doc_id, r.text, r.n) for r in got.collect()]
    assert len(rows) == len(texts)
    by = {}
    for i, t, n in rows:
        by.setdefault(i, []).append((t, n))
    assert by[5] == [(None, 0)] and by[6] == [("", 0)] and by[7] == [(texts[6][1], 0)]
    for word in ("lopez", "bob@x.org", "555-0202", "4111", "b44e15e0", "84.26.86.227", "Schmidt", "Weber", "Петрова", "3704", "123-45", "10.0.0.1"):
        assert not any(word.lower() in (t or "").lower() for t, _ in sum(by.values(), [])), word
    one = by[1][0][0]
    assert by[1][0] == by[1][1]
    mails = re.findall(r"[\w.]+@[\w.]+", one)
    assert mails[0].upper() == mails[1] and mails[2] != mails[0] and mails[2] in by[None][0][0]
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.com", mails[0])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}, or \d{3}-\d{3}-\d{4}, card \d{4} \d{4} \d{4} \d{4} = \d{16}", by[2][0][0])
    a, b = re.search(r"card ([\d ]+) = (\d+)", by[2][0][0]).groups()
    assert a.replace(" ", "") == b
    names = re.match(r"Mrs\. (\w+ \w+) met Mr\. (\w+) (\w+); Mrs (\w+ \w+) left\. Госпожа (\w+) (\w+)", by[4][0][0])
    assert names[1] == names[4] and names[1].split()[0] in pii.GIVEN[("f", "latin")] and names[2] in pii.GIVEN[("m", "latin")] and names[5] in pii.GIVEN[("f", "cyrillic")]
    assert pii.pseudonymise(docs.limit(0), key="k").count() == 0
    other = pii.pseudonymise(docs, key="other").filter("doc_id = 3").first().text
    assert other != by[3][0][0]


def test_names_as_written(spark):
    texts = [
        "Mr McDonald, Mr. O'Neil and Mr J. Smith left.", "Mrs Anna-Maria Schmidt and Mr John Paul Jones's dog.", "Dr. Krause saw Prof. Dr. Ada Vogel and Frau von der Leyen.",
        "Mr Karl Weber came. Mr Weber sat; Weber spoke. Karl Weber's hat.", "Nobody here: Weber, Karl.", "Mrs. Eva Lang and Dr. Eva Lang, Frau Lang."]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k", found_col="n").collect()
    got = {r.doc_id: r.text for r in rows}
    for i, words in enumerate((("McDonald", "O'Neil", "Neil", "J.", "Smith"), ("Anna", "Maria", "Schmidt", "John", "Paul", "Jones"), ("Krause", "Ada", "Vogel", "Leyen"), ("Karl", "Weber"), (), ("Eva", "Lang"))):
        assert not any(re.search(rf"(?<!\w){w}(?!\w)", got[i]) for w in words), got[i]
    assert got[4] == texts[4] and re.fullmatch(r"Mrs \w+ \w+ and Mr \w+ \w+'s dog\.", got[1]) and re.fullmatch(r"Mr \w+, Mr\. \w+ and Mr \w+ \w+ left\.", got[0])
    full, last, bare, again = re.fullmatch(r"Mr (\w+ \w+) came\. Mr (\w+) sat; (\w+) spoke\. (\w+ \w+)'s hat\.", got[3]).groups()
    assert full == again and last == bare == full.split()[1]
    one, two, three = re.fullmatch(r"Mrs\. (\w+ \w+) and Dr\. (\w+ \w+), Frau (\w+)\.", got[5]).groups()
    assert one == two and three == one.split()[1] and one.split()[0] in pii.GIVEN[("f", "latin")]
    assert {r.doc_id: r.n for r in rows} == {0: 3, 1: 2, 2: 3, 3: 4, 4: 0, 5: 3}


def test_surrogates_keep_checks(spark):
    """Country codes, check digits and script stay; long addresses do not end the job; other numbers stay in clear."""
    long = "x@" + "a." * 300_000
    texts = ["+44 20 7946 0958 and +49 30 123456", "4785380592391139 or 5731080387325255", "DE89 3704 0044 0532 0130 00", "2001:db8::ff00:42:8329 std::move 12:30:45", "Mrs Ελένη Παππά", long + "com", long + "1", "see a.b@mail.example.com."]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k", found_col="n").collect()
    got, n = {r.doc_id: r.text for r in rows}, {r.doc_id: r.n for r in rows}
    assert n == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 1}
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4} and \+49 \d\d \d{6}", got[0]) and got[0] != texts[0]
    card, other = got[1].split(" or ")
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(card))))
    assert total % 10 == 0 and card != "4785380592391139" and other == "5731080387325255"
    plain = got[2].replace(" ", "")
    assert plain[:2] == "DE" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4} std::move 12:30:45", got[3]) and "8329" not in got[3]
    assert re.fullmatch(r"Mrs [\u0370-\u03ff]+ [\u0370-\u03ff]+", got[4]) and "Παππά" not in got[4]
    assert len(got[5]) == len(texts[5]) != 0 and got[5] != texts[5] and got[6] == texts[6]
    assert re.fullmatch(r"see [a-z]\.[a-z]@[a-z]{4}\.[a-z]{7}\.com\.", got[7])


def test_surrogates_stay_distinct(spark):
    """Entities outnumber what a short format can hold apart by chance."""
    from marketloom.llm.scratch import Scratch

    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(60)], "kind string, value string")
    made = pii.distinct_surrogates(entities, "k", Scratch(spark, "t")).collect()
    assert len(made) == 60 and len({r.made for r in made}) == 60 and not {r.made for r in made} & {r.value for r in made}


def test_chat(spark):
    rng = random.Random(3)
    nasty = ["\\", "<turn>", "</turn>\n", "\\</turn>", "<", "é", "日本", "🎉", "\n\n", " ", "assistant", "\\n", "<|endoftext|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole\\n<turn>", None]), rng.choice([None, ""] + ["".join(rng.choice(nasty) for _ in range(rng.randrange(12))) for _ in range(8)])) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "no id"), (100, None, "assistant", "no turn"), (101, 1, "assistant", "x" * 20000), (101, 1, "assistant", "x" * 20000), (102, 0, "user", "only user")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(frame, tokenizer_path())
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert len(got) == len(by)
    for c, turns in by.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        assert len(r.token_ids) == len(r.loss_mask)
    assert chat.read_back(chat.format_conversations(frame.limit(0), tokenizer_path())).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from marketloom.llm import decontaminate, line_dedup, near_dedup

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}
    bad = [r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()]
    left = {r.doc_id for r in kept.collect()}
    assert len([b for b in bad if b in left]) <= 0.2 * len(bad)
