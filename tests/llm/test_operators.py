"""The ten operators and the pipeline: edge cases, round trips and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkflow.llm import bitplanes, decontaminate, html, jpeg, media, neardup, packing, pii, quality, quotes, tokens, warc
from inkflow.llm.common import shared_dir
from inkflow.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, part string, key string"
LONG = "word " * 30000


def odd_documents(spark):
    rows = [
        (3, "Hello world, hello.", "en", "a", 1, "x", "y", "z"), (1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "x", "y", "z"),
        (None, "No id here.", "en", "a", 1, "x", "y", "z"), (3, "Hello world, hello.", "en", "a", 1, "x", "y", "z"), (4, LONG, "en", "a", 1, "x", "y", "z"),
        (5, "É ß  日本\tx\n\ny 'S it's", "en", "a", 1, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


def expected_ids(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for x in texts]


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_token_cache(name):
    odd = ["", " ", "a  b", " x y ", "it's I'LL o'Re 'S'", "ﬁ Å é x İ K ſ", "12 345 6.7,8", "日本語 テスト", "a\tb\n\nc d e", "<|endoftext|> a", "Σας ΣΑΣ", "a" * 300, "\x1c a\x1cb", "...!!!***" * 5, "foo.\nBar baz\n qux"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(vocabulary(name)).encode(odd)]
    assert got == [x[:-1].tolist() for x in expected_ids(name, odd, 0)]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_op1(spark, kind):
    docs = odd_documents(spark)
    files = bitplanes.write_token_ids(docs, vocabulary(WORD_BPE), 2, shared_dir(spark, "t1"), kind)
    rows = bitplanes.document_ids(files).orderBy("start").collect()
    order = [None, 1, 2, 3, 3, 4, 5]
    texts = ["No id here.", None, "", "Hello world, hello.", "Hello world, hello.", LONG, "É ß  日本\tx\n\ny 'S it's"]
    want, start = [], 0
    for i, ids in zip(order, expected_ids(WORD_BPE, texts, 2), strict=True):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == want
    assert bitplanes.encode_corpus(docs.limit(0), vocabulary(WORD_BPE), 2).count() == 0


def test_op2(spark):
    rows = packing.pack_documents(odd_documents(spark), vocabulary(BYTE_BPE), 1).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    whole = np.concatenate([r.ids for r in sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.start)])
    assert whole.tolist() == expected_ids(BYTE_BPE, [LONG], 1)[0].tolist()
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert packing.pack_documents(odd_documents(spark).limit(0), vocabulary(BYTE_BPE), 1).count() == 0


def test_op3(spark):
    big, small = "<p>é</p>" * 200, "<p>x</p>"
    data = [(1, "u1", big), (2, "u2", big), (3, None, small), (4, "u4", small), (5, "u5", None), (None, "u6", big), (7, "u\r\n7", big + "!"), (2, "u2", "other")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    out = shared_dir(spark, "t3")
    manifest = warc.write_warc(pages, out, roll_bytes=500)
    assert manifest.count() > 2 and all(".tmp" not in r.path for r in manifest.collect())
    rows = {(r.page_id, r.payload_digest): r for r in warc.read_warc(manifest, out).collect()}
    assert len(rows) == len(data)
    for i, _, h in data:
        raw = (h or "").encode()
        r = rows[i, hashlib.sha1(raw).hexdigest()]
        assert r.payload_bytes == len(raw)
        assert (r.record_type, r.refers_to) == (("revisit", 2) if i == 1 else ("response", None))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_op4_codec():
    rng = random.Random(5)
    payloads = [b" " * 192, bytes(range(192)), b"p" * 384, bytes(rng.randrange(256) for _ in range(192 * 40)), b"o" * 960]
    files = jpeg.encode(payloads)
    assert [jpeg.payload(*x) for x in jpeg.decode(files)] == payloads
    image, coefs = jpeg.decode(files)[1]
    b = np.zeros(64)
    b[jpeg.ZIGZAG] = coefs[0]
    c = lambda k: 0.5**0.5 if k == 0 else 1
    want = [[sum(c(u) * c(v) * b[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 + 128 for x in range(8)] for y in range(8)]
    assert np.abs(np.array(want).clip(0, 255) - jpeg.planes(image, coefs)[0][:8, :8]).max() <= 0.51
    with pytest.raises(ValueError):
        jpeg.decode([files[0][:60]])


def test_op4(spark):
    """Stored media against their texts, with long texts in strips; tensors against the codec's own; nulls and empty tables."""
    docs = odd_documents(spark)
    stored = media.store_media(docs, 384 * 100)
    rows = media.decode_media(stored).collect()
    texts = {i: t or "" for i, t in docs.select("doc_id", "text").collect()}
    assert len(rows) == 7
    for r in rows:
        n, payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    files = {r.doc_id: [bytes(f) for f in r.media] for r in stored.collect()}
    assert len(files[4]) == 4 and all((r.media_bytes, r.media_sha256) == (sum(map(len, files[r.doc_id])), hashlib.sha256(b"".join(files[r.doc_id])).hexdigest()) for r in rows)
    assert len({(r.feature, r.media_sha256) for r in rows if r.doc_id == 3}) == 1
    tensors = media.store_tensors(stored).collect()
    assert len(tensors) == 10 and all(len(r.rgb) == r.height * r.width * 3 for r in tensors)
    assert all(bytes(r.rgb) == jpeg.rgb(*jpeg.decode([files[r.doc_id][r.strip]])[0]).tobytes() for r in tensors)
    none = spark.createDataFrame([(1, None, None), (2, 1, files[2])], media.STORED)
    got = {r.doc_id: r for r in media.decode_media(none).collect()}
    assert len(got) == 2 and got[1].payload_sha256 is None and got[1].feature is None and got[2].payload_bytes == 192
    assert media.decode_media(media.store_media(docs.limit(0))).count() == 0


def test_op5(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) for _ in range(120)]
    bad = [" ".join(rng.choice(["zz$$$", "qq%%%", "xx&&&"]) for _ in range(40)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(x for p in zip(good, bad, strict=True) for x in p)] + [(None, "alpha"), (999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held and r.doc_id < 240]
    assert len(got) == 242 and len(held) > 50 and all(r.predicted == (r.doc_id + 1) % 2 for r in held)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_op6(spark):
    text = "a@b.co x@y@z.org 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +49 (30) 123-4567 ++1 2 call 49 30 1234567 or mail a (at) b.co"
    base = pii.base_spans(text)
    want = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 8 <= len(digits) <= 15:
                continue
            want.append((kind, *m.span()))
    assert base == want
    # Chains of equal forms carry the label to what no pattern finds.
    rng = random.Random(2)
    number = lambda: "+" + "".join(rng.choice("123456789") for _ in range(11))
    rows = [(i, f"call {number()} now, order {rng.randrange(10**6)} of u{i}@mail.org") for i in range(200)]
    rows += [(900, "ring +49301234567 today. Again: 49301234567 please."), (901, None), (902, ""), (None, "x@y.zz"), (903, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.find_pii(docs, model).collect()}
    assert got[900].n_phone == 1 and got[900].spans.count("phone") == 2
    assert got[901].spans == got[902].spans == got[903].spans == "" and got[None].n_email == 1
    assert sum(r.n_added for i, r in got.items() if i is not None and i < 200) == 0
    clean = docs.select("doc_id", pii.redacted(docs, model).alias("t"))
    assert {r.doc_id: r.t for r in clean.collect()}[900] == "ring <PHONE> today. Again: <PHONE> please."
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_op6_marginals():
    """Message passing against enumeration: exact on a tree, close on a loop; and what training learns is kept."""
    import itertools

    def enumerated(g, model):
        n, m = len(g.spans), len(pii.LABELS)
        unary = [model.scores(pii.features(p, b)) for p, b in zip(g.pieces, g.before, strict=True)]
        out = np.zeros((n, m))
        for ys in itertools.product(range(m), repeat=n):
            if all(not o or o == y for o, y in zip(g.base, ys, strict=True)):
                z = sum(unary[i][y] for i, y in enumerate(ys) if not g.base[i]) + sum(model.chain[ys[i], ys[i + 1]] for i in range(n - 1)) + sum(model.skip[ys[a], ys[b]] for a, b in g.skips)
                for i, y in enumerate(ys):
                    out[i, y] += np.exp(z)
        return out / out.sum(1, keepdims=True)

    rng = np.random.default_rng(3)
    model = pii.Model({"bias": rng.normal(size=5), "digits11": rng.normal(size=5)}, rng.normal(size=(5, 5)) / 2, np.eye(5) * 1.5)
    for text, most in (("call 49301234567 or 44209876543 or a@b.co today", 1e-4), ("+49301234567 x 44201234567 y 49301234567 z a (at) b.co", 0.08)):
        base = pii.base_spans(text)
        g = pii.Graph(text, base, pii.other_nodes(text, base))
        assert np.abs(pii.marginals(g, model, 200) - enumerated(g, model)).max() < most
    texts = [f"+49301234{i:03d} then 49301234{i:03d} and 88{i:03d}77665544" for i in range(100)]
    learned = pii.train([c for t in texts for c in pii.cases(pii.Graph(t, pii.base_spans(t), pii.other_nodes(t, pii.base_spans(t))))])
    assert learned.skip[4, 4] > learned.skip[4, 0] + 1 and learned.skip[0, 0] > learned.skip[0, 4]
    assert len({round(x, 6) for x in learned.skip.diagonal()}) > 1


def test_fits_are_bounded(spark):
    """Five hundred rows of two labelled ids give two rows to learn from, and scores and spans for all of them."""
    rows = [(i % 2, f"word{i} +4930123456{i % 10} mail{i}@host.org") for i in range(500)] + [(None, "x"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash")).withColumn("h", F.lit("clash")).withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, labels, 2).count() == 502 and pii.find_pii(docs, pii.fit(docs, 2)).count() == 502
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    got = {str(r.doc_id): r for r in quality.score_documents(docs, labels).where("doc_id is null or doc_id = 7").collect()}
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got.values())


def test_op6_brute_force(spark):
    """Spans and digests of odd texts against the contract's patterns; a text of many nodes; repeated rows."""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def wanted(text):
        out = []
        for kind, pattern in enumerate(patterns):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 8 <= len(digits) <= 15:
                    continue
                out.append((kind, *m.span()))
        return out

    rng = random.Random(6)
    alphabet = ["a", "b.", "@", "1", "23", "+4", ".", "-", " ", "(", ")", "é", "4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "+49 301234567"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + [" ".join(f"+4930{i:07d} u{i}@h.org 4930{i:07d}" for i in range(3000))]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("spans", F.lit(1))
    got = pii.find_pii(docs, pii.fit(docs)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = wanted(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(pii.joined(base).split(",")) - {""} <= set(r.spans.split(","))


def test_op6_without_base(spark):
    """The field runs on a text without base spans: its forms alone can be certain."""
    weight = [9.0 if k and pii.KINDS[k - 1] == "phone" else 0.0 for k in range(len(pii.KINDS) + 1)]
    model = pii.Model({"digits11": weight})
    docs = spark.createDataFrame([(1, "ring 49301234567 today. Again: 49301234567 please."), (2, "nothing here, 12345 apart"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs, model).collect()}
    assert got[1].n_phone == 0 and got[1].n_added == 2 and got[2].n_added == got[3].n_added == 0
    clean = {r.doc_id: r.t for r in docs.select("doc_id", pii.redacted(docs, model).alias("t")).collect()}
    assert clean[1] == "ring <PHONE> today. Again: <PHONE> please." and clean[2].endswith("12345 apart") and clean[3] is None


def test_op7(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 10, 14])))) for i in range(12)] + [(50, None), (None, "w1 w2"), (51, "...")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(60)) + (" " + items[i % 12][1].upper() + "!" if i % 2 else "")) for i in range(40)] + [(None, None), (77, "")]
    got = decontaminate.find_overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    for i, t in docs:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        hit, ids = set(), set()
        for k, x in items:
            iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x or "")
            for a in range(max(1, len(iw) - 9) if iw else 0):
                w = iw[a : a + 10]
                for s in range(len(ws) - len(w) + 1):
                    if ws[s : s + len(w)] == w:
                        hit |= set(range(s, s + len(w)))
                        ids |= {k} - {None}
        r = by[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(ws), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.contaminated)


def test_op7_edges(spark):
    """Long texts, repeated rows and items, windows at both ends, a word that stands everywhere, empty tables, clashing names."""
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, item), (1, item), (2, LONG + item), (3, "ten eleven " + LONG), (4, item[4:-7]), (5, "Word " + item.upper()), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("n_hit", F.lit(2))
    items = spark.createDataFrame([(7, item), (7, item), (8, item), (None, "ten eleven word"), (9, "word " * 10)], "item_id long, text string")
    got = {(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.find_overlap(docs, items).collect()}
    assert got == {(1, 11, 2), (2, 30011, 3), (3, 30002, 1), (4, 0, 0), (5, 11, 2), (6, 0, 0)}
    assert {(r.doc_id, len(r.hit_words), r.hit_words[-1]) for r in decontaminate.hit_positions(docs, items).collect()} == {(1, 11, 10), (2, 30011, 30010), (3, 30002, 30001), (5, 11, 11)}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 6]
    assert decontaminate.find_overlap(docs.limit(0), items).count() == 0 and not decontaminate.find_overlap(docs, items.limit(0)).where("contaminated").count()
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_op8(spark):
    rows = [
        (1, 0, "user", "The first long message here.\nSecond line of it."), (1, 1, "assistant", "> The first LONG message, here.\nI agree with that one."),
        (1, 2, "user", ">> The first long message here.\n> I agree with that one.\nThanks a lot for that."), (1, 3, "user", "> something nobody has written\nok"),
        (1, 4, "user", "> Thanks a lot for that.\nWelcome."), (2, 0, "user", "> The first long message here.\nother thread"), (None, 1, "user", "> x"), (3, None, None, None),
        (1, 4, "user", "> Thanks a lot for that.\nWelcome."),
    ]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].reply_to for t in range(5)] == [None, 0, 1, None, 2]
    assert [by[1, t].thread_turn for t in range(5)] == [0, 0, 0, 3, 0] and [by[1, t].depth for t in range(5)] == [0, 1, 2, 0, 3]
    assert by[1, 2].text == "Thanks a lot for that." and by[1, 2].n_quotes == 2 and by[1, 2].n_linked == 2
    assert by[2, 0].reply_to is None and by[3, None].text == "" and by[None, 1].reply_to is None


def test_op8_parts(spark):
    """Quotes of some lines, of a paragraph, of own words around a quote, and of few words."""
    rows = [
        (1, 0, "Line one of it.\nLine two of it.\nLine three of it."), (1, 1, "> Line one of it.\n> Line two of it.\nWhy not?"), (1, 2, "> Why not?\nok"),
        (1, 3, "First half here.\n> Line three of it.\nSecond half here."), (1, 4, "> First half here.\n> Second half here.\nyes"),
        (1, 5, "A paragraph of\ntwo lines.\n\nAnother one."), (1, 6, "> A paragraph\n> of two lines.\nfine"), (1, 7, "> Line two of it.\n> Another one.\nnot of one message"),
        (2, 0, "\u597d\u7684\u3002\n\u518d\u89c1"), (2, 1, "> \u597d\u7684\u3002\n\u662f"), (2, 2, "?!"), (2, 3, "> ?!\nWhat?"), (2, 4, ">\nblank"), (2, 5, ">>> \u662f\n> What?\nso"),
    ]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))).collect()
    by = {(r.conv_id, r.turn): r.reply_to for r in got}
    assert len(got) == len(rows) and [by[1, k] for k in range(8)] == [None, 0, 1, 0, 3, None, 5, None]
    assert [by[2, k] for k in range(6)] == [None, 0, None, 2, None, 3]


def test_op8_native():
    import inspect

    assert not re.search(r"pandas|arrow|udf|\.rdd", inspect.getsource(quotes))


def test_edit_distance():
    rng = random.Random(3)

    def model(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(150))]
        b = [x for x in a if rng.random() > 0.05] + [rng.randrange(4) for _ in range(rng.randrange(3))]
        most = rng.randrange(30)
        assert neardup.edit_distance(a, b, most) == min(model(a, b), most + 1)


def test_op9(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(5000)]
    rows, shared = [], " ".join(rng.choice(vocab) for _ in range(60))
    for c in range(25):  # originals with near copies and exact copies
        base = [rng.choice(vocab) for _ in range(150)]
        for k in range(4):
            ws = list(base)
            for p in rng.sample(range(150), 3 * k):
                ws[p] = rng.choice(vocab)
            rows.append((100 * c + k, " ".join(ws), c))
        rows.append((100 * c + 50, " ".join(base), c))
    rows += [(9000 + i, shared + " " + " ".join(rng.choice(vocab) for _ in range(90)), 1000 + i) for i in range(60)]  # one passage in many texts
    rows += [(8000, "", 2000), (8001, None, 2000), (8002, "one two", 2001), (8002, "one two", 2001), (None, "one two", 2001), (None, "alone", 2002)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for i, _, c in rows:
        by.setdefault(c, set()).add(i)
    want = {i: min((x for x in by[c] if x is not None), default=None) for i, _, c in rows if i is not None}
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert sorted((str(r.class_id) for r in got if r.doc_id is None)) == ["8002", "None"]
    kept = sorted(str(r.doc_id) for r in neardup.keep_one(docs).collect())
    assert set(kept) - {"None"} == {str(x) for x in want.values()}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def classes_by_brute_force(texts):
    """Single linkage over all pairs."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, y in enumerate(texts):
        for i in range(j):
            if find(i) != find(j) and neardup.similar(texts[i], y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1000, 20])
def test_op9_family(spark, monkeypatch, block):
    """Different texts around one passage, with copies that differ in a tenth to a fifth of the words."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(20000)]
    shared = [rng.choice(vocab) for _ in range(75)]
    texts = []
    for c in range(150):
        base = shared + [rng.choice(vocab) for _ in range(26)]
        texts.append(" ".join(base))
        if c % 2:
            for p in rng.sample(range(len(base)), 10 + c % 11):
                base[p] = rng.choice(vocab)
            texts.append(" ".join(base))
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = classes_by_brute_force(texts)
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want)) and len(set(want)) < len(texts) - 50


def test_op9_recall(spark):
    """Texts of 1 to 300 words with up to a fifth of their words changed, dropped or added, at any place."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    texts = []
    for c in range(160):
        n = (1, 2, 4, 5, 9, 10, 25, 60, 150, 300)[c % 10]
        base = [rng.choice(vocab) for _ in range(n)]
        texts.append(" ".join(base))
        for p in sorted(rng.sample(range(n), rng.randrange(n // 5 + 1) if c % 3 else n // 5), reverse=True):
            base[p : p + 1] = rng.choice(([rng.choice(vocab)], [], [base[p], rng.choice(vocab)]))
        texts.append("  ".join(base))
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(classes_by_brute_force(texts)))


def test_op10(spark):
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies on this site, please accept.</div><main><h1>Head &amp line</h1><p>One <b>bo</b>ld.<p>Two&nbsp;words<br>x</p><div class="ad">Buy this now</div><script>var a="</p>"</script><p>Y</p></main><aside><p>Related things to read today.</p></aside><!-- c --><footer>&copy; me</footer></body></html>'
    data = [(1, "u", page), (2, None, None), (3, "v", "<article><p>cut"), (None, "w", "<p"), (1, "u", page), (4, "x", "<article>" + "<p>word" * 20000)]
    got = html.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "Head & line One bold. Two words x Y" and by[1].n_chars == len(by[1].text)
    assert by[2].text == "" and by[3].text == "cut" and by[None].text == "" and by[4].text.count("word") == 20000


def test_op10_hints():
    tree = html.default_tree()
    x, y, _ = html.labelled_table()
    assert (html.classify(tree, x) == y).all()
    long = " ".join(f"w{i}" for i in range(70))
    text = lambda body, attrs="": html.main_text(f"<html><body{attrs}>{body}</body></html>", tree)[0]
    assert text(f"<p>{long}</p>", ' class="has-sidebar"') == text(f"<p>{long}</p>", ' class="search"') == long
    assert text('<article class="post with-sidebar"><p>Few words.</p></article>') == "Few words."
    article = '<h2 id="search-algorithms">Search</h2><section id="related-work"><p>Earlier work.</p></section><section id="related"><p>More.</p></section>'
    assert text(f'<article><div class="article-header"><h1>Title here</h1></div>{article}</article>') == "Title here Search Earlier work. More."
    assert text(f'<article><div class="notice"><p>{long}</p></div><p>Few words.</p></article>') == "Few words."
    assert text(f"<p>{long}</p><p>Why so?</p><p>{long}</p>") == f"{long} Why so? {long}"
    links = "".join(f'<li><a href="/{i}">Other page</a></li>' for i in range(5))
    assert text(f"<article><p>{long}</p><ul>{links}</ul></article>") == long
    assert text(f'<p>{long}</p><div class="site-sidebar"><p>Buy it now</p></div><div class="comment-list"><p>First!</p></div>') == long


def test_queries(spark, sf_dir):
    """The whole small tables, with the rows that the contracts name."""
    from inkflow.llm import queries

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    wanted = {"op3_": pages, "op10": pages, "op11": 4 * vectors, "op13": vectors}
    for name, fn in queries.queries().items():
        rows = fn(spark, sf_dir).count()
        assert rows == wanted.get(name[:4], n) or name.startswith(("op2_", "op8_")), name


def test_pipeline(spark, sf_dir):
    """run() against the stages' own operators on its input, one after the other, by hand."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    scored = quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    left = sorted(r.doc_id for r in scored if r.predicted == 1)
    classes: dict[int, int] = {}
    for i in left:  # brute force: single linkage over all pairs
        classes[i] = i
        for j in left:
            if j >= i:
                break
            if classes[j] != classes[i] and neardup.similar(texts[i], texts[j]):
                a, b = sorted((classes[i], classes[j]))
                classes = {k: a if v == b else v for k, v in classes.items()}
    left = sorted(set(classes.values()))
    windows = {tuple(w) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in decontaminate.windows_of(decontaminate.words(r.text))}

    def has(t):
        ws = decontaminate.words(t)
        return any(tuple(ws[s : s + len(w)]) == w for w in windows for s in range(len(ws) - len(w) + 1))

    left = [i for i in left if not has(texts[i])]
    assert sorted({r.doc_id for r in out}) == left
    assert all(len(r.ids) == r.length for r in out)


def test_pipeline_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, a planted passage, and empty tables, through all stages."""
    import corpus_pipeline

    rng = random.Random(7)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(60)) for _ in range(30)]
    bad = [" ".join(rng.choice(["zz$$$", "qq%%%", "xx&&&"]) for _ in range(60)) for _ in range(30)]
    passage = "one two three four five six seven eight nine ten"
    rows = list(enumerate(good)) + [(100 + i, t) for i, t in enumerate(bad)] + [(200, good[0]), (0, good[0]), (201, good[1] + " " + passage), (202, LONG + "alpha of the beta"), (203, None), (204, ""), (None, good[2]), (205, good[3] + " mail me@host.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(x).alias(x) for x in ("lang", "source", "score", "predicted", "id", "key", "row", "digest", "h")), F.lit(1).cast("long").alias("n_chars"))
    labels = spark.createDataFrame([*[(i, 1, 0) for i in range(30)], *[(100 + i, 0, 0) for i in range(30)], (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, passage), (None, None)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    kept = {r.doc_id for r in out}
    assert {i for i in range(30)} <= kept | {2, 3} and 200 not in kept and 201 not in kept and not kept & set(range(100, 130)) and 202 in kept
    assert all(len(r.ids) == r.length for r in out) and len([r for r in out if r.doc_id == 0 and r.start == 0]) == 2  # repeated rows of a kept id
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_op1_rolls(spark):
    """Small files in order, a hot id over several of them, repeated rows, and starts without a gap."""
    rows = [(7, f"alpha beta {i % 30}") for i in range(300)] + [(i, f"gamma {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1))
    files = bitplanes.write_token_ids(docs, vocabulary(WORD_BPE), 2, shared_dir(spark, "t1"), roll_ids=100)
    found = bitplanes.document_ids(files).orderBy("start").collect()
    assert files.count() > 5 and max(r.n_ids for r in files.collect()) < 120
    ends = np.cumsum([r.n_tokens for r in found])
    assert [r.start for r in found] == [0, *ends[:-1].tolist()] and [r.doc_id for r in found] == sorted(i for i, _ in rows)
    want = sorted((i, zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, expected_ids(WORD_BPE, [t for _, t in rows], 2), strict=True))
    assert sorted((r.doc_id, r.ids_crc32) for r in found) == want


def test_op3_record_ids(spark):
    """No two records share an id, with null and repeated page_ids; every reference leads to a response of that payload."""
    import pyarrow.fs as pafs

    big, long = "<p>same</p>" * 200, "x" * 3_000_000
    data = [(None, "a", big), (None, "a", big), (None, "b", "y"), (1, "u", big), (1, "u", big), (2, "u", big), (3, "u", big), (3, "v", big), (3, "u", "other"), (4, "u", long), (5, "u", long)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("part", F.lit("clash")).withColumn("kind", F.lit(7))
    out = shared_dir(spark, "t3")
    manifest = warc.write_warc(pages, out, roll_bytes=1000)
    heads = []
    for r in manifest.collect():
        fs, _ = pafs.FileSystem.from_uri(out)
        heads += [h for h, _ in warc.parse_records(fs, r.path) if h["WARC-Type"] != "warcinfo"]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) == len(data)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            to = ids[h["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["X-Page-Id"] == h["X-Refers-To-Page-Id"] and to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_warc(manifest, out).collect())
    want = [(None, None), (None, None), (None, None), (1, 3), (1, 3), (2, 3), (3, None), (3, None), (3, None), (4, 5), (5, None)]
    assert kinds == sorted((str(i), "response" if to is None else "revisit", to) for i, to in want)
