"""Token counts, piece models, personal data, near duplicates, media: exactness and odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from notelattice.llm import jaccard_join, pii, piece_model, token_counts, webp
from notelattice.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a  b ", "\n\n x\r\n", "a<|endoftext|>b", "it's we'll I'LL '' x", "é漢字 \U0001f600 \u0085 　", "x" * 5000, "word " * 20000, "call +1 (030) 555-1234 or a.b@c.de.", "same text here and there", "same text here and there"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, "n", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")


def test_token_counts(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    for docs in (table(spark, sf_dir, "documents"), odd):
        want = Counter((d["doc_id"], len((d["text"] or "").encode()), n := len(tok.encode(d["text"] or "", add_special_tokens=False)), n > 512) for d in docs.collect())
        assert Counter(map(tuple, token_counts.token_counts(docs, BPE).collect())) == want
    assert token_counts.token_counts(odd.limit(0), BPE).count() == 0


def test_pre_tokens_of_every_character():
    from tokenizers import Tokenizer

    tok, mine = Tokenizer.from_file(BPE), token_counts.PieceTable(BPE, known=50_000)
    texts = [f"a{c}b {c} 1{c}{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x1FB00)])]
    for i in range(0, len(texts), 8000):
        part = texts[i : i + 8000]
        assert mine.counts(part) == [len(e) for e in tok.encode_batch(part, add_special_tokens=False)]


def test_pieces(spark, sf_dir, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (table(spark, sf_dir, "documents"), odd):
        rows = piece_model.encode_texts(docs, PIECES).collect()
        want = Counter((d["doc_id"], tuple(sp.encode(d["text"] or ""))) for d in docs.collect())
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
        assert all(r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_pieces_of_random_texts(monkeypatch):
    import sentencepiece

    sp, mine = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_model.Codec(PIECES)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ▁\n\ré漢\U0001f600{};()t hein  ,.1'²_") for _ in range(60)) for _ in range(2000)]
    texts += texts[:5]
    assert mine.units and mine.units.classes.max() == 2 and mine.encode(texts) == sp.encode(texts)
    ids, bounds, same, back = mine.batch(texts)
    assert same.all() and back == mine.decode([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])])
    # parts of a text give the ids of the whole
    longer = [" ".join(texts[i : i + 40]) for i in range(0, 800, 40)] + ["word " * 300, " " * 300, "x" * 300, ""]
    want = mine.batch(longer)
    assert all(len(mine.parts(t, 50)) > 5 for t in longer[:21])
    got = mine.batch(longer, chars=50)
    assert got[2].all() and got[3] == want[3] and all((a == b).all() for a, b in zip(got[:2], want[:2])) and mine.encode(longer) == sp.encode(longer)
    # units that are forgotten again and again, and none at all
    monkeypatch.setattr(piece_model, "KNOWN", 50)
    mine.units.forget()
    assert [mine.encode(texts[i : i + 7]) for i in range(0, 700, 7)] == [sp.encode(texts[i : i + 7]) for i in range(0, 700, 7)]
    assert [a == b for a, b in zip(mine.decode(mine.encode(texts)), texts)] == ["▁" not in t for t in texts]
    mine.units = None
    assert mine.encode(texts) == sp.encode(texts) and mine.batch(longer)[2].all() and mine.batch(longer)[3] == want[3]


def test_parity_is_of_the_whole_text():
    """Libraries that agree on each word, but not on a text of two, are told apart."""

    class Peer:
        def encode(self, texts, num_threads):
            return [[*ids, 0] if " " in t else ids for t, ids in zip(texts, real.encode(texts), strict=True)]

    mine = piece_model.Codec(PIECES)
    real, mine.peer = mine.peer, Peer()
    assert mine.batch(["one", "two", "one two", "one"])[2].tolist() == [True, True, False, True]


def field_bytes(number, kind, value):
    def varint(v):
        out = b""
        while v > 127:
            out += bytes([v & 127 | 128])
            v >>= 7
        return out + bytes([v])

    return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else value if kind == 5 else varint(value))


def test_unigram_models(tmp_path):
    import struct

    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁the", "▁", "t", "h", "e", "th", "he", "▁t", "en", "n", "▁then", "a", "▁a"])]
    raw = b"".join(field_bytes(1, 2, field_bytes(1, 2, p.encode()) + field_bytes(2, 5, struct.pack("<f", s)) + field_bytes(3, 0, k)) for p, s, k in pieces)
    raw += field_bytes(2, 2, field_bytes(3, 0, 1) + field_bytes(35, 0, 1)) + field_bytes(3, 2, field_bytes(1, 2, b"identity") + field_bytes(3, 0, 1) + field_bytes(4, 0, 0))
    (tmp_path / "m.model").write_bytes(raw)
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), piece_model.Codec(str(tmp_path / "m.model"))
    texts = ["the then hen", "a the  xé", "", "thethe then"]
    assert mine.model.kind == piece_model.UNIGRAM and mine.encode(texts) == sp.encode(texts)


def plain_spans(t):
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1." * 500_000, "1.2.3 " * 170_000, "12 " * 330_000, "+1" + "(" * 1_000_000, "a@" * 500_000, "123-" * 250_000])
def test_patterns_take_time_in_proportion(text):
    began = time.monotonic()
    pii.base_spans(text)
    assert time.monotonic() - began < 10  # minutes where a pattern starts anew at each digit


def test_addresses_match_as_the_plain_pattern_does():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("0123..a") for _ in range(rng.randint(0, 24)))
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]


def test_pii(spark, sf_dir, odd):
    for docs in (table(spark, sf_dir, "documents"), odd):
        want = Counter()
        for d in docs.collect():
            s = plain_spans(d["text"] or "")
            want[(d["doc_id"], *(sum(x[0] == k for x in s) for k in pii.BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
        rows = pii.find_pii(docs).collect()
        assert Counter(tuple(r)[:6] for r in rows) == want
    assert pii.redact(odd).columns == odd.columns
    clean = [r["text"] for r in pii.redact(odd).collect()]
    assert clean[0] is None and clean[10] == "call <PHONE> or <EMAIL>." and clean[9] == TEXTS[9]


def test_base_spans_of_random_texts():
    rng = random.Random(0)
    for _ in range(4000):
        t = "".join(rng.choice("a.@b-+ 1234567890.@-(٣é") for _ in range(60))
        assert pii.base_spans(t) == plain_spans(t)


def test_field():
    f = pii.field()
    for ws, ys in pii.labelled_rows():
        ids, length = f.encode([pii.word_features(ws)])
        assert f.viterbi(ids, length)[0].tolist() == ys
    unseen = ['the token = "5e884898da28047151d0e56f8dc6292773603d0d" of it', "mail eva at inbox dot org now", "his ssn 078-05-1120 leaked", "call (040) 555-0177 soon"]
    kinds = [[k for k, _, _ in s] for _, s in pii.all_spans(unseen, f)]
    assert kinds[0] == ["secret"] and kinds[2] == ["id"] and kinds[3] == ["phone"]
    assert all(not s for _, s in pii.all_spans(["In 2019 there were 12 of 30, version 2.0.", "On 3 May 2021, 45 people left."], f))


def test_viterbi_is_the_best_path():
    f = pii.field()
    rng = np.random.default_rng(1)
    ids = rng.integers(0, len(f.index), (5, 3, 4))
    s = f.emit[ids].sum(2)
    k = len(pii.LABELS)
    for n in range(5):
        best = max(((f.trans[-1, a] + s[n, 0, a] + f.trans[a, b] + s[n, 1, b] + f.trans[b, c] + s[n, 2, c], (a, b, c)) for a in range(k) for b in range(k) for c in range(k)))
        assert tuple(f.viterbi(ids[n : n + 1], np.array([3]))[0]) == best[1]


def grams(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows):
    """(links by id, groups by id) of rows with ids."""
    sets = {d["doc_id"]: grams(d["text"]) for d in rows}
    ids, held = sorted(sets), defaultdict(set)
    for i in ids:
        for g in sets[i]:
            held[g].add(i)
    links = {i: set() for i in ids}
    for i in ids:
        near = set().union(*(held[g] for g in sets[i])) if sets[i] else {j for j in ids if not sets[j]}
        for j in near - {i}:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
    group = {}
    for i in ids:
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += links[x]
    return {i: len(v) for i, v in links.items()}, group


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(90):  # a chain of near copies that spans blocks
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{rng.randrange(50)}" for _ in range(30))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, "one two"), (204, "two one"), (205, rows[3][1]), (206, " " + rows[3][1].replace(" ", "\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(docs).collect()}
    links, group = brute_links(docs.collect())
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["group_id"] for i, r in got.items()} == group
    kept = jaccard_join.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group.values()))


def test_jaccard_join_of_a_chain(spark, monkeypatch):
    """Windows over one long text: neighbours are linked, the ends share nothing. Its buckets meet for
    themselves, and a pair that shares several of them counts once; the group of near copies beside it
    meets as a whole."""
    words = [f"w{i}" for i in range(1400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(300)]
    rows += [(1000 + i, " ".join([f"h{k}" for k in range(200)] + [f"z{i}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    ways, plain = set(), jaccard_join.verify

    def verify(members):
        ways.update((r["v"], r["apart"]) for r in members.select("m.v", F.expr("m.places[0].tree >= 0").alias("apart")).collect())
        return plain(members)

    monkeypatch.setattr(jaccard_join, "verify", verify)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(docs).collect()}
    links, group = brute_links(docs.collect())
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["group_id"] for i, r in got.items()} == group
    assert Counter(apart for _, apart in ways) == {True: 300, False: 60}


def test_jaccard_join_of_the_table(spark, sf_dir):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    links, group = brute_links(docs.collect())
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(docs).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * sum(links.values()) and all(r["n_links"] <= links[i] for i, r in got.items())


def test_jaccard_join_of_odd_rows(spark, odd):
    rows = jaccard_join.jaccard_join(odd).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r["n_copies"] for r in rows) == sorted([3] * 3 + [2] * 2 + [1] * 8)
    same = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "q", "y"), (None, "q", "y")], "doc_id long, text string, h string")
    kept = jaccard_join.keep_one(same)
    assert kept.columns == same.columns and sorted((r["h"] for r in kept.collect())) == ["x", "y"]
    assert jaccard_join.jaccard_join(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)} | {(i, i + 1) for i in range(100, 140)}
    root = {}
    for x in {v for e in edges for v in e}:
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += [b if a == y else a for a, b in edges if y in (a, b)]
        root[x] = min(seen)
    got = {r["v"]: r["c"] for r in jaccard_join.components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert got == {v: c for v, c in root.items() if v != c}


def test_media(spark, sf_dir, odd):
    for docs in (table(spark, sf_dir, "documents"), odd):
        want = Counter()
        for d in docs.collect():
            p = webp.padded(d["text"] or "")
            want[(d["doc_id"], len((d["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
        rows = webp.media_digests(docs).collect()
        assert Counter(tuple(r)[:5] for r in rows) == want
    assert webp.media_digests(odd.limit(0)).count() == 0


def grey(h, w, k, seed=0):
    img = np.random.default_rng(seed).integers(0, k, (h, w)).astype(np.uint32) * np.uint32(0x01030507) | np.uint32(0xFF000000)
    img[h // 2 : h // 2 + 2] = img[:2]
    return img


CASES = [((), 0, 256, 0), ((), 4, 5, 0), ((2,), 0, 200, 0), ((1,), 3, 200, 0), ((0, 1, 2), 5, 200, 12), ((3,), 0, 2, 0), ((3,), 2, 4, 0), ((3,), 0, 15, 0), ((3,), 0, 100, 0), ((3, 0), 0, 12, 7)]


@pytest.mark.parametrize("transforms,cache,colours,mode", CASES + [((0,), 2, 180, m) for m in range(14)])
def test_images(transforms, cache, colours, mode):
    img = grey(13, 17, colours)
    raw = webp.encode_image(img, transforms, cache, mode)
    assert [np.array_equal(webp.decode(s), img) for s in webp.streams(raw)] == [True]


def test_known_image():
    """A 1 x 1 image whose bits were laid out by hand: five simple codes of one symbol each."""
    bits = [(0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for s in (0x22, 0x11, 0x33, 0xFF):  # green, red, blue, alpha
        bits += [(1, 1), (0, 1), (1, 1), (s, 8)]
    bits += [(1, 1), (0, 1), (0, 1), (0, 1)]
    value = size = 0
    for v, n in bits:
        value |= v << size
        size += n
    assert webp.decode(value.to_bytes((size + 7) // 8, "little")).tolist() == [[0xFF112233]]


def test_payloads_both_ways():
    """The numpy walk and the symbol by symbol reader agree on every stored payload."""
    rng = np.random.default_rng(3)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 3, 40)]
    payloads += [webp.padded(t) for t in ("", "the same line again\n" * 200, "漢字かな " * 70, "A mixed text, é and so on. " * 9)]
    for p, media in zip(payloads, webp.encode_payloads(payloads), strict=True):
        assert webp.samples(media) == p
        (stream,) = webp.streams(media)
        plan, at = webp.plan_of(stream)
        r = webp.Reader(stream)
        r.at = at
        slow = plan.undo(r.pixels(plan.coded_width, webp.size_of(stream)[1], plan.groups, None, 0, plan.cache))
        assert (slow & 255).astype(np.uint8).tobytes() == p
    big = b"0123456789abcdef" * (1 << 17)
    assert webp.samples(webp.encode_payloads([big])[0]) == big


def test_broken_streams():
    (stream,) = webp.streams(webp.encode_payloads([webp.padded("some text " * 50)])[0])
    for bad in (stream[: len(stream) // 2], b"\0" + stream[1:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_extra_columns(spark, odd):
    wide = odd.withColumn("ids", F.lit(1)).withColumn("media", F.lit("x")).withColumn("th", F.lit(2)).withColumn("size", F.lit("s"))
    assert piece_model.encode_texts(wide, PIECES).count() == webp.media_digests(wide).count() == jaccard_join.jaccard_join(wide).count() == len(TEXTS)
