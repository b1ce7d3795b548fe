"""Operators on single texts against plain versions: statistics, secrets, tokens, codecs, TIFF."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from kinfold.llm import quality, secrets, tiff, tokens, treebpe
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_statistics(docs, texts, empty):
    def plain(t):
        t = t or ""
        w = WORD.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(tri)
        rep = {i + j for i, x in enumerate(tri) if c[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(rep), len(lines)

    for r in quality.with_statistics(docs, keep=["doc_id", "text", "n_words"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == plain(r.text)
    assert quality.with_statistics(empty).count() == 0


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    rules = quality.learn(x, y, ["a", "b", "c"])
    said = np.zeros(len(y), bool)
    for r in rules.rules:
        hit = np.ones(len(y), bool)
        for n, above, t in r.conditions:
            v = x[:, "abc".index(n)]
            hit &= v >= t if above else v < t
        said |= hit
    assert (said == y).mean() > 0.985 and (y[said]).mean() > 0.97
    assert quality.learn(x[:0], y[:0], ["a", "b", "c"]).rules == [] and quality.learn(x, np.zeros(3000, bool), ["a", "b", "c"]).rules == []


def test_decision_list_on_held_out_documents(spark, sf_dir):
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_from(d.filter("doc_id % 2 = 0"), lab)
    got = quality.judged(quality.with_statistics(d.filter("doc_id % 2 = 1"), keep=["doc_id"]), rules).filter("not base_failed").join(lab, "doc_id").collect()
    assert all(r.kept for r in got if r.quality == 1)
    assert quality.learn_from(d, lab.limit(0)).rules == []


def test_base_secrets(docs, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for t in [*texts, "PassWord: 'abcdefghijkl'", "api_key=short", "APIKEY = aaaabbbbccccd", "x" * 3 + "0123456789abcdef" + "g", "AKIA" + "A" * 13, "AKIA" + "A" * 14]:
        t = t or ""
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base, every = secrets.all_spans(t)
        assert base == sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0]))) and set(base) <= set(every)
    found = {r.doc_id: r.secrets for r in secrets.scan(docs, keep=["doc_id"]).collect()}
    assert found[0] == [] and found[1] == [] and {s.kind for s in found[13]} == {"assign", "hex"} and found[14][0].kind == "access"


def test_entropy_by_increments_and_allow_list():
    rng = random.Random(2)
    for n in (19, 20, 21, 200):
        s = "".join(rng.choice("abcd0123XYZ") for _ in range(n))
        want = [-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(n - 19)]
        assert secrets.entropy_windows(s) == pytest.approx(want)
    key = "q7Zp2LkV9xTr4WmB8sYd1NcH"
    assert secrets.entropy_spans(f"see {key} here") == [(4, 28)]
    for quiet in ("antidisestablishmentarianisms" * 2, "550e8400-e29b-41d4-a716-446655440000", "1234567890" * 4, "some/long/path-of-plain-words", "example" + key):
        assert secrets.entropy_spans(f"see {quiet} here") == []


def test_redaction(docs):
    out = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert secrets.redacted(docs).columns == docs.columns and out[0].text is None and out[1].text == ""
    assert out[13].text.startswith("[assign removed]") and "04dbeb" not in out[13].text and out[7].text == docs.filter("doc_id = 7").first().text


def test_token_counts(docs, texts, vocab):
    library = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    got = tokens.token_counts(docs, vocab("byte_bpe_50k.json"), keep=["doc_id"]).filter("doc_id is not null").collect()
    assert len(got) == len(texts) + 2 and all(r.n_tokens == want[r.doc_id] and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in got)


def test_merging_whole_sequences(vocab):
    rng = random.Random(3)
    m = tokens.RankMerger(vocab("byte_bpe_50k.json"))
    ranks = treebpe.load_ranks(vocab("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    seqs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for alphabet in ("a", "ab", "theandiong ", "é日x1 ") for _ in range(150)]
    symbols = [None] * len(seqs)
    counts = m.counts([s.encode() for s in seqs], symbols)
    assert symbols == [library.encode_ordinary(s) for s in seqs] and counts.tolist() == list(map(len, symbols))


def test_tree_codec(docs, texts, vocab):
    import public_tokenizers

    path = vocab("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=treebpe.load_ranks(path), special_tokens={})
    rng = random.Random(4)
    own = treebpe.codec(path)
    odd = ["".join(rng.choice("ab \n\tsé9.'") for _ in range(rng.randint(1, 90))) for _ in range(800)] + ["".join(rng.choice("theandiongs") for _ in range(700)) for _ in range(40)]
    for t in [*odd, *texts]:
        ids = own.encode([t])[0]
        assert ids == library.encode_ordinary(t or "") and own.bpe.decode(ids) == (t or "").encode()
    got = treebpe.round_trip(docs, path, keep=["doc_id"]).filter("doc_id is not null").collect()
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    whole = treebpe.decoded(treebpe.encoded(docs.select("doc_id", "text"), path), path).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in whole)


def test_every_token_encodes_to_itself_and_joins_are_a_monoid(vocab):
    bpe = treebpe.TreeBPE(vocab("byte_bpe_50k.tiktoken"))
    assert all(bpe._merge_long(w) == [i] for w, i in list(bpe.ranks.items())[::7])
    rng = random.Random(6)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("theandaio") for _ in range(rng.randint(0, 40))).encode() for _ in range(3))
        left = bpe.join(bpe.join(bpe.encode(a), bpe.encode(b)), bpe.encode(c))
        assert left == bpe.join(bpe.encode(a), bpe.join(bpe.encode(b), bpe.encode(c))) == (bpe._merge_long(a + b + c) if a + b + c else [])


@pytest.mark.parametrize("layouts", [tiff.LAYOUTS, ((1, 1, False),), ((5, 2, True),), ((32773, 2, False),)])
def test_tiff_round_trip(layouts):
    rng = random.Random(8)
    for n in (0, 1, 191, 192, 193, 12288, 30001):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            payload = data + b" " * (-n % 192 if n else 192)
            assert b"".join(p.pixels for p in tiff.decode(tiff.encode(payload, layouts))) == payload
            assert tiff.unlzw(tiff.lzw(data), n) == data and tiff.unpackbits(tiff.packbits(data), n) == data


def test_tiff_big_endian_planar_16_bit():
    import struct

    image = np.arange(2 * 4 * 2, dtype=np.uint16).reshape(2, 4, 2) * 999
    blocks = [zlib.compress(np.concatenate([image[:, :1, s], np.diff(image[:, :, s].astype(np.int32), axis=1).astype(np.uint16)], 1).astype(">u2").tobytes()) for s in range(2)]
    at = [8, 8 + len(blocks[0])]
    start = at[1] + len(blocks[1]) + sum(map(len, blocks)) % 2
    entries = [(256, 3, 1, 4), (257, 3, 1, 2), (258, 3, 2, (16, 16)), (259, 3, 1, 8), (273, 3, 2, tuple(at)), (277, 3, 1, 2), (278, 3, 1, 2), (279, 3, 2, tuple(map(len, blocks))), (284, 3, 1, 2), (317, 3, 1, 2)]
    body = b"MM\0*" + struct.pack(">I", start) + b"".join(blocks)
    body = body.ljust(start, b"\0") + struct.pack(">H", len(entries))
    for tag, kind, n, v in entries:
        v = v if isinstance(v, tuple) else (v, 0)
        body += struct.pack(">HHIHH", tag, kind, n, *v)
    (page,) = tiff.decode(body + b"\0\0\0\0")
    assert np.array_equal(np.frombuffer(page.pixels, "<u2").reshape(2, 4, 2), image)


def test_tiff_rows(spark, docs, texts, empty):
    stored = tiff.with_media(docs, keep=["doc_id", "n_words"])
    for r in tiff.digests(stored, keep=["doc_id"]).filter("doc_id is not null").collect():
        p = tiff.padded(texts[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), None)
    pages = tiff.pages(stored.filter("doc_id = 19"), keep=["doc_id"]).orderBy("page").collect()
    assert b"".join(bytes(r.pixels) for r in pages) == tiff.padded(texts[19]) and {r.compression for r in pages} == {5, 8, 32773}
    good = tiff.encode(b"x" * 192)
    at = int.from_bytes(good[4:8], "little")
    link = at + 2 + 12 * int.from_bytes(good[at : at + 2], "little")
    loop = good[:link] + good[4:8] + good[link + 4 :]
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"nothing")), (3, bytearray(good[:40])), (4, bytearray(loop))], "id int, media binary")
    assert sorted((r.id, r.page, r.error) for r in tiff.pages(bad).filter("error is not null").collect()) == [(2, 0, "not TIFF"), (3, 0, "cut short"), (4, 1, "directories loop")]
    assert tiff.pages(bad).filter("error is null").count() == 1
    assert tiff.digests(bad).count() == 4 and tiff.with_media(empty).count() == 0


def test_chunks_are_bounded_by_bytes(vocab):
    """Long texts with two spaces in a row leave little behind; what is kept stays within its bound and is right after it was let go."""
    from kinfold.llm.pretoken import LONG, Chunks, pattern

    rng = random.Random(3)
    split = pattern().findall
    own = Chunks(lambda chunks: [tuple(split(c)) for c in chunks], most=200_000)
    for _ in range(30):
        texts = ["  ".join("".join(rng.choice("abcdefg") for _ in range(rng.choice((2, 5, 90)))) for _ in range(400)) for _ in range(8)]
        texts += ["", " ", "  ", "a ", " a", "\n a  \n b", "x \t y\u3000 z  "]
        assert [[t for c in x for t in c] for x in own.of(texts)] == [split(t) for t in texts]
        assert all(len(x) <= LONG for h in (own.inner, own.first) for x in (*h.now, *h.old)) and own.size < 1_500_000
    own.clear()
    assert own.of([]) == [] and not own.inner.now and not own.inner.old and not own.size
