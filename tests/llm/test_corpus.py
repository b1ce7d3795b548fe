"""Operators on whole corpora against plain versions: language, pages, archives, near duplicates, packing, the pipeline."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from kinfold.llm import jaccard, language, packing, quality, warc, wrapper
from kinfold.llm.common import documents
from kinfold.llm.queries import QUERIES
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    """{doc_id: (n, component)} by comparing all pairs; rows of (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)], default=d) if sets[i] else d) for i, (d, _) in enumerate(rows) if d is not None)


def test_near_duplicates(docs, empty):
    got = jaccard.near_duplicates(docs).filter("doc_id is not null").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.near_duplicates(empty).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    """Chains, hubs, sets within a shingle of the threshold, and a passage that all share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((12, 30, 110)))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join((passage if rng.random() < 0.5 else []) + copy)))
            base = copy if rng.random() < 0.5 else base
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    want = plain_components(rows)
    assert got == want and 12 < len({c for *_, c in want}) < len(rows)


def near_copies(rng, families, members, words, most):
    """Rows of families of copies with up to ``most`` words changed, some in chains, and a passage that half of all share."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice((3, 6, 11, 30))))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(families):
        base = [word() for _ in range(words)]
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join((passage if rng.random() < 0.5 else []) + copy)))
            base = copy if rng.random() < 0.2 else base
    return rows


@pytest.mark.parametrize("tile", [4, 16, 90])
def test_near_duplicates_in_tiles(spark, monkeypatch, tile):
    """Clusters of many tiles give what all pairs give; a text without id links two others."""
    monkeypatch.setattr(jaccard, "TILE_LEAST", tile)
    monkeypatch.setattr(jaccard, "TILE_MOST", tile)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    rows = near_copies(random.Random(tile), 2, 110, 120, 6)
    w = [f"w{i}" for i in range(90)]
    ends = [(5000, " ".join(w)), (None, " ".join(w[:88] + ["x", "y"])), (5001, " ".join(w[:83] + ["o", "p", "q"] + w[86:88] + ["x", "y"]))]
    rows += [(d, t) for d, t in ends]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() if r.doc_id is not None)
    want = plain_components(rows)
    assert got == want and 20 < len({c for *_, c in want}) < 200


def test_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the base."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rows = [(1, f"w x y {a}"), (2, "w x y " + a.translate(str.maketrans("ab", "ba"))), (3, f"W x  y {a}")]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_word_hashes_tell_words_apart():
    """Words of all lengths about the hash's steps, alike but for a byte, and the same words at other places."""
    words = sorted({"a" * n + x + "b" * m for n in (0, 1, 6, 7, 8, 9, 15, 16, 250, 256, 300) for m in (0, 1, 7, 8, 9) for x in ("", "c", "é", "日")} - {""})
    (x,), (y,) = jaccard.shingles([" ".join(words)], 1), jaccard.shingles(["  \n" + "\t ".join(words[::-1])], 1)
    assert len(x) == len(words) and (x == y).all() and not np.intersect1d(x, jaccard.shingles([" ".join(words)], 1, bytes(32))[0]).size


def test_count_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64) << np.uint64(2)
    sets = []
    for i in range(300):
        keep = base[rng.random(400) < rng.choice([0.3, 0.9, 0.97])]
        more = rng.integers(0, 1 << 62, 9000 if i % 60 == 0 else rng.integers(0, 30), dtype=np.uint64) << np.uint64(2)
        sets.append(np.unique(np.concatenate([keep, more])))
    counts = [jaccard.point(x, jaccard.GROUPS) for x in sets]
    assert (jaccard._points([jaccard._packed(c) for c in counts]) >= counts).all()
    for some in (sets, [x for x in sets if len(x) < 9000], sets[:1], []):
        n = np.array(list(map(len, some)), int)
        c = jaccard._points([jaccard._packed(jaccard.point(x, jaccard.GROUPS)) for x in some]) if some else np.zeros((0, jaccard.GROUPS), np.uint8)
        classes, sides = rng.integers(0, 9, len(some)), rng.integers(0, 3, len(some))
        for kinds, halves in ((None, None), (classes, None), (classes, sides)):
            got = [(min(p), max(p)) for i, j, _ in jaccard.CountTree(c, n, kinds, halves).pairs() for p in zip(i.tolist(), j.tolist(), strict=True)]
            apart = lambda i, j: (kinds is None or kinds[i] != kinds[j]) and (halves is None or halves[i] != halves[j] or halves[i] == 2)  # noqa: B023, E731
            want = {(i, j) for i in range(len(some)) for j in range(i + 1, len(some)) if apart(i, j) and np.minimum(c[i].astype(int), c[j]).sum() >= jaccard.least_shared(n[i], n[j])}
            assert len(got) == len(set(got)) and set(got) == want
            assert all((i, j) in want for i in range(len(some)) for j in range(i + 1, len(some)) if apart(i, j) and jaccard.linked(some[i], some[j]))
    assert 0 < len(want) if some else True


def test_language(docs, empty, spark, sf_dir):
    d = documents(spark, sf_dir)
    model = language.fit(d.filter("doc_id % 2 = 0"))
    rows = lambda x: x.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    held = language.scored(rows(d.filter("doc_id % 2 = 1 and length(text) > 100")), model)
    got = language.fuse(held, model, language.gather(held, model)).collect()
    assert np.mean([r.language == r.lang for r in got]) > 0.98
    odd = language.scored(docs.withColumns({"declared": F.col("lang"), "host": F.col("source")}), model)
    out = {r.doc_id: r for r in language.fuse(odd, model, language.gather(odd, model)).collect()}
    assert out[0].language == "und" and not out[0].kept and not out[2].kept and len(out) == docs.select("doc_id").distinct().count()
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    blank = language.scored(odd.drop("text_scores"), none)
    assert not any(r.kept for r in language.fuse(blank, none, language.gather(blank, none)).collect())
    nothing = language.scored(empty.withColumns({"declared": F.col("lang"), "host": F.col("source")}), model)
    assert language.fuse(nothing, model, language.gather(nothing, model)).count() == 0


def test_evidence_decides_where_text_does_not(spark):
    """Pages of two languages with one alphabet of words each; a page of neither is placed by markup and host."""
    rng = random.Random(1)
    speak = lambda w: " ".join(rng.choice(w) for _ in range(40))
    a, b = ["bacada", "fagaha", "jakala", "manapa"], ["rosoto", "vowoxo", "yozoco", "dofogo"]
    rows = [(i, speak(a), "aa", f"http://h{i % 3}.aa.org/x", '<html lang="aa">') for i in range(60)] + [(100 + i, speak(b), "bb", f"http://g{i % 3}.bb.net/x", '<html lang="bb-XX">') for i in range(60)]
    mixed = " ".join(a + b)
    rows += [(900, mixed, None, "http://h1.aa.org/y", '<html lang="aa">'), (901, mixed, None, "http://new.bb.net/y", '<HTML class=x lang=bb>')]
    df = spark.createDataFrame(rows, "id int, text string, lang string, url string, html string")
    model = language.fit(df)
    seen = language.scored(df.select("id", "text", language.markup_language(F.col("html")).alias("declared"), language.host_of(F.col("url")).alias("host")), model, keep=["id", "declared", "host"])
    out = {r.id: r for r in language.fuse(seen, model, language.gather(seen, model)).collect()}
    assert out[900].language == "aa" and out[901].language == "bb" and out[5].language == "aa" and out[105].language == "bb"


def article(source):
    a = source.split("<article>", 1)[1].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", a)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", b))).split()) for b in blocks) if x)


def test_pages(spark, sf_dir):
    pages = documents(spark, sf_dir, "pages")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = wrapper.extract(pages.withColumn("text", F.lit("clash")), keep=["page_id", "url", "text"]).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_wrapper_drops_constant_slots_without_tell_tale_names(spark):
    page = "<body><div class=x>Our site, {0} lines</div><div id=c><h2>Title {1}</h2><p>Body {1} &amp; more</p><p>{2}</p></div><table><tr><td>Same end</table>"
    rows = [(i, f"http://a.example/{i}", page.format("many", i, "last " * (i + 1))) for i in range(8)]
    rows += [(100, None, None), (101, "http://b.example/", ""), (102, "http://c.example/", "plain text &lt;only&gt;"), (103, "http://d.example/", "<p>one<p>two<div class='comments'>no</div><form>no</form><!-- no --><script>no</script>")]
    rows += [(104, "http://e.example/", "<div>" * 3000 + "deep"), (105, "http://f.example/", "<p title='a > b'>x</p><nav>no<ul><li>no</ul></nav><div class=cookie-notice>no</div>")]
    rows += [(200 + i, f"http://copies.example/{i}", page.format("many", 1, "x")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in wrapper.extract(df, keep=["page_id"]).collect()}
    assert all(got[i] == f"Title {i}\nBody {i} & more\n" + " ".join(["last"] * (i + 1)) for i in range(8))
    assert got[100] == got[101] == "" and got[102] == "plain text <only>" and got[103] == "one\ntwo" and got[104] == "deep" and got[105] == "x"
    assert "Body 1 & more" in got[202]
    assert wrapper.extract(df.limit(0)).count() == 0


def test_parts_of_a_page_by_role():
    page = "<html class='no-sidebar'><body class='page with-sidebar'><header>no</header><main class='has-ads'><article><header><h1>Yes</h1></header><p>body &eacute;\u00a0 x</p><p hidden>no</p><aside>no</aside><section id='comments'><article class='comment'>no</article></section></article></main><div role='complementary'>no</div><p>no"
    assert wrapper.main_text(page) == "Yes\nbody \u00e9 x"


def test_wrappers_merge_in_any_grouping():
    p = [wrapper.slots(wrapper.parse(f"<div class=a>same</div><div><p>{i}</p>" + "<p>x</p>" * i + "</div>")) for i in range(4)]
    one = wrapper.merged(wrapper.merged(wrapper.merged(p[0], p[1]), p[2]), p[3])
    two = wrapper.merged(wrapper.merged(p[0], p[1]), wrapper.load(wrapper.dump(wrapper.merged(p[2], p[3]))))
    assert wrapper.dump(one) == wrapper.dump(two) and one.n == 4 and one.kids[0].text is not None and one.kids[1].kids[0].text is None


def test_keys_with_control_characters_are_found(spark):
    """Tabs, line ends and other control characters in addresses, beside keys that begin with them, on one index part and several."""
    urls = [f"http://x.org/{c}{d}" for c in ("", "\t", "\n", "\r", "\x00", "\x0b", "\x1f", " ", "\x7f", "%09", "b") for d in ("", "z", "\x01")] + ["http://x.org/b", None, "", " "]
    df = spark.createDataFrame([(i, u, f"page {i % 20}") for i, u in enumerate(urls)] + [(3, urls[3], "page 3")], "page_id long, url string, html string")
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = warc.round_trip(spark, df).collect()
        assert sorted(r.page_id for r in got) == sorted([*range(len(urls)), 3]) and all(r.refers_to == (r.page_id % 20 if r.page_id >= 20 else None) for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_archives(spark):
    rows = [(i, f"http://{'abc'[i % 3]}.example.org/p{i % 7}?q={i}", f"<p>{i % 5}</p>" if i % 4 else f"own {i}") for i in range(400)]
    rows += [(None, "http://x.org/\tz", "<p>1</p>"), (None, None, "alone"), (500, None, None), (501, None, ""), (502, "ftp://x/ y\n", "ü"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    want = []
    for i, _, h in rows:
        data, first = (h or "").encode(), firsts.get(h or "")
        to = first if first is not None and i != first else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    key = lambda x: tuple((v is None, v) if v is not None else (True, 0) for v in x)
    got = [tuple(r) for r in warc.round_trip(spark, df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_index_blocks_and_payloads(spark, tmp_path):
    rows = [(i, f"http://h{i % 9}.example.org/{i}", f"page {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    captures = warc.write_archives(df, f"file://{tmp_path}/a")
    top = warc.build_index(captures, f"file://{tmp_path}/i", block_lines=16)
    wanted = df.filter("page_id % 97 = 0").select(warc.key_of(F.col("url")).alias("key"), "page_id")
    got = warc.lookup(wanted, top, f"file://{tmp_path}/i", f"file://{tmp_path}/a", with_payload=True).collect()
    assert {(r.page_id, bytes(r.payload)) for r in got} == {(i, f"page {i}".encode()) for i in range(0, 1000, 97)}
    index = warc.Index(top, f"file://{tmp_path}/i", f"file://{tmp_path}/a")
    assert index.find("org,example,h1)/none 1") == [] and index.find("") == [] and index.find("zzz") == []


def check_packing(rows, ids_of, capacity=packing.CAPACITY):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, own in by_doc.items():
        ids = ids_of(d)
        spots = Counter((r.piece, r.start, r.length) for r in own)
        copies = set(spots.values())
        assert len(copies) == 1 and sorted(spots) == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda x: x.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence), sum(r.length for r in rows)


class Counting:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, inner):
        self.inner, self.strings = inner, 0

    def encode_batch_fast(self, strings, **options):
        self.strings += len(strings)
        return self.inner.encode_batch_fast(strings, **options)


def test_chunks_are_encoded_end_to_end(texts, vocab):
    from tokenizers import Tokenizer

    path = vocab("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    many = [*texts, *[" ".join(f"w{i}x{k}," for i in range(400)) for k in range(5)], "a  b \n c\t d ", " <|endoftext|> x<|endoftext|>  y"]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in many]
    made = packing.Encoder(path)
    made.tokenizer = Counting(made.tokenizer)
    assert [bytes(x) for x in made.encode(many)] == want
    assert made.tokenizer.strings < 100  # the first chunks of texts, and the others end to end
    before = made.tokenizer.strings
    assert made.encode(many) == want and made.tokenizer.strings - before <= len(many)  # what was met is kept
    small = packing.Encoder(path, 1 << 10)  # nearly nothing is kept
    assert [small.encode(many[i : i + 3]) for i in range(0, len(many), 3)] == [want[i : i + 3] for i in range(0, len(many), 3)]
    small.clear()
    small.bytes_of[:] = 7  # where ids don't come apart between chunks, each is encoded by itself
    assert small.encode(many) == want


def test_packing(docs, empty, texts, vocab):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    ids = lambda d: library.encode("no id at all " * 20 if d is None else texts[d] or "", add_special_tokens=False).ids + [2]
    got = packing.packed(docs, vocab("byte_bpe_50k.json"), keep=["doc_id"]).collect()
    n, tokens = check_packing(got, ids)
    assert n <= -(-tokens // packing.CAPACITY) + 1
    assert packing.packed(empty, vocab("byte_bpe_50k.json")).count() == 0


def test_plan_uses_up_the_histogram_tightly():
    rng = random.Random(0)
    for capacity in (10, 64, 1024):
        for _ in range(5):
            h = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, 40))}
            plan = packing.plan(h, capacity)
            used = Counter()
            for held, times in plan:
                assert 0 < sum(held) <= capacity and times > 0
                for n in held:
                    used[n] += times
            assert used == Counter(h)
    h = {n: 20 for n in range(1, 700)}
    assert sum(t for _, t in packing.plan(h, 1024)) <= 1.02 * sum(n * c for n, c in h.items()) / 1024 + 1
    assert packing.plan({}, 8) == [] and packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]


def test_best_two_fit_tightens():
    # greedy gives 6 + 3 of 10; the 3 gives way to 2 + 2
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    kind = name.split("_")[0]
    if kind == "op11":  # anchors are asked for; each that has a result is one
        anchors = documents(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select("vec_id")
        assert 0 < got.select("anchor_id").distinct().count() == got.select("anchor_id").distinct().join(anchors, got.anchor_id == anchors.vec_id).count()
        return
    if kind == "op13":  # all conversations are members of the root
        assert got.filter("depth = 0").first().n_convs == documents(spark, sf_dir, "conversations").select("conv_id").distinct().count()
        return
    table, id_ = ("pages", "page_id") if kind in ("op5", "op6", "page") else ("documents", "doc_id")
    assert got.select(id_).distinct().count() == documents(spark, sf_dir, table).select(id_).distinct().count()


def test_pipeline(spark, sf_dir, vocab):
    """Each stage against a plain version on what the stage before kept."""
    import corpus_pipeline as P
    from kinfold.llm import secrets
    from test_whole import components_by_all_pairs
    from tokenizers import Tokenizer

    docs, labels = documents(spark, sf_dir), {r.doc_id: r.quality for r in documents(spark, sf_dir, "labels").collect()}
    stage = dict(P.STAGES)
    good = P.written(stage["quality_rules"](spark, docs, sf_dir))
    kept = {r.doc_id for r in good.collect()}
    for r in docs.collect():
        s = quality.text_statistics(r.text)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert not (failed and r.doc_id in kept) and (failed or labels.get(r.doc_id) != 1 or r.doc_id in kept)
    known = P.written(stage["language_id"](spark, good, sf_dir))
    assert {r.doc_id for r in known.collect()} == kept
    single = P.written(stage["near_duplicates"](spark, known, sf_dir))
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(components_by_all_pairs(rows, P.SHINGLE, P.RATIO).values()))
    clean = P.written(stage["secret_scan"](spark, single, sf_dir))
    assert {r.doc_id: r.text for r in clean.collect()} == {r.doc_id: secrets.redact(r.text) for r in single.collect()}
    assert all(x.columns == docs.columns for x in (good, known, single, clean))
    library = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    check_packing(stage["best_fit_packing"](spark, clean, sf_dir).collect(), lambda d: library.encode(texts[d], add_special_tokens=False).ids + [2])
    assert P.run(spark, sf_dir).count() > 0


def test_language_stage_drops_what_is_no_language_of_the_labels(spark, sf_dir):
    import corpus_pipeline as P

    rng = random.Random(6)
    docs = documents(spark, sf_dir)
    odd = [(10_000 + i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)), None, None, 300) for i in range(4)] + [(10_010, None, None, None, 0), (10_011, "", "en", None, 0)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in dict(P.STAGES)["language_id"](spark, both, sf_dir).select("doc_id").collect()}
    assert not kept & {r[0] for r in odd}
    assert {r.doc_id for r in docs.filter("length(text) > 200").select("doc_id").collect()} <= kept


def test_pages_declare_their_language(spark, sf_dir):
    """Markup and hosts as evidence: what the text leaves open goes by them, and a long text goes by itself."""
    from kinfold.llm.queries import page_evidence

    docs = documents(spark, sf_dir)
    model = language.fit(docs)
    long = {r.lang: r.t for r in docs.filter("length(text) > 400").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    first, second = sorted(x for x in long if x in model.languages)[:2]
    page = lambda lang, body: f"<html lang='{lang}-XX'><head><style>p {{}}</style><script>var the = 'of';</script></head><body><p>{body}</p></body></html>"
    rows = [(i, f"http://one.{first}/{i}", page(first, long[first] + f" {i}")) for i in range(30)] + [(100 + i, f"http://two.{second}/{i}", page(second, long[second] + f" {i}")) for i in range(30)]
    rows += [(200, f"http://one.{first}/x", page(first, "ok")), (201, f"http://new.{second}/x", page(second, "ok")), (202, f"http://one.{first}/y", page(first, long[second])), (203, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = page_evidence(pages)
    assert {r.page_id: (r.declared, r.host) for r in seen.filter("page_id in (0, 203)").collect()} == {0: (first, f"one.{first}"), 203: (None, None)}
    scored = language.scored(seen, model, keep=["page_id", "declared", "host"])
    got = {r.page_id: r.language for r in language.fuse(scored, model, language.gather(scored, model)).collect()}
    assert got[200] == first and got[201] in (second, "und") and got[202] == second and got[203] == "und" and got[0] == first and got[100] == second


def test_pipeline_stages_take_odd_tables(spark, docs, empty, sf_dir):
    import corpus_pipeline as P

    for table in (docs, empty):
        now = table
        for name, stage in P.STAGES:
            now = P.written(stage(spark, now, sf_dir), name)
            assert name == P.STAGES[-1][0] or now.columns == table.columns


def test_blocks_across_batch_ends(spark):
    """Blocks are the same however the sorted stream is cut into batches."""
    rng = random.Random(11)
    rows = [(rng.randrange(-9, 9), bytes([rng.randrange(12)]) * 16) for _ in range(160)] + [(77, b"z" * 16)] * 5 + [(78, bytes([i]) * 16) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, bytearray(k)) for t, k in rows], "token long, key binary")
    held = defaultdict(set)
    for t, k in rows:
        held[t].add(k)
    want = {(t, k, min(ks), len(ks) >= 3) for t, ks in held.items() if len(ks) > 1 for k in ks}
    for size in (1, 2, 3, 7, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [(r.token, bytes(r.key), bytes(r.first), r.large) for r in jaccard._blocks(df).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and {x[:3] for x in got} == {x[:3] for x in want}
        assert {x for x in got if not x[3]} <= want
