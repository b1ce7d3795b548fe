"""Cases that cuts would miss: each against a plain version or a result known by construction."""

import random

import pytest
from kinfold.llm import jaccard, wrapper
from test_corpus import shingle_set


def components_by_all_pairs(rows, k, ratio):
    """{doc_id: the least doc_id of its component}; rows of (doc_id, text)."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    label = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            c = len(sets[a] & sets[b])
            if a < b and c and ratio[1] * c >= ratio[0] * (len(sets[a]) + len(sets[b]) - c):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return label


@pytest.mark.parametrize("changed", [4, 5, 6])
def test_pipeline_links_five_words_at_four_fifths(spark, changed):
    """Copies of 200 words with scattered changes: similarities of five words on both sides of 0.8, of four words under 0.85."""
    import corpus_pipeline as P

    rng = random.Random(changed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(200)]
        copy = list(base)
        for at in range(10, 10 + 30 * changed, 30):
            copy[at] = word()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in dict(P.STAGES)["near_duplicates"](spark, df, "").collect()}
    assert got == set(components_by_all_pairs(rows, 5, (80, 100)).values())
    assert len(got) == (6 if changed == 4 else 12)


def lost_link(salt):
    """Documents f, i, j, j2 and others, as sets of words: i-j2 and j-j2 are links, i-j is none, though j's nearest; what i and j2 are found by f has too."""
    some = lambda name, n: [f"{salt}{name}{x}" for x in range(n)]
    both, not_j, ij, all4, jj2 = some("core", 1578), some("notj", 112), some("ij", 100), some("all", 40), some("jj", 15)
    filler = some("filler", 300)
    sets = [all4 + filler, both + not_j + ij + all4 + some("i", 170), both + ij + all4 + jj2 + some("j", 10), both + not_j + all4 + jj2 + some("jtwo", 15)]
    return sets + [both + not_j + filler + some(f"dummy{d}x", 1000) for d in range(5)]


def test_a_refused_pair_does_not_end_the_search(spark):
    for salt in range(3000):
        # the order of keys that puts f first in its blocks, then i, then j
        names = [jaccard.key_of(x) for x in jaccard.shingles([" ".join(x) for x in lost_link(salt)[:4]], 1)]
        if names == sorted(names):
            break
    rows = list(enumerate(" ".join(x) for x in lost_link(salt)))
    want = components_by_all_pairs(rows, 1, jaccard.RATIO)
    assert want[1] == want[2] == want[3] == 1 and want[0] == 0
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), k=1, secret=jaccard.KEY)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_large_wrappers_count_all_pages(spark):
    """Over 2000 nodes that two pages each have, and then template blocks that come late: every node is counted on every page."""
    letters = lambda x: "".join(chr(97 + x // 26**i % 26) for i in range(3))
    many = "".join(f"<div class=q{letters(x)}><p>{x}</p></div>" for x in range(1100))
    late = [f"<section class=late>Late template</section><div class=body><p>Story {i}</p></div>" for i in range(4)]
    rows = [("http://h.example/", x) for x in [many, many, *late]]
    for parts in (1, 3, 6):
        (r,) = wrapper.induce(spark.createDataFrame(rows, "url string, html string").repartition(parts)).collect()
        made = wrapper.load(r.wrapper)
        found = [k for k in made.kids if k.key == "section.late+"]
        assert made.n == 6 and [(k.n, k.chars, k.text is not None) for k in found] == [(4, 4 * len("Late template"), True)]
        assert wrapper.main_text(late[0], made) == "Story 0"


def test_wrapper_has_what_half_of_the_pages_have(spark):
    """A text that most pages have is template, though the twenty pages of least digest lack it; of pages that are left out no character is lost to the counts."""
    page = "<body><div class=top>Site</div>{1}<div class=story><p>Story {0} of the day</p><p>More of {0}</p></div></body>".format
    both = [(str(with_), page(i, "<div class=strip><p>Read our terms</p></div>" * with_)) for i in range(120) for with_ in (0, 1)]
    seen = spark.createDataFrame(both, "has string, html string").selectExpr("has", "html", "xxhash64(html) as d").collect()
    plain = sorted((r for r in seen if r.has == "0"), key=lambda r: r.d)[:20]
    rows = plain + sorted((r for r in seen if r.has == "1"), key=lambda r: r.d)[-24:]
    assert max(r.d for r in plain) < min(r.d for r in rows[20:])
    df = spark.createDataFrame([(i, f"https://a.example/{i}", r.html) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert not [r.text for r in wrapper.extract(df.repartition(3), keep=["page_id"]).collect() if "terms" in r.text or "Story" not in r.text]
    (r,) = wrapper.induce(df).collect()
    made = wrapper.load(r.wrapper)
    left, chars = [made], 0
    while left:
        s = left.pop()
        chars, left = chars + s.chars, left + s.kids
    assert made.n == 44 and chars == sum(wrapper._chars(wrapper.slots(wrapper.parse(r.html))) for r in rows)


def test_wrappers_depend_on_the_pages_alone(spark):
    """Three templates of 300 blocks each on one host, in several orders and partitions: one text a page, without the blocks of any template."""
    letters = lambda x: "".join(chr(97 + x // 26**i % 26) for i in range(3))
    block = lambda t: "".join(f"<div class='{t}{letters(x)}'><b>{t}</b> note {x}</div>" for x in range(300))
    kinds = {"a": block("a"), "b": block("b"), "c": block("c")}
    said = set()
    for order in ("aabbccccaaaa", "ccccaabbaaaa", "bbccccaaaaaa"):
        rows = [(i, "http://h.example/x", kinds[t] + f"<div class=body><p>{t} story {order[:i].count(t)}</p></div>") for i, t in enumerate(order)]
        for parts in (1, 32):
            df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts, "page_id")
            got = wrapper.extract(df, keep=["page_id"]).collect()
            said.add(tuple(sorted(r.text[-9:] for r in got)))
            assert all(r.text == f"a story {order[: r.page_id].count('a')}" for r in got if order[r.page_id] == "a")
    assert len(said) == 1


def test_names_that_only_sound_like_menus():
    page = "<body><nav>no</nav><article><div class='entry-header'><h1>Title</h1></div><p class='share-price'>1.5</p><p class='form-factor'>small</p><p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><p>b</p><div class='share-buttons'>no</div><div class=postComments>no</div><div class='ad-slot top'>no</div><div id=related-posts>no</div></article>"
    assert wrapper.main_text(page) == "Title\n1.5\nsmall\nSum x+1\nb"
    assert wrapper.main_text("<div>" * 70 + "<nav>menu text</nav><p>body</p>") == "body"
    two = "<body><article><p>first</p></article><aside>no</aside><article><p>second, and longer</p></article><footer>no"
    assert wrapper.main_text(two) == "first\nsecond, and longer"


def test_long_lists_are_one_slot():
    """Tens of thousands of rows are aligned in time, and read whole."""
    page = "<body><div class=c><table>" + "".join(f"<tr><td>{i}</td><td><p>v</p></td></tr>" for i in range(20_000)) + "</table></div>"
    own, other = wrapper.slots(wrapper.parse(page)), wrapper.slots(wrapper.parse(page.replace("<td>77</td>", "<td>x</td>")))
    assert wrapper.count(own) < 10 and len(list(wrapper.aligned(own, other))) == wrapper.count(own)
    assert wrapper.main_text(page).split("\n")[-2:] == ["19999", "v"]


def test_elements_at_any_depth():
    """Deep elements close themselves and not their ancestors, and deep menus are put out; a wrapper of deep pages is read back whole."""
    deep = "<div>" * 70 + "<p>deep {0}</p><nav>menu</nav><form>ask</form>" + "</div>" * 70
    page = "<body><main><p>first {0}</p><div>" + deep + "</div><p>last {0}</p></main><p>end</p>"
    assert wrapper.main_text(page.format(1)) == "first 1\ndeep 1\nlast 1"
    deeper = ["<div>" * 20_000 + f"<p>same</p><article>story {i}</article>" + "</div>" * 20_000 for i in range(3)]
    one = wrapper.slots(wrapper.parse(deeper[0]))
    for x in deeper[1:]:
        one = wrapper.merged(one, wrapper.slots(wrapper.parse(x)))
    text = wrapper.dump(one)
    again = wrapper.load(text)
    assert wrapper.dump(again) == text and wrapper.count(again) == wrapper.count(one) == 20_003
    assert [wrapper.main_text(x, again) for x in deeper] == ["story 0", "story 1", "story 2"]


def clashing(spark, rows):
    """Tables whose other columns have the names that operators give or use inside."""
    names = "n_bytes n_tokens over_limit ids ids_sha256 decoded secrets piece start length sequence_id offset media page error payload_bytes record_type key place side label counts hashes n_words kept rule language confidence text_scores declared host row__ __text salt__ number__ n_chars n_shingles component_id".split()
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return made.selectExpr("*", *[f"'clash' as `{n}`" for n in names]).repartition(2)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """One very long text of each kind, repeated rows, nulls in every column."""
    long = [" ".join(f"w{i % 977}" for i in range(150_000)), "x" * 400_000, "a  b\n" * 60_000, "password=" + "9f" * 60_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(long)] + [(9, texts[7], None, None)] * 2 + [(None, None, None, None), (10, "", "en", "")]
    return clashing(spark, rows)


@pytest.mark.parametrize("name", ["tokens", "secrets", "treebpe", "tiff", "packing", "quality", "language", "jaccard", "pages", "archives"])
def test_odd_tables(spark, odd, vocab, name):
    """Clashing columns, very long texts, nulls, repeated rows and an empty table, for every operator."""
    from kinfold.llm import language, packing, quality, secrets, tiff, tokens, treebpe, warc
    from pyspark.sql import functions as F

    def fused(d):
        model = language.fit(d, least_rows=1)
        seen = language.scored(d.withColumns({"declared": F.col("lang"), "host": language.host_of(F.col("source"))}), model)
        return language.fuse(seen, model, language.gather(seen, model))

    web = lambda d: d.select("*", F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.x/"), "source").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    work = {
        "tokens": lambda d: tokens.token_counts(d, vocab("byte_bpe_50k.json")),
        "secrets": secrets.scan,
        "treebpe": lambda d: treebpe.decoded(treebpe.encoded(treebpe.round_trip(d, vocab("byte_bpe_50k.tiktoken")), vocab("byte_bpe_50k.tiktoken")), vocab("byte_bpe_50k.tiktoken")),
        "tiff": lambda d: tiff.digests(tiff.with_media(d)),
        "packing": lambda d: packing.packed(d, vocab("byte_bpe_50k.json")),
        "quality": lambda d: quality.judged(quality.with_statistics(d), quality.DecisionList()),
        "language": fused,
        "jaccard": jaccard.near_duplicates,
        "pages": lambda d: wrapper.extract(web(d)),
        "archives": lambda d: warc.round_trip(spark, web(d)),
    }[name]
    rows = [r.asDict() for r in work(odd).collect()]
    assert work(odd.limit(0)).count() == 0
    ids = [r["page_id" if name == "archives" else "doc_id"] for r in rows]
    assert set(ids) == {0, 1, 2, 3, 9, 10, None} and (name == "packing" or len(rows) == 8 and ids.count(9) == 2)
    of = {r["page_id" if name == "archives" else "doc_id"]: r for r in rows}
    if name == "tokens":
        assert of[None]["n_tokens"] == of[10]["n_tokens"] == 0 and of[0]["n_tokens"] > 150_000 and of[1]["n_bytes"] == 400_000
    if name == "secrets":
        assert of[3]["secrets"] and not of[None]["secrets"]
    if name == "treebpe":
        assert of[2]["decoded"].decode() == "a  b\n" * 60_000 and of[None]["n_tokens"] == 0
    if name == "tiff":
        assert of[3]["payload_bytes"] % 192 == 0 and of[None]["payload_bytes"] == 192 and not any(r["error"] for r in rows)
    if name == "packing":
        assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["length"] for r in rows if r["doc_id"] is None) == 1
    if name == "quality":
        assert of[0]["n_words"] == 150_000 and not of[10]["kept"] and of[2]["n_dup_lines"] == 59_999
    if name == "language":
        assert of[None]["language"] == "und" and of[9]["language"] is not None
    if name == "jaccard":
        assert [of[i]["component_id"] for i in (0, 1, 2, 3, 9, 10)] == [0, 1, 2, 3, 9, 10] and of[0]["n_shingles"] == 977
    if name == "pages":
        assert of[None]["text"] == of[10]["text"] == "" and len(of[0]["text"]) > 500_000
    if name == "archives":
        assert of[None]["payload_bytes"] == 0 and of[1]["payload_bytes"] == 400_003


def test_shared_ids_keep_every_text(spark):
    """Under one doc_id a copy of another document and a text of its own: the copy goes, its own text stays; equal rows are one."""
    import corpus_pipeline as P

    rng = random.Random(2)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, c), (8, None), (8, d), (None, c), (None, None), (9, d)]
    got = dict(P.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    kept = sorted((r.text for r in got if r.doc_id is not None), key=str)
    assert kept == sorted([a, b, c, d, None], key=str) and [r.doc_id for r in got].count(None) == 2


def test_language_posterior_by_hand(spark):
    """Posteriors of a small table, computed plainly from the same text scores: declarations, suffixes, and hosts smoothed along domain, suffix and whole."""
    import math

    from kinfold.llm import language
    from pyspark.sql import functions as F

    rng = random.Random(4)
    speak = {"aa": ["bacada", "fagaha", "jakala"], "bb": ["rosoto", "vowoxo", "yozoco"]}
    rows = []
    for i in range(90):
        l = "aa" if i % 3 else "bb"
        text = " ".join(rng.choice(speak[l]) for _ in range(20)) if i % 7 else None
        rows.append((i, text, l, rng.choice([l, l, "aa", None]), rng.choice(["w.x.org", "v.x.org", f"{l}.net", "plain", None])))
    rows += [(100, "bacada rosoto", None, "bb", "new.org"), (101, "rosoto bacada", None, None, "w.x.org"), (102, "fagaha vowoxo", None, "zz", None)]
    df = spark.createDataFrame(rows, "id int, text string, lang string, declared string, host string")
    model = language.fit(df)
    seen = [r.asDict() for r in language.scored(df, model).collect()]
    names, pull = model.languages, language.PULL
    assert names == ["aa", "bb"]

    def of_text(s):
        best = max([0.0, *s]) if s else 0
        return names[s.index(best)] if best > 0 else None

    said = [(r["declared"], r["host"], of_text(r["text_scores"])) for r in seen]
    said = [x for x in said if x[2]]
    count = lambda f: [sum(bool(f(x)) and x[2] == l for x in said) for l in names]
    total = count(lambda x: True)
    whole = [(n + 1) / (sum(total) + 2) for n in total]
    suffix_of = lambda h: h.rsplit(".", 1)[1] if h and "." in h else None
    domain_of = lambda h: ".".join(h.split(".")[-2:])
    smooth = lambda n, up: [(a + pull * b) / (sum(n) + pull) for a, b in zip(n, up, strict=True)]
    suffixes = {s: smooth(count(lambda x: suffix_of(x[1]) == s), whole) for s in {suffix_of(x[1]) for x in said} - {None}}
    hosts = {}
    for h in {x[1] for x in said} - {None}:
        domain = smooth(count(lambda x: x[1] and domain_of(x[1]) == domain_of(h)), suffixes.get(suffix_of(h), whole))
        hosts[h] = smooth(count(lambda x: x[1] == h), domain)
    declared = {}
    for d in {x[0] for x in said} - {None}:
        n = count(lambda x: x[0] == d)
        declared[d] = [(a + pull * sum(n) / sum(total)) / (t + pull) for a, t in zip(n, total, strict=True)]
    got = {r.id: r for r in language.fuse(language.scored(df, model), model, language.gather(language.scored(df, model), model)).collect()}
    for r in seen:
        s = r["text_scores"]
        if not s:
            assert (got[r["id"]].language, got[r["id"]].confidence) == ("und", 0.0)
            continue
        prior = hosts.get(r["host"]) or [a * b / b for a, b in zip(suffixes.get(suffix_of(r["host"]), whole), whole, strict=True)]
        post = [x + math.log(p) + math.log(d) for x, p, d in zip(s, prior, declared.get(r["declared"], [1, 1]), strict=True)] + [math.log(min(whole))]
        best = post.index(max(post))
        assert got[r["id"]].language == [*names, "und"][best]
        assert got[r["id"]].confidence == pytest.approx(1 / sum(math.exp(x - max(post)) for x in post))


def test_decision_list_verdicts_by_hand(spark, docs):
    """What the ordered conditions give for every row, against the rules applied one by one."""
    from kinfold.llm import quality

    rules = quality.DecisionList([
        quality.Rule([("symbols_per_word", True, 0.2)]), quality.Rule([("dup_lines_share", True, 0.4), ("n_words", True, 60.0)]), quality.Rule([("chars_per_word", False, 2.0), ("words_per_line", True, 5.0)]), quality.Rule([("n_words", True, 8000.0)]),
    ])
    for r in quality.judged(quality.with_statistics(docs), rules).collect():
        n, chars, symbols, dup, repeat, lines = quality.text_statistics(r.text)
        value = {"symbols_per_word": symbols / max(n, 1), "chars_per_word": chars / max(n, 1), "dup_lines_share": dup / max(lines, 1), "repeat_share": repeat / max(n, 1), "words_per_line": n / max(lines, 1), "n_words": n}
        first = next((k for k, rule in enumerate(rules.rules, 1) if all((value[f] >= t) == above for f, above, t in rule.conditions)), 0)
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.base_failed, r.rule, r.kept) == (failed, first, not failed and not first)


def _story(host, i, blocks=3):
    body = "".join(f"<p>Story {host} {i} part {k}</p>" for k in range(blocks))
    return f"<html><body><div class=top>Welcome to {host}</div><div class=story>{body}</div><div class=end>All rights of {host}</div></body></html>"


def test_wrappers_sent_with_their_pages(spark, monkeypatch):
    """Past the bound of broadcasts: the same texts, whether a host has one group or several, hosts without template too."""
    rows = [(h * 1000 + i, f"http://h{h}.example/{i}", _story(h, i)) for h, n in ((1, 40), (2, 5), (3, 1)) for i in range(n)] + [(9, None, None), (8, "http://h1.example/x", ""), (7, None, "<p>alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = sorted(tuple(r) for r in wrapper.extract(pages, keep=["page_id"]).collect())
    assert (1000, "\n".join(f"Story 1 0 part {k}" for k in range(3)), 50) in want
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    for group in (2000, 7):
        monkeypatch.setattr(wrapper, "GROUP_PAGES", group)
        assert sorted(tuple(r) for r in wrapper.extract(pages, keep=["page_id"]).collect()) == want


def test_long_pages_align_in_bounded_time_and_memory():
    import time
    import tracemalloc

    rng = random.Random(1)
    turns = ["<body>" + "".join(f"<h2>H{i}</h2><p>text {i} {k}</p>" for i in range(5000)) + "</body>" for k in (1, 2)]
    mixed = ["<body>" + "".join(rng.choice(["<h2>{0}</h2>", "<p>{0}</p>", "<pre>{0}</pre>", "<hr><section class=s><p>{0}</p></section>"]).format(i) for i in range(5000)) + "</body>" for _ in range(2)]
    for a, b in (turns, mixed):
        began = time.time()
        tracemalloc.start()
        x, y = (wrapper.slots(wrapper.parse(p)) for p in (a, b))
        wrapper.matching(x, y)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
        assert time.time() - began < 30
    for tags in ("<a ' " * 100_000, "<a '>" * 100_000 + "'", "<! " * 100_000, "<" * 100_000):
        began = time.time()
        wrapper.parse(tags)
        assert time.time() - began < 5


def plain_alignment(x, y):
    """The whole table, a cell at a time, and the way back through it."""
    table = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    weigh = lambda p, q: (wrapper.matching(p, q)[0] if p.kids and q.kids else 1.0) + 0.5 * (not p.kids and p.text == q.text)
    for i, p in enumerate(x, 1):
        for j, q in enumerate(y, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + weigh(p, q) if p.key == q.key else 0)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return table[-1][-1], pairs[::-1]


def test_alignment_is_that_of_the_whole_table(monkeypatch):
    rng = random.Random(3)
    some = lambda: wrapper.slots(wrapper.parse("".join(rng.choice(["<h2>a{0}</h2>", "<p>b{0}</p>", "<pre>c</pre>", "<div><p>{0}</p><h3>d</h3></div>"]).format(rng.randint(0, 3)) for _ in range(rng.randint(0, 30)))))
    for cells in (1 << 27, 20):
        monkeypatch.setattr(wrapper, "CELLS", cells)
        for _ in range(60):
            a, b = some(), some()
            if [k.key for k in a.kids] == [k.key for k in b.kids]:
                continue
            best, pairs = plain_alignment(a.kids, b.kids)
            weight, got = wrapper.matching(a, b)
            assert weight == 1.0 + best
            if cells > 20:
                assert [(a.kids.index(p), b.kids.index(q)) for p, q, _ in got] == pairs


def test_many_spans_of_secrets():
    """Entropy spans beside base spans, both in thousands: one walk along both."""
    import time

    from kinfold.llm import secrets

    rng = random.Random(2)
    sign = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    words = [f'token = "{sign()}"' if i % 2 else sign() for i in range(12_000)]
    few = " ".join(words[:300])
    base, own = secrets.base_spans(few), secrets.entropy_spans(few)
    want = [("entropy", a, b) for a, b in own if not any(s <= a and b <= e for _, s, e in base)]
    assert [x for x in secrets.all_spans(few)[1] if x[0] == "entropy"] == want and want
    began = time.time()
    secrets.all_spans(" ".join(words))
    assert time.time() - began < 20


def _unrelated(n, count, seed=1):
    import numpy as np

    rng = np.random.default_rng(seed)
    return [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(count)]


def test_the_bound_says_something_of_sets_of_any_size():
    """Of unrelated sets of one size less than a hundredth pass, at both similarities; of linked ones all do."""
    import numpy as np

    for n in (1000, 5000, 8000, 12_000, 20_000, 60_000):
        sets = _unrelated(n, 40)
        size = np.array(list(map(len, sets)))
        near = [np.sort(np.concatenate([x[: len(x) * 9 // 10 + len(x) // 100], y[: len(y) // 20]])) for x, y in zip(sets[:4], sets[4:8], strict=True)]
        for ratio in ((80, 100), (85, 100)):
            every = [*sets, *near]
            sizes = np.array(list(map(len, every)))
            points = lambda at, g: jaccard._points([jaccard._packed(jaccard.point(every[i])) for i in at], g)  # noqa: B023, E731
            got = {(min(i, j), max(i, j)) for a, b, _ in jaccard.tree_pairs(points, sizes, np.arange(len(every)), np.full(len(every), 2), ratio) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
            assert sum(j < 40 for _, j in got) <= 0.01 * 40 * 39 / 2
            assert {(k, 40 + k) for k in range(4) if jaccard.linked(every[k], every[40 + k], ratio)} <= got
            assert not any(i == j for i, j in got) and size.min() > 0


def test_trees_of_several_sizes_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    base = _unrelated(9000, 6, 5)
    sets = [np.sort(x[rng.permutation(len(x))[: int(len(x) * f)]]) for x in base for f in (1.0, 0.95, 0.88, 0.9, 0.46, 0.45, 0.42)]
    sizes, kinds = np.array(list(map(len, sets))), rng.integers(0, 30, len(sets))
    sides = rng.integers(0, 3, len(sets))
    points = lambda at, g: np.array([jaccard.point(sets[i], g) for i in at])
    got = [(min(p), max(p)) for i, j, _ in jaccard.tree_pairs(points, sizes, kinds, sides, (80, 100)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard.linked(sets[i], sets[j], (80, 100)) and kinds[i] != kinds[j] and not (sides[i] == sides[j] < 2)}
    assert len(set(got)) == len(got) and want and want <= set(got)


def test_long_texts_in_one_cluster(spark):
    """Texts of some thousand words that share a passage of rare words: links as all pairs have them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(300)]
    rows = []
    for i in range(14):
        own = [word() for _ in range(5000 + 400 * i)]
        rows.append((len(rows), " ".join(shared + own)))
        if i % 2:
            copy = list(own)
            for at in range(50, len(copy), 250 if i % 4 == 1 else 30):
                copy[at] = word()
            rows.append((len(rows), " ".join(shared + copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    want = components_by_all_pairs(rows, 4, jaccard.RATIO)
    assert got == want and 14 < len(set(want.values())) < len(rows)


def test_jobs_side_by_side_keep_their_tables(spark):
    """What one thread discards is its own."""
    import threading

    from kinfold.llm import common

    ready, done, rows = threading.Event(), threading.Event(), []

    def other():
        held = common.written(spark.range(5), "other")
        ready.set()
        done.wait(120)
        rows.append(held.count())

    thread = threading.Thread(target=other)
    thread.start()
    at = common.tables_written()
    common.written(spark.range(3), "mine")
    last = common.written(spark.range(4), "mine")
    ready.wait(120)
    common.discard(spark, at)
    done.set()
    thread.join(120)
    assert rows == [5] and last.count() == 4 and common.tables_written() == at
