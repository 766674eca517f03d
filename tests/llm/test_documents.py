"""Near duplicates, decontamination, wrappers and the pipeline against plain versions."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline
from pairloom.llm import decontamination, superminhash, wrappers
from pairloom.llm.words import ALPHANUMERIC, BLANK_SEPARATED, hashed_words

# Words and signatures


def test_hashed_words_are_the_words():
    r = random.Random(2)
    texts = ["".join(r.choice("aB1 \t\né~.-_") for _ in range(r.randrange(0, 40))) for _ in range(500)]
    for table, pattern in ((BLANK_SEPARATED, brute.WORD), (ALPHANUMERIC, brute.ALNUM)):
        known = {}
        for text in texts:
            plain, hashed = pattern.findall(brute.lower(text)), hashed_words(text.encode(), table).tolist()
            assert len(plain) == len(hashed)
            for w, h in zip(plain, hashed):
                assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)


def plain_signature(elements):
    """One element at a time, without stopping early."""
    best = [float("inf")] * superminhash.SLOTS
    for x in elements:
        order = list(range(superminhash.SLOTS))
        for j in range(superminhash.SLOTS):
            d = int(superminhash.mixed(np.array([x], np.uint64) ^ superminhash._STEPS[j])[0])
            k = j + ((d & 0xFFFFFFFF) * (superminhash.SLOTS - j) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], (j << 32) + (d >> 32))
    return (superminhash.mixed(np.array(best, np.uint64)) >> np.uint64(48)).astype(np.uint16)


def test_signatures_with_early_stopping_equal_the_plain_walk():
    r = np.random.default_rng(4)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 20, 129, 400)]
    for s, got in zip(sets, superminhash.signatures(sets)):
        assert (got == plain_signature(s)).all()


def test_agreement_estimates_similarity():
    r = np.random.default_rng(6)
    pool = r.integers(0, 2**63, 400).astype(np.uint64)
    a, b = superminhash.signatures([pool[:350], pool[50:]])
    assert abs((a == b).mean() - 0.75) < 0.15


# Near duplicates


def compare_near(df, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_duplicates(df).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_the_whole_table(spark, sf, documents):
    got = {r["doc_id"]: r for r in entry.queries()["op7_superminhash"](spark, sf).collect()}
    want = brute.near_duplicates(documents)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_chains_and_groups_whose_smallest_member_is_not_the_centre(spark, frame):
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for g in range(6):
        words = [f"g{g}{w}" for w in base]
        for k in range(25):  # variants of a centre that are farther from each other than from it
            own = list(words)
            for at in r.sample(range(120), 3):
                own[at] = f"x{g}_{k}_{at}"
            rows.append((1000 * g + k, " ".join(own)))
        rows.append((1000 * g + 999, " ".join(words)))
        chain = [f"c{g}{w}" for w in base]
        for k in range(10):  # each step changes a little more
            chain[10 * k] = f"y{g}_{k}"
            rows.append((100_000 + 100 * g + k, " ".join(chain)))
    compare_near(frame(rows), rows)


def test_blocks_of_a_large_bucket(spark, frame, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK", 7)
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(60):
        own = list(base)
        for at in r.sample(range(100), 4):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    compare_near(frame(rows), rows)


def templated(n, share=0.62, size=200):
    """Texts of one template: any two have about ``share`` of their shingles in common."""
    common = round(size * 2 * share / (1 + share))
    start = " ".join(f"t{i}" for i in range(common))
    return [(k, start + " " + " ".join(f"u{k}x{i}" for i in range(size - common))) for k in range(n)]


def test_texts_of_one_template_are_left_alone_without_comparing_pairs(spark, frame, monkeypatch):
    rows = templated(150) + [(1000, "t0 " * 30), (1001, templated(1)[0][1] + " more")]
    compare_near(frame(rows), rows)
    sets = [superminhash.shingles(t) for _, t in rows[:150]]
    stored = spark.createDataFrame([(k, superminhash._pack(s)) for k, s in enumerate(sets)], "node long, set binary")
    members = stored.select("node", F.col("node").alias("root"))
    able = superminhash.with_partners(members, stored).collect()
    assert able and not any(r["small"] for r in able)  # none can be the smaller one of a pair


def test_members_with_partners_are_never_left_out(spark):
    r = random.Random(3)
    pool = [f"p{i}" for i in range(60)]
    sets = [superminhash.shingles(" ".join(r.sample(pool, r.randint(20, 60)) if k % 3 else pool[:r.randint(30, 60)])) for k in range(60)]
    stored = spark.createDataFrame([(k, superminhash._pack(s)) for k, s in enumerate(sets)], "node long, set binary")
    able = {r["node"]: r["small"] for r in superminhash.with_partners(
        stored.select("node", F.col("node").alias("root")), stored).collect()}
    for a in range(60):
        for b in range(a):
            if superminhash.similar(sets[a], sets[b]):
                assert a in able and b in able and able[min(a, b, key=lambda k: len(sets[k]))]


def test_keys_of_sets_are_exact_beside_empty_texts():
    import pandas as pd
    alone, beside = (next(superminhash.features(iter([pd.Series(x)]))) for x in (["a b c d e f"], [None, "a b c d e f", ""]))
    assert alone["key_a"][0] == beside["key_a"][1] and alone["key_b"][0] == beside["key_b"][1]
    assert beside["key_a"].isna().tolist() == [True, False, True]


def test_rows_without_an_id_stay_once_per_set(spark, frame):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (None, "X  y z"), (None, "x y z"), (None, "other"),
            (None, None), (None, "")]
    docs = frame(rows).withColumn("key_a", F.lit(1))
    kept = superminhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in kept.collect()), key=str)
    assert got == sorted([(1, list("abcdef")), (None, list("xyz")), (None, ["other"]), (None, []), (None, [])], key=str)


def test_near_duplicate_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A B  c"), (6, "a b"), (7, "a b c d e"), (None, "a b c"),
            (None, "only here now"), (8, "one two three four five six"), (8, "one two three four five six"), (9, "p q r"), (9, "a b"),
            (10, "p q r")]
    docs = frame(rows).withColumn("node", F.lit(1)).withColumn("n_shingles", F.lit("x"))
    got = superminhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == by[1] and by[1][0] == (0, 1, True) and by[2][0] == (0, 2, True) and by[3][0] == (0, 3, True)
    assert by[5] == [(1, 4, False)] and by[4] == [(1, 4, True)] and by[7] == [(1, 7, True)]
    assert sorted(by[None], key=str) == [(1, 4, False), (1, None, True)]
    assert {x[1] for x in by[9]} == {6} and by[10] == [(1, 6, False)]  # two versions link their groups
    kept = superminhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rows = [(i, i + 1) for i in range(0, 200)] + [(300, 500), (500, 400)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in superminhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 400: 300, 500: 300}


# Decontamination


def compare_contamination(docs, benchmark, rows, items, **kw):
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])
           for r in decontamination.find_contamination(docs, benchmark, **kw).collect()}
    assert got == brute.contamination(rows, items)


def test_contamination_of_the_whole_table(spark, sf, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = entry.queries()["op8_suffix_arrays"](spark, sf).collect()
    want = brute.contamination(documents, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got} == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
@pytest.mark.parametrize("shard_words", [250_000, 30])
def test_contamination_of_random_texts(spark, frame, monkeypatch, block_bytes, shard_words):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard_words)
    r = random.Random(11)
    vocabulary = ["a", "b", "É", "c1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 9, 10, 11, 15])))) for i in range(12)]
    items += [(20, None), (21, "!?"), (3, items[5][1])]
    rows = []
    for d in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 90))]
        if d % 3 == 0:
            words += items[r.randrange(12)][1].split()
        rows.append((d, r.choice([" ", ", "]).join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    compare_contamination(frame(rows), bench, rows, items, block_bytes=block_bytes)


def test_longest_match(spark, frame):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame([(1, "x " + " ".join(f"W{i}" for i in range(3, 20)) + " y"), (2, "none")])
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench).collect()}
    assert got[1]["longest"] == 17 and got[1]["n_hit"] == 17 and got[2]["longest"] == 0


def test_matches_are_measured_across_pieces_and_by_item(spark, frame, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 30)

    def words(first, end):
        return " ".join(f"w{i}" for i in range(first, end))

    items = [(1, words(0, 60)), (2, f"{words(100, 110)} x"), (3, words(101, 130)), (4, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"{words(900, 920)} {words(0, 60)} tail"), (2, words(100, 130)), (3, "a short one " * 2), (4, "none")]
    got = {r["doc_id"]: r for b in (1 << 20, 200) for r in
           decontamination.find_contamination(frame(rows), bench, block_bytes=b).withColumn("b", F.lit(b)).collect()}
    assert {d: r["longest"] for d, r in got.items()} == {1: 60, 2: 29, 3: 2, 4: 0}
    assert {d: [tuple(p) for p in r["places"]] for d, r in got.items()} == {
        1: [(20, 80, "1")], 2: [(0, 10, "2"), (1, 30, "3")], 3: [(1, 3, "4"), (4, 6, "4")], 4: []}


def test_decontamination_edges(spark, frame):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "x")]
    docs = frame(rows).withColumn("n_hit", F.lit("mine"))
    bench = spark.createDataFrame([(None, "a b c"), (2, None)], "item_id long, text string")
    got = decontamination.find_contamination(docs, bench)
    assert got.count() == len(rows) and dict(got.dtypes)["n_hit"] == "bigint"
    left = decontamination.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4]
    assert {r["n_hit"] for r in left.collect()} == {"mine"}
    assert decontamination.remove_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


def test_suffix_array_is_sorted():
    r = np.random.default_rng(3)
    words = r.integers(0, 4, 300)
    order = decontamination.suffix_array(words, 10)
    tails = [tuple(words[i:i + 10]) for i in order]
    assert sorted(order) == list(range(300)) and tails == sorted(tails)


# Wrappers


def plain_article(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    inner = re.sub(r"<[^>]*\Z", "", inner[1] if inner else "")
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inner)]
    return " ".join(b for b in blocks if b)


def test_articles_of_the_whole_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = entry.queries()["op5_wrappers"](spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: plain_article(v) for k, v in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_models_are_union_free_expressions():
    assert wrappers.collapsed(["li", "li", "li"]) == ["li+"]
    assert wrappers.collapsed(["dt", "dd", "dt", "dd", "x"]) == ["(dt dd)+", "x"]
    assert wrappers.aligned(["h0", "p+", "f"], ["h0", "ad", "p", "f"]) == ["h0", "ad?", "p+", "f"]
    assert wrappers.aligned(["a", "b"], ["a", "c"]) == ["a", "b?", "c?"]
    assert wrappers.free(wrappers.aligned([f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]))


SITE = """<html><head><title>t</title></head><body><div class="top"><a href="/">Home</a> <a href="/n">News</a></div>
<div id="cookie-notice">We use cookies.</div><div class="cols"><div class="story"><h1>{h}</h1><p>{a} <i>x</i>y &lt;{b}&#233;</p>
<ul><li><a href="1">one more story</a></li><li><a href="2">another story</a></li></ul><p>{c}<br>end</p>
<div class="comments"><p>reader says hi</p></div></div><div class="sidebar">side</div></div><form>name <input></form>
<footer>bye</footer><script>var p = "<p>no</p>";</script></body></html>"""


def test_site_without_article_elements(spark):
    rows = [(i, f"https://Host.example:80/{i}", SITE.format(h=f"Title {i}", a=f"many words of page {i} " * 8, b=f"b{i}", c=f"closing {i}"))
            for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in wrappers.extract(pages).collect()}
    assert got[3]["root"] == "/html/body/div.cols/div.story"
    assert got[3]["text"] == " ".join(f"Title 3 {'many words of page 3 ' * 8} xy <b3é closing 3 end".split())


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}


def test_class_words_and_forms_do_not_condemn_the_page(spark):
    def prose(i):
        return f"the long story of page number {i} goes on and on"

    shapes = [
        '<body class="page has-sidebar"><h1>T{i}</h1><p>{a}</p>{side}</body>',
        '<body><main class="content with-menu"><h1>T{i}</h1><p>{a}</p></main>{side}</body>',
        '<body><article class="post comment-open"><h1>T{i}</h1><p>{a}</p></article>{side}</body>',
        '<body><form id="aspnetForm"><h1>T{i}</h1><p>{a}</p>{side}</form></body>',
        '<body><form id="aspnetForm"><article><h1>T{i}</h1><p>{a}</p></article>{side}</form></body>',
        '<body><div class="layout has-sidebar"><div class="c1"><h1>T{i}</h1><p>{a}</p></div>{side}</div></body>',
        '<body><div role="main banner"><h1>T{i}</h1><p>{a}</p></div>{side}</body>',
    ]
    side = '<div class="sidebar">see this too</div><nav>home</nav>'
    rows, want = [], {}
    for k, shape in enumerate(shapes):
        for i in range(4):
            rows.append((10 * k + i, f"http://h{k}/{i}", f"<html>{shape.format(i=i, a=prose(i), side=side)}</html>"))
            want[10 * k + i] = f"T{i} {prose(i)}"
    # A form around one page of a host whose other pages have a form for searching only.
    rows += [(100 + i, f"http://mixed/{i}", f"<html><body><form>find</form><div><p>{prose(i)}</p></div></body></html>") for i in range(9)]
    rows.append((109, "http://mixed/9", f"<html><body><form><p>{prose(9)}</p></form></body></html>"))
    want.update({100 + i: prose(i) for i in range(10)})
    # An article says where the text is, however short it is.
    rows.append((110, "http://short/", '<html><body><div class="ad">buy this and that now</div><article></article></body></html>'))
    rows.append((111, "http://brief/", '<html><body><div class="ad">buy this and that now</div><article>word</article></body></html>'))
    want.update({110: "", 111: "word"})
    assert extracted(spark, rows) == want


def test_text_equal_on_the_pages_of_a_host_is_template(spark):
    notice, advert = "<div class='box3'>We use <b>cookies</b> on this site</div>", "<div class='offer'><p>Buy the book</p></div>"
    story = ["storm", "river", "garden", "letter", "engine", "market"]

    def body(i, head=True):
        extra = advert if i % 2 else f"<div class='extra'><p>extra {story[i]}</p></div>"
        return (f"<html><body><div class='c1'>{notice if head else ''}<h1>About the {story[i]}</h1><p><b>Note:</b> the {story[i]} "
                f"was seen</p>{extra}<p>It ended with {story[i]}</p></div></body></html>")

    def want(i):
        return f"About the {story[i]} Note: the {story[i]} was seen{'' if i % 2 else f' extra {story[i]}'} It ended with {story[i]}"

    rows = [(i, f"http://news/{i}", body(i)) for i in range(6)]
    rows += [(10 + i, f"http://news/again/{i}", body(0)) for i in range(5)]  # copies of one page are one page
    rows += [(20, "http://alone/", body(1, False))]  # a host of one page has no template
    # Copies that differ in one word are no template.
    copy = " ".join(f"<p>{' '.join(story)} part {k}</p>" for k in range(20))
    rows += [(30 + i, f"http://mirror/{i}", f"<body><article>{copy}<p>{story[i]}</p></article></body>") for i in range(4)]
    got = extracted(spark, rows)
    assert {i: got[i] for i in range(6)} == {i: want(i) for i in range(6)}
    assert {got[10 + i] for i in range(5)} == {want(0)}
    assert got[20] == "About the river Note: the river was seen Buy the book It ended with river"
    assert all(got[30 + i].startswith(" ".join(story)) and got[30 + i].endswith(f"part 19 {story[i]}") for i in range(4))


STORIES = ["storm", "river", "garden", "letter", "engine", "market"]
RECURRING = ('<p class="by">By Jane Doe</p><div class="byline">Staff</div><h2>Introduction</h2><p>About the {s}, {n}.</p>'
             '<div class="box7">No advice is given here.</div><h2>Conclusion</h2><p>It ended with {s} number {n}.</p>')


@pytest.mark.parametrize("pages", [1, 2, 6, 60])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div class='x'>{}</div></main>", "<div><article>{}</article></div>"])
def test_what_recurs_inside_an_article_is_content(spark, pages, around):
    notice = "<div class='box3'>We use cookies here</div>"
    rows = [(n, f"http://host/{n}", "<html><body>" + around.format(RECURRING.format(s=STORIES[n % 6], n=n)) + notice + "</body></html>")
            for n in range(pages)]
    got = extracted(spark, rows)
    assert got == {n: f"By Jane Doe Staff Introduction About the {STORIES[n % 6]}, {n}. No advice is given here. Conclusion "
                      f"It ended with {STORIES[n % 6]} number {n}." for n in range(pages)}


@pytest.mark.parametrize("pages", [3, 6, 60])
def test_headings_and_bylines_of_a_plain_root_are_content_and_a_constant_container_is_template(spark, pages):
    def body(n):
        items = "".join(f"<div class='part'><p>Same start</p><p>part {k} of {STORIES[n % 6]} {n}</p></div>" for k in range(3))
        return (f"<html><body><div class='c1'><div class='box3'><p>We use cookies</p></div><p class='by'>By Jane Doe</p>"
                f"<h2>Introduction</h2><p>About the {STORIES[n % 6]}, {n}.</p>{items}<h2>Conclusion</h2></div></body></html>")

    got = extracted(spark, [(n, f"http://plain/{n}", body(n)) for n in range(pages)])
    assert got == {n: f"By Jane Doe Introduction About the {STORIES[n % 6]}, {n}. " + "".join(
        f"Same start part {k} of {STORIES[n % 6]} {n} " for k in range(3)) + "Conclusion" for n in range(pages)}


def test_wrapper_edges(spark):
    rows = [(1, "http://h/a", None), (2, "http://h/b", ""), (3, None, "<p>plain"), (4, "nonsense", "no tags &amp; &am"),
            (5, "http://h/c", "<article><p>one<p>two <b>x</b>y</article><p>out"), (5, "http://h/c", "<article><p>one<p>two <b>x</b>y</article><p>out"),
            (6, "http://h/d", "<div>" * 3000 + "deep" + "<p"), (7, "http://h/e", "<article>a < b \"c\" <em>d</em>e<!-- x --></article"),
            (8, "http://h/f", "</p></div><article><nav>menu</nav><header><h1>T</h1></header>text<aside>s</aside></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))
    got = wrappers.extract(pages)
    assert got.count() == len(rows)
    by = {r["page_id"]: r["text"] for r in got.collect()}
    assert by[1] == by[2] == "" and by[3] == "plain" and by[4] == "no tags & &am"
    assert by[5] == "one two xy" and by[6] == "deep" and by[7] == "a < b \"c\" de" and by[8] == "T text"
    assert wrappers.extract(pages.limit(0)).count() == 0


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(12)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(3, 9))) for _ in range(n))

    passage, secret = prose(60), prose(30)
    clean = [(i, prose(80), "en", f"s{i % 4}") for i in range(40)]
    near = clean[0][1].split()
    near[5] = "changed"
    rows = clean + [(100, clean[1][1], "en", "s0"), (101, " ".join(near), "en", "s1"), (102, "12 34", "en", "s0"),
                    (103, None, None, None), (104, f"{prose(70)}\n{passage}", "en", "s2"), (105, f"{passage}\n{prose(70)}", "en", "s3"),
                    (106, f"{prose(50)} {secret} {prose(50)}", "en", "s1")]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in at.select("doc_id").collect()})
        if name != "mixing":
            assert at.dtypes == docs.dtypes
    ids = {row[0] for row in rows}
    assert seen[0] == ids - {102, 103}
    assert seen[1] == seen[0] - {100}  # its one line is a repeated passage
    assert seen[2] == seen[1] - {101}
    assert seen[3] == seen[2] - {106}
    deduped = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert passage in deduped[104]["text"] and passage not in deduped[105]["text"]
    assert deduped[105]["n_chars"] == len(deduped[105]["text"])
    total = at.agg(F.sum("taken")).first()[0]
    assert abs(total - 81 * len(seen[3])) < 0.2 * total
    ran = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {r["doc_id"]: r["taken"] for r in at.collect()}


def test_pipeline_keeps_own_columns_and_rejects_gibberish(spark, tmp_path):
    """The first three stages against plain rules, on rows with nulls, repeats and columns named like the operators'."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 8))) for _ in range(150)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    shared, short = prose(55), prose(9)
    rows = [(i, prose(90), "en", "s", f"l{i}", "keep") for i in range(30)]
    rows += [(40, rows[0][1], "en", "s", "x", "keep"), (41, f"{shared}\n{prose(60)}", "en", None, "x", None),
             (42, f"{prose(60)}\n{shared}", None, "s", "x", "keep"), (None, rows[1][1], "en", "s", "x", "keep"),
             (None, short, "en", "s", "x", "keep"), (None, short.upper().replace(" ", "  "), "en", "s", "x", "keep"),
             (50, "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8\u3067\u3059\u3088", "en", "s", "x", "keep"), (51, "xqzj wvkq zzzz xxkq", "en", "s", "x", "keep"),
             (52, "zq", "en", "s", "x", "keep"), (53, None, "en", "s", "x", "keep"), (54, "1234 !", "en", "s", "x", "keep"), (55, "", "en", "s", "x", "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines string, score string")
    docs = docs.withColumn("n.dotted", F.lit(1))
    spark.createDataFrame([(1, "none of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert at.dtypes == docs.dtypes
        ids.append(sorted((x["doc_id"] for x in at.collect()), key=str))
    whole = sorted([*range(30), 40, 41, 42, None, None, None, 52], key=str)
    assert ids[0] == whole
    # Documents are one line of more than fifty words: a copy loses it all. Rows without an id come first, so document 1 is
    # the copy; the passage goes from the later document.
    assert ids[1] == sorted([0, *range(2, 30), 41, 42, 52, None, None, None], key=str)
    assert ids[2] == ids[3] == sorted([0, *range(2, 30), 41, 42, 52, None, None], key=str)
    assert {x["score"] for x in at.where("doc_id < 30").collect()} == {"keep"}
    assert {x["n_lines"] for x in at.where("doc_id = 3").collect()} == {"l3"}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
