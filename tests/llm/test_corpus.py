"""Language-model scores, page texts and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from millrace.llm.batches import packed, unpacked
from millrace.llm.graph import written
from millrace.llm.html_extract import extract_text, main_text
from millrace.llm.interpolation import context_bucket, learn_weights, text_scores
from millrace.llm.page_tokens import page_tokens
from millrace.tables import table

SF_DIR = "/root/testdata/sf0.001"


def brute_base(rows):
    tokens = [(k, (t or "").encode().lower().split() + [None]) for k, t in rows]
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7
    count = Counter(w for k, ws in tokens if fold(k) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(
        (
            (k, fold(k) == 2, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6))
            for k, ws in tokens
        ),
        key=repr,
    )


def test_scores_match_brute_force(spark, odd_docs, no_docs):
    docs = table(spark, SF_DIR, "documents")
    for df in (docs, odd_docs, docs.limit(1)):
        rows = text_scores(df).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)
        assert got == brute_base([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert text_scores(no_docs).collect() == []


def test_model_matches_its_formula(spark):
    """The score from counts gathered here, with weights learnt here by the same rule."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    fold = {k: zlib.crc32(str(k).encode()) % 7 for k, _ in rows}
    tokens = {k: (t or "").encode().lower().split() + ["END"] for k, t in rows}
    pairs = {k: list(zip(["START", *ws[:-1]], ws)) for k, ws in tokens.items()}

    def counts(use):
        one, two = Counter(), Counter()
        for k in tokens:
            if use(fold[k]):
                one.update(tokens[k])
                two.update(pairs[k])
        one["START"] = one["END"]
        return one, two

    one, two = counts(lambda f: f != 2)
    n, v = sum(one.values()) - one["START"], sum(c > 0 for w, c in one.items() if w != "START")
    less_one, less_two = counts(lambda f: f not in (2, 3))
    less = sum(less_one.values()) - less_one["START"]
    cells = Counter()
    for k in tokens:
        if fold[k] == 3:
            for a, b in pairs[k]:
                cells[(int(context_bucket(np.array([less_one[a]]))[0]), less_one[b] / less, less_two[a, b] / max(1, less_one[a]))] += 1
    weights = learn_weights(np.array([[b, c, p, q] for (b, p, q), c in cells.items()]), 1 / (v + 1))
    got = {r.doc_id: r.score for r in text_scores(table(spark, SF_DIR, "documents")).collect()}
    held_out = {k: sum(map(math.log10, [1 / (v + 1)])) for k in tokens}
    for k in tokens:
        want = 0.0
        for a, b in pairs[k]:
            w = weights[int(context_bucket(np.array([one[a]]))[0])]
            want += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + w[2] * two[a, b] / max(1, one[a]))
        # The weights are learnt on a histogram with fine steps.
        assert abs(want - got[k]) <= 0.002 * abs(want) + 1e-6
    assert len(held_out) == len(got)


def test_mixture_beats_words_alone(spark):
    rows = [r for r in text_scores(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def test_weights_of_each_bucket_sum_to_one():
    draw = np.random.default_rng(0)
    cells = np.column_stack([draw.integers(1, 9, 300), draw.integers(1, 50, 300), draw.random(300) * 1e-3, draw.random(300) * (draw.random(300) < 0.5)])
    weights = learn_weights(cells, 1e-6)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 0] > 0).all()
    assert weights[0, 2] == 0


def test_numbers_survive_packing():
    numbers = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)
    assert (unpacked(packed(numbers)) == numbers).all() and len(unpacked(packed(numbers[:0]))) == 0


def page(title, body, k=0, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{x}}</style><script>var t="</p>";</script></head><body>'
        f'<nav><ul><li><a href="/a">Menu {k}</a></ul></nav><div class="ad">Buy {k}</div><article><h1>{title}</h1>{body}{extra}</article>'
        f"<section id=comments><p>Nice {k}</p></section><footer>&copy; me</footer></body></html>"
    )


def test_main_text_of_single_pages():
    body = "<p>One  <b>two</b>\n three&amp;four &eacute;<br>five<p>Six<ul><li>a<li>b</ul><form><input value='>'>no</form><p>a &lt; b</p>"
    assert main_text(page("T", body), []) == "T\nOne two three&four é five\nSix\na\nb\na < b"
    assert main_text("", []) == ""
    assert main_text("plain   text", []) == "plain text"
    assert main_text("<p>cut <a href='x", []) in ("cut", "cut <a href='x")
    assert main_text("<article><p>never closed <b>at all", []) == "never closed at all"
    assert main_text("<div class=menu>m</div><div><p>body text that is long</p></div><footer>f</footer>", []) == "body text that is long"
    assert main_text('<body class="with-sidebar"><main class="no-comments"><p>a</p><figure>b</figure></main></body>', []) == "a\nb"
    assert main_text("<article><header>h</header><p>a</p><div id='comments-3'>c</div></article>", []) == "a"
    assert main_text("<article><p>a<!-- <p>x</p> -->b<script>1</script>c</p></article>", []) == "abc"


def test_names_of_wrappers_set_no_article_aside():
    story = "<h1>T</h1><p>story</p>"
    after = "<div class='sidebar'><p>links and more links</p></div>"
    assert main_text(f'<div class="content-sidebar-wrap"><main>{story}</main>{after}</div>', []) == "T\nstory"
    assert main_text(f'<div class="content-sidebar-wrap"><article>{story}</article>{after}</div><div>longer text below</div>', []) == "T\nstory"
    assert main_text(f'<div id="page" class="has-sidebar no-comments"><div class="side-by-side"><article>{story}</article></div></div>', []) == "T\nstory"
    assert main_text(f'<main><div class="has-widget"><article>{story}</article></div>{after}</main>', []) == "T\nstory"
    # What holds teasers or comments stays aside, whether the story is an article or not.
    listed = "<article>one</article><article>two</article>"
    assert main_text(f"<article>{story}</article><div id='comments'>{listed}</div>", []) == "T\nstory"
    assert main_text(f"<article>{story}<p>goes on</p></article><div class='related'><article>a teaser</article></div>", []) == "T\nstory\ngoes on"
    assert main_text(f"<div><p>a story without an article</p></div><div id='comments'>{listed}</div>", []) == "a story without an article"
    assert main_text(f"<nav class='menu'><article>{story}</article></nav>", []) == ""


def test_every_block_of_a_container_stays():
    story = "<h1>T</h1><p>" + "words " * 30 + "</p><h2>U</h2><ul><li>a<li>b</ul><blockquote>q</blockquote><pre>c</pre><table><tr><td>1<td>2</table><div><p>z</p></div>"
    want = "T\n" + "words " * 29 + "words\nU\na\nb\nq\nc\n1\n2\nz"
    assert main_text(f"<body><div>top</div><div class=entry>{story}<div class=share>s</div></div><div>low</div></body>", []) == want
    assert main_text(story, []) == want
    # Two containers with much text each.
    both = "<div id=a><h2>A</h2><p>some words here</p></div><div id=b><h2>B</h2><p>some more words</p></div>"
    assert main_text(f"<body><div>top</div><div>{both}</div></body>", []) == "A\nsome words here\nB\nsome more words"
    assert main_text("<body><ul><li>only a list</li><li>b</li></ul></body>", []) == "only a list\nb"


def test_templates_of_a_host(spark):
    draw = random.Random(3)
    note = "<p>Read more of our stories</p>"
    rows = [(i, "http://Same.org/%d" % i, page(f"t{i}", "".join(f"<p>word{draw.random()}</p>" for _ in range(draw.randint(1, 6))), i, note)) for i in range(30)]
    rows += [(100, "http://few.org/1", page("t", "<p>x</p>", 1, note)), (101, None, None), (102, "odd", ""), (103, "http://few.org/1", page("t", "<p>x</p>", 1, note))]
    rows += [(103, "http://few.org/1", page("t", "<p>x</p>", 1, note)), (None, "http://same.org/x", page("z", "<p>y</p>", 3, note))]
    # Copies of one page are no template.
    rows += [(200 + i, "http://copies.org/%d" % i, page("t", "<p>all alike</p>")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS raw", "3 AS template", "4 AS text")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_text(df).collect()), key=repr)
    assert [r[:2] for r in got] == sorted(((a, b) for a, b, _ in rows), key=repr)
    by_id = {r[0]: r[2] for r in got}
    assert all("Read more" not in by_id[i] and by_id[i].startswith(f"t{i}\nword") for i in range(30))
    assert by_id[100] == by_id[103] == "t\nx\nRead more of our stories"
    assert by_id[None] == "z\ny" and by_id[101] == by_id[102] == ""
    assert by_id[205] == "t\nall alike"
    assert all(r[3] == len(r[2]) for r in got)
    assert extract_text(df.limit(0)).collect() == []


def test_names_and_forms_inside_the_article():
    kept = [
        '<h2 id="hidden-gems">k</h2>',
        '<h2 id="the-social-contract">k</h2>',
        '<h2 id="comments">k</h2>',
        '<section class="related-work">k</section>',
        '<div class="side-by-side">k</div>',
        '<div class="foot-notes">k</div>',
        '<p class="notice-period">k</p>',
        '<p id="legal">k</p>',
        "<header><p>lost</p><h1>k</h1></header>",
        '<figure class="banner-image" id="header">k</figure>',
    ]
    for part in kept:
        assert main_text(f"<article><p>some words before</p>{part}<p>after</p></article>", []) == "some words before\nk\nafter", part
    lost = [
        '<div class="comments">k</div>',
        '<section id="comments-3">k</section>',
        '<div class="box related">k</div>',
        '<div role="search">k</div>',
        '<p class="advert">k</p>',
        "<form><p>k</p></form>",
        "<header>k</header>",
        "<nav><h2>k</h2></nav>",
    ]
    for part in lost:
        assert main_text(f"<article><p>some words before</p>{part}<p>after</p></article>", []) == "some words before\nafter", part
    page = "<nav>n</nav><form action=x><article><h1>t</h1><p>words</p><form>poll</form></article><select>s</select></form>"
    assert main_text(f"<body>{page}</body>", []) in ("t\nwords", "t\nwords\npoll")
    assert main_text("<body><form><div><p>long text of the page</p><button>b</button></div></form><p>x</p></body>", []) == "long text of the page"
    assert main_text('<div class="cookie-banner"><p>c</p></div><div><h2 id="social">h</h2><p>text of the page</p></div>', []) == "h\ntext of the page"


def test_hints_count_where_the_template_bears_them_out(spark):
    share = '<div class="share-buttons"><ul><li>share {0}</ul></div>'
    rows = [(i, f"http://a.org/{i}", page(f"t{i}", f"<p>own {i}</p>", i, share.format(i))) for i in range(10)]
    rows.append((10, "http://a.org/10", page("t10", "<p>own 10</p>", 10, '<section class="related-work"><p>as others said</p></section>')))
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"t{i}\nown {i}" for i in range(10)} | {10: "t10\nown 10\nas others said"}


def test_odd_page_tables(spark):
    schema = "page_id bigint, url string, html string, id int, host string, raw string, template string, role int, roles int, text string"
    long = "".join(f"<p>paragraph {i} of many</p>" for i in range(40_000))
    rows = [(1, "http://a.org/1", page("t", long), 1, "h", "r", "t", 1, 1, "x"), (None, None, None, *[None] * 7), (2, "odd", "", *[None] * 7)]
    df = spark.createDataFrame(rows, schema)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_text(df).collect()}
    text = "t\n" + "\n".join(f"paragraph {i} of many" for i in range(40_000))
    assert got == {1: ("http://a.org/1", text, len(text)), None: (None, "", 0), 2: ("odd", "", 0)}
    assert extract_text(df.limit(0)).collect() == []
    deep = "<div>" * 3_000 + "x" + "</div>" * 3_000
    assert main_text(deep, []) == "x"


def test_copies_beside_other_pages_are_no_template(spark):
    """Copies that differ in what is no token, such as a script, are one page as well."""
    copy = page("t", "<p>all alike</p><p>and so on</p>")
    rows = [(i, "http://a.org/%d" % i, copy.replace("var t", f"var t{i % 50}")) for i in range(300)]
    rows += [(1000 + i, "http://a.org/%d" % i, page(f"u{i}", f"<p>other {i}</p>", i)) for i in range(12)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "t\nall alike\nand so on" for i in range(300)} | {1000 + i: f"u{i}\nother {i}" for i in range(12)}


def test_templates_of_few_pages_and_of_layouts(spark):
    draw = random.Random(4)
    body = lambda n: "".join(f"<p>word{draw.random()}</p>" for _ in range(n))
    note = lambda x: f"<p>Read more of our {x}</p>"
    rows = [(i, "http://few.org/%d" % i, page(f"t{i}", body(2), i, note("stories"))) for i in range(4)]
    for i in range(100, 140):
        kind, wrap = ("news", "<div class=a><div class=b>{}</div></div>") if i % 5 < 3 else ("sport", "<section class=c><div class=d>{}</div></section>")
        rows.append((i, "http://two.org/%d" % i, page(f"t{i}", wrap.format(body(3) + note(kind)), i)))
    # One article published again with changes, beside others, and on a host of its own.
    again = "".join(f"<p>the same words in paragraph {k}</p>" for k in range(4))
    rows += [(200 + i, "http://again.org/%d" % i, page("same", again + f"<p>changed {i}</p>", i)) for i in range(4)]
    rows += [(210 + i, "http://again.org/x%d" % i, page(f"t{i}", body(2), i)) for i in range(10)]
    rows += [(300 + i, "http://own.org/%d" % i, page("same", again + f"<p>changed {i}</p>", i)) for i in range(3)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("Read more" not in got[i] and got[i].startswith(f"t{i}\nword") for i in [*range(4), *range(100, 140)])
    assert all(got[i].count("word0") == 3 for i in range(100, 140))
    assert all(got[k + i].startswith("same\nthe same") and got[k + i].endswith(f"paragraph 3\nchanged {i}") for k, n in ((200, 4), (300, 3)) for i in range(n))
    assert all(got[210 + i].count("word") == 2 for i in range(10))


def test_tokens_of_broken_markup():
    for text in ("<", "<a", "<a href=\"x>y", "</p></p>", "<p <b>x", "&#0;&bogus;", "<script>never closed <p>x"):
        page_tokens(text)


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "secret scans",
        "best-fit packing",
    ]
    docs = first = table(spark, SF_DIR, "documents")
    kept = [first.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == first.columns and docs.dtypes == first.dtypes
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4]
    words = docs.selectExpr("doc_id", r"size(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)) AS n").collect()
    packed = Counter()
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        packed[r.doc_id] += r.n_words
    assert packed == Counter({r.doc_id: r.n for r in words})


def test_pipeline_at_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF_DIR), "stage")
        docs.collect()


def test_every_operator_has_a_query():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in queries() and {n for n in oracle_sql() if n.startswith("op")} == {
        "op1_benchmark_decontamination",
        "op10_license_scan",
    }
