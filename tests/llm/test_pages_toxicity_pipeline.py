import html
import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from haltwerk.llm import html_content, html_tree, queries, toxicity_chain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return html_content.fitted(spark.read.parquet(f"{SF}/pages.parquet"))


def article(page):
    a, e = page.find("<article>") + 9, page.find("</article>")
    body = re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", page[a : e if e >= 0 else len(page)]))
    lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", body).split("\n"))
    return "\n".join(x for x in lines if x)


def test_articles_of_the_given_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_content.extract(pages, model).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_pages_in_other_clothes(spark, model):
    right = total = 0
    for seed, row in enumerate(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()):
        tree = html_tree.parse(row.html)
        other, label = html_content.redressed(tree, html_content.landmark_labels(tree), 10**6 + seed)
        nodes = html_content.features(other)
        p = html_content.marginals(model.unary(nodes.names), nodes.parent, nodes.kind, model.passed)
        pairs = [(q > 0.5, y) for q, y, r in zip(p, label, nodes.run, strict=True) if r]
        right += sum(a == b for a, b in pairs)
        total += len(pairs)
    assert right / total > 0.99


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(4)
    parent, kind = [0, 0, 0, 1, 1, 3], [0, 1, 4, 2, 5, 0]
    unary, passed = draw.normal(size=6).tolist(), draw.normal(size=(8, 2, 2))
    weight = np.zeros(6)
    total = 0.0
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(u * a for u, a in zip(unary, y, strict=True)) + sum(passed[kind[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total += w
        weight += w * np.array(y)
    np.testing.assert_allclose(html_content.marginals(unary, parent, kind, passed), weight / total)


@pytest.mark.parametrize("page", ["", "<", "<<>>", "</p>", "<p", "<!--", "<script>x", "&am", "<a><a></b><p><p>", "<table><td>x<tr>", "<div " * 50, "<div>" * 3000 + "x", "\x00<p>\x00"])
def test_no_page_breaks_the_reader(model, page):
    assert isinstance(html_content.content(page, model), str)


def test_odd_pages(spark, model):
    rows = [(1, None, None), (None, "u", "<article><p>Short but main &amp; text.</p></article>"), (1, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.text, r.n_chars) for r in html_content.extract(pages, model).collect())
    assert [g[0] for g in got[:2]] == ["", ""] and len(got) == 3
    assert html_content.extract(pages.where("false"), html_content.fitted(pages.where("false"))).collect() == []


def test_toxicity_against_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity_chain.fit(docs, labels.where("doc_id % 4 <> 0"), ["quality", "toxic"], rows_per_side=1500)
    rows = toxicity_chain.score(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    toxic = [r.flagged for r in rows if r.toxic == 1]
    clean = [r.flagged for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_toxicity_of_odd_and_no_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, 0), (None, 1, 1), (3, None, 1)], "doc_id long, insult int, toxic int")
    chain = toxicity_chain.fit(odd, labels, ["insult", "toxic"])
    assert toxicity_chain.score(odd, chain).count() == 13 and toxicity_chain.score(nothing, chain).collect() == []
    empty = toxicity_chain.fit(nothing, labels.where("false"), ["insult", "toxic"])
    assert not any(r.flagged for r in toxicity_chain.score(odd, empty).collect())


def test_pipeline_stages(spark, odd, nothing, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "encoding"]
    folder = str(tmp_path)
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "never seen words in here"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= {1, 2, 11} and all(r.same for r in out)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, folder).columns == odd.columns and stage(spark, nothing, folder).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, SF)
        lost = docs.join(kept, "doc_id", "left_anti").join(labels, "doc_id").collect()
        assert all(len(r.text.split()) < 60 or r.text.count(" ") < 60 for r in lost)
        docs = kept


def test_every_query_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_self_closed_pictures_and_formulas_keep_the_text():
    def runs(body):
        tree = html_tree.parse(f"<html><body><article><p>{body}</p><p>After.</p></article></body></html>")
        return [t for t in tree.text if t]

    assert runs("One <svg viewBox='0 0 1 1' /> two") == ["One two", "After."]
    assert runs("One <math/> two") == ["One two", "After."]
    assert runs("Let <math><mi>x</mi><mspace width='1em'/><mo>&gt;</mo><mn>0</mn></math> be") == ["Let x>0 be", "After."]
    assert runs("<math><semantics><mi>y</mi><annotation encoding='tex'>\\y</annotation></semantics></math> too") == ["y too", "After."]
    assert runs("<svg><title/><path d='M0'/><text>no</text></svg>One") == ["One", "After."]
    tree = html_tree.parse("<article><svg/>Directly<p>in it</p></article>")
    assert [t for t in tree.text if t] == ["Directly", "in it"]


def test_few_labelled_pages_among_many_train(spark, monkeypatch):
    monkeypatch.setattr(html_content, "fit", lambda pages: pages)
    labelled = [f"<html><body><ARTICLE class='a'><p>Text {i}.</p></ARTICLE></body></html>" for i in range(4)]
    others = [f"<html><body><div><p>articles {i}</p></div></body></html>" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate([None, *labelled, *others])), "page_id long, html string").repartition(3)
    assert html_content.fitted(pages, fit_pages=8) == sorted(labelled)
    assert html_content.fitted(pages.where("page_id > 4"), fit_pages=8) == []


@pytest.mark.parametrize(
    "inside",
    [
        "<script>x</script>", "<style>p {}</style>", "<noscript>x</noscript>", "<svg><title>x</title><text>x</text></svg>", "<input value='x'>",
        "<textarea>x</textarea>", "<iframe src='x'>x</iframe>", "<audio controls>x</audio>", "<output></output>", "<picture><source><img alt='x'></picture>",
        "<button type='button'>x</button>", "<select><option>x<option>y</select>", "<video><track>x</video>", "<canvas>x</canvas>", "<object data='x'>x</object>",
    ],
)
def test_elements_within_a_line_keep_it_whole(inside):
    tree = html_tree.parse(f"<html><body><article><p>one {inside} two</p><p>three</p></article></body></html>")
    assert [t for t in tree.text if t] == ["one two", "three"]
    loose = html_tree.parse(f"<article>one {inside} two<p>three</p></article>")
    assert [t for t in loose.text if t] == ["one two", "three"]


def test_large_deep_and_cluttered_pages():
    import time

    many = "<html><body><article>" + "".join(f"<p class='a{k}'>Paragraph {k} of the page.</p>" for k in range(20_000)) + "</article></body></html>"
    deep = "<div>" * 20_000 + "<p>low</p>" + "</em>" * 20_000 + "</div>" * 20_000
    marked = "<article>" + "".join(f"<p {' '.join(f'data-{k}={k}' for k in range(200))}>text {i}</p>" for i in range(50)) + "</article>"
    began = time.process_time()
    assert [t for t in html_tree.parse(deep).text if t] == ["low"]
    assert time.process_time() - began < 5  # grows with the page, not with its square
    model = html_content.fit([many, marked], steps=5)
    for page in (many, deep, marked):
        assert isinstance(html_content.content(page, model), str)
    tree = html_tree.parse(many)
    other, labels = html_content.redressed(tree, html_content.landmark_labels(tree), 3)
    assert len(other.tag) == len(labels) > 10_000


def test_training_pages_are_bounded_and_never_none(spark, monkeypatch):
    monkeypatch.setattr(html_content, "fit", lambda pages: pages)
    long = [f"<article><p>{'word ' * (50 + k)}</p></article>" for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(long)), "page_id long, html string")
    assert html_content.fitted(pages, fit_chars=100) == sorted(sorted(long, key=len)[:8])
    equal = spark.range(500).selectExpr("1L AS page_id", "'<article><p>same</p></article>' AS html")
    assert len(html_content.fitted(equal, fit_pages=300)) <= 600


def test_pages_with_more_columns(spark, model):
    rows = [(1, "u", "<article><p>Some text of the article, long enough to be one.</p></article>", "t", 3), (1, "u", None, "t", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tag string, node int")
    found = html_content.extract(pages, model).collect()
    assert sorted(r.n_chars == 0 for r in found) == [False, True] and found[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_duplicate_stage_keeps_one_row_of_each_group(spark, nothing):
    words = [f"w{k}" for k in range(120)]
    a, b = " ".join(words), " ".join([*words[:60], "new", *words[61:]])
    rows = [(5, a, "x"), (5, a, "x"), (5, a, "y"), (3, b, "x"), (None, a, "x"), (7, "alone " + b[::-1], "x")]
    rows += [(None, "clean text of a page without an id " + " ".join(f"n{k}" for k in range(90)), "x")] * 2
    rows += [(None, "another one without an id " + " ".join(f"m{k}" for k in range(90)), "x"), (9, "", "x"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    found = sorted(((r.doc_id, (r.text or "")[:5]) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    assert found == sorted([(3, "w0 w1"), (7, "alone"), (None, "clean"), (None, "anoth"), (9, "")], key=str)


def test_repeated_rows_of_near_copies_cost_no_pairs(spark):
    from haltwerk.llm import minmax_dedup

    words = [f"w{k}" for k in range(200)]
    a, b = " ".join(words), " ".join([*words[:100], "new", *words[101:]])
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").crossJoin(spark.range(1000)).select("doc_id", "text").repartition(4)
    involved = minmax_dedup._distinct_texts(docs)
    assert involved.count() == 2
    found = minmax_dedup.near_duplicates(docs).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1000), (2, 1, 1000)]
