"""Toxicity, licences and pages: held-out quality, exact wording and planted pages."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from silovalue.llm import html_cut, licenses, mixing, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.digest(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and got.score.between(0, 1).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    caught, right = got.predicted[got.toxic == 1].mean(), got.toxic[got.predicted == 1].mean()
    assert (got.toxic == 1).sum() >= 50 and caught >= 0.85 and right >= 0.9
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "good day " * 50_000, "x")], "doc_id bigint, text string, score string")
    assert {r.doc_id: r.predicted for r in toxicity.digest(odd, model).collect()}.keys() == {1, 2, 3}
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns
    assert toxicity.digest(odd.where(F.lit(False)), model).count() == 0


def test_folding_undoes_disguises():
    assert toxicity.fold("Hеllо") == toxicity.fold("hello")
    assert toxicity.fold(None) == toxicity.fold("")


FILLER = "an ordinary text about gardens and the weather of the year\n" * 6


def copies_of(spark, rows, **options):
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()
    return sorted((r.doc_id, r.first_line, r.last_line, r.license, r.missing, r.added) for r in found)


def test_planted_licences_are_found_with_their_lines(spark):
    rows = [(i, f"{FILLER}{text}\n{FILLER}") for i, text in enumerate(licenses.TEMPLATES.values())]
    exact = [x for x in copies_of(spark, rows) if not x[4] and not x[5]]
    names = list(licenses.TEMPLATES)
    for i, name in enumerate(names):
        assert (i, 6, 6, name, [], []) in exact


def test_two_copies_in_one_block_and_their_differences(spark):
    notice = licenses.TEMPLATES["MIT-notice"]
    altered = notice.replace("free of charge", "at no charge").replace("merge, ", "")
    rows = [(1, f"{notice}\n{notice}"), (2, f"{altered}\nand so on\n{notice}"), (None, notice), (4, notice + " x" * 60_000), (5, None), (6, ""), (7, FILLER * 40)]
    found = [x for x in copies_of(spark, [r for r in rows if r[0] is not None]) if x[3] == "MIT-notice"]
    assert [x[:3] for x in found] == [(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 2, 2), (4, 0, 0)]
    changed = found[2]
    assert "merge" in changed[4] and "free" in changed[4] and "at" in changed[5] and found[3][4] == found[3][5] == []
    assert [r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id IS NULL").collect()] == ["MIT-notice"]
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert not [x for x in copies_of(spark, rows[1:2], most_different=0.0) if x[:2] == (2, 0)]


def test_page_text_leaves_the_frame_out(spark):
    article = "".join(f"<p>Sentence {i} of the report&nbsp;tells what was &amp; was not measured in the long second year.</p>" for i in range(8))
    page = f"<html><head><style>p{{}}</style></head><body><nav><a href=1>Home</a> <a href=2>Shop</a></nav><article><h1>Report</h1>{article}</article><footer>Copyright notice</footer><script>var a=1</script></body></html>"
    rows = [(1, "u", page, "z"), (2, "u", None, "z"), (3, "u", "", "z"), (4, "u", page, "z"), (5, None, "<p><<b", "z")]
    got = {r.page_id: r for r in html_cut.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars string")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1].text == got[4].text and all(r.n_chars == len(r.text) for r in got.values())
    assert len(re.findall("Sentence", got[1].text)) == 8 and "&" in got[1].text
    assert not re.search("Home|Copyright|var a|<p>", got[1].text)
    assert got[2].text == got[3].text == ""


SENTENCES = "".join(f"<p>Sentence {i} of the report tells what was and was not measured in the long second year.</p>" for i in range(8))
FRAME = (
    '<div class="cookie-banner"><p>We use cookies to improve your experience on this site, as all do.</p></div><nav><a href=1>Home</a></nav>',
    '<footer>Copyright notice of all</footer>')
COMMENTS = '<div class="comments"><p>' + "I disagree with this whole thing, said one reader at length. " * 12 + "</p></div>"


@pytest.mark.parametrize("after", ["", COMMENTS])
@pytest.mark.parametrize("wrapper", [
    '<div class="layout with-sidebar">%s</div>', '<div class="page has-comments">%s</div>', '<article class="post social-story">%s</article>',
    '<main id="search-results-story">%s</main>', '<div class="related-story">%s</div>', "<div>%s</div>", "<article>%s</article>",
    '<div class="content sidebar-layout"><div class="article">%s</div></div>'])
def test_names_of_wrappers_do_not_lose_the_article(wrapper, after):
    text = "\n".join(html_cut.main_blocks(f"<html><body>{FRAME[0]}{wrapper % SENTENCES}{after}{FRAME[1]}</body></html>"))
    assert text.count("Sentence") == 8 and not re.search("disagree|cookies|Home|Copyright", text)


def test_frames_inside_and_around_an_article_stay_out():
    inner = '<aside><p>Read this other thing too, it is so very good and long.</p></aside><ul class="share-buttons"><li>Share this story now.</li></ul>'
    table = "<table><tr><td>Cell one of the table says a thing.</td><td>Cell two says another thing.</td></tr></table>"
    page = f"<body><header><p>The site of sites for all who read.</p></header><article>{SENTENCES}{inner}{table}<ol><li>First point of the list, in words.</li></ol></article><form><p>Sign up for our letter, it is free for all of you.</p></form></body>"
    text = "\n".join(html_cut.main_blocks(page))
    assert text.count("Sentence") == 8 and "Cell two" in text and "First point" in text
    assert not re.search("other thing too|Share this|site of sites|Sign up", text)
    assert html_cut.main_blocks(f"<body><article>{SENTENCES * 400}</article></body>").__len__() == 3200


def test_pages_of_an_empty_table(spark):
    assert html_cut.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_stages_drop_what_they_should_and_nothing_else(spark):
    """Each stage on its own input, the rows of sf0.001 and odd ones, against the operators' rows and brute force."""
    from test_join import groups_by_brute_force

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "source mix", "packing"]
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9001, None), (9002, ""), (9002, ""), (None, "a text without an id"), (9003, "long " * 30_000)]
    docs = given.unionByName(spark.createDataFrame([(d, t, "en", None, 0) for d, t in odd], "doc_id bigint, text string, lang string, source string, n_chars int").select(
        *[F.col(c).cast(k).alias(c) for c, k in given.dtypes])).cache()
    toxic, near, mix, pack = (stage for _, stage in corpus_pipeline.STAGES)
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)

    clean = toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    clean_rows = clean.collect()
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert key(clean_rows) == key(r.doc for r in scored if r.score < 0.5)
    more = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < toxic(spark, more, SF).count() < more.count()

    one = near(spark, spark.createDataFrame(clean_rows, docs.schema), sf)
    assert one.columns == docs.columns
    one_rows = one.collect()
    groups = groups_by_brute_force([(r.doc_id, r.text) for r in clean_rows if r.doc_id is not None])
    named = [r.doc_id for r in one_rows if r.doc_id is not None]
    assert sorted(set(named)) == sorted(set(groups.values())) and sum(r.doc_id is None for r in one_rows) == sum(r.doc_id is None for r in clean_rows)

    kept = spark.createDataFrame(one_rows, docs.schema)
    mixed = mix(spark, kept, sf)
    assert mixed.columns == docs.columns
    mixed_rows = mixed.collect()
    wanted = {}
    for r in mixing.digest(mixing.mix(kept)).where("doc_id IS NOT NULL").collect():
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.copies
    assert {d: sum(r.doc_id == d for r in mixed_rows) for d in wanted} == wanted

    packed = pack(spark, spark.createDataFrame(mixed_rows[:40], docs.schema), sf).collect()
    assert sum(r.length for r in packed if r.doc_id == mixed_rows[0].doc_id) == sum(
        r.doc_tokens for r in packed if r.doc_id == mixed_rows[0].doc_id and r.start == 0)
    assert corpus_pipeline.run(spark, sf).count() > 0
