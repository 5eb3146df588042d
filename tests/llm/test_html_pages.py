from auditspark.llm.html_extract import extract, main_text


def test_unclosed_silent_elements_end_with_what_holds_them():
    choice = "<select><option>1<option>2</select>"
    assert main_text(f"<article><p>a</p><form>{choice}</form><p>b</article>") == "a\nb"
    assert main_text(f"<p>a</p>{choice}<p>b</p><p>c") == "a\nb\nc"
    assert main_text("<div><button>Go</div><p>b") == "b"
    assert main_text("<p>a<object><p>x<svg></object><p>b") == "a\nb"
    assert main_text("<div><select><optgroup><option>1<option>2</select>a</div>") == "a"


def test_names_of_layouts_and_titles_drop_no_text():
    assert main_text("<article><h2 id=related-work>Related work</h2><section id=discussion><p>d</section>"
                     "<section class=comments><p>me too</section></article>") == "Related work\nd"
    for name in ("content no-sidebar", "page has-header", "sidebar"):
        assert main_text(f"<div class='{name}'><p>the long text of the page</div><p>x") == "the long text of the page\nx"
    assert main_text("<div class='site-footer'>f</div><p>the long text") == "the long text"


def test_copies_of_a_page_are_no_template(spark):
    def page(*texts):
        return "<div class=top>Site</div>" + "".join(f"<div class=b{k}><p>{t}</div>" for k, t in texts)

    rows = [(i, f"http://a.example/{i}", page((0, f"text {i}"))) for i in range(8)]
    rows += [(10 + i, f"http://a.example/c{i}", page((1, "copied"), (2, "twice"))) for i in range(2)]
    rows += [(20 + i, f"http://b.example/{i}", page((0, "only page"))) for i in range(3)]
    rows += [(30, "http://c.example/1", page((0, "x"))), (31, "http://c.example/2", page((0, "y")))]
    got = {r.page_id: r.text for r in extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == got[11] == "copied\ntwice" and all(got[i] == f"text {i}" for i in range(8))
    assert {got[i] for i in (20, 21, 22)} == {"Site\nonly page"} and (got[30], got[31]) == ("x", "y")


def test_wrappers_decide_marked_pages_too(spark):
    rows = [(i, f"http://a.example/{i}", f"<main><p>the long main text of page {i}</p><article>card {i}</article></main>")
            for i in range(3)]
    rows += [(10 + i, f"http://b.example/{i}", f"<article><p>text {i}</p><div>Printed from b</div></article><p>x{i}")
             for i in range(3)]
    rows += [(20, "http://c.example/1", "<div>the long text of the page</div><article>card</article>")]
    got = {r.page_id: r.text for r in extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"the long main text of page {i}\ncard {i}" for i in range(3))
    assert all(got[10 + i] == f"text {i}" for i in range(3))
    assert got[20] == "the long text of the page\ncard"


def test_names_of_parts_values_of_attributes_and_formulas_drop_no_text():
    part = '<div class="elementor-widget elementor-widget-text-editor"><p>part {}</p></div>'
    parts = "".join(part.format(i) for i in range(4))
    for page in (f"<body>{parts}</body>", f"<article>{parts}</article>"):
        assert main_text(page) == "part 0\npart 1\npart 2\npart 3"
    assert main_text("".join(f'<div class="widget-text">w{i}</div>' for i in range(3))) == "w0\nw1\nw2"
    assert main_text('<article><section title="the hidden cost"><p title="a hidden gem">kept</p></section>'
                     '<p hidden>gone</p><p hidden="">gone</p><p HIDDEN>gone</p></article>') == "kept"
    assert main_text("<article><p>where <math><mi>x</mi></math> is small</p></article>") == "where x is small"
    # comments stay out, however long they are together
    said = "".join(f'<div class="comment"><p>opinion {i} at some length</p></div>' for i in range(9))
    assert main_text(f"<body><p>the text of the page stands here, long enough</p>{said}</body>") == (
        "the text of the page stands here, long enough")
