from tickerloom.llm.html_text import (
    LAYOUTS, Field, blocks_of, fit_field, labelled_pages, main_text, main_texts, page_features, relaid, train,
)

PAGE = (
    "<!DOCTYPE html><html><head><title>Title {k}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    "<body><nav><ul><li><a href='/a'>Home {k}</a></li><li><a href='/b'>About</a></li></ul></nav><div class='ad'>Buy {k} now.</div>"
    "<article><h1>Title {k}</h1><p><b>First &amp; foremost {k}, a sentence with several words in it.<br><p>Second\n  one &copy;"
    " with more of the same words, number {k}.</p></article><footer>&copy; site {k}</footer>"
)
MAIN = "Title {k}\nFirst & foremost {k}, a sentence with several words in it.\nSecond one © with more of the same words, number {k}."


def test_blocks_of_malformed_markup():
    texts = [b.text for b in blocks_of("<p>a<b>c</b> d<p>e<div>f &amp g</div>&lt;x<br>y</p><ul><li>1<li>2</ul><script>if(a<b)</script>z<!-- c")]
    assert texts == ["ac d", "e", "f & g", "<x y", "1", "2", "z"]
    assert blocks_of("") == [] and blocks_of("<<<>>") != [] and blocks_of("<script>never closed") == []
    assert [b.text for b in blocks_of("<td>" * 5000 + "x")] == ["x"]


def test_field_learns_layouts_it_has_not_seen_filled():
    model = fit_field(labelled_pages([PAGE.format(k=k) for k in range(40)]))
    for k in range(40, 60):
        main, rest = [f"A paragraph about {k}, of some length and sense.", f"Then another, {k}."], ["Home", "News", "Ad", "Top", "Log in"]
        page = relaid(main, rest, k % LAYOUTS)
        wrong = [b for b, y in zip(blocks_of(page), model.decode(page_features(blocks_of(page))), strict=True) if b.main != y]
        assert not wrong


def test_viterbi_is_the_best_of_all_sequences():
    from itertools import product

    model = Field({"a": 0.7, "b": -0.4, "c": 0.1}, ((0.3, -0.5), (-0.2, 0.4)))
    features = [["a"], ["b"], ["c", "b"], ["a", "c"], ["b", "b"]]
    emit = [sum(model.weights[f] for f in own) for own in features]

    def score(y):
        return sum(e for e, v in zip(emit, y, strict=True) if v) + sum(model.transition[p][q] for p, q in zip(y, y[1:], strict=False))

    assert score(model.decode(features)) == max(map(score, product((0, 1), repeat=5)))


def test_table(spark):
    rows = [(k, f"u{k}", PAGE.format(k=k), 1) for k in range(60)] + [(60, None, None, 1), (None, "u", "", 1), (0, "u0", PAGE.format(k=0), 1)]
    rows.append((61, "long", "<article>" + "<p>Word, word and word.</p>" * 20_000 + "</article>", 1))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = main_texts(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert all(by_id[k].text == MAIN.format(k=k) for k in range(60))
    assert by_id[60].text == "" and by_id[None].n_chars == 0
    assert by_id[61].text.count("\n") == 19_999 and by_id[61].n_chars == len(by_id[61].text)
    assert main_texts(pages.limit(0)).count() == 0
    assert main_text("", Field()) == ""


def test_text_of_embedded_elements_is_left_to_the_field():
    page = (
        "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <svg><path d='M0'/></svg>here.</p>"
        "<p>Then <object><p>a film</p></object> and <canvas>a chart</canvas>more.<noscript>No script &amp; text</noscript></p>"
        "<template><p>later</p></template><iframe>frame</iframe><style>p{}</style><svg><text>drawn</text></svg></article>"
    )
    got = {b.text: [t for t, _ in b.path] for b in blocks_of(page)}
    assert list(got) == [
        "So x=2 holds here.", "Then", "a film", "and", "a chart", "more.", "No script & text", "later", "frame", "drawn"
    ]
    assert got["Then"] == ["article", "p"] and got["a film"] == ["article", "p", "object", "p"] and "canvas" in got["a chart"]
    assert "noscript" in got["No script & text"] and got["drawn"] == ["article", "svg"]
    for name in ("object", "canvas", "math", "svg", "noscript", "template", "iframe"):
        assert [b.text for b in blocks_of(f"<p>before<{name}><p>after</p><div>end</div>")] == ["before", "after", "end"]


def test_sample_is_of_distinct_pages_and_of_long_ones_where_none_is_short(spark):
    rows = [(PAGE.format(k=k),) for k in range(12) for _ in range(1 + 40 * (k % 2))]
    pages = spark.createDataFrame([*rows, (None,)], "html string").repartition(3)
    distinct = spark.createDataFrame([(PAGE.format(k=k),) for k in range(12)], "html string")
    assert train(pages, sample=12) == train(distinct, sample=12)
    model = train(pages, longest=100)
    assert main_text(PAGE.format(k=99), model) == MAIN.format(k=99)
