"""Main text that stands outside the densest container."""

from runlens.llm import html


def test_headline_and_sections_beside_the_densest_container(spark, sentence):
    rows, want = [], {}
    menu = "<div class=links><a href=/1>one link</a> <a href=/2>and another</a></div><div class=imprint>Same on every page</div>"
    for n in range(6):
        title, intro, main, tail = sentence(10 + n, 6), sentence(20 + n, 40), sentence(30 + n, 80), sentence(40 + n, 10)
        rows.append((n, f"http://a.org/{n}", f"<body>{menu}<article><h1>{title}</h1><div class=body><p>{main}</p></div><section><div><p>{tail}</p></div></section></article></body>"))
        want[n] = f"{title}\n{main}\n{tail}"
        rows.append((10 + n, f"http://b.org/{n}", f"<body>{menu}<div class=intro>{intro}</div><div class=main><p>{main}</p></div></body>"))
        want[10 + n] = f"{intro}\n{main}"
    # A page of another layout is judged on its own.
    rows.append((99, "http://a.org/other", f"<body>{menu}<main><h2>Head</h2><div class=text>{sentence(60, 50)}</div></main></body>"))
    want[99] = f"Head\n{sentence(60, 50)}"
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r for r in html.main_text(pages).collect()}
    assert {i: r.text for i, r in found.items()} == want
    assert all(r.n_chars == len(r.text) for r in found.values())
