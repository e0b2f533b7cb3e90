"""Main text of generated pages whose article is known: nothing of it may be missing, nothing else may be there."""

import random

import pytest

from runlens.llm import html

FURNITURE = [
    "<nav><ul><li><a href=/a>menu one</a></li></ul></nav>", "<header><p>site name</p></header>", "<footer><p>foot line</p></footer>",
    "<aside><p>side bar</p></aside>", "<div class='ad-box'>buy this</div>", "<div id=cookie-notice><p>we use cookies</p></div>",
    "<form><label>your mail</label><input></form>", "<script>var x = '<p>code</p>';</script>", "<style>p{}</style>", "<!-- <p>hidden</p> -->",
    "<div class='left-sidebar'><p>links</p></div>", "<div role=navigation>go on</div>", "<div style='display: none'>unseen</div>",
    "<section class='post-comments'><p>first!</p></section>", "<ul class='article-related'><li>more to read</li></ul>", "<select><option>pick</select>"]

PARTS = [
    (lambda t: f"<h2>{t}</h2>", 3), (lambda t: f"<p>{t}</p>", 40), (lambda t: f"<p>{t}", 20), (lambda t: f"<blockquote>{t}</blockquote>", 15),
    (lambda t: f"<ul><li>{t}</ul>", 5), (lambda t: f"<div class=article-header>{t}</div>", 4), (lambda t: f"<section class=notes-3><p>{t}</p></section>", 12),
    (lambda t: f"<table><tr><td>{t}</table>", 6), (lambda t: f"<p>so <math><mi>{t}</mi></math> holds</p>", 2), (lambda t: f"<header>{t}</header>", 5),
    (lambda t: f"<div><div class='x y'><span>{t}</span></div></div>", 9), (lambda t: f"<pre>{t}</pre>", 7), (lambda t: f"<p>see <label>{t}</label></p>", 2),
    (lambda t: f"<div class=entry-banner><p>{t}</p></div>", 4), (lambda t: f"<p>map <map>{t}</map> <object>{t}</object></p>", 2)]
TEXT_AROUND = {8: "so {} holds", 12: "see {}", 14: "map {0} {0}"}


def page(rng, sentence, shell):
    """(html, text of the article)"""
    inside, text, bare = [], [], shell == "none"
    for n in range(rng.randint(3, 9)):
        kind = rng.randrange(len(PARTS))
        if bare and kind == 9:  # without an article element, a header is the page's
            continue
        make, length = PARTS[kind]
        words = sentence(rng.random(), length)
        inside.append(make(words))
        text.append(TEXT_AROUND.get(kind, "{}").format(words))
        if rng.random() < 0.4:
            inside.append(rng.choice([f for f in FURNITURE if "<header" not in f]))
    lead = sentence(rng.random(), 90)
    at = rng.randint(0, len(inside))
    text.insert(sum(x not in FURNITURE for x in inside[:at]), lead)
    inside.insert(at, f"<p>{lead}</p>")
    body = "".join(inside)
    body = {"article": f"<article>{body}</article>", "main": f"<main><div class=content>{body.replace('<header>', '<div>').replace('</header>', '</div>')}</div></main>",
            "nested": f"<main><article class=post-12>{body}</article></main>", "none": f"<div id=page>{body}</div>"}[shell]
    furniture = rng.sample(FURNITURE, 4)
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(furniture[:2])}{body}{''.join(furniture[2:])}</body></html>", "\n".join(text)


@pytest.mark.parametrize("shell", ["article", "main", "nested", "none"])
def test_recall_and_precision_of_article_text(spark, sentence, shell):
    rng = random.Random(shell)
    rows, want = [], {}
    for n in range(120):
        source, text = page(rng, sentence, shell)
        host = f"h{n % 4}.org" if n < 100 else f"single{n}.org"
        for copy in range(1 + (n % 5 == 0) + 6 * (n == 7)):
            rows.append((1000 * copy + n, f"https://{host}/{n}", source))
            want[1000 * copy + n] = text
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    kept = sum(len(set(want[i].split("\n")) & set(found[i].split("\n"))) for i in want)
    assert kept == sum(len(set(t.split("\n"))) for t in want.values())
    assert found == want


def test_repeated_pages_and_rare_sections_lose_nothing(spark, sentence):
    title, text = sentence(1, 5), sentence(2, 50)
    twice = f"<body><article><h1>{title}</h1><div class=body><p>{text}</p></div></article></body>"
    bare = f"<body><h1>{title}</h1><div class=body><p>{text}</p></div></body>"
    rows = [(n, "http://twice.org/", twice) for n in range(2)] + [(10 + n, "http://bare.org/", bare) for n in range(20)]
    want = dict.fromkeys([0, 1, *range(10, 30)], f"{title}\n{text}")
    for n in range(10):
        notes = sentence(100 + n, 12)
        body = f"<div class=text><p>{sentence(50 + n, 60)}</p></div>" + (f"<section class=notes>{notes}</section>" if n < 4 else "")
        rows.append((100 + n, f"http://rare.org/{n}", f"<body>{body}<div class=imprint>the same on all pages</div></body>"))
        want[100 + n] = sentence(50 + n, 60) + (f"\n{notes}" if n < 4 else "")
    long = " ".join(sentence(7, 40) for _ in range(2500))
    rows += [(200, "http://long.org/", f"<body><article>{'<p>' + long + '</p>'}{'<div>' * 300}{text}</article></body>"), (201, None, twice), (202, "http://x.org", None), (203, "http://x.org", "")]
    want |= {200: f"{long}\n{text}", 201: f"{title}\n{text}", 202: "", 203: ""}
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == want
