import random
import re

from llm import html_extraction as H
from llm import license_scan as S
from llm import url_filter as U

URLS = ["http://M.Casino-Win.example.com/EN/1", "https://shop.example.net/en/a?x=http://b", "https://a.example.net/de/", "http://x.net", "http://x.net/",
        "no scheme", "", None, "http://a.example.com/de/x#y", "ftp://q.org/fr/", "http://cheapest-pillsbury.org/", "http://cheap-pills.org/", "http://kasinoé-casinoé.com/",
        "http://notexample.net/en/", "http://example.net/en/x"]


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages).collect()}
    assert got == {0: ("m.casino-win.example.com", "/EN/1", None, "block"), 1: ("shop.example.net", "/en/a", "example.net/en/", "allow"),
                   2: ("a.example.net", "/de/", "net/", "block"), 3: ("x.net", "", None, "allow"), 4: ("x.net", "/", "net/", "block"),
                   5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("a.example.com", "/de/x", "example.com/de/", "block"),
                   9: ("q.org", "/fr/", "org/fr/", "allow"), 10: ("cheapest-pillsbury.org", "/", None, "allow"), 11: ("cheap-pills.org", "/", None, "block"),
                   12: ("kasinoé-casinoé.com", "/", None, "allow"), 13: ("notexample.net", "/en/", "net/", "block"), 14: ("example.net", "/en/x", "example.net/en/", "allow")}
    assert U.filter_urls(pages.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="top"><a href="/">Home</a> Site</header>
<div class="cookie-notice">We use cookies</div><nav><ul><li><a href=x>A</a></li></ul></nav>
<div class="content"><h2>Title &eacute; &amp; more</h2><div><p>First para with <a href="#">link</a>&nbsp;inside.</p></div><div class="ad-box">Buy!</div>
<p>Second
 para.<script>var x="</p>";</script> End</p><ul><li>item one</li></ul></div><aside><p>Side text that is long enough to matter</p></aside>
<section id="comments"><p>Great post, I agree with all of it</p></section><form><p>Mail</p></form><footer>foot</footer></body></html>"""


def test_pages(spark):
    assert H.main_blocks(PAGE) == ["Title é & more", "First para with link inside.", "Second para. End", "item one"]
    assert H.main_blocks("<article><h1>A</h1><p>b<br>c<p>d</article><div>far longer text outside of the article</div>") == ["A", "b c", "d"]
    assert H.main_blocks("<article><p>cut off &amp; <b>here</b") == ["cut off & here"]
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "", "t"), (4, "u", "<p>" + "x " * 50_000, "t"), (5, "u", "<nav>a</nav><!-- b", "t")]
    got = sorted((r.page_id, r.n_chars) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [(1, 72), (2, 0), (3, 0), (3, 0), (4, 99_999), (5, 0)]


def test_licences(odd, none, docs_of):
    rows = [(1, "x Released under the MIT License. y"), (2, "the mit of a license"), (3, "A B All rights, reserved; CC-BY cc by"), (4, None), (4, None),
            (5, "w " * 500 + "This work is licensed under the GNU General Public License, version 3."), (5, "General Public License"), (6, "Licensed under the Apache License, Version 2.0")]
    got = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in S.scan(docs_of(rows)).collect()}
    assert got[1, 7] == (0, None, None, "", "mit") and got[2, 5] == (0, None, None, "", "")
    assert got[3, 9] == (3, 2, 7, "cc-by,reserved", "cc-by,reserved") and got[4, 0] == (0, None, None, "", "")
    assert got[5, 512] == (1, 507, 507, "gpl", "gpl,gpl-3.0") and got[5, 3] == (1, 0, 0, "gpl", "gpl") and got[6, 8][4] == "apache-2.0"
    every = S.scan(odd).collect()
    assert len(every) == odd.count() and [r.base_labels for r in every if r.doc_id is None] == ["cc-by"] and S.scan(none).count() == 0
    for i, text in rows:
        n = len(re.findall(S.WORD, (text or "").lower()))
        assert got[i, n][0] == sum(len(S.matches(text, p)) for p, _ in S.BASE)


def test_several_licences_in_one_file(docs_of):
    parts = ["Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0", "Released under the MIT License",
             "Licensed under the GNU General Public License version 3", S.TEMPLATES[1][1], S.TEMPLATES[5][1]]
    rows = [(1, "\n\n".join(parts)), (2, f"binary charge obtaining software unencumbered mozilla lesser hereby {parts[2]}")]
    rows += [(k, "plain words") for k in range(3, 40)] + [(k, p) for k, p in enumerate(parts, 40)]
    got = {r.doc_id: set(r.labels.split(",")) for r in S.scan(docs_of(rows)).collect()}
    assert got[1] == {"apache-2.0", "cc-by", "cc-by-nc-4.0", "mit", "gpl", "gpl-3.0", "bsd", "isc"} and got[2] == {"mit"}


def test_lead_outside_the_largest_container_stays():
    page = "<body><div class=content><div class=lead><p>{}</p></div><div class=text><section><p>{}</p></section><section><p>{}</p></section></div></div></body>"
    parts = ["lead " * 25, "first " * 20, "second " * 80]
    assert H.main_blocks(page.format(*parts)) == [p.strip() for p in parts]


def by_windows(lengths, window, surge):
    """Places of the lines kept: those of runs of windows that hold text, where one window of the run holds enough."""
    sums = {i: sum(lengths[max(0, i):i + window]) for i in range(1 - window, len(lengths))}
    kept, run = [], []
    for i in [*sums, None]:
        if i is not None and sums[i]:
            run.append(i)
            continue
        if run and max(sums[j] for j in run) >= min(surge, max(sums.values())):
            kept += [j for j in run if j >= 0 and lengths[j]]
        run = []
    return kept


def test_stretches_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 5, 30, 60]) for _ in range(rng.randrange(25))]
        for window, surge in ((1, 30), (3, 86), (4, 0), (5, 1000)):
            got = [i for low, high in H.stretches(lengths, window, surge) for i in range(low, high) if lengths[i]]
            assert got == by_windows(lengths, window, surge)


STORY = ["first part of the story " * 8, "second part of the story " * 20, "third part of the story " * 12]


def test_windows_choose_the_text(monkeypatch):
    menu = "<nav><ul><li>a</li><li>b</li><li>c</li></ul></nav>"
    page = f"<body><div>Home News Contact</div>{menu}{''.join(f'<p>{p}</p>' for p in STORY)}{menu}<div>Copyright 2020 Foo Inc</div></body>"
    story = [p.strip() for p in STORY]
    assert H.main_blocks(page) == story
    assert H.main_blocks(f"<body><div>Home</div>{menu}<p>short</p></body>") == ["short"]
    wide = H.stretches
    monkeypatch.setattr(H, "stretches", lambda lengths: wide(lengths, 9))
    assert H.main_blocks(page) == ["Home News Contact", *story, "Copyright 2020 Foo Inc"]


def test_no_name_or_article_alone_drops_the_story():
    text, story = "".join(f"<p>{p}</p>" for p in STORY), [p.strip() for p in STORY]
    for page in ("<form id=aspnetForm>{}</form>", "<div id=ad-hoc-networks>{}</div>", "<aside><div class=search-results-for-river>{}</div></aside>",
                 "<form id=f><div class=ad>Buy this!</div>{}</form>"):
        assert H.main_blocks(f"<body>{page.format(text)}</body>") == story
    for page in ("<article>A teaser of something else</article>", "<main><p>One line</p></main>"):
        assert H.main_blocks(f"<body>{page}{text}</body>")[1:] == story
    assert H.main_blocks(f"<body><article>{text}</article><p>Something else</p></body>") == story
