"""Windows run on every page; article and main only move their points."""

import re

import duckdb

from torqueline.llm import html_extract
from torqueline.llm.html_extract import main_text

PARA = ("A sentence of the main text that goes on for some while, as sentences do. " * 3).strip()
LINKS = "<div><a href=x>link</a></div>" * 9


def test_body_beside_marked_comments_stays():
    body = f"<div>{PARA}</div>" * 3
    for names in ('class="comment"', 'id="div-comment-5" class="comment-body even"', "class=reply"):
        assert main_text(f"<body>{LINKS}{body}{LINKS}<article {names}><p>{PARA} Reader</p></article></body>") == "\n\n".join([PARA] * 3)
    teasers = "<article><a href=x>Read this too</a></article><article>Two words</article>"
    assert main_text(f"<body>{LINKS}{body}{LINKS}{teasers}</body>") == "\n\n".join([PARA] * 3)


def test_tags_move_the_points_to_the_ends_of_the_article():
    page = f"<body><div>Short before</div><article><h1>Head</h1><p>a</p><p>b</p><p>c</p><p>{PARA}</p><p>d</p><p>e</p><p>f</p><p>Last</p></article><div>Short after</div></body>"
    assert main_text(page) == "\n\n".join(["Head", "a", "b", "c", PARA, "d", "e", "f", "Last"])
    assert main_text(f"<main><p>Only short</p></main>{LINKS}<div>other</div>") == "Only short"
    assert main_text(f'<article class="post comment-open"><p>{PARA}</p></article>') == PARA


def test_text_outside_a_marked_part_has_windows_of_its_own():
    assert main_text(f"<div>{PARA}</div>{LINKS}<article><p>{PARA} More</p></article><div>tail</div>") == f"{PARA}\n\n{PARA} More"


LONG = "<p>" + "A paragraph of some length that is the text of the page. " * 3 + "</p>"


def article(inside, tag="article"):
    return f"<html><head><title>t</title></head><body><nav>menu</nav><{tag}><h1>Head</h1>{inside}{LONG}<p>End.</p></{tag}><footer>foot</footer></body></html>"


def test_names_of_text_inside_an_article_drop_nothing():
    for part in ('<h2 class="section-header">Kept</h2>', '<p class="side-note">Kept</p>', '<div class="related-work">Kept</div>', '<section id="search"><p>Kept</p></section>',
                 '<figure class="banner"><img src="x"><figcaption>Kept</figcaption></figure>', '<p>One <span class="comment">Kept</span> more</p>'):
        assert "Kept" in html_extract.main_text(article(part)), part
    for part in ('<div class="ad-slot">Gone</div>', '<section id="comments"><p>Gone</p></section>', '<aside>Gone</aside>', '<div class="x share-buttons">Gone</div>', '<form>Gone</form>'):
        text = html_extract.main_text(article(part))
        assert "Gone" not in text and text.startswith("Head") and text.endswith("End."), part


def test_windows_find_the_same_text_without_the_tags():
    """Pages of the given kind, with the article's tags renamed: its short first and last blocks are found by the windows alone."""
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()
    for (page,) in rows:
        renamed = re.sub(r"(</?)(?:article|main)\b", r"\1div", page, flags=re.I)
        assert html_extract.main_text(renamed) == html_extract.main_text(page)
    assert html_extract.main_text(article("<p>Short.</p>", "div")) == html_extract.main_text(article("<p>Short.</p>"))


def test_a_dive_ends_a_stretch():
    links = "".join(f"<p><a href='{i}'>link {i}</a></p>" for i in range(4))
    page = f"<body><div>{LONG}<p>End.</p>{links}<p>after</p></div></body>"
    assert html_extract.main_text(page).endswith("End.")
    assert html_extract.between([0, 5, 0, 0, 0, 90, 0, 3, 0, 0, 0, 7], 3, 80) == [i in (5, 6, 7) for i in range(12)]


def test_pieces_of_a_text_have_all_its_ngrams(monkeypatch):
    import numpy as np

    from torqueline.llm import lang_id

    text = "Ein Wort, zwei  Wörter 12 und drei." * 9
    whole = np.sort(np.concatenate(list(lang_id.pieces(lang_id.points_of(text)))))
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(lang_id, "PIECE", size)
        assert (np.sort(np.concatenate(list(lang_id.pieces(lang_id.points_of(text))))) == whole).all()
