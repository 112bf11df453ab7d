"""Labelled pages for the content model: varied layouts written by a seeded generator, each text marked as content or not.

A text that belongs to the article lies in an element with the attribute ``data-content="1"`` (or below one, up to an
element with ``data-content="0"``).  The parser reads the marks as labels; features never see them.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo ar en il or un ste".split()


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentence(rng: random.Random) -> str:
    return _words(rng, rng.randint(1, 18)).capitalize() + "."


def _paragraph(rng: random.Random) -> str:
    if rng.random() < 0.15:  # junk and markup characters occur in articles too
        return " ".join(w + rng.choice(["***", "$$$", "!!", " |", "&amp;&amp;"]) for w in _words(rng, rng.randint(3, 30)).split())
    text = " ".join(_sentence(rng) for _ in range(rng.choice([1, 1, 2, 4, 8])))
    if rng.random() < 0.2:
        text = text.replace(" ", f' <a href="/{_words(rng, 1)}">{_words(rng, 2)}</a> ', 1)
    return text


def _article(rng: random.Random) -> str:
    parts = [f"<h1>{_words(rng, rng.randint(2, 9)).capitalize()}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 8)):
        kind = rng.random()
        if kind < 0.7:
            parts.append(rng.choice(["<p>%s</p>", "<p>%s", "<p><b>%s</b></p>", "<p><b>%s<br>", "<div>%s</div>", "%s<br><br>"]) % _paragraph(rng))
        elif kind < 0.8:
            parts.append(f"<h2>{_words(rng, 4)}</h2><p>{_paragraph(rng)}</p>")
        elif kind < 0.87:
            parts.append("<ul>" + "".join(f"<li>{_sentence(rng)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            parts.append("<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 2)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.96:
            parts.append(f"<blockquote>{_paragraph(rng)}</blockquote>")
        else:
            parts.append(f"<pre>{_words(rng, 8)}</pre><figure><figcaption>{_sentence(rng)}</figcaption></figure>")
        if rng.random() < 0.1:
            parts.append(f'<div class="{rng.choice(["ad", "advert", "share-buttons", "related", "newsletter-form"])}" data-content="0">{_sentence(rng)}</div>')
    return "".join(parts)


def _links(rng: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{_words(rng, 1)}">{_words(rng, rng.randint(1, 3))}</a></li>' for _ in range(n)) + "</ul>"


def labelled_page(seed: int) -> str:
    rng = random.Random(seed)
    box = lambda tags, names, body: (lambda t: f'<{t}{rng.choice(["", *names]) if t not in ("div", "section") else rng.choice(names)}>{body}</{t}>')(rng.choice(tags))
    named = lambda *names: [f' class="{n}"' for n in names] + [f' id="{n}"' for n in names]
    top, bottom = [], []
    if rng.random() < 0.8:
        top.append(box(["nav", "div", "ul"], named("nav", "menu", "main-menu", "navbar"), _links(rng, rng.randint(3, 8))))
    if rng.random() < 0.4:
        top.append(box(["header", "div"], named("header", "masthead", "site-header"), f"<h2>{_words(rng, 2)}</h2><p>{_sentence(rng)}</p>"))
    for _ in range(rng.randint(0, 2)):
        kind = rng.choice([named("ad", "advert", "ads banner", "sponsor", "promo"), named("cookie-notice", "consent", "notice", "alert", "popup")])
        rng.choice([top, bottom]).append(f"<div{rng.choice(kind)}>{' '.join(_sentence(rng) for _ in range(rng.randint(1, 4)))}</div>")
    if rng.random() < 0.4:
        rng.choice([top, bottom]).append(box(["aside", "div"], named("sidebar", "related", "widget", "recommended"), f"<h3>{_words(rng, 2)}</h3>" + _links(rng, 3) + f"<p>{_sentence(rng)}</p>"))
    if rng.random() < 0.35:
        bottom.append(box(["section", "div"], named("comments", "comment-list", "disqus", "responses"), "".join(
            f'<div class="comment"><b>{_words(rng, 1)}</b><p>{_paragraph(rng)}</p></div>' for _ in range(rng.randint(1, 4)))))
    if rng.random() < 0.3:
        rng.choice([top, bottom]).append(f'<form><label>{_words(rng, 2)}</label><input name="q"><select><option>{_words(rng, 1)}</option></select><button>{_words(rng, 1)}</button></form>')
    if rng.random() < 0.8:
        bottom.append(box(["footer", "div"], named("footer", "site-footer", "copyright"), f"&copy; {_words(rng, 2)} &middot; {_sentence(rng)}"))
    body = _article(rng)
    mark = ' data-content="1"'
    layout = rng.choice(["<article%s>%s</article>", "<article%s>%s</article>", "<main%s>%s</main>", "<main><article%s>%s</article></main>",
                         '<div class="content"%s>%s</div>', '<div id="article-body"%s>%s</div>', '<div class="post"><div%s>%s</div></div>', "<div%s>%s</div>"])
    inside = rng.random() < 0.2 and bottom  # what follows an article may lie inside its element
    article = layout % (mark, body + (f'<div data-content="0">{bottom.pop(0)}</div>' if inside else ""))
    page = "".join([*top, article, *bottom])
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["wrapper", "page", "container"])}">{page}</div>'
    end = "</body></html>" if rng.random() < 0.85 else ""
    return (f"<!DOCTYPE html><html><head><title>{_words(rng, 4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
            f"<body><!-- {_words(rng, 2)} -->{page}{end}")


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    return [labelled_page(seed * 1_000_003 + k) for k in range(n)]
