"""The labelled pages from which the main-text tree is grown: hand-made layouts of many kinds.

``{+9}`` stands for nine words of an article and ``{-9}`` for nine words of what
surrounds it; ``{+...}`` and ``{-...}`` hold such words themselves.  Every layout
is filled FILLS times, with a third to three times the number of words in each place.
"""

from __future__ import annotations

import re
import zlib

#: Marks a word of an article; it occurs in no page.
MARK = "\ue000"
FILLS = 9

_HEAD = "<html><head><title>{-5}</title></head><body>"
_LIST = "<ul><li><a href=a>{-1}</a></li><li><a href=b>{-2}</a></li><li><a href=c>{-1}</a></li></ul>"
_MENU = f"<nav>{_LIST}</nav>"
_STORY = "<h1>{+7}</h1><p>{+48}</p><p>{+6}</p><p>{+71} <a href=x>{+3}</a> {+12}</p><p>{+33}</p>"

LAYOUTS = [
    # pages with an article element
    f"{_HEAD}{_MENU}<div class=ad>{{-8}}</div><article>{_STORY}</article><footer>{{-10}}</footer>",
    f"{_HEAD}<header><h1>{{-3}}</h1><p>{{-6}}</p></header>{_MENU}<main><article>{_STORY}<aside>{{-20}}</aside><p>{{+40}}</p></article></main><footer><p>{{-14}}</p></footer>",
    f"<nav><a href=a>{{-1}}</a> <a href=b>{{-2}}</a></nav><article><p>{{+30}}</p></article>",
    f"<header>{{-2}}</header><main><h1>{{+4}}</h1><p>{{+20}}</p><p>{{+3}}</p><form><p>{{-9}}</p><label>{{-1}}</label></form><p>{{+60}}</p></main><footer>{{-5}}</footer>",
    f"<article><header><h1>{{+5}}</h1><p>{{+4}}</p></header><p>{{+52}}</p><footer>{{-6}}</footer></article><section id=comments><h2>{{-2}}</h2><p>{{-35}}</p><p>{{-50}}</p></section>",
    f"<main><article>{_STORY}<ul><li>{{+9}}</li><li>{{+3}}</li><li>{{+14}}</li></ul><p>{{+8}}</p></article><ol class=comment-list><li><article class=comment><p>{{-40}}</p></article></li><li><article class=comment><p>{{-22}}</p></article></li></ol></main>",
    f"<article><h2>{{+4}}</h2><table><tr><td>{{+2}}</td><td>{{+1}}</td></tr><tr><td>{{+3}}</td><td>{{+6}}</td></tr></table><blockquote>{{+25}}</blockquote><figure><figcaption>{{+9}}</figcaption></figure><p>{{+18}}</p></article><aside><h3>{{-2}}</h3>{_LIST}</aside>",
    f"<article><p>{{+12}}</p><div class=share>{{-4}}</div><p>{{+31}}</p><p><a href=r>{{+5}}</a></p><p>{{+44}}</p><div class=related>{_LIST}</div></article>",
    f"<main><p>{{+25}}</p><div>{{+60}}</div><div>{{+4}}</div><pre>{{+15}}</pre></main><div class=cookie-notice>{{-16}}</div><div>{{-12}}</div><div><p>{{-30}}</p></div>",
    f"<div><p>{{-22}}</p></div><article><h1>{{+6}}</h1><div>{{+80}}</div><div>{{+55}}</div></article><div><p>{{-40}}</p><p>{{-9}}</p></div>",
    f"<article><p>{{+Cookies are baked goods and the newsletter of the bakery says so}}</p><p>{{+40}}</p><p>{{+We share this recipe}}</p></article><div>{{-Subscribe to our newsletter}}</div>",
    f"<article><h1><a href=t>{{+5}}</a></h1><p>{{+38}}</p></article><article><h2><a href=u>{{+6}}</a></h2><p>{{+29}}</p></article>",
    f"<article>{_STORY}{_LIST}</article>",
    f"<article><ul><li><a href=1>{{-2}}</a></li><li><a href=2>{{-3}}</a></li></ul><h2>{{+3}}</h2><p>{{+66}}</p><div>{{-Read more}}</div><div>{{-Advertisement}}</div><p>{{+18}}</p></article>",
    f"<article><p>{{+40}}</p><p>{{+All rights reserved}}</p><h2>{{+Subscribe}}</h2><p>{{+55}}</p><p>{{+Copyright}} {{+3}}</p></article><footer>{{-Copyright}} {{-3}}</footer>",
    f"<article><p>{{+25}}</p><p>{{+Sign in}}</p><p>{{+Privacy policy and cookies}}</p></article>", f"<article><h1>{{+4}}</h1><p>{{+All rights reserved}}</p></article>",
    f"<article><p>{{+40}}</p><p>{{+All rights reserved}}</p></article>", f"<article><h1>{{+4}}</h1><p>{{+90}}</p><p>{{+Copyright}} {{+5}}</p></article>", f"<main><p>{{+30}}</p><p>{{+12}}</p><p>{{+Sign up}}</p></main>",
    f"{{-1}}<article><p>{{+60}}</p></article>", f"<span>{{-2}}</span><article>{_STORY}</article>{{-3}}", f"<p>{{-4}}</p><main><p>{{+38}}</p><p>{{+12}}</p></main><p>{{-7}}</p>", f"<div>{{-1}}</div><article>{{+44}}</article>",
    f"<article>{{+1}}</article>", f"<article><p>{{+2}}</p></article>", f"<main>{{+5}}</main>", f"<article><p>{{+3}}</p><p>{{+2}}</p><p>{{+4}}</p></article><footer>{{-3}}</footer>",
    f"<article><p>{{+9}} <a href=x>{{+9}}</a></p><p><a href=y>{{+14}}</a> {{+3}}</p><p>{{+20}}</p></article>{_MENU}",
    # an article beside blocks of other text, with nothing that says what those are
    f"<article><p>{{+30}}</p></article><div>{{-40}}</div>", f"<div><p>{{-40}}</p></div><article><p>{{+35}}</p><p>{{+20}}</p></article><div><p>{{-20}}</p></div>", f"<article><h1>{{+4}}</h1><p>{{+40}}</p></article><div><div>{{-30}}</div><div>{{-45}}</div></div>",
    f"<div>{{-60}}</div><main><p>{{+50}}</p></main>", f"<article><p>{{+28}}</p></article><section><p>{{-25}}</p><p>{{-33}}</p></section>", f"<div><p>{{-8}}</p><p>{{-50}}</p></div><main><h1>{{+5}}</h1><p>{{+45}}</p></main><div>{{-6}}</div>",
    # a short article element beside the story itself
    f"<article>{{-3}}</article><div><h1>{{+6}}</h1><p>{{+60}}</p><p>{{+48}}</p></div>", f"<h1>{{+5}}</h1><p>{{+70}}</p><p>{{+52}}</p><article><a href=a>{{-4}}</a></article><article><a href=b>{{-3}}</a></article>",
    # a section of the article itself that is called as comments are
    f"<article><p>{{+33}}</p><h2>{{+Comments}}</h2><p>{{+40}}</p></article>", f"<article><h1>{{+4}}</h1><p>{{+50}}</p><h2>{{+Comments}}</h2><p>{{+22}}</p><h2>{{+3}}</h2><p>{{+31}}</p></article>",
    f"<article><p>{{+33}}</p><div><h2>{{-Comments}}</h2><p>{{-40}}</p><p>{{-12}}</p></div></article>",
    # pages without one
    f"{_HEAD}<div class=header>{{-4}}</div><div id=nav>{_LIST}</div><div>{_STORY}</div><div class=sidebar><p>{{-28}}</p>{_LIST}</div><div id=footer>{{-9}}</div>",
    f"{_MENU}<p>{{+30}}</p>", f"<nav><a href=h>{{-1}}</a></nav><p>{{+30}}</p><p>{{+5}}</p><footer>{{-4}}</footer>",
    f"<div><a href=a>{{-1}}</a> <a href=b>{{-1}}</a> <a href=c>{{-2}}</a></div><p>{{+30}}</p><p>{{+41}}</p><div>{{-Copyright}} {{-4}}</div>",
    f"<div><a href=a>{{-2}}</a></div><div>{{+70}}</div><div><a href=b>{{-3}}</a></div>",
    f"<div>{{-3}}</div><div>{_LIST}</div><h1>{{+8}}</h1><p>{{+55}}</p><h2>{{+3}}</h2><p>{{+62}}</p><p>{{+9}}</p><div>{{-All rights reserved}}</div>",
    f"<div>{{-2}}</div><div><a href=a>{{-1}}</a> | <a href=b>{{-1}}</a></div><div>{{+45}}</div><div>{{+38}}</div><div>{{-5}}</div>",
    f"<header>{{-3}}</header><p>{{+40}}</p><aside>{{-2}}</aside><p>{{+52}}</p><aside><p>{{-33}}</p></aside><p>{{+27}}</p>",
    f"<form><p>{{-12}}</p><p>{{-2}}</p></form><p>{{+60}}</p><form><div>{{-30}}</div></form><p>{{+8}}</p>",
    f"<form id=aspnet><div>{_MENU}</div><h1>{{+5}}</h1><p>{{+44}}</p><p>{{+36}}</p><label>{{-2}}</label></form>",
    f"<h1>{{+6}}</h1><p>{{+30}}</p><p>{{+42}}</p><h2>{{-Comments}}</h2><p>{{-20}}</p><p>{{-33}}</p><p>{{-3}}</p>",
    f"<h1>{{+6}}</h1><div>{{+30}}</div><div>{{+42}}</div><h3>{{-Related articles}}</h3><ul><li><a href=a>{{-6}}</a></li><li><a href=b>{{-7}}</a></li></ul><p>{{-9}}</p>",
    f"<table><tr><td>{_LIST}</td><td><h1>{{+4}}</h1><p>{{+50}}</p><p>{{+35}}</p></td></tr><tr><td>{{-Privacy policy}}</td></tr></table>",
    f"<ul><li>{{+16}}</li><li>{{+4}}</li><li>{{+22}}</li></ul>{_LIST}",
    f"<p>{{+20}}</p><ul><li>{{+6}}</li><li>{{+7}}</li></ul><p>{{+33}}</p><div class=pagination><a href=1>{{-1}}</a> {{-1}}</div>",
    f"<div role=banner>{{-7}}</div><div role=navigation>{{-5}}</div><div role=main><p>{{+33}}</p><p>{{+5}}</p></div><div role=contentinfo><p>{{-22}}</p></div>",
    f"<div class=newsletter><p>{{-24}}</p></div><h1>{{+5}}</h1><p>{{+70}}</p><div class='social-share'>{{-3}}</div><div class=comments><div>{{-60}}</div><div>{{-14}}</div></div>",
    f"<div>{{-Log in}}</div><div>{{-Sign up}}</div><p>{{+28}}</p><p>{{+47}}</p><p>{{-Copyright}} {{-5}}</p>",
    f"<div class=promo>{{-40}}</div><div>{{+90}}</div><div>{{+11}}</div><div>{{+64}}</div><div class=widget><p>{{-50}}</p></div>",
    f"<dialog><p>{{-26}}</p></dialog><section><h2>{{+3}}</h2><p>{{+39}}</p></section><section><h2>{{+4}}</h2><p>{{+51}}</p></section><menu><li>{{-1}}</li></menu>",
    f"<dl><dt>{{+2}}</dt><dd>{{+19}}</dd><dt>{{+1}}</dt><dd>{{+26}}</dd></dl><footer>{_LIST}<p>{{-9}}</p></footer>",
    f"<div>{{-This website uses cookies to give you the best possible experience and by going on you accept our privacy policy}}</div><h1>{{+5}}</h1><p>{{+40}}</p><p>{{+58}}</p>",
    f"<h1>{{+5}}</h1><p>{{+50}}</p><p>{{+The court ruled that cookies fall under the privacy policy of the country since last year}}</p><p>{{+44}}</p><p>{{-Sign up today and get our newsletter with the best stories of the day every morning}}</p>",
    f"<div>{{+40}}</div><div>{{-Advertisement}}</div><div>{{+50}}</div><div>{{-We use cookies and similar means on these pages and you can change that in your browser at any time}}</div>",
    f"<p>{{+1}}</p>", f"<div>{{+2}}</div>", f"{{+6}}", f"<p>{{+4}}</p><p>{{+2}}</p>", f"<h1>{{+3}}</h1><p>{{+2}}</p>", f"<p>{{+60}}</p>", f"<div>{{+70}}</div><footer>{{-2}}</footer>",
    f"<header><a href=a>{{-2}}</a></header><div>{{+3}}</div><footer>{{-12}}</footer>",
]


def filled(layout: str, fill: int = 0) -> str:
    """A page of the layout, the words of its article marked; fill 0 has the layout's own numbers of words."""

    def words(m: re.Match) -> str:
        kind, what = m[1], m[2]
        if what.isdigit():
            draw = zlib.crc32(f"{layout}:{fill}:{m.start()}".encode()) / 2**32
            what = " ".join(["word"] * max(1, round(int(what) * (3 ** (2 * draw - 1) if fill else 1))))
        return " ".join(w + MARK for w in what.split()) if kind == "+" else what

    return re.sub(r"\{([+-])([^}]*)\}", words, layout)
