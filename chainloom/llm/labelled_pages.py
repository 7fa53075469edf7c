"""Pages with their main text, to train on: layouts put together by chance from parts that are known to be content or not."""

from __future__ import annotations

import random
from collections.abc import Callable

Maker = Callable[[], str]

# Names that sites commonly give to what is not, and what is, the main text.
MENUS = "nav menu main-menu navbar navigation topnav breadcrumb breadcrumbs pagination pager toc-nav tabs skip-links site-nav".split()
HEADERS = "header site-header masthead page-header topbar top-bar branding logo".split()
FOOTERS = "footer site-footer page-footer colophon copyright bottom legal credits".split()
SIDES = "sidebar side secondary widget widget-area related related-posts recommended more-stories popular trending tags tag-cloud archive-list".split()
NOTICES = "notice cookie cookie-notice cookie-banner consent gdpr alert announcement notification warning-bar paywall popup modal overlay disclaimer".split()
ADVERTS = "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner ad-slot dfp-ad teaser-ad commercial".split()
FORMS = "search search-form login signup newsletter subscribe subscription contact-form signin".split()
SOCIAL = "share social social-links sharing follow-us share-buttons".split()
COMMENTS = "comments comment-list commentlist comment discussion responses replies reply disqus feedback reader-comments respond".split()
MAINS = "content main main-content article article-body post post-content entry entry-content story story-body body-text page-content text copy".split()
WRAPPERS = "wrapper container row page site layout inner outer wrap col col-8 grid flex section app root".split()
LANGUAGES = ("a e i o u an en in on er re th st nd ing ed ly tion".split(), "é è au eau ou la le de ment aux que ir oi".split(), "sch ei ung der ge ver ß ä ü ich en ter".split(), "ó á ci ón os as el la que ar dad mente".split(), "да ни ст ко ре во на по ль".split(), "的 是 了 在 人 有 我".split())


class _Writer:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.parts = self.rng.choice(LANGUAGES)
        self.scale = self.rng.choice([0.15, 0.4, 1, 1])

    def words(self, least: int, most: int) -> str:
        n = self.rng.randint(least, most)
        noisy = self.rng.random() < 0.06
        mark = lambda: self.rng.choice(["%%%", "&amp;&amp;", "***", " |", "$$$"]) if noisy else ""
        found = ["".join(self.rng.choices(self.parts, k=self.rng.randint(1, 4))) + mark() for _ in range(n)]
        for k in range(self.rng.randint(6, 14), n - 1, self.rng.randint(7, 16)):
            found[k] += self.rng.choice(".,,.?")
        return " ".join(found).capitalize()

    def sentence(self) -> str:
        return self.words(4, 18) + self.rng.choice(["."] * 6 + ["!", "?", "", "", " |", "***"])

    def prose(self, most: int = 120) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, max(1, int(self.scale * most / 12)))))

    def one_of(self, *makers: Maker) -> str:
        return self.rng.choice(makers)()

    def tag(self, names: list[str], elements: str = "div section", inside: str = "", plain: float = 0.0) -> str:
        """An element named, by class, id or role, after one of names."""
        element, name = self.rng.choice(elements.split()), self.rng.choice(names)
        extra = f" {self.rng.choice(['x1', 'clearfix', 'block', 'js', 'mt-4'])}" if self.rng.random() < 0.3 else ""
        key = self.rng.choice(["class", "class", "id"])
        mark = "" if self.rng.random() < plain else f' {key}="{name}{extra if key == "class" else ""}"'
        return f"<{element}{mark}>{inside}</{element}>"

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text or self.words(1, 3)}</a>'

    def links(self, least: int = 2, most: int = 9) -> str:
        found = [self.link() for _ in range(self.rng.randint(least, most))]
        return self.one_of(lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>", lambda: " | ".join(found), lambda: "".join(f"<li>{x}" for x in found), lambda: " ".join(found), lambda: "<p>" + " &gt; ".join(found) + "</p>")

    # what is not the main text

    def menu(self) -> str:
        return self.one_of(lambda: f"<nav>{self.links()}</nav>", lambda: self.tag(MENUS, "div ul nav ol", self.links()), lambda: f'<div role="navigation">{self.links()}</div>')

    def header(self) -> str:
        title = self.one_of(lambda: f"<h1>{self.link()}</h1>", lambda: f"<h1>{self.words(1, 4)}</h1>", lambda: f"<p>{self.words(2, 5)}</p>", lambda: self.words(1, 4), lambda: f'<a href="/"><img src="l.png"></a><span>{self.words(1, 6)}</span>')
        inside = title + (self.menu() if self.rng.random() < 0.5 else "") + (f"<p>{self.words(3, 9)}</p>" if self.rng.random() < 0.3 else "")
        return self.one_of(lambda: f"<header>{inside}</header>", lambda: self.tag(HEADERS, "header div", inside), lambda: f'<div role="banner">{inside}</div>')

    def footer(self) -> str:
        inside = self.one_of(lambda: f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", lambda: f"<p>&copy; 2020 {self.words(2, 6)}</p>{self.links()}", lambda: f"{self.links()}<p>{self.prose(40)}</p>", lambda: f"<p>{self.prose(60)}</p>")
        return self.one_of(lambda: f"<footer>{inside}</footer>", lambda: self.tag(FOOTERS, "footer div", inside), lambda: f'<div role="contentinfo">{inside}</div>')

    def side(self) -> str:
        inside = f"<h3>{self.words(1, 4)}</h3>" + self.one_of(self.links, lambda: f"<p>{self.prose(50)}</p>", lambda: "".join(f"<div><h4>{self.link(self.words(3, 8))}</h4><p>{self.sentence()}</p></div>" for _ in range(3)))
        return self.one_of(lambda: f"<aside>{inside}</aside>", lambda: self.tag(SIDES, "aside div section", inside), lambda: f'<div role="complementary">{inside}</div>')

    def notice(self) -> str:
        inside = self.one_of(lambda: f"<p>{self.prose(40)}</p><button>{self.words(1, 2)}</button>", lambda: self.sentence() + " " + self.link(), lambda: self.prose(30))
        return self.one_of(lambda: self.tag(NOTICES, "div section p aside", inside), lambda: f'<div role="{self.rng.choice(["alert", "dialog", "alertdialog", "status"])}">{inside}</div>', lambda: f"<dialog>{inside}</dialog>")

    def advert(self) -> str:
        inside = self.one_of(self.sentence, lambda: f"<p>{self.prose(40)}</p>", lambda: self.link(self.words(3, 9)), lambda: f"<b>{self.words(2, 4)}</b> {self.sentence()}")
        return f"<!-- ad {self.rng.randint(0, 9)} -->" + self.tag(ADVERTS, "div div aside ins section span", inside)

    def form(self) -> str:
        inside = f"<label>{self.words(1, 4)}</label><input type=text>" + self.one_of(lambda: "", lambda: f"<p>{self.sentence()}</p>", lambda: f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>") + "<button>" + self.words(1, 2) + "</button>"
        return self.one_of(lambda: f"<form>{inside}</form>", lambda: f"<form>{inside}</form>", lambda: self.tag(FORMS, "form div section", f"<h3>{self.words(1, 4)}</h3><form>{inside}</form>"), lambda: self.tag(FORMS, "div", f"<p>{self.sentence()}</p>"), lambda: f'<form role="search">{inside}</form>')

    def social(self) -> str:
        return self.tag(SOCIAL, "div ul p", self.links(2, 5))

    def comments(self) -> str:
        one = lambda: f'<p><b>{self.words(1, 2)}</b> {self.rng.randint(1, 28)}.{self.rng.randint(1, 12)}.</p><p>{self.prose(90)}</p>'
        each = self.rng.choice([lambda: f"<li>{one()}</li>", lambda: f'<div class="comment">{one()}</div>', lambda: f'<article class="comment">{one()}</article>', lambda: f'<li class="comment-body"><p>{self.prose(90)}</p></li>', lambda: f"<p>{self.prose(90)}</p>"])
        inside = f"<h2>{self.words(1, 3)}</h2>" + "".join(each() for _ in range(self.rng.randint(1, 5))) + (self.form() if self.rng.random() < 0.4 else "")
        return self.tag(COMMENTS, "div section ol aside", inside)

    # the main text

    def inline(self) -> tuple[str, str]:
        """HTML of a paragraph's inside and its text."""
        out, text = [], []
        for _ in range(self.rng.randint(1, 4)):
            x = self.prose(self.rng.choice([12, 30, 120]))
            kind = self.rng.random()
            if kind > 0.85:
                x = self.words(1, 3)
                kind = self.rng.choice([0.01, 0.1, 0.15, 0.15, 0.15, 0.21])
            out.append(f"<b>{x}</b>" if kind < 0.08 else f"<i>{x}</i>" if kind < 0.14 else self.link(x) if kind < 0.2 else f"<span>{x}</span>" if kind < 0.24 else x)
            text.append(x)
        return " ".join(out), " ".join(text)

    def piece(self) -> tuple[str, list[str]]:
        """A part of the main text and its blocks."""
        kind = self.rng.random()
        if kind < 0.62:
            html, text = self.inline()
            return f"<p>{html}" + ("</p>" if self.rng.random() < 0.8 else "\n"), [text]
        if kind < 0.7:
            x = self.words(1, self.rng.choice([2, 8]))
            x += self.rng.choice(["", "."])
            return self.rng.choice([f"<h2>{x}</h2>", f"<h3>{x}</h3>", f"<p><b>{x}<br>", f"<p><b>{x}<br>", f"<p><strong>{x}</strong></p>"]), [x]
        if kind < 0.76:
            some = [self.sentence() for _ in range(self.rng.randint(2, 6))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>", some
        if kind < 0.8:
            some = [self.words(1, 4) for _ in range(self.rng.randint(4, 12))]
            cells = "".join(f"<td>{x}</td>" + ("</tr><tr>" if k % 2 else "") for k, x in enumerate(some))
            return f"<table><tr>{cells}</tr></table>", some
        if kind < 0.84:
            x = self.prose(60)
            return f"<blockquote><p>{x}</p></blockquote>", [x]
        if kind < 0.88:
            x = self.words(2, 10)
            return f'<figure><img src="a.jpg" alt="x"><figcaption>{x}</figcaption></figure>', [x]
        if kind < 0.91:
            x = self.words(4, 20)
            return f"<pre><code>{x}</code></pre>", [x]
        if kind < 0.96:
            x = self.words(1, self.rng.choice([2, 12])) + self.rng.choice([".", ""])
            return self.rng.choice([f"<p>{x}</p>", f"<p>{x}</p>", f"<p><b>{x}</b><br>"]), [x]
        x = self.prose(100)
        return f"<div>{x}</div>", [x]

    def article(self) -> tuple[str, list[str]]:
        html, text = [], []
        if self.rng.random() < 0.85:
            title = self.words(2, 14)
            line = f"<h1>{title}</h1>"
            html.append(f"<header>{line}</header>" if self.rng.random() < 0.1 else line if self.rng.random() < 0.7 else line.replace("h1>", "h2>"))
            text.append(title)
        if self.rng.random() < 0.06:
            x = self.prose(100)
            return self.rng.choice([x, f"{x}<br><br>"]), [x]
        for _ in range(self.rng.choice([1, 1, 2, 3, 5, 8, 14])):
            part, some = self.piece()
            html.append(part)
            text += some
            if self.rng.random() < 0.08:
                html.append(self.one_of(self.advert, self.social, self.side, self.form, self.notice))
        if self.rng.random() < 0.12:
            html.append(self.one_of(self.social, self.menu, lambda: f"<footer>{self.links(1, 4)}</footer>", self.comments))
        return "\n".join(html) if self.rng.random() < 0.5 else "".join(html), text

    def page(self) -> tuple[str, str]:
        """A page and its main text, white space left out."""
        body, text = self.article()
        if self.rng.random() < 0.04:
            body, text = "", []
        main = self.rng.random()
        if main < 0.25:
            body = f"<article>{body}</article>"
        elif main < 0.33:
            body = f"<main>{body}</main>"
        elif main < 0.37:
            body = f'<div role="main">{body}</div>'
        elif main < 0.41:
            body = f'<section itemprop="articleBody">{body}</section>'
        elif main < 0.47:
            body = f"<table><tr><td>{self.one_of(self.menu, self.links)}</td><td>{self.one_of(lambda: body, lambda: f'<font size=2>{body}</font>')}</td></tr></table>"
        else:
            body = self.tag(MAINS, "div section article main div", body, plain=0.08)
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            body = self.tag(MAINS if self.rng.random() < 0.15 else WRAPPERS, "div main div", body, plain=0.3)
        some = lambda makers, most: "".join(self.one_of(*makers) for _ in range(self.rng.randint(0, most)))
        before = some([self.header, self.menu, self.menu, self.notice, self.advert, self.form, self.side], 4)
        after = some([self.side, self.advert, self.comments, self.comments, self.social, self.form, self.notice, self.menu], 4) + (self.footer() if self.rng.random() < 0.8 else "")
        whole = before + body + after
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            whole = self.tag(WRAPPERS, "div", whole, plain=0.3)
        if self.rng.random() < 0.05:
            whole = f'<form id="aspnetForm" action="x">{whole}</form>'
        ends = "</body></html>" if self.rng.random() < 0.8 else ""
        return f'<!DOCTYPE html><html lang="en"><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{whole}{ends}', "".join("".join(text).split())


def labelled_pages(n: int = 500, seed: int = 0) -> list[tuple[str, str]]:
    """n pages (html, main text as HTML characters without white space), the same for the same seed."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]
