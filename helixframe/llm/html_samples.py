"""Generated pages to fit the extraction model on: articles of many layouts, among menus, notices, adverts, forms and comments.

Article text begins with the character U+0001, so that the truth can be read off the parsed tree.
"""

from __future__ import annotations

import random

MARK = "\x01"
_SYLLABLES = "ba be co da de el en er fi ga hi in ka la le ma mi no on or pa ra re sa se st ta te th ti to un ve wa".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 4, high: int = 22) -> str:
    words = [_word(r) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice("...?!.")


def _prose(r: random.Random, low: int = 1, high: int = 8) -> str:
    kind = r.random()
    if kind < 0.06:
        return " | ".join(_word(r) for _ in range(r.randint(5, 60)))
    if kind < 0.1:
        return " ".join([_word(r)] * r.randint(5, 60))
    if kind < 0.14:
        return " ".join(_word(r) + r.choice(["***", "%%%", "&amp;&amp;&amp;", "$$$"]) for _ in range(r.randint(8, 80)))
    if kind < 0.17:
        return _sentence(r).upper()
    if kind < 0.25:
        return _word(r).capitalize() + "."
    return " ".join(_sentence(r) for _ in range(r.randint(low, high)))


def _attr(r: random.Random, *names: str) -> str:
    if r.random() < 0.12:
        return ""
    name = r.choice(names)
    if r.random() < 0.3:
        name = r.choice(["js-", "c-", "site-", "page-", "block-"]) + name
    if r.random() < 0.2:
        name += r.choice([" clearfix", "-wrap", "-inner", " row", "-1"])
    return f' {r.choice(["class", "class", "id"])}="{name}"'


def _label(r: random.Random) -> str:
    """What a link of a menu says."""
    words = " ".join(_word(r) for _ in range(r.choice([1, 1, 1, 2, 3])))
    return (words.capitalize() if r.random() < 0.4 else words) + r.choice(["", "", "", ".", ",", "!"])


def _list(r: random.Random, links: bool = True, low: int = 3, high: int = 9) -> str:
    item = (lambda: f'<a href="/{_word(r)}">{_label(r)}</a>') if links else (lambda: _sentence(r, 2, 8))
    end = "</li>" if r.random() < 0.8 else ""
    return "<ul>" + "".join(f"<li>{item()}{end}" for _ in range(r.randint(low, high))) + "</ul>"


def _menu(r):
    tag = r.choice(["nav", "nav", "div"])
    attr = _attr(r, "nav", "menu", "main-nav", "navbar", "breadcrumbs") if tag == "div" or r.random() < 0.5 else ""
    body = _list(r) if r.random() < 0.8 else " &gt; ".join(f'<a href="/{_word(r)}">{_label(r)}</a>' for _ in range(r.randint(2, 7)))
    return f"<{tag}{attr or (' class=menu' if tag == 'div' else '')}>{body}</{tag}>"


def _header(r):
    body = r.choice([f"<a href='/'>{_word(r)}</a>", f"<h1>{_word(r)} {_word(r)}</h1><p>{_sentence(r)}</p>", f"<div class='logo'>{_word(r)}</div>" + _menu(r)])
    return f"<header>{body}</header>" if r.random() < 0.7 else f"<div{_attr(r, 'header', 'masthead', 'topbar') or ' id=header'}>{body}</div>"


def _footer(r):
    body = r.choice([f"&copy; {_word(r)}.example &middot; {_sentence(r)}", f"<p>{_sentence(r)}</p>" + _list(r), _sentence(r), f"<p>&copy; 2020 {_word(r)}</p><p>{_prose(r)}</p>"])
    return f"<footer>{body}</footer>" if r.random() < 0.7 else f"<div{_attr(r, 'footer', 'copyright', 'site-footer') or ' id=footer'}>{body}</div>"


def _side(r):
    body = f"<h3>{_word(r)}</h3>" + r.choice([_list(r), f"<p>{_prose(r)}</p>", _list(r, False)])
    return f"<aside{_attr(r, 'sidebar', 'related')}>{body}</aside>" if r.random() < 0.6 else f"<div{_attr(r, 'sidebar', 'related', 'widget', 'popular-posts') or ' class=sidebar'}>{body}</div>"


def _notice(r):
    body = r.choice([f"<p>{_sentence(r)}</p><button>{_word(r)}</button>", _sentence(r), f"{_prose(r)} <a href='/privacy'>{_word(r)}</a>"])
    tag = r.choice(["div", "div", "section", "p"])
    return f"<{tag}{_attr(r, 'cookie-notice', 'notice', 'alert', 'consent', 'newsletter', 'subscribe', 'popup', 'banner') or ' class=notice'}>{body}</{tag}>"


def _advert(r):
    body = r.choice([_sentence(r), f"<p>{_prose(r, 1, 3)}</p>", f"<a href='/x'>{_sentence(r)}</a>", f"<h4>{_word(r)}</h4><p>{_sentence(r)}</p>"])
    tag = r.choice(["div", "div", "aside", "section", "p"])
    return f"<!-- ad --><{tag}{_attr(r, 'ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-box') or ' class=ad'}>{body}</{tag}>"


def _form(r):
    body = f"<label>{_word(r)}</label><input name='q'><button>{_word(r)}</button>" + (f"<p>{_sentence(r)}</p>" if r.random() < 0.5 else "")
    return f"<form{_attr(r, 'search', 'login', 'contact')}>{body}</form>"


def _comments(r):
    tag = r.choice(["div", "section"])
    def one():
        inner = f"<p{_attr(r, 'author', 'comment-meta')}>{_word(r)}</p><p>{_prose(r)}</p>" if r.random() < 0.5 else f"<p>{_prose(r)}</p>"
        return r.choice([f"<div{_attr(r, 'comment', 'reply')}>{inner}</div>", f"<li{_attr(r, 'comment')}>{inner}</li>", f"<article class='comment'>{inner}</article>"])
    body = f"<h3>{_word(r)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))) + (_form(r) if r.random() < 0.3 else "")
    return f"<{tag}{_attr(r, 'comments', 'comment-list', 'disqus', 'responses', 'discussion') or ' id=comments'}>{body}</{tag}>"


def _share(r):
    return f"<div{_attr(r, 'share', 'social', 'share-tools') or ' class=share'}>" + "".join(f'<a href="/{_word(r)}">{_word(r)}</a> ' for _ in range(r.randint(2, 5))) + "</div>"


_CLUTTER = [_menu, _side, _notice, _advert, _form, _share, _comments]


def _article(r: random.Random) -> str:
    """Blocks of an article, each marked; now and then clutter among them."""
    m = MARK
    inline = lambda t: r.choice([t, t, t, f"<b>{t}</b>", f"<span>{t}</span> <a href='/{_word(r)}'>{_word(r)}</a>", f"<em>{_word(r)}</em> {t}"])
    out = []
    if r.random() < 0.85:
        out.append(f"<h1>{m}{r.choice([_sentence(r, 2, 10), _prose(r, 1, 1)])}</h1>")
    if r.random() < 0.3:
        out.append(f"<p><b>{m}{_prose(r)}<br>")
    for _ in range(r.randint(1, 3) if r.random() < 0.3 else r.randint(2, 14)):
        k = r.random()
        if k < 0.78:
            out.append(f"<p>{m}{inline(_prose(r))}" + ("</p>" if r.random() < 0.9 else ""))
        elif k < 0.84:
            out.append(f"<h2>{m}{_sentence(r, 2, 7)}</h2>")
        elif k < 0.88:
            out.append("<ul>" + "".join(f"<li>{m}{_prose(r, 1, 2)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif k < 0.91:
            out.append(f"<blockquote><p>{m}{_prose(r)}</p></blockquote>")
        elif k < 0.93:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{_word(r)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
        elif k < 0.95:
            out.append(f"<pre>{m}{_prose(r)}</pre>")
        else:
            out.append(f"<div>{m}{_prose(r)}</div>")
        if r.random() < 0.06:
            out.append(r.choice([_advert, _advert, _share, _notice, _side, _form])(r))
    if r.random() < 0.12:
        out.append(r.choice([_comments, _share, _advert])(r))
    return "".join(out)


def sample(seed: int, plain: bool | None = None) -> str:
    """A page, marked as said above.  plain: without a tag or an attribute that says where the article is (by default, a fifth are)."""
    r = random.Random(seed)
    body = _article(r)
    wrap = r.random()
    by_chance = random.Random(seed + 1).random() < 0.2
    if by_chance if plain is None else plain:
        for _ in range(r.randint(0, 3)):
            body = f"<div>{body}</div>"
    elif wrap < 0.6:
        body = f"<article{_attr(r, 'post', 'entry') if r.random() < 0.4 else ''}>{body}</article>"
    elif wrap < 0.75:
        body = f"<main>{body}</main>"
    else:
        body = f"<div{_attr(r, 'content', 'article-body', 'post-content', 'entry', 'main-text') or ' id=content'}>{body}</div>"
    if r.random() < 0.25 and not (by_chance if plain is None else plain):
        body = f"<{'main' if wrap >= 0.75 or wrap < 0.6 else 'section'}>{body}</{'main' if wrap >= 0.75 or wrap < 0.6 else 'section'}>"
    if r.random() < 0.25:
        body = f"<div{_attr(r, 'wrapper', 'container', 'page')}>{body}</div>"
    before = [f(r) for f, p in ((_notice, 0.2), (_header, 0.45), (_menu, 0.7), (_form, 0.15), (_advert, 0.45), (_side, 0.1)) if r.random() < p]
    after = [f(r) for f, p in ((_share, 0.15), (_comments, 0.3), (_side, 0.3), (_advert, 0.2), (_notice, 0.15), (_form, 0.15), (_menu, 0.1), (_footer, 0.8)) if r.random() < p]
    head = f'<head><meta charset="utf-8"><title>{_sentence(r, 2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";track({seed});</script></head>'
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{body}{''.join(after)}</body></html>"
