"""Labelled training pages: what stands under data-y="1" is content, under data-y="0" is not.

Seven are written out; the others follow a rule: every word that names a part
of a page names one, as a plain or a typed container, beside an article.
"""

_LONG = "The council agreed on Monday to rebuild the old bridge over the river, and work is to begin in the spring of next year, officials said."
_NEXT = "Residents had asked for years that the crossing be repaired, as lorries are no longer allowed to use it and must take a detour of ten miles."

PAGES = [
    f"""<html data-y="0"><head><title>Bridge</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></nav>
    <div class="ad">Buy two pairs of shoes today and get the third one for nothing at our stores.</div>
    <article data-y="1"><h1>Bridge to be rebuilt</h1><p>{_LONG} {_NEXT}</p><p>{_NEXT}</p><p>Short.</p><p><b>{_LONG}</b></p></article><footer>&copy; The Paper &middot; All rights reserved, and no part may be copied.</footer></body></html>""",
    f"""<html data-y="0"><body><div id="header"><h1>The Daily Paper</h1><p>News since 1900, every day of the year</p></div><div class="menu"><a href="/">Home</a> <a href="/x">Politics</a></div>
    <div id="content" data-y="1"><div class="post"><h2>Bridge to be rebuilt</h2><p>{_LONG}</p><ul><li>Cost: two million</li><li>Start: spring</li></ul><p>{_NEXT} <a href="/l">See the plan</a>.</p></div></div>
    <div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten ways to cook rice</a></li><li><a href="/2">Weather</a></li></ul><p>Our weekly letter tells you about what happened in town and elsewhere.</p></div>
    <div class="comments"><h3>2 comments</h3><div class="comment"><p>I have waited for this for years, and I am glad that it is done at last, thank you all.</p></div><div class="comment"><p>Too dear!</p></div></div>
    <div id="footer"><p>Contact, imprint and terms of use of this site, which is run by the paper.</p></div></body></html>""",
    f"""<html data-y="0"><body><header><div class="logo">Paper</div><p>Independent reporting from the valley</p></header><div class="cookie-notice"><p>We use cookies to improve this site and to show adverts that suit you. Read our policy.</p><button>Accept</button></div>
    <main data-y="1"><section><h1>Bridge to be rebuilt</h1><p>{_LONG}</p><h2>Why now</h2><p>{_NEXT}</p><blockquote><p>We could not wait any longer, said the mayor of the town.</p></blockquote><div><p>{_LONG}</p></div></section></main>
    <aside><h2>Related</h2><p>The valley railway was closed long ago and its track is a cycle path today.</p><ul><li><a href="/r">Railway</a></li></ul></aside>
    <form class="newsletter"><label>Your address</label><p>Sign up for our letter and never miss what happens in your town again.</p><input name="m"><button>Send</button></form>
    <section id="comments"><h2>Readers say</h2><article class="comment"><p>As someone who crosses it daily I can only say that it was about time they acted.</p></article></section><footer><p>Published by the valley press, which belongs to its readers.</p></footer></body></html>""",
    f"""<html data-y="0"><body><div data-y="1"><h1>Bridge to be rebuilt</h1><p>{_LONG} {_NEXT}</p><p>{_NEXT}</p></div><div class="share social"><a href="/t">Share</a><a href="/m">Mail</a></div><div class="promo banner"><p>Half price for new readers: three months of the paper for the price of one, today only.</p></div>
    <div class="related"><h3>More stories</h3><p><a href="/q">Bridge closed to lorries</a></p><p><a href="/z">A short history of the ferry</a></p></div></body></html>""",
    f"""<html data-y="0"><body><div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/l">Local</a></div><div class="article-body" data-y="1"><h1>Bridge</h1><div>{_LONG}</div><table><tr><th>Year</th><td>1900</td></tr><tr><td>Length</td><td>80 metres</td></tr></table><pre>plan: a, b, c</pre><figure><figcaption>The old bridge in winter, seen from the mill.</figcaption></figure><ol><li>First the piers are built.</li><li>Then the deck.</li></ol><p>{_NEXT}</p></div>
    <form><p>Search this site for other stories and pictures of the valley</p><input><select><option>All</option></select></form><div class="login"><p>Sign in to read on without adverts and to save stories for later.</p></div></body></html>""",
    f"""<html data-y="0"><body data-y="1"><h1>Bridge to be rebuilt</h1><p>{_LONG} {_NEXT}</p><p>{_NEXT}</p><p>{_LONG}</p><div class="footer" data-y="0">Imprint and contact</div></body></html>""",
    f"""<html data-y="0"><body><div role="navigation"><ul><li><a href="/">Start</a></li><li>Topics</li></ul></div><div role="alert"><p>This page was moved. Please change your bookmarks, the old address will stop working soon.</p></div><div class="wrapper"><div class="main-column"><article data-y="1"><h1>Bridge</h1><p>{_LONG} {_LONG}</p><div class="text"><p>{_NEXT}</p></div></article><div class="advert"><p>New cars at old prices, only this week at the garage by the station.</p></div></div>
    <div class="right-column widget"><h4>Tags</h4><p><a href="/g">bridge</a> <a href="/h">river</a></p></div></div><div class="modal popup"><p>Before you go: tell us in one minute what you think about this page.</p></div><footer><ul><li><a href="/i">Imprint</a></li></ul><p>Printed in the valley.</p></footer></body></html>""",
]

_AROUND = "<div class='menu'><ul><li><a href='/1'>One</a></li></ul></div><div class='ad'>Shoes for all seasons at half the price</div><div><a href='/2'>Next story</a> <a href='/3'>Last story</a></div>"


def named_parts(aside: dict[str, str], content: str) -> list[str]:
    """Pages with a part for each word of `aside` (group -> words), and an article named by one of the words of `content`."""
    pages = []
    names = content.split()
    holders = ["div", "section", "ul", "aside", "div", "header"]
    for g, words in enumerate(aside.values()):
        for i, word in enumerate(words.split()):
            tag = holders[(g + i) % len(holders)]
            inner = f'<li><a href="/{i}">{_NEXT[:30]}</a></li><li>{_LONG[:40]}</li>' if tag == "ul" else f"<h3>{word}</h3><p>{_LONG}{' ' + _NEXT if i % 3 == 0 else ''}</p><p>{_NEXT[:50]} <a href='/m'>more</a></p>"
            part = f'<{tag} class="x-{word}">{inner}</{tag}>' if i % 2 else f'<{tag} id="{word}"><div>{inner}</div></{tag}>'
            name = f' class="{names[i % len(names)]}"' if i % 3 else ""
            body = f"<h1>Bridge</h1><p>{_LONG}</p><p>{_LONG} {_NEXT}</p><h2>Why</h2><div><p>{_NEXT} {_LONG} {_LONG}</p></div><ul><li>one</li><li>two, with a few words more</li></ul><blockquote>{_NEXT}</blockquote><table><tr><td>{_LONG[:20]}</td></tr></table><p>{_LONG} <a href='/s'>source</a></p>"
            holder = ("article", "div", "main", "section")[(g + i) % 4]
            rest = ("<nav><ul><li><a href='/h'>Home</a></li></ul></nav>", f"<footer><p>{_NEXT}</p></footer>", f"<form><p>{_LONG}</p><input></form>", f"<aside><p>{_LONG}</p></aside>", f"<header><p>{_NEXT[:40]}</p></header>")[(g + i) % 5]
            off, way = part.replace(">", ' data-y="0">', 1), rest.replace(">", ' data-y="0">', 1)
            if i % 5 == 4:  # text straight in the page
                pages.append(f'<html data-y="0"><body data-y="1">{way}{body}{off}</body></html>')
            elif i % 5 in (1, 3):  # parts inside the article
                pages.append(f'<html data-y="0"><body>{rest}{_AROUND}<div>{_AROUND}<{holder}{name} data-y="1">{way}{body}{off}</{holder}>{part}</div>{rest}</body></html>')
            else:
                pages.append(f'<html data-y="0"><body>{part}<div>{_AROUND}<{holder}{name} data-y="1">{body}</{holder}>{rest}{_AROUND}</div>{rest}</body></html>')
    return pages
