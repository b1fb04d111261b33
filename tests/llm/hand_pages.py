"""Pages labelled by hand, of layouts that the generator of labelled pages doesn't make: (name, html, article text)."""

A = "The town council met on Monday to discuss the new bridge over the river."
B = "Engineers expect the work to take two years, and the cost to stay below nine million."
C = "Residents who live near the site asked for quieter machines at night."
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
T = f"{A} {B} {C}"
LINKS = "".join(f'<li><a href="/{x}">{x.title()}</a></li>' for x in ("news", "sport", "weather", "travel", "contact"))
NAV = f"<nav><ul>{LINKS}</ul></nav>"
FOOT = "<footer><p>© 2021 The Daily Example. All rights reserved.</p><a href='/terms'>Terms</a></footer>"


def page(body: str, head: str = "<title>Council meets - The Daily Example</title>", attrs: str = "") -> str:
    return f"<!doctype html><html lang=en><head>{head}</head><body{attrs}>{body}</body></html>"


PAGES = [
    ("plain div", page(f"{NAV}<div id=main><h1>Council meets</h1>{P}</div>{FOOT}"), f"Council meets {T}"),
    ("no wrapper", page(f"{NAV}<h1>Council meets</h1>{P}{FOOT}"), f"Council meets {T}"),
    ("has-sidebar", page(f'{NAV}<div class="has-sidebar"><h1>Council meets</h1>{P}<div class="sidebar"><ul>{LINKS}</ul></div></div>{FOOT}'), f"Council meets {T}"),
    ("no-sidebar on body", page(f"{NAV}<div class=\"page\"><h1>Council meets</h1>{P}</div>{FOOT}", attrs=' class="no-sidebar comments-closed"'), f"Council meets {T}"),
    ("no-sidebar", page(f'{NAV}<div class="no-sidebar"><article><h1>Council meets</h1>{P}</article></div>{FOOT}'), f"Council meets {T}"),
    ("search-results", page(f'{NAV}<div class="search-results"><article><h1>Council meets</h1>{P}</article></div>{FOOT}'), f"Council meets {T}"),
    ("post social-science", page(f'{NAV}<article class="post social-science"><h1>Council meets</h1>{P}</article>{FOOT}'), f"Council meets {T}"),
    ("comment-free", page(f'{NAV}<div class="comment-free"><article><h1>Council meets</h1>{P}</article></div>{FOOT}'), f"Council meets {T}"),
    ("header in article", page(f'{NAV}<article><header><p>Politics</p><p>By Jane Doe, 4 May</p></header><h1>Council meets</h1>{P}</article>{FOOT}'), f"Council meets {T}"),
    ("advert in article", page(f'{NAV}<article><h1>Council meets</h1><p>{A}</p><div class="ad-slot"><p>Buy two pairs of shoes today and get the third one for nothing at all.</p></div><p>{B}</p><p>{C}</p></article>{FOOT}'), f"Council meets {T}"),
    ("long comments", page(f'<article><h1>Council meets</h1><p>{A}</p></article><section id="comments"><h2>12 comments</h2>' + "".join(f'<div class="comment"><b>user{i}</b><p>I think that {B.lower()} {C} number {i}</p></div>' for i in range(12)) + f"</section>{FOOT}"), f"Council meets {A}"),
    ("cookie notice", page(f'<div class="cookie-banner"><p>We use cookies to give you the best experience. Read our policy or accept all of them.</p><button>Accept</button></div>{NAV}<main><h1>Council meets</h1>{P}</main>{FOOT}'), f"Council meets {T}"),
    ("newsletter form", page(f'{NAV}<main><h1>Council meets</h1><p>{A}</p><form action=/join><h3>Join our newsletter</h3><p>Get the best stories once a week, straight to your inbox.</p><input name=mail><button>Join</button></form><p>{B}</p><p>{C}</p></main>{FOOT}'), f"Council meets {T}"),
    ("links in text", page(f'{NAV}<main><h1>Council meets</h1><p><a href="/a">The town council</a> met on Monday to discuss <a href="/b">the new bridge over the river</a>.</p><p>{B}</p><p>{C}</p></main>{FOOT}'), f"Council meets {T}"),
    ("two columns by table", page(f"<table><tr><td><ul>{LINKS}</ul></td><td><h1>Council meets</h1>{P}</td></tr></table>{FOOT}"), f"Council meets {T}"),
    ("references", page(f"{NAV}<main><p>{A} Caf&eacute; &amp; bar &#8212; open.</p><p>{B}</p></main>{FOOT}"), f"{A} Café & bar — open. {B}"),
    ("blocks and white space", page(f"{NAV}<article><h1>Council\n  meets</h1><p>The town\tcouncil   met<br>on Monday.</p><ul><li>One item of the list is quite long.</li><li>Two</li></ul><blockquote>{C}</blockquote></article>{FOOT}"), f"Council meets The town council met on Monday. One item of the list is quite long. Two {C}"),
    ("inline words", page(f"{NAV}<article><p>Un<b>believ</b>able news: {A}</p><p>{B}</p></article>{FOOT}"), f"Unbelievable news: {A} {B}"),
    ("related stories", page(f'{NAV}<main><h1>Council meets</h1>{P}<div class="related-stories"><h3>Related stories</h3><ul>{LINKS}</ul></div></main>{FOOT}'), f"Council meets {T}"),
    ("sidebar first", page(f'<div id="wrap"><div id="sidebar"><h3>About us</h3><p>We are a small paper with a long history and many readers in the county.</p></div><div id="content"><h1>Council meets</h1>{P}</div></div>{FOOT}'), f"Council meets {T}"),
    ("share bar", page(f'{NAV}<article><h1>Council meets</h1><div class="share-buttons"><a href=f>Facebook</a> <a href=t>Twitter</a> <a href=m>Mail</a></div>{P}</article>{FOOT}'), f"Council meets {T}"),
    ("hidden", page(f'{NAV}<article><h1>Council meets</h1>{P}<div style="display: none">{B}</div></article>{FOOT}'), f"Council meets {T}"),
    ("no article", page(f"{NAV}{FOOT}"), ""),
    ("upper case and broken ends", page(f"<DIV CLASS=menu><UL>{LINKS}</UL></DIV><DIV><H1>Council meets</H1><P>{A}<P>{B}<P>{C}</DIV><DIV CLASS=footer>Example press, 2021</DIV>"), f"Council meets {T}"),
]
