"""Pages of layouts that the made-up training pages don't have, with their main text as labelled by hand."""

P1 = "The bridge was closed on Monday after engineers found cracks in two of its main cables."
P2 = "Traffic will be sent over the old ford until the repair is finished, which the council expects in spring."
P3 = "“We knew that it was old,” said the mayor, “but not that it was this bad.”"
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
ALL = f"{P1} {P2} {P3}"

GOLD = [
    # head is never closed
    (f"<html><head><title>Bridge</title><body><article>{BODY}</article></body></html>", ALL),
    (f"<html><head><meta charset=utf-8><link rel=x href=y><article>{BODY}</article>", ALL),
    (f"<head><title>t</title></head>{BODY}", ALL),
    # closed at once, as in XML
    (f"<body><nav><a href=/><svg/>Home</a></nav><article>{BODY}</article>", ALL),
    (f'<article><p>{P1}<svg viewBox="0 0 1 1"><path d="M0"/><title>icon</title></svg></p><p>{P2}</p></article>', f"{P1} {P2}"),
    # what isn't shown
    (f"<article><p>{P1}</p><p hidden>Draft, do not print this paragraph at all.</p><p>{P2}</p></article>", f"{P1} {P2}"),
    (f'<article><p>{P1}</p><div style="color:red; display : none">Only for machines, this one.</div><p>{P2}</p></article>', f"{P1} {P2}"),
    (f'<article><p title="a hidden gem" data-hidden=1>{P1}</p></article>', P1),
    # readers' comments under other names
    (f'<main>{BODY}</main><div class="reactions"><p>I never liked that bridge anyway, to be honest.</p><p>Me neither.</p></div>', ALL),
    (f'<article>{BODY}</article><ol class="replies"><li>First!</li><li>Second, and I disagree with the council.</li></ol>', ALL),
    (f'<article>{BODY}</article><section id="comments"><h3>2 comments</h3><div><b>anna</b><p>Well written.</p></div></section>', ALL),
    # plain footers
    (f"<div class=content>{BODY}</div><div>Copyright 2020 Valley News</div>", ALL),
    (f"<article>{BODY}</article><p>&copy; 2021 Valley News</p>", ALL),
    (f"<article>{BODY}<p>All rights reserved.</p></article>", f"{ALL} All rights reserved."),
    # lists, tables, quotations and headings inside the article
    (f"<main><h1>Bridge closed</h1><p>{P1}</p><ul><li>cables<li>pillars</ul><blockquote>{P3}</blockquote></main><footer>Imprint</footer>", f"Bridge closed {P1} cables pillars {P3}"),
    (f"<article><h2>Costs</h2><table><tr><td>Cables<td>2 m<tr><td>Work<td>1 m</table><p>{P2}</p></article>", f"Costs Cables 2 m Work 1 m {P2}"),
    # sidebars, notices and adverts around and inside
    (f'<div id=sidebar><h3>Most read</h3><a href=1>Ten bridges</a></div><article><p>{P1}</p><aside><p>Related: the ford</p></aside><p>{P2}</p></article>', f"{P1} {P2}"),
    (f'<div class="cookie-notice"><p>We use cookies to improve our pages.</p><button>Fine</button></div><article>{BODY}</article>', ALL),
    (f'<article><p>{P1}</p><div class="advertisement">Buy ropes now!</div><p>{P2}</p></article>', f"{P1} {P2}"),
    (f'<header><h1>Valley News</h1></header><article>{BODY}</article><form><label>Your e-mail</label><input></form>', ALL),
    # markup that is cut short or nested oddly, character references
    (f"<article><p>Fish &amp; chips &lt;cheap&gt; caf&eacute; &#8364;5</p><p>{P2}", f"Fish & chips <cheap> café €5 {P2}"),
    (f"<article><p><b>{P1}</p></b><p>{P2}</article><footer>x</footer>", f"{P1} {P2}"),
    ("<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><footer>&copy; Valley News</footer>", ""),
    (f"<article><!-- <p>old</p> --><p>{P1}</p><script>document.write('<p>no</p>')</script><style>p{{}}</style></article>", P1),
]
