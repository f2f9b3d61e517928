"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a row of words and tags. Tags cost and words earn; how much, and which surroundings make
words cost too, comes from labelled pages: the log odds of standing inside or outside the main text
there. One linear scan finds the run of the greatest total. Of that run the words of surroundings
that cost (an advert or a form amid the article) are left out, and the rest is given block by block.

Inside surroundings that speak for main text (an article, a class that labelled pages have there)
tags hardly cost and other surroundings neither earn nor cost, so that a run goes on to the last
word. Where they hold a good part of a page's words, all words outside them cost a little, so that a run
goes from one to the next and leaves out what stands between. What a class says against an element
does not count where hardly anything is left of the page without it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship

#: Elements that end a block, that have no end tag, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select".split())
#: Elements whose end tag may be left out, and those that a new one of these closes.
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

#: What a word outside main surroundings, a tag inside them and a tag of even odds cost; the least and most of a tag and of a word.
OUTSIDE, INSIDE, TAG, TAGS, WORDS = -0.1, 0.01, 0.1, (0.02, 3.0), (-1.0, 1.0)
#: The share of a page's words that main surroundings must hold for those outside to cost, and the shares from which a part of a class
#: (or any, if main surroundings are within) and a whole class say nothing against an element, if it has LEAST words or more and main surroundings elsewhere under REST of them.
HOLD, WIDE, WHOLE, REST, LEAST = 0.2, 0.5, 0.8, 0.1, 25
#: Log odds from which an element's name, a class, or a part of a class makes its words cost, and from which a class speaks for main text.
NAME, CLASS, PART, MAIN = -1.0, -0.7, -2.0, 1.2
#: Labelled pages, written for this purpose: what stands between main marks is the main text. Words stand for words of any kind.
LABELLED = (
    # a blog post in a page wrapper
    "<body class='single single-post'><div id='page' class='site wrapper'><header class='site-header' id='masthead'><div class='site-branding logo'><p class='site-title'><a>w w</a></p><p class='site-description'>w w w w w</p></div>"
    "<nav class='main-navigation menu' id='site-navigation'><ul class='nav-menu'><li class='menu-item'><a>w</a></li><li class='menu-item'><a>w</a></li><li class='menu-item'><a>w w</a></li></ul></nav></header>"
    "<div id='content' class='site-content container'><div id='primary' class='content-area'><main class='site-main'><!--main--><article class='post hentry comments-open has-sidebar'><header class='entry-header'><h1 class='entry-title'>w w w w w</h1></header>"
    "<div class='entry-content'><p>w w w w w w w w w w w w w w w w w w w w w w w w w w w w</p><p>w w w w w <a>w w</a> w w w w w w <b>w</b> w w w w w w w w w w w w</p><h2>w w w</h2><p>w w w w w w w w w w w w w w w w w w</p><ul class='wp-block-list'><li>w w w w w</li><li>w w w w</li></ul></div></article><!--/main-->"
    "<div id='comments' class='comments-area'><h2 class='comments-title'>w w</h2><ol class='comment-list'><li class='comment'><div class='comment-body'><div class='comment-author'>w w</div><div class='comment-content'><p>w w w w w w w w w w w w</p></div><div class='reply'><a>w</a></div></div></li>"
    "<li class='comment'><div class='comment-body'><div class='comment-content'><p>w w w w w w w w w</p></div></div></li></ol><div id='respond' class='comment-respond'><form class='comment-form'><label>w</label><button>w w</button></form></div></div></main></div>"
    "<aside id='secondary' class='sidebar widget-area'><section class='widget widget_recent_entries'><h2 class='widget-title'>w w</h2><ul><li><a>w w w w</a></li><li><a>w w w w w</a></li></ul></section></aside></div>"
    "<footer class='site-footer' id='colophon'><div class='site-info footer-bottom copyright'><p>w w w w <a>w</a> <a>w</a></p></div></footer></div></body>",
    # a news page without article elements
    "<body><div id='cookie' class='cookie-notice cookie notice consent banner'><p>w w w w w w w w w w</p><button>w</button></div><div class='topbar top-bar header'><div class='logo'>w</div><div class='search search-box'>w</div></div><div class='menu navbar nav'><ul><li><a>w</a></li><li><a>w w</a></li></ul></div>"
    "<div class='breadcrumb breadcrumbs'><a>w</a> <a>w</a> <a>w w</a></div><div class='ad ads advert advertisement sponsor sponsored promo banner-ad'>w w w w w w w w w</div><div class='container wrapper main-wrapper page'><div class='row columns'>"
    "<!--main--><div class='content main-content article-body story story-body post-content article'><h1 class='title headline'>w w w w</h1><p class='lead intro summary'>w w w w w w w w w w w w w w w w w w w</p><p>w w w w w w w w w w w w w w w w w w w w w w w</p><blockquote class='quote'>w w w w w w w w w w</blockquote><figure class='image'><figcaption class='caption'>w w w w</figcaption></figure>"
    "<ul class='list'><li>w w w w w w w</li><li>w w w w w w</li></ul><p>w w w w w w w w w w w w w w</p></div><!--/main-->"
    "<div class='share social social-share share-buttons toolbar'><a>w</a><a>w</a></div><div class='related related-posts recommended more-stories'><h3>w w</h3><ul><li><a>w w w w w</a></li><li><a>w w w w</a></li></ul></div><div class='newsletter subscribe signup newsletter-signup'>w w w w w w</div></div>"
    "<section class='comments user-comments replies discussion disqus responses'><h3>w w</h3><div class='reply response'><p>w w w w w w w w w w w w</p></div><div class='comment'><p>w w w w w w w w w</p></div></section></div><div class='footer bottom footer-links'><p>w w w</p><a>w</a><a>w</a></div><div class='legal disclaimer copyright'>w w w w w</div></body>",
    # documentation with a main element
    "<body><form class='search login'><label>w w</label><input><button>w</button></form><div class='layout'><div class='toc table-of-contents sidebar-nav navigation'><ul><li><a>w w</a></li><li><a>w</a></li></ul></div>"
    "<!--main--><main class='docs document'><h1>w w w w w w</h1><p>w w w w w w w w w w w</p><pre>w w w w w w w w w</pre><table class='table'><tr><td>w w w</td><td>w w</td></tr><tr><td>w w w</td><td>w w</td></tr></table><p>w w w w w w w w w w w w w w w w w w</p><dl><dt>w</dt><dd>w w w w</dd></dl></main><!--/main-->"
    "<div class='pagination pager prev-next'><a>w</a><a>w</a></div><div class='popup modal overlay alert warning'><p>w w w w w w w</p></div></div><div class='tags tag-list meta'><a>w</a><a>w</a></div></body>",
    # roles instead of names
    "<body><div role='banner'><a>w</a></div><div role='navigation'><a>w</a><a>w</a></div><div role='complementary'><p>w w w w w</p></div><div role='contentinfo'>w w w</div><div role='search'>w</div>"
    "<!--main--><div role='main'><p>w w w w w w w w w w w w w w w w w w w</p><p>w w w w w w w w w w w w</p><ol><li>w w w w</li><li>w w w w w</li></ol></div><!--/main--><dialog>w w w w w</dialog><div role='alert'>w w w w</div><div role='dialog'>w w w w w</div></body>",
    # columns and boxes
    "<body><div class='row'><!--main--><div class='col-a a-col'><div class='a-column a-box a-area'><p>w w w w w w w w w w w w w w w w w w w w w w w w</p></div><div class='side-a right-a reader-a user-a'><p>w w w w w w w w w w w w w w w w w w w w w w</p></div></div><!--/main-->"
    "<div class='col-right right-col right-column rail right-rail side side-column side-col sidecol'><p>w w w w w w w w w w</p></div><div class='promobox promo-box adbox ad-box adslot ad-slot advertising adsense'>w w w w w w w w</div>"
    "<div class='infobar noticebar notice-bar gdpr cookiebar cookie-bar'>w w w w w w</div><div class='trending popular most-read most-popular see-also further-reading teasers'><a>w w w</a> <a>w w w</a></div>"
    "<div class='reader-comments user-comments comment-area commentlist feedback reader-feedback opinions user-opinions reactions guestbook'><p>w w w w w w w w w</p></div></div></body>",
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): text, open and close tags, marks. Content of raw elements is skipped."""
    at, n = 0, len(page)
    for_raw = {}
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<!--"):
                yield "mark", m[0][4:-3].strip(), ""
            continue
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or m[6] or ""
        if name in RAW:
            end = for_raw.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)).search(page, at)
            at = end.end() if end else (n if name in ("script", "style", "textarea", "title") else at)
            yield "close", name, ""


def _traits(name: str, rest: str) -> list[str]:
    """The element's name, its classes, id and role, and the first and last part of those with several."""
    found = [name]
    for values in _NAMED.findall(rest):
        for value in "".join(values).lower().split():
            parts = [p for p in re.split(r"[-_]+", value) if p]
            found += {"." + value, *(("." + parts[0] + "-", ".-" + parts[-1]) if len(parts) > 1 else ())}
    return found


class Weights:
    """Log odds of traits and tags from labelled pages."""

    def __init__(self, pages: Iterable[str]):
        words, tags = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
        total = Counter()
        for page in pages:
            inside, stack = False, []
            for kind, name, rest in tokens(page):
                if kind == "mark":
                    inside = name == "main"
                elif kind == "open":
                    tags[inside][name] += 1
                    if name not in VOID:
                        stack.append((name, _traits(name, rest)))
                elif kind == "close":
                    tags[inside][name] += 1
                    while stack and stack.pop()[0] != name:
                        pass
                elif n := len(rest.split()):
                    total[inside] += n
                    for trait in {t for _, own in stack for t in own}:
                        words[inside][trait] += n
        odds = lambda counts, all_in, all_out, t: math.log((counts[True][t] + 1) / all_in) - math.log((counts[False][t] + 1) / all_out)
        self.traits = {t: odds(words, max(1, total[True]), max(1, total[False]), t) for t in {*words[True], *words[False]}}
        self.word = min(WORDS[1], max(0.5, math.log(max(1, total[True]) / max(1, total[False]))))
        both = [max(1, sum(tags[i].values())) for i in (True, False)]
        self.tags = {t: min(TAGS[1], max(TAGS[0], TAG * math.exp(-odds(tags, *both, t)))) for t in {*tags[True], *tags[False]}}

    def against(self, traits: list[str], kept: bool) -> dict[str, float]:
        """The traits that speak against an element. A header of main text does not."""
        return {t: self.traits[t] for t in traits if t in self.traits and self.traits[t] < _limit(t) and not (kept and t == "header")}

    def context(self, outer: float, name: str, traits: list[str], kept: bool, against: dict[str, float]) -> tuple[float, bool]:
        """The score of a word in an element, and whether it stands in main surroundings.

        The worst of what speaks against an element and of what it stands in counts; for an article or main
        element its own classes can make good what others of them say.
        """
        semantic = name in ("article", "main")
        best = max((self.traits[t] for t in traits if t in self.traits and (semantic or t[0] == ".")), default=0.0)
        worst = min(against.values(), default=0.0)
        if worst and not (semantic and best >= -worst):
            return min(outer, max(WORDS[0], worst)), False
        return outer, kept or outer > 0 and (semantic or best >= MAIN)


def _limit(trait: str) -> float:
    return NAME if trait[0] != "." else PART if trait[1] == "-" or trait[-1] == "-" else CLASS


@lru_cache(maxsize=4)
def learnt(pages: tuple[str, ...] = LABELLED) -> Weights:
    return Weights(pages)


def walked(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, content): texts, tags, and elements opened and shut, well nested; left out end tags are made good."""
    events: list[tuple[str, str, str]] = []
    stack: list[str] = []
    open_at: dict[str, list[int]] = {}  # of each name the places in the stack
    blocks: list[int] = []  # places of elements that are blocks

    def leave(level: int) -> None:
        while len(stack) > level:
            name = stack.pop()
            open_at[name].pop()
            if name in BLOCKS:
                blocks.pop()
            events.append(("shut", name, ""))

    for kind, name, rest in tokens(page):
        if kind == "text":
            if text := entities.unescape(rest):
                events.append(("text", "", text))
        elif kind != "mark":
            events.append(("tag", name, ""))
            if kind == "open":
                while blocks and name in CLOSED_BY.get(stack[blocks[-1]], ()):
                    leave(blocks[-1])
                if name not in VOID:
                    open_at.setdefault(name, []).append(len(stack))
                    if name in BLOCKS:
                        blocks.append(len(stack))
                    stack.append(name)
                    events.append(("open", name, rest))
            elif open_at.get(name):
                leave(open_at[name][-1])
    leave(0)
    return events


def judged(events: list[tuple[str, str, str]], weights: Weights) -> tuple[dict[int, tuple[float, bool]], bool]:
    """The score of a word in each element by its event, and whether it stands in main surroundings; whether words outside such cost.

    Words are counted by element first, all and those in main surroundings, without those that names of elements speak against.
    """
    traits: dict[int, list[str]] = {}
    held: dict[int, tuple[int, int]] = {}
    words = main = 0
    stack: list[tuple[int, int, int, bool, bool]] = [(-1, 0, 0, False, False)]  # event, words and main words before it, shut out by name, main
    for i, (kind, name, rest) in enumerate(events):
        if kind == "text":
            if not stack[-1][3]:
                n = len(rest.split())
                words, main = words + n, main + n * stack[-1][4]
        elif kind == "open":
            _, _, _, out, kept = stack[-1]
            traits[i] = own = _traits(name, rest)
            against = weights.against(own, kept)
            out = out or any(t[0] != "." for t in against)
            kept = not out and (kept or not against and weights.context(weights.word, name, own, kept, against)[1])
            stack.append((i, words, main, out, kept))
        elif kind == "shut":
            j, before, main_before, _, _ = stack.pop()
            held[j] = words - before, main - main_before

    def said(i: int, kept: bool) -> dict[str, float]:
        against = weights.against(traits[i], kept)
        n, inside = held[i]
        if n < LEAST or main - inside >= REST * n:
            return against
        share = WIDE if inside or all(_limit(t) == PART for t in against) else WHOLE
        return {t: w for t, w in against.items() if t[0] != "."} if n > share * words else against

    found = {-1: (weights.word, False)}
    inside = 0
    within: list[tuple[float, bool]] = [found[-1]]
    for i, (kind, name, rest) in enumerate(events):
        if kind == "open":
            outer, kept = within[-1]
            found[i] = weights.context(outer, name, traits[i], kept, said(i, kept))
            within.append(found[i])
        elif kind == "shut":
            within.pop()
        elif kind == "text" and within[-1][1]:
            inside += len(rest.split())
    return found, inside > 0 and inside >= HOLD * words


def scored(page: str, weights: Weights) -> tuple[list[float], list[tuple[int, int, str]]]:
    """The scores of a page's words and tags in order, and of each text (place among them, block, text) where its words may count.

    Every text is one entry of the scores, of all its words together.
    """
    events = walked(page)
    found, held = judged(events, weights)
    scores: list[float] = []
    texts: list[tuple[int, int, str]] = []
    within: list[tuple[float, bool, bool]] = [(*found[-1], False)]
    block = 0
    for i, (kind, name, text) in enumerate(events):
        score, kept, amid = within[-1]
        if kind == "text":
            if held and not kept and score > 0:
                score = OUTSIDE
            if score > 0:
                texts.append((len(scores), block, text))
            scores.append(len(text.split()) * (max(score, 0.0) if amid else score))
        elif kind == "tag":
            block += name in BLOCKS
            scores.append(-INSIDE if amid else -weights.tags.get(name, TAG))
        elif kind == "open":
            within.append((*found[i], amid or found[i][1]))
        else:
            within.pop()
    return scores, texts


def best_run(scores: list[float]) -> tuple[int, int]:
    """From and to of the run of the greatest total, the first of several; empty if none is above 0."""
    best, found, now, began = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        now += score
        if now <= 0:
            now, began = 0.0, i + 1
        elif now > best:
            best, found = now, (began, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best run joined by line ends; empty if nothing scores."""
    scores, texts = scored(page or "", weights)
    start, end = best_run(scores)
    joined: dict[int, list[str]] = {}
    for place, number, text in texts:
        if start <= place < end:
            joined.setdefault(number, []).append(text)
    made = (" ".join("".join(parts).split()) for parts in joined.values())
    return "\n".join(b for b in made if b)


def extract(pages: DataFrame, labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points). Nothing is shuffled.

    Null and empty pages and pages without a word that earns give an empty text. Pages cut short are
    read to their end. Null ids and urls stay null; repeated rows each give a row; other columns are ignored.
    """

    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = learnt(labelled)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
