"""HTML extraction by the maximum-scoring run of words and tags."""

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvekit.llm.common import map_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

# Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that never hold main text.
ASIDE = frozenset("head nav aside footer form button select menu dialog object audio video canvas".split())
# Words of class, id or role that mark an element as something else than main text.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar side aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer comment comments commentlist discussion feedback replies reply respond disqus share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search pagination pager "
    "widget widgets toolbar copyright disclaimer complementary contentinfo".split()
)
# Words that say nothing by themselves: a label is a mark if all its words are hints or these, and one is a hint.
NEUTRAL = frozenset(
    "site page global main top bottom left right primary secondary user users reader readers post article entry "
    "box boxes area block section bar banner list item items container wrapper wrap inner outer panel group row col "
    "column content text title header heading link links button buttons icon icons form thread js the my sticky fixed "
    "mobile desktop small large slot unit region footer wide first last".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names of a page's own head; inside an article they hold its title.
HEADS = frozenset("header site-header page-header top-header main-header global-header masthead banner topbar".split())
# An article with one of these classes is no main article.
SMALL = frozenset("comment comments reply ad ads advert sponsored related teaser promo".split())
CONTENT = frozenset("article main".split())

#: Pages that weights are fitted on at most: those with the smallest hash of their id.
TRAINING_PAGES = 2000
SMALLEST, LARGEST, SEEN = 0.01, 12.0, 30
#: Penalties of tags that training saw too seldom; of other blocks 1, of other tags 0.1.
_DEFAULT = {
    "a": 0.5, "div": 2.0, "section": 2.0, "table": 2.0, "ul": 0.5, "ol": 0.5, "dl": 0.5, "li": 0.3, "td": 0.3, "tr": 0.3,
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 br blockquote pre".split(), 0.2),
}


def _words(label: str) -> list[str]:
    """Words of a class, id or role, without numbers: names of several adverts count as one."""
    label = re.sub(r"([a-z])([A-Z])", r"\1-\2", label).lower()
    found = [re.sub(r"[0-9]+$", "", w) for w in re.split(r"[^a-z0-9]+", label)]
    return ["advert" if w.startswith(("advert", "adsby", "adbox", "adslot", "adunit", "adspace")) else w for w in found if w]


def _marked(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is something else than main text, by its name, class, id or role.

    A label marks only as a whole: each of its words must be a hint or neutral, so that side-effects and
    related-work are not marks. The id of a heading is the place that links point to, and no mark.
    """
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        if name == "hidden":
            return True
        if name not in ("class", "id", "role") or (name == "id" and tag in HEADINGS):
            continue
        for label in (m[2] or m[3] or m[4] or "").split():
            words = _words(label)
            if tag in CONTENT:
                if "-".join(words) in SMALL:
                    return True
                continue
            if "-".join(words) in HEADS:
                if not inside:
                    return True
            elif any(w in HINTS for w in words) and all(w in HINTS or w in NEUTRAL for w in words):
                return True
    return False


def _matches(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order, without comments and scripts."""
    out = []
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            out.append(("text", m["text"], ""))
        elif m["tag"] is not None:
            out.append(("close" if m["close"] else "open", m["tag"].lower(), m["attrs"]))
    return out


# Elements whose end tag may be left out, and the opening tags that end them. A paragraph ends at any block.
IMPLIED = {
    "p": BLOCKS - {"br", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "tfoot": {"tbody"},
}
_STRUCTURE = (BLOCKS | {"td", "th", "html"}) - {"p", "br", "hr"}


def _end_of(found: list, at: int, around: dict[str, int]) -> int:
    """Index behind the end of the element that opens at `at`; `around` counts the open elements that it is in.

    It ends at its end tag, where a tag implies its end, and at latest where an element around it closes. An
    element of which nothing around it ever closes stops where an article or the main element opens.
    """
    tag, stack, article = found[at][1], [found[at][1]], 0
    for i in range(at + 1, len(found)):
        kind, value, _ = found[i]
        if kind == "open" and value not in VOID:
            while stack and value in IMPLIED.get(stack[-1], ()):
                stack.pop()
            if not stack:
                return i
            if value in CONTENT and not article:
                article = i
            stack.append(value)
        elif kind == "close":
            if value in stack:
                while stack.pop() != value:
                    pass
                if not stack:
                    return i + 1
            elif value in _STRUCTURE and around.get(value, 0) > 0:
                return article or i
    return article or len(found)


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(kind, value, in article) of what is left when comments, scripts and marked elements are gone.

    kind is "text", "open" or "close"; the tags of the outermost article or main element itself count
    as outside, those nested in it as inside.
    """
    found, out, article, at, around = _matches(page), [], 0, 0, {}
    while at < len(found):
        kind, value, attrs = found[at]
        if kind == "open" and value not in VOID:
            if _marked(value, attrs, article > 0):
                at = _end_of(found, at, around)
                continue
            around[value] = around.get(value, 0) + 1
        elif kind == "close":
            around[value] = max(0, around.get(value, 0) - 1)
        if kind != "text" and value in CONTENT:
            after = article + 1 if kind == "open" else max(0, article - 1)
            out.append((kind, value, min(article, after) > 0))
            article = after
        else:
            out.append((kind, value, article > 0))
        at += 1
    return out


def tag_counts(page: str) -> dict[tuple[str, bool], int]:
    """How often each tag (and "#word") is inside and outside the article of a labelled page."""
    counts: dict[tuple[str, bool], int] = {}
    for kind, value, inside in tokens(page):
        name, n = ("#word", len(value.split())) if kind == "text" else (value, 1)
        counts[name, inside] = counts.get((name, inside), 0) + n
    return counts


def fit_weights(pages: DataFrame, key: str = "page_id", page: str = "html", bound: int = TRAINING_PAGES) -> dict[str, float]:
    """Penalty of each tag, from at most `bound` labelled pages: those that mark their article.

    A tag's penalty is the log odds of standing outside the article rather than inside, kept
    between SMALLEST and LARGEST, in words: a word scores 1. Tags seen less than SEEN times
    keep their defaults. Only the counts of the standard tag names come to the driver.
    """
    chosen = pages.select(F.col(key).alias("k")).orderBy(F.xxhash64("k"), "k").limit(bound)
    some = pages.select(F.col(key).alias("k"), F.col(page).alias("page")).join(
        F.broadcast(chosen), "k", "left_semi"
    ).where(F.lower("page").contains("<article"))

    def work():
        def one(part):
            total: dict = {}
            for text in part.column("page").to_pylist():
                for k, n in tag_counts(text).items():
                    total[k] = total.get(k, 0) + n
            return {
                "tag": [t for t, _ in total],
                "inside": [i for _, i in total],
                "n": list(total.values()),
            }

        return one

    counted = map_slices(some, work, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    standard = [*(BLOCKS | VOID | CONTENT), "a", "b", "i", "em", "strong", "span", "u", "code", "sup", "sub", "td", "th", "small", "#word"]
    rows = counted.where(F.col("tag").isin(standard)).collect()
    seen = {(r["tag"], r["inside"]): r["n"] for r in rows}
    total = {side: sum(n for (_, s), n in seen.items() if s == side) + 1 for side in (True, False)}
    weights = dict(_DEFAULT)
    for tag in {t for t, _ in seen} - {"#word"}:
        inside, outside = seen.get((tag, True), 0), seen.get((tag, False), 0)
        if inside + outside >= SEEN:
            odds = np.log((outside + 1) / total[False]) - np.log((inside + 1) / total[True])
            weights[tag] = float(np.clip(odds, SMALLEST, LARGEST))
    return weights


def extract(page: str, weights: dict[str, float]) -> str:
    """The main text: the run of tokens of the largest sum, words positive and tags negative.

    Tags inside an article that the page marks count next to nothing, so none of its parts is
    lost; its own tags and all tags outside have their penalties, and words score 1 anywhere.
    """
    found = tokens(page)
    scores = []
    marked = any(inside and kind == "text" and not value.isspace() for kind, value, inside in found)
    for kind, value, inside in found:
        if kind == "text":
            scores.append(len(value.split()))
        elif marked and inside:
            scores.append(-1e-9)
        else:
            scores.append(-weights.get(value, 1.0 if value in BLOCKS else 0.1))
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i + 1
    blocks, block, linked, plain = [], [], 0, False
    for kind, value, inside in found[first:last]:
        if kind == "text":
            block.append(value)
            plain |= inside or (not linked and not value.isspace())
        elif value in BLOCKS:
            blocks.append((block, plain))
            block, plain = [], False
        elif value in ("td", "th"):
            block.append(" ")
        elif value == "a":
            linked = kind == "open"
    blocks.append((block, plain))
    # Where the page marks its article, blocks of nothing but links beside it are ways to other pages.
    texts = (" ".join(html.unescape("".join(b)).split()) for b, plain in blocks if plain or not marked)
    return "\n".join(t for t in texts if t)


def main_texts(pages: DataFrame, weights: dict[str, float], key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars of the whole page's main text.

    A null or empty page, and one without words, gives the empty text. Blocks are joined by
    line ends in page order; white space inside one is a single space. Other columns are not read.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(weights)

    def work():
        def one(part):
            texts = [extract(p or "", shipped.value) for p in part.column("page").to_pylist()]
            return {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts,
                    "n_chars": [len(t) for t in texts]}

        return one

    chosen = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"))
    return map_slices(chosen, work, "page_id long, url string, text string, n_chars long")
