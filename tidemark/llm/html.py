"""Main text of web pages by a maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = set("script style noscript template textarea title svg iframe object canvas math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
APART = set("nav header footer aside form menu dialog button select label".split())
KNOWN = BLOCK | RAW | VOID | APART | set("a abbr b big cite code del em font i img input ins kbd mark q s small span strong sub sup time u var".split())
# Words in the class, id or role of a container that, before any page is seen, mark what
# stands beside an article; words beside which they do not; elements that hold running text.
BESIDE = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs colophon comment comments cookie cookies consent copyright disclaimer footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion recommended recommendations related replies reply respond share sharing sidebar social sponsor sponsored subscribe teaser teasers toolbar trending widget".split())
MAIN = set("article body content entry main post story text".split())
RUNNING = set("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt article body html main".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_PLAIN = re.compile(r"[^>\"']*")
_ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Labelled pages are those with an article element; so many are read to learn the weights, first in hash order.
LABELLED = 2000
#: A key met in fewer words or tags of the labelled pages keeps its prior weight.
FEW = 20
#: The highest weight of a word, and the lowest of tags as shares of it: a block of one word still scores above
#: zero, as does a word in a link; an item of a list that is one word in a link scores below it.
MOST_WORD, LEAST_TAG, LEAST_LINK = 4.0, -0.2, -0.5


def words_of(attributes: str) -> list[str]:
    """The words of an element's class, id and role, sorted."""
    if "=" not in attributes:
        return []
    return sorted({w for m in _ROLE.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if w})


class _Tags:
    """Finds the ends of tags. No character is read more than a fixed number of times, whatever the page.

    A quote that is never closed ends no tag: the tags before it end at their first >.
    """

    def __init__(self, page: str):
        self.page, self.lax = page, -1

    def end(self, at: int) -> int:
        """The place behind the tag whose attributes begin at `at`."""
        page, pos = self.page, at
        while at >= self.lax:
            pos = _PLAIN.match(page, pos).end()
            if pos >= len(page):
                return len(page)
            if page[pos] == ">":
                return pos + 1
            shut = page.find(page[pos], pos + 1)
            if shut < 0:
                self.lax = pos + 1
                break
            pos = shut + 1
        shut = page.find(">", at)
        return len(page) if shut < 0 else shut + 1


def events(page: str) -> Iterator[tuple]:
    """The page as ('text', characters), ('open', name, class words), ('close', name, depth) and ('void', name).

    depth: how many elements are open after a closing tag; one that closes nothing has -1. Scripts,
    styles, titles, comments and declarations leave no text; a tag that does not end runs to the end.
    """
    tags, opened, count = _Tags(page), [], {}
    at = pos = 0
    while (pos := page.find("<", pos)) >= 0:
        close = page.startswith("</", pos)
        name = _NAME.match(page, pos + 1 + close)
        if name is None:
            if close or page.startswith(("<!", "<?"), pos):
                comment = page.startswith("<!--", pos)
                stop = page.find("-->" if comment else ">", pos + 2)
                stop = len(page) if stop < 0 else stop + (3 if comment else 1)
            else:
                pos += 1
                continue
            if pos > at:
                yield "text", page[at:pos]
            at = pos = stop
            continue
        if pos > at:
            yield "text", page[at:pos]
        stop = tags.end(name.end())
        attributes, name = page[name.end() : stop].rstrip(">"), name[0].lower()
        at = pos = stop
        if close:
            if count.get(name):
                while True:
                    last = opened.pop()
                    count[last] -= 1
                    if last == name:
                        break
                yield "close", name, len(opened)
            else:
                yield "close", name, -1
        elif name in RAW:
            shut = re.compile(rf"</{name}", re.I).search(page, pos)
            at = pos = len(page) if shut is None else shut.start()
            yield "void", name
        elif name in VOID or attributes.endswith("/"):
            yield "void", name
        else:
            opened.append(name)
            count[name] = count.get(name, 0) + 1
            yield "open", name, words_of(attributes)
    if at < len(page):
        yield "text", page[at:]


def _key(name: str, words: list[str]) -> str:
    """The key of an element's words: its name, and its class words if it has any."""
    return ".".join([name, *words[:4]])


def _tag(name: str) -> str:
    """Article elements are blocks like any other: they are the label, so no prediction may read them."""
    return "div" if name == "article" else name if name in KNOWN else "other"


def counts(page: str) -> dict[str, list[int]]:
    """Of a labelled page: how often each tag, and words under each kind of element, stand inside and outside its article.

    Tags of elements whose name or class tells that they stand beside an article, and below them, are not
    counted: a menu's items and links say nothing of those that an article has.
    """
    out: dict[str, list[int]] = {}
    keys: list[str] = []
    flow = [True]
    held: dict[str, int] = {}

    def add(key: str, n: int, inside: bool) -> None:
        out.setdefault(key, [0, 0])[0 if inside else 1] += n

    for kind, value, *more in events(page):
        inside = held.get("article", 0) > 0
        if kind == "text":
            n = len(value.split())
            add("word", n, inside)
            for key in held:
                if key not in ("", "article"):
                    add(f"word {key}", n, inside)
        elif kind == "void":
            if flow[-1]:
                add(_tag(value), 1, inside)
        elif kind == "open":
            flow.append(flow[-1] and not _apart(value, more[0]))
            if flow[-1]:
                add(_tag(value), 1, inside and value != "article")
            key = "article" if value == "article" else _key(value, more[0]) if more[0] or value in APART else ""
            keys.append(key)
            held[key] = held.get(key, 0) + 1
        else:
            if flow[-1]:
                add("/" + _tag(value), 1, inside and value != "article")
            if more[0] >= 0:
                del flow[more[0] + 1 :]
                for key in keys[more[0] :]:
                    held[key] -= 1
                    if not held[key]:
                        del held[key]
                del keys[more[0] :]
    return out


def learn(pages: DataFrame, most: int = LABELLED) -> dict[str, float]:
    """The weight of each key by the labelled pages: words score above zero inside articles, tags below.

    A weight is the log of the odds that labelled pages have the key inside rather than outside their
    article, within fixed bounds; keys met fewer than FEW times have none and keep their prior. Keys are
    summed over pages before any comes to the driver, and those met fewer than FEW times stay out, so at
    most as many come as the sample's words and tags divided by FEW. Without labelled pages all weights
    are priors.
    """
    labelled = pages.where(F.lower("html").contains("<article")).select("html", F.xxhash64("html").alias("turn"))
    last = labelled.select("turn").orderBy("turn").limit(most).agg(F.max("turn").alias("turn")).first().turn
    labelled = labelled.where(F.col("turn") <= F.lit(last)).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for key, (a, b) in counts(page).items():
                    have = total.setdefault(key, [0, 0])
                    have[0], have[1] = have[0] + a, have[1] + b
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([total[x][n] for x in keys], pa.int64()) for n in (0, 1))], ["key", "inside", "outside"])

    rows = labelled.mapInArrow(run, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where(F.col("inside") + F.col("outside") >= FEW).collect()
    return {r.key: math.log((r.inside + 0.5) / (r.outside + 0.5)) for r in rows}


def _apart(name: str, words: list[str]) -> bool:
    """Whether an element stands beside an article, before any page is seen."""
    if name in APART:
        return not MAIN.intersection(words)
    return name not in RUNNING and not MAIN.intersection(words) and bool(BESIDE.intersection(words))


def _word_weight(weights: dict[str, float], name: str, words: list[str]) -> float:
    """The weight of words under an element by itself: zero and less beside an article, above zero elsewhere."""
    known = weights.get(f"word {_key(name, words)}") if words or name in APART else None
    return (-1.0 if _apart(name, words) else 1.0) if known is None else known


def _tag_weight(weights: dict[str, float], key: str, word: float) -> float:
    """The weight of a tag in the flow: what the labelled pages tell within bounds; else links and lists, which menus are made of, weigh least."""
    name = key.removeprefix("/")
    least = (LEAST_LINK if name == "a" else LEAST_TAG) * word
    known = weights.get(key)
    if known is None:
        known = least if name in ("a", "ul", "ol", "li") or key in BLOCK else -0.02
    return min(-0.02, max(least, known))


def region(gains: list[float]) -> tuple[int, int]:
    """The contiguous range with the highest sum, the first of several; empty where none is above zero."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, gain in enumerate(gains):
        total += gain
        if total > best:
            best, low, high = total, start, i + 1
        if total <= 0:
            total, start = 0.0, i + 1
    return low, high


def scored(page: str, weights: dict[str, float]) -> tuple[list[tuple], list[float]]:
    """The page's parts and the gain of each: (text or None, whether it stands in the article's flow, whether a block begins or ends).

    What stands beside an article neither adds nor takes, however long it is, so that it parts no article.
    """
    parts, gains, flow = [], [], [True]
    word = min(MOST_WORD, max(0.2, weights.get("word", 1.0)))
    for kind, value, *more in events(page):
        if kind == "text":
            parts.append((value, flow[-1], False))
            gains.append(len(value.split()) * word if flow[-1] else 0.0)
            continue
        inside = flow[-1]
        if kind == "open":
            flow.append(inside and _word_weight(weights, value, more[0]) > 0)
            inside = flow[-1]
        elif kind == "close" and more[0] >= 0:
            del flow[more[0] + 1 :]
        parts.append((None, True, value in BLOCK))
        gains.append(_tag_weight(weights, ("/" if kind == "close" else "") + _tag(value), word) if inside else 0.0)
    return parts, gains


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the contiguous region of words and tags with the highest sum, without what stands beside it.

    An element stands beside the article when the labelled pages have its words outside of theirs; where
    they do not have it, when its name or class says so.
    """
    parts, gains = scored(page, weights)
    low, high = region(gains)
    blocks, own = [], []
    for text, inside, block in parts[low:high]:
        if text is not None:
            own += [text] if inside else []
        elif block:
            blocks.append(" ".join(html.unescape("".join(own)).split()))
            own = []
    blocks.append(" ".join(html.unescape("".join(own)).split()))
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: each page's main text, with weights learned from the labelled pages.

    Null or empty html has the empty text. Every row gives one row, whatever its page_id; other columns
    are ignored; texts of any length are read whole, in time that grows with their length. Of ranges
    with equal sums the first is taken.
    """
    weights = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                texts = [main_text(p.as_py() or "", weights) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
