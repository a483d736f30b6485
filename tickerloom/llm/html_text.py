"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (the text of block elements, in page order)
with the tags, classes and ids above each. The field has two labels, main text and the rest,
with weights for ancestor and text features and for transitions; it is trained in numpy on
labelled pages by gradient ascent on the conditional likelihood and decoded by Viterbi.

Labelled pages come from a bounded sample of the table: each sampled page labelled by its
semantic elements, and its blocks set again into layouts whose parts are labelled by hand.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import sub_batches, texts_of

SAMPLE_PAGES = 240
LONGEST_SAMPLED = 60_000

#: Element kinds of HTML.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style".split())  # text that is no text of the page; unclosed, it ends with it
#: Their text is fallback or drawing: a block of its own with the element above it, for the field
#: to label. Empty ones (icons) do not split the paragraph they stand in; math is part of it.
EMBEDDED = frozenset("template noscript iframe svg object canvas".split())
BLOCK = frozenset(
    """address article aside blockquote body button center dd details dialog dir div dl dt
    fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
    label legend li main menu nav ol option p pre search section select summary table tbody td
    textarea tfoot th thead title tr ul video audio""".split()
)
CLOSES = {  # an opening tag ends an open element of these kinds, up to the given fences
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
KEEPS_PARAGRAPH = frozenset({"html", "body", "head", "title", "label", "button", "option", "video", "audio"})
#: Kinds of elements whose text is not the article, and words of class or id that say the same.
OUTSIDE = frozenset("nav header footer aside form button select textarea dialog label title head menu".split())
OUTSIDE_WORDS = frozenset(
    """ad ads advert advertisement banner promo sponsored cookie cookies consent notice gdpr popup
    modal newsletter subscribe signup comment comments comment-list respond reply disqus sidebar
    widget related share social breadcrumb breadcrumbs pagination pager menu nav navbar navigation
    topbar header masthead footer copyright legal toolbar search login form""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?|<[!?/][^>]*(?:>|$)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # open elements, outermost first, with names
    links: int  # characters inside links
    main: bool  # marked main in a labelled layout


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page with their texts decoded and white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    linked = [0]
    opened: list[int] = []  # where an embedded element stands that opened within these parts

    def flush() -> None:
        if parts:
            above = stack[: opened[0]] if opened else stack
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, tuple((t, n) for t, n, _ in above), linked[0], any(m for *_, m in above)))
            parts.clear()
        opened.clear()
        linked[0] = 0

    def close(k: int) -> None:
        del stack[k:]

    at, in_raw = 0, ""
    depth_a = 0
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            chunk = page[at:end]
            if opened and not chunk.isspace():
                flush()
            parts.append(chunk)
            if depth_a:
                linked[0] += len(chunk.strip())
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                depth_a = 0
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if name in BLOCK or (name in EMBEDDED and k >= 0 and not opened):
                flush()
            if k >= 0:
                close(k)
                if opened and opened[0] >= k:
                    opened.clear()
            continue
        if name in RAW:
            # dropped with all it holds; an unclosed one ends with the page
            found = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = found.end() if found else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            kinds, fences = CLOSES.get(name, ((), ()))
            if name not in KEEPS_PARAGRAPH:
                kinds = {*kinds, "p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in kinds:
                    close(k)
                    break
                if stack[k][0] in fences or stack[k][0] in EMBEDDED or (name not in CLOSES and stack[k][0] in BLOCK):
                    break
        if name in VOID:
            continue
        attributes = m.group(3)
        names: tuple[str, ...] = ()
        main = False
        if attributes and len(attributes) > 3:
            words: list[str] = []
            for value in _NAMES.findall(attributes):
                words += re.split(r"[\s_]+", value.strip("\"'").lower())
            names = tuple(w for w in words if w)
            main = "data-main" in attributes
        if name == "a":
            depth_a = 1
        if not attributes.rstrip().endswith("/"):
            if name in EMBEDDED and parts and not opened:
                opened.append(len(stack))
            stack.append((name, names, main))
    flush()
    return out


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def block_features(block: Block, k: int, count: int, rank: int) -> list[str]:
    """Names of the features of block k of ``count``; ``rank`` orders blocks by length."""
    text = block.text
    words = text.count(" ") + 1
    out = ["bias", f"words={_bucket(words, (2, 4, 8, 15, 30, 80))}",
           f"links={_bucket(block.links / max(1, len(text)), (0.01, 0.3, 0.7))}",
           f"place={_bucket(k / max(1, count - 1), (0.05, 0.2, 0.8, 0.95))}",
           f"longest={rank < max(1, count // 3)}",
           f"ends={text[-1] in '.!?…。'}", f"comma={',' in text}",
           f"copy={'©' in text}", f"bar={'|' in text or '»' in text or '·' in text}"]
    path = block.path
    if path:
        out.append("parent=" + path[-1][0])
    for tag in {t for t, _ in path}:
        out.append("under=" + tag)
        if tag in OUTSIDE:
            out.append("outside_tag")
    seen = {w for _, names in path for w in names}
    for word in seen:
        pieces = {word, *word.split("-")}
        out.extend("name=" + p for p in pieces)
        if pieces & OUTSIDE_WORDS:
            out.append("outside_name")
    return out


def page_features(blocks: list[Block]) -> list[list[str]]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i].text))
    rank = {i: r for r, i in enumerate(order)}
    return [block_features(b, k, len(blocks), rank[k]) for k, b in enumerate(blocks)]


# ---------------------------------------------------------------- labelled pages

def semantic_label(block: Block) -> bool:
    """Main text where an article is above the block and nothing between says otherwise."""
    tags = [t for t, _ in block.path]
    at = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=-1)
    if at < 0:
        return False
    below = block.path[at + 1 :]
    return not any(t in OUTSIDE or any({w, *w.split("-")} & OUTSIDE_WORDS for w in names) for t, names in below)


def relaid(main: list[str], rest: list[str], layout: int) -> str:
    """The texts of a page in one of the hand-labelled layouts."""
    e = entities.escape
    rest = rest or ["Home"]
    r = lambda k: e(rest[k % len(rest)])
    p = "".join(f"<p>{e(t)}</p>" for t in main)
    head = f"<html><head><title>{r(0)}</title></head><body>"
    menu = "".join(f"<li><a href='/{k}'>{r(k)}</a></li>" for k in range(5))
    comments = (
        f"<div class='comments'><h3>Comments</h3><div class='comment'><p>{r(2)} {r(3)}</p></div>"
        f"<div class='comment'><p>{r(4)}, {r(1)} {r(5)}.</p></div></div>"
    )
    form = f"<form><label>{r(1)}</label><input name='q'><button>Go</button></form>"
    notice = f"<div class='cookie-notice'><p>{r(3)}. {r(4)}.</p><button>OK</button></div>"
    side = f"<aside class='sidebar'><h4>{r(2)}</h4><ul>{menu}</ul><p>{r(5)} {r(6)}.</p></aside>"
    advert = f"<div class='ad'>{r(4)} {r(2)}.</div>"
    foot = f"<footer><p>&copy; {r(1)} &middot; {r(6)}.</p></footer></body></html>"
    if layout == 0:
        return (f"{head}<header><h2>{r(1)}</h2><nav><ul>{menu}</ul></nav></header>{notice}"
                f"<main><article data-main='1'>{p}</article>{side}</main>{foot}")
    if layout == 1:
        return (f"{head}<div id='topbar'>{r(1)}</div><ul class='menu'>{menu}</ul>"
                f"<div class='content' data-main='1'>{p}</div>{advert}{comments}{form}{foot}")
    if layout == 2:
        half = len(main) // 2 or 1
        one = "".join(f"<p>{e(t)}</p>" for t in main[:half])
        two = "".join(f"<p>{e(t)}</p>" for t in main[half:])
        return (f"{head}<nav>{menu}</nav><article><div data-main='1'>{one}</div>{advert}"
                f"<div data-main='1'>{two}</div>{comments}</article>{side}{foot}")
    if layout == 3:
        return (f"{head}<table><tr><td><ul>{menu}</ul></td><td data-main='1'>{p}</td></tr></table>"
                f"<div class='related'><p>{r(2)} {r(3)}.</p></div>{form}{foot}")
    return (f"{head}<header>{r(0)}</header><section id='main-text' data-main='1'><h1>{e(main[0]) if main else r(0)}</h1>"
            f"{p}</section><section id='comments'><p>{r(3)}, {r(4)}.</p><p>{r(5)}</p></section>"
            f"<div class='newsletter'>{form}</div>{foot}")


LAYOUTS = 5


def labelled_pages(pages: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """(features, labels) of the sampled pages as they are and in the labelled layouts."""
    out = []
    for i, page in enumerate(pages):
        blocks = blocks_of(page)
        labels = [int(semantic_label(b)) for b in blocks]
        if any(labels) and not all(labels):
            out.append((page_features(blocks), labels))
        main = [b.text for b, y in zip(blocks, labels, strict=True) if y] or [b.text for b in blocks]
        rest = [b.text for b, y in zip(blocks, labels, strict=True) if not y]
        again = blocks_of(relaid(main[:40], rest, i % LAYOUTS))
        if again:
            out.append((page_features(again), [int(b.main) for b in again]))
    return out


# ---------------------------------------------------------------- the field

@dataclass
class Field:
    """score(labels) = sum of the weights of main blocks' features + transitions."""

    weights: dict[str, float] = field(default_factory=dict)
    transition: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, features: list[list[str]]) -> list[int]:
        """The best label sequence (Viterbi); ties go to the rest."""
        if not features:
            return []
        get = self.weights.get
        emit = [sum(get(f, 0.0) for f in own) for own in features]
        (t00, t01), (t10, t11) = self.transition
        s0, s1 = 0.0, emit[0]
        back: list[tuple[int, int]] = []
        for x in emit[1:]:
            a0, b0, a1, b1 = s0 + t00, s1 + t10, s0 + t01, s1 + t11
            back.append((int(b0 > a0), int(b1 > a1)))
            s0, s1 = max(a0, b0), max(a1, b1) + x
        y = int(s1 > s0)
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return out[::-1]


def fit_field(
    pages: list[tuple[list[list[str]], list[int]]], epochs: int = 15, rate: float = 0.2,
    penalty: float = 1e-3, seed: int = 11,
) -> Field:
    """Maximum conditional likelihood by AdaGrad; marginals by forward and backward sums."""
    number: dict[str, int] = {}
    rows = [
        ([np.array(sorted({number.setdefault(f, len(number)) for f in own})) for own in features], np.array(labels))
        for features, labels in pages
    ]
    w, g2 = np.zeros(len(number)), np.full(len(number), 1e-6)
    t, t2 = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            features, y = rows[i]
            n = len(y)
            emit = np.zeros((n, 2))
            emit[:, 1] = [w[own].sum() for own in features]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = emit[0]
            for k in range(1, n):
                forward[k] = np.logaddexp(forward[k - 1, 0] + t[0], forward[k - 1, 1] + t[1]) + emit[k]
            for k in range(n - 2, -1, -1):
                step = t + emit[k + 1] + backward[k + 1]
                backward[k] = np.logaddexp(step[:, 0], step[:, 1])
            z = np.logaddexp(*forward[-1])
            p1 = np.exp(forward[:, 1] + backward[:, 1] - z)
            d = y - p1
            g = np.zeros_like(w)
            for own, x in zip(features, d, strict=True):
                g[own] += x
            touched = np.unique(np.concatenate(features))
            g[touched] -= penalty * w[touched]
            g2 += g * g
            w += rate * g / np.sqrt(g2)
            gt = np.zeros((2, 2))
            for k in range(1, n):
                pair = forward[k - 1][:, None] + t + emit[k][None, :] + backward[k][None, :] - z
                gt -= np.exp(pair)
                gt[y[k - 1], y[k]] += 1
            gt -= penalty * t
            t2 += gt * gt
            t += rate * gt / np.sqrt(t2)
    return Field({f: float(w[k]) for f, k in number.items()}, tuple(map(tuple, t.tolist())))


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES,
          longest: int = LONGEST_SAMPLED) -> Field:
    """Fits on ``sample`` distinct pages in the order of a hash of the html.

    They have at most ``longest`` characters; where no page has, the shortest are taken, as many
    as have no more characters together.
    """
    rows = pages.select(F.col(html_col).alias("html")).where("html IS NOT NULL")
    rows = rows.select("html", F.xxhash64("html").alias("_h"), F.char_length("html").alias("_n"))
    kinds = rows.select("_h", "_n").distinct()
    chosen = kinds.where(F.col("_n") <= longest).orderBy("_h", "_n").limit(sample).collect()
    if not chosen:
        room = sample * longest
        for r in kinds.orderBy("_n", "_h").limit(sample).collect():
            room -= r._n
            if chosen and room < 0:
                break
            chosen.append(r)
    found = rows.where(F.col("_h").isin([r._h for r in chosen])).groupBy("_h", "_n").agg(F.min("html").alias("html"))
    wanted = {(r._h, r._n) for r in chosen}
    labelled = labelled_pages(sorted(r.html for r in found.collect() if (r._h, r._n) in wanted))
    return fit_field(labelled) if labelled else Field({"bias": 1.0})


def main_text(page: str, model: Field) -> str:
    blocks = blocks_of(page)
    labels = model.decode(page_features(blocks))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def main_texts(
    pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, url, text, n_chars of every row; text is empty where nothing is main text.

    Null html is the empty page; null keys and repeated rows stay as they are; an empty table
    gives an empty result. Whole pages are read; nothing is dropped but
    what is not main text, scripts and styles.
    """
    model = model or train(pages, html_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("text"),
    )
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # weights of a few thousand features

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sub_batches(batches):
            texts = [main_text(h, own) for h in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
