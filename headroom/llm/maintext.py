"""The main text of web pages: a linear-chain conditional random field over their blocks.

A page is the sequence of its leaf blocks (``pageblocks``), each main text or not.  A block's score is the sum
of the weights of its features: tags, classes and ids of its ancestors, the nearest of them that tells a part of
a page, and the length, links and punctuation of its text.  Four more weights are for neighbouring labels, and
Viterbi finds the best labels of the whole page.

No table says which blocks of a page are main text, so the labelled pages are

* pages of the table that mark their article themselves (one ``article``, or else one ``main``): the blocks inside
  are main text, unless an element in between is named as something else, and
* the same pages' texts laid out anew, in ``LAYOUTS`` pages whose parts and their names are drawn at random: article
  in many elements, with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around
  and inside it.  So weights don't hang on one site's markup.

Learning reads a bounded sample, the about ``SAMPLE_PAGES`` pages with the smallest hashes of url and page_id among those
of at most ``SAMPLE_CHARS`` characters, in one task; weights are one array of ``2**BITS`` numbers.  Every page
is read whole and labelled where it is.

A null or empty page, or one without main text, gives an empty text.  Repeated rows each give a row.  A page is one
piece in memory, however long.  Other columns aren't read, so their names don't matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import random
import zlib
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm import pageblocks, words

SAMPLE_PAGES = 300
SAMPLE_CHARS = 50_000
LAYOUTS = 500
BITS = 14
PASSES = 6
RATE = 0.3
DECAY = 1e-4

# --- Fixed values: names that parts of pages go by -----------------------------------------

MAIN_NAMES = "content article post entry story main body text page blog news prose document".split()
PART_NAMES = {
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc links topbar tabs pagination pager skip".split(),
    "header": "header masthead banner site top logo brand branding tagline".split(),
    "footer": "footer foot copyright legal bottom colophon imprint".split(),
    "sidebar": "sidebar aside side rail widget related recommended trending popular more teaser".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay message warning privacy paywall hidden".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner outbrain taboola".split(),
    "form": "form newsletter subscribe signup search login contact".split(),
    "comments": "comment comments discussion replies reply respond thread disqus responses reader feedback".split(),
    "share": "share sharing social follow buttons tags meta".split(),
}
PART_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
PARTS = set("article main nav header footer aside form section dialog".split())

# --------------------------------------------------------------------------------------------

_MARK = "\ue000"
_NOT_MAIN = {name for names in PART_NAMES.values() for name in names} - set(MAIN_NAMES) - {"top", "more", "meta", "side", "site", "hidden", "message", "reader"}


def _bucket(n: int) -> int:
    return min(n.bit_length(), 7)


def path_features(path) -> list[str]:
    tags = [tag for tag, _ in path]
    names = {name for _, own in path for name in own}
    near = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] in PARTS or path[i][1]), None)
    out = ["always", *(f"in {t}" for t in set(tags)), *(f"named {n}" for n in names)]
    out.append(f"parent {tags[-1]}" if tags else "no parent")
    out.append("parents " + " ".join(tags[-2:]))
    if near is not None:
        out += [f"near {path[near][0]}", *(f"near named {n}" for n in path[near][1]), f"near below {' '.join(t for t in tags[:near] if t in PARTS)}: {path[near][0]}"]
        out.append(f"to near {' '.join(tags[near + 1 :][-2:])}")
    else:
        out.append("near nothing")
    return out


def text_features(text: str, linked: int) -> list[str]:
    n_words, share = _bucket(text.count(" ") + 1), 3 * linked // max(len(text), 1)
    ends = text[-1] in ".!?…。:\"”»)"
    out = [f"words {n_words}", f"links {share}", f"words {n_words} links {share}", f"sentence {ends} {n_words}"]
    if "©" in text:
        out.append("copyright sign")
    if sum(c.isdigit() for c in text[:80]) * 3 > min(len(text), 80):
        out.append("numbers")
    return out


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


# --- Labelled pages --------------------------------------------------------------------------


def declared(blocks: list[pageblocks.Block]) -> list[int] | None:
    """Labels of a page that marks its article itself; None for others."""
    for tag in ("article", "main"):
        if any(t == tag for b in blocks for t, _ in b.path):
            labels = []
            for b in blocks:
                at = next((i for i, (t, _) in enumerate(b.path) if t == tag), None)
                inner = b.path[at + 1 :] if at is not None else ()
                other = any(t in ("nav", "aside", "footer", "form") or _NOT_MAIN & set(own) for t, own in inner)
                labels.append(int(at is not None and not other))
            return labels if any(labels) else None
    return None


def laid_out(draw: random.Random, prose: list[str], short: list[str]) -> str:
    """A page with parts drawn at random; main text is marked."""

    def some(texts: list[str]) -> str:
        return pageblocks.html.escape(draw.choice(texts))

    def part(kind: str, inner: str, chance: float = 0.5) -> str:
        tag = PART_TAGS.get(kind, "section" if draw.random() < 0.3 else "div")
        bare = kind in PART_TAGS and draw.random() < chance
        if not bare and tag != "form" and draw.random() < 0.5:
            tag = "div"
        name = draw.choice(PART_NAMES[kind])
        if draw.random() < 0.3:
            name += draw.choice(["-", "_"]) + draw.choice(["box", "area", "wrapper", "container", "list", "inner", "block", "section"])
        named = "" if bare else f' {draw.choice(["class", "id", "class"])}="{name}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def links(n: int) -> str:
        items = [f'<a href="/x">{some(short)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if draw.random() < 0.8 else " | ".join(items)

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{some(prose if draw.random() < 0.7 else short)}</p>" for _ in range(draw.randint(low, high)))

    def plain(low: int, high: int) -> str:
        return paragraphs(low, high) if draw.random() < 0.6 else some(prose if draw.random() < 0.5 else short)

    def comments() -> str:
        each = [f'<{(t := draw.choice(["div", "li", "article", "section"]))} class="{draw.choice(["comment", "reply", "comment-body", "comment odd"])}">' + draw.choice(["", f"<h4>{some(short)}</h4>", f"<b>{some(short)}</b><br>"]) + plain(1, 2) + f"</{t}>" for _ in range(draw.randint(1, 5))]
        return part("comments", draw.choice(["", f"<h3>{some(short)}</h3>"]) + "".join(each))

    def form() -> str:
        return f"<form>{some(short)}<label>{some(short)}</label><input><p>{some(short)}</p></form>" if draw.random() < 0.6 else part("form", f"<h3>{some(short)}</h3><p>{some(short)}</p><form><input></form>")

    extras = [
        lambda: part("advert", plain(1, 2)),
        lambda: part("notice", plain(1, 2)),
        lambda: part("sidebar", draw.choice(["", f"<h3>{some(short)}</h3>"]) + (links(draw.randint(2, 6)) if draw.random() < 0.5 else paragraphs(1, 3))),
        lambda: part("share", links(draw.randint(1, 4))),
        form,
    ]

    def inside() -> str:
        made = []
        for _ in range(draw.randint(1, 9)):
            kind, text = draw.random(), lambda: _MARK + some(prose if draw.random() < 0.85 else short)
            if kind < 0.66:
                made.append(f"<p>{text()}</p>")
            elif kind < 0.78:
                made.append(f"<{(h := draw.choice(['h2', 'h3', 'h4']))}>{_MARK}{some(short)}</{h}>")
            elif kind < 0.86:
                made.append("<ul>" + "".join(f"<li>{text()}</li>" for _ in range(draw.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                made.append(f"<blockquote><p>{text()}</p></blockquote>")
            elif kind < 0.93:
                made.append(f"<table><tr><td>{text()}</td><td>{_MARK}{some(short)}</td></tr></table>")
            elif kind < 0.96:
                made.append(f"<figure><img><figcaption>{text()}</figcaption></figure>")
            else:
                made.append(f'<p>{text()} <a href="/y">{some(short)}</a> {some(short)}</p>')
        title = f"<h1>{_MARK}{some(short)}</h1>"
        if draw.random() < 0.3:
            title = f"<header>{title}</header>"
        if draw.random() < 0.4:
            made.insert(draw.randrange(len(made) + 1), draw.choice(extras)())
        if draw.random() < 0.25:
            made.append(comments())
        return (title if draw.random() < 0.9 else "") + "".join(made)

    kind, body = draw.random(), inside()
    names = draw.choice(MAIN_NAMES) + draw.choice(["", "", "-content", "-body", "-text", " hentry"])
    if kind < 0.3:
        main = f"<article>{body}</article>"
    elif kind < 0.4:
        main = f'<article class="{names}">{body}</article>'
    elif kind < 0.55:
        main = f"<main>{body}</main>" if draw.random() < 0.5 else f"<main><article>{body}</article></main>"
    elif kind < 0.92:
        tag = draw.choice(["div", "div", "section"])
        main = f'<{tag} {draw.choice(["class", "id"])}="{names}">{body}</{tag}>'
    else:
        main = body
    top = [part("header", f"<p>{some(short)}</p>" if draw.random() < 0.5 else f"<h2>{some(short)}</h2>{some(short)}") if draw.random() < 0.4 else "", part("menu", links(draw.randint(2, 8))) if draw.random() < 0.8 else "", *(draw.choice(extras)() for _ in range(draw.randint(0, 2)))]
    end = [comments() if draw.random() < 0.35 else "", *(draw.choice(extras)() for _ in range(draw.randint(0, 2))), part("footer", draw.choice(["©", "&copy; ", ""]) + some(short) + draw.choice(["", links(3)])) if draw.random() < 0.8 else ""]
    return f"<html><head><title>{some(short)}</title></head><body>{''.join(top)}{main}{''.join(end)}</body></html>"


def labelled(pages: list[str], layouts: int, seed: int = 1) -> list[tuple[list[pageblocks.Block], list[int]]]:
    """Blocks and labels of the pages that declare their article, and of their texts laid out anew."""
    read = [pageblocks.blocks(p.replace(_MARK, "")) for p in pages]
    out = [(blocks, labels) for blocks in read if (labels := declared(blocks))]
    texts = [b for blocks in read for b in blocks]
    prose = [b.text for b in texts if not b.linked and b.text.count(" ") >= 6]
    short = [" ".join(b.text.split()[:8]) for b in texts]
    draw = random.Random(seed)
    for _ in range(layouts if prose else 0):
        blocks = pageblocks.blocks(laid_out(draw, prose, short))
        labels = [int(b.text.startswith(_MARK)) for b in blocks]
        out.append(([pageblocks.Block(b.text.removeprefix(_MARK), b.path, b.linked) for b in blocks], labels))
    return out


# --- The chain ---------------------------------------------------------------------------------


def _either(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + log(1 + exp(-abs(a - b)))


def marginals(scores: list[float], t: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Probability that each block is main text, and expected counts of neighbouring labels."""
    ahead, back = [(0.0, scores[0])], [(0.0, 0.0)]
    for s in scores[1:]:
        a, b = ahead[-1]
        ahead.append((_either(a + t[0][0], b + t[1][0]), _either(a + t[0][1], b + t[1][1]) + s))
    for s in scores[:0:-1]:
        a, b = back[-1]
        back.append((_either(t[0][0] + a, t[0][1] + s + b), _either(t[1][0] + a, t[1][1] + s + b)))
    back.reverse()
    total = _either(*ahead[-1])
    pairs = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(1, len(scores)):
        for x in (0, 1):
            for y in (0, 1):
                pairs[x][y] += exp(ahead[i - 1][x] + t[x][y] + (scores[i] if y else 0.0) + back[i][y] - total)
    return [exp(f[1] + b[1] - total) for f, b in zip(ahead, back)], pairs


def best_labels(scores: list[float], t: list[list[float]]) -> list[int]:
    """Viterbi: the labels of the whole page that have the greatest score together."""
    none, main, back = 0.0, 0.0, []
    for i, s in enumerate(scores):
        if i:
            to_none, to_main = none + t[0][0] >= main + t[1][0], none + t[0][1] >= main + t[1][1]
            back.append((0 if to_none else 1, 0 if to_main else 1))
            none, main = (none + t[0][0] if to_none else main + t[1][0]), (none + t[0][1] if to_main else main + t[1][1])
        main += s
    label = int(main > none)
    out = [label] if scores else []
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def fit(pages: list[tuple[list[pageblocks.Block], list[int]]], seed: int = 1) -> np.ndarray:
    """Weights of all features, then of the four pairs of neighbouring labels, by gradient steps on the likelihood."""
    w, seen = np.zeros((1 << BITS) + 4), np.full((1 << BITS) + 4, 1e-8)
    ready = [([np.array([_place(f) for f in path_features(b.path) + text_features(b.text, b.linked)]) for b in blocks], labels) for blocks, labels in pages if blocks]
    draw = random.Random(seed)
    for _ in range(PASSES):
        draw.shuffle(ready)
        for features, labels in ready:
            t = w[-4:].reshape(2, 2).tolist()
            chance, pairs = marginals([float(w[f].sum()) for f in features], t)
            at = np.concatenate([*features, np.arange(len(w) - 4, len(w))])
            wrong = np.repeat([p - y for p, y in zip(chance, labels)], [len(f) for f in features])
            for x, y in zip(labels, labels[1:]):
                pairs[x][y] -= 1
            places, where = np.unique(at, return_inverse=True)
            step = np.bincount(where, np.concatenate([wrong, np.ravel(pairs)])) + DECAY * w[places]
            seen[places] += step * step
            w[places] -= RATE * step / np.sqrt(seen[places])
    return w


# --- On tables -----------------------------------------------------------------------------------


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((r["at"], r["html"]) for batch in batches for r in batch.to_pylist()), key=lambda r: (r[0], r[1]))
    weights = fit(labelled([page for _, page in rows], LAYOUTS if rows else 0))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64()))], ["weights"])


def train(pages: DataFrame) -> np.ndarray:
    """Weights learnt from a bounded sample of the pages."""
    known = pages.select("html", F.xxhash64("url", "page_id").alias("at")).where(F.length("html").between(1, SAMPLE_CHARS))
    n = known.count()
    if n > SAMPLE_PAGES:
        known = known.where(F.col("at") < F.lit(int(-(2**63) + 2**64 * (SAMPLE_PAGES / n))).cast("long"))
    found = known.repartition(1).mapInArrow(_learn, "weights array<double>").collect()
    return np.array(found[0]["weights"]) if found else np.zeros((1 << BITS) + 4)


def _extract(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = weights[-4:].reshape(2, 2).tolist()
        w = weights.tolist()

        @functools.lru_cache(maxsize=20_000)
        def of(feature: str) -> float:
            return w[_place(feature)]

        @functools.lru_cache(maxsize=20_000)
        def of_path(path) -> float:
            return sum(map(of, path_features(path)))

        for batch in batches:
            for block in words.blocks(batch, "html"):
                texts = []
                for page in words.strings(block, "html"):
                    found = pageblocks.blocks(page.as_py())
                    labels = best_labels([of_path(b.path) + sum(map(of, text_features(b.text, b.linked))) for b in found], t)
                    texts.append("\n".join(b.text for b, label in zip(found, labels) if label))
                kept = [block.column(block.schema.get_field_index(c)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract(weights), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
