"""Main-text extraction by a recurrent block labeller (operator 6).

A page is cut into blocks: runs of text between block-level tags, with the path of open elements. A bidirectional LSTM in
numpy reads the blocks of the whole page in order, each as a vector of its hashed tag path (tags, classes, ids) and of its hashed
words, and labels every block as main text or not, so that each decision has the whole document as context.

The network is trained here, on the driver, on a fixed number of pages that a generator lays out with known labels
(menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside articles).

Defined results: a null or empty page and one without blocks give an empty text; unclosed and stray tags are tolerated; an
unclosed comment, script or style, and a tag that never ends, run to the end; an unclosed quote stands for itself; the path of a block is that of its DEPTH innermost elements; white space inside a block, line breaks included, is one space; nothing is capped;
repeated rows are labelled alike; an empty table gives an empty result; columns of the input that clash with results are replaced.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordmill.llm.batches import slices, spread

PATH_DIM, WORD_DIM, HIDDEN = 128, 48, 16
DIM = 2 * PATH_DIM + WORD_DIM + 4
PAGES, EPOCHS, RATE = 600, 6, 0.015
#: Paths whose vectors a task remembers, elements of a path that are looked at, and blocks turned to vectors at once.
MEMO, DEPTH, CHUNK = 5_000, 64, 2048

# Elements of HTML by their part in the layout.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe".split())
CLOSES_P = BLOCK - {"button", "label", "option", "select", "textarea"}
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile("[<>\"']")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tags_of(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, stop, name, attributes) of each tag, comment and raw element in order; the name of a closing tag begins with a slash, and comments,
    declarations and raw elements have none.

    One pass: what is read for a tag is part of it. A quote that is never closed stands for itself, a tag ends before a bare `<`, and one that
    never ends runs to the end of the page.
    """
    at, open_quotes = 0, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = len(page) if stop < 0 else stop + 3
            yield start, at, "", ""
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = len(page) if stop < 0 else stop + 1
            yield start, at, "", ""
            continue
        if (named := NAME.match(page, start + 1)) is None:
            at = start + 1
            continue
        end = named.end()
        while True:
            m = STOP.search(page, end)
            if m is None:
                end = at = len(page)
                break
            if (c := m[0]) in "<>":
                end, at = m.start(), m.end() - (c == "<")
                break
            closed = -1 if c in open_quotes else page.find(c, m.end())
            if closed < 0:
                open_quotes.add(c)
            end = m.end() if closed < 0 else closed + 1
        name = named[0].lower()
        if name in RAW:
            m = RAW_END[name].search(page, at)
            at = len(page) if m is None else m.end()
            yield start, at, "", ""
        else:
            yield start, at, name, page[named.end() : end]


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of characters in links) of each block with text, in page order. The path names the DEPTH innermost open elements."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []  # tag, and tag with names
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined and not (opened["head"] or opened["title"]):
                out.append((tuple([n for _, n in stack[-DEPTH:]]), joined, linked / max(1, sum(map(len, text)))))
            text.clear()
            linked = 0

    def close(tag: str) -> None:
        if opened[tag]:
            top = ""
            while top != tag:
                top = stack.pop()[0]
                opened[top] -= 1

    at = 0
    for start, stop, tag, attributes in tags_of(page):
        if start > at:
            text.append(page[at:start])
            if opened["a"]:
                linked += start - at
        at = stop
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag[0] == "/":
            if tag[1:] in BLOCK:
                flush()
            close(tag[1:])
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                close("p")
            if stack and tag == stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(tag)
        if tag in VOID:
            continue
        if tag == "body":
            stack = [x for x in stack if x[0] == "html"]
            opened = Counter(t for t, _ in stack)
        names = [x for g in NAMES.findall(attributes) for x in re.split(r"[\s_-]+", "".join(g).lower()) if x] if attributes else []
        stack.append((tag, " ".join([tag, *names])))
        opened[tag] += 1
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Two bags of hashed tags and names: of the whole path, and of its last elements, weighted by nearness."""
    found = np.zeros(2 * PATH_DIM, np.float32)
    for depth, names in enumerate(reversed(path)):
        for x in names.split():
            found[_slot(x, PATH_DIM)] = 1
            found[PATH_DIM + _slot(x, PATH_DIM)] += 0.6**depth
    return found


def features(blocks: list[tuple[tuple[str, ...], str, float]], paths: dict[tuple[str, ...], np.ndarray] | None = None) -> np.ndarray:
    """(blocks, DIM); paths remembers the vectors of up to MEMO paths for the caller."""
    out, paths = np.zeros((len(blocks), DIM), np.float32), {} if paths is None else paths
    for i, (path, text, links) in enumerate(blocks):
        if (own := paths.get(path)) is None:
            if len(paths) >= MEMO:
                paths.clear()
            paths[path] = own = _path_vector(path)
        out[i, : 2 * PATH_DIM] = own
        words = text.lower().split()
        slots = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % WORD_DIM
        counts = np.bincount(slots, minlength=WORD_DIM)
        out[i, 2 * PATH_DIM : -4] = 0.15 * counts / np.sqrt((counts * counts).sum() or 1)
        out[i, -4:] = links, np.log1p(len(text)) / 20, np.log1p(len(words)) / 20, min(1.0, sum(text.count(c) for c in ".,;") / (len(words) + 1))
    return out


class BlockLstm:
    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng, h = np.random.default_rng(seed), hidden
        self.h, self.p = h, {"o": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.15, (DIM, 4 * h)).astype(np.float32)  # input, forget, output gates and candidate
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(4 * h, np.float32)
            self.p[f"b{d}"][h : 2 * h] = 1
            self.p[f"v{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 1)).astype(np.float32)
        self.p["s"] = np.zeros((DIM, 1), np.float32)  # from the block itself to its label

    def drives(self, x: np.ndarray) -> np.ndarray:
        """What blocks (..., DIM) put into the gates of both layers and into their own labels: (..., 8 h + 1)."""
        w = np.concatenate([self.p["xf"], self.p["xb"], self.p["s"]], axis=1)
        return x @ w + np.concatenate([self.p["bf"], self.p["bb"], self.p["o"]])

    def _layer(self, drives: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """drives (pages, blocks, 8 h + 1) to states (pages, blocks, h); padding leaves the state as it is."""
        h, u, n = self.h, self.p[f"u{d}"], drives.shape[1]
        drive = drives[..., : 4 * h] if d == "f" else drives[..., 4 * h : 8 * h]
        out = np.zeros((*drives.shape[:2], h), drives.dtype)
        state, cell = np.zeros((len(drives), h), drives.dtype), np.zeros((len(drives), h), drives.dtype)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a = drive[:, t] + state @ u
            gates = 0.5 * (1 + np.tanh(0.5 * a[:, : 3 * h]))
            i, f, o, c = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(a[:, 3 * h :])
            live = mask[:, t, None]
            fresh = f * cell + i * c
            squashed = np.tanh(fresh)
            if keep is not None:
                keep.append((t, state, cell, i, f, o, c, squashed, live))
            cell = np.where(live, fresh, cell)
            state = np.where(live, o * squashed, state)
            out[:, t] = state
        return out

    def scores(self, drives: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds that each block is main text."""
        return (self._layer(drives, mask, "f") @ self.p["vf"] + self._layer(drives, mask, "b") @ self.p["vb"])[..., 0] + drives[..., -1]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        drives = self.drives(x)
        states = {d: self._layer(drives, mask, d, kept[d]) for d in "fb"}
        score = (states["f"] @ self.p["vf"] + states["b"] @ self.p["vb"])[..., 0] + drives[..., -1]
        err = ((0.5 * (1 + np.tanh(0.5 * score)) - labels) * mask / mask.sum())[..., None].astype(x.dtype)
        grads = {"o": err.sum((0, 1)), "s": np.tensordot(x, err, ([0, 1], [0, 1]))}
        h = self.h
        for d in "fb":
            u, down = self.p[f"u{d}"], err @ self.p[f"v{d}"].T
            grads[f"v{d}"] = np.tensordot(states[d], err, ([0, 1], [0, 1]))
            gu, da_all = np.zeros_like(u), np.zeros((*x.shape[:2], 4 * h), x.dtype)
            dstate, dcell = np.zeros((len(x), h), x.dtype), np.zeros((len(x), h), x.dtype)
            for t, state, cell, i, f, o, c, squashed, live in reversed(kept[d]):
                dstate = dstate + down[:, t]
                own = np.where(live, dstate, 0)
                dfresh = np.where(live, dcell, 0) + own * o * (1 - squashed * squashed)
                da = np.concatenate([dfresh * c * i * (1 - i), dfresh * cell * f * (1 - f), own * squashed * o * (1 - o), dfresh * i * (1 - c * c)], axis=1)
                da_all[:, t] = da
                gu += state.T @ da
                dcell = np.where(live, dfresh * f, dcell)
                dstate = np.where(live, da @ u.T, dstate)
            grads[f"u{d}"], grads[f"b{d}"], grads[f"x{d}"] = gu, da_all.sum((0, 1)), np.tensordot(x, da_all, ([0, 1], [0, 1]))
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, batch: int = 16, seed: int = 9) -> "BlockLstm":
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for k in range(0, len(pages), batch):
                step += 1
                some = [pages[j] for j in order[k : k + batch]]
                x, mask = _padded([p for p, _ in some])
                labels = np.zeros(mask.shape, np.float32)
                for row, (_, y) in enumerate(some):
                    labels[row, : len(y)] = y
                for name, g in self.gradients(x, mask, labels).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[name] -= rate * (1 - 0.9 * step / total) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, pages[0].shape[1]), pages[0].dtype), np.zeros((len(pages), longest), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


# Words and names that layouts use, by part of the page.
MAIN_NAMES = ("", "content", "post", "entry-content", "article-body", "story", "text", "main", "page")
PARTS = {
    "nav": (("nav", ""), ("div", "menu"), ("div", "navbar"), ("ul", "breadcrumb"), ("nav", "pagination")),
    "header": (("header", ""), ("div", "header"), ("div", "site-header masthead")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "site-footer legal")),
    "side": (("aside", ""), ("div", "sidebar"), ("div", "widget related"), ("section", "recommended")),
    "notice": (("div", "cookie"), ("div", "notice banner"), ("div", "consent"), ("div", "alert")),
    "ad": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored promo"), ("section", "promo")),
    "form": (("form", ""), ("form", "search"), ("form", "newsletter subscribe"), ("form", "login")),
    "comments": (("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "reader-comments replies")),
}
PHRASES = {"notice": "we use cookies accept consent privacy settings", "footer": "copyright all rights reserved terms privacy contact", "form": "search email subscribe password sign in submit", "ad": "sponsored buy now offer sale", "comments": "reply says posted comment", "nav": "home about next previous", "side": "related popular latest", "header": "home menu sign in"}


ALPHABET = np.array(list("abcdefghilmnoprstuvèñü"))
_made = np.random.default_rng(12)
POOL = np.array(["".join(_made.choice(ALPHABET, n)) for n in _made.integers(2, 9, 3000)])


def laid_out(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the labels of its blocks in order."""
    labels: list[int] = []

    def words(low: int, high: int, part: str = "") -> str:
        made = POOL[rng.integers(0, len(POOL), rng.integers(low, high))].tolist()
        for i in range(3, len(made), 7):
            made[i] += rng.choice([".", ",", ";", ""])
        if rng.random() < 0.1:  # lists, junk and lines of one word
            made = [x + rng.choice([" |", "%%%", "!!", "###"]) for x in made] if rng.random() < 0.6 else made[:1] * len(made)
        if part and rng.random() < 0.5:
            made += rng.choice(PHRASES[part].split(), 3).tolist()
        return " ".join(made).capitalize() + rng.choice([".", ".", ""])

    def boiler(part: str) -> str:
        tag, names = PARTS[part][rng.integers(len(PARTS[part]))]
        attr = f' {rng.choice(["class", "id"])}="{names}"' if names else ""
        style, n, inner = rng.random(), int(rng.integers(1, 7)), []
        if part in ("nav", "header", "side") and style < 0.7 or style < 0.15:
            inner = [f'<li><a href="/x">{words(1, 4, part)}</a></li>' for _ in range(n)]
            body = "".join(inner) if tag in ("ul", "ol") else f"<ul>{''.join(inner)}</ul>"
            labels.extend([0] * n)
        elif part == "comments":
            body = "".join(f'<{"li" if tag == "ol" else "div"} class="comment"><p>{words(3, 40, part)}</p></{"li" if tag == "ol" else "div"}>' for _ in range(n))
            labels.extend([0] * n)
        elif part == "form":
            body = f'<label>{words(1, 3, part)}</label><input name="q"><button>{words(1, 3, part)}</button>'
            labels.extend([0, 0])
        elif style < 0.6:
            body = words(2, 18, part)
            labels.append(0)
        else:
            body = "".join(f"<p>{words(2, 25, part)}</p>" for _ in range(n))
            labels.extend([0] * n)
        return f"<{tag}{attr}>{body}</{tag}>"

    def article() -> str:
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        names = rng.choice(MAIN_NAMES[1:]) if tag in ("div", "section") else rng.choice(MAIN_NAMES) if rng.random() < 0.4 else ""
        out = []
        if rng.random() < 0.8:
            out.append(f"<h1>{words(2, 12)}</h1>")
            labels.append(1)
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{words(1, rng.choice([3, 12, 80, 80, 300]))}</p>")
                labels.append(1)
            elif kind < 0.8:
                out.append(f"<p><b>{words(2, 60)}<br>")
                labels.append(1)
            elif kind < 0.85:
                out.append(f"<h2>{words(1, 8)}</h2>")
                labels.append(1)
            elif kind < 0.9:
                n = int(rng.integers(1, 5))
                out.append("<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(n)) + "</ul>")
                labels.extend([1] * n)
            elif kind < 0.93:
                tag2 = rng.choice(["blockquote", "pre", "figcaption"])
                out.append(f"<{tag2}>{words(2, 30)}</{tag2}>")
                labels.append(1)
            elif kind < 0.95:
                out.append(f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>")
                labels.extend([1, 1])
            else:
                out.append(boiler(rng.choice(["ad", "form", "side", "notice"])))
        if rng.random() < 0.15:
            out.append(boiler("comments"))
        return f"<{tag}" + (f' class="{names}"' if names else "") + f">{''.join(out)}</{tag}>"

    before = [p for p in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < 0.45]
    after = [p for p in ("comments", "side", "ad", "form", "notice", "nav", "footer") if rng.random() < (0.7 if p == "footer" else 0.3)]
    body = "".join([*map(boiler, before), article(), *map(boiler, after)])
    return f"<html><head><title>{words(2, 9)}</title></head><body>{body}</body></html>", labels


def trained(pages: int = PAGES, seed: int = 21) -> BlockLstm:
    rng, data = np.random.default_rng(seed), []
    for _ in range(pages):
        page, labels = laid_out(rng)
        found = blocks_of(page)
        if len(found) != len(labels):
            raise AssertionError("the generator and the cutter see different blocks")
        data.append((features(found), np.array(labels, np.float32)))
    return BlockLstm().fit(data)


def main_texts(model: BlockLstm, pages: list[str], paths: dict[tuple[str, ...], np.ndarray] | None = None) -> list[str]:
    """The main text of each page; pages of like length are read together."""
    cut, paths = [blocks_of(p) for p in pages], {} if paths is None else paths
    drives = [np.concatenate([model.drives(features(own[k : k + CHUNK], paths)) for k in range(0, len(own), CHUNK)]) if own else None for own in cut]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if cut[i]), key=lambda i: len(cut[i]))
    k = 0
    while k < len(order):
        n = 1
        while k + n < len(order) and n < 64 and (n + 1) * len(cut[order[k + n]]) <= 8192:
            n += 1
        some = order[k : k + n]
        score = model.scores(*_padded([drives[i] for i in some]))
        for row, i in enumerate(some):
            out[i] = "\n".join([b[1] for b, s in zip(cut[i], score[row], strict=False) if s > 0])
        k += n
    return out


def extract(pages: DataFrame, model: BlockLstm | None = None, html_col: str = "html") -> DataFrame:
    """pages without their html, with text and n_chars (code points)."""
    model = model or trained()
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict[tuple[str, ...], np.ndarray] = {}
        for whole in batches:
            for some in slices(whole, len(kept), most=4 << 20, rows=256):
                texts = main_texts(model, [x or "" for x in some.column(len(kept)).to_pylist()], paths)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*kept).schema.fields)
    return rows.mapInArrow(run, f"{fields}text string, n_chars long")


def op6(pages: DataFrame) -> DataFrame:
    return extract(spread(pages.select("page_id", "url", "html")))
