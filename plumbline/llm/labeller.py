"""A recurrent block labeller in numpy: a bidirectional LSTM over a page's blocks, trained on generated pages.

A block is read as the mean of embeddings of its path's tokens (tags, and words of class, id and role), the mean of
embeddings of its words, both hashed, and a few counts. The two directions carry the whole page's context to every
block. Training pages are drawn from a generator of page layouts; the model is the same for every corpus.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from plumbline.llm.blocks import Block, blocks_of

PATHS, WORDS = 512, 512
PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 16, 6, 8, 16
SPLIT = re.compile(r"[^a-z0-9]+")


def slot(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % n


class Reader:
    """Feature arrays of blocks; path tokens are hashed once for each path while held."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], list[int]] = {}

    def path(self, path: tuple[str, ...]) -> list[int]:
        got = self.paths.get(path)
        if got is None:
            names = [x for part in path for x in SPLIT.split(part) if x and x not in ("html", "body")]
            last = [f"<{x}" for x in SPLIT.split(path[-1]) if x] if path else []
            got = [slot(x, PATHS) for x in [*dict.fromkeys(names), *last]] or [0]
            if len(self.paths) > 20_000:
                self.paths.clear()
            self.paths[path] = got
        return got

    def read(self, pages: list[list[Block]], place: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """place: where in its page each block stands, 0 to 1; None: `pages` are whole."""
        blocks = [b for p in pages for b in p]
        path = [self.path(b.path) for b in blocks]
        crc = zlib.crc32
        word = [[crc(w) % WORDS for w in b.text.lower().encode("utf-8", "replace").split()] for b in blocks]
        chars = np.array([len(b.text) for b in blocks], float)
        words = np.array([len(w) for w in word], float)
        if place is None:
            place = np.concatenate([np.arange(len(p)) / max(len(p), 1) for p in pages] or [np.empty(0)])
        stops = np.array([b.text.count(". ") + b.text.endswith((".", "!", "?")) for b in blocks], float)
        digits = np.array([sum(map(b.text.count, "0123456789")) for b in blocks], float)
        linked = np.array([b.linked for b in blocks], float) / np.maximum(chars, 1)
        counts = np.stack([np.log1p(chars) / 6, np.log1p(words) / 5, np.minimum(linked, 1), np.log1p(stops), place, digits / np.maximum(chars, 1), (words < 4).astype(float), np.ones(len(blocks))], axis=1) if blocks else np.empty((0, COUNTS))
        return {"path": np.array([s for p in path for s in p], np.int64), "paths": np.array([len(p) for p in path], np.int64), "word": np.array([s for w in word for s in w], np.int64), "words": words.astype(np.int64), "counts": counts, "sizes": np.array([len(p) for p in pages], np.int64)}


def bag(table: np.ndarray, slots: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Mean of the table's rows for each run of slots; every run has one at least."""
    starts = np.concatenate(([0], np.cumsum(many)[:-1]))
    return np.add.reduceat(table[slots], starts, axis=0) / many[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def new_model(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + COUNTS
    make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = {"E": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "V": rng.normal(0, 0.1, (WORDS, WORD_DIM)), "out": make(2 * HIDDEN, 1), "bias": np.zeros(1)}
    for way in ("f", "b"):
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1.0
        model |= {f"W{way}": make(d, 4 * HIDDEN), f"U{way}": make(HIDDEN, 4 * HIDDEN), f"c{way}": bias}
    return model


def inputs(model: dict, x: dict) -> np.ndarray:
    return np.concatenate([bag(model["E"], x["path"], x["paths"]), bag(model["V"], x["word"], x["words"]), x["counts"]], axis=1)


def grid(sizes: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Block number at (step, page), and which cells exist; pages read from the end if `back`."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    step = np.arange(sizes.max())[:, None]
    live = step < sizes
    at = first + (sizes - 1 - step if back else step)
    return np.where(live, at, 0), live


def run(model: dict, way: str, x: np.ndarray, live: np.ndarray, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
    """Hidden states (steps, pages, HIDDEN), with `keep` what the way back needs, and the state after the last step."""
    steps, pages, _ = x.shape
    z = x @ model[f"W{way}"] + model[f"c{way}"]
    h, c = state or (np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)))
    out, held = np.empty((steps, pages, HIDDEN)), []
    for t in range(steps):
        a = z[t] + h @ model[f"U{way}"]
        gates = sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        c_new = f * c + i * g
        s = np.tanh(c_new)
        if keep:
            held.append((h, c, i, f, o, g, s))
        m = live[t][:, None]
        h, c = np.where(m, o * s, h), np.where(m, c_new, c)
        out[t] = h
    return out, held, (h, c)


def back(model: dict, way: str, x: np.ndarray, live: np.ndarray, held: list, dout: np.ndarray) -> tuple[np.ndarray, dict]:
    """Gradients of the inputs and of the direction's parameters."""
    steps, pages, _ = x.shape
    U = model[f"U{way}"]
    dz = np.zeros((steps, pages, 4 * HIDDEN))
    dh, dc, dU = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros_like(U)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, s = held[t]
        m = live[t][:, None]
        into, state = np.where(m, dh + dout[t], 0), np.where(m, dc, 0)
        state = state + into * o * (1 - s * s)
        d = np.concatenate([state * g * i * (1 - i), state * c * f * (1 - f), into * s * o * (1 - o), state * i * (1 - g * g)], axis=1)
        dz[t] = d
        dU += h.T @ d
        dh, dc = np.where(m, d @ U.T, dh), np.where(m, state * f, dc)
    flat = dz.reshape(-1, 4 * HIDDEN)
    return dz @ model[f"W{way}"].T, {f"W{way}": x.reshape(len(flat), -1).T @ flat, f"U{way}": dU, f"c{way}": flat.sum(axis=0)}


def logits(model: dict, x: dict) -> np.ndarray:
    """A number for each block of the pages read, positive for main text. Pages of like size run together."""
    sizes = x["sizes"]
    score = np.zeros(int(sizes.sum()))
    if not len(score):
        return score
    flat = inputs(model, x)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        top = sizes[order[at]]
        some = order[at : at + 256]
        some = some[sizes[some] * 2 >= top]
        at += len(some)
        for way in ("f", "b"):
            where, live = grid(sizes[some], way == "b")
            start = first[some] - np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            where = np.where(live, where + start, 0)
            h, _, _ = run(model, way, flat[where], live, False)
            score[where[live]] += h[live] @ model["out"][:HIDDEN, 0] if way == "f" else h[live] @ model["out"][HIDDEN:, 0]
    return score + model["bias"][0]


def long_logits(model: dict, reader: Reader, page: list[Block], stretch: int) -> np.ndarray:
    """logits() of one page, read in stretches of blocks with the state carried on, so that only one is held as arrays."""
    score = np.full(len(page), model["bias"][0])
    starts = list(range(0, len(page), stretch))
    for way, order, out in (("f", starts, model["out"][:HIDDEN, 0]), ("b", starts[::-1], model["out"][HIDDEN:, 0])):
        state = None
        for a in order:
            some = page[a : a + stretch]
            turn = slice(None, None, 1 if way == "f" else -1)
            flat = inputs(model, reader.read([some], np.arange(a, a + len(some)) / len(page)))[turn]
            h, _, state = run(model, way, flat[:, None], np.ones((len(some), 1), bool), False, state)
            score[a : a + len(some)][turn] += h[:, 0] @ out
    return score


#: Pages of more blocks are read in stretches of so many.
STRETCH = 4096


def labelled(model: dict, reader: Reader, pages: list[list[Block]]) -> np.ndarray:
    """A number for each block of the pages, one page after the other, positive for main text."""
    short = [p if len(p) <= STRETCH else [] for p in pages]
    score = logits(model, reader.read(short))
    if all(len(p) <= STRETCH for p in pages):
        return score
    cut = np.cumsum([len(p) for p in short])[:-1]
    return np.concatenate([long_logits(model, reader, p, STRETCH) if len(p) > STRETCH else s for p, s in zip(pages, np.split(score, cut))])


def learn(pages: list[list[Block]], truth: list[list[int]], *, rounds: int = 7, group: int = 24, rate: float = 0.01, seed: int = 3) -> dict:
    """Adam on the cross entropy of blocks."""
    rng, model, reader = np.random.default_rng(seed), new_model(seed), Reader()
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(x) for k, x in model.items()}
    n = 0
    for turn in range(rounds):
        order = rng.permutation(len(pages))
        for k in range(0, len(order), group):
            some = [i for i in order[k : k + group] if pages[i]]
            x = reader.read([pages[i] for i in some])
            y = np.array([t for i in some for t in truth[i]], float)
            flat = inputs(model, x)
            ways = {}
            total = np.full(len(y), model["bias"][0])
            for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
                where, live = grid(x["sizes"], way == "b")
                h, held, _ = run(model, way, flat[where], live, True)
                total[where[live]] += h[live] @ model["out"][part, 0]
                ways[way] = (where, live, h, held, part)
            d = (sigmoid(total) - y) / len(y)
            grads, dflat = {"bias": np.array([d.sum()]), "out": np.zeros_like(model["out"])}, np.zeros_like(flat)
            for way, (where, live, h, held, part) in ways.items():
                grads["out"][part, 0] = d[where[live]] @ h[live]
                dout = np.zeros_like(h)
                dout[live] = d[where[live]][:, None] * model["out"][part, 0]
                dx, own = back(model, way, flat[where], live, held, dout)
                np.add.at(dflat, where[live], dx[live])
                grads |= own
            for name, slots, many, cols in (("E", "path", "paths", slice(0, PATH_DIM)), ("V", "word", "words", slice(PATH_DIM, PATH_DIM + WORD_DIM))):
                g = np.zeros_like(model[name])
                np.add.at(g, x[slots], np.repeat(dflat[:, cols] / x[many][:, None], x[many], axis=0))
                grads[name] = g
            n += 1
            for key, g in grads.items():
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.999 * v[key] + 0.001 * g * g
                model[key] = model[key] - rate * (1 - 0.9 * turn / rounds) * (m[key] / (1 - 0.9**n)) / (np.sqrt(v[key] / (1 - 0.999**n)) + 1e-8)
    return model


#: Parts of generated pages: the elements they are, names they go by, and typical words. Fixed values.
PARTS = {
    "menu": (["nav", "div", "ul", "div role=navigation"], ["menu", "navbar", "nav", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "pagination", "site-nav", "navigation"], ["Home", "About", "Contact", "Products", "Login", "News", "Next", "Previous", "Archive"]),
    "header": (["header", "div", "header", "div role=banner"], ["header", "site-header", "masthead", "top", "topbar", "branding", "banner", "logo"], ["Welcome", "Daily", "Search", "Sign", "in", "Edition"]),
    "footer": (["footer", "div", "footer", "div role=contentinfo"], ["footer", "site-footer", "bottom", "copyright", "colophon", "legal", "foot"], ["©", "·", "Copyright", "All", "rights", "reserved", "Privacy", "Terms", "Imprint", "Impressum"]),
    "sidebar": (["aside", "div", "aside", "div role=complementary"], ["sidebar", "side", "widget", "related", "right-column", "most-read", "trending", "recommended", "tags", "rail"], ["Related", "Popular", "Trending", "Latest", "More", "Tags"]),
    "notice": (["div", "section", "aside", "noscript", "div role=dialog", "div role=alert"], ["cookie", "notice", "consent", "gdpr", "cookie-banner", "alert", "popup", "modal", "overlay", "paywall", "message"], ["cookies", "Accept", "consent", "privacy", "settings", "browser", "continue", "policy"]),
    "advert": (["div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adbox", "sponsor", "promotion"], ["Advertisement", "Buy", "Sale", "Sponsored", "Offer", "%"]),
    "form": (["form", "form", "div"], ["search", "login", "newsletter", "subscribe", "signup", "search-form", "contact-form", "form"], ["Email", "Password", "Submit", "Subscribe", "Name", "Search", "Send"]),
    "comments": (["section", "div", "ol", "aside"], ["comments", "comment", "comment-list", "discussion", "replies", "respond", "comments-area", "disqus"], ["Reply", "Comments", "says", "wrote", "ago", "Like", "Report"]),
    "share": (["div", "ul", "section"], ["share", "social", "sharing", "follow-us", "buttons", "tools", "meta", "byline-tools"], ["Share", "Tweet", "Facebook", "Print", "Follow"]),
}
HOMES = [("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("section", "article"), ("div", "post"), ("div", "entry-content"), ("div", "main"), ("div", "story"), ("section", "text"), ("div role=main", "")]


def generated(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page, and for each of its blocks whether it is main text."""
    syllables = ["".join(rng.choice(list("bcdfghklmnprstvwz"), 1)) + "".join(rng.choice(["a", "e", "i", "o", "u", "an", "er", "on", "st", "é", "ü"], 1)) for _ in range(40)]
    pick = lambda x: x[int(rng.integers(len(x)))]
    label: list[int] = []

    def words(low: int, high: int) -> str:
        w = ["".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(low, high)))]
        noise = pick(["", "", "", " |", "%%%", "***"])
        text = (noise + " ").join(w).capitalize() + pick([".", ".", ".", "", "!"])
        return text.upper() if rng.random() < 0.05 else text

    def element(kind: str, name: str, inside: str) -> str:
        tag, _, role = kind.partition(" ")
        named = f' {pick(["class", "class", "id"])}="{pick(["", "", "c1 ", "box "])}{name}"' if name else ""
        return f"<{tag}{' ' + role if role else ''}{named}>{inside}</{tag}>"

    def part(kind: str) -> str:
        kinds, names, typical = PARTS[kind]
        lines = []
        for _ in range(int(rng.integers(1, 7 if kind in ("menu", "comments", "sidebar") else 4))):
            long = kind in ("comments", "notice", "advert", "sidebar") and rng.random() < 0.6
            text = words(4, 40) if long else words(1, 6)
            if rng.random() < 0.6:
                text = f"{pick(typical)} {text}" if rng.random() < 0.7 else pick(typical)
            if rng.random() < (0.8 if kind in ("menu", "share", "sidebar") else 0.2):
                text = f'<a href="/x">{text}</a>'
            lines.append(text)
        label.extend([0] * len(lines))
        if len(lines) == 1 and rng.random() < 0.6:
            inside = lines[0]
        else:
            tag = pick(["li", "p", "div"])
            inside = "".join(f"<{tag}>{x}</{tag}>" for x in lines)
            inside = f"<ul>{inside}</ul>" if tag == "li" else inside
        holder = pick(kinds)
        # Only elements that say what they are do without a name.
        plain = holder in ("nav", "header", "footer", "aside", "form", "noscript") and rng.random() < 0.5
        return element(holder, "" if plain else pick(names), inside)

    def story() -> str:
        out = []
        again = words(1, 4) if rng.random() < 0.08 else ""
        for k in range(int(rng.integers(1, 40 if again else 14))):
            kind = "h1" if k == 0 and rng.random() < 0.7 else pick(["p"] * 12 + ["h2", "h3", "blockquote", "li", "td", "pre", "figcaption"])
            text = words(1, 12) if kind[0] == "h" else words(1, 90) if rng.random() < 0.65 else words(1, 4)
            text = again if again and kind == "p" else text
            text = " ".join([text] * int(rng.integers(2, 20))) if rng.random() < 0.04 else text
            if rng.random() < 0.1:
                text = f'{text} <a href="/y">{words(1, 4)}</a> {words(1, 9)}'
            if rng.random() < 0.15:
                out.append(f"<p><b>{text}<br>")
            else:
                wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>", "figcaption": "<figure><figcaption>{}</figcaption></figure>"}.get(kind, "<{0}>{{}}</{0}>".format(kind))
                out.append(wrap.format(text))
            label.append(1)
            if rng.random() < 0.06:
                out.append(part(pick(["advert", "sidebar", "share", "form", "notice"])))
        return "".join(out)

    def some(kinds: list[str], share: float) -> str:
        return "".join(part(k) for k in kinds if rng.random() < share)

    body = some(["notice", "header", "menu", "advert"], 0.55)
    tag, name = pick(HOMES)
    inner = element(tag, name, story() + some(["share", "comments"], 0.2))
    if rng.random() < 0.4:
        inner = element(pick(["div", "main", "div"]), pick(["wrapper", "page", "container", "content"]), inner + some(["sidebar"], 0.5))
    body += inner + some(["share", "comments", "sidebar", "form", "advert", "menu", "footer"], 0.45)
    return f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title></head><body>{body}</body></html>", label


_HELD: dict[tuple[int, int], dict] = {}


def trained(pages: int = 1000, seed: int = 3) -> dict:
    """The labeller, trained once in a process for given arguments."""
    if (pages, seed) not in _HELD:
        rng = np.random.default_rng(seed)
        made = [generated(rng) for _ in range(pages)]
        read = [(blocks_of(p), y) for p, y in made]
        read = [(b, y) for b, y in read if len(b) == len(y)]
        _HELD[pages, seed] = learn([b for b, _ in read], [y for _, y in read], seed=seed)
    return _HELD[pages, seed]
